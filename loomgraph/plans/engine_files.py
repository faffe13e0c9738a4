"""Chunks of files and the index flow, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import chunking as CH
from loomgraph.operators import files as FI

from . import derived as D
from .base import query

t = D.table

# a Markdown file for each document: a title, its text cut at full stops into lines, a section of a few words, and one by rank
MD = "SELECT source || '/' || doc_id || '.md' AS path, '# ' || lang || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10)) || chr(10) || chr(10) || '## short' || chr(10) || 'x' || chr(10) || '## tail' || chr(10) || 'the end of it, number ' || doc_id AS text, doc_id FROM documents WHERE NOT contains(coalesce(text, ''), '#')"


def markdown(s, d):
    body = F.concat(F.lit("# "), "lang", F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")), F.lit("\n\n## short\nx\n## tail\nthe end of it, number "), "doc_id")
    docs = t(s, d, "documents").filter(~F.contains(F.coalesce("text", F.lit("")), F.lit("#")))
    return docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), body.alias("text"), F.sha2(body, 256).alias("content_hash"), "doc_id")


def sections(files):
    from loomgraph.operators.chunks import markdown_sections

    return markdown_sections(files).withColumn("kind", F.lit("section"))


SECTIONS = f"""md AS ({MD}), ls AS (SELECT path, k, ls[k] AS line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT path, string_split(text, chr(10)) AS ls FROM md))),
sc AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#+\\s+.+') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY k) AS sec FROM ls),
un AS (SELECT path, sec, CAST(min(k) AS INTEGER) AS start_line, CAST(max(k) FILTER (WHERE regexp_matches(line, '\\S')) AS INTEGER) AS end_line, trim(regexp_extract(arg_min(line, k), '^#+\\s+(.+)', 1)) AS name FROM sc WHERE sec > 0 GROUP BY ALL),
se AS (SELECT u.path, u.sec, u.start_line, u.end_line, CASE WHEN u.sec = 1 THEN u.name ELSE (SELECT f.name FROM un f WHERE f.path = u.path AND f.sec = 1) || ' > ' || u.name END AS name, string_agg(line, chr(10) ORDER BY k) AS content FROM un u JOIN sc ON sc.path = u.path AND sc.sec = u.sec AND k <= end_line GROUP BY ALL)"""
# paragraphs of long sections, packed greedily: a chain from the first paragraph to the one that no longer fits
PACKED = """pg0 AS (SELECT sc.path, sc.sec, sc.k, line, sum(CASE WHEN regexp_matches(line, '\\S') THEN 0 ELSE 1 END) OVER (PARTITION BY sc.path, sc.sec ORDER BY sc.k) AS gap FROM sc JOIN se ON se.path = sc.path AND se.sec = sc.sec AND sc.k <= se.end_line WHERE length(content) > 2000),
pg AS (SELECT path, sec, row_number() OVER (PARTITION BY path, sec ORDER BY min(k)) AS p, CAST(min(k) AS INTEGER) AS a, CAST(max(k) AS INTEGER) AS b, string_agg(line, chr(10) ORDER BY k) AS x FROM pg0 WHERE regexp_matches(line, '\\S') GROUP BY path, sec, gap),
pk AS (SELECT path, sec, p, a, b, x AS content, CAST(0 AS BIGINT) AS piece FROM pg WHERE p = 1 UNION ALL SELECT n.path, n.sec, n.p, CASE WHEN length(content) + 2 + length(n.x) <= 2000 THEN pk.a ELSE n.a END, n.b, CASE WHEN length(content) + 2 + length(n.x) <= 2000 THEN content || chr(10) || chr(10) || n.x ELSE n.x END, piece + CASE WHEN length(content) + 2 + length(n.x) <= 2000 THEN 0 ELSE 1 END FROM pk JOIN pg n ON n.path = pk.path AND n.sec = pk.sec AND n.p = pk.p + 1),
pz AS (SELECT path, sec, piece, arg_max(a, p) AS a, arg_max(b, p) AS b, arg_max(content, p) AS content FROM pk GROUP BY ALL),
ck AS (SELECT path, name, start_line AS line_start, end_line AS line_end, content FROM se WHERE length(content) <= 2000 AND length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) >= 20 UNION ALL SELECT pz.path, name, a, b, pz.content FROM pz JOIN se USING (path, sec))"""


@query(f"WITH RECURSIVE {SECTIONS}, {PACKED} SELECT path, name, line_start, line_end, md5(content) AS digest FROM ck")
def markdown_chunks(s, d):
    f = markdown(s, d)
    return CH.file_chunks(f, sections(f)).select("path", "name", "line_start", "line_end", F.md5("content").alias("digest"))


@query(f"WITH RECURSIVE {SECTIONS}, {PACKED} SELECT path, line_start, md5('File: ' || path || chr(10) || '[section: ' || name || ']' || chr(10) || content) AS digest FROM ck")
def embedding_texts(s, d):
    f = markdown(s, d)
    c = CH.file_chunks(f, sections(f))
    return c.select("path", "line_start", F.md5(CH.embedding_text(F.col("path"), F.col("kind"), F.col("name"), F.col("content"))).alias("digest"))


# code: a file for each part brand, a unit for each part, each of some lines; every seventh is long, with a blank line now and then
CODE = "ln AS (SELECT p_brand AS path, p_partkey AS u, i, CASE WHEN i % 9 = 8 THEN '' ELSE 'line ' || i || ' of ' || p_name END AS line FROM (SELECT p_brand, p_partkey, p_name, unnest(range(0, CASE WHEN p_partkey % 7 = 0 THEN 200 ELSE 3 END)) AS i FROM part)), nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY u, i) AS INTEGER) AS no FROM ln)"


def code(s, d):
    n = F.when(F.col("p_partkey") % 7 == 0, 200).otherwise(3)
    ln = t(s, d, "part").select(F.col("p_brand").alias("path"), "p_partkey", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "p_name")
    ln = ln.withColumn("line", F.when(F.col("i") % 9 == 8, "").otherwise(F.concat(F.lit("line "), "i", F.lit(" of "), "p_name")))
    files = ln.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "i", "line"))), lambda x: x["line"]), "\n").alias("text")).withColumn("language", F.lit("python"))
    from pyspark.sql import Window as W

    size = t(s, d, "part").select(F.col("p_brand").alias("path"), "p_partkey", n.alias("n"))
    upto = F.sum("n").over(W.partitionBy("path").orderBy("p_partkey"))
    units = size.select("path", F.concat(F.lit("u"), "p_partkey").alias("name"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("parent"), (upto - F.col("n") + 1).cast("int").alias("start_line"), upto.cast("int").alias("end_line"))
    return files, units


@query(f"""WITH RECURSIVE {CODE}, un AS (SELECT path, u, min(no) AS s, max(no) AS e, string_agg(line, chr(10) ORDER BY no) AS content FROM nu GROUP BY ALL),
st AS (SELECT n.path, n.u, n.no, length(n.line) + 1 AS size, CASE WHEN length(n.line) + 1 >= 2000 AND (trim(n.line) = '' OR n.no = e) THEN TRUE ELSE FALSE END AS cut, 0 AS part FROM nu n JOIN un ON un.path = n.path AND un.u = n.u AND n.no = s WHERE length(content) > 2000
UNION ALL SELECT n.path, n.u, n.no, z, z >= 2000 AND (trim(n.line) = '' OR n.no = e), part + CASE WHEN st.cut THEN 1 ELSE 0 END FROM st JOIN nu n ON n.path = st.path AND n.u = st.u AND n.no = st.no + 1 JOIN un ON un.path = n.path AND un.u = n.u, LATERAL (SELECT CASE WHEN st.cut THEN 0 ELSE st.size END + length(n.line) + 1 AS z) q)
SELECT path, 'u' || u AS name, s AS line_start, e AS line_end, md5(content) AS digest FROM un WHERE length(content) <= 2000
UNION ALL SELECT st.path, 'u' || st.u || '[' || part || ']', min(st.no), max(st.no), md5(string_agg(line, chr(10) ORDER BY st.no)) FROM st JOIN nu n ON n.path = st.path AND n.u = st.u AND n.no = st.no GROUP BY st.path, st.u, part""")
def code_chunks(s, d):
    f, u = code(s, d)
    return CH.file_chunks(f, u).select("path", "name", "line_start", "line_end", F.md5("content").alias("digest"))


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'About ' || lang ELSE substr(trim(coalesce(text, '')), 1, 200) END AS summary, CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [] END AS topics FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[{}\\[\\]]') AND NOT regexp_matches(coalesce(text, ''), '^\\s|\\s$')")
def chunk_summaries(s, d):
    x = F.coalesce("text", F.lit(""))
    docs = t(s, d, "documents").filter(~x.rlike(r"[{}\[\]]") & ~x.rlike(r"^\s|\s$"))
    good = F.concat(F.lit('ok {"summary": "About '), "lang", F.lit('", "topics": ["'), "lang", F.lit('", "'), "source", F.lit('"]}'))
    return CH.summaries(docs.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, good).otherwise(x).alias("reply")))


# ------------------------------------------------------------------ the index flow

ID = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
HASHED = f"fi AS (SELECT path, sha256(text) AS content_hash, doc_id FROM ({MD}))"


def stored_graph(s, d):
    """What an earlier run left: files of even ids, every fourth with another hash, each with one old unit, and edges to it."""
    f = markdown(s, d).filter("doc_id % 2 = 0")
    hash_ = F.when(F.col("doc_id") % 4 == 0, F.lit("old")).otherwise(F.col("content_hash"))
    files = f.select(FI.make_id(F.col("path")).alias("id"), "path", F.lit("File").alias("type"), F.lit("file").alias("kind"), hash_.alias("content_hash"), (F.col("doc_id") % 8 == 0).alias("stale"), "doc_id")
    units = files.select(F.concat("id", F.lit("__old")).alias("id"), "path", F.lit("Section").alias("type"), F.lit("section").alias("kind"), F.lit(None).cast("string").alias("content_hash"), F.lit(False).alias("stale"), "doc_id")
    nodes = files.unionByName(units).withColumn("label", F.substring_index("path", "/", -1))
    edges = units.select(F.substring_index("id", "__", 1).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"))
    return nodes, edges


STORED = f"""{HASHED}, old AS (SELECT {ID.format('path')} AS id, path, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE content_hash END AS content_hash, doc_id FROM fi WHERE doc_id % 2 = 0)"""


@query(f"""WITH {STORED}, nw AS (SELECT * FROM fi WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = fi.path AND old.content_hash = fi.content_hash)),
{SECTIONS}, ni AS (SELECT DISTINCT {ID.format("split_part(path, '/', 1)")} AS id, 'folder' AS kind FROM nw UNION SELECT {ID.format('path')}, 'file' FROM nw UNION SELECT {ID.format('un.path')} || '__' || CASE WHEN sec = 1 THEN '' ELSE (SELECT {ID.format('f.name')} FROM un f WHERE f.path = un.path AND f.sec = 1) || '__' END || {ID.format('name')}, 'section' FROM un JOIN nw USING (path))
SELECT id, kind FROM ni UNION SELECT id, 'file' FROM old WHERE doc_id % 4 <> 0 UNION SELECT id || '__old', 'section' FROM old WHERE doc_id % 4 <> 0""")
def index_nodes(s, d):
    n, e = stored_graph(s, d)
    nodes, _, _ = FI.index(n, e, markdown(s, d))
    return nodes.select("id", "kind")


@query(f"""WITH {STORED}, nw AS (SELECT * FROM fi WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = fi.path AND old.content_hash = fi.content_hash)),
{SECTIONS}, nu AS (SELECT {ID.format('un.path')} AS file, sec, {ID.format('un.path')} || '__' || CASE WHEN sec = 1 THEN '' ELSE (SELECT {ID.format('f.name')} FROM un f WHERE f.path = un.path AND f.sec = 1) || '__' END || {ID.format('name')} AS id FROM un JOIN nw USING (path))
SELECT DISTINCT {ID.format("split_part(path, '/', 1)")} AS source, {ID.format('path')} AS target, 'contains' AS relation FROM nw UNION SELECT file, id, 'contains' FROM nu
UNION SELECT a.id, b.id, 'child_of' FROM nu a JOIN nu b ON a.file = b.file AND a.sec > 1 AND b.sec = 1 UNION SELECT id, id || '__old', 'contains' FROM old WHERE doc_id % 4 <> 0""")
def index_edges(s, d):
    n, e = stored_graph(s, d)
    _, edges, _ = FI.index(n, e, markdown(s, d))
    return edges.select("source", "target", "relation")


@query(f"WITH RECURSIVE {STORED}, {SECTIONS}, {PACKED} SELECT path, count(*) AS n FROM ck WHERE NOT EXISTS (SELECT 1 FROM old JOIN fi USING (path, content_hash) WHERE old.path = ck.path) GROUP BY path")
def index_chunks(s, d):
    n, e = stored_graph(s, d)
    _, _, chunks = FI.index(n, e, markdown(s, d))
    return chunks.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STORED}, {SECTIONS}, st AS (SELECT * FROM old WHERE doc_id % 8 = 0), gone AS (SELECT * FROM st WHERE doc_id % 16 = 0), again AS (SELECT * FROM st WHERE doc_id % 16 <> 0)
SELECT id, 'file' AS kind FROM old WHERE doc_id % 16 <> 0 UNION SELECT id || '__old', 'section' FROM old WHERE doc_id % 8 <> 0 OR doc_id % 16 = 0
UNION SELECT {ID.format("split_part(path, '/', 1)")}, 'folder' FROM again UNION SELECT {ID.format('un.path')} || '__' || CASE WHEN sec = 1 THEN '' ELSE (SELECT {ID.format('f.name')} FROM un f WHERE f.path = un.path AND f.sec = 1) || '__' END || {ID.format('name')}, 'section' FROM un JOIN again USING (path)""")
def reindex_stale(s, d):
    n, e = stored_graph(s, d)
    files = markdown(s, d).filter("doc_id % 16 <> 0")
    nodes, _ = FI.reindex(n, e, files, sections(files))
    return nodes.select("id", "kind")


@query("""WITH u AS (SELECT o_custkey AS path, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
m AS (SELECT l_suppkey AS path, 'sum ' || l_orderkey || '/' || l_linenumber AS summary, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem)
SELECT u.path, u.id, m.summary FROM u LEFT JOIN m ON m.path = u.path AND m.k = u.k""")
def attach_summaries(s, d):
    u = t(s, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"))
    m = t(s, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.concat(F.lit("sum "), "l_orderkey", F.lit("/"), "l_linenumber").alias("summary"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return FI.attach_summaries(u, m).select("path", "id", "summary")


@query(f"""WITH {STORED}, x AS (SELECT min(path) AS p FROM old) SELECT 'node' AS what, id FROM old, x WHERE path <> p UNION ALL SELECT 'node', id || '__old' FROM old, x WHERE path <> p
UNION ALL SELECT 'edge', id || '__old' FROM old, x WHERE path <> p UNION ALL SELECT 'chunk', path FROM old, x WHERE path <> p""")
def delete_document(s, d):
    n, e = stored_graph(s, d)
    files = n.filter("kind = 'file'")
    first = files.agg(F.min("path")).first()[0]
    nodes, edges, chunks = FI.delete_document(n, e, files.select("path"), first)
    return nodes.select(F.lit("node").alias("what"), "id").unionByName(edges.select(F.lit("edge").alias("what"), F.col("target").alias("id"))).unionByName(chunks.select(F.lit("chunk").alias("what"), F.col("path").alias("id")))
