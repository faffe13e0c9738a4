"""Registered queries of the engine's own operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions import text as X
from loomgraph.operators import chunks as C
from loomgraph.operators import context as K
from loomgraph.operators import extract as X_
from loomgraph.operators import facts as FA
from loomgraph.operators import graph as G
from loomgraph.operators import rank as R
from loomgraph.operators import turns as T
from loomgraph.streaming import turns as S_

from . import derived as D
from .base import QUERIES, SQL, query

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


t = D.table
N, E, P, B = D.NODES, D.EDGES, D.PLACES, D.BOTH

# ------------------------------------------------------------------ graph reads


@query(f"WITH {N} SELECT * FROM nodes")
def scan_nodes(s, d):
    return D.nodes(s, d)


@query(f"WITH {N} SELECT * FROM nodes WHERE lower(label) LIKE '%nation_1%' ORDER BY seq LIMIT 1")
def node_lookup(s, d):
    return G.lookup(D.nodes(s, d), F.lit("NATION_1"), F.lit("nation 1"))


@query(f"WITH {N} SELECT id, label, type FROM nodes WHERE contains(lower(label), 'nation_1') OR contains('nation_1', lower(label))")
def node_search_bidirectional(s, d):
    return G.search(D.nodes(s, d), "NATION_1").select("id", "label", "type")


SECTIONS = "sections AS (SELECT 'file_' || o_custkey || '__' || o_orderkey AS id, o_orderpriority AS label, CASE o_orderkey % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'symbol' ELSE 'entity' END AS kind, o_orderkey AS seq FROM orders)"


def sections(s, d):
    k = F.col("o_orderkey") % 3
    return t(s, d, "orders").select(F.concat(F.lit("file_"), "o_custkey", F.lit("__"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.when(k == 0, "section").when(k == 1, "symbol").otherwise("entity").alias("kind"), F.col("o_orderkey").alias("seq"))


@query(f"WITH {SECTIONS} SELECT id, label FROM sections WHERE starts_with(id, 'file_1__') AND kind <> 'entity'")
def children_by_prefix(s, d):
    return G.children(sections(s, d), "file_1").select("id", "label")


@query(f"WITH {P} SELECT source, target, relation FROM edges WHERE source IN ('nation_3', 'region_1') OR target IN ('nation_3', 'region_1')")
def incident_edges(s, d):
    return G.incident(D.edges(s, d, uses=False), ["nation_3", "region_1"]).select("source", "target", "relation")


@query(f"""WITH {N}, {E}, {B},
best AS (SELECT src, dst, max(weight) AS weight, min(seq) AS seq FROM both_ GROUP BY src, dst),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, seq, dst) AS INTEGER) AS rank FROM best)
SELECT src, dst, label, weight, rank FROM r JOIN nodes ON dst = id WHERE rank <= 5""")
def neighbors_top5_max_weight(s, d):
    return G.neighbors(D.nodes(s, d), D.edges(s, d))


@query(f"""WITH RECURSIVE {P}, {B},
r AS (SELECT 'nation_3' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN both_ ON src = id WHERE depth < 2)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id""")
def bfs_layers(s, d):
    return G.layers(D.edges(s, d, uses=False), s.createDataFrame([("nation_3",)], "id string"))


@query(f"""WITH {N}, {P}, {B},
f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq, dst) AS rank FROM both_)
SELECT src, CASE relation WHEN 'part_of' THEN 'Part of' WHEN 'located_in' THEN 'Located in' ELSE relation END AS name, string_agg(label, ', ' ORDER BY rank) AS ends
FROM f JOIN nodes ON dst = id WHERE rank <= 12 GROUP BY 1, 2""")
def relation_grouping(s, d):
    return G.grouped_relations(D.edges(s, d, uses=False), D.nodes(s, d), {"part_of": "Part of", "located_in": "Located in"})


@query(f"WITH {N}, {P} SELECT CASE WHEN kind IS NULL THEN 'entity' ELSE kind END AS kind, type, count(*) AS n FROM nodes GROUP BY 1, 2")
def graph_stats_by_kind(s, d):
    return D.nodes(s, d).groupBy(F.coalesce("kind", F.lit("entity")).alias("kind"), "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {N}, {P} SELECT id, label FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges WHERE source = id OR target = id)""")
def orphan_entities(s, d):
    return G.orphans(D.nodes(s, d), D.edges(s, d, uses=False)).select("id", "label")


ORDERS = "SELECT 'customer_' || o_custkey AS source, 'priority_' || substr(o_orderpriority, 1, 1) AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'related_to' WHEN o_orderkey % 3 = 1 THEN 'ordered' ELSE 'asked' END AS relation, 1.0::DOUBLE AS weight, o_orderkey AS seq FROM orders"


def order_edges(s, d):
    r = F.when(F.col("o_orderkey") % 3 == 0, "related_to").when(F.col("o_orderkey") % 3 == 1, "ordered").otherwise("asked")
    return t(s, d, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("source"), F.concat(F.lit("priority_"), F.substring("o_orderpriority", 1, 1)).alias("target"), r.alias("relation"), F.lit(1.0).alias("weight"), F.col("o_orderkey").alias("seq"))


@query(f"WITH e AS ({ORDERS}) SELECT source, target, relation, min(seq) AS seq FROM e GROUP BY ALL")
def edge_dedup_directed(s, d):
    return G.dedup_directed(order_edges(s, d)).select("source", "target", "relation", "seq")


@query(f"""WITH e AS ({ORDERS}), r AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target)
ORDER BY relation IN ('related_to', 'uses', 'uses_technology', 'belongs_to', 'associated_with'), seq) AS rn FROM e WHERE source <> target)
SELECT source, target, relation, seq FROM r WHERE rn = 1""")
def edge_one_per_pair_upgrade(s, d):
    return G.one_per_pair(order_edges(s, d)).select("source", "target", "relation", "seq")


@query(f"WITH {N}, e AS ({ORDERS}) SELECT source, target, relation, seq FROM e WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)")
def dangling_edges(s, d):
    return G.dangling(order_edges(s, d), D.nodes(s, d)).select("source", "target", "relation", "seq")


@query(f"""WITH {N}, {P} SELECT count(*) AS edges, (SELECT count(*) FROM nodes) AS nodes FROM
(SELECT DISTINCT source, target, relation FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))""")
def repair_report(s, d):
    n, e = G.repaired(D.nodes(s, d), D.edges(s, d, uses=False))
    a = n.agg(F.count(F.lit(1)).alias("nodes")).withColumn("k", F.lit(1))
    return e.agg(F.count(F.lit(1)).alias("edges")).withColumn("k", F.lit(1)).join(a, "k").select("edges", "nodes")


@query(f"""WITH {P}, m AS (SELECT 'supplier_' || s_suppkey AS old, 'customer_' || s_suppkey AS new FROM supplier),
e AS (SELECT coalesce(a.new, source) AS source, coalesce(b.new, target) AS target, relation, weight, seq FROM edges LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target)
SELECT source, target, relation, min(seq) AS seq FROM e WHERE source <> target GROUP BY 1, 2, 3""")
def merge_nodes_remap(s, d):
    m = t(s, d, "supplier").select(F.concat(F.lit("supplier_"), "s_suppkey").alias("old"), F.concat(F.lit("customer_"), "s_suppkey").alias("new"))
    return G.merged_edges(D.edges(s, d, uses=False), m).select("source", "target", "relation", "seq")


@query(f"""WITH {P}, i AS (SELECT target AS source, source AS target, CASE WHEN seq % 2 = 0 THEN relation ELSE 'near' END AS relation, seq FROM edges)
SELECT source, target, relation, seq FROM i WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE least(e.source, e.target) = least(i.source, i.target)
AND greatest(e.source, e.target) = greatest(i.source, i.target) AND e.relation = i.relation)""")
def import_merge(s, d):
    e = D.edges(s, d, uses=False)
    new = e.select(F.col("target").alias("source"), F.col("source").alias("target"), F.when(F.col("seq") % 2 == 0, F.col("relation")).otherwise("near").alias("relation"), "seq")
    return G.imported_edges(e, new).select("source", "target", "relation", "seq")


@query("""WITH q AS (SELECT DISTINCT 'how many ' || p_name || ' in ' || n_name AS text FROM part, nation), n AS (SELECT 'nation_' || n_nationkey AS id, n_name AS label FROM nation)
SELECT text, id FROM q, n WHERE length(label) >= 3 AND contains(lower(text), lower(label))""")
def seed_selection(s, d):
    nation = t(s, d, "nation")
    q = t(s, d, "part").select("p_name").distinct().join(F.broadcast(nation.select("n_name")))
    q = q.select(F.concat(F.lit("how many "), "p_name", F.lit(" in "), "n_name").alias("text")).distinct()
    return G.seeds(q, nation.select(F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))).select("text", "id")


# ------------------------------------------------------------------ text

WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents"
FOLD = "regexp_replace(strip_accents(lower(w)), '[^\\x00-\\x7F]', '', 'g')"


@query(f"WITH x AS ({WORDS}) SELECT w, trim(regexp_replace({FOLD}, '[^a-z0-9]+', '_', 'g'), '_') AS id FROM x")
def make_id(s, d):
    return t(s, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", X.make_id(F.col("w")).alias("id"))


MARKED = ["Žižek", "Łódź", "Kőrösi", "Škoda Ørsted", "Ångström", "naïve ťhť", "Ñandú"]


@query(f"SELECT c_custkey, trim(regexp_replace(regexp_replace(strip_accents(lower(w)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_') AS id FROM (SELECT c_custkey, {MARKED!r}[1 + c_custkey % {len(MARKED)}] || c_name AS w FROM customer)")
def make_id_marks(s, d):
    word = F.element_at(F.array(*map(F.lit, MARKED)), (F.col("c_custkey") % len(MARKED) + 1).cast("int"))
    return t(s, d, "customer").select("c_custkey", X.make_id(F.concat(word, "c_name")).alias("id"))


@query("""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9\\s]', '', 'g') AS b FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(b, '\\b(el|la|los|las|un|una|de|del|en|the|a|an|of|in)\\b', '', 'g'), '\\s+', ' ', 'g'))) AS form FROM x""")
def dedup_normalize(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.dedup_form(F.col("text"))).alias("form"))


@query("SELECT conv_id, turn, greatest(1, CAST(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INTEGER)) AS tokens FROM conversations")
def count_tokens(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", X.count_tokens(F.col("text")).alias("tokens"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM p""")
def jaccard_pairs(s, d):
    w = t(s, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("w"))
    a, b = w.toDF("conv_id", "turn", "x"), w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


def _hits(signs):
    return " + ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')::INT" for p in signs)


TALK = "(SELECT conv_id, turn, text || ' ' || CASE turn % 5 WHEN 0 THEN 'Show me the code' WHEN 1 THEN 'what is the idea' WHEN 2 THEN 'By the way, how many' WHEN 3 THEN 'cambiando de tema' ELSE '' END AS text FROM conversations) x"


def talk(s, d):
    k = F.col("turn") % 5
    asked = F.when(k == 0, "Show me the code").when(k == 1, "what is the idea").when(k == 2, "By the way, how many").when(k == 3, "cambiando de tema").otherwise("")
    return t(s, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), asked).alias("text"))


@query(f"SELECT conv_id, turn, CASE WHEN {_hits(X.SPECIFIC)} >= {_hits(X.CONCEPTUAL)} THEN 'specific' ELSE 'conceptual' END AS kind FROM {TALK}")
def specificity(s, d):
    return talk(s, d).select("conv_id", "turn", X.specificity(F.col("text")).alias("kind"))


@query(f"SELECT conv_id, turn, lower(regexp_extract(text, '(?i)({'|'.join(X.CHANGE).replace(chr(39), chr(39) * 2)})', 1)) AS phrase FROM {TALK}")
def topic_change_phrase(s, d):
    return talk(s, d).select("conv_id", "turn", X.change_phrase(F.col("text")).alias("phrase"))


@query(f"SELECT conv_id, turn, {' OR '.join(f'contains(lower(text), {chr(39)}{p}{chr(39)})' for p in X.OVERVIEW)} AS overview FROM {TALK}")
def intent_override(s, d):
    return talk(s, d).select("conv_id", "turn", X.asks_overview(F.col("text")).alias("overview"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 58) || '..' ELSE text END AS short FROM documents")
def truncate_text(s, d):
    return t(s, d, "documents").select("doc_id", X.truncate(F.col("text"), 60).alias("short"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace('<think>' || role || '</think> ' || text || ' <think>x', '<think>.*?</think>', '', 'gs'), '<think>.*$', '', 'gs')) AS plain FROM conversations")
def strip_think(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", X.strip_think(F.concat(F.lit("<think>"), "role", F.lit("</think> "), "text", F.lit(" <think>x"))).alias("plain"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(s, d):
    return t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


# ------------------------------------------------------------------ chunks and structure

CHUNKS = """c AS (SELECT doc_id, chunk_index, substr(text, chunk_index * 450 + 1, 500) AS content FROM
(SELECT doc_id, text, CAST(unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil(length(text) / 450.0) AS BIGINT) END)) AS INTEGER) AS chunk_index FROM documents))"""
STATS = "s AS (SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(floor(sum(length(content)) / count(*)) AS BIGINT) AS avg_chars, CAST(min(length(content)) AS INTEGER) AS min_chars, CAST(max(length(content)) AS INTEGER) AS max_chars FROM c GROUP BY doc_id)"


def chunks_of(s, d):
    return C.fixed_chunks(t(s, d, "documents"))


@query(f"WITH {CHUNKS} SELECT * FROM c")
def fixed_chunks_500_50(s, d):
    return chunks_of(s, d)


@query(f"WITH {CHUNKS}, {STATS} SELECT * FROM s")
def chunk_stats(s, d):
    return C.stats(chunks_of(s, d))


@query(f"""WITH {CHUNKS} SELECT CASE WHEN length(content) < 100 THEN '<100' WHEN length(content) < 500 THEN '100-500' WHEN length(content) < 1000 THEN '500-1k'
WHEN length(content) < 2000 THEN '1k-2k' ELSE '>2k' END AS bucket, count(*) AS n FROM c GROUP BY 1""")
def chunk_size_histogram(s, d):
    return C.histogram(chunks_of(s, d))


@query("SELECT doc_id, n AS chunks, length(text) AS chars FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents) WHERE length(text) > 2000 AND n <= 2")
def under_chunked(s, d):
    x = t(s, d, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("chunks"), F.length("text").cast("long").alias("chars"))
    return C.under_chunked(x)


MD = "('# ' || n_name || chr(10) || 'a' || chr(10) || chr(10) || chr(10) || '## ' || r_name || chr(10) || chr(10) || '### x' || n_nationkey || chr(10) || '## y' || chr(10) || chr(10))"


@query(f"""WITH f AS (SELECT n_name AS path, string_split({MD}, chr(10)) AS ls FROM nation JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT path, ls[k] AS line, k, len(ls) AS total FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS k FROM f)),
h AS (SELECT path, k, total, length(regexp_extract(line, '^(#+)\\s', 1)) AS level, trim(regexp_extract(line, '^#+\\s+(.+)', 1)) AS name FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s+.+'))
SELECT path, name, CAST(level AS INTEGER) AS level, CAST(k AS INTEGER) AS start_line, CAST((SELECT max(b.k) FROM l b WHERE b.path = h.path AND trim(b.line) <> '' AND b.k >= h.k AND b.k < coalesce((SELECT min(n.k) FROM h n WHERE n.path = h.path AND n.k > h.k), total + 1)) AS INTEGER) AS end_line,
(SELECT arg_max(p.name, p.k) FROM h p WHERE p.path = h.path AND p.k < h.k AND p.level < h.level) AS parent FROM h""")
def markdown_sections(s, d):
    x = t(s, d, "nation").join(F.broadcast(t(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lit("# "), "n_name", F.lit("\na\n\n\n## "), "r_name", F.lit("\n\n### x"), "n_nationkey", F.lit("\n## y\n\n"))
    return C.markdown_sections(x.select(F.col("n_name").alias("path"), body.alias("text")))


@query("""WITH u AS (SELECT o_custkey AS path, 'o' || min(o_orderkey) AS name, min(o_orderkey) AS start_line, max(o_orderkey) AS end_line FROM orders GROUP BY o_custkey, o_orderstatus)
SELECT path, name, start_line, end_line, list_sort(list(o_orderkey)) AS chunk_ids FROM u JOIN orders ON o_custkey = path WHERE o_orderkey >= start_line AND o_orderkey + 1 <= end_line GROUP BY ALL""")
def chunk_unit_interval_join(s, d):
    o = t(s, d, "orders")
    u = o.groupBy(F.col("o_custkey").alias("path"), "o_orderstatus").agg(F.concat(F.lit("o"), F.min("o_orderkey")).alias("name"), F.min("o_orderkey").alias("start_line"), F.max("o_orderkey").alias("end_line"))
    c = o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("line_start"), (F.col("o_orderkey") + 1).alias("line_end"))
    return C.chunks_in_units(c, u.drop("o_orderstatus"))


@query("""WITH f AS (SELECT n_name || (CASE n_nationkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '/index.js' ELSE '/__init__.py' END) AS file FROM nation),
tr AS (SELECT * FROM (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '.d.ts'), (7, '/index.ts'), (8, '/index.tsx'), (9, '/index.js'), (10, '/index.jsx'), (11, '/__init__.py')) v(r, suf))
SELECT c_name AS path, 'NATION_' || c_nationkey AS target, arg_min(file, r) AS resolved FROM customer, tr JOIN f ON file = 'NATION_' || c_nationkey || suf GROUP BY 1, 2""")
def import_resolution(s, d):
    k = F.col("n_nationkey") % 4
    files = t(s, d, "nation").select(F.concat("n_name", F.when(k == 0, ".ts").when(k == 1, ".py").when(k == 2, "/index.js").otherwise("/__init__.py")).alias("path"))
    imports = t(s, d, "customer").select(F.col("c_name").alias("path"), F.concat(F.lit("NATION_"), "c_nationkey").alias("target"))
    return C.resolve_imports(imports, files)


@query("""WITH x AS (SELECT DISTINCT s_nationkey AS file, s_suppkey AS node, lower(trim('T' || (s_suppkey % 7))) AS topic FROM supplier),
ok AS (SELECT topic FROM x GROUP BY topic HAVING count(*) BETWEEN 2 AND 50 AND count(DISTINCT file) >= 2),
p AS (SELECT x.topic, x.node AS a, y.node AS b, CAST(row_number() OVER (PARTITION BY x.topic ORDER BY x.file, x.node, y.file, y.node) AS INTEGER) AS rank FROM x JOIN ok USING (topic) JOIN x y ON x.topic = y.topic AND x.file < y.file)
SELECT topic, a, b, rank FROM p WHERE rank <= 20""")
def topic_pairs_cross_file(s, d):
    x = t(s, d, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("node"), F.concat(F.lit("T"), F.col("s_suppkey") % 7).alias("topic"))
    return C.topic_pairs(x)


@query("""SELECT regexp_extract(url, '^(https?://[^/]+)', 1) AS site, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1 HAVING count(*) >= 2""")
def group_by_top_dir(s, d):
    return t(s, d, "pages").groupBy(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("site")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("html")).alias("chars")).filter("files >= 2")


@query("SELECT lang, CASE WHEN avg((n_chars > 1500)::INT) > 0.7 THEN 'prose' ELSE 'mixed' END AS content_type FROM documents GROUP BY lang")
def content_type_majority(s, d):
    share = F.avg((F.col("n_chars") > 1500).cast("int"))
    return t(s, d, "documents").groupBy("lang").agg(F.when(share > 0.7, "prose").otherwise("mixed").alias("content_type"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def html_titles(s, d):
    return t(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).cast("long").alias("paragraphs"))


# ------------------------------------------------------------------ vectors and budgets

COS = "round(list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)), 6)"


@query(f"""WITH r AS (SELECT q.vec_id AS query_id, v.vec_id, {COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM r) SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 5""")
def cosine_topk(s, d):
    e = t(s, d, "embeddings")
    return R.top_vectors(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", "embedding"))


@query(f"""WITH r AS (SELECT q.vec_id AS query_id, v.vec_id, round(least({COS[6:-4]} + 0.15, 1.0), 6) AS score FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM r) SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 3""")
def scoped_cosine_top3_boost(s, d):
    e = t(s, d, "embeddings")
    return R.scoped_top(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q")), e, "label")


@query("""WITH RECURSIVE i AS (SELECT o_custkey AS g, o_orderkey AS id, CAST(o_orderkey % 90 + 1 AS BIGINT) AS tk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 13 DESC, o_orderkey) AS k FROM orders),
f AS (SELECT DISTINCT g, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS ids FROM i
UNION ALL SELECT f.g, f.k + 1, CASE WHEN used + tk <= 120 THEN used + tk ELSE used END, CASE WHEN used + tk <= 120 THEN list_append(ids, i.id) ELSE ids END FROM f JOIN i ON i.g = f.g AND i.k = f.k + 1)
SELECT g AS group_id, arg_max(used, k) AS used, arg_max(ids, k) AS item_ids FROM f GROUP BY g""")
def budget_select_skip(s, d):
    o = t(s, d, "orders")
    items = o.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 13).cast("double").alias("score"), (F.col("o_orderkey") % 90 + 1).alias("tokens"), F.col("o_orderkey").alias("seq"))
    return R.select_in_budget(items, 120)


# ------------------------------------------------------------------ conversations

TOK = "greatest(1, CAST(floor(len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INTEGER))"
TK = TOK.format("text")


def conv(s, d):
    return t(s, d, "conversations")


@query("""SELECT conv_id, turn, prev_assistant FROM (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER
(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_assistant FROM conversations) WHERE role = 'user'""")
def prev_assistant(s, d):
    return T.prev_assistant(conv(s, d)).select("conv_id", "turn", "prev_assistant")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS r FROM conversations) WHERE role = 'system' OR r <= 2")
def history_window(s, d):
    return T.history_window(conv(s, d)).select("conv_id", "turn", "role")


@query(f"""WITH x AS (SELECT *, lag(role) OVER w AS ur, lag(text) OVER w AS ut FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, {TOK.format('ut')} + {TK} AS tokens, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS rank FROM x WHERE role = 'assistant' AND ur = 'user'),
q AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS running FROM p WHERE rank <= 2)
SELECT conv_id, turn, rank, tokens, running FROM q WHERE running <= 100""")
def hot_pairs_break(s, d):
    return T.hot_pairs(conv(s, d), budget=100)


@query(f"""SELECT conv_id, CAST(sum({TK}) AS BIGINT) AS tokens, count(*) AS n_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r > 2 GROUP BY conv_id HAVING sum({TK}) >= 60""")
def compaction_candidates(s, d):
    return T.compaction_candidates(conv(s, d))


@query(f"""WITH x AS (SELECT *, lower(regexp_extract(text, '(?i)({'|'.join(X.CHANGE).replace(chr(39), chr(39) * 2)})', 1)) AS phrase, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS f,
len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 5 AS short FROM conversations)
SELECT conv_id, turn, phrase, CASE WHEN phrase <> '' OR f THEN 'changed' WHEN short THEN 'same' ELSE 'undecided' END AS verdict,
CASE WHEN phrase <> '' OR f THEN 1.0::DOUBLE WHEN short THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM x""")
def topic_change_l1(s, d):
    return T.topic_change(conv(s, d))


@query("""SELECT conv_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN substr(text, 1, 10) END IGNORE NULLS) OVER
(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS topic FROM conversations""")
def topic_carry_forward(s, d):
    return T.carry_topic(conv(s, d), F.when(F.length("text") % 3 == 0, F.substring("text", 1, 10))).select("conv_id", "turn", "topic")


METRICS = f"""m AS (SELECT conv_id, turn, tokens, history_tokens, history_tokens > 0 AS context_hit FROM (SELECT conv_id, turn, role, {TK} AS tokens,
CAST(coalesce(sum({TK}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history_tokens FROM conversations) WHERE role = 'user')"""


@query(f"WITH {METRICS} SELECT * FROM m")
def turn_metrics(s, d):
    return T.turn_metrics(conv(s, d))


@query(f"""WITH {METRICS} SELECT conv_id, count(*) AS n_turns, round_even(avg(tokens), 1) AS avg_tokens, round_even(avg(history_tokens), 1) AS avg_history,
round_even(avg(context_hit::INT), 3) AS hit_rate, CAST(sum(tokens) AS BIGINT) AS sum_tokens FROM m GROUP BY conv_id""")
def session_summary(s, d):
    return T.session_summary(T.turn_metrics(conv(s, d)))


@query(f"WITH {METRICS} SELECT conv_id, round(CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE (arg_max(history_tokens, turn) - arg_min(history_tokens, turn))::DOUBLE / (count(*) - 1) END, 6) AS growth FROM m GROUP BY conv_id")
def graph_growth(s, d):
    return T.growth(T.turn_metrics(conv(s, d)), "history_tokens")


@query("""SELECT event_type AS category, round(avg((user_id % 2 = 0)::INT) * 100, 4) AS s1, round(avg(CASE WHEN user_id % 3 = 0 THEN (value > 50)::INT END) * 100, 4) AS s2, count(*) AS n FROM events GROUP BY ROLLUP (event_type)""")
def category_component_matrix(s, d):
    hit = lambda c: F.round(F.avg(c.cast("int")) * 100, 4)
    return t(s, d, "events").rollup(F.col("event_type").alias("category")).agg(hit(F.col("user_id") % 2 == 0).alias("s1"), hit(F.when(F.col("user_id") % 3 == 0, F.col("value") > 50)).alias("s2"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, ts, 'write' AS action, event_type AS tool, 'file_' || json_extract_string(props, '$.k') AS file FROM events WHERE event_type IN ('purchase', 'signup')""")
def changelog_from_events(s, d):
    e = t(s, d, "events").filter(F.col("event_type").isin("purchase", "signup"))
    return e.select("event_id", "ts", F.lit("write").alias("action"), F.col("event_type").alias("tool"), F.concat(F.lit("file_"), F.get_json_object("props", "$.k")).alias("file"))


@query("""WITH e AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS expected FROM orders GROUP BY 1), a AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS actual FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT e.k, round(len(list_intersect(expected, coalesce(actual, [])))::DOUBLE / len(expected), 6) AS recall FROM e LEFT JOIN a USING (k)""")
def recall_accuracy(s, d):
    o = t(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("e"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("a"))
    return o.select("k", F.round(F.size(F.array_intersect("e", "a")) / F.size("e"), 6).alias("recall"))


# ------------------------------------------------------------------ extraction, context, incremental indexing


@query("""SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN '[context] ' || role ELSE text || chr(10) || chr(10) || '[context] ' || role END AS system
FROM (SELECT conv_id, turn, role, CASE WHEN contains(text, 'the') THEN '[context] ' || role ELSE text END AS text0, text FROM conversations)""")
def system_message_compose(s, d):
    text = F.when(F.contains("text", F.lit("the")), F.concat(F.lit("[context] "), "role")).otherwise(F.col("text"))
    return conv(s, d).select("conv_id", "turn", K.compose_system(text, F.col("role")).alias("system"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, concat_ws(chr(10), string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), 'system: warm',
string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system' AND r <= 2)) AS messages FROM m GROUP BY conv_id""")
def context_stack(s, d):
    return K.stack(conv(s, d), F.lit("warm"))


@query(f"""WITH {N}, {P}, {B}, f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq, dst) AS rank FROM both_),
g AS (SELECT src, string_agg('Near: ' || label, ', ' ORDER BY rank) AS r FROM f JOIN nodes ON dst = id WHERE rank <= 3 GROUP BY src)
SELECT id, label || ' [' || type || ']' || CASE WHEN r IS NULL THEN '' ELSE ' - ' || r END AS line FROM nodes LEFT JOIN g ON src = id""")
def hot_lines(s, d):
    n = D.nodes(s, d)
    e = G.undirected(D.edges(s, d, uses=False)).withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("seq", "dst"))).filter("rank <= 3")
    r = e.join(n.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: F.concat(F.lit("Near: "), x["label"])), ", ").alias("r"))
    j = n.join(r, "id", "left")
    return j.select("id", K.node_line(F.col("label"), F.col("type"), F.coalesce("r", F.lit("")), F.array().cast("array<string>")).alias("line"))


@query("""WITH x AS (SELECT conv_id, turn, text, [split_part(text, ' ', 1), split_part(text, ' ', 2), 'zebra'] AS e FROM conversations)
SELECT conv_id, turn, list_filter(e, lambda w: contains(lower(text), lower(w))) AS entities FROM x""")
def s1_grounded_entities(s, d):
    w = F.split("text", " ")
    e = F.array(w[0], F.coalesce(F.get(w, 1), F.lit("")), F.lit("zebra"))
    return conv(s, d).select("conv_id", "turn", X_.grounded(e, F.col("text")).alias("entities"))


@query("""WITH f AS (SELECT c_custkey AS node_id, 'The fact of ' || c_nationkey AS fact, c_custkey AS seq FROM customer), n AS (SELECT c_custkey AS node_id, CASE WHEN c_custkey % 2 = 0 THEN 'fact ' || c_nationkey ELSE 'a new one' END AS fact, c_custkey AS seq FROM customer)
SELECT * FROM f UNION ALL SELECT * FROM n WHERE node_id % 2 = 1""")
def import_merge_facts(s, d):
    c = t(s, d, "customer")
    old = c.select(F.col("c_custkey").alias("node_id"), F.concat(F.lit("The fact of "), "c_nationkey").alias("fact"), F.col("c_custkey").alias("seq"))
    new = c.select(F.col("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("fact "), "c_nationkey")).otherwise("a new one").alias("fact"), F.col("c_custkey").alias("seq"))
    return G.merged_facts(old, new, X.dedup_form)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def incremental_changed_files(s, d):
    """Files whose content hash is not the stored one: the anti-join runs before any parsing."""
    docs = t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    stored = docs.filter("doc_id % 3 = 0")
    return docs.join(stored, ["doc_id", "hash"], "left_anti").select("doc_id")


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(s, d):
    return S_.windowed_counts(t(s, d, "events"))


GS = f"""{N}, g AS (SELECT id, label, seq, CASE WHEN seq % 3 = 0 THEN 'PERSONAL' ELSE 'UNIVERSAL' END AS layer, CASE seq % 7 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE '' END AS status, CAST(seq % 9 AS INTEGER) AS session_count, CAST(seq AS VARCHAR) AS last_active FROM nodes)"""


@query(f"""WITH {GS}, q AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text || ' nation_' || (conv_id % 25)), ' '), lambda w: w <> '')) AS w FROM conversations WHERE turn = 1),
l AS (SELECT *, list_distinct(list_filter(string_split(replace(lower(label), '_', ' '), ' '), lambda w: w <> '')) AS lw,
  (CASE WHEN layer = 'PERSONAL' THEN 0.1 ELSE 0 END)::DOUBLE + (CASE status WHEN 'hot' THEN 0.2 WHEN 'warm' THEN 0.15 ELSE 0 END)::DOUBLE + 0.05::DOUBLE * least(session_count, 5) AS base FROM g),
x AS (SELECT conv_id, turn, id, seq, round(len(list_intersect(w, lw))::DOUBLE / len(list_distinct(list_concat(w, lw))) + base, 6) AS score FROM q, l),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, seq) AS INTEGER) AS rank FROM x WHERE score > 0) SELECT conv_id, turn, id, score, rank FROM r WHERE rank <= 20""")
def graph_summary_top20(s, d):
    q = t(s, d, "conversations").filter("turn = 1").select("conv_id", "turn", F.concat("text", F.lit(" nation_"), F.col("conv_id") % 25).alias("text"))
    k = F.col("seq") % 7
    n = D.nodes(s, d).withColumn("layer", F.when(F.col("seq") % 3 == 0, "PERSONAL").otherwise("UNIVERSAL")).withColumn("status", F.when(k == 0, "hot").when(k == 1, "warm").otherwise(""))
    n = n.withColumn("session_count", (F.col("seq") % 9).cast("int")).withColumn("last_active", F.col("seq").cast("string"))
    return R.graph_summary(q, n, ["conv_id", "turn"])


@query()
def fact_near_dup_fold(s, d):
    return FA.distinct_facts(conv(s, d).select(F.col("conv_id").alias("node_id"), F.col("text").alias("fact"), F.col("turn").alias("seq")))


@query()
def prose_clusters(s, d):
    return FA.prose_clusters(t(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))


@query("""WITH n AS (SELECT 'customer_' || c_custkey AS id, c_name AS label, 'Organization' AS type FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT 'customer_' || o_custkey AS id, 'O' || o_orderkey AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'Odd' ELSE 'Place' END AS type, o_orderkey AS seq FROM orders),
e AS (SELECT id, arg_min(label, seq) AS label, arg_min(type, seq) AS type, count(*) AS m FROM r GROUP BY id)
SELECT coalesce(n.id, e.id) AS id, coalesce(n.label, e.label) AS label, CASE WHEN n.id IS NOT NULL THEN n.type WHEN e.type = 'Odd' THEN 'Unknown' ELSE e.type END AS type,
CASE WHEN n.id IS NOT NULL THEN 'complete' WHEN e.type = 'Odd' THEN 'incomplete' ELSE 'complete' END AS status,
CASE WHEN n.id IS NOT NULL THEN 't0' ELSE 't1' END AS created_at, CASE WHEN e.id IS NOT NULL THEN 't1' ELSE 't0' END AS last_active,
CAST((n.id IS NOT NULL)::INT + CASE WHEN e.id IS NULL OR CAST(split_part(e.id, '_', 2) AS BIGINT) % 3 = 0 THEN 0 ELSE m END AS INTEGER) AS session_count FROM n FULL JOIN e ON n.id = e.id""")
def upsert_entities(s, d):
    n = t(s, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("Organization").alias("type"), F.lit("complete").alias("status"), F.lit("t0").alias("created_at"), F.lit("t0").alias("last_active"), F.lit(1).alias("session_count"), F.array().cast("array<string>").alias("pending"))
    e = t(s, d, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("id"), F.concat(F.lit("O"), "o_orderkey").alias("label"), F.when(F.col("o_orderkey") % 5 == 0, "Odd").otherwise("Place").alias("type"), F.col("o_orderkey").alias("seq"))
    seen = t(s, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"))
    return FA.upsert_entities(n, e, "t1", ["Place", "Organization"], seen).drop("pending")


from . import engine_queries, structure_queries  # noqa: E402, F401
