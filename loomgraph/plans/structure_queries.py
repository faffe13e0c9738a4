"""Registered queries of structure, activation, curation and the vector store, each beside its SQL.

Source files, folders and reviews are derived from whole driver tables; where a query has no SQL, tests hold it
against brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import activation as A
from loomgraph.operators import curation as U
from loomgraph.operators import rank as R
from loomgraph.operators import structure as ST
from loomgraph.sources import vectors as V

from . import derived as D
from .base import query

t = D.table
N, P = D.NODES, D.PLACES

# ------------------------------------------------------------------ files


def pages(s, d):
    return t(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))


@query(r"""WITH l AS (SELECT CAST(page_id AS VARCHAR) AS path, unnest(string_split(h, chr(10))) AS line, generate_subscripts(string_split(h, chr(10)), 1) AS k FROM (SELECT page_id, replace(replace(html, '<article>', '<app-post id="post">'), '<p>', chr(10) || '<p>') AS h FROM pages)),
c AS (SELECT path, k, unnest(regexp_extract_all(line, '<(app-[\w-]+|[A-Z][\w]+)[\s/>]', 1)) AS name FROM l),
i AS (SELECT path, k, unnest(regexp_extract_all(line, 'id=["'']([^"'']+)["'']', 1)) AS name FROM l)
SELECT path, 'component_ref' AS kind, name, CAST(min(k) AS INTEGER) AS line_no FROM c GROUP BY path, name UNION ALL SELECT path, 'html_id', name, CAST(k AS INTEGER) FROM i""")
def html_elements(s, d):
    marked = F.replace(F.replace("text", F.lit("<article>"), F.lit('<app-post id="post">')), F.lit("<p>"), F.lit("\n<p>"))
    return ST.html_elements(pages(s, d).withColumn("text", marked))


@query("""WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey AS n FROM customer)
SELECT path, 'css_selector' AS kind, '.s' || n || ' > .t' AS name, CAST(1 AS INTEGER) AS start_line, CAST(3 AS INTEGER) AS end_line FROM k
UNION ALL SELECT path, 'css_variable', '--v' || n, 2, 2 FROM k UNION ALL SELECT path, 'css_selector', '#i' || n, 8, 8 FROM k""")
def css_units(s, d):
    n = F.col("c_custkey")
    text = F.concat(F.lit(".s"), n, F.lit(" > .t {\n  --v"), n, F.lit(": 1;\n}\n@media print {\n  .x {\n  }\n}\n#i"), n, F.lit(" { }"))
    return ST.css_units(t(s, d, "customer").select(n.cast("string").alias("path"), text.alias("text")))


@query()
def text_sections(s, d):
    return ST.text_sections(t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


@query("""WITH k AS (SELECT p_partkey AS n, 'src/' || p_partkey || '.ts' AS path FROM part)
SELECT path, 'function' AS kind, 'f' || n AS name, NULL::VARCHAR AS parent, CAST(1 AS INTEGER) AS start_line, CAST(3 AS INTEGER) AS end_line FROM k
UNION ALL SELECT path, 'class', 'C' || n, NULL, 4, 8 FROM k UNION ALL SELECT path, 'method', 'run', 'C' || n, 5, 7 FROM k
UNION ALL SELECT path, 'type_alias', 'T' || n, NULL, 9, 9 FROM k UNION ALL SELECT path, 'function', 'g', NULL, 10, 10 FROM k""")
def js_units(s, d):
    n = F.col("p_partkey")
    text = F.concat(F.lit("export function f"), n, F.lit("() {\n  return '}';\n}\nclass C"), n, F.lit(" {\n  run(a) {\n    if (a) { }\n  }\n}\nexport type T"), n, F.lit(" = string;\nexport const g = (x) => x + 1;"))
    return ST.js_units(t(s, d, "part").select(F.concat(F.lit("src/"), n, F.lit(".ts")).alias("path"), text.alias("text")))


def modules(s, d):
    n = F.col("c_nationkey")
    py = F.concat(F.lit("import os, sys as y\nfrom .m"), n, F.lit(" import a as b, c\nx = 1"))
    js = F.concat(F.lit("import { a as b, c } from './m"), n, F.lit("'\nimport D from \"d\"\nimport * as e from 'e'\nexport async function f() {}\nexport const k = 1\nexport default f"))
    even = F.col("c_custkey") % 2 == 0
    return t(s, d, "customer").select(F.concat("c_custkey", F.when(even, ".py").otherwise(".js")).alias("path"), F.when(even, py).otherwise(js).alias("text"))


@query("""WITH p AS (SELECT c_custkey || '.py' AS path, c_nationkey AS n FROM customer WHERE c_custkey % 2 = 0), j AS (SELECT c_custkey || '.js' AS path, c_nationkey AS n FROM customer WHERE c_custkey % 2 = 1)
SELECT path, CAST(1 AS INTEGER) AS line_no, 'os' AS source, ['os', 'sys'] AS names, false AS is_local FROM p UNION ALL SELECT path, 2, '.m' || n, ['a', 'c'], true FROM p
UNION ALL SELECT path, 1, './m' || n, ['a', 'c'], true FROM j UNION ALL SELECT path, 2, 'd', ['D'], false FROM j UNION ALL SELECT path, 3, 'e', ['* as e'], false FROM j""")
def import_statements(s, d):
    return ST.imports(modules(s, d))


@query("""WITH j AS (SELECT c_custkey || '.js' AS path FROM customer WHERE c_custkey % 2 = 1)
SELECT path, CAST(4 AS INTEGER) AS line_no, 'f' AS name, 'function' AS kind FROM j UNION ALL SELECT path, 5, 'k', 'variable' FROM j UNION ALL SELECT path, 6, 'f', 'default' FROM j""")
def export_statements(s, d):
    return ST.exports(modules(s, d))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS raw, rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') || '/y' AS path FROM pages")
def path_normalize(s, d):
    raw = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return t(s, d, "pages").select("page_id", raw.alias("raw"), ST.normal_path(F.concat(raw, F.lit("/x/../././y"))).alias("path"))


FILES = "f AS (SELECT rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') || '.md' AS path, page_id AS seq FROM pages)"


def page_files(s, d):
    raw = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return t(s, d, "pages").select(F.concat(F.rtrim(raw, F.lit("/")), F.lit(".md")).alias("path"), F.col("page_id").alias("seq"))


@query(f"""WITH {FILES}, x AS (SELECT string_split(path, '/') AS s FROM f), e AS (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM x)
SELECT DISTINCT array_to_string(s[1:i - 1], '/') AS source, array_to_string(s[1:i], '/') AS target, CASE WHEN i = len(s) THEN 'file' ELSE 'folder' END AS kind FROM e WHERE i > 1""")
def folder_tree(s, d):
    return ST.folders(page_files(s, d))


@query(f"WITH {FILES} SELECT path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.md' THEN 'markdown' END AS language FROM f")
def language_by_suffix(s, d):
    return page_files(s, d).select("path", ST.language(F.col("path")).alias("language"))


@query("SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS slice_hash FROM documents")
def source_slice(s, d):
    return t(s, d, "documents").select("doc_id", F.sha2(ST.line_range(F.col("text"), F.lit(2), F.lit(4)), 256).alias("slice_hash"))


@query()
def file_batches(s, d):
    return U.batches(page_files(s, d))


@query(f"""WITH {FILES}, g AS (SELECT split_part(path, '/', 1) AS module, count(*) AS n FROM f GROUP BY 1)
SELECT 'synthesis:module_' || trim(regexp_replace(lower(module), '[^a-z0-9]+', '_', 'g'), '_') AS id, module AS label, 'synthesis' AS kind, n, 'about ' || module AS summary FROM g WHERE n >= 2 AND (SELECT count(*) FROM g) > 1""")
def synthesis_modules(s, d):
    f = page_files(s, d)
    made = f.select(F.substring_index("path", "/", 1).alias("module")).distinct().withColumn("summary", F.concat(F.lit("about "), "module"))
    return U.summary_nodes(f, made)


@query("""SELECT conv_id, turn, CAST(sum(n) OVER w - n + 1 AS BIGINT) AS start_line, CAST(sum(n) OVER w AS BIGINT) AS end_line FROM (SELECT conv_id, turn, len(string_split(text, chr(10))) AS n FROM conversations)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def cumulative_lines(s, d):
    from pyspark.sql import Window as W

    x = t(s, d, "conversations").withColumn("n", F.size(F.split("text", "\n", -1)))
    end = F.sum("n").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return x.select("conv_id", "turn", (end - F.col("n") + 1).alias("start_line"), end.alias("end_line"))


# ------------------------------------------------------------------ activation

ASKS = "a AS (SELECT p_partkey AS text_id, 'show the ' || p_name || ' of ' || p_brand AS text FROM part), n AS (SELECT DISTINCT 'name ' || p_name AS id, p_name AS label FROM part UNION SELECT DISTINCT 'type ' || p_type, p_type || ' thing' FROM part UNION SELECT DISTINCT 'brand ' || p_brand, p_brand FROM part)"


def asks(s, d):
    return t(s, d, "part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("show the "), "p_name", F.lit(" of "), "p_brand").alias("text"))


def ask_nodes(s, d):
    p = t(s, d, "part")
    out = p.select(F.concat(F.lit("name "), "p_name").alias("id"), F.col("p_name").alias("label"))
    out = out.unionByName(p.select(F.concat(F.lit("type "), "p_type").alias("id"), F.concat("p_type", F.lit(" thing")).alias("label")))
    return out.unionByName(p.select(F.concat(F.lit("brand "), "p_brand").alias("id"), F.col("p_brand").alias("label"))).distinct()


@query(f"""WITH {ASKS}, x AS (SELECT text_id, id, lower(text) AS m, lower(label) AS l, string_split(lower(text), ' ') AS mw, list_distinct(string_split(lower(label), ' ')) AS lw FROM a, n WHERE length(label) >= 3)
SELECT text_id, id FROM x WHERE contains(m, l) OR len(list_filter(mw, lambda w: length(w) >= 4 AND starts_with(l, w))) > 0 OR (len(lw) > 1 AND len(list_filter(lw, lambda w: NOT list_contains(mw, w))) = 0)""")
def text_matches(s, d):
    return A.mentioned(asks(s, d), ask_nodes(s, d))


@query(f"""WITH {ASKS}, m AS (SELECT text_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM a), k AS (SELECT id, lower('it is a ' || label || ' here') AS note FROM n)
SELECT DISTINCT text_id, id FROM m JOIN k ON length(w) >= 4 AND contains(note, w)""")
def keyword_matches(s, d):
    notes = ask_nodes(s, d).select("id", F.concat(F.lit("it is a "), "label", F.lit(" here")).alias("note"))
    return A.by_keyword(asks(s, d), notes)


TREE = """g AS (SELECT 'r' || r_regionkey AS id, 'folder' AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, 'file' FROM nation UNION ALL SELECT 's' || s_suppkey, 'section' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'entity' FROM customer),
te AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS relation, n_nationkey::BIGINT AS seq FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains', s_suppkey FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey + 1), 'knows', c_custkey FROM customer),
u AS (SELECT source AS src, target AS dst, relation FROM te UNION ALL SELECT target, source, relation FROM te),
b0 AS (SELECT n_nationkey AS text_id, CASE WHEN n_nationkey % 3 = 0 THEN 'r' || n_regionkey WHEN n_nationkey % 3 = 1 THEN 'n' || n_nationkey ELSE 'c' || n_nationkey END AS id FROM nation),
b1 AS (SELECT * FROM b0 UNION SELECT text_id, dst FROM b0 JOIN g USING (id) JOIN u ON src = b0.id WHERE kind = 'folder' AND relation = 'contains'),
b2 AS (SELECT * FROM b1 UNION SELECT text_id, dst FROM b1 JOIN g USING (id) JOIN u ON src = b1.id WHERE kind = 'file' AND relation = 'contains'),
b3 AS (SELECT * FROM b2 UNION SELECT text_id, dst FROM b2 JOIN g USING (id) JOIN u ON src = b2.id JOIN g h ON h.id = dst WHERE g.kind = 'entity' AND h.kind = 'entity')"""


def tree(s, d):
    r, n, sp, c = (t(s, d, x) for x in ("region", "nation", "supplier", "customer"))
    node = lambda df, p, k, kind: df.select(F.concat(F.lit(p), k).alias("id"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind} "), k).alias("label"))
    nodes = node(r, "r", "r_regionkey", "folder").unionByName(node(n, "n", "n_nationkey", "file")).unionByName(node(sp, "s", "s_suppkey", "section")).unionByName(node(c, "c", "c_custkey", "entity"))
    edge = lambda df, a, b, rel, k: df.select(a.alias("source"), b.alias("target"), F.lit(rel).alias("relation"), F.col(k).cast("long").alias("seq"))
    of = lambda p, k: F.concat(F.lit(p), k)
    edges = edge(n, of("r", "n_regionkey"), of("n", "n_nationkey"), "contains", "n_nationkey").unionByName(edge(sp, of("n", "s_nationkey"), of("s", "s_suppkey"), "contains", "s_suppkey"))
    edges = edges.unionByName(edge(c, of("c", "c_custkey"), of("c", F.col("c_custkey") + 1), "knows", "c_custkey"))
    k = F.col("n_nationkey") % 3
    active = n.select(F.col("n_nationkey").alias("text_id"), F.when(k == 0, of("r", "n_regionkey")).when(k == 1, of("n", "n_nationkey")).otherwise(of("c", "n_nationkey")).alias("id"))
    return nodes, edges, active


@query(f"WITH {TREE} SELECT text_id, id FROM b3")
def activation_expansion(s, d):
    nodes, edges, active = tree(s, d)
    return A.expanded(active, nodes, edges)


@query(f"""WITH {TREE}, x AS (SELECT text_id, id, kind, CASE text_id % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'overview' ELSE 'specific' END AS intent FROM b3 JOIN g USING (id)),
y AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE kind IN ('entity', 'synthesis', 'file', 'folder')) OVER w AS b FROM x WINDOW w AS (PARTITION BY text_id))
SELECT text_id, id, kind FROM y WHERE CASE WHEN intent = 'chat' THEN kind = 'synthesis' WHEN intent = 'specific' AND n > 4 AND b <= 4 THEN kind IN ('entity', 'synthesis', 'file', 'folder')
WHEN intent = 'specific' AND n > 4 THEN kind IN ('entity', 'synthesis') ELSE true END""")
def intent_cap(s, d):
    nodes, edges, active = tree(s, d)
    k = F.col("n_nationkey") % 4
    intents = t(s, d, "nation").select(F.col("n_nationkey").alias("text_id"), F.when(k == 0, "chat").when(k == 1, "overview").otherwise("specific").alias("intent"))
    return A.capped(A.expanded(active, nodes, edges), nodes, intents, most=4)


@query("SELECT n_nationkey AS id, n_name AS label FROM nation WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE contains(lower(text), lower(n_name)))")
def phantom_entities(s, d):
    labels = t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return A.phantoms(labels, t(s, d, "benchmark").select(F.col("item_id").alias("text_id"), "text"))


@query("""WITH f AS (SELECT c_custkey AS id, 'buys ' || c_mktsegment AS fact FROM customer)
SELECT c_custkey AS id, CASE WHEN contains(lower(c_name), 'building') THEN NULL ELSE fact END AS fact FROM customer JOIN f ON id = c_custkey WHERE contains(lower(c_name), 'building') OR contains(lower(fact), 'building')""")
def search_labels_then_facts(s, d):
    fact = F.concat(F.lit("buys "), "c_mktsegment")
    label, facts = F.contains(F.lower("c_name"), F.lit("building")), F.contains(F.lower(fact), F.lit("building"))
    return t(s, d, "customer").filter(label | facts).select(F.col("c_custkey").alias("id"), F.when(~label, fact).alias("fact"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS g, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END AS l, CAST(o_orderkey % 90 + 1 AS BIGINT) AS tk FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY l, k) AS r FROM o),
f AS (SELECT DISTINCT g, 0::BIGINT AS r, 0::BIGINT AS used, []::VARCHAR[] AS kept FROM i
UNION ALL SELECT f.g, f.r + 1, CASE WHEN used + tk <= 150 THEN used + tk ELSE used END, CASE WHEN used + tk <= 150 THEN list_append(kept, 'o' || k) ELSE kept END FROM f JOIN i ON i.g = f.g AND i.r = f.r + 1)
SELECT g AS turn_id, arg_max(used, r) AS used, arg_max(kept, r) AS kept FROM f GROUP BY g""")
def layered_budget(s, d):
    st = F.col("o_orderstatus")
    x = t(s, d, "orders").select(F.col("o_custkey").alias("turn_id"), F.when(st == "F", "hot").when(st == "O", "warm").otherwise("cold").alias("layer"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("o"), "o_orderkey").alias("line"), (F.col("o_orderkey") % 90 + 1).alias("tokens"))
    return R.layered_budget(x, 150)


@query("""SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN b * 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE b END, 9) AS score FROM
(SELECT *, CASE WHEN contains('all of the red things', split_part(lower(p_name), ' ', 1)) THEN least((CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) + 0.3::DOUBLE, 1.0::DOUBLE) ELSE (CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) END AS b FROM part)""")
def chunk_scores(s, d):
    k = F.col("p_size") % 3
    score = R.chunk_score(F.substring_index("p_name", " ", 1), F.lit("all of the red things"), F.col("p_size") % 2 == 0, F.when(k == 0, "relation").when(k == 1, "file").otherwise("fact"))
    return t(s, d, "part").select("p_partkey", F.round(score, 9).alias("score"))


# ------------------------------------------------------------------ curation


def people(s, d):
    """Customers as nodes with attributes, their nations as edges, their segments as facts."""
    c = t(s, d, "customer")
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("Organization").alias("type"), F.create_map(F.lit("seg"), "c_mktsegment", F.concat(F.lit("k"), F.col("c_custkey") % 2), F.col("c_custkey").cast("string")).alias("attributes"))
    edges = c.select(F.col("c_custkey").alias("source"), (F.col("c_nationkey") + 0).cast("long").alias("target"), F.lit("related_to").alias("relation"), F.lit(1.0).alias("weight"), F.col("c_custkey").alias("seq"))
    facts = t(s, d, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderpriority").alias("fact"), F.lit("user").alias("source"), F.col("o_orderkey").alias("seq"))
    merges = t(s, d, "supplier").select((F.col("s_suppkey") + 1).alias("from_id"), F.floor(F.col("s_suppkey") / 4).cast("long").alias("into_id"), F.col("s_suppkey").alias("seq"))
    return nodes, edges, facts, merges


MERGED = """mg AS (SELECT s_suppkey + 1 AS old, CAST(floor(s_suppkey / 4) AS BIGINT) AS new, s_suppkey AS seq FROM supplier),
ok AS (SELECT * FROM mg WHERE old <> new AND old IN (SELECT c_custkey FROM customer) AND new IN (SELECT c_custkey FROM customer) AND NOT EXISTS (SELECT 1 FROM mg h WHERE h.old = mg.new AND h.old <> h.new AND h.seq < mg.seq AND h.old IN (SELECT c_custkey FROM customer))),
up AS (SELECT old, new, 1 AS n FROM ok UNION ALL SELECT up.old, ok.new, n + 1 FROM up JOIN ok ON ok.old = up.new), res AS (SELECT old, arg_max(new, n) AS new FROM up GROUP BY old)"""


@query(f"""WITH RECURSIVE {MERGED} SELECT coalesce(a.new, c_custkey) AS source, coalesce(b.new, c_nationkey)::BIGINT AS target, 'related_to' AS relation, 1.0::DOUBLE AS weight, c_custkey AS seq
FROM customer LEFT JOIN res a ON a.old = c_custkey LEFT JOIN res b ON b.old = c_nationkey""")
def curation_merged_edges(s, d):
    return U.apply_merges(*people(s, d))[1]


@query(f"WITH RECURSIVE {MERGED} SELECT coalesce(new, o_custkey) AS node_id, o_orderpriority AS fact, 'user' AS source, o_orderkey AS seq FROM orders LEFT JOIN res ON old = o_custkey")
def curation_merged_facts(s, d):
    return U.apply_merges(*people(s, d))[2]


@query(f"""WITH RECURSIVE {MERGED}, a AS (SELECT c_custkey AS id, 'seg' AS k, c_mktsegment AS v, -1::BIGINT AS seq FROM customer UNION ALL SELECT c_custkey, 'k' || (c_custkey % 2), c_custkey::VARCHAR, -1 FROM customer),
m AS (SELECT id, k, v, seq FROM a WHERE id NOT IN (SELECT old FROM res) UNION ALL SELECT res.new, k, v, mg.seq FROM a JOIN res ON res.old = id JOIN mg ON mg.old = id)
SELECT id, k, arg_max(v, seq) AS v FROM m GROUP BY id, k""")
def curation_merged_attributes(s, d):
    return U.apply_merges(*people(s, d))[0].select("id", F.explode("attributes").alias("k", "v"))


@query("""SELECT c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN (SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey) ELSE 'Organization' END AS type FROM customer""")
def curation_type_fixes(s, d):
    fixes = t(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("new_type"), F.col("o_orderkey").alias("seq"))
    return U.fix_types(people(s, d)[0], fixes).select("id", "type")


@query("""SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0 OR (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 2""")
def curation_discards(s, d):
    n, e, f, _ = people(s, d)
    ids = t(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return U.discard(n, e, f, ids)[0].select("id")


@query("""WITH e AS (SELECT 'c' || o_custkey AS source, 'p' || substr(o_orderpriority, 1, 1) AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'related_to' ELSE 'asked' END AS relation, o_orderkey AS seq FROM orders WHERE o_orderstatus = 'F'),
w AS (SELECT 'c' || o_custkey AS source, 'p' || substr(o_orderpriority, 1, 1) AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'uses' ELSE 'ordered' END AS relation, o_orderkey AS seq FROM orders WHERE o_orderstatus <> 'F'),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY relation = 'uses', seq) AS r FROM w) WHERE r = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY seq) AS r FROM e)
SELECT o.source, o.target, CASE WHEN o.r = 1 AND o.relation = 'related_to' AND n.relation = 'ordered' THEN 'ordered' ELSE o.relation END AS relation, o.seq FROM o LEFT JOIN n USING (source, target)
UNION ALL SELECT source, target, relation, seq FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = n.source AND e.target = n.target)""")
def upsert_relations(s, d):
    o, k = t(s, d, "orders"), F.col("o_orderkey")
    edge = lambda df, rel: df.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("target"), rel.alias("relation"), F.lit(1.0).alias("weight"), k.alias("seq"))
    old = edge(o.filter("o_orderstatus = 'F'"), F.when(k % 3 == 0, "related_to").otherwise("asked"))
    new = edge(o.filter("o_orderstatus <> 'F'"), F.when(k % 2 == 0, "uses").otherwise("ordered"))
    return U.upsert_relations(old, new).select("source", "target", "relation", "seq")


@query(f"""WITH {TREE} SELECT source AS id, count(*) AS n, array_to_string((list('section ' || substr(target, 2) ORDER BY seq))[1:3], ', ') AS children FROM te WHERE relation = 'contains' AND source LIKE 'n%' GROUP BY source
UNION ALL SELECT source, count(*), array_to_string((list('file ' || substr(target, 2) ORDER BY seq))[1:3], ', ') FROM te WHERE relation = 'contains' AND source LIKE 'r%' GROUP BY source""")
def children_listing(s, d):
    nodes, edges, _ = tree(s, d)
    return U.children_listed(nodes, edges, most=3)


@query(f"WITH {P} SELECT source, target, relation FROM edges WHERE NOT (source = 'nation_1' OR starts_with(source, 'nation_1__') OR target = 'nation_1' OR starts_with(target, 'nation_1__'))")
def remove_edges_by_file(s, d):
    return U.without_file(D.nodes(s, d), D.edges(s, d, uses=False), "nation_1")[1].select("source", "target", "relation")


@query("""SELECT c_custkey AS id, coalesce((SELECT list('o' || o_orderkey ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), ['old']) AS chunk_ids FROM customer""")
def link_chunks(s, d):
    n = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("old")).alias("chunk_ids"))
    o = t(s, d, "orders")
    return U.link_chunks(n, o.select(F.col("o_custkey").alias("id"), F.concat(F.lit("o"), "o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("chunk_index"))).select("id", "chunk_ids")


@query("""SELECT c_custkey AS id, c_nationkey < 5 OR c_custkey IN (SELECT o_custkey FROM orders) AS stale, CASE WHEN c_nationkey < 5 THEN 't0' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 't1' END AS stale_since FROM customer""")
def mark_stale(s, d):
    old = F.col("c_nationkey") < 5
    n = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(old, True).alias("stale"), F.when(old, "t0").alias("stale_since"))
    return U.mark_stale(n, t(s, d, "orders").select(F.col("o_custkey").alias("id")), "t1").select("id", "stale", "stale_since")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'UNIVERSAL' WHEN contains('about my ' || lower(p_name), 'my ' || lower(p_name)) AND p_size % 2 = 0 THEN 'PERSONAL' WHEN p_size % 3 = 0 THEN 'PERSONAL' ELSE 'UNIVERSAL' END AS layer FROM part""")
def layer_resolution(s, d):
    k = F.col("p_size")
    text = F.when(k % 2 == 0, F.concat(F.lit("About my "), "p_name")).otherwise(F.concat(F.lit("About the "), "p_name"))
    layer = U.layer_of(F.when(k % 5 == 0, "UNIVERSAL"), F.col("p_name"), text, F.when(k % 3 == 0, "Person").otherwise("Place"), ["Person"])
    return t(s, d, "part").select("p_partkey", layer.alias("layer"))


@query("""SELECT c_custkey AS id, [c_mktsegment, 'own'] AS first, ['other', 'own'] AS last FROM customer""")
def attribute_merge_rules(s, d):
    own = F.create_map(F.lit("a"), "c_mktsegment", F.lit("b"), F.lit("own"))
    other = F.create_map(F.lit("a"), F.lit("other"))
    return t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.map_values(U.keep_first(own, other)).alias("first"), F.map_values(U.last_wins(own, other)).alias("last"))


# ------------------------------------------------------------------ vector store, metrics, messages


@query("""SELECT 'n' || c_custkey || '_f0' AS chunk_id, c_name || ': in ' || c_mktsegment AS document FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 2 = 0
UNION ALL SELECT 'n' || c_custkey || '_f0', c_name || ': was ' || c_mktsegment FROM customer WHERE c_custkey % 2 = 1""")
def vector_fact_upsert(s, d):
    c = t(s, d, "customer")
    rows = lambda df, fact: V.fact_rows(df.select(F.concat(F.lit("n"), "c_custkey").alias("node_id"), F.col("c_name").alias("label"), fact.alias("fact"), F.lit(0).alias("fact_index")))
    old = rows(c.filter("c_custkey % 2 = 1 or c_nationkey % 2 = 0"), F.concat(F.lit("was "), "c_mktsegment"))
    new = rows(c.filter("c_custkey % 2 = 0"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("in "), "c_mktsegment")).otherwise(" "))
    return V.replaced(old, new).select("chunk_id", "document")


@query("SELECT count(*) AS chunks, count(DISTINCT page_id) AS owners FROM (SELECT page_id, unnest(range(0, CASE WHEN length(html) <= 500 THEN 1 ELSE CAST(ceil(length(html) / 450.0) AS BIGINT) END)) FROM pages)")
def vector_store_stats(s, d):
    from loomgraph.operators import chunks as C

    p = t(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return V.stats(V.chunk_rows(C.fixed_chunks(p).select(F.concat(F.lit("p/"), "doc_id", F.lit(".md")).alias("path"), "chunk_index", "content")))


@query("""SELECT o_custkey AS k, round(sum((o_orderstatus = 'F')::INT)::DOUBLE / arg_max(o_totalprice, o_orderkey), 9) AS density FROM orders GROUP BY 1""")
def fact_density(s, d):
    n = F.max_by("o_totalprice", "o_orderkey")
    return t(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.when(n > 0, F.sum((F.col("o_orderstatus") == "F").cast("int")) / n).otherwise(0.0), 9).alias("density"))


@query("""SELECT event_type AS category, round(avg((value > 20)::INT), 6) AS answered, CAST(sum(CASE WHEN value > 20 THEN user_id ELSE 0 END) AS BIGINT) AS engine_tokens, CAST(sum(user_id * 3) AS BIGINT) AS agent_tokens,
round(CASE WHEN sum(user_id) = 0 THEN 0.0::DOUBLE ELSE sum(user_id * 3)::DOUBLE / sum(user_id) END, 6) AS ratio FROM events GROUP BY 1""")
def agent_scorecard(s, d):
    yes, u = F.col("value") > 20, F.col("user_id")
    ratio = F.when(F.sum(u) == 0, 0.0).otherwise(F.sum(u * 3) / F.sum(u))
    return t(s, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.round(F.avg(yes.cast("int")), 6).alias("answered"), F.sum(F.when(yes, u).otherwise(0)).alias("engine_tokens"), F.sum(u * 3).alias("agent_tokens"), F.round(ratio, 6).alias("ratio"))


@query("SELECT conv_id, turn, n - lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)")
def turn_deltas(s, d):
    from pyspark.sql import Window as W

    n = F.length("text").cast("long")
    return t(s, d, "conversations").select("conv_id", "turn", (n - F.lag(n).over(W.partitionBy("conv_id").orderBy("turn"))).alias("delta"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.path'), json_extract_string(props, '$.file_path'), json_extract_string(props, '$.k')) AS path FROM events")
def tool_call_path(s, d):
    keys = ["path", "file_path", "filename", "file", "k"]
    return t(s, d, "events").select("event_id", F.coalesce(*[F.get_json_object("props", f"$.{k}") for k in keys]).alias("path"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) = 'user' AS new_turn FROM conversations GROUP BY conv_id")
def new_user_turn(s, d):
    return t(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), (F.max_by("role", "turn") == "user").alias("new_turn"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'N' || s_suppkey END AS name FROM supplier""")
def user_identity(s, d):
    fact = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("My name is N"), "s_suppkey", F.lit("."))).otherwise("likes tea")
    name = F.regexp_extract(fact, r"(?i)(?:my name is|me llamo|mi nombre es|i am called)\s+(\w+)", 1)
    return t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(name != "", name).alias("name"))


@query("""WITH x AS (SELECT DISTINCT s_nationkey AS file, s_suppkey AS node, lower(trim('T' || (s_suppkey % 3))) AS topic FROM supplier)
SELECT DISTINCT a.node AS a, b.node AS b, 0.6::DOUBLE AS weight FROM x a JOIN x b ON a.file = b.file AND a.topic = b.topic AND a.node < b.node""")
def topic_pairs_same_file(s, d):
    x = t(s, d, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 3).alias("topic"))
    return x.join(x.withColumnRenamed("node", "other"), ["file", "topic"]).filter("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"), F.lit(0.6).alias("weight")).distinct()


@query("""SELECT 'required' AS kind, lower(r_name) AS what, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey) AS passed FROM region
UNION ALL SELECT 'bounds', 'min_nodes', (SELECT count(*) FROM customer) >= 10""")
def graph_quality_checks(s, d):
    n = t(s, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.lit(True).alias("hit")).distinct()
    need = t(s, d, "region").join(n, "r_regionkey", "left").select(F.lit("required").alias("kind"), F.lower("r_name").alias("what"), F.coalesce("hit", F.lit(False)).alias("passed"))
    return need.unionByName(t(s, d, "customer").agg((F.count(F.lit(1)) >= 10).alias("passed")).select(F.lit("bounds").alias("kind"), F.lit("min_nodes").alias("what"), "passed"))


@query("""SELECT c_custkey AS id, '{"id":"c' || c_custkey || '","label":"' || c_name || '","layer":"PERSONAL","attributes":{"status":"' || c_mktsegment || '"}}' AS entry FROM customer""")
def node_summary_json(s, d):
    shown = F.map_filter(F.create_map(F.lit("status"), "c_mktsegment", F.lit("hidden"), F.lit("x")), lambda k, v: k.isin(SHOWN))
    e = F.struct(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("PERSONAL").alias("layer"), shown.alias("attributes"))
    return t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.to_json(e).alias("entry"))


# Attributes that a summary shows.
SHOWN = ["purpose", "description", "url", "location", "platforms", "tech_stack", "role", "stack", "status", "domain"]


@query("""SELECT conv_id, turn, role || '/' || CASE WHEN turn % 2 = 0 THEN 'changed' ELSE 'same' END AS topic, CASE WHEN turn % 2 = 0 THEN [role, 'x' || turn] ELSE [] END AS entities FROM conversations""")
def s1_reply_parse(s, d):
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('noise {"topic":{"action":"changed","label":"'), "role", F.lit('"},"entities":[{"label":"'), "role", F.lit('"},"x'), "turn", F.lit('"]} tail'))).otherwise(F.concat(F.lit('{"topic":"'), "role", F.lit('"}')))
    reply = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    label = F.coalesce(F.get_json_object(reply, "$.topic.label"), F.get_json_object(reply, "$.topic"))
    action = F.coalesce(F.get_json_object(reply, "$.topic.action"), F.lit("same"))
    raw = F.coalesce(F.from_json(F.get_json_object(reply, "$.entities"), "array<string>"), F.array().cast("array<string>"))
    names = F.transform(raw, lambda e: F.coalesce(F.get_json_object(e, "$.label"), e))
    return t(s, d, "conversations").select("conv_id", "turn", F.concat(label, F.lit("/"), action).alias("topic"), names.alias("entities"))


@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(greatest(1, CAST(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INTEGER))) AS BIGINT) AS tokens, max(turn) AS last_turn FROM conversations GROUP BY 1")
def session_totals(s, d):
    from loomgraph.streaming import turns as S_

    return S_.session_totals(t(s, d, "conversations").select("conv_id", "turn", X.count_tokens(F.col("text")).alias("tokens")))
