"""Lookups, reply parsing, rendering, context preparation, chunks and the index flow, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import ontology as ON
from loomgraph.functions import text as X
from loomgraph.operators import extract as EX
from loomgraph.operators import lookup as L
from loomgraph.operators import prepare as PR
from loomgraph.operators import render as RE

from . import derived as D
from .base import query

t = D.table
N, P = D.NODES, D.PLACES
TEXTS = "array<string>"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def cases(values: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted([a])} THEN {quoted([b])}" for a, b in values.items()) + f" ELSE {default} END"


def pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: list[str], key: str) -> str:
    return f"[{quoted(values)}][1 + {key} % {len(values)}]"


# ------------------------------------------------------------------ text and ontology

RAW = ["person", " Lugar ", "COMIC", "xy", "widget", "entity", "Tecnología", "gadget types"]


@query(f"""WITH r AS (SELECT o_orderkey, lower(trim({sql_pick(RAW, 'o_orderkey')})) AS c FROM orders),
m AS (SELECT o_orderkey, {cases(ON.NAMES, 'c', "CASE WHEN length(c) >= 3 THEN upper(c[1]) || c[2:] ELSE 'Unknown' END")} AS type FROM r)
SELECT o_orderkey, type, type IN ({quoted(ON.TYPES)}) AS known, type IN ({quoted(ON.UNIVERSAL)}) AS universal FROM m""")
def ontology_types(s, d):
    m = t(s, d, "orders").select("o_orderkey", ON.mapped_type(pick(RAW, "o_orderkey")).alias("type"))
    return m.select("*", ON.Ontology().known(F.col("type")).alias("known"), ON.universal(F.col("type")).alias("universal"))


@query(f"""SELECT o_orderkey, relation, relation IN ({quoted([*ON.RELATIONS, *ON.UPPER, 'asked'])}) AS known, {cases(X.REVERSED, 'relation', 'relation')} AS reversed
FROM (SELECT o_orderkey, {sql_pick(['located_in', 'asked', 'played_for', 'HAS_MODULE', 'x'], 'o_orderkey')} AS relation FROM orders)""")
def ontology_relations(s, d):
    o = t(s, d, "orders").select("o_orderkey", pick(["located_in", "asked", "played_for", "HAS_MODULE", "x"], "o_orderkey").alias("relation"))
    return o.select("*", ON.Ontology().with_relation("asked").known_relation(F.col("relation")).alias("known"), X.reverse_relation(F.col("relation")).alias("reversed"))


ID = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"""SELECT o_orderkey, {ID.format("'src/' || o_orderstatus || '.py'")} || '__' || CASE WHEN o_orderkey % 2 = 0 THEN {ID.format('o_orderpriority')} || '__' ELSE '' END || 'order_' || o_orderkey AS id,
replace(lower(trim(' ' || o_orderpriority)), ' ', '_') AS plain FROM orders""")
def symbol_ids(s, d):
    parent = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    own = X.symbol_id(F.concat(F.lit("src/"), "o_orderstatus", F.lit(".py")), F.concat(F.lit("Order "), "o_orderkey"), parent)
    return t(s, d, "orders").select("o_orderkey", own.alias("id"), X.plain_id(F.concat(F.lit(" "), "o_orderpriority")).alias("plain"))


@query("SELECT conv_id, turn, trim(regexp_replace(trim(text), '```(json)?\\s*', '', 'g')) AS plain FROM (SELECT conv_id, turn, '```json ' || text || ' ``` end' AS text FROM conversations)")
def strip_fences(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", X.strip_fences(F.concat(F.lit("<think>no</think>```json "), "text", F.lit(" ``` end"))).alias("plain"))


@query(f"""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 100) / 100.0::DOUBLE END AS sim, CASE WHEN event_id % 11 = 0 THEN 'by the way' ELSE '' END AS word FROM events),
v AS (SELECT *, CASE WHEN sim >= 0.80 THEN 'same' WHEN sim < 0.65 THEN 'changed' WHEN event_type = 'view' THEN 'subtopic' ELSE 'undecided' END AS verdict FROM e)
SELECT event_id, verdict, CASE WHEN word <> '' THEN {quoted([X.HINTS['keyword']])} WHEN sim IS NULL THEN {quoted([X.HINTS['open']])} WHEN sim >= 0.80 THEN {quoted([X.HINTS['same']])}
WHEN sim < 0.65 THEN {quoted([X.HINTS['changed']])} WHEN verdict = 'subtopic' THEN 'subtopic of ' || event_type || ' (medium confidence — verify)' ELSE {quoted([X.HINTS['same']])} END AS hint FROM v""")
def topic_hints(s, d):
    e = t(s, d, "events").withColumn("sim", F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 100) / 100.0)).withColumn("word", F.when(F.col("event_id") % 11 == 0, "by the way").otherwise(""))
    verdict = X.topic_verdict(F.col("sim"))
    e = e.withColumn("verdict", F.when((verdict == "undecided") & (F.col("event_type") == "view"), "subtopic").otherwise(verdict))
    return e.select("event_id", "verdict", X.topic_hint(F.col("word"), F.col("sim"), F.col("verdict"), F.col("event_type")).alias("hint"))


REPLIES = ["I can search for that", "Here it is", "No tengo datos sobre eso", "Shall I look?"]


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, lower(text || ' ' || {sql_pick(REPLIES, 'turn')}) AS x FROM conversations WHERE role = 'assistant') WHERE NOT ({' OR '.join(f'contains(x, {quoted([p])})' for p in X.NO_DATA)})")
def replies_with_data(s, d):
    c = t(s, d, "conversations").filter("role = 'assistant'").withColumn("x", F.concat("text", F.lit(" "), pick(REPLIES, "turn")))
    return c.filter(~X.says_no_data(F.col("x"))).select("conv_id", "turn")


@query("SELECT conv_id, turn, role || ' ' || text AS plain FROM conversations")
def content_blocks_text(s, d):
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    c = t(s, d, "conversations").withColumn("b", F.array(block("text", F.col("role")), block("image", F.col("text")), block("text", F.col("text"))))
    return c.select("conv_id", "turn", X.blocks_text(F.col("b")).alias("plain"))


# ------------------------------------------------------------------ lookups and views

FILES = """files AS (SELECT 'file_' || doc_id AS id, source || '/' || doc_id || '.md' AS label, 'File' AS type, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE 'file' END AS kind, doc_id AS seq,
CASE WHEN doc_id % 3 = 0 THEN ['c' || doc_id, 'd' || doc_id] WHEN doc_id % 3 = 1 THEN [] ELSE NULL END AS chunk_ids, doc_id % 4 = 0 AS stale FROM documents
UNION ALL SELECT 'file_' || (o_orderkey % 97) || '__u' || o_orderkey, 'Unit ' || o_orderkey, 'Section', CASE WHEN o_orderkey % 2 = 0 THEN 'section' ELSE 'symbol' END, 1000000 + o_orderkey, NULL, FALSE FROM orders)"""


def file_nodes(s, d):
    k, i = F.col("doc_id") % 3, F.col("doc_id")
    f = t(s, d, "documents").select(F.concat(F.lit("file_"), i).alias("id"), F.concat("source", F.lit("/"), i, F.lit(".md")).alias("label"), F.lit("File").alias("type"), F.when(i % 10 != 9, "file").alias("kind"), i.alias("seq"), F.when(k == 0, F.array(F.concat(F.lit("c"), i), F.concat(F.lit("d"), i))).when(k == 1, F.array().cast(TEXTS)).alias("chunk_ids"), (i % 4 == 0).alias("stale"))
    o = F.col("o_orderkey")
    u = t(s, d, "orders").select(F.concat(F.lit("file_"), o % 97, F.lit("__u"), o).alias("id"), F.concat(F.lit("Unit "), o).alias("label"), F.lit("Section").alias("type"), F.when(o % 2 == 0, "section").otherwise("symbol").alias("kind"), (o + 1000000).alias("seq"), F.lit(None).cast(TEXTS).alias("chunk_ids"), F.lit(False).alias("stale"))
    return f.unionByName(u)


FACTS = "facts AS (SELECT 'nation_' || c_nationkey AS node_id, 'Home of ' || c_name AS fact, CASE c_custkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'web' WHEN 2 THEN 'rag' ELSE 'other' END AS source, c_custkey AS seq FROM customer)"


def facts(s, d):
    k = F.col("c_custkey") % 4
    return t(s, d, "customer").select(F.concat(F.lit("nation_"), "c_nationkey").alias("node_id"), F.concat(F.lit("Home of "), "c_name").alias("fact"), F.when(k == 0, "user").when(k == 1, "web").when(k == 2, "rag").otherwise("other").alias("source"), F.col("c_custkey").alias("seq"))


@query(f"WITH {N} SELECT id, label FROM nodes WHERE id IN (SELECT 'customer_' || o_custkey FROM orders)")
def nodes_by_ids(s, d):
    return L.by_ids(D.nodes(s, d), t(s, d, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("id"))).select("id", "label")


@query(f"WITH {FILES} SELECT id FROM files WHERE kind = 'file'")
def nodes_by_kind(s, d):
    return L.by_kind(file_nodes(s, d), "file").select("id")


@query(f"WITH {FILES} SELECT id, len(chunk_ids)::INTEGER AS n FROM files WHERE len(chunk_ids) > 0")
def nodes_with_chunks(s, d):
    return L.with_chunks(file_nodes(s, d)).select("id", F.size("chunk_ids").alias("n"))


@query(f"WITH {FILES} SELECT id FROM files WHERE kind = 'file' AND stale")
def stale_file_nodes(s, d):
    return L.stale_files(file_nodes(s, d)).select("id")


@query(f"WITH {FILES} SELECT id, unnest(chunk_ids) AS item FROM files")
def linked_chunks(s, d):
    return L.linked(file_nodes(s, d), "chunk_ids")


@query(f"""WITH {N}, {P}, {FACTS} SELECT id, label, type, kind, (SELECT count(*) FROM facts WHERE node_id = id) AS n_facts,
(SELECT count(*) FROM edges WHERE source = id) + (SELECT count(*) FROM edges WHERE target = id) AS n_edges FROM nodes""")
def node_list_view(s, d):
    return L.list_view(D.nodes(s, d), D.edges(s, d, uses=False), facts(s, d))


@query(f"WITH {N}, {P}, {FACTS} SELECT id, label, type, kind, (SELECT count(*) FROM facts WHERE node_id = id) AS n_facts, (SELECT count(*) FROM edges WHERE source = id) + (SELECT count(*) FROM edges WHERE target = id) AS n_edges FROM nodes ORDER BY label, id LIMIT 30")
def node_list_limited(s, d):
    return L.list_view(D.nodes(s, d), D.edges(s, d, uses=False), facts(s, d), 30)


@query(f"""WITH {N}, {P}, {FACTS} SELECT id, label, coalesce((SELECT list(fact ORDER BY facts.seq, fact) FROM facts WHERE node_id = id), []) AS facts,
coalesce((SELECT list(relation || ' ' || target ORDER BY edges.seq, relation || ' ' || target) FROM edges WHERE source = id), []) AS outgoing,
coalesce((SELECT list(relation || ' ' || source ORDER BY edges.seq, relation || ' ' || source) FROM edges WHERE target = id), []) AS incoming FROM nodes""")
def node_detail_view(s, d):
    return L.detail_view(D.nodes(s, d), D.edges(s, d, uses=False), facts(s, d))


@query(f"""WITH {N}, {P}, {D.BOTH}, best AS (SELECT src, dst, max(weight) AS weight, min(seq) AS seq FROM both_ GROUP BY src, dst),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, seq, dst) AS INTEGER) AS rank FROM best) SELECT src, dst, label, weight, rank FROM r JOIN nodes ON dst = id WHERE rank <= 10""")
def related_nodes(s, d):
    return L.related(D.nodes(s, d), D.edges(s, d, uses=False), 2)


@query(f"""WITH {P}, p AS (SELECT DISTINCT 'nation_' || s_nationkey AS a, 'supplier_' || (s_suppkey + s_suppkey % 3) AS b, CASE WHEN s_suppkey % 2 = 0 THEN 'located_in' ELSE 'owns' END AS relation FROM supplier)
SELECT a, b, relation, EXISTS (SELECT 1 FROM edges e WHERE (e.source = a AND e.target = b) OR (e.source = b AND e.target = a)) AS connected,
EXISTS (SELECT 1 FROM edges e WHERE e.relation = p.relation AND ((e.source = a AND e.target = b) OR (e.source = b AND e.target = a))) AS same FROM p""")
def edge_probes(s, d):
    k = F.col("s_suppkey")
    p = t(s, d, "supplier").select(F.concat(F.lit("nation_"), "s_nationkey").alias("a"), F.concat(F.lit("supplier_"), k + k % 3).alias("b"), F.when(k % 2 == 0, "located_in").otherwise("owns").alias("relation")).distinct()
    return L.probe_edges(p, D.edges(s, d, uses=False))


@query(f"WITH {N} SELECT id, CASE WHEN type = 'Place' AND seq % 2 = 0 THEN 'The ' || label ELSE label END AS label, CASE WHEN type = 'Place' AND seq % 3 = 0 THEN 'Country' ELSE type END AS type FROM nodes")
def node_update(s, d):
    n = D.nodes(s, d)
    c = n.filter("type = 'Place'").select("id", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("The "), "label")).alias("label"), F.when(F.col("seq") % 3 == 0, "Country").alias("type"))
    return L.updated(n, c).select("id", "label", "type")


@query(f"WITH {N} SELECT id, CASE WHEN id IN (SELECT 'customer_' || o_custkey FROM orders) THEN 't1' ELSE 't0' END AS last_active, CAST(1 + (id IN (SELECT 'customer_' || o_custkey FROM orders))::INT AS INTEGER) AS session_count FROM nodes")
def touched_nodes(s, d):
    n = D.nodes(s, d).select("id", F.lit("t0").alias("last_active"), F.lit(1).alias("session_count"))
    return L.touched(n, t(s, d, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("id")), "t1")


@query(f"""WITH {FILES} SELECT f.id, f.label, CAST(coalesce(len(f.chunk_ids), 0) AS INTEGER) AS n_chunks, f.stale, (SELECT count(*) FROM files u WHERE u.kind IN ('section', 'symbol') AND starts_with(u.id, f.id || '__')) AS n_units FROM files f WHERE f.kind = 'file'""")
def document_list(s, d):
    return L.documents(file_nodes(s, d))


@query(f"WITH {FILES} SELECT id, label, kind FROM files WHERE kind IN ('section', 'symbol') AND starts_with(id, 'file_7__')")
def document_units(s, d):
    return L.document_units(file_nodes(s, d), "file_7")


@query(f"WITH {FILES}, {P} SELECT (SELECT count(*) FROM files) AS nodes, (SELECT count(*) FROM files WHERE stale) AS stale, (SELECT count(*) FROM edges) AS edges")
def graph_counters(s, d):
    return L.counters(file_nodes(s, d), D.edges(s, d, uses=False))


@query("SELECT event_id FROM events WHERE event_type = 'view'")
def overview_sources(s, d):
    e = t(s, d, "events").withColumn("source", F.when(F.col("event_type") == "view", "verified_fact").otherwise("guess"))
    return L.overview_sources(e, "overview").select("event_id").unionByName(L.overview_sources(e, "chat").select("event_id"))


@query("SELECT doc_id AS id, lang AS label, NULL AS path, 'facts' AS collection FROM documents UNION ALL SELECT doc_id, NULL, source, 'files' FROM documents WHERE doc_id % 2 = 0")
def fact_and_file_hits(s, d):
    x = t(s, d, "documents")
    return L.found(x.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), x.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("path")))


# ------------------------------------------------------------------ replies

NAMES = ["GIN index", "query", "Order Book", "x", "primary key", "Sandy", "json", "The Table"]
GARBAGE = f"(n IN ({quoted([*EX.NEVER, *EX.JARGON])}) OR (len(w) >= 2 AND w[-1] IN ({quoted(EX.JARGON)})) OR length(n) < 2)"


@query(f"WITH x AS (SELECT o_orderkey, lower({sql_pick(NAMES, 'o_orderkey')}) AS n FROM orders), y AS (SELECT *, string_split(n, ' ') AS w FROM x) SELECT o_orderkey, {GARBAGE} AS garbage FROM y")
def garbage_entities(s, d):
    return t(s, d, "orders").select("o_orderkey", EX.garbage(pick(NAMES, "o_orderkey")).alias("garbage"))


def replies(s, d):
    """A reply for each turn: entities from its text and others, relations and facts among them."""
    w = F.split("text", " ")
    e = lambda name, there: F.struct(name.alias("name"), F.lit("person").alias("type"), there.alias("existing_id"))
    none = F.lit(None).cast("string")
    r = lambda a, b, rel: F.struct(a.alias("source"), b.alias("target"), rel.alias("relation"))
    f = lambda a, x: F.struct(a.alias("entity"), x.alias("fact"))
    one, two = w[0], F.lower(F.coalesce(F.get(w, 1), F.lit("zz")))
    result = F.struct(
        F.array(e(one, none), e(two, none), e(F.lit("Zebra"), none), e(F.lit("Known"), F.lit("k")), e(F.lit("Query"), none)).alias("entities"),
        F.array(r(one, F.lit("Zebra"), F.lit("knows")), r(F.lit("Zebra"), F.lit("Yak"), F.lit("knows")), r(one, two, F.lit("Related To")), r(F.lit("known"), F.lit("Yak"), F.lit("co_mentioned")), r(F.lit("Yak"), F.lower(one), F.lit("likes"))).alias("relations"),
        F.array(f(F.lower(one), F.lit("short")), f(one, F.lit(" Was mentioned ")), f(one, F.lit("lives near the sea")), f(F.lit("Zebra"), F.lit("lives near the sea"))).alias("facts"),
    )
    return t(s, d, "conversations").filter("length(text) > 0").withColumn("r", result)


REPLY = """x AS (SELECT conv_id, turn, lower(text) AS msg, split_part(text, ' ', 1) AS one, lower(CASE WHEN contains(text, ' ') THEN split_part(text, ' ', 2) ELSE 'zz' END) AS two FROM conversations WHERE length(text) > 0),
en AS (SELECT conv_id, turn, k, name, there FROM x, LATERAL (VALUES (1, one, NULL), (2, two, NULL), (3, 'Zebra', NULL), (4, 'Known', 'k'), (5, 'Query', NULL)) v(k, name, there)),
re AS (SELECT conv_id, turn, k, a, b, rel FROM x, LATERAL (VALUES (1, one, 'Zebra', 'knows'), (2, 'Zebra', 'Yak', 'knows'), (3, one, two, 'Related To'), (4, 'known', 'Yak', 'co_mentioned'), (5, 'Yak', lower(one), 'likes')) v(k, a, b, rel)),
fa AS (SELECT conv_id, turn, k, ent, fact FROM x, LATERAL (VALUES (1, lower(one), 'short'), (2, one, ' Was mentioned '), (3, one, 'lives near the sea'), (4, 'Zebra', 'lives near the sea')) v(k, ent, fact))"""


def _reply_sql(entity: str, fold: str, relation: str) -> str:
    return f"""WITH {REPLY}, ok AS (SELECT en.*, {fold.format('name')} AS f FROM en JOIN x USING (conv_id, turn), LATERAL (SELECT lower(trim(name)) AS n, string_split(lower(trim(name)), ' ') AS w) g WHERE {entity}),
rr AS (SELECT re.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS rn FROM re WHERE {relation} AND EXISTS (SELECT 1 FROM ok WHERE ok.conv_id = re.conv_id AND ok.turn = re.turn AND ok.f IN ({fold.format('a')}, {fold.format('b')}))),
c AS (SELECT conv_id, turn, count(*) AS n FROM ok GROUP BY ALL)
SELECT conv_id, turn, coalesce((SELECT string_agg(name, ',' ORDER BY k) FROM ok WHERE ok.conv_id = x.conv_id AND ok.turn = x.turn), '') AS entities,
coalesce((SELECT string_agg(a || '>' || b, ',' ORDER BY k) FROM rr WHERE rr.conv_id = x.conv_id AND rr.turn = x.turn AND rn <= greatest(2 * coalesce((SELECT n FROM c WHERE c.conv_id = x.conv_id AND c.turn = x.turn), 0), 1)), '') AS relations,
(SELECT count(*) FROM fa WHERE fa.conv_id = x.conv_id AND fa.turn = x.turn AND length(trim(fact)) >= 10 AND lower(trim(fact)) NOT IN ({quoted(EX.VAGUE_FACTS)}) AND EXISTS (SELECT 1 FROM ok WHERE ok.conv_id = fa.conv_id AND ok.turn = fa.turn AND ok.f = {fold.format('ent')})) AS n_facts FROM x"""


def _reply_view(df, c):
    return df.select("conv_id", "turn", F.array_join(F.transform(c["entities"], lambda e: e["name"]), ",").alias("entities"), F.array_join(F.transform(c["relations"], lambda r: F.concat(r["source"], F.lit(">"), r["target"])), ",").alias("relations"), F.size(c["facts"]).cast("long").alias("n_facts"))


@query(_reply_sql(f"NOT {GARBAGE} AND (contains(msg, lower(name)) OR there IS NOT NULL)", "lower({})", f"replace(lower(rel), ' ', '_') NOT IN ({quoted(EX.VAGUE_RELATIONS)})"))
def s1_validation(s, d):
    r = replies(s, d)
    return _reply_view(r.withColumn("v", EX.valid_extraction(F.col("r"), F.col("text"))), F.col("v"))


@query(_reply_sql("contains(msg, lower(name))", "{}", "rel <> 'co_mentioned'"))
def conversation_validation(s, d):
    r = replies(s, d)
    return _reply_view(r.withColumn("v", EX.valid_conversation(F.col("r"), F.col("text"))), F.col("v"))


@query(f"""WITH x AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS w, role FROM conversations)
SELECT conv_id, turn, CASE WHEN length(w) > 3 AND trim(lower(w), '!?.,;:"''()[]') NOT IN ({quoted(EX.BLACKLIST)}) AND length(w || role) >= 2 THEN w || '/Place,' ELSE '' END || 'Sandra/Widget' AS entities, w || ' likes Sandra' AS relations, role = 'assistant' AS by_assistant FROM x WHERE regexp_matches(w, '^[A-Za-z.,]+$')""")
def conversation_reply(s, d):
    w = F.element_at(F.split("text", " "), 1)
    j = F.concat(F.lit('Sure: ```json {"entities": [{"name": "'), w, F.lit('", "type": " lugar "}, {"name": "Sandra", "type": "widget"}, {"name": "abc", "type": "person"}, {"name": "noType"}, 5, {"name": "Thanks!", "type": "person"}], "relations": [{"source": "'), w, F.lit('", "target": "Sandra", "relation": "LIKES"}, {"source": "a", "target": "", "relation": "likes"}, {"source": "a", "target": "b", "relation": "co_mentioned"}], "facts": [{"entity": "Sandra", "fact": "is kind", "speaker": "'), "role", F.lit('"}, {"entity": "Sandra"}]} ```'))
    c = t(s, d, "conversations").filter(w.rlike("^[A-Za-z.,]+$")).select("conv_id", "turn", X.strip_fences(j).alias("reply"))
    c = EX.json_object(c, "reply").withColumn("r", EX.conversation_reply(F.col("json")))
    show = F.array_join(F.transform(F.col("r.entities"), lambda e: F.concat(e["name"], F.lit("/"), e["type"])), ",")
    rel = F.array_join(F.transform(F.col("r.relations"), lambda x: F.concat(x["source"], F.lit(" "), x["relation"], F.lit(" "), x["target"])), ",")
    return c.select("conv_id", "turn", show.alias("entities"), rel.alias("relations"), (F.col("r.facts")[0]["speaker"] == "assistant").alias("by_assistant"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey < 3 THEN '' ELSE 's' || s_suppkey || '>s' || (s_suppkey % 3) END AS merges, 'a owns b,n' || s_suppkey || ' serves c' AS relations, 's' || s_suppkey || ':Place' AS corrections, 'd' || s_suppkey AS discards,
'E' || s_suppkey || '/Technology/UNIVERSAL/' || CASE WHEN s_suppkey % 2 = 0 THEN 'e' || s_suppkey ELSE '' END AS entities, CAST(1 AS BIGINT) AS n_facts FROM supplier""")
def update_reply(s, d):
    k = F.col("s_suppkey").cast("string")
    into = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("s"), k)).otherwise(F.concat(F.lit("s"), F.col("s_suppkey") % 3))
    j = F.concat(
        F.lit('{"merges": [{"from": "s'), k, F.lit('", "into": "'), into, F.lit('"}, {"from": "", "into": "x"}, "odd"], "new_relations": [{"source": "a", "target": "b", "relation": "owns"}, {"source": "a", "target": "b", "relation": "Related to"}], "type_corrections": [{"id": "s'), k,
        F.lit('", "new_type": "Place"}, {"id": "q"}], "discards": [{"id": "d'), k, F.lit('"}, {}], "assistant_entities": [{"name": "E'), k, F.lit('", "type": "tecnologia", "layer": "odd", "existing_id": "'), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("e"), k)).otherwise("null"),
        F.lit('"}, {"name": "F", "type": "x"}], "assistant_facts": [{"entity": "E", "fact": "too short"}, {"entity": "E", "fact": "long enough"}], "assistant_relations": [{"source": "n'), k, F.lit('", "target": "c", "relation": "serves"}]\n}'),
    )
    c = EX.json_object(t(s, d, "supplier").select("s_suppkey", j.alias("reply")), "reply").withColumn("r", EX.update_reply(F.col("json")))
    join = lambda a, f: F.array_join(F.transform(F.col(f"r.{a}"), f), ",").alias(a)
    return c.select(
        "s_suppkey", join("merges", lambda m: F.concat(m["old"], F.lit(">"), m["new"])), join("relations", lambda x: F.concat_ws(" ", x["source"], x["relation"], x["target"])), join("corrections", lambda x: F.concat_ws(":", x["id"], x["type"])), join("discards", lambda x: x),
        join("entities", lambda e: F.concat_ws("/", e["name"], e["type"], e["layer"], F.coalesce(e["existing_id"], F.lit("")))), F.size("r.facts").cast("long").alias("n_facts"),
    )


@query("""SELECT o_orderkey, coalesce((SELECT c_name FROM customer WHERE c_custkey = o_custkey AND o_orderkey % 3 <> 2), 'other ' || o_orderkey) AS source, 'unknown' AS target FROM orders""")
def relation_endpoints(s, d):
    k = F.col("o_orderkey") % 3
    c = t(s, d, "customer").select(F.concat(F.lit("ID"), "c_custkey").alias("model_id"), F.col("c_name").alias("label"), "c_custkey")
    o = t(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    r = o.select("o_orderkey", F.when(k == 0, F.lower("model_id")).when(k == 1, F.upper("label")).otherwise(F.concat(F.lit("other "), "o_orderkey")).alias("source"), F.lit("unknown").alias("target"), F.lit("r").alias("relation"))
    return EX.resolved_ends(r, c.select("model_id", "label")).drop("relation")


@query("SELECT o_orderkey, 'customer_' || c_custkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 2 = 0")
def facts_to_entities(s, d):
    c = t(s, d, "customer")
    f = t(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.upper("c_name").alias("entity"))
    return EX.attached_facts(f, c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"), F.lower("c_name").alias("name"))).select("o_orderkey", "id")


@query("""WITH e AS (SELECT 'supplier_' || s_suppkey AS id, s_name AS name, s_suppkey AS k FROM supplier), r AS (SELECT a.name AS source, b.name AS target FROM e a JOIN e b ON b.k = a.k + 1),
dir AS (SELECT name FROM e WHERE k % 10 = 0), near AS (SELECT name FROM dir UNION SELECT target FROM r WHERE source IN (SELECT name FROM dir) UNION SELECT source FROM r WHERE target IN (SELECT name FROM dir))
SELECT 'entity' AS what, name AS a, '' AS b FROM e WHERE name IN (SELECT name FROM near) UNION ALL SELECT 'relation', source, target FROM r WHERE source IN (SELECT name FROM near) OR target IN (SELECT name FROM near)""")
def web_relevance(s, d):
    e = t(s, d, "supplier").select(F.concat(F.lit("supplier_"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    r = e.select(F.col("name").alias("source"), (F.col("k") + 1).alias("k")).join(e.select(F.col("name").alias("target"), "k"), "k").select("source", "target")
    ents, rels = EX.relevant_web(e.select("id", "name"), r, F.lit("nothing"), e.filter("k % 10 = 0").select("id"))
    return ents.select(F.lit("entity").alias("what"), F.col("name").alias("a"), F.lit("").alias("b")).unionByName(rels.select(F.lit("relation").alias("what"), F.col("source").alias("a"), F.col("target").alias("b")))


# ------------------------------------------------------------------ rendering and context

ENDS = "en0 AS (SELECT source AS id, target AS dst, TRUE AS out_, relation, seq FROM edges UNION ALL SELECT target, source, FALSE, relation, seq FROM edges WHERE source <> target), en AS (SELECT e.id, e.out_, e.relation, n.label AS other, e.rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, dst) AS rank FROM en0) e JOIN nodes n ON n.id = e.dst)"


def described(s, d):
    """Nodes with what rendering needs: every third region or nation has a description, some have been met before."""
    k = F.col("seq")
    extra = [F.when(k % 3 == 0, F.concat(F.lit("about "), "label")).otherwise("").alias("description"), (k % 3 + 1).cast("int").alias("session_count"), F.when(k % 2 == 0, F.concat(F.lit("sum "), "id")).otherwise("").alias("summary"), F.when(k % 5 == 0, F.concat("id", F.lit(".md"))).alias("file_path")]
    return D.nodes(s, d).withColumn("kind", F.when(F.col("type") == "Product", "file").otherwise(F.col("kind"))).select("*", *extra)


DESCRIBED = "desc_ AS (SELECT id, label, type, CASE WHEN type = 'Product' THEN 'file' ELSE kind END AS kind, seq, CASE WHEN seq % 3 = 0 THEN 'about ' || label ELSE '' END AS description, seq % 3 + 1 AS session_count, CASE WHEN seq % 2 = 0 THEN 'sum ' || id ELSE '' END AS summary, CASE WHEN seq % 5 = 0 THEN id || '.md' END AS file_path FROM nodes)"
SRC = {"user": "The user mentioned:", "web": "From web search:", "rag": "From documents:"}
BLOCKS = f"""{ENDS}, {DESCRIBED}, fs AS (SELECT node_id AS id, source, string_agg('- ' || fact, chr(10) ORDER BY seq, fact) AS f FROM facts GROUP BY ALL),
rl AS (SELECT id, string_agg('- ' || CASE WHEN out_ THEN relation ELSE {cases(X.REVERSED, 'relation', 'relation')} END || ': ' || other, chr(10) ORDER BY k) AS r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM en) WHERE k <= 5 GROUP BY id),
b0 AS (SELECT d.id, d.seq, '# ' || label || ' (' || type || ')' AS head, concat_ws(chr(10), CASE WHEN session_count > 1 THEN 'Mentioned in ' || session_count || ' previous sessions.' END,
CASE WHEN kind = 'file' AND NOT EXISTS (SELECT 1 FROM facts WHERE node_id = d.id) THEN concat_ws(chr(10), CASE WHEN summary <> '' THEN 'Summary: ' || summary END, CASE WHEN file_path <> '' THEN 'File: ' || file_path END) END,
{', '.join(f"(SELECT {quoted([v])} || chr(10) || f FROM fs WHERE fs.id = d.id AND fs.source = '{k}')" for k, v in SRC.items())}, (SELECT 'Relations:' || chr(10) || r FROM rl WHERE rl.id = d.id)) AS body FROM desc_ d),
bl AS (SELECT id, seq, CASE WHEN body = '' THEN '' ELSE head || chr(10) || body END AS block FROM (SELECT id, seq, head, trim(replace(body, chr(10) || chr(10), chr(10)), chr(10)) AS body FROM b0))"""


@query(f"WITH {N}, {P}, {FACTS}, {BLOCKS} SELECT id, block FROM bl")
def node_blocks(s, d):
    return RE.node_blocks(described(s, d), D.edges(s, d, uses=False), facts(s, d))


ACTIVE = "act AS (SELECT DISTINCT o_orderkey % 50 AS text_id, 'customer_' || o_custkey AS id FROM orders WHERE o_orderkey % 5 < 2)"


def active(s, d):
    return t(s, d, "orders").filter("o_orderkey % 5 < 2").select((F.col("o_orderkey") % 50).alias("text_id"), F.concat(F.lit("customer_"), "o_custkey").alias("id")).distinct()


NEAR = "bst AS (SELECT src, dst, max(weight) AS weight, min(seq) AS seq FROM both_ GROUP BY src, dst), nb AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, seq, dst) AS rank FROM bst)"


@query(f"""WITH {N}, {P}, {D.BOTH}, {FACTS}, {ACTIVE}, {NEAR}, h AS (SELECT a.text_id, dst AS id, max(weight) AS w FROM act a JOIN nb ON src = a.id AND rank <= 5 WHERE dst IN (SELECT id FROM nodes) AND NOT EXISTS (SELECT 1 FROM act b WHERE b.text_id = a.text_id AND b.id = dst) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY text_id ORDER BY w DESC, id) AS INTEGER) AS rank FROM h) SELECT text_id, id, rank FROM k WHERE rank <= 5 AND id IN (SELECT node_id FROM facts)""")
def neighbour_pull(s, d):
    return RE.pulled(active(s, d), D.nodes(s, d), D.edges(s, d, uses=False), facts(s, d))


@query(f"""WITH {N}, {P}, {D.BOTH}, {FACTS}, {ACTIVE}, {NEAR}, m AS (SELECT a.text_id, dst AS id FROM act a JOIN nb ON src = a.id AND rank <= 3 WHERE dst IN (SELECT node_id FROM facts) AND dst IN (SELECT id FROM nodes))
SELECT text_id, id, TRUE AS hot FROM act UNION ALL SELECT DISTINCT text_id, id, FALSE FROM m WHERE NOT EXISTS (SELECT 1 FROM act b WHERE b.text_id = m.text_id AND b.id = m.id)""")
def gather_nodes(s, d):
    return RE.gathered(active(s, d), D.nodes(s, d), D.edges(s, d, uses=False), facts(s, d))


@query(f"""WITH {N}, {P}, {D.BOTH}, {FACTS}, {ACTIVE}, {NEAR}, {BLOCKS}, own AS (SELECT a.text_id, a.id, 0 AS part, bl.seq, block FROM act a JOIN bl USING (id) WHERE CAST(split_part(a.id, '_', 2) AS BIGINT) % 2 = 0 AND block <> ''),
h AS (SELECT a.text_id, dst AS id, max(weight) AS w FROM own a JOIN nb ON src = a.id AND rank <= 5 WHERE dst IN (SELECT id FROM nodes) AND NOT EXISTS (SELECT 1 FROM own b WHERE b.text_id = a.text_id AND b.id = dst) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY w DESC, id) AS rank FROM h), more AS (SELECT text_id, id, 1 AS part, rank AS seq, block FROM k JOIN bl USING (id) WHERE rank <= 5 AND id IN (SELECT node_id FROM facts) AND block <> '')
SELECT text_id, 'Note: in previous sessions the user identified as Sandy.' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY part, seq) AS paragraph FROM (SELECT text_id, part, seq, block FROM own UNION ALL SELECT text_id, part, seq, block FROM more) GROUP BY text_id""")
def synthesis(s, d):
    a = active(s, d)
    named = a.filter(F.substring_index("id", "_", -1).cast("long") % 2 == 0)
    return RE.synthesized(a, named, described(s, d), D.edges(s, d, uses=False), facts(s, d), "Sandy")


CHOSEN = "ch AS (SELECT o_orderkey % 40 AS text_id, o_orderkey AS seq, o_orderstatus AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'relation' ELSE 'fact' END AS source, CASE o_orderkey % 3 WHEN 0 THEN '**' || o_orderstatus || '** → to ' || o_custkey WHEN 1 THEN '**' || o_orderstatus || '**: told ' || o_custkey ELSE 'bare ' || o_custkey END AS text FROM orders)"


def chosen(s, d):
    k, name = F.col("o_orderkey") % 3, F.concat(F.lit("**"), "o_orderstatus", F.lit("**"))
    body = F.when(k == 0, F.concat(name, F.lit(" → to "), "o_custkey")).when(k == 1, F.concat(name, F.lit(": told "), "o_custkey")).otherwise(F.concat(F.lit("bare "), "o_custkey"))
    return t(s, d, "orders").select((F.col("o_orderkey") % 40).alias("text_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("label"), F.when(k == 0, "relation").otherwise("fact").alias("source"), body.alias("text"))


@query(f"""WITH {CHOSEN}, p AS (SELECT text_id, seq, label, source, CASE WHEN source = 'relation' THEN trim(split_part(text, '→', 2)) WHEN contains(text, '**: ') THEN trim(split_part(text, '**: ', 2)) ELSE text END AS x FROM ch),
g AS (SELECT text_id, label, string_agg(x, '; ' ORDER BY seq) FILTER (WHERE source = 'fact') AS f, string_agg(x, ', ' ORDER BY seq) FILTER (WHERE source = 'relation') AS r, min(seq) FILTER (WHERE source = 'fact') AS fm, min(seq) AS m FROM p GROUP BY ALL)
SELECT text_id, string_agg('**' || label || '**' || CASE WHEN f IS NULL THEN ' -> ' || r ELSE ': ' || f || coalesce(' | ' || r, '') END, chr(10) ORDER BY fm IS NULL, coalesce(fm, m)) AS context FROM g GROUP BY text_id""")
def compact_chunk_context(s, d):
    return RE.compact_chunks(chosen(s, d))


@query(f"WITH {CHOSEN} SELECT text_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS context FROM ch GROUP BY text_id")
def verbose_chunk_context(s, d):
    return RE.verbose_chunks(chosen(s, d))


@query("""WITH f AS (SELECT source AS folder, doc_id || '.md' AS name, doc_id % 4 AS sections FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM f)
SELECT folder, count(*) AS n_files, CAST(sum(sections) AS BIGINT) AS n_sections, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 10) || CASE WHEN count(*) > 10 THEN ', … ' || (count(*) - 10) || ' more' ELSE '' END AS listing FROM k GROUP BY folder""")
def folder_listing(s, d):
    return RE.folder_listing(t(s, d, "documents").select(F.col("source").alias("folder"), F.concat("doc_id", F.lit(".md")).alias("name"), (F.col("doc_id") % 4).alias("sections")))


@query(f"""WITH {N}, {P}, {FACTS}, {ENDS}, few AS (SELECT * FROM nodes ORDER BY seq LIMIT 20)
SELECT id, '- ' || label || ' (' || type || ')' || coalesce((SELECT ' | ' || string_agg(fact, '; ' ORDER BY seq) FROM (SELECT fact, facts.seq FROM facts WHERE node_id = few.id ORDER BY facts.seq LIMIT 3)), '')
|| coalesce((SELECT ' | ' || string_agg(relation || ' ' || other, '; ' ORDER BY rank) FROM en WHERE en.id = few.id AND rank <= 5), '') AS line FROM few""")
def curation_listing(s, d):
    return RE.curation_block(D.nodes(s, d), D.edges(s, d, uses=False), facts(s, d))


@query(f"WITH {ACTIVE} SELECT text_id, substr('context ' || text_id, 1, 500) AS preview, count(*) AS n_active, list_sort(list(id))[1:20] AS active FROM act GROUP BY text_id")
def debug_view(s, d):
    a = active(s, d)
    return RE.debug_view(a.select("text_id", F.concat(F.lit("context "), "text_id").alias("context")).distinct(), a)


ASKS = "asks AS (SELECT conv_id * 1000 + turn AS text_id, text || CASE WHEN turn % 4 = 3 THEN '' ELSE ' nation_' || (conv_id % 25) END AS text, ['overview', 'specific', 'followup', 'chat'][1 + (conv_id + turn) % 4] AS intent FROM conversations WHERE role = 'user')"


def asks(s, d):
    c = t(s, d, "conversations").filter("role = 'user'")
    intent = F.element_at(F.array(*map(F.lit, ["overview", "specific", "followup", "chat"])), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) + 1).cast("int"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), F.concat("text", F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit(" nation_"), F.col("conv_id") % 25))).alias("text"), intent.alias("intent"))


def graph(s, d):
    """Places, organisations and, as synthesis nodes, a note on each region."""
    n = described(s, d).filter("type <> 'Product'").select("id", "label", "type", "kind", "seq", "description", "summary")
    r = t(s, d, "region").select(F.concat(F.lit("note_"), "r_regionkey").alias("id"), F.concat(F.lit("Note on "), "r_name").alias("label"), F.lit("Note").alias("type"), F.lit("synthesis").alias("kind"), (F.col("r_regionkey") + 9 * D.SHIFT).cast("long").alias("seq"), F.lit("").alias("description"), F.concat(F.lit("all about nation_"), F.col("r_regionkey") * 5, F.lit(" and more")).alias("summary"))
    return n.unionByName(r)


SEEDS = f"""{DESCRIBED}, gr AS (SELECT id, label, type, kind, seq, description, summary FROM desc_ WHERE type <> 'Product' UNION ALL SELECT 'note_' || r_regionkey, 'Note on ' || r_name, 'Note', 'synthesis', CAST(r_regionkey + {9 * D.SHIFT} AS BIGINT), '', 'all about nation_' || (r_regionkey * 5) || ' and more' FROM region),
{ASKS}, aw AS (SELECT DISTINCT text_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM asks),
fnd AS (SELECT text_id, id FROM asks, gr WHERE length(label) >= 3 AND contains(lower(text), lower(label)) UNION SELECT text_id, id FROM aw, gr WHERE length(w) >= 4 AND length(label) >= 3 AND starts_with(lower(label), w)),
tlk AS (SELECT DISTINCT text_id, id FROM aw JOIN asks USING (text_id), gr WHERE intent = 'chat' AND kind = 'synthesis' AND length(w) >= 4 AND contains(lower(summary), w)),
sds AS (SELECT * FROM fnd WHERE text_id NOT IN (SELECT text_id FROM tlk) UNION SELECT * FROM tlk UNION SELECT text_id, id FROM asks, gr WHERE intent = 'overview' AND kind = 'entity' AND text_id NOT IN (SELECT text_id FROM fnd))"""


@query(f"WITH {N}, {SEEDS} SELECT text_id, id FROM sds")
def context_seeds(s, d):
    return PR.seeds(asks(s, d), graph(s, d)).select("text_id", "id")


LAYERED = f"""{SEEDS}, lr AS (SELECT text_id, id, 0 AS depth FROM sds UNION SELECT text_id, dst, depth + 1 FROM lr JOIN both_ ON src = lr.id WHERE depth < 2 AND dst IN (SELECT id FROM gr)),
lay AS (SELECT text_id, id, CAST(min(depth) AS INTEGER) AS depth FROM lr GROUP BY ALL)"""


@query(f"WITH RECURSIVE {N}, {P}, {D.BOTH}, {LAYERED} SELECT text_id, id, depth FROM lay")
def context_layers(s, d):
    g = graph(s, d)
    return PR.layered(asks(s, d), g, D.edges(s, d, uses=False)).select("text_id", "id", "depth")


TOKENS = "greatest(1, CAST(floor(len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INTEGER))"
GRENDS = ENDS.replace("JOIN nodes n", "JOIN gr n")
HEAD = "'  ' || label || ' [' || type || ']'"
LINES = f"""{GRENDS}, hr AS (SELECT id, name, min(rank) AS rank, '    ' || name || ': ' || string_agg(other, ', ' ORDER BY rank) AS x FROM (SELECT *, CASE WHEN out_ THEN {cases(PR.OUTGOING, 'relation', 'relation')} ELSE {cases(PR.INCOMING, 'relation', "'← ' || relation")} END AS name FROM en WHERE rank <= 12) GROUP BY id, name),
hl AS (SELECT g.id, concat_ws(chr(10), {HEAD} || CASE WHEN description <> '' THEN ' — ' || description ELSE '' END, (SELECT string_agg(x, chr(10) ORDER BY rank) FROM hr WHERE hr.id = g.id), (SELECT string_agg('    * ' || fact, chr(10) ORDER BY seq) FROM (SELECT fact, seq, node_id, row_number() OVER (PARTITION BY node_id ORDER BY seq) AS k FROM facts) WHERE k <= 3 AND node_id = g.id)) AS line FROM gr g),
wl AS (SELECT g.id, {HEAD} || coalesce((SELECT ': ' || string_agg(other, ' + ' ORDER BY rank) FROM en WHERE en.id = g.id AND rank <= 4), '') || CASE WHEN description <> '' THEN ' — ' || description ELSE '' END AS line FROM gr g)"""
OVERVIEW = "A project about places."
PREPARED = f"""{LAYERED}, {LINES}, bud AS (SELECT text_id, intent, {cases({k: str(v) for k, v in PR.BUDGETS.items()}, 'intent', "'400'")}::BIGINT AS budget FROM asks),
ln AS (SELECT l.text_id, l.depth + 1 AS layer, g.seq, CASE l.depth WHEN 0 THEN hl.line WHEN 1 THEN wl.line ELSE g.label || ' [' || g.type || ']' END AS line FROM lay l JOIN gr g USING (id) JOIN hl USING (id) JOIN wl USING (id) JOIN bud b USING (text_id) WHERE l.depth < 2 OR b.intent IN ('specific', 'followup')
UNION ALL SELECT DISTINCT text_id, 0, 0, '{OVERVIEW}' FROM lay),
nm AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY layer, seq, line) AS k FROM (SELECT ln.*, budget, {TOKENS.format('line')} AS tokens FROM ln JOIN bud USING (text_id)) WHERE tokens <= budget),
fold AS (SELECT text_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, FALSE AS kept FROM bud UNION ALL SELECT n.text_id, n.k, CASE WHEN used + tokens <= budget THEN used + tokens ELSE used END, used + tokens <= budget FROM fold f JOIN nm n ON n.text_id = f.text_id AND n.k = f.k + 1),
kp AS (SELECT nm.* FROM nm JOIN fold USING (text_id, k) WHERE kept),
pt AS (SELECT text_id, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE layer = 0) AS o, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE layer = 1) AS h, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE layer = 2) AS w, string_agg(line, ', ' ORDER BY k) FILTER (WHERE layer = 3) AS c FROM kp GROUP BY text_id),
blk AS (SELECT b.text_id, b.intent, CASE WHEN pt.text_id IS NULL THEN '{OVERVIEW}' ELSE concat_ws(chr(10), o, CASE WHEN h IS NOT NULL OR w IS NOT NULL THEN concat_ws(chr(10), '<ctx>', CASE WHEN h IS NOT NULL THEN '<hot>' || chr(10) || h || chr(10) || '</hot>' END, CASE WHEN w IS NOT NULL THEN '<warm>' || chr(10) || w || coalesce(chr(10) || '  Also: ' || c, '') || chr(10) || '</warm>' END, '</ctx>') END) END AS block FROM bud b LEFT JOIN pt USING (text_id)),
ctx AS (SELECT text_id, block || CASE WHEN intent = 'chat' THEN '' ELSE chr(10) || chr(10) || {cases(PR.GROUNDING, 'intent', "''")} END AS warm_content FROM blk)"""


@query(f"""WITH RECURSIVE {N}, {P}, {D.BOTH}, {FACTS}, {PREPARED}
SELECT text_id, warm_content, {TOKENS.format('warm_content')} AS warm_tokens, TRUE AS has_context, FALSE AS needs_tool,
(SELECT count(*) FROM lay WHERE lay.text_id = ctx.text_id AND depth = 0) AS hot, (SELECT count(*) FROM lay WHERE lay.text_id = ctx.text_id AND depth = 1) AS warm, (SELECT count(*) FROM lay WHERE lay.text_id = ctx.text_id AND depth = 2) AS cold FROM ctx""")
def prepare_context(s, d):
    return PR.prepare(asks(s, d), graph(s, d), D.edges(s, d, uses=False), facts(s, d), overview=OVERVIEW)


# ------------------------------------------------------------------ chunks and files

from . import engine_files  # noqa: E402, F401
