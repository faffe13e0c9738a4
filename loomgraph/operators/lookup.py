"""Lookups, views and small updates over nodes(id, label, type, kind, ..., seq) and edges(source, target, relation, weight, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import children, neighbors, undirected


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """A missing kind is none of them."""
    return nodes.filter(F.col("kind") == kind)


def with_chunks(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))) > 0)


def stale_files(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("kind") == "file") & F.coalesce("stale", F.lit(False)))


def linked(nodes: DataFrame, column: str) -> DataFrame:
    """id, item: the files or chunk ids of each node."""
    return nodes.select("id", F.explode(column).alias("item"))


def list_view(nodes: DataFrame, edges: DataFrame, facts: DataFrame, limit: int = 0) -> DataFrame:
    """id, label, type, kind, n_facts, n_edges by label; all rows for limit 0.  facts(node_id, fact)."""
    e = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    f = facts.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n_facts"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = nodes.join(e, "id", "left").join(f, "id", "left").select("id", "label", "type", F.coalesce("kind", F.lit("entity")).alias("kind"), none("n_facts"), none("n_edges"))
    out = out.orderBy("label", "id")
    return out.limit(limit) if limit else out


def detail_view(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """id, label, facts, outgoing, incoming: the facts and the edges' other ends, in order."""
    lines = lambda df, key, value, out: df.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(value).alias("x")))), lambda r: r["x"]).alias(out))
    e = edges.withColumn("to", F.concat("relation", F.lit(" "), "target")).withColumn("from", F.concat("relation", F.lit(" "), "source"))
    out = nodes.select("id", "label")
    for df, key, value, name in ((facts, "node_id", "fact", "facts"), (e, "source", "to", "outgoing"), (e, "target", "from", "incoming")):
        out = out.join(lines(df, key, value, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def related(nodes: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Neighbours of each node, five for each step of depth; depth is no distance."""
    return neighbors(nodes, edges, 5 * depth)


def probe_edges(probes: DataFrame, edges: DataFrame) -> DataFrame:
    """probes(a, b, relation) with connected (any edge between them) and same (one of that relation), in either direction."""
    pair = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    p = probes.select("*", *pair("a", "b"))
    e = edges.select(*pair("source", "target"), "relation").distinct()
    some = e.select("lo", "hi").distinct().withColumn("c", F.lit(True))
    out = p.join(some, ["lo", "hi"], "left").join(e.withColumn("s", F.lit(True)), ["lo", "hi", "relation"], "left")
    return out.select("a", "b", "relation", F.coalesce("c", F.lit(False)).alias("connected"), F.coalesce("s", F.lit(False)).alias("same"))


def updated(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with label and type of changes(id, label, type) where these are given; nothing else can be changed."""
    c = changes.select("id", F.col("label").alias("__label"), F.col("type").alias("__type"))
    out = nodes.join(c, "id", "left").withColumn("label", F.coalesce("__label", "label")).withColumn("type", F.coalesce("__type", "type"))
    return out.select(*nodes.columns)


def touched(nodes: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """last_active and session_count of nodes that this session meets for the first time."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    out = nodes.join(hit, "id", "left")
    out = out.withColumn("last_active", F.when(F.col("__hit"), now).otherwise(F.col("last_active")))
    return out.withColumn("session_count", (F.coalesce("session_count", F.lit(0)) + F.coalesce(F.col("__hit").cast("int"), F.lit(0))).cast("int")).select(*nodes.columns)


def documents(nodes: DataFrame) -> DataFrame:
    """File nodes with the number of their chunks and units."""
    files = by_kind(nodes, "file")
    units = nodes.filter(F.col("kind").isin("section", "symbol")).groupBy(F.substring_index("id", "__", 1).alias("id")).agg(F.count(F.lit(1)).alias("n_units"))
    out = files.select("id", "label", F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))).alias("n_chunks"), F.coalesce("stale", F.lit(False)).alias("stale"))
    return out.join(units, "id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0).cast("long")))


def document_units(nodes: DataFrame, file_id: str) -> DataFrame:
    return children(nodes, file_id).select("id", "label", "kind").orderBy("id")


def counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("stale", F.lit(False))).alias("stale")).withColumn("k", F.lit(0))
    return n.join(edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("k", F.lit(0)), "k").drop("k")


def overview_sources(items: DataFrame, intent: str) -> DataFrame:
    """Chunks that compete for the budget: all for most intents, verified ones for an overview, none in a chat."""
    return {"overview": items.filter(F.col("source").startswith("verified")), "chat": items.filter(F.lit(False))}.get(intent, items)


def found(fact_hits: DataFrame, file_hits: DataFrame, n: int = 5) -> DataFrame:
    """Hits of both collections in one list; what one lacks is null."""
    return fact_hits.withColumn("collection", F.lit("facts")).unionByName(file_hits.withColumn("collection", F.lit("files")), allowMissingColumns=True)
