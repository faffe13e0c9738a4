"""What a review of the graph changes: merges, type fixes, discards, relations, file links; batches and summaries.

nodes(id, label, type, attributes map), edges(source, target, relation, weight, seq), facts(node_id, fact, source, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import GENERIC, first_per, one_per_pair, pair_key


def cut(df: DataFrame) -> DataFrame:
    """Without lineage: in the checkpoint folder if one is set, else kept by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def valid_merges(merges: DataFrame, nodes: DataFrame) -> DataFrame:
    """old, new of merges(from_id, into_id, seq) as if done in order of seq.

    A merge counts if both nodes exist and neither was absorbed before it; a node absorbed later takes what it had
    absorbed along.  Chains of any length are followed, by doubling until no row changes.
    """
    ids = nodes.select("id")
    m = merges.filter("from_id <> into_id").join(ids, F.col("from_id") == F.col("id"), "left_semi").join(ids, F.col("into_id") == F.col("id"), "left_semi")
    m = first_per(m, ["from_id"], ["seq"])
    gone = m.select(F.col("from_id").alias("into_id"), F.col("seq").alias("gone_at"))
    m = m.join(gone, "into_id", "left").filter("gone_at is null or gone_at > seq").select(F.col("from_id").alias("old"), F.col("into_id").alias("new"))
    m, moved = cut(m), True
    while moved:  # seq grows along a chain, so there are no rings
        on = m.select(F.col("old").alias("new"), F.col("new").alias("further"))
        step = cut(m.join(on, "new", "left").select("old", F.coalesce("further", "new").alias("new"), F.col("further").isNotNull().alias("moved")))
        m, moved = step.select("old", "new"), not step.filter("moved").isEmpty()
    return m


def apply_merges(nodes: DataFrame, edges: DataFrame, facts: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts move over as they are, attributes of the absorbed win, edges are re-pointed; self-loops and repeats stay."""
    m = valid_merges(merges, nodes)
    to = lambda df, col: df.join(m.select(F.col("old").alias(col), F.col("new").alias("__to")), col, "left").withColumn(col, F.coalesce("__to", col)).drop("__to")
    order = m.join(first_per(merges, ["from_id"], ["seq"]).select(F.col("from_id").alias("old"), "seq"), "old")
    own = nodes.select("id", F.explode("attributes").alias("k", "v"), F.lit(-1).cast("long").alias("seq"))
    got = nodes.join(order, nodes["id"] == order["old"]).select(F.col("new").alias("id"), F.explode("attributes").alias("k", "v"), F.col("seq").cast("long").alias("seq"))
    attrs = own.unionByName(got).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    kept = nodes.join(m.select(F.col("old").alias("id")), "id", "left_anti").drop("attributes").join(attrs, "id", "left")
    return kept, to(to(edges, "source"), "target").select(*edges.columns), to(facts, "node_id").select(*facts.columns)


def fix_types(nodes: DataFrame, fixes: DataFrame) -> DataFrame:
    """The last of fixes(id, new_type, seq) of a node sets its type."""
    f = fixes.groupBy("id").agg(F.max_by("new_type", "seq").alias("__new"))
    return nodes.join(f, "id", "left").withColumn("type", F.coalesce("__new", "type")).drop("__new")


def discard(nodes: DataFrame, edges: DataFrame, facts: DataFrame, ids: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the nodes of ids(id) that have at most ``most`` facts, their edges and facts."""
    n = facts.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    go = ids.select("id").distinct().join(n, "id", "left").filter(F.coalesce("n", F.lit(0)) <= most).select("id")
    out = lambda df, col: df.join(go.select(F.col("id").alias(col)), col, "left_anti")
    return out(nodes, "id"), out(out(edges, "source"), "target").select(*edges.columns), out(facts, "node_id").select(*facts.columns)


def upsert_relations(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after new(source, target, relation, weight, seq): a pair without an edge gets one, the first specific, else the first;
    a pair's first edge, if generic, takes the first specific relation; anything else is ignored."""
    cols = ["source", "target", "relation", "weight", "seq"]
    n = one_per_pair(new).select(*cols, *pair_key())
    first = W.partitionBy("lo", "hi").orderBy("seq")
    e = edges.select(*cols, *pair_key()).withColumn("__first", F.row_number().over(first) == 1)
    better = n.filter(~F.col("relation").isin(GENERIC)).select("lo", "hi", F.col("relation").alias("__r"))
    up = F.col("__first") & F.col("relation").isin(GENERIC) & F.col("__r").isNotNull()
    old = e.join(better, ["lo", "hi"], "left").withColumn("relation", F.when(up, F.col("__r")).otherwise(F.col("relation")))
    return old.select(*cols).unionByName(n.join(e.select("lo", "hi"), ["lo", "hi"], "left_anti").select(*cols))


def keep_first(own: Column, other: Column) -> Column:
    """Attributes of both; what a node has stays."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(own, F.map_filter(other, lambda k, v: ~F.map_contains_key(own, k))))))


def last_wins(own: Column, other: Column) -> Column:
    return keep_first(other, own)


def link_files(files: Column, path: Column) -> Column:
    return F.array_union(files, F.array(F.replace(path, F.lit("\\"), F.lit("/"))))


def unlink_files(files: Column, path: Column) -> Column:
    return F.array_except(files, F.array(F.replace(path, F.lit("\\"), F.lit("/"))))


def link_chunks(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with their chunk ids replaced by those of links(id, chunk_id, chunk_index), in order; others as they were."""
    got = links.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("__c"))
    return nodes.join(got, "id", "left").withColumn("chunk_ids", F.coalesce("__c", "chunk_ids")).drop("__c")


def mark_stale(nodes: DataFrame, paths: DataFrame, now: str) -> DataFrame:
    """File nodes of paths(id) become stale; the first time of being so stays."""
    p = paths.select("id").distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit") & ~F.coalesce("stale", F.lit(False))
    j = nodes.join(p, "id", "left")
    return j.withColumn("stale_since", F.when(hit, F.lit(now)).otherwise(F.col("stale_since"))).withColumn("stale", F.coalesce("stale", F.lit(False)) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def without_file(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """Without a file's node, its children (id prefix), and every edge at one of them."""
    of = lambda c: (F.col(c) == file_id) | F.col(c).startswith(f"{file_id}__")
    return nodes.filter(~of("id")), edges.filter(~of("source") & ~of("target"))


def children_listed(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """id, n, children: of each node the labels of what it contains, in order of insertion, the first ``most``."""
    held = edges.filter("relation = 'contains'").join(nodes.select(F.col("id").alias("target"), "label"), "target")
    top = held.withColumn("__r", F.row_number().over(W.partitionBy("source").orderBy("seq", "target"))).filter(F.col("__r") <= most)
    names = top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "label"))), lambda x: x["label"]), ", ").alias("children"))
    n = held.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "source").select(F.col("source").alias("id"), "n", "children")


def batches(files: DataFrame, size: int = 10) -> DataFrame:
    """path, batch: files(path, seq) in batches of about ``size`` that keep a folder together; folders come in order of their first file.

    A batch closes before a folder that would overflow it and after one that fills it.  The fold runs over folders
    with their counts; files join their folder's batch afterwards.
    """
    f = files.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    counts = f.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))

    def run(parts):
        import pyarrow as pa

        batch, held = 0, 0
        for b in parts:
            names, at = b.column("folder").to_pylist(), []
            for n in b.column("n").to_pylist():
                if held and held + n > size:
                    batch, held = batch + 1, 0
                at.append(batch)
                held += n
                if held >= size:
                    batch, held = batch + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int64())], ["folder", "batch"])

    # the rows are one a folder and stream through in sorted order
    of = counts.repartition(1).sortWithinPartitions("first", "folder").mapInArrow(run, "folder string, batch long")
    return f.join(of, "folder").select("path", "batch")


def layer_of(hint: Column, name: Column, text: Column, kind: Column, personal: list[str]) -> Column:
    """A hint decides, then a possessive before the name in the text, then the type."""
    own = F.contains(F.regexp_replace(F.lower(text), r"\b(mi|mis|my|nuestro|nuestra|nuestros|nuestras|our)\s+", "\u0001"), F.concat(F.lit("\u0001"), F.lower(name)))
    return F.when(hint.isin("PERSONAL", "UNIVERSAL"), hint).when(own | kind.isin(personal), "PERSONAL").otherwise("UNIVERSAL")


def summary_nodes(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """Synthesis nodes of modules(top folder) with two files or more, when there is more than one group, upserted from summaries(module, summary)."""
    g = files.groupBy(F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("(root)").alias("module")).agg(F.count(F.lit(1)).alias("n"))
    several = g.agg((F.count(F.lit(1)) > 1).alias("__several"))
    m = g.filter("n >= 2").join(several.withColumn("__k", F.lit(1)), F.lit(1) == F.col("__k")).filter("__several").join(summaries, "module")
    safe = F.regexp_replace(F.lower("module"), "[^a-z0-9]+", "_")
    return m.select(F.concat(F.lit("synthesis:module_"), F.btrim(safe, F.lit("_"))).alias("id"), F.col("module").alias("label"), F.lit("synthesis").alias("kind"), "n", "summary")
