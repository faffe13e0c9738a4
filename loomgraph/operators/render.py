"""Texts about nodes: blocks, paragraphs, listings, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions.text import reverse_relation

from .graph import neighbors
from .prepare import ends, in_order

# Headings of facts by source, in order; facts of other sources are not shown.
SOURCES = {"user": "The user mentioned:", "web": "From web search:", "rag": "From documents:"}
NONE = "array<string>"


def empty() -> Column:
    return F.array().cast(NONE)


def node_blocks(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """id, block: header, sessions, summary and file of indexed nodes without facts, facts by source, five relations.

    nodes(id, label, type, kind, session_count, summary, file_path), facts(node_id, fact, source, seq); a header alone gives an empty text.
    """
    by_source = facts.filter("fact <> ''").groupBy(F.col("node_id").alias("id")).agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("source", F.lit("user")) == s, F.struct("seq", "fact")))), lambda x: F.concat(F.lit("- "), x["fact"])).alias(f"f_{s}") for s in SOURCES],
        F.count(F.lit(1)).alias("n"),
    )
    name = F.when(F.col("out"), F.col("relation")).otherwise(reverse_relation(F.col("relation")))
    first = W.partitionBy("id").orderBy("rank")
    rel = ends(nodes, edges, 1 << 30).withColumn("k", F.row_number().over(first)).filter("k <= 5").withColumn("x", F.concat(F.lit("- "), name, F.lit(": "), "other"))
    rel = rel.groupBy("id").agg(in_order("k").alias("r"))
    j = nodes.join(by_source, "id", "left").join(rel, "id", "left")
    bare = F.col("kind").isin("file", "section", "symbol") & F.coalesce(F.col("n") == 0, F.lit(True))
    line = lambda ok, text: F.when(F.coalesce(ok, F.lit(False)), F.array(text)).otherwise(empty())
    parts = [
        line(F.col("session_count") > 1, F.concat(F.lit("Mentioned in "), "session_count", F.lit(" previous sessions."))),
        line(bare & (F.col("summary") != ""), F.concat(F.lit("Summary: "), "summary")),
        line(bare & (F.col("file_path") != ""), F.concat(F.lit("File: "), "file_path")),
    ]
    titled = lambda title, body: F.when(F.size(F.coalesce(body, empty())) > 0, F.concat(F.array(F.lit(title)), body)).otherwise(empty())
    parts += [titled(title, F.col(f"f_{s}")) for s, title in SOURCES.items()]
    parts.append(titled("Relations:", F.col("r")))
    body = F.concat(*parts)
    head = F.array(F.concat(F.lit("# "), "label", F.lit(" ("), "type", F.lit(")")))
    return j.select("id", F.when(F.size(body) > 0, F.array_join(F.concat(head, body), "\n")).otherwise("").alias("block"))


def pulled(included: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """text_id, id, rank: for the nodes included(text_id, id) in a paragraph, their strongest neighbours outside; those without facts drop out."""
    near = neighbors(nodes, edges).select("src", "dst", "weight")
    hit = included.join(near, F.col("id") == F.col("src")).groupBy("text_id", F.col("dst").alias("id")).agg(F.max("weight").alias("weight"))
    hit = hit.join(included, ["text_id", "id"], "left_anti")
    top = hit.withColumn("rank", F.row_number().over(W.partitionBy("text_id").orderBy(F.desc("weight"), "id"))).filter(F.col("rank") <= most)
    return top.join(facts.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").select("text_id", "id", "rank")


def synthesized(active: DataFrame, mentioned: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, identity: str | None = None) -> DataFrame:
    """text_id, paragraph: blocks of the active nodes that have facts or are mentioned, then of their strongest neighbours with facts.

    active(text_id, id), mentioned(text_id, id); a note on the user's identity leads, if it is known.
    """
    told = facts.select(F.col("node_id").alias("id")).distinct()
    use = active.join(told, "id", "left_semi").select("text_id", "id").unionByName(active.join(mentioned, ["text_id", "id"], "left_semi").select("text_id", "id")).distinct()
    blocks = node_blocks(nodes, edges, facts).filter("block <> ''")
    own = use.join(blocks, "id").join(nodes.select("id", "seq"), "id").select("text_id", "id", F.lit(0).alias("part"), "seq", "block")
    more = pulled(own.select("text_id", "id"), nodes, edges, facts).join(blocks, "id").select("text_id", "id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("seq"), "block")
    all_ = own.unionByName(more).groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "block"))).alias("b"))
    note = [F.array(F.lit(f"Note: in previous sessions the user identified as {identity}."))] if identity else []
    return all_.select("text_id", F.array_join(F.concat(*note, F.transform("b", lambda x: x["block"])), "\n\n").alias("paragraph"))


def gathered(active: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, most: int = 3) -> DataFrame:
    """text_id, id, hot: active nodes and of each its three strongest neighbours that have facts."""
    near = neighbors(nodes, edges, most).select("src", "dst").join(facts.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")
    more = active.join(near, F.col("id") == F.col("src")).select("text_id", F.col("dst").alias("id")).distinct().join(active, ["text_id", "id"], "left_anti")
    return active.select("text_id", "id").distinct().withColumn("hot", F.lit(True)).unionByName(more.withColumn("hot", F.lit(False)))


def compact_chunks(chunks: DataFrame) -> DataFrame:
    """text_id, context: the selected chunks(text_id, seq, label, text, source) by label: facts joined by semicolons, relations by commas."""
    rel = F.contains("source", F.lit("relation"))
    arrow = F.when(F.contains("text", F.lit("→")), F.trim(F.regexp_extract("text", "(?s)^[^→]*→(.*)$", 1))).otherwise(F.col("text"))
    fact = F.when(F.contains("text", F.lit("**: ")), F.trim(F.regexp_extract("text", r"(?s)^.*?\*\*: (.*)$", 1))).otherwise(F.col("text"))
    c = chunks.select("text_id", "seq", "label", rel.alias("is_relation"), F.when(rel, arrow).otherwise(fact).alias("t"))
    pick = lambda kind: in_order_if(kind)
    g = c.groupBy("text_id", "label").agg(pick(False).alias("facts"), pick(True).alias("rels"), F.min(F.when(~F.col("is_relation"), F.col("seq"))).alias("f"), F.min(F.when(F.col("is_relation"), F.col("seq"))).alias("r"))
    name = F.concat(F.lit("**"), "label", F.lit("**"))
    line = F.when(F.size("facts") == 0, F.concat(name, F.lit(" -> "), F.array_join("rels", ", "))).otherwise(F.concat(name, F.lit(": "), F.array_join("facts", "; "), F.when(F.size("rels") > 0, F.concat(F.lit(" | "), F.array_join("rels", ", "))).otherwise("")))
    order = F.struct(F.col("f").isNull().alias("a"), F.coalesce("f", "r").alias("b"), line.alias("line"))
    return g.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n").alias("context"))


def in_order_if(relation: bool) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("is_relation") == relation, F.struct("seq", "t")))), lambda x: x["t"])


def verbose_chunks(chunks: DataFrame) -> DataFrame:
    """text_id, context: the texts of the selected chunks with blank lines between."""
    return chunks.groupBy("text_id").agg(F.array_join(in_order("seq", "text"), "\n\n").alias("context"))


def folder_listing(files: DataFrame, most: int = 10) -> DataFrame:
    """folder, n_files, n_sections, listing: the first names of files(folder, name, sections), and how many more there are."""
    f = files.withColumn("k", F.row_number().over(W.partitionBy("folder").orderBy("name")))
    g = f.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("sections").cast("long").alias("n_sections"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "name")))), lambda x: x["name"]).alias("names"))
    more = F.when(F.col("n_files") > most, F.concat(F.lit(", … "), F.col("n_files") - most, F.lit(" more"))).otherwise("")
    return g.select("folder", "n_files", "n_sections", F.concat(F.array_join("names", ", "), more).alias("listing"))


def curation_block(nodes: DataFrame, edges: DataFrame, facts: DataFrame, most: int = 20) -> DataFrame:
    """id, line of the first entities: label and type, three facts, five edges."""
    few = nodes.orderBy("seq").limit(most)
    f = facts.withColumn("k", F.row_number().over(W.partitionBy("node_id").orderBy("seq"))).filter("k <= 3").groupBy(F.col("node_id").alias("id")).agg(F.array_join(in_order("k", "fact"), "; ").alias("f"))
    e = ends(nodes, edges, 5).withColumn("x", F.concat("relation", F.lit(" "), "other")).groupBy("id").agg(F.array_join(in_order("rank"), "; ").alias("e"))
    part = lambda c: F.when(F.col(c) != "", F.concat(F.lit(" | "), c)).otherwise("")
    return few.join(f, "id", "left").join(e, "id", "left").select("id", F.concat(F.lit("- "), "label", F.lit(" ("), "type", F.lit(")"), part("f"), part("e")).alias("line"))


def project_overview(description: Column, summary: Column) -> Column:
    return F.concat_ws("\n", F.when(description != "", description), F.when(summary != "", summary))


def debug_view(turns: DataFrame, active: DataFrame) -> DataFrame:
    """text_id, preview, n_active, active: the first 500 characters of the context, the number of active nodes, the first 20 of them."""
    a = active.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_active"), F.slice(F.array_sort(F.collect_list("id")), 1, 20).alias("active"))
    return turns.join(a, "text_id", "left").select("text_id", F.substring("context", 1, 500).alias("preview"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), F.coalesce("active", empty()).alias("active"))
