"""Chunks, structural units, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, content: pieces of ``size`` characters that overlap; a text of at most ``size`` is one piece."""
    step = size - overlap
    n = F.when(F.length("text") <= size, 1).otherwise(F.ceil(F.length("text") / F.lit(step)).cast("int"))
    at = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return at.select("doc_id", "chunk_index", F.substring("text", F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


def stats(chunks: DataFrame) -> DataFrame:
    n = F.length("content")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("chars"), F.floor(F.sum(n) / F.count(F.lit(1))).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def size_class(n: Column) -> Column:
    return F.when(n < 100, "<100").when(n < 500, "100-500").when(n < 1000, "500-1k").when(n < 2000, "1k-2k").otherwise(">2k")


def histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(size_class(F.length("content")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def under_chunked(stats_: DataFrame) -> DataFrame:
    return stats_.filter("chars > 2000 and chunks <= 2")


def markdown_sections(files: DataFrame) -> DataFrame:
    """path, name, level, start_line, end_line, parent of the headings of files(path, text).

    A section ends with its last line before the next heading that is not blank; its parent is the nearest earlier heading of a
    smaller level.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    at = W.partitionBy("path").orderBy("pos")
    head = F.col("line").rlike(r"^#{1,6}\s+.+")
    lines = lines.withColumn("section", F.sum(head.cast("int")).over(at)).filter("section > 0")
    first = F.min_by("line", "pos")
    h = lines.groupBy("path", "section").agg((F.min("pos") + 1).alias("start_line"), first.alias("line"), F.max(F.when(F.col("line").rlike(r"\S"), F.col("pos") + 1)).alias("end_line"))
    h = h.select("path", "start_line", "end_line", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)", 1)).alias("name"))
    by = W.partitionBy("path").orderBy("start_line")
    # a heading's parent: of the last headings of each level, the latest with a smaller level
    before = by.rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("start_line", "name"))).over(before) for k in range(1, 6)]
    parent = F.greatest(F.lit(None).cast("struct<start_line:int,name:string>"), *[F.when(F.col("level") > k, x) for k, x in enumerate(last, 1)])
    return h.select("path", "name", "level", "start_line", "end_line", parent["name"].alias("parent"))


BLOCK = 256


def chunks_in_units(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """units(path, name, start_line, end_line) with the ids of the chunks of their file that lie within them.

    A file's chunks are packed in order of their first lines, ``BLOCK`` to a row; a unit meets its file's packs that may hold chunks
    within it, so that the work follows the number of chunks, not that of the lines a unit spans.
    """
    c = chunks.filter("line_start is not null and line_end is not null").select("path", "line_start", "line_end", "chunk_id")
    c = c.withColumn("__block", F.floor((F.row_number().over(W.partitionBy("path").orderBy("line_start")) - 1) / BLOCK))
    packs = c.groupBy("path", "__block").agg(F.max("line_start").alias("__to"), F.min("line_end").alias("__low"), F.collect_list(F.struct("line_start", "line_end", "chunk_id")).alias("__chunks"))
    near = (F.col("__to") >= F.col("start_line")) & (F.col("__low") <= F.col("end_line"))
    inside = F.filter("__chunks", lambda x: (x["line_start"] >= F.col("start_line")) & (x["line_end"] <= F.col("end_line")))
    hit = units.join(packs, "path").filter(near).select("path", "name", "start_line", "end_line", F.transform(inside, lambda x: x["chunk_id"]).alias("__ids")).filter(F.size("__ids") > 0)
    return hit.groupBy("path", "name", "start_line", "end_line").agg(F.array_sort(F.flatten(F.collect_list("__ids"))).alias("chunk_ids"))


# What an import path is tried with, in order.
TRIALS = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(path, target) joined to the first file that exists among the trials for the target."""
    tries = F.posexplode(F.transform(F.array(*map(F.lit, TRIALS)), lambda s: F.concat(F.col("target"), s))).alias("rank", "file")
    hit = imports.select("path", "target", tries).join(files.select(F.col("path").alias("file")), "file", "left_semi")
    return hit.groupBy("path", "target").agg(F.min_by("file", "rank").alias("resolved"))


def topic_pairs(topics: DataFrame, most: int = 20) -> DataFrame:
    """topics(file, node, topic): pairs of nodes of different files that share a topic held by 2 to 50 nodes; at most ``most`` for a topic."""
    t = topics.withColumn("topic", F.lower(F.trim("topic"))).distinct()
    ok = t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("f")).filter("n between 2 and 50 and f >= 2").select("topic")
    t = t.join(ok, "topic")
    a, b = t.select("topic", F.col("file").alias("fa"), F.col("node").alias("a")), t.select("topic", F.col("file").alias("fb"), F.col("node").alias("b"))
    p = a.join(b, "topic").filter("fa < fb")
    return p.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy("fa", "a", "fb", "b"))).filter(F.col("rank") <= most).select("topic", "a", "b", "rank")
