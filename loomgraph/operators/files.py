"""Files in the graph: structure upsert behind a content hash, summaries, reindexing, the index flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions.text import make_id, symbol_id

from .chunking import file_chunks
from .chunks import markdown_sections

NODE = ["id", "label", "type", "kind", "path", "content_hash"]


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """files(path, content_hash, ...) whose hash is not the stored one; the join comes before any parsing."""
    return files.join(stored.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def folders(files: DataFrame) -> DataFrame:
    """path, parent: every folder above the files, and what holds it."""
    parts = F.split("path", "/")
    above = files.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path")).distinct()
    return above.withColumn("parent", F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)))


def structure(files: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files(path, content_hash) and units(path, name, kind, parent, start_line): folders hold folders and files,
    files hold units, and a unit is the child of the unit it names as parent, if that unit comes before it."""
    base = lambda c: F.substring_index(c, "/", -1)
    none = F.lit(None).cast("string")
    f = folders(files)
    nodes = f.select(make_id(F.col("path")).alias("id"), base("path").alias("label"), F.lit("Folder").alias("type"), F.lit("folder").alias("kind"), "path", none.alias("content_hash"))
    nodes = nodes.unionByName(files.select(make_id(F.col("path")).alias("id"), base("path").alias("label"), F.lit("File").alias("type"), F.lit("file").alias("kind"), "path", "content_hash"))
    u = units.join(files.select("path"), "path", "left_semi").withColumn("id", symbol_id(F.col("path"), F.col("name"), F.col("parent")))
    u = u.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("start_line"))).filter("k = 1").drop("k")
    section = F.col("kind") == "section"
    nodes = nodes.unionByName(u.select("id", F.col("name").alias("label"), F.when(section, "Section").otherwise("Symbol").alias("type"), F.when(section, "section").otherwise("symbol").alias("kind"), "path", none.alias("content_hash")))
    edge = lambda df, a, b, r: df.select(a.alias("source"), b.alias("target"), F.lit(r).alias("relation"))
    up = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    edges = edge(f.filter("parent is not null"), make_id(F.col("parent")), make_id(F.col("path")), "contains")
    edges = edges.unionByName(edge(files.withColumn("up", up).filter("up is not null"), make_id(F.col("up")), make_id(F.col("path")), "contains"))
    edges = edges.unionByName(edge(u, make_id(F.col("path")), F.col("id"), "contains"))
    over = u.select("path", F.col("name").alias("parent"), F.col("id").alias("over"), F.col("start_line").alias("at"))
    nested = u.join(over, ["path", "parent"]).filter("at < start_line and over <> id")
    nearest = nested.groupBy("id").agg(F.max_by("over", "at").alias("over"))
    return nodes, edges.unionByName(edge(nearest, F.col("id"), F.col("over"), "child_of"))


def upsert_structure(nodes: DataFrame, edges: DataFrame, files: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges after files were read again: those with the stored hash stay as they are; of the others all units go and come anew."""
    new = changed_files(files, nodes.filter("kind = 'file'"))
    n, e = structure(new, units)
    gone = nodes.filter("kind in ('section', 'symbol')").join(new.select("path"), "path", "left_semi").select("id")
    left = nodes.join(gone, "id", "left_anti").join(n.select("id"), "id", "left_anti").select(*NODE)
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    same = ["source", "target", "relation"]
    return left.unionByName(n.select(*NODE)), kept.select(*same).unionByName(e.join(kept, same, "left_anti").select(*same))


def attach_summaries(units: DataFrame, summaries: DataFrame) -> DataFrame:
    """units(path, id, seq) with the summary of the same place among summaries(path, summary, seq) of the file."""
    place = F.row_number().over(W.partitionBy("path").orderBy("seq"))
    return units.withColumn("k", place).join(summaries.withColumn("k", place).select("path", "k", "summary"), ["path", "k"], "left").drop("k")


def reindex(nodes: DataFrame, edges: DataFrame, files: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stale files read again: one that is missing loses its node (its units stay) and its edges; the others are parsed anew.

    nodes has stale; the result's files are fresh.
    """
    stale = nodes.filter("kind = 'file' and stale")
    missing = stale.join(files.select("path"), "path", "left_anti").select("id")
    left = nodes.join(missing, "id", "left_anti").select(*NODE)
    kept = edges.join(missing.withColumnRenamed("id", "source"), "source", "left_anti").join(missing.withColumnRenamed("id", "target"), "target", "left_anti")
    again = files.join(stale.select("path"), "path", "left_semi")
    blank = left.join(again.select("path", F.lit(True).alias("again")), "path", "left").withColumn("content_hash", F.when(F.col("again") & (F.col("kind") == "file"), F.lit(None).cast("string")).otherwise(F.col("content_hash")))
    return upsert_structure(blank.select(*NODE), kept, again, units)


def index(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and the chunks of changed files(path, language, text, content_hash): hash gate, Markdown structure, chunks."""
    new = changed_files(files, nodes.filter("kind = 'file'"))
    units = markdown_sections(new.filter("language = 'markdown'")).withColumn("kind", F.lit("section"))
    n, e = upsert_structure(nodes, edges, files, units)
    return n, e, file_chunks(new, units)


def delete_document(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without a file, its units, their edges and its chunks."""
    gone = nodes.filter((F.col("path") == path) & F.col("kind").isin("file", "section", "symbol")).select("id")
    e = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti").select(*nodes.columns), e.select(*edges.columns), chunks.filter(F.col("path") != path)
