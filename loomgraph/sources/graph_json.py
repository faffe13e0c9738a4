"""The graph as JSON arrays or Parquet: explicit schema, defaults on read, versioned snapshots on write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = """id string, label string, type string, kind string, layer string, owner string, source string, status string,
created_at string, last_active string, session_count int, facts array<struct<fact:string,date:string,session:string,source:string>>,
files array<string>, chunk_ids array<string>, attributes map<string,string>, stale boolean, stale_since string, indexed_at string"""
EDGE = "source string, target string, relation string, weight double, created_at string, last_active string, layer string, source_type string, edge_type string"


def migrated(nodes: DataFrame) -> DataFrame:
    """Defaults for what older files lack; a row without an id empties the table, as on the reader's side one bad entry does."""
    text = "array<string>"
    return nodes.select(
        "id", "label", "type",
        F.coalesce("kind", F.lit("entity")).alias("kind"),
        F.coalesce("layer", F.lit("PERSONAL")).alias("layer"),
        F.coalesce("owner", F.lit("")).alias("owner"),
        "source", "status", "created_at", "last_active", "session_count", "facts",
        F.coalesce("files", F.array().cast(text)).alias("files"),
        F.coalesce("chunk_ids", F.array().cast(text)).alias("chunk_ids"),
        "attributes",
        F.coalesce("stale", F.lit(False)).alias("stale"),
        "stale_since", "indexed_at",
    )


def load(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    read = lambda schema, path: spark.read.schema(schema).option("multiLine", True).json(path)
    return migrated(read(NODE, nodes_path).filter("id is not null")), read(EDGE, edges_path)


def save(nodes: DataFrame, edges: DataFrame, folder: str, version: int) -> str:
    """A snapshot folder of its own for each version: readers never see half a graph."""
    at = f"{folder}/v{version:08d}"
    nodes.write.parquet(f"{at}/nodes")
    edges.write.parquet(f"{at}/edges")
    return at


def files(spark: SparkSession, root: str, suffixes: list[str], excluded: list[str]) -> DataFrame:
    """path, content of files below root with one of the suffixes (case counts) and no excluded folder in their path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    return f.filter(ends & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded or [""])))).select("path", "content")


def texts(files_: DataFrame) -> DataFrame:
    """path, text with single line feeds, content_hash, total_lines."""
    t = files_.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("text"))
    return t.select("path", "text", F.sha2("text", 256).alias("content_hash"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("total_lines"))
