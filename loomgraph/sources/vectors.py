"""The vector store as a table(chunk_id, owner, label, chunk_index, document, embedding): writes are pure functions of the old table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["chunk_id", "owner", "label", "chunk_index", "document", "embedding"]


def hashed_embedding(text: Column, dims: int = 8) -> Column:
    """A stand-in for an embedding model: the hexadecimal digits of a hash, from 0 to 1."""
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.pmod(F.floor(h / F.pow(F.lit(16.0), i)), F.lit(16)) / 15).cast("float"))


def replaced(store: DataFrame, new: DataFrame) -> DataFrame:
    """What the owners in ``new`` had goes; owners without new rows keep theirs."""
    return store.select(*COLUMNS).join(new.select("owner").distinct(), "owner", "left_anti").select(*COLUMNS).unionByName(new.select(*COLUMNS))


def fact_rows(facts: DataFrame, embed=hashed_embedding) -> DataFrame:
    """Rows for facts(node_id, label, fact, fact_index): blank facts drop out, ids are ``node_f0``, ``node_f1``, ..."""
    doc = F.concat("label", F.lit(": "), "fact")
    f = facts.filter(F.trim("fact") != "")
    return f.select(F.concat("node_id", F.lit("_f"), "fact_index").alias("chunk_id"), F.col("node_id").alias("owner"), "label", F.col("fact_index").cast("int").alias("chunk_index"), doc.alias("document"), embed(doc).alias("embedding"))


def chunk_rows(chunks: DataFrame, embed=hashed_embedding) -> DataFrame:
    """Rows for chunks(path, chunk_index, content): ids are the path with / and . as _, then ``_c`` and the index."""
    stem = F.regexp_replace("path", "[/.]", "_")
    return chunks.select(F.concat(stem, F.lit("_c"), "chunk_index").alias("chunk_id"), F.col("path").alias("owner"), F.col("path").alias("label"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("content").alias("document"), embed(F.col("content")).alias("embedding"))


def removed(store: DataFrame, ids: DataFrame, column: str = "owner") -> DataFrame:
    """Without the rows whose owner (or chunk_id) is among ids(id)."""
    return store.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*COLUMNS)


def stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("owner").alias("owners"))
