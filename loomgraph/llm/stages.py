"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing of sources, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Where a stage changes the text, n_chars follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op3_toxicity, op4_neardup, op6_bpe, op9_lines, op10_mixing
from .common import Scratch, crc_mod, table


def plain(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    machine = op3_toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return plain(op3_toxicity.score(docs, machine).filter("__lg_toxic < 0.5"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in the one with the largest doc_id only."""
    out = op9_lines.dedup_lines(docs, Scratch(spark))
    if "n_chars" in docs.columns:
        changed = F.col("__lg_lines.n_dropped") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return plain(out, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return plain(op4_neardup.keep_one(docs, Scratch(spark)), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global shuffle."""
    return plain(op10_mixing.mix_sources(docs), docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian uint32) of every document, and the digest of what they decode to."""
    out = op6_bpe.encode_texts(docs)
    b = F.col("__lg_bpe")
    return out.select("doc_id", "lang", "source", b["n_tokens"].alias("n_tokens"), b["ids"].alias("token_ids"), F.sha2(b["decoded"].cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

# The first, third and last stage can't be put in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents table, each written as Parquet and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
