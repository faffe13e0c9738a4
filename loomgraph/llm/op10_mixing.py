"""Mixing sources to target weights by Poisson replication.

Source s holds size(s) bytes of text and shall make up weight(s) of the mix, which is ``budget``
times as large as the input.  Its mean repetition rate is
``weight(s) / sum of weights * budget * total / size(s)``.  Each document gets a uniform number
from a hash of (seed, doc_id), which is put through the inverse of the Poisson distribution with
that mean; the document is repeated so many times, and all copies are ordered globally by another
hash, a shuffle that comes out the same each time.  As that hash is uniform in [0, 1), its range is cut into equal
partitions without sampling, so that counts are drawn once.

Default weights: the square root of each source's size, as in temperature sampling.

Defined cases: a null text has size 0; a null source is a source of its own; a source with no
bytes gets rate 1; rows that repeat a doc_id share its count, each row being repeated; rows whose doc_id
is null are hashed as the text 'null'; sources missing from given weights get none; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEED = 20
FEW = 10_000  # sources: up to so many, the table of rates is broadcast; beyond, it is joined by shuffle
PART_BYTES = 128 << 20  # of text in a partition of the result
TERMS = 64  # inverse Poisson: counts beyond it have no chance at rates up to 16; greater rates are split


def uniform(seed: int, what: str, *extra: Column) -> Column:
    """In [0, 1), with 52 bits of md5."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), *extra)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def inverse_poisson(u: Column, rate: Column) -> Column:
    """The least n whose distribution function exceeds u, for rates up to 16."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))

    def step(s: Column, j: Column) -> Column:
        p = s["p"] * rate / j.cast("double")
        return F.when(s["c"] > u, s).otherwise(F.struct(p.alias("p"), (s["c"] + p).alias("c"), j.cast("int").alias("n")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["n"])


def repetitions(rate: Column, seed: int) -> Column:
    """Poisson count of mean ``rate``: whole parts of 8 and a rest are drawn apart and added."""
    part = F.lit(8.0)
    n = F.floor(rate / part).cast("int")
    rest = inverse_poisson(uniform(seed, "n"), rate - n * part)
    whole = F.when(
        n > 0,
        F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, k: a + inverse_poisson(uniform(seed, "w", k.cast("string")), part)),
    ).otherwise(F.lit(0))
    return rest + whole


def source_rates(docs: DataFrame, weights: dict[str, float] | None, budget: float) -> tuple[DataFrame, float]:
    """__lg_source, __lg_rate: one row for each source; and the bytes of all texts."""
    key = F.coalesce(F.col("source").cast("string"), F.lit("\0null"))
    sizes = docs.groupBy(key.alias("__lg_source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        w = F.sqrt("size")
    else:
        w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("__lg_source")), F.lit(0.0)) if weights else F.lit(0.0)
    sized = sizes.withColumn("w", w)
    sum_w, total = sized.agg(F.sum("w"), F.sum("size")).first()
    rate = F.when(F.col("size") > 0, F.col("w") / F.lit(sum_w or 1.0) * F.lit(float(budget)) * F.lit(total or 0.0) / F.col("size")).otherwise(F.lit(1.0))
    return sized.select("__lg_source", F.coalesce(rate, F.lit(0.0)).alias("__lg_rate")), total or 0.0


def mix_sources(docs: DataFrame, *, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs, each row repeated by its Poisson count and all shuffled; adds __lg_copy, __lg_rate, __lg_order."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rates, total = source_rates(docs, weights, budget)
    if len(rates.take(FEW + 1)) <= FEW:
        rates = F.broadcast(rates)
    keyed = docs.withColumn("__lg_source", F.coalesce(F.col("source").cast("string"), F.lit("\0null")))
    times = keyed.join(rates, "__lg_source").withColumn("__lg_n", repetitions(F.col("__lg_rate"), seed))
    copies = times.filter("__lg_n > 0").select(*own, "__lg_rate", F.explode(F.sequence(F.lit(1), F.col("__lg_n"))).alias("__lg_copy"))
    order = uniform(seed, "order", F.col("__lg_copy").cast("string"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * budget / PART_BYTES) + 1)
    dealt = copies.withColumn("__lg_order", order).repartitionById(parts, F.floor(F.col("__lg_order") * parts).cast("int"))
    return dealt.sortWithinPartitions("__lg_order", "doc_id", "__lg_copy")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.col("__lg_copy").alias("copy"), F.round("__lg_rate", 9).alias("rate"), F.col("__lg_order").alias("position"))


SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(size)) AS sw, sum(size) AS total FROM sizes),
r AS (SELECT source, CASE WHEN size > 0 THEN sqrt(size) / sw * 1.0 * total / size ELSE 1.0 END AS rate FROM sizes, t),
u AS (SELECT doc_id, rate,
  CAST(('0x' || substr(md5('{SEED}|n|' || doc_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN r ON r.source IS NOT DISTINCT FROM d.source),
p AS (SELECT doc_id, rate, u, exp(-rate) AS pr, exp(-rate) AS c, 0 AS n FROM u
  UNION ALL SELECT doc_id, rate, u, pr * rate / (n + 1), c + pr * rate / (n + 1), n + 1 FROM p WHERE c <= u AND n < {TERMS}),
n AS (SELECT doc_id, max(n) AS n FROM p GROUP BY doc_id),
x AS (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM n)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(x.copy AS INTEGER) AS copy, round(r.rate, 9) AS rate,
  CAST(('0x' || substr(md5('{SEED}|order|' || d.doc_id || '|' || x.copy), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS position
FROM x JOIN documents d USING (doc_id) JOIN r ON r.source IS NOT DISTINCT FROM d.source
"""
