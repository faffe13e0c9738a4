"""Exact top-k inner-product search by distributed histogram selection.

Components x become floor(1024 * x) as integers; the score of two vectors is their integer inner
product.  Queries go in blocks of at most ``block`` rows, so that what a pass sends to the executors
is bounded; each block is scored against all rows.

For a block, the k-th largest score of every query is located by narrowing a histogram: in each pass
every batch of rows counts its scores in ``bins`` equal bins of the query's present interval, the
counts are added up over all batches, and the bin that holds the k-th value becomes the next interval,
until it holds one integer.  A batch leaves out its counts below its own k-th score, which cannot
reach the global one.  A last pass keeps scores above the k-th value, and of those equal to it each
batch's k smallest ids; ties go to smaller ids.

Scores are exact: products whose sums stay below 2^53 are formed in float64, below 2^63 in int64, and the rows with larger
components in integers of any size.  A score that does not fit in a long is an error, as in SQL.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do rows with a null id; an empty vector has score 0 with any other; rows with a query's own id are not its candidates; of rows that repeat a
query's id, the one with the least vector asks, while each such row is a candidate of other queries;
vectors of different length are filled with zeros; with fewer than k candidates all are returned; no
vectors give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table
from .vectors import matrix, usable

TOP = np.uint64(1 << 63)


def whole(m: np.ndarray) -> np.ndarray:
    """floor(1024 x) as float64, which holds it exactly."""
    return np.floor(1024.0 * m)


def scores(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Exact integer inner products, rows by queries, and which of them a long can't hold."""
    d = max(rows.shape[1], queries.shape[1])
    rows, queries = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x for x in (rows, queries))
    tall = np.abs(rows).max(axis=1, initial=0) * np.abs(queries).max(initial=0) * max(d, 1)
    if tall.max(initial=0) < 2**53:
        return (rows @ queries.T).astype(np.int64), None
    small = (tall < 2.0**62) & (np.abs(rows).max(axis=1, initial=0) < 2.0**62)
    if np.abs(queries).max(initial=0) >= 2.0**62:
        small[:] = False
    out = np.zeros((len(rows), len(queries)), np.int64)
    if small.any():
        out[small] = rows[small].astype(np.int64) @ queries.astype(np.int64).T
    over = np.zeros(out.shape, bool)
    exact = np.array([[int(x) for x in q] for q in queries], object).reshape(len(queries), d)
    for r in np.flatnonzero(~small):
        s = exact @ np.array([int(x) for x in rows[r]], object)
        over[r] = [not -(2**63) <= x < 2**63 for x in s]
        out[r] = np.where(over[r], 0, s).astype(np.int64)
    return out, over


def ordered(s: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers of the same order."""
    return s.astype(np.int64).view(np.uint64) ^ TOP


def batches(parts, query_ids: np.ndarray, queries: np.ndarray, step: int = 512):
    """For each batch of rows and some queries: row ids, the queries' places, scores, own-row mask."""
    for b in parts:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(ids):
            continue
        rows = whole(matrix(b.column(1)))
        for i in range(0, len(query_ids), step):
            s, over = scores(rows, queries[i : i + step])
            own = ids[:, None] == query_ids[None, i : i + step]
            if over is not None and (over & ~own).any():
                raise OverflowError("a score does not fit in a long")
            yield ids, np.arange(i, min(i + step, len(query_ids))), s, own


def locate(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, reach: float, k: int, bins: int) -> np.ndarray:
    """The k-th largest score of each query, as ``ordered``; 0, the least of all, if there are fewer."""
    spark = rows.sparkSession
    q = len(ids)
    bound = [min(int(x * reach * (1 + 1e-9)) + 2, 2**63 - 1) for x in np.abs(queries).sum(1).tolist()]
    low = np.array([2**63 - x for x in bound], np.uint64)
    width = np.array([-(-(2 * x) // bins) for x in bound], np.uint64)
    done = np.zeros(q, bool)
    while not done.all():
        sent = spark.sparkContext.broadcast((ids, queries, low, width, done))

        def count(parts, sent=sent):
            import pyarrow as pa

            ids, queries, low, width, done = sent.value
            for _, at, s, own in batches(parts, ids, queries):
                live = ~done[at]
                if not live.any():
                    continue
                at, s, own = at[live], ordered(s[:, live]), own[:, live]
                b = np.minimum((s - low[at]) // width[at], np.uint64(bins)).astype(np.int64)
                b[s < low[at]] = -1
                b[own] = -2
                if len(b) > k:
                    floor = np.maximum(np.partition(b, len(b) - k, axis=0)[len(b) - k], -1)
                else:
                    floor = np.full(len(at), -1)
                r, c = np.nonzero(b >= floor)
                key, n = np.unique(at[c] * (bins + 2) + b[r, c] + 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // (bins + 2)), pa.array(key % (bins + 2) - 1), pa.array(n.astype(np.int64))], ["q", "b", "n"])

        hist = rows.mapInArrow(count, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        over = W.partitionBy("q").orderBy(F.desc("b"))
        cum = hist.withColumn("upto", F.sum("n").over(over.rowsBetween(W.unboundedPreceding, 0)))
        hit = cum.filter(F.col("upto") >= k).groupBy("q").agg(F.max("b").alias("b"))
        got = {r["q"]: r["b"] for r in hit.collect()}  # one row for each query of the block
        for i in np.flatnonzero(~done):
            if i not in got:  # fewer than k candidates
                low[i], done[i] = 0, True
                continue
            low[i] += np.uint64(got[i]) * width[i]
            if width[i] == 1:
                done[i] = True
            else:
                width[i] = -(-int(width[i]) // bins)
        sent.unpersist()
    return low


def search(vectors: DataFrame, is_query: Column, scratch: Scratch, *, k: int = 10, block: int = 8192, bins: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query row of vectors(vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable(empty=True) & F.col("vec_id").isNotNull())
    asking = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asking = scratch.save(asking.withColumn("blk", F.lit(0)))
    n = asking.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    many = -(-n // (block * 3 // 4)) if n > block else 1
    if many > 1:
        asking = asking.withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.lit(many)))
    big = rows.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()[0]
    reach = float(big or 0) * 1024 + 1
    found = []
    for i in range(many):
        own = asking.filter(F.col("blk") == i).select("vec_id", "embedding").toArrow()  # at most about ``block`` rows
        for j in range(0, own.num_rows, block):
            part = own.slice(j, block)
            ids, queries = part.column(0).to_numpy().astype(np.int64), whole(matrix(part.column(1)))
            kth = locate(rows, ids, queries, reach, k, bins)
            sent = vectors.sparkSession.sparkContext.broadcast((ids, queries, kth))

            def keep(parts, sent=sent):
                import pyarrow as pa

                ids, queries, kth = sent.value
                for rid, at, s, own in batches(parts, ids, queries):
                    order = np.argsort(rid, kind="stable")
                    s, own, rid = s[order], own[order], rid[order]
                    above = (ordered(s) > kth[at]) & ~own
                    tie = (ordered(s) == kth[at]) & ~own
                    tie &= np.cumsum(tie, axis=0) <= k  # the smallest ids
                    r, c = np.nonzero(above | tie)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[c]]), pa.array(rid[r]), pa.array(s[r, c])], ["query_id", "vec_id", "score"])

            best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            out = rows.mapInArrow(keep, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            out = scratch.save(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
            found.append(out)
            sent.unpersist()
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
