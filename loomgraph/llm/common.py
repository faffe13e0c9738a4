"""Helpers shared by the operators: scratch tables, hashes over Arrow buffers, ranks, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the folder that ``spark.checkpoint.dir`` names, shared by driver and executors.

    Writing a table cuts the lineage: a lost executor costs only the stage that runs just then.
    Where the setting is absent, a temporary folder takes its place if the master is local; elsewhere that is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lg-scratch-")
        self.base = f"{base.rstrip('/')}/lg-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Writes df and returns the frame that reads it back."""
        path = f"{self.base}/{self.made}"
        self.made += 1
        w = df.write.option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lg_path = path
        return out

    def save_sorted(self, df: DataFrame, key: str, buckets: int, dealt: bool = False) -> DataFrame:
        """Writes df in sorted buckets of key and returns the frame that reads them: joins by key need no shuffle.

        ``dealt``: df comes from joins of such tables, and each of its partitions holds one bucket already.
        """
        path, name = f"{self.base}/{self.made}", f"lg_{uuid.uuid4().hex}"
        self.made += 1
        (df if dealt else df.repartition(buckets, key)).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        out = self.spark.table(name)
        out._lg_path, out._lg_table = path, name
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables made by save() or save_sorted(); nothing may read them afterwards."""
        for df in frames:
            if hasattr(df, "_lg_table"):
                self.spark.sql(f"DROP TABLE {df._lg_table}")
            p = self.spark._jvm.org.apache.hadoop.fs.Path(df._lg_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold rule of the learned operators."""
    return F.crc32(F.col(col).cast("string")) % F.lit(n)


# ---------------------------------------------------------------- hashing over Arrow buffers


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_range(n: int, seed: int) -> np.ndarray:
    """n reproducible pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of an Arrow string array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks == 1 else pa.concat_arrays(arr.chunks)
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Runs (i, j) of consecutive texts of about ``most`` bytes in all; one long text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True
_BYTE = hash_range(256, 0x5EED)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs of ASCII letters, digits and non-ASCII bytes within a text.

    Returns their 64-bit hashes, the text each belongs to, their starts and their lengths.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none.astype(np.uint64), none, none, none
    w = _WORD[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] = w[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    at = np.flatnonzero(w)
    begin = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begin, len(at)))
    rank = np.arange(len(at)) - np.repeat(begin, lengths)
    odd = hash_range(int(lengths.max()), 0xA11CE) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[data[at]] * odd[rank], begin)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return mix64(h + lengths.astype(np.uint64)), doc, starts, lengths


def shingle_hashes(words: np.ndarray, doc: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, and the text each belongs to.

    A text with fewer words, but at least one, has one shingle: all its words.
    """
    odd = hash_range(size, 0xBEE) | np.uint64(1)
    n = len(words)
    if n == 0:
        return words, doc
    with np.errstate(over="ignore"):
        m = max(0, n - size + 1)
        h = np.zeros(m, np.uint64)
        for k in range(size):
            h += words[k : k + m] * odd[k]
        ok = doc[:m] == doc[size - 1 : size - 1 + m] if m else np.zeros(0, bool)
        h, d = h[ok], doc[:m][ok]
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        count = np.diff(np.append(begin, n))
        few = count < size
        if few.any():
            rank = np.arange(n) - np.repeat(begin, count)
            part = np.add.reduceat(words * odd[np.minimum(rank, size - 1)], begin)[few]
            h = np.append(h, part + count[few].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            d = np.append(d, doc[begin[few]])
    return mix64(h), d


# ---------------------------------------------------------------- ranks without one large window


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, n_rows: int, per_task: int = 200_000) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 within each group, with no task ranking a whole group.

    Rows are dealt by a hash of ``order`` into buckets, ranked within (group, bucket), and
    shifted by the sizes of the earlier buckets, a table of bounded size that is joined back.
    """
    buckets = max(64, -(-n_rows // per_task))
    b = df.withColumn("__lg_b", F.pmod(F.xxhash64(F.lit(11), *order), F.lit(buckets)).cast("int"))
    sizes = b.groupBy(*group, "__lg_b").agg(F.count(F.lit(1)).alias("__lg_n"))
    before = W.partitionBy(*group).orderBy("__lg_b").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*group, "__lg_b", F.coalesce(F.sum("__lg_n").over(before), F.lit(0)).alias("__lg_shift"))
    within = W.partitionBy(*group, "__lg_b").orderBy(*order)
    out = b.withColumn("__lg_rank", F.row_number().over(within) - 1).join(shift, [*group, "__lg_b"])
    return out.withColumn(name, (F.col("__lg_rank") + F.col("__lg_shift")).cast("long")).drop("__lg_b", "__lg_rank", "__lg_shift")


# ---------------------------------------------------------------- connected components


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each end of edges(u, v): columns id, component.

    Alternating large-star and small-star steps: each node's neighbours move to the smallest
    id around it, first the larger, then the smaller ones, until nothing changes.  The minimum
    is an aggregate with partial sums and the hand-over an equi-join, so that a hub with very
    many edges is never held in one task.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            new = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            low = down.groupBy("u").agg(F.min("v").alias("m"))
            new = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return new.filter("u <> v").distinct()

    e, last = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()), None
    while True:  # a number of rounds in proportion to the logarithm of the longest chain
        new = scratch.save(star(star(e, True), False))
        scratch.drop(e)
        e = new
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
