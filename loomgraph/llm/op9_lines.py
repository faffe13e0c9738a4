"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased.
Keys of at least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all
their lines except in the largest doc_id that holds them.

The ledger of keys is a set of sorted runs (key hash, number of documents, largest doc_id), as in
a log-structured merge tree, no key in two runs.  Documents arrive in batches: each batch's keys are anti-joined with
all runs; keys not seen before open a new run, and the others go into a run of increments.  When ``fanout``
runs of a level have gathered they become one of the next level.  All runs have the same sorted buckets of key
hashes: a batch is shuffled into them, and anti-joins, compaction (a full merge join) and the final sum of keys and
increments need no further shuffle.

Lines that very many documents share: keys in a thousandth or more of all (key, document) pairs, which are at most 1,000, are
broadcast; the others meet the pairs in a join by key.

Defined cases: a null or empty text is one empty line and stays as it is; rows whose doc_id is null
are neither counted nor changed; rows that repeat a doc_id count as one document, and decisions
hold for each of them; ties cannot arise, as doc_ids are compared; an empty table gives an empty
result; other columns pass through.  Key hashes have 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

STRIP = b" \t\n\x0b\f\r"
KEYS = "h binary, doc long, batch int"


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text as bytes, and for each its key's hash, None where it is too short."""
    import hashlib

    raw = (text or "").encode("utf-8", "surrogatepass")
    out: list[bytes | None] = []
    for k in raw.lower().split(b"\n"):  # bytes.lower() changes A-Z only
        k = k.strip(STRIP)
        long = len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(hashlib.md5(k).digest() if long else None)
    return raw.split(b"\n"), out


class LineLedger:
    """Levelled sorted runs (h, n_docs, max_doc) of disjoint keys, and levelled runs of increments to them."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = 2):
        self.scratch, self.buckets, self.fanout = scratch, buckets, fanout
        self.runs: list[list[DataFrame]] = [[]]
        self.increments: list[list[DataFrame]] = [[]]

    def kept(self, df: DataFrame) -> DataFrame:
        return self.scratch.save_sorted(df, "h", self.buckets, dealt=True)

    def add(self, keys: DataFrame) -> None:
        """keys(h, doc): distinct pairs of documents that no earlier batch had."""
        own = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("max_doc"))
        own = self.scratch.save_sorted(own, "h", self.buckets)
        runs = [r for level in self.runs for r in level]
        fresh = own
        for r in runs:
            fresh = fresh.join(r.select("h"), "h", "left_anti")
        if runs:
            fresh = self.kept(fresh)
            self.increments[0].append(self.kept(own.join(fresh.select("h"), "h", "left_anti")))
            self.scratch.drop(own)
        self.runs[0].append(fresh)
        self.compact(self.runs)
        self.compact(self.increments)

    def compact(self, levels: list[list[DataFrame]]) -> None:
        k = 0
        while k < len(levels):
            if len(levels[k]) >= self.fanout:
                if k + 1 == len(levels):
                    levels.append([])
                old, levels[k] = levels[k], []
                levels[k + 1].append(self.merged(old))
            k += 1

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run in place of several."""
        if len(runs) == 1:
            return runs[0]
        out = runs[0]
        for r in runs[1:]:
            more = r.select("h", F.col("n_docs").alias("n"), F.col("max_doc").alias("top"))
            out = out.join(more, "h", "full").select("h", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "top").alias("max_doc"))
        out = self.kept(out)
        self.scratch.drop(*runs)
        return out

    def total(self) -> DataFrame:
        """h, n_docs, max_doc: one row per key, as each stands in one run."""
        self.runs, self.increments = ([[self.merged([r for level in levels for r in level])]] if any(levels) else levels for levels in (self.runs, self.increments))
        keys = self.runs[0][0]
        if not self.increments[0]:
            return keys
        more = self.increments[0][0].select("h", F.col("n_docs").alias("n"), F.col("max_doc").alias("top"))
        return keys.join(more, "h", "left").select("h", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "top").alias("max_doc"))


def dedup_lines(docs: DataFrame, scratch: Scratch, *, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with text replaced by the kept lines, and a struct __lg_lines(n_lines, n_dropped)."""

    def keys_of(parts):
        import pyarrow as pa

        for b in parts:
            hs, ds = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for h in {x for x in line_keys(text.as_py(), min_chars)[1] if x}:
                    hs.append(h)
                    ds.append(doc)
            import numpy as np

            d = np.array(ds, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(d), pa.array((d * 0x9E3779B1 >> 16) % batches, pa.int32())], ["h", "doc", "batch"])

    src = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    keys = scratch.save(src.mapInArrow(keys_of, KEYS), partition_by="batch")
    ledger = LineLedger(scratch, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), fanout)
    for k in range(batches):
        ledger.add(keys.filter(F.col("batch") == k).select("h", "doc").distinct())
    gone = scratch.save(ledger.total().filter(F.col("n_docs") >= min_docs).select("h", "max_doc", "n_docs"))
    pairs = gone.agg(F.sum("n_docs")).first()[0] or 0
    often = F.col("n_docs") * 1000 >= pairs  # at most 1,000 keys
    heavy, light = F.broadcast(gone.filter(often).select("h", "max_doc")), gone.filter(~often).select("h", "max_doc")
    held = keys.select("h", "doc").join(heavy, "h", "left")
    rest = held.filter("max_doc is null").select("h", "doc").join(light, "h")
    lose = held.filter("max_doc is not null").select("h", "doc", "max_doc").unionByName(rest.select("h", "doc", "max_doc"))
    lose = lose.filter("doc < max_doc").groupBy("doc").agg(F.collect_set("h").alias("__lg_lose"))
    own = docs.columns
    joined = docs.withColumn("__lg_id", F.col("doc_id").cast("long")).join(lose.withColumnRenamed("doc", "__lg_id"), "__lg_id", "left").select(*[F.col(f"`{c}`") for c in own], "__lg_lose")
    stats = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("__lg_lines", stats)])
    at = own.index("text")

    def keep(parts):
        import pyarrow as pa

        kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64())])
        for b in parts:
            texts, counts = [], []
            for text, lose in zip(b.column(at), b.column(len(own)), strict=True):
                text, lose = text.as_py(), lose.as_py()
                if not lose:
                    texts.append(text)
                    counts.append({"n_lines": (text or "").count("\n") + 1, "n_dropped": 0})
                    continue
                lose = set(lose)
                lines, hashes = line_keys(text, min_chars)
                kept = [x for x, h in zip(lines, hashes, strict=True) if h not in lose]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                counts.append({"n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
            cols = [b.column(i) for i in range(len(own))]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, kind)], [*own, "__lg_lines"])

    return joined.mapInArrow(keep, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, Scratch(spark))
    return out.select("doc_id", "__lg_lines.n_lines", "__lg_lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, ls[pos] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)),
k AS (SELECT doc_id, pos, line,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id < g.max_doc AS dropped FROM k LEFT JOIN g ON k.key = g.key AND length(k.key) >= 20)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
