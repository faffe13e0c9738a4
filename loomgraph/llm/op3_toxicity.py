"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and their prefixes of 4, 5 and 6 bytes, lower-cased, each hashed to one of 2^20 buckets; a
text is the set of its buckets.  The machine scores w0 + sum of w_i + sum over pairs of <v_i, v_j>, so that
two harmless terms can be toxic together, and is trained by Adam on the logistic loss.

Learning uses a bounded sample of labelled rows: at most about ``most_rows`` (default 12,000), taken in the
order of a hash.  Every bucket of the sample has a weight and factors; they are fitted in two steps.  First those that tell most are trained
together: up to ``terms`` buckets (default 4,096) in at least 3 rows whose frequencies differ most between the classes, by
4 standard errors or more; and up to ``terms`` more buckets of the pairs whose rows are toxic, or clean, beyond what a machine over the
former terms foresees from the other half of the sample.  Pairs are counted exactly among the ``screened`` buckets (default 8,192) in most rows; one counts if
chance would not give its deviance once among so many pairs.  Then all other buckets, alone and in pairs with those, are fitted to
what the first step leaves, by descent with a ridge and a step for each bucket that bounds what a document's terms can do together.

Defined cases: a null or empty text has no terms and gets the machine's constant; without labelled rows, or with
one class only, all texts get the base rate (0 without rows); null labels are not learned; of rows that repeat a
doc_id in the labels the largest label counts; repeated texts get equal scores; texts of any length are
scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, crc_mod, mix64, slices, table, word_hashes

BUCKETS = 20  # bits
PREFIXES = (4, 5, 6)


def term_pieces(texts, most: int = 1 << 18):
    """For pieces of an Arrow string array: first text, number of texts, and (text, bucket) of all terms.

    A term may come more than once; texts count from the start of their piece.
    """
    import pyarrow.compute as pc

    data, off = buffers(pc.utf8_lower(texts))
    for i, j in slices(off, most):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        h, doc, start, length = word_hashes(part, o)
        docs, terms = [doc], [h]
        for p in PREFIXES:
            long = np.flatnonzero(length > p)
            v = np.zeros(len(long), np.uint64)
            for k in range(p):
                v = (v << np.uint64(8)) | part[start[long] + k]
            docs.append(doc[long])
            terms.append(mix64(v + np.uint64(p << 56)))
        yield i, j - i, np.concatenate(docs), (np.concatenate(terms) >> np.uint64(64 - BUCKETS)).astype(np.int64)


def distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc << BUCKETS | term)
    return key >> BUCKETS, key & ((1 << BUCKETS) - 1)


@dataclass
class Machine:
    chosen: np.ndarray  # bucket -> place or -1
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, n: int, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """doc sorted; each (doc, place) once."""
        s = np.zeros((n, self.v.shape[1] + 2))
        vec = self.v[place]
        rows = np.column_stack([vec, (vec * vec).sum(1), self.w[place]])
        if len(doc):
            cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            s[doc[cut]] = np.add.reduceat(rows, cut)
        k = self.v.shape[1]
        return self.w0 + s[:, k + 1] + 0.5 * ((s[:, :k] ** 2).sum(1) - s[:, k])

    def score(self, texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, n, doc, term in term_pieces(texts):
            place = self.chosen[term]
            hit = place >= 0
            out[i : i + n] = self.logits(n, *distinct(doc[hit], place[hit]))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


BLOCK = 1 << 17  # pairs of a row and a term at once
PIECE = 1 << 20  # bytes of a machine on its way to the driver


def run_starts(doc: np.ndarray, n: int) -> np.ndarray:
    """Where the pairs of each row begin, and their end; doc is sorted."""
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros(n + 1, np.int64)
    out[doc[cut].astype(np.int64) + 1] = np.diff(np.append(cut, len(doc)))
    return out.cumsum()


def run_sums(start: np.ndarray, at: np.ndarray, rows, width: int, block: int) -> np.ndarray:
    """For each k the sum of rows(at[start[k] : start[k + 1]]); blocks of whole runs bound the memory."""
    out = np.zeros((len(start) - 1, width))
    full = np.flatnonzero(start[1:] > start[:-1])
    begin, end, a = start[full], start[full + 1], 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + block, side="right")))
        out[full[a:b]] = np.add.reduceat(rows(at[begin[a] : end[b - 1]]), begin[a:b] - begin[a])
        a = b
    return out


def turned(doc: np.ndarray, place: np.ndarray, size: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The pairs sorted by place: where those of each place begin, and their docs.  A counting sort, a block at a time."""
    start = np.zeros(size + 1, np.int64)
    for i in range(0, len(place), block):
        start[1:] += np.bincount(place[i : i + block], minlength=size)
    np.cumsum(start, out=start)
    free, out = start[:-1].copy(), np.empty_like(doc)
    for i in range(0, len(place), block):
        part = place[i : i + block]
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        n = np.diff(np.append(cut, len(part)))
        out[np.repeat(free[part[cut]] - cut, n) + np.arange(len(part))] = doc[i : i + block][order]
        free[part[cut]] += n
    return start, out


def gradients(m: Machine, y: np.ndarray, start: np.ndarray, place: np.ndarray, by_place: tuple[np.ndarray, np.ndarray], block: int):
    """Sums over the rows of the logistic loss's gradient: for w0, each w and v (one column each); and the largest squared length of a row's sum of factors.

    place[start[i] : start[i + 1]] are the places of row i; ``by_place`` holds the same pairs sorted by place.
    """
    k = m.v.shape[1]
    square = np.einsum("ij,ij->i", m.v, m.v)
    sums = run_sums(start, place, lambda at: np.column_stack([m.v[at], square[at], m.w[at]]), k + 2, block)
    length = (sums[:, :k] ** 2).sum(1)
    g = 1 / (1 + np.exp(-np.clip(m.w0 + sums[:, k + 1] + 0.5 * (length - sums[:, k]), -30, 30))) - y
    back = np.column_stack([g, g[:, None] * sums[:, :k]])
    out = run_sums(*by_place, lambda at: back[at], k + 1, block)
    for i in range(0, len(out), block):
        out[i : i + block, 1:] -= out[i : i + block, :1] * m.v[i : i + block]
    return float(g.sum()), out, float(length.max(initial=0))


def train(chosen: np.ndarray, size: int, y: np.ndarray, doc: np.ndarray, place: np.ndarray, *, factors: int = 8, rounds: int = 100, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    """Full-batch Adam; (doc, place) sorted by doc."""
    rng = np.random.default_rng(7)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    m = Machine(chosen, float(np.log(base / (1 - base))), np.zeros(size), rng.normal(0, 0.01, (size, factors)))
    first = {"m": np.zeros((size, factors + 1)), "s": np.zeros((size, factors + 1))}
    b1 = b2 = 0.0
    start, by_place = run_starts(doc, len(y)), turned(doc, place, size)
    for t in range(1, rounds + 1):
        all_, grad, _ = gradients(m, y, start, place, by_place, BLOCK)
        grad = grad / len(y) + decay * np.column_stack([m.w, m.v])
        first["m"] = 0.9 * first["m"] + 0.1 * grad
        first["s"] = 0.99 * first["s"] + 0.01 * grad**2
        step = rate * (first["m"] / (1 - 0.9**t)) / (np.sqrt(first["s"] / (1 - 0.99**t)) + 1e-8)
        m.w -= step[:, 0]
        m.v -= step[:, 1:]
        b1 = 0.9 * b1 + 0.1 * all_ / len(y)
        b2 = 0.99 * b2 + 0.01 * (all_ / len(y)) ** 2
        m.w0 -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    return m


def foreseen(y: np.ndarray, doc: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Each row's probability by a machine that learned the other half of the rows; never nearer to 0 or 1 than an eighth of the base rates."""
    out, half = np.zeros(len(y)), np.arange(len(y)) % 2
    for k in (0, 1):
        own, other = half[doc] == k, half[doc] != k
        m = train(np.zeros(0), max(1, size), y[half != k], doc[other] // 2, place[other])
        out[half == k] = m.logits(int((half == k).sum()), doc[own] // 2, place[own])
    return np.clip(1 / (1 + np.exp(-np.clip(out, -30, 30))), y.mean() / 8, 1 - (1 - y.mean()) / 8)


def deviance(bad, good, due):
    return 2 * (bad * np.log(np.maximum(bad, 1) / np.maximum(due, 1e-9)) + good * np.log(np.maximum(good, 1) / np.maximum(bad + good - due, 1e-9)))


def telling_pairs(y: np.ndarray, p: np.ndarray, by_place: tuple[np.ndarray, np.ndarray], among: np.ndarray, block: int = 512) -> np.ndarray:
    """Pairs (i, j) of the places ``among``, the most telling first: rows with both are toxic more, or less, often than ``p`` foresees.

    Counts of all pairs come from products of blocks of the 0/1 matrix, so that a block's size bounds the memory.  Rows
    of one label and one p (most have the least or the largest) are counted only; a second product sums p over the others.  The
    binomial deviance from the sum of p bounds the probability of chance by exp(-deviance / 2).  A pair that is taken
    explains its rows: one that rides on the same rows is not taken again.
    """
    least = 2 * np.log(max(2, len(among) * (len(among) - 1)))  # either side of each pair
    start, docs = by_place
    row = np.empty(len(y), np.int32)
    kind = 3 * (y > 0) + 1 + (p >= p.max()) - (p <= p.min())
    by = np.argsort(kind, kind="stable")
    row[by] = np.arange(len(y))  # clean rows, then toxic ones; in each those of the least p, others, those of the largest
    weight = p[by, None].astype(np.float32)
    ends = np.searchsorted(kind[by], np.arange(7))

    def matrix(i, room):
        own = among[i : i + block]
        x = room[:, : len(own)]
        x[:] = 0
        for k, place in enumerate(own):
            x[of(place), k] = 1
        return x

    def of(place):
        return row[docs[start[place] : start[place + 1]]]

    found, worth = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    rooms = np.empty((2, len(y), min(block, len(among))), np.float32)
    for i in range(0, len(among), block):
        a = matrix(i, rooms[0])
        for j in range(i, len(among), block):
            b = a if i == j else matrix(j, rooms[1])
            count, due = np.zeros((2, a.shape[1], b.shape[1])), np.zeros((a.shape[1], b.shape[1]))
            for k in np.flatnonzero(ends[:-1] < ends[1:]).tolist():
                part = slice(ends[k], ends[k + 1])
                c = (a[part].T @ b[part]).astype(np.float64)
                count[k // 3] += c
                due += (a[part] * weight[part]).T @ b[part] if k % 3 == 1 else c * p[by[ends[k]]]
            good, bad = count
            dev = deviance(bad, good, due)
            x, z = np.nonzero(np.triu(dev, 1) > least if i == j else dev > least)
            found.append(np.column_stack([among[x + i], among[z + j]]))
            worth.append(dev[x, z])
    found, worth = np.concatenate(found), np.concatenate(worth)
    y, p, out = y[by], p[by].copy(), []
    for i, j in found[np.lexsort((found[:, 1], found[:, 0], -worth))].tolist():
        r = np.intersect1d(of(i), of(j), assume_unique=True)
        if deviance(bad := y[r].sum(), len(r) - bad, p[r].sum()) > least:
            out.append((i, j))
            p[r] = (bad + y.mean()) / (len(r) + 1)
    return np.array(out, np.int64).reshape(-1, 2)


def settle(m: Machine, rest: np.ndarray, y: np.ndarray, doc: np.ndarray, place: np.ndarray, *, rounds: int = 10, ridge: float = 8.0, block: int = BLOCK) -> None:
    """Fits the weights and factors of the places ``rest`` to what the others leave; (doc, place) sorted by doc."""
    start, by_place = run_starts(doc, len(y)), turned(doc, place, len(m.w))
    many = run_sums(start, place, lambda at: rest[at, None].astype(np.float64), 1, block)
    step = np.where(rest, 1 / (ridge + 0.25 * run_sums(*by_place, lambda at: many[at], 1, block)[:, 0]), 0.0)
    for _ in range(rounds):
        _, grad, top = gradients(m, y, start, place, by_place, block)
        for i in range(0, len(step), block):
            j = slice(i, i + block)
            m.w[j] -= step[j] * (grad[j, 0] + ridge * m.w[j])
            m.v[j] -= (step[j] / (1 + top))[:, None] * (grad[j, 1:] + ridge * m.v[j])


def fit(parts, *, terms: int, screened: int) -> Machine | float:
    """The machine of a sample, from Arrow batches of its labels and buckets; for no rows 0, for rows of one class their rate."""
    toxic, length, bucket = [], [], []
    for b in parts:
        toxic.append(b.column(0).to_numpy())
        length.append(b.column(1).value_lengths().to_numpy(zero_copy_only=False))
        bucket.append(b.column(1).flatten().to_numpy())
    if not sum(map(len, toxic)):
        return 0.0
    toxic, length, bucket = map(np.concatenate, (toxic, length, bucket))
    n1 = float((toxic > 0).sum())
    n0 = len(toxic) - n1
    if n0 == 0 or n1 == 0:
        return n1 / (n0 + n1)
    c, of = np.zeros((2, 1 << BUCKETS), np.int64), np.repeat(toxic > 0, length)
    for i in range(0, len(bucket), BLOCK):
        part, bad = bucket[i : i + BLOCK], of[i : i + BLOCK]
        for k in (0, 1):
            c[k] += np.bincount(part[bad == k], minlength=1 << BUCKETS)
    del of
    seen = np.flatnonzero(c.sum(0))
    c0, c1 = c[:, seen]
    del c
    p = (c0 + c1 + 1) / (n0 + n1 + 2)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    common = c0 + c1 >= 3
    best = np.flatnonzero(common & (z >= 4))
    best = best[np.lexsort((seen[best], -z[best]))][:terms]
    often = np.flatnonzero(common)
    often = often[np.lexsort((seen[often], -(c0 + c1)[often]))][:screened]
    alone, front = len(best), np.append(best, often[~np.isin(often, best)])
    at = np.append(seen[front], np.delete(seen, front))  # all buckets: those that tell alone, the frequent ones, the others
    chosen = np.full(1 << BUCKETS, -1, np.int32)
    chosen[at] = np.arange(len(at))
    frequent = chosen[seen[often]].astype(np.int64)
    rows = np.split(bucket, np.cumsum(length)[:-1])
    del bucket
    # in an order that does not depend on how the rows came; as big-endian bytes places sort like numbers
    rows = sorted((t, np.sort(chosen[r]).astype(">i4").tobytes()) for t, r in zip(toxic.tolist(), rows))
    y = np.array([t > 0 for t, _ in rows], np.float64)
    length = np.array([len(r) // 4 for _, r in rows])
    place = np.frombuffer(b"".join(r for _, r in rows), ">i4").astype(np.int32)
    del rows  # from here the sample's terms are held once, besides the same sorted by term while a step needs that
    doc = np.repeat(np.arange(len(length), dtype=np.min_scalar_type(len(length))), length)
    lone = place < alone
    p = foreseen(y, doc[lone], place[lone], alone)
    del lone
    pairs = telling_pairs(y, p, turned(doc, place, len(at)), frequent)
    _, first = np.unique(pairs, return_index=True)
    extra = pairs.ravel()[np.sort(first)]
    kept = np.append(np.arange(alone), extra[extra >= alone][:terms]).astype(np.int64)
    new = np.full(len(at), -1)
    new[kept] = np.arange(len(kept))
    took = (new >= 0)[place]
    told = train(chosen, max(1, len(kept)), y, doc[took], new[place[took]])
    m = Machine(chosen, told.w0, np.zeros(len(at)), np.zeros((len(at), told.v.shape[1])))
    m.w[kept], m.v[kept] = told.w[: len(kept)], told.v[: len(kept)]
    settle(m, new < 0, y, doc, place)
    return Machine(chosen, m.w0, m.w.astype(np.float32), m.v.astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, *, most_rows: int = 12_000, terms: int = 4096, screened: int = 8192) -> Machine | float:
    """The sample is fitted in one task, as its size does not grow with the tables; the driver gets the machine only."""
    spark = docs.sparkSession
    y = labels.filter(learnable & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__lg_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    coin = F.pmod(F.xxhash64(F.lit(3), "__lg_id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    n = y.count()
    if n == 0:
        return 0.0
    picked = y.filter(coin < min(1.0, most_rows / n))  # at most about most_rows rows, so it may be broadcast
    src = docs.select(F.col("doc_id").alias("__lg_id"), "text").join(F.broadcast(picked), "__lg_id").select("text", "toxic").repartition(spark.sparkContext.defaultParallelism)

    def rows(parts):
        import pyarrow as pa

        for b in parts:
            for i, n, doc, term in term_pieces(b.column(0)):
                doc, term = distinct(doc, term)
                cut = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                buckets = pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, n).cast(pa.int32()), buckets], ["toxic", "buckets"])

    def fitted(parts):
        import pyarrow as pa

        blob = pickle.dumps(fit(parts, terms=terms, screened=screened), 5)
        for k, i in enumerate(range(0, len(blob), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob[i : i + PIECE]], pa.binary())], ["k", "piece"])

    got = src.mapInArrow(rows, "toxic int, buckets array<int>").repartition(1).mapInArrow(fitted, "k int, piece binary").toArrow()
    pieces = dict(zip(got.column("k").to_pylist(), got.column("piece").to_pylist()))
    del got
    return pickle.loads(b"".join(pieces[k] for k in sorted(pieces))) if pieces else 0.0


def score(docs: DataFrame, machine: Machine | float) -> DataFrame:
    """docs with __lg_toxic, the probability."""
    if isinstance(machine, float):
        return docs.withColumn("__lg_toxic", F.lit(machine))
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    own, at = docs.columns, docs.columns.index("text")

    def run(parts):
        import pyarrow as pa

        for b in parts:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(b.column(at)))], [*own, "__lg_toxic"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__lg_toxic", T.DoubleType())]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 5) == 0
    machine = learn(docs, table(spark, sf_dir, "labels"), ~held)
    return score(docs, machine).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("__lg_toxic").alias("score"), (F.col("__lg_toxic") >= 0.5).cast("int").alias("predicted"))
