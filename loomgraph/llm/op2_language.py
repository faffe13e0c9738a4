"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with one space for each run of anything else.  For every language a
model of ``order`` characters is learned: the highest order from counts, lower ones from continuation
counts, each with its own discount n1 / (n1 + 2 n2), interpolated down to the uniform distribution.  All
languages share one sorted array of n-gram hashes for each order, with a row of log-probabilities
(a value for each language), and one of context hashes with back-off weights; scoring is a binary search
for each character.  The language of the lowest cross-entropy per character wins.

Learning uses a bounded sample: of each language about ``sample_chars`` characters, taken as whole texts
in the order of a hash; a tenth of them only calibrates.  Calibration gives each language's mean and
deviation of its own cross-entropy: texts beyond mean + 6 deviations are not ``accepted`` (an
extra column; the prediction stays), and the posterior's temperature is the mean deviation.

Defined cases: a null text, or one without letters, gets ``und`` and score 0; with nothing to learn from all
texts get that; null languages are not learned; ties go to the first language in order; repeated rows are predicted alike;
texts of any length are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hash_range, mix64, table

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)]))
    return _LETTER[0]


def characters(text: str) -> np.ndarray:
    """Code points of the letters, with single spaces (32) for other runs; empty if there is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letters()[c]
    if not ok.any():
        return c[:0]
    c = np.where(ok, c, 32).astype(np.uint32)
    return c[np.append(True, ok[1:] | ok[:-1])]


def gram_hash(c: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place of c from n - 1 on."""
    odd = hash_range(n, 77 + n) | np.uint64(1)
    m = len(c) - n + 1
    with np.errstate(over="ignore"):
        h = np.zeros(max(m, 0), np.uint64)
        for k in range(n):
            h += (c[k : k + m].astype(np.uint64) + np.uint64(1)) * odd[k]
    return mix64(h)


@dataclass
class Model:
    languages: list[str]
    order: int
    floor: float
    grams: list[np.ndarray] = field(default_factory=list)  # by order: sorted hashes
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    logb: list[np.ndarray] = field(default_factory=list)
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def look(self, n: int, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p(c[at] | n - 1 characters before) for each language."""
        if n == 0:
            return np.full((len(at), len(self.languages)), self.floor, np.float32)
        odd = hash_range(n, 77 + n) | np.uint64(1)
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h += (c[at - (n - 1 - k)].astype(np.uint64) + np.uint64(1)) * odd[k]
        h = mix64(h)
        i = np.minimum(np.searchsorted(self.grams[n], h), len(self.grams[n]) - 1)
        out = self.logp[n][i]
        miss = np.flatnonzero(self.grams[n][i] != h)
        if len(miss):
            low = self.look(n - 1, c, at[miss])
            if n > 1:
                g = context_hash(c, at[miss], n)
                j = np.minimum(np.searchsorted(self.contexts[n], g), len(self.contexts[n]) - 1)
                low = low + np.where((self.contexts[n][j] == g)[:, None], self.logb[n][j], 0)
            else:
                low = low + self.logb[1][0]
            out[miss] = low
        return out

    def entropy(self, text: str, step: int = 1 << 16) -> np.ndarray | None:
        """Nats per character for each language; None without letters."""
        c = characters(text)
        if not len(c):
            return None
        c = np.concatenate([np.full(self.order - 1, 32, np.uint32), c])
        total = np.zeros(len(self.languages))
        for i in range(self.order - 1, len(c), step):
            total += self.look(self.order, c, np.arange(i, min(i + step, len(c)))).sum(axis=0, dtype=np.float64)
        return -total / (len(c) - self.order + 1)


def context_hash(c: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n - 1 characters before each place."""
    odd = hash_range(n, 177 + n) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(n - 1):
            h += (c[at - (n - 1 - k)].astype(np.uint64) + np.uint64(1)) * odd[k]
    return mix64(h)


def fit(languages: list[str], grams: np.ndarray, lang: np.ndarray, count: np.ndarray) -> Model:
    """grams: code points of n-grams of the highest order, a row each, with their language's place and count."""
    order = grams.shape[1]
    size = len(languages)
    alphabet = max(2, len(np.unique(grams[:, -1])))
    model = Model(languages, order, float(-np.log(alphabet + 1)), [np.zeros(0)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0)])
    levels = {order: (grams, lang, count)}
    for n in range(order - 1, 0, -1):  # continuation counts
        g, l, _ = levels[n + 1]
        u, c = np.unique(np.column_stack([l, g[:, 1:]]), axis=0, return_counts=True)
        levels[n] = (u[:, 1:], u[:, 0], c)
    for n in range(1, order + 1):
        g, l, c = levels[n]
        at = np.full(len(g), n - 1) + np.arange(len(g)) * n
        flat = g.astype(np.uint32).ravel()
        h = gram_hash_at(flat, at, n)
        ctx = context_hash(flat, at, n)
        uh, first, inv = np.unique(h, return_index=True, return_inverse=True)
        uc, cinv = np.unique(ctx, return_inverse=True)
        full = np.zeros((len(uh), size))
        np.add.at(full, (inv, l), c)
        mass, kinds = np.zeros((len(uc), size)), np.zeros((len(uc), size))
        np.add.at(mass, (cinv, l), c)
        np.add.at(kinds, (cinv, l), 1)
        n1, n2 = np.array([[(c[l == k] == j).sum() for j in (1, 2)] for k in range(size)]).T
        d = np.clip(np.where(n1 + 2 * n2 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5), 0.1, 0.95)
        back = np.where(mass > 0, d * kinds / np.maximum(mass, 1), 1.0)
        lower = np.exp(model.look(n - 1, flat, at[first])) if n > 1 else np.full((len(uh), size), 1 / (alphabet + 1))
        own = cinv[first]
        p = np.maximum(full - d, 0) / np.maximum(mass[own], 1) + back[own] * lower
        model.grams.append(uh)
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(uc)
        model.logb.append(np.log(back).astype(np.float32))
    return model


def gram_hash_at(c: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    odd = hash_range(n, 77 + n) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h += (c[at - (n - 1 - k)].astype(np.uint64) + np.uint64(1)) * odd[k]
    return mix64(h)


def learn(docs: DataFrame, learnable: Column, *, order: int = 4, sample_chars: int = 2_000_000) -> Model | None:
    spark = docs.sparkSession
    src = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", "doc_id")
    sizes = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_chars / max(1, sizes[k])))])
    coin = F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(1 << 30)).cast("double") / (1 << 30)
    picked = src.filter(coin < share[F.col("lang")]).select("text", "lang", (F.pmod(F.xxhash64(F.lit(6), F.col("doc_id")), F.lit(10)) == 0).alias("calibrates"))
    place = {k: i for i, k in enumerate(languages)}

    def count(parts):
        import pyarrow as pa

        for b in parts:
            by: dict[int, list[np.ndarray]] = {}
            for text, lang, off in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not off and len(c := characters(text)):
                    c = np.concatenate([np.full(order - 1, 32, np.uint32), c])
                    by.setdefault(place[lang], []).append(np.lib.stride_tricks.sliding_window_view(c, order))
            for k, rows in by.items():
                g, n = np.unique(np.ascontiguousarray(np.concatenate(rows)).view(f"V{4 * order}").ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array([x.tobytes() for x in g], pa.binary()), pa.array(n.astype(np.int64))], ["l", "g", "n"])

    got = picked.mapInArrow(count, "l int, g binary, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    if not got.num_rows:
        return None
    grams = np.frombuffer(b"".join(got.column("g").to_pylist()), np.uint32).reshape(-1, order).astype(np.int64)
    model = fit(languages, grams, got.column("l").to_numpy().astype(np.int64), got.column("n").to_numpy())
    sent = spark.sparkContext.broadcast(model)

    def own(parts):
        import pyarrow as pa

        m = sent.value
        for b in parts:
            for text, lang, off in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if off and (h := m.entropy(text)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([place[lang]], pa.int32()), pa.array([h[place[lang]]])], ["l", "h"])

    seen = {r["l"]: r for r in picked.mapInArrow(own, "l int, h double").groupBy("l").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s")).collect()}
    model.mean = np.array([seen[i]["m"] if i in seen else np.inf for i in range(len(languages))])
    model.deviation = np.array([max(seen[i]["s"], 1e-3) if i in seen else 1.0 for i in range(len(languages))])
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a struct __lg_lang(lang, score, entropy, accepted)."""
    if model is None:
        nothing = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("accepted"))
        return docs.withColumn("__lg_lang", nothing)
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)
    own, at = docs.columns, docs.columns.index("text")
    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(parts):
        import pyarrow as pa

        m = sent.value
        heat = float(np.mean(m.deviation))
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("accepted", pa.bool_())])
        for b in parts:
            rows = []
            for text in b.column(at):
                h = m.entropy(text.as_py() or "")
                if h is None:
                    rows.append({"lang": "und", "score": 0.0, "entropy": None, "accepted": False})
                    continue
                k = int(h.argmin())
                p = 1.0 / np.exp(-np.minimum((h - h[k]) / heat, 700)).sum()
                rows.append({"lang": m.languages[k], "score": float(p), "entropy": float(h[k]), "accepted": bool(h[k] <= m.mean[k] + 6 * m.deviation[k])})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*own, "__lg_lang"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__lg_lang", out)]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = learn(docs.select("doc_id", "text", "lang"), ~held)
    out = identify(docs.select("doc_id", "text"), model)
    x = F.col("__lg_lang")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), x["lang"].alias("lang_pred"), x["score"].alias("score"), x["entropy"].alias("entropy"), x["accepted"].alias("accepted"))
