"""Brute force for the learned operators and the sharding law; repeated ids, clashing columns, odd rows, through operators and pipeline stages."""

import ast
import collections
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import op2_language, op3_toxicity, op4_neardup, op5_sharding, op6_bpe, op7_suffixes, op8_embeddings, op9_lines, op10_mixing, stages
from loomgraph.llm.common import Scratch, buffers, shingle_hashes, word_hashes

SF = "/root/testdata/sf0.001"
SHARED = "A line that many documents share, of some length"


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("name,texts", [
    ("pairs", [f"t{i // 2}" for i in range(160)]), ("equal", ["a"] * 100), ("triples", [f"t{i // 3}" for i in range(300)]), ("few", ["a", "b", "a"]),
    ("nulls", [None, None, "", "", "é", None, "", "b"] * 5), ("skewed", [f"t{min(i, 40)}" for i in range(90)] + ["x"] * 45),
])
def test_law(spark, name, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op5_sharding.shard(df, Scratch(spark)).collect()}
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[k]) for k in range(16)]
    assert len(got) == len(texts) and max(counts) - min(counts) <= 1 and set(slots) <= set(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        if t is not None:
            groups[t].append(got[i]["shard"])
    # each shard's quota can end within at most two groups besides those larger than a quota
    small = [set(x) for x in groups.values() if len(x) <= len(texts) // 16]
    assert sum(len(x) > 1 for x in small) <= 32
    if name == "pairs":
        assert all(len(x) == 1 for x in small)


# ---------------------------------------------------------------- near-duplicates


def words(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_repeated_ids(spark):
    a, b = words("a"), words("b")
    rows = [(5, b), (5, a), (7, a + " x"), (9, b + " z"), (3, "y " + a), (4, "alone"), (4, "alone"), (11, words("q")), (11, words("r"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = sorted(map(tuple, op4_neardup.near_classes(df, Scratch(spark)).collect()))
    assert classes == [(3, 3), (4, 4), (4, 4), (5, 3), (5, 3), (7, 3), (9, 3), (11, 11), (11, 11)]
    kept = sorted((r["doc_id"], r["text"]) for r in op4_neardup.keep_one(df, Scratch(spark)).collect())
    assert kept == sorted([(3, "y " + a), (4, "alone"), (5, b), (11, words("q")), (11, words("r"))])
    other = spark.createDataFrame([(5, words("q")), (5, words("r")), (6, words("t"))], "doc_id long, text string")
    assert op4_neardup.keep_one(other, Scratch(spark)).count() == 3


def test_classes_of_a_real_table(spark):
    """All pairs at similarity 0.8 or more of sf0.01, compared exactly, give the same classes: none is lost, none is made up."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in op4_neardup.near_classes(docs, Scratch(spark)).collect()}
    rows = docs.collect()
    data, off = buffers(pa.array([r["text"].lower() for r in rows]))
    h, d, _, _ = word_hashes(data, off)
    h, d = shingle_hashes(h, d)
    doc, key, count = op4_neardup.weighted(d, h)
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    sets = [(key[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]) for i in range(len(rows))]
    up = {r["doc_id"]: r["doc_id"] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    mass = np.array([s[1].sum() for s in sets])
    for i in range(len(rows)):
        for j in np.flatnonzero((np.minimum(mass, mass[i]) >= 0.8 * np.maximum(mass, mass[i])) & (np.arange(len(rows)) > i)):
            if rows[i]["text"] == rows[j]["text"] or mass[i] and op4_neardup.similarity(*sets[i], *sets[j]) >= 0.8:
                a, b = sorted((top(rows[i]["doc_id"]), top(rows[j]["doc_id"])))
                up[b] = a
    assert got == {i: top(i) for i in up}


# ---------------------------------------------------------------- language models


def test_kneser_ney():
    """Against a model of dictionaries, character by character; probabilities of the alphabet and one unknown character sum to one."""
    texts = {0: ["the cat sat on the mat", "a cat"], 1: ["der hund und die katze", "das haus"]}
    order, rows, langs = 3, [], []
    for k, ts in texts.items():
        for x in ts:
            c = np.concatenate([np.full(order - 1, 32, np.uint32), op2_language.characters(x)])
            for w in np.lib.stride_tricks.sliding_window_view(c, order):
                rows.append(tuple(map(int, w)))
                langs.append(k)
    counted = collections.Counter(zip(langs, rows, strict=True))
    model = op2_language.fit(["en", "de"], np.array([r for _, r in counted], np.int64), np.array([k for k, _ in counted]), np.array(list(counted.values())))
    levels = {order: counted}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter((k, g[1:]) for k, g in levels[n + 1])
    alphabet = sorted({g[-1] for _, g in counted})
    discount = {}
    for n, table in levels.items():
        for k in texts:
            n1, n2 = (sum(v == m for (lang, _), v in table.items() if lang == k) for m in (1, 2))
            discount[n, k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5))

    def p(k, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(alphabet) + 1)
        same = {g: v for (lang, g), v in levels[n].items() if lang == k and g[:-1] == gram[:-1]}
        lower = p(k, gram[1:]) if n > 1 else 1 / (len(alphabet) + 1)
        if not same:
            return lower
        d, total = discount[n, k], sum(same.values())
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * lower

    for k in texts:
        for context in ((32, 32), (ord("t"), ord("h")), (ord("q"), ord("q"))):
            assert sum(p(k, (*context, c)) for c in [*alphabet, 0x416]) == pytest.approx(1)
    for x in ("the hat", "die katze", "qqq", "ж"):
        c = [32] * (order - 1) + [int(v) for v in op2_language.characters(x)]
        want = [-np.mean([math.log(p(k, tuple(c[i - order + 1 : i + 1]))) for i in range(order - 1, len(c))]) for k in texts]
        assert model.entropy(x) == pytest.approx(want, abs=1e-4)


def test_language_odd_rows(spark):
    rows = [(i, f"the cat {i} sat on the mat and the dog", "en") for i in range(30)] + [(100 + i, f"der hund {i} und die katze im haus", "de") for i in range(30)]
    rows += [(0, "the cat 0 sat on the mat and the dog", "en"), (200, None, "en"), (201, "", None), (202, "x" * 50_000, None), (None, "the cat", "en")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, lang string, score int, entropy string")
    got = op2_language.identify(df, op2_language.learn(df, F.lit(True)))
    assert got.columns == [*df.columns, "__lg_lang"] and got.count() == len(rows)
    by = collections.defaultdict(set)
    for r in got.collect():
        by[r["doc_id"]].add((r["__lg_lang"]["lang"], r["__lg_lang"]["score"]))
    assert len(by[0]) == 1 and by[200] == by[201] == {("und", 0.0)} and {x for x, _ in by[105]} == {"de"}


# ---------------------------------------------------------------- toxicity


def test_machine_is_a_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = op3_toxicity.Machine(np.zeros(1), 0.3, rng.normal(size=7), rng.normal(size=(7, 3)))
    sets = [[0, 2, 5], [], [6], [0, 1, 2, 3, 4, 5, 6]]
    doc = np.repeat(np.arange(4), [len(x) for x in sets])
    want = [0.3 + sum(m.w[i] for i in s) + sum(m.v[i] @ m.v[j] for i in s for j in s if i < j) for s in sets]
    assert m.logits(4, doc, np.array(sum(sets, []))) == pytest.approx(want)


def test_rest_of_the_terms_is_fitted():
    """Terms that the first step leaves out take on what it can't explain, in blocks as well as at once."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    doc = np.repeat(np.arange(400), 2)
    place = np.stack([1 + y.astype(int), rng.integers(3, 40, 400)], 1).ravel()
    got = []
    for block in (16, 1 << 19):
        m = op3_toxicity.Machine(np.zeros(1), 0.0, np.zeros(40), np.zeros((40, 2)))
        op3_toxicity.settle(m, np.arange(40) > 0, y, doc, place, rounds=30, block=block)
        got.append(m.w)
    assert got[0] == pytest.approx(got[1]) and got[0][1] < -0.3 and got[0][2] > 0.3 and got[0][0] == 0


def test_toxicity_every_bucket_of_the_sample_has_a_weight(spark):
    """Also buckets of one row, and those that tell nothing."""
    rows = [(i, f"common words w{i} {'vile' if i % 4 == 0 else 'kind'}", int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = op3_toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    seen = set()
    for _, _, _, term in op3_toxicity.term_pieces(pa.array([t for _, t, _ in rows])):
        seen |= set(term.tolist())
    assert set(np.flatnonzero(m.chosen >= 0).tolist()) == seen and len(m.w) == len(m.v) == len(seen) and (m.w != 0).sum() > 200


def test_sample_is_fitted_off_the_driver(spark, monkeypatch):
    """The driver's Python fits nothing, and the machine does not depend on how the sample's rows come."""
    rows = [(i, f"common words w{i % 30} {'vile' if i % 4 == 0 else 'kind'}", int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    batch = pa.RecordBatch.from_arrays([pa.array([y for _, _, y in rows], pa.int32()), pa.array([sorted({int(x) for *_, term in op3_toxicity.term_pieces(pa.array([t])) for x in term}) for _, t, _ in rows], pa.list_(pa.int32()))], ["toxic", "buckets"])
    a = op3_toxicity.fit([batch], terms=4096, screened=8192)
    b = op3_toxicity.fit([batch.slice(150), batch.slice(0, 0), batch.slice(60, 90), batch.slice(0, 60)], terms=4096, screened=8192)

    def here(*_, **__):
        raise AssertionError("fitted on the driver")

    for name in ("train", "foreseen", "telling_pairs", "settle"):
        monkeypatch.setattr(op3_toxicity, name, here)
    c = op3_toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    for m in (b, c):
        assert m.w0 == a.w0 and np.array_equal(m.chosen, a.chosen) and np.array_equal(m.w, a.w) and np.array_equal(m.v, a.v)
    assert op3_toxicity.fit([], terms=4096, screened=8192) == op3_toxicity.fit([batch.slice(0, 0)], terms=4096, screened=8192) == 0.0


def test_no_name_is_defined_twice():
    for path in sorted(Path(op3_toxicity.__file__).parent.glob("*.py")):
        for scope in [n for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, (ast.Module, ast.ClassDef))]:
            names = [n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
            assert len(names) == len(set(names)), path.name


def test_toxicity_odd_rows(spark):
    rows = [(i, f"you are a {'bad fool' if i % 2 else 'good friend'} number {i % 5}", i % 2) for i in range(200)] + [(300, None, 1), (301, "", 0), (302, "fool " * 20_000, None), (5, "you are a bad fool number 0", 1), (None, "x", 1)]
    docs = spark.createDataFrame([(i, t, "s", 2.0) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = op3_toxicity.learn(docs, labels, F.lit(True))
    got = op3_toxicity.score(docs, machine)
    assert got.columns == [*docs.columns, "__lg_toxic"] and got.count() == len(rows)
    s = {r["doc_id"]: r["__lg_toxic"] for r in got.collect()}
    assert s[300] == s[301] and s[7] > 0.5 > s[8] and all(0 <= x <= 1 for x in s.values())
    assert op3_toxicity.learn(docs, labels.filter("toxic = 1"), F.lit(True)) == 1.0
    assert op3_toxicity.learn(docs, labels.withColumn("toxic", F.lit(None).cast("int")), F.lit(True)) == 0.0
    none = docs.limit(0)
    assert op3_toxicity.score(none, machine).count() == 0 and op3_toxicity.learn(none, labels, F.lit(True)) == 0.0


# ---------------------------------------------------------------- mixing


def test_counts_and_order(spark):
    rows = [(i, "x" * (1 + i % 9), None if i % 10 == 0 else "ab"[i % 2]) for i in range(600)] + [(600, None, "zero"), (601, "", "zero"), (7, "again", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op10_mixing.mix_sources(df).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    total, weight = sum(size.values()), sum(math.sqrt(v) for v in size.values())
    want = collections.Counter()
    for i, t, s in rows:
        rate = math.sqrt(size[s]) / weight * total / size[s] if size[s] else 1.0
        u = int(hashlib.md5(f"{op10_mixing.SEED}|n|{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        want[i, t] += n
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == +want
    order = [r["__lg_order"] for r in out]
    assert order == sorted(order)
    assert op10_mixing.mix_sources(df, budget=0.0).filter("source is null or source <> 'zero'").count() == 0 and op10_mixing.mix_sources(df, weights={"a": 1.0}).filter("source = 'b'").count() == 0


# ---------------------------------------------------------------- clashing names and odd rows


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    base = text(80)
    rows = [(i, text(30) + "\n" + SHARED + "\n" + text(4)) for i in range(8)] + [(20, base), (21, base), (22, base + " more"), (22, base + " more"), (23, None), (24, ""), (25, "a"), (None, base), (None, None), (26, text(20_000)), (27, "\n\n"), (28, "x" * 400)]
    names = "id c n b k1 k2 g m s first home bucket bands mass label e u v h doc batch shard slot size score toxic class_id kept runs masks __x".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in names)
    out = [(i, t, "en" if i else None, None if i == 3 else f"s{(i or 0) % 2}", len(t or ""), *names) for i, t in rows]
    return spark.createDataFrame(out, schema).repartition(3)


def same_extra(df, got):
    """Extra columns are there with their values."""
    extra = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert [c for c in got.columns if c in df.columns] == df.columns
    assert all(r[c] == c for r in got.select(*extra).collect() for c in extra)


def test_clashing_names(spark, odd):
    n = odd.count()
    for out in (op9_lines.dedup_lines(odd, Scratch(spark)), op7_suffixes.remove_repeats(odd, Scratch(spark)), op6_bpe.encode_texts(odd), op4_neardup.keep_one(odd, Scratch(spark)), op10_mixing.mix_sources(odd)):
        same_extra(odd, out)
    assert op9_lines.dedup_lines(odd, Scratch(spark)).count() == op7_suffixes.remove_repeats(odd, Scratch(spark)).count() == op6_bpe.encode_texts(odd).count() == n
    assert op4_neardup.near_classes(odd, Scratch(spark)).count() == n and op5_sharding.shard(odd, Scratch(spark)).count() == n
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in op4_neardup.keep_one(odd, Scratch(spark)).collect())
    assert [k[1] for k in kept if not k[0]] == [*range(8), 20, 23, 24, 25, 26, 27, 28] and sum(k[0] for k in kept) == 2


def test_stages_with_odd_rows(spark, odd):
    """Each stage on nulls, empty, long and repeated texts, extra columns and no rows at all."""
    docs = odd
    for name, stage in stages.STAGES:
        out = Scratch(spark).save(stage(spark, docs, SF))
        if name == "bpe":
            own = op6_bpe.loaded(op6_bpe.VOCABULARY)
            texts = collections.Counter((r["doc_id"], own.encode(r["text"] or "")[0]) for r in docs.collect())
            assert collections.Counter((r["doc_id"], bytes(r["token_ids"])) for r in out.collect()) == texts
            break
        same_extra(docs, out)
        before, after = (collections.Counter(r["doc_id"] for r in x.collect()) for x in (docs, out))
        assert set(after) <= set(before)
        if name in ("line_dedup", "toxicity"):
            assert after == before or name == "toxicity"
        if name == "line_dedup":
            shared = [r["doc_id"] for r in out.filter(F.contains("text", F.lit(SHARED))).collect()]
            assert shared == [7] and out.filter("text is not null and n_chars <> length(text)").count() == 0
        docs = out
    none = odd.limit(0)
    for _, stage in stages.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.0, 1.0], 0), (4, [5.0, 5.0], 0), (5, [1.0, 0.0], 1)]
    got = sorted(map(tuple, op8_embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), Scratch(spark)).collect()))
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (5, 0, 5)]
