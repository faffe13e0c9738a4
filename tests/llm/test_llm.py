"""The training-data operators against brute force, on small fixtures with nulls, ties, copies and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import op1_topk, op2_language, op3_toxicity, op4_neardup, op5_sharding, op6_bpe, op7_suffixes, op8_embeddings, op9_lines, op10_mixing
from loomgraph.llm.common import Scratch, components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __x string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, line = text(80), "A line that many documents share, of some length"
    out = [(i, text(30) + "\n" + line + "\n" + text(5)) for i in range(12)]
    out += [(20 + i, base) for i in range(5)]
    for i in range(6):
        t = base.split()
        t[i * 3] = "changed"
        out.append((30 + i, " ".join(t)))
    out += [(40, None), (41, ""), (42, "a"), (43, "a\n\na"), (44, text(4000)), (45, "é" * 70), (46, "é" * 70), (None, "no id " + base), (47, "a" * 300), (48, "b" + "a" * 200)]
    return [(i, t, "en", None if (i or 0) % 7 == 0 else f"s{(i or 0) % 3}", 1, "x") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (7, 9), (4, 3)], "u long, v long")
    got = {r["id"]: r["component"] for r in components(Scratch(spark), e).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 8: 7, 9: 7}


def test_lines(docs, none, rows, spark):
    key = lambda x: bytes(x.encode()).lower().strip(op9_lines.STRIP)
    seen = collections.defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x).decode()) >= 20:
                    seen[key(x)].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if i is None or not (len(s := seen.get(key(x), ())) >= 3 and i < max(s))) for i, t, *_ in rows if t is not None}
    out = op9_lines.dedup_lines(docs, Scratch(spark))
    got = {r["doc_id"]: r["text"] for r in out.filter("text is not null").collect()}
    assert got == want and out.columns == [*docs.columns, "__lg_lines"]
    assert op9_lines.dedup_lines(none, Scratch(spark)).count() == 0


def test_near_classes(docs, none, rows, spark):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    ids = [r[0] for r in rows if r[0] is not None]
    texts, up = dict((r[0], r[1]) for r in rows), {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and texts[a] is not None and (texts[a] == texts[b] or sets[a] and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values())):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r["doc_id"]: r["class_id"] for r in op4_neardup.near_classes(docs, Scratch(spark)).collect()}
    assert got == {**{i: top(i) for i in ids}, None: None}
    assert op4_neardup.near_classes(none, Scratch(spark)).count() == 0
    assert op4_neardup.keep_one(docs, Scratch(spark)).count() == len({top(i) for i in ids}) + 1


def test_dart_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    b[:200] = a[:200]
    w = rng.integers(1, 8, 300) / 2.0
    o, p = np.argsort(a), np.argsort(b)
    sig = op4_neardup.dart_signatures(2, np.repeat([0, 1], 300), np.append(a, b), np.append(w, w), 2048)
    assert abs((sig[0] == sig[1]).mean() - op4_neardup.similarity(a[o], w[o], b[p], w[p])) < 0.05


def kept_by_brute_force(rows, span=50):
    first, want = {}, {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - span + 1 if i is not None else 0):
            first[b[k : k + span]] = min(i, first.get(b[k : k + span], i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1 if i is not None else 0):
            if first[b[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        want[i] = bytes(x for x, y in zip(b, gone, strict=True) if not y)
    return want


def test_previous_factors():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        doc, common = rng.integers(0, 12, n), rng.choice([0, 8, 50, 60], n, p=[0.1, 0.1, 0.4, 0.4])
        common[:1] = 0
        want = [max([0, *(min(common[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if doc[j] < doc[i])]) for i in range(n)]
        got = op7_suffixes.previous_factors(doc, common, 50)
        assert [x if x >= 50 else 0 for x in got] == [x if x >= 50 else 0 for x in want]


def test_repeats(docs, none, rows, spark):
    got = {r["doc_id"]: bytes(r["__lg_cut"]["kept"]) for r in op7_suffixes.remove_repeats(docs, Scratch(spark), shard_runs=50).collect()}
    assert got == kept_by_brute_force(rows)
    assert op7_suffixes.remove_repeats(none, Scratch(spark)).count() == 0


@pytest.mark.parametrize("batch", ["7", "10000"])
@pytest.mark.parametrize("shard_runs", [3, 30, 250_000])
def test_frequent_passages(spark, batch, shard_runs):
    """One phrase in all texts, in few and in many surroundings, over batches that see much or little of it."""
    rng = np.random.default_rng(5)
    phrase, near = "the quick brown fox jumps over", ["".join(rng.choice(list("abcdefgh "), 60)) for _ in range(6)]
    rows = [(int(i), near[rng.integers(6)] + phrase + (near[rng.integers(6)] if i % 3 else str(i) * 30) + phrase * (i % 2)) for i in rng.permutation(150)]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, batch)
    try:
        out = op7_suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), shard_runs=shard_runs).collect()
    finally:
        spark.conf.set(conf, before)
    assert {r["doc_id"]: bytes(r["__lg_cut"]["kept"]) for r in out} == kept_by_brute_force(rows)


def test_bpe(docs, none, rows):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(op6_bpe.vocabulary_path(op6_bpe.VOCABULARY))
    own = op6_bpe.loaded(op6_bpe.VOCABULARY)
    extra = ["Σας ΣΣ'S don't I'LL <|endoftext|>x ÀÉ²½Ⅷ ١٢ ﬁ é İ\x1c\x85​　d 😀", "x" * 3000, " \t\n"]
    extra += ["".join(f"a{c}{c}7 {c}" for c in map(chr, range(k, k + 64))) for k in (0xA7C0, 0x10D40, 0x1C80, 0x2EBF0, 0x11BC0)]  # of newer Unicode versions
    for t in [r[1] or "" for r in rows] + extra:
        e = lib.encode(t, add_special_tokens=False)
        ids, decoded = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert decoded == lib.decode(e.ids, skip_special_tokens=False) == own.decode(e.ids)
    assert op6_bpe.encode_texts(docs).count() == len(rows) and op6_bpe.encode_texts(none).count() == 0


def test_shards(docs, none, rows, spark):
    got = op5_sharding.shard(docs.select("doc_id", "text"), Scratch(spark), shards=4).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(x) for x in by.values()]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] in range(20, 25)}) == 1
    assert op5_sharding.shard(none.select("doc_id", "text"), Scratch(spark)).count() == 0


def test_mixing(docs, none, spark):
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    n = {r["source"]: r["count"] for r in op10_mixing.mix_sources(big, weights={"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 200 and abs(n["b"] - 1000) < 120
    far = op10_mixing.mix_sources(big.filter("source = 'a'"), budget=20.0).count()  # rates above 16 are split
    assert abs(far - 20000) < 700
    assert op10_mixing.mix_sources(docs).columns[: len(docs.columns)] == docs.columns and op10_mixing.mix_sources(none).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=8)], i % 2) for i in range(60)]
    v += [(100 + i, [x + 0.02 * i for x in v[3][1]], 1) for i in range(6)] + [(200, v[5][1], 1), (201, v[5][1], 1), (202, v[5][1], None)]
    return v + [(300, None, 1), (301, [float("nan")] * 8, 1), (302, [0.0] * 8, 1), (303, [None] * 8, 0), (None, v[1][1], 1), (304, [float("inf")] * 8, 0)]


def test_topk(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    ok = [(i, np.floor(1024 * np.float32(e).astype(float)).astype(int)) for i, e, _ in vectors if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    want = set()
    for q, x in ok:
        if q % 10 == 0:
            best = sorted(((-int(x @ y), i) for i, y in ok if i != q))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for block in (3, 100):
        got = op1_topk.search(df, F.col("vec_id") % 10 == 0, Scratch(spark), k=5, block=block, bins=16)
        assert {tuple(r) for r in got.collect()} == want
    assert op1_topk.search(df.filter("vec_id < 0"), F.lit(True), Scratch(spark)).count() == 0


def test_topk_large_components(spark):
    """Scores up to the range of a long are exact; beyond it there is an error."""
    rows = [(0, [200000.0]), (1, [200000.0]), (2, [150000.0]), (3, [140000.0]), (4, [-200000.0]), (5, [])]
    got = op1_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, Scratch(spark), k=10).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 41943040001048576 - 1048576), (2, 31457280000000000), (3, 29360128000000000), (5, 0), (4, -41943040000000000)]
    wide = [(0, [2.0**21, 2.0**21]), (1, [2.0**20 * 1.5, -1.0]), (2, [2.0**20, 2.0**20])]
    got = op1_topk.search(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), F.lit(True), Scratch(spark), k=1).collect()
    x = {i: [int(1024 * c) for c in v] for i, v in wide}
    best = {q: max((sum(a * b for a, b in zip(x[q], x[i], strict=True)), -i) for i in x if i != q) for q in x}
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in got} == {(q, -i, s) for q, (s, i) in best.items()}
    with pytest.raises(Exception, match="does not fit"):
        op1_topk.search(spark.createDataFrame([(0, [1e20]), (1, [1e20])], "vec_id long, embedding array<double>"), F.lit(True), Scratch(spark)).collect()


def test_near_vectors(spark, vectors):
    ok = {i: (np.float32(e).astype(float), lab) for i, e, lab in vectors if i is not None and lab is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    link = {a: [b for b in ok if a != b and ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.98] for a in ok}

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return min(seen)

    want = {(i, len(link.get(i, [])), reach(i) if i in ok else i) for i, *_ in vectors}
    df = spark.createDataFrame(vectors, VECTORS)
    for kw in ({}, {"cell": 4, "home_rows": 5, "other_rows": 7, "share": 9}, {"cell": 1000}):
        assert {tuple(r) for r in op8_embeddings.near_vectors(df, Scratch(spark), **kw).collect()} == want
    assert op8_embeddings.near_vectors(df.filter("vec_id < 0"), Scratch(spark)).count() == 0


def test_language(spark, none):
    out = op2_language.op2_language_id(spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    r = out.filter("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("double"))).first()[0]
    assert r > 0.9
    model = op2_language.learn(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "the " * 5000)], "doc_id long, text string")
    assert [r["__lg_lang"]["lang"] for r in op2_language.identify(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert op2_language.learn(none, F.lit(True)) is None and op2_language.identify(none, None).count() == 0


def test_toxicity_learns_pairs():
    """Neither term alone is toxic, both together are: no additive weights can do it."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, (2, 600))
    y = (a == b).astype(float)
    doc = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    place = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
    o = np.argsort(doc, kind="stable")
    m = op3_toxicity.train(np.zeros(1), 2, y, doc[o], place[o], rounds=400)
    assert (((m.logits(600, doc[o], place[o]) > 0) == y).mean()) == 1.0


def test_toxicity_learns_pairs_from_texts(spark):
    """The same through learn(): terms that tell nothing alone must reach the machine."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, (2, 2000))
    y = (a == b).astype(int)
    rows = [(i, " ".join(["alpha"] * int(a[i]) + ["gamma"] * int(b[i]) + [f"w{k}" for k in rng.integers(0, 300, 5)]), int(y[i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = op3_toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") < 1500)
    got = op3_toxicity.score(df, m).filter("doc_id >= 1500").collect()
    assert np.mean([(r["__lg_toxic"] >= 0.5) == r["toxic"] for r in got]) > 0.95


def test_toxicity(spark, none):
    got = op3_toxicity.op3_toxicity(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert op3_toxicity.learn(none, labels, F.lit(True)) == 0.0


def test_pipeline(spark):
    """Each stage against what it must do with its own input."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    scratch = Scratch(spark)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    flagged = {r["doc_id"] for r in op3_toxicity.score(docs, op3_toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).filter("__lg_toxic >= 0.5").collect()}
    a = scratch.save(p.toxicity(spark, docs, SF))
    assert a.columns == docs.columns and ids(a) == ids(docs) - flagged
    b = scratch.save(p.line_dedup(spark, a, SF))
    assert b.columns == docs.columns and ids(b) == ids(a) and b.filter("n_chars <> length(text)").count() == 0
    c = scratch.save(p.near_dedup(spark, b, SF))
    classes = {r["class_id"] for r in op4_neardup.near_classes(b, Scratch(spark)).collect()}
    assert ids(c) == classes and c.count() == len(classes)
    d = scratch.save(p.mixing(spark, c, SF))
    assert d.columns == docs.columns and ids(d) <= ids(c)
    e = p.bpe(spark, d, SF).collect()
    text = {r["doc_id"]: r["text"] for r in c.collect()}
    own = op6_bpe.loaded(op6_bpe.VOCABULARY)
    for r in e:
        x, y = own.encode(text[r["doc_id"]])
        assert bytes(r["token_ids"]) == x and r["decoded_sha256"] == hashlib.sha256(y.encode()).hexdigest()
    assert len(e) == d.count()
