"""Operators on inputs whose shape, not whose size, once made them fail."""

from pyspark.sql import functions as F

from loomgraph.operators import activation as A
from loomgraph.operators import chunks as C
from loomgraph.operators import prepare as PR
from loomgraph.operators import rank as R


def test_chunks_in_wide_units(spark):
    """A unit may span any number of lines; packs of a file's chunks, odd chunks and repeated units make no difference."""
    far = 10**13
    rows = [("a", i, i * 7, i * 7 + (i % 5) * 4) for i in range(600)] + [("a", 900, far, far), ("a", 901, 50, 20), ("b", 902, None, 3), (None, 903, 1, 2)]
    units = [("a", "all", 0, far), ("a", "low", 10, 1500), ("a", "low", 10, 1500), ("a", "late", 3000, 2 * far), ("a", "none", 8, 8), ("b", "b", 0, far)]
    got = C.chunks_in_units(spark.createDataFrame(rows, "path string, chunk_id long, line_start long, line_end long"), spark.createDataFrame(units, "path string, name string, start_line long, end_line long"))
    want = {}
    for p, n, s, e in units:
        ids = [i for q, i, a, z in rows if q == p and a is not None and a >= s and z <= e]
        if ids:
            want[p, n] = sorted(want.get((p, n), []) + ids)
    assert {(r["path"], r["name"]): r["chunk_ids"] for r in got.collect()} == want


def test_top_vectors_is_brute_force(spark):
    """Queries by the thousand, ties by rounding, copies, odd vectors and other lengths, as the row by row comparison ranks them."""
    import random

    from pyspark.sql import Window as W

    r = random.Random(5)
    rows = [[r.gauss(0, 1) for _ in range(6)] for _ in range(120)]
    rows += [rows[3]] * 15 + [[2 * x for x in rows[4]]] * 9 + [[0.0] * 6, None, [1.0] * 5, [float("nan")] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [1e-120] * 6, [1e3, 1.0, 0.0, 0.0, 0.0, 0.0]]
    rows += [[1e3, 1.0 + k * 1e-7, 0.0, 0.0, 0.0, 0.0] for k in range(9)]
    e = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3)
    q = e.filter("vec_id % 3 = 0 or vec_id > 130").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = q.join(e).withColumn("score", F.round(R.cosine(F.col("q"), F.col("embedding")), 6))
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter("rank <= 5").select("query_id", "vec_id", "score", "rank")
    assert sorted(map(str, R.top_vectors(q, e, 5, 40).collect())) == sorted(map(str, s.collect()))
    none = q.filter("query_id < 0")
    assert R.top_vectors(none, e).collect() == [] and R.top_vectors(q, e.filter("vec_id < 0")).collect() == []
    plan = R.top_vectors(q.filter("query_id = 3"), e)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_equal_texts_are_matched_once(spark):
    """However many turns say the same, pieces of their text are sought once; ids with two texts keep the matches of both."""
    texts = ["show the Big Bolt of Brand#1", "big bolt", "BOLTS and big", None, "", "bran the", "show the Big Bolt of Brand#1 "]
    turns = [(i, texts[i % 7]) for i in range(70)] + [(3, "big bolt"), (8, "bran the"), (8, "big bolt")]
    labels = ["big bolt", "Bolts", "Brand#1", "Brand#12", "bolt big", "th", "the", "showing off", "Bran the great"]
    t, n = spark.createDataFrame(turns, "text_id long, text string"), spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    want = set()
    for i, x in turns:
        for j, y in enumerate(labels):
            m, low = (x or "").lower(), y.lower()
            if len(y) >= 3 and x and (low in m or any(len(w) >= 4 and low.startswith(w) for w in m.split()) or (len(set(low.split())) > 1 and set(low.split()) <= set(m.split()))):
                want.add((i, j))
    assert sorted(map(tuple, A.mentioned(t, n).collect())) == sorted(want)
    _, each = A.alike(t)
    assert each.count() < 15


def test_turns_with_equal_seeds_share_layers(spark):
    """Layers are found once a set of seeds, and all turns get them; an overview without seeds gets all entities."""
    names = ["Alpha Site", "Beta", "Alphabet", "Gamma"]
    nodes = spark.createDataFrame([(f"n{i}", x, "entity", "") for i, x in enumerate(names)] + [("s", "Note", "synthesis", "on beta things")], "id string, label string, kind string, summary string")
    edges = spark.createDataFrame([("n0", "n3"), ("n3", "n1"), ("n2", "gone")], "source string, target string")
    said = [("about alpha site", "specific"), ("tell of Alpha Site", "chat"), ("beta", "chat"), ("nothing", "overview"), ("zzz", "overview"), ("zzz", "chat")]
    turns = spark.createDataFrame([(i, *said[i % 6]) for i in range(60)], "text_id long, text string, intent string")
    want = {0: ["n0", "n2"], 1: ["n0", "n2"], 2: ["s"], 3: ["n0", "n1", "n2", "n3"], 4: ["n0", "n1", "n2", "n3"]}
    assert sorted(map(tuple, PR.seeds(turns, nodes).collect())) == sorted((i, x) for i in range(60) for x in want.get(i % 6, []))
    members, start = PR.entered(turns, nodes)
    assert start.count() == 7 and members.select("rep").distinct().count() == 3
    around = {0: {("n0", 0), ("n2", 0), ("n3", 1), ("n1", 2)}, 2: {("s", 0)}, 3: {(f"n{k}", 0) for k in range(4)}}
    around |= {1: around[0], 4: around[3], 5: set()}
    assert sorted(map(tuple, PR.layered(turns, nodes, edges).collect())) == sorted((i, x, d) for i in range(60) for x, d in around[i % 6])
