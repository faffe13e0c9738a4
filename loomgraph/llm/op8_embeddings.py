"""Embedding near-dedup as an exact metric range join within labels.

Vectors are scaled to length 1; cosine >= c means a distance of at most r = sqrt(2 - 2c).  Pivots, up to ``fan`` vectors
of a label drawn by hash, split it into cells (nearest pivot).  A vector
at distance a from its own pivot and b from another can have a partner in that pivot's cell only if
b - a <= 2r (triangle inequality), and, distances being Euclidean, only if (b^2 - a^2) / (2 * distance
of the pivots) <= r; where both hold it is copied there.  So each vector meets all its partners in its
own cell, and cells join independently, in blocks of bounded size: a block counts the links of its rows
and returns a spanning forest, never pairs.

Cells with more home rows than a block takes are split again by pivots of their own, copies included, until none is left or a split
is not worth it.  That is measured on some ``share`` rows of the cell: a label is split if the copies make at most four rows of one, or
if the growth of rows times the share of comparisons left is at most 2; a cell further down if that holds and a quarter of
the comparisons goes.  Where pivots separate nothing (vectors without structure), the cell stays whole and its
blocks compare all its rows: slower, but as exact.

Equal vectors are joined first, as one representative with a count.  Pairs whose cosine is within
1e-9 of the bound are computed again from the stored components.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null
label or id, link with nothing (n_links 0, their own component); vectors of different length are filled with zeros;
rows that repeat an id are vectors of their own and link like any others; no rows give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, components, table
from .vectors import matrix, usable

EDGE = 1e-9


def unit(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(top > 0, top, 1)  # no overflow in the squares
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n > 0, n, 1)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def forest(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest id of its component, for links i-j between places in ids."""
    used, inv = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = inv[: len(i)], inv[len(i) :]
    own = ids[used]
    label = own.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, new[a])
        if (new == label).all():
            return own, label
        label = new


def join_block(part, bound: float, step: int = 1024):
    """part: rows of one block, columns home, id, n, e.  Rows with home join all rows."""
    import pyarrow as pa

    home = part.column("home").to_numpy(zero_copy_only=False).astype(bool)
    ids = part.column("id").to_numpy().astype(np.int64)
    n = part.column("n").to_numpy().astype(np.int64)
    raw = matrix(part.column("e"))
    v = unit(raw)
    h, rest = np.flatnonzero(home), np.flatnonzero(~home)
    links = np.zeros(len(h), np.int64)
    us, vs = [], []
    for k in range(0, len(rest), step):
        a = rest[k : k + step]
        s = v[h] @ v[a].T
        for x, y in zip(*np.nonzero(np.abs(s - bound) < EDGE), strict=True):
            s[x, y] = cosine(raw[h[x]], raw[a[y]])
        i, j = np.nonzero(s >= bound)
        ok = ids[h[i]] != ids[a[j]]
        i, j = i[ok], j[ok]
        if len(i):
            np.add.at(links, i, n[a[j]])
            u, w = forest(h[i], a[j], ids)
            us.append(u[u != w])
            vs.append(w[u != w])
    got = np.flatnonzero(links)
    u = np.concatenate([ids[h[got]], *us]).astype(np.int64)
    w = np.concatenate([ids[h[got]], *vs]).astype(np.int64)
    c = np.concatenate([links[got], np.zeros(len(u) - len(got), np.int64)])
    return pa.table({"u": u, "v": w, "links": c})


def assigned(part, r: float):
    """For a part of a cell and the cell's pivots: its rows, their nearest pivot, and (row, pivot) of the copies to other pivots."""
    lead = part.column("pivot").to_numpy(zero_copy_only=False).astype(bool)
    rows = part.take(np.flatnonzero(~lead))
    e = matrix(part.column("e"))
    pivots, m = unit(e[lead]), unit(e[~lead])
    d = np.sqrt(np.maximum(0, 2 - 2 * m @ pivots.T))
    gaps = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    own = d.argmin(1)
    a = d[np.arange(len(d)), own]
    reach = (d - a[:, None] <= 2 * r) & (d**2 - (a**2)[:, None] <= 2 * r * gaps[own] + 1e-7)
    reach[np.arange(len(d)), own] = False
    return rows, own, *np.nonzero(reach), len(pivots)


def worth(part, r: float):
    """Growth of the rows and share of the comparisons left if this part of a cell were split."""
    import pyarrow as pa

    rows, own, _, to, p = assigned(part, r)
    home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
    h = np.bincount(own[home], minlength=p)
    every = np.bincount(np.append(own, to), minlength=p)
    left = float((h * every).sum()) / max(1, int(home.sum()) * len(own))
    return pa.table({"label": part.column("label").slice(0, 1), "cell": part.column("cell").slice(0, 1), "growth": [float(every.sum()) / max(1, len(own))], "left": [left]})


def children(part, r: float, fan: int):
    import pyarrow as pa

    rows, own, i, to, _ = assigned(part, r)
    take = rows.take(pa.array(np.append(np.arange(len(own)), i)))
    home = take.column("home").to_numpy(zero_copy_only=False).astype(bool)
    home[len(own) :] = False
    cell = take.column("cell").to_numpy() * fan + np.append(own, to) + 1
    return pa.table({"label": take.column("label"), "cell": pa.array(cell, pa.int64()), "home": home, "id": take.column("id"), "n": take.column("n"), "e": take.column("e")})


def near_vectors(rows: DataFrame, scratch: Scratch, *, cos: float = 0.98, cell: int = 16, fan: int = 16, share: int = 16384, home_rows: int = 2048, other_rows: int = 16384) -> DataFrame:
    """vec_id, n_links, component_id for each row of rows(vec_id, embedding, label)."""
    ok = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    named = rows.select("vec_id", "embedding", "label", ok.alias("ok"))
    good = named.filter("ok").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(9), "embedding", "label").alias("k2"))
    reps = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("e"), F.any_value("label").alias("label"))
    reps = scratch.save(reps.withColumn("id", F.monotonically_increasing_id()))  # numbers hold once they are written
    r = math.sqrt(2 - 2 * cos) + 1e-7
    kind = dict(reps.dtypes)
    schema = f"label {kind['label']}, cell long, home boolean, id long, n long, e {kind['e']}"
    dealt = reps.select("label", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "id", "n", "e")
    of = ["label", "cell"]
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    level, done = 0, []
    while True:
        most = home_rows if level else cell
        sizes = dealt.groupBy(*of).agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("a")).filter(F.col("h") > most)
        large = scratch.save(sizes.select(*of, F.least(F.lit(fan), F.ceil(F.col("h") / most)).alias("p"), F.ceil(F.col("a") / share).cast("int").alias("parts")))
        if not large.take(1):
            break
        drawn = W.partitionBy(*of).orderBy(F.xxhash64(F.lit(level), "id"), "id")
        pivots = dealt.filter("home").join(large, of).withColumn("o", F.row_number().over(drawn)).filter(F.col("o") <= F.col("p"))
        pivots = pivots.select(*of, F.explode(every("parts")).alias("part"), F.lit(True).alias("pivot"), "home", "id", "n", "e")
        tiles = dealt.join(large, of).select(*of, F.pmod(F.xxhash64(F.lit(20 + level), "id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("pivot"), "home", "id", "n", "e")
        tiles = tiles.unionByName(scratch.save(pivots))
        gain = tiles.filter("part = 0").groupBy(*of).applyInArrow(lambda t: worth(t, r), f"label {kind['label']}, cell long, growth double, left double")
        good_split = F.col("growth") * F.col("left") <= 2
        split = scratch.save(gain.filter(good_split & (F.col("left") <= 0.75) if level else good_split | (F.col("growth") <= 4)).select(*of))
        if not split.take(1):
            break
        done.append(dealt.join(split, of, "left_anti"))
        dealt = scratch.save(tiles.join(split, of, "left_semi").groupBy(*of, "part").applyInArrow(lambda t: children(t, r, fan), schema))
        level += 1
    for x in done:
        dealt = dealt.unionByName(x)
    # blocks: the home rows of a cell against all its rows, both cut by a hash of the id
    size = dealt.groupBy(*of).agg(F.ceil(F.count_if("home") / home_rows).cast("int").alias("hb"), F.ceil(F.count(F.lit(1)) / other_rows).cast("int").alias("ab")).filter("hb > 0")
    sized = dealt.join(size, of)
    place = lambda n: F.pmod(F.xxhash64(F.lit(4), "id"), F.col(n)).cast("int")
    cols = ["label", "cell", "id", "n", "e"]
    homes = sized.filter("home").withColumn("x", place("hb")).select(*cols, "home", "x", F.explode(every("ab")).alias("y"))
    others = sized.withColumn("y", place("ab")).withColumn("home", F.lit(False)).select(*cols, "home", F.explode(every("hb")).alias("x"), "y")
    blocks = homes.unionByName(others).groupBy("label", "cell", "x", "y")
    met = scratch.save(blocks.applyInArrow(lambda t: join_block(t, cos), "u long, v long, links long"))
    links = met.filter("u = v").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    comp = components(scratch, met.filter("u <> v").select("u", "v"))
    known = scratch.save(reps.select("k1", "k2", "id", "first", "n").join(links, "id", "left").join(comp, "id", "left").select("k1", "k2", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("c")))
    first = known.groupBy("c").agg(F.min("first").alias("component_id"))
    done = good.select("vec_id", "k1", "k2").join(known.join(first, "c"), ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = named.filter("not ok").select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return done.union(alone)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT c.id, l.w FROM c JOIN l ON c.r = l.u),
m AS (SELECT id, min(r) AS component_id FROM c GROUP BY id)
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.u = m.id) AS n_links, component_id, id = component_id AS kept FROM m
"""
