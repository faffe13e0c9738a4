"""MinHash near-dedup with dart throwing.

A document is a weighted set: its shingles of five words (lower-cased), each weighted by its number of occurrences.
Similarity is the weighted Jaccard index, sum of minima over sum of maxima, and documents of
similarity >= 0.8 are linked; classes are the connected components.

Signatures.  Every element (shingle, w) owns a region of width w, cut into unit cells.  Onto each cell darts
fall at times of a Poisson process that is drawn from a hash of the cell, so that two documents see the
same darts where their regions overlap.  Each dart hits one of k coordinates; the earliest dart of a
coordinate is its value, and two documents share it with a probability equal to their similarity.
Darts are thrown until a time at which about k ln k + 3k have fallen, whatever the size of the document, and
twice as long for those documents where a coordinate is still empty.

Candidates.  32 bands of 4 coordinates make buckets; a pair of similarity 0.8 misses all of them with a
probability of 5e-8.  Within a bucket no pairs are listed.  First its smallest id leads and is held against all
other members, which settles groups around one original.  In buckets that still hold several classes, the
members outside the largest one are then held against all members of other classes, in
blocks of bounded size that return a spanning forest of the links they find.  A pair that shares several buckets is
compared in the first.  Every comparison is exact, from the texts' shingles.

Work is on distinct texts, each with a number of its own, so that ids may repeat.

Defined cases: equal texts are one class from the start, empty ones too; texts without words are linked with equal
texts only; texts of fewer than five words have one shingle; null texts and rows with a null id are classes of their own; rows that repeat
an id with other texts count as one document with the links of each text in ``near_classes``, while ``keep_one`` judges every text by
itself, so that no text goes without a near copy that stays; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, buffers, components, hash_range, mix64, shingle_hashes, slices, table, word_hashes
from .op8_embeddings import forest

_ODD = hash_range(4096, 0xDA27) | np.uint64(1)


def weighted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) in order, with their numbers of occurrences."""
    o = np.lexsort((key, doc))
    doc, key = doc[o], key[o]
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[cut], key[cut], np.diff(np.append(cut, len(doc))).astype(np.float64)


def unit_float(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(n: int, doc: np.ndarray, key: np.ndarray, weight: np.ndarray, k: int = 128) -> np.ndarray:
    """n x k values for weighted sets given as (doc, key, weight), each (doc, key) once; 0 where a set is empty."""
    cells = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), cells)
    level = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    with np.errstate(over="ignore"):
        cell = mix64(key[row] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    width = np.minimum(1.0, weight[row] - level)  # less than 1 in the last cell of a fractional weight
    owner = doc[row]
    mass = np.bincount(doc, weight, minlength=n)
    until = np.zeros(n)
    until[mass > 0] = k * (np.log(k) + 3) / mass[mass > 0]
    out = np.zeros((n, k), np.uint64)
    todo = mass > 0
    while todo.any():
        at = np.flatnonzero(todo[owner])
        live, own, w, t = cell[at], owner[at], width[at], np.zeros(len(at))
        slots, times, darts = [], [], []
        j = 0
        while len(live):
            with np.errstate(over="ignore"):
                h = mix64(live + _ODD[j % 4096] * np.uint64(2 * (j // 4096) + 1))
                t = t - np.log(unit_float(h))
                keep = t < until[own]
                live, own, w, t, h = live[keep], own[keep], w[keep], t[keep], h[keep]
                g = mix64(h ^ np.uint64(0xC0FFEE123456789))
            hit = slice(None) if (w >= 1).all() else unit_float(mix64(g)) <= w  # where in the cell it falls
            slots.append((own * k + (g % np.uint64(k)).astype(np.int64))[hit])
            times.append(t[hit])
            darts.append(g[hit])
            j += 1
        slot, time, dart = np.concatenate(slots), np.concatenate(times), np.concatenate(darts)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, slot, time)
        first = time == best[slot]
        flat = out.reshape(-1)
        flat[slot[first]] = dart[first] | np.uint64(1)
        empty = (out == 0).any(axis=1) & todo
        out[empty] = 0
        until[empty] *= 2
        todo = empty
    return out


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys of buckets."""
    s = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    h = np.zeros(s.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
        h = mix64(h + np.arange(bands, dtype=np.uint64))
    return h.astype(np.int64)


def shingles(texts):
    """For pieces of an Arrow string array: first text, number of texts, and (text, shingle, occurrences)."""
    import pyarrow.compute as pc

    data, off = buffers(pc.utf8_lower(texts))
    for i, j in slices(off, 1 << 20):
        words, doc, _, _ = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        h, d = shingle_hashes(words, doc)
        yield i, j - i, weighted(d, h)


def similarity(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Weighted Jaccard of two sets as sorted keys and their weights."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a
    low = np.minimum(na[same], nb[at[same]]).sum()
    total = na.sum() + nb.sum() - low
    return float(low / total) if total else 0.0


def verify(pairs: DataFrame, texts: DataFrame, least: float, share: int = 128) -> DataFrame:
    """Those of pairs(a, b) with similarity >= least; texts(id, text).

    A leader's text is sent once to every ``share`` of its partners, with theirs, and compared in a stream.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts"))
    second = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    leaders = many.join(texts.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    partners = second.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
    rows = leaders.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(parts):
        import pyarrow as pa

        lead = mine = None
        for whole in parts:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                us, vs = [], []
                for i, n, (doc, key, count) in shingles(batch.column("text")):
                    cut = np.searchsorted(doc, np.arange(n + 1))
                    for r in range(n):
                        own = key[cut[r] : cut[r + 1]], count[cut[r] : cut[r + 1]]
                        if b[i + r] is None:
                            lead, mine = a[i + r], own
                        elif lead == a[i + r] and len(own[0]) and len(mine[0]) and similarity(*mine, *own) >= least:
                            us.append(lead)
                            vs.append(b[i + r])
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def join_bucket(part, least: float):
    """Links between leading rows and the others of one block of a bucket, as a spanning forest."""
    import pyarrow as pa

    lead = part.column("lead").to_numpy(zero_copy_only=False).astype(bool)
    home = part.column("home").to_numpy(zero_copy_only=False).astype(bool)
    ids, cls, mass = (part.column(k).to_numpy() for k in ("id", "c", "mass"))
    bands = np.frombuffer(b"".join(part.column("bands").to_pylist()), ">i8").astype(np.int64).reshape(len(ids), -1)
    band = int(np.flatnonzero(bands[0] == part.column("bucket")[0].as_py())[0])
    got = [(doc + i, key, count) for i, _, (doc, key, count) in shingles(part.column("text"))]
    doc, key, count = (np.concatenate(x) for x in zip(*got, strict=True))
    size, place = 0, key
    if len(key):
        distinct, place = np.unique(key, return_inverse=True)
        size = len(distinct)
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    other = np.flatnonzero(~lead)
    us, vs = [], []
    for h in np.flatnonzero(lead):
        want = (cls[other] != cls[h]) & (np.minimum(mass[other], mass[h]) >= least * np.maximum(mass[other], mass[h]))
        want &= ~home[other] | (ids[other] > ids[h])  # both lead: once
        want &= ~(bands[other, :band] == bands[h, :band]).any(axis=1)  # they met in an earlier bucket
        todo = other[want]
        if not len(todo):
            continue
        own = np.zeros(size)
        own[place[cut[h] : cut[h + 1]]] = count[cut[h] : cut[h + 1]]
        n = cut[todo + 1] - cut[todo]
        at = np.repeat(cut[todo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        low = np.add.reduceat(np.minimum(own[place[at]], count[at]), np.cumsum(n) - n)
        hit = todo[low >= least * (mass[h] + mass[todo] - low)]
        us.append(np.full(len(hit), h))
        vs.append(hit)
    i = np.concatenate(us) if us else np.zeros(0, np.int64)
    j = np.concatenate(vs) if vs else np.zeros(0, np.int64)
    if not len(i):
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    u, v = forest(i, j, ids.astype(np.int64))
    return pa.table({"u": u[u != v], "v": v[u != v]})


def whole() -> Column:
    """Rows that take part in comparisons."""
    return F.col("doc_id").isNotNull() & F.col("text").isNotNull()


def text_keys(a: str = "k1", b: str = "k2") -> list[Column]:
    return [F.xxhash64("text").alias(a), F.xxhash64(F.lit(8), "text").alias(b)]


def text_classes(docs: DataFrame, scratch: Scratch, *, least: float = 0.8, bands: int = 32, rows: int = 4, home_bytes: int = 2_000_000, other_bytes: int = 8_000_000) -> DataFrame:
    """The distinct texts of docs(doc_id, text): k1, k2 (hashes), id (a number of the text), first (smallest doc_id), c (smallest id of the class)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = named.filter(whole()).select("doc_id", *text_keys(), "text")

    def sketch(parts):
        import pyarrow as pa

        for b in parts:
            if not b.num_rows:
                continue
            mass, keys = np.zeros(b.num_rows), np.zeros((b.num_rows, bands), np.int64)
            for i, n, (doc, key, count) in shingles(b.column(3)):
                mass[i : i + n] = np.bincount(doc, count, minlength=n)
                keys[i : i + n] = bands_of(dart_signatures(n, doc, key, count, bands * rows), bands, rows)
            lists = [k.tobytes() if m else None for k, m in zip(keys.astype(">i8"), mass, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(mass), pa.array(lists, pa.binary())], ["doc_id", "k1", "k2", "mass", "bands"])

    sketched = keyed.mapInArrow(sketch, "doc_id long, k1 long, k2 long, mass double, bands binary")
    groups = sketched.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min("mass").alias("mass"), F.min("bands").alias("bands"))
    groups = scratch.save(groups.withColumn("id", F.monotonically_increasing_id()))  # numbers hold once they are written
    # the i-th 8 bytes of the packed keys, most significant first, name a bucket
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring(F.hex("bands"), i * 16 + 1, F.lit(16)))
    dealt = groups.filter("bands is not null").select("id", "mass", F.explode(keys).alias("hex")).select("id", "mass", F.conv("hex", 16, -10).cast("long").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = scratch.save(dealt.join(shared, "bucket").distinct())
    chosen = groups.select("id", F.col("first").alias("doc_id"), "k1", "k2").join(members.select("id").distinct(), "id", "left_semi")
    same = ["doc_id", "k1", "k2"]  # repeated rows of one document carry its text once
    texts = scratch.save(keyed.join(chosen, same).dropDuplicates(same).select("id", "text"))
    head = members.groupBy("bucket").agg(F.min(F.struct("id", "mass")).alias("m")).select("bucket", F.col("m.id").alias("a"), F.col("m.mass").alias("ma"))
    near = (F.least("ma", "mass") >= least * F.greatest("ma", "mass")) & (F.col("a") != F.col("id"))
    pairs = scratch.save(members.join(head, "bucket").filter(near).select("a", F.col("id").alias("b")).distinct())
    links = scratch.save(verify(pairs, texts, least))
    comp = components(scratch, links)
    now = scratch.save(members.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"))
    sizes = now.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("bucket", F.col("top.c").alias("top"))
    open_ = now.join(main, "bucket").withColumn("home", F.col("c") != F.col("top")).drop("top")
    full = open_.join(groups.select("id", "bands"), "id").join(texts, "id").withColumn("len", F.octet_length("text"))
    cut = full.groupBy("bucket").agg(F.ceil(F.sum(F.when(F.col("home"), F.col("len"))) / home_bytes).cast("int").alias("hb"), F.ceil(F.sum("len") / other_bytes).cast("int").alias("ab"))
    rows_ = full.join(cut, "bucket")
    place = lambda n: F.pmod(F.xxhash64(F.lit(4), "id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ["bucket", "id", "c", "mass", "bands", "text", "home"]
    homes = rows_.filter("home").withColumn("x", place("hb")).select(*cols, F.lit(True).alias("lead"), "x", F.explode(every("ab")).alias("y"))
    others = rows_.withColumn("y", place("ab")).select(*cols, F.lit(False).alias("lead"), F.explode(every("hb")).alias("x"), "y")
    more = scratch.save(homes.unionByName(others).groupBy("bucket", "x", "y").applyInArrow(lambda t: join_bucket(t, least), "u long, v long"))
    comp = components(scratch, more.union(comp.select(F.col("id").alias("u"), F.col("component").alias("v"))))
    return groups.join(comp, "id", "left").select("k1", "k2", "id", "first", F.coalesce("component", "id").alias("c"))


def near_classes(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """doc_id, class_id for each row of docs(doc_id, text)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = scratch.save(text_classes(docs, scratch, **how))
    rows = scratch.save(named.filter(whole()).select("doc_id", *text_keys()).join(texts, ["k1", "k2"]).select("doc_id", "c"))
    # the texts of a repeated id bring their classes together
    several = rows.groupBy("doc_id").agg(F.min("c").alias("u"), F.max("c").alias("top")).filter("u < top").select("doc_id", "u")
    joint = components(scratch, rows.join(several, "doc_id").select("u", F.col("c").alias("v")))
    joined = rows.join(joint.withColumnRenamed("id", "c"), "c", "left").select("doc_id", F.coalesce("component", "c").alias("c"))
    first = texts.join(joint.withColumnRenamed("id", "c"), "c", "left").groupBy(F.coalesce("component", "c").alias("c")).agg(F.min("first").alias("class_id"))
    return joined.join(first, "c").select("doc_id", "class_id").union(named.filter(~whole()).select("doc_id", F.col("doc_id").alias("class_id")))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with one row of each class of texts: that of the smallest doc_id, then text hash, then hash of the whole row.

    Rows with a null id or a null text stay.
    """
    texts = text_classes(docs, scratch)
    kept = texts.groupBy("c").agg(F.min(F.struct("first", "k1", "k2")).alias("m"))
    kept = kept.select(F.col("m.first").alias("__lg_id"), F.col("m.k1").alias("__lg_k1"), F.col("m.k2").alias("__lg_k2"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.filter(whole()).select(*own, F.col("doc_id").cast("long").alias("__lg_id"), *text_keys("__lg_k1", "__lg_k2"), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias("__lg_row"))
    chosen = tagged.join(kept, ["__lg_id", "__lg_k1", "__lg_k2"], "left_semi")
    one = W.partitionBy("__lg_id", "__lg_k1", "__lg_k2").orderBy("__lg_row")
    return chosen.withColumn("__lg_n", F.row_number().over(one)).filter("__lg_n = 1").select(*own).unionByName(docs.filter(~whole()))
