"""Removal of repeated byte strings by longest-previous-factor arrays over sharded suffixes.

A byte goes if it lies in a string of ``span`` (50) bytes that also starts in a document with a smaller
doc_id; strings are judged on the input and never cross documents.

Sharding the suffixes.  Each start of a 50-byte string is filed under its minimizer, the least of the
hashes of the ``gram``-byte substrings in it.  Equal strings have equal minimizers, so all their starts meet in
one shard.  Consecutive starts with one minimizer form a run of at most 35, whose bytes are a slice.

In any order that puts equal strings side by side, the longest factor that a string shares with a smaller document is read
from the previous and the next smaller position: the nearest places before and after it with a smaller document, and the
least common prefix on the way there (``previous_factors``).  Where that reaches 50 bytes, the start goes.

1. Every run sends (minimizer, hash of its slice, document, number of the run) to its shard.  There, in the
   order of the slices' hashes, the common prefix of equal neighbours is the whole slice, of others 0: a slice with a longest previous
   factor goes as a whole.  For minimizers with more than one slice, each slice's first document is asked for its bytes.
2. These slices meet again in their shard: all starts are put in suffix order (to a depth of 50 bytes), common prefixes of neighbours
   are found in words of 8 bytes, and starts with a longest previous factor of 50 bytes go.
3. Documents join their marks, a 64-bit mask for each marked run.

Hashes that name a slice have over 96 bits.  Shards hold about ``shard_runs`` runs.

Frequent passages and minimizers.  Before the shuffle each batch of documents keeps, of every slice, the runs of
its smallest document only; those of its later documents are marked there and travel as marks, dealt evenly.  A
minimizer that has a shard's worth of different slices, by its share of a batch, is spread: its slices go by their
names, and a token tells the minimizer's own shard, where batches that saw few of them sent theirs.  All first
slices of such a minimizer, and of one that fills a shard by itself, are asked for, and step 2 deals their starts one by
one, by a hash of the 50 bytes; equal strings still meet.

Defined cases: a null text is empty; texts under 50 bytes stay; rows with a null doc_id stay and remove
nothing; of rows that repeat a doc_id each is treated as that document (they do not remove one
another); an empty table gives an empty result; texts of any length are taken whole; other columns pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, buffers, hash_range, mix64, slices, table

_BYTE = hash_range(256, 0x7E47)
_STEP = hash_range(8, 0x57E9) | np.uint64(1)


def runs_of(data: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """Runs of starts with one minimizer: text, first start, number of starts, minimizer, slice hash.

    Starts count from the beginning of ``data``; runs are in the order of their starts.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - span + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    with np.errstate(over="ignore"):
        powers, size, k = {1: _BYTE[data]}, 1, 0
        while size * 2 <= span:
            h = powers[size]
            powers[size * 2] = h[:-size] * _STEP[k] + h[size:]
            size, k = size * 2, k + 1
        cover = lambda m: powers[s] if (s := 1 << (m.bit_length() - 1)) == m else powers[s][: len(data) - m + 1] * _STEP[7] + powers[s][m - s : len(data) - s + 1]
        whole, g = cover(span), mix64(cover(gram))
        del powers
        width, size, low = span - gram + 1, 1, g
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: n], low[width - size : width - size + n])
        length = np.diff(offsets)
        good = np.zeros(n + 1, np.int32)  # starts whose string stays within its text
        has = length >= span
        np.add.at(good, offsets[:-1][has], 1)
        np.add.at(good, np.minimum(offsets[1:][has] - span + 1, n), -1)
        good = np.cumsum(good[:-1]) > 0
        new = np.append(True, low[1:] != low[:-1])
        cut = offsets[:-1][has]
        new[cut[cut < n]] = True
        new[1:] |= good[1:] != good[:-1]
        first = np.flatnonzero(new & good)
        edge = np.flatnonzero(new | ~good)
        after = np.searchsorted(edge, first, side="right")
        end = np.where(after < len(edge), edge[np.minimum(after, len(edge) - 1)], n)
        count = end - first
        many = -(-count // width)
        if (many > 1).any():  # periodic text: pieces of at most ``width`` starts
            part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            first, end = np.repeat(first, many) + part * width, np.repeat(end, many)
            count = np.minimum(end - first, width)
        doc = np.searchsorted(offsets, first, side="right") - 1
        name = mix64(whole[first] * _STEP[5] + mix64(whole[first + count - 1]) + count.astype(np.uint64))
        return doc, first, count, low[first], name


def numbered(doc: np.ndarray) -> np.ndarray:
    """Number of each run within its text; doc ascends."""
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    return np.arange(len(doc)) - np.repeat(cut, np.diff(np.append(cut, len(doc))))


def texts_runs(texts, span: int, gram: int):
    """For pieces of an Arrow string array: data, offsets, first text, and the runs."""
    data, off = buffers(texts)
    for i, j in slices(off, 1 << 20):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        yield part, o, i, runs_of(part, o, span, gram)


# what a blob of the first shuffle holds: runs by minimizer, runs of a spread minimizer by name, marks, tokens
PLAIN, SPREAD, MARKED, TOKEN = range(4)
# what a row of marks asks for: nothing (it is a mask), the slices, the slices start by start
MASK, ASK, ASK_STARTS = range(3)


def previous_factors(doc: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place of a sorted order the longest prefix shared with a smaller document, exact where it is ``least`` or more.

    ``common`` holds the common prefix of each place and the one before it.  The previous smaller position is found by
    following each place's present candidate to that one's own, which doubles the way in every pass; the least common
    prefix on the way is carried along, and a place whose prefix falls below ``least`` is given up.
    """

    def one_side(doc, low):
        at = np.arange(len(doc)) - 1
        live = np.flatnonzero(low >= least)
        live = live[doc[at[live]] >= doc[live]]
        while len(live):
            j = at[live]
            low[live], at[live] = np.minimum(low[live], low[j]), at[j]
            live = live[low[live] >= least]
            live = live[doc[at[live]] >= doc[live]]
        return low

    if not len(doc):
        return common
    before = np.append(0, common[1:])
    after = np.append(0, common[:0:-1])
    return np.maximum(one_side(doc, before), one_side(doc[::-1], after)[::-1])


def batch_firsts(ids, name, low, span):
    """Which runs belong to the smallest document of their batch that has their slice: those without a previous factor in the batch."""
    o = np.argsort(name, kind="stable")
    same = (name[o][1:] == name[o][:-1]) & (low[o][1:] == low[o][:-1])
    first = np.ones(len(o), bool)
    first[o] = previous_factors(ids[o], np.append(0, np.where(same, span, 0)).astype(np.int64)[: len(o)], span) < span
    return first


def full_mask(count):
    return (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)


def first_reduce(blobs, shard_runs: int, span: int):
    """Rows (doc, ask, run numbers, masks) of one shard."""
    got = {k: [[], [], [], [], []] for k in range(4)}
    for b in blobs.to_pylist():
        docs = np.repeat(np.frombuffer(b["docs"], np.int64), np.frombuffer(b["per"], np.uint32))
        columns = np.frombuffer(b["keys"], np.uint32), np.frombuffer(b["names"], np.uint64), docs, np.frombuffer(b["runs"], np.uint32), np.frombuffer(b["counts"], np.uint8)
        for x, y in zip(got[b["kind"]], columns, strict=True):
            x.append(y)
    joined = {k: [np.concatenate(x) for x in v] for k, v in got.items() if v[0]}
    tokens = np.unique(joined[TOKEN][0]) if TOKEN in joined else np.zeros(0, np.uint32)
    out = []
    if MARKED in joined:
        _, _, doc, run, count = joined[MARKED]
        out.append((doc, run, full_mask(count), np.full(len(doc), MASK)))
    for kind in (PLAIN, SPREAD):
        if kind not in joined:
            continue
        key, name, doc, run, count = joined[kind]
        o = np.lexsort((name, key))
        key, name, doc, run, count = key[o], name[o], doc[o], run[o], count[o]
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, name[1:] != name[:-1])
        later = previous_factors(doc, np.where(new, 0, count.astype(np.int64) + span - 1), span) >= span
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        spread = (kinds >= shard_runs) | np.isin(key, tokens) | (kind == SPREAD)
        ask = np.where(later, MASK, np.where(spread, ASK_STARTS, ASK))
        take = later | spread | (kinds > 1)
        out.append((doc[take], run[take], np.where(later, full_mask(count), np.uint64(0))[take], ask[take]))
    if not out:
        return packed(*(np.zeros(0, t) for t in (np.int64, np.uint32, np.uint64, np.int64)))
    doc, run, mask, ask = (np.concatenate(x) for x in zip(*out, strict=True))
    o = np.lexsort((run, ask, doc))
    return packed(doc[o], run[o], mask[o], ask[o])


def packed(doc, run, mask, ask):
    import pyarrow as pa

    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (ask[1:] != ask[:-1]))) if len(doc) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(doc)) if len(cut) else cut
    r, m = run.astype(np.uint32), mask.astype(np.uint64)
    return pa.table(
        {
            "doc": pa.array(doc[cut], pa.int64()),
            "ask": pa.array(ask[cut], pa.int32()),
            "runs": pa.array([r[i:j].tobytes() for i, j in zip(cut, end, strict=True)], pa.binary()),
            "masks": pa.array([m[i:j].tobytes() for i, j in zip(cut, end, strict=True)], pa.binary()),
        }
    )


def suffix_reduce(rows, span: int):
    """Masks for the asked runs of one shard, by suffix order and longest previous factors.

    ``at`` is the number of the first start within its run that a row holds.
    """
    import pyarrow as pa

    docs = rows.column("doc").to_numpy()
    runs = rows.column("run").to_numpy()
    begin = rows.column("at").to_numpy()
    col = rows.column("bytes").combine_chunks()
    _, off, data = (col if isinstance(col, pa.Array) else col.chunk(0)).buffers()
    base = col.offset if isinstance(col, pa.Array) else col.chunk(0).offset
    offsets = np.frombuffer(off, np.int32)[base : base + len(docs) + 1].astype(np.int64)
    text = np.append(np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))
    count = np.diff(offsets) - span + 1
    row = np.repeat(np.arange(len(docs)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + within
    # eight bytes from each place, most significant first, so that integer order is suffix order
    word = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | text[k : k + len(word)]
    places = [*range(0, span - 7, 8)]
    if places[-1] + 8 < span:
        places.append(span - 8)
    doc = docs[row]
    columns = [word[start + p] for p in places]
    order = np.lexsort(columns[::-1])
    common = np.zeros(len(order), np.int64)  # of neighbours in suffix order, in whole words, ``span`` where all agree
    same = np.ones(max(0, len(order) - 1), bool)
    for p, c in zip(places, columns, strict=True):
        same &= c[order[1:]] == c[order[:-1]]
        common[1:][same] = p + 8
    gone = np.zeros(len(order), bool)
    gone[order] = previous_factors(doc[order], common, span) >= span
    bits = np.where(gone, np.uint64(1) << (begin[row] + within).astype(np.uint64), np.uint64(0))
    first = np.cumsum(count) - count
    mask = np.bitwise_or.reduceat(bits, first) if len(first) else np.zeros(0, np.uint64)
    hit = np.flatnonzero(mask)
    o = hit[np.lexsort((runs[hit], docs[hit]))]
    return packed(docs[o], runs[o], mask[o], np.full(len(o), MASK))


MARKS = "doc long, ask int, runs binary, masks binary"
BLOB = ["keys", "names", "docs", "per", "runs", "counts"]
MARK_RUNS = 50_000


def remove_repeats(docs: DataFrame, scratch: Scratch, *, span: int = 50, gram: int = 20, shard_runs: int = 250_000) -> DataFrame:
    """docs with a struct __lg_cut(n_bytes, n_removed, n_spans, kept binary)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= span))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, int(size / (span - gram + 2) * 2 / shard_runs) + 1)

    def send(parts):
        import pyarrow as pa

        for b in parts:
            ids = b.column(0).to_numpy().astype(np.int64)
            got = [[], [], [], [], []]
            for _, _, i, (doc, _, count, low, name) in texts_runs(b.column(1), span, gram):
                for x, y in zip(got, (doc + i, numbered(doc).astype(np.uint32), count.astype(np.uint8), low, name), strict=True):
                    x.append(y)
            if not got[0]:
                continue
            doc, run, count, low, name = (np.concatenate(x) for x in got)
            key = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            shard = ((low >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            first = batch_firsts(ids[doc], name, low, span)
            kind = np.where(first, PLAIN, MARKED)
            # marks of the batch: dealt in pieces, whatever their minimizer
            marked = np.flatnonzero(~first)
            shard[marked] = (int(name[0] % np.uint64(shards)) + np.arange(len(marked)) // MARK_RUNS) % shards
            # minimizers with a shard's worth of slices by their share of this batch
            of = np.flatnonzero(first)
            seen, back, n = np.unique(low[of], return_inverse=True, return_counts=True)
            many = n >= max(4, 2 * len(low) / shards)
            tokens = seen[many]
            spread = of[many[back]]
            kind[spread] = SPREAD
            shard[spread] = (mix64(name[spread]) % np.uint64(shards)).astype(np.int64)
            out = {k: [] for k in ("shard", "kind", *BLOB)}

            def put(s, k, w, out=out, key=key, name=name, doc=doc, run=run, count=count):
                d, per = np.unique(doc[w], return_counts=True)
                named = k != MARKED
                for c, x in zip(out, (int(s), int(k), key[w] if named else key[:0], name[w] if named else name[:0], ids[d], per.astype(np.uint32), run[w], count[w]), strict=True):
                    out[c].append(x if isinstance(x, int) else x.tobytes())

            group = shard * 4 + kind
            o = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.append(True, group[o][1:] != group[o][:-1]))
            for i, j in zip(cut, np.append(cut[1:], len(o)), strict=True):
                put(group[o[i]] // 4, group[o[i]] % 4, o[i:j])
            for t in tokens:
                out["shard"].append(int((t >> np.uint64(32)) % np.uint64(shards)))
                out["kind"].append(TOKEN)
                out["keys"].append(np.uint32(t & np.uint64(0xFFFFFFFF)).tobytes())
                for c in BLOB[1:]:
                    out[c].append(b"")
            yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["kind"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in BLOB]], list(out))

    blobs = src.mapInArrow(send, "shard int, kind int, " + ", ".join(f"{k} binary" for k in BLOB))
    marks = scratch.save(blobs.groupBy("shard").applyInArrow(lambda t: first_reduce(t, shard_runs, span), MARKS))
    asks = marks.filter(F.col("ask") > MASK).groupBy("doc").agg(F.collect_list(F.struct("runs", (F.col("ask") == ASK_STARTS).alias("each"))).alias("runs"))

    def answer(parts):
        import pyarrow as pa

        for b in parts:
            ids = b.column(0).to_numpy().astype(np.int64)
            asked = b.column(2)
            for part, _, i, (doc, first, count, low, _) in texts_runs(b.column(1), span, gram):
                begin = np.searchsorted(doc, np.arange(doc[-1] + 2)) if len(doc) else [0, 0]
                want = [(d, x) for d in range(len(begin) - 1) for x in asked[i + d].as_py()]
                if not want:
                    continue
                picks = [begin[d] + np.frombuffer(x["runs"], np.uint32) for d, x in want]
                each = np.repeat([x["each"] for _, x in want], [len(p) for p in picks])
                pick = np.concatenate(picks)
                raw = part.tobytes()
                shard = (low[pick] >> np.uint64(32)) % np.uint64(shards)
                # whole slices, and the starts of spread ones
                n = np.where(each, count[pick], 1)
                row = np.repeat(np.arange(len(pick)), n)
                start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begins = first[pick][row] + start
                texts = [raw[f : f + c + span - 1] for f, c in zip(begins.tolist(), np.where(each, 1, count[pick])[row].tolist(), strict=True)]
                to = shard[row]
                alone = np.flatnonzero(each[row])
                to[alone] = [zlib.crc32(texts[k]) for k in alone]
                to %= np.uint64(shards)
                run = (pick - np.asarray(begin)[doc[pick]])[row].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(ids[doc[pick] + i][row]), pa.array(run), pa.array(start.astype(np.int32)), pa.array(texts, pa.binary())], ["shard", "doc", "run", "at", "bytes"])

    slices_ = src.join(asks, "doc").mapInArrow(answer, "shard int, doc long, run int, at int, bytes binary")
    more = scratch.save(slices_.groupBy("shard").applyInArrow(lambda t: suffix_reduce(t, span), MARKS))
    cuts = marks.filter(F.col("ask") == MASK).unionByName(more).groupBy(F.col("doc").alias("__lg_id")).agg(F.collect_list(F.struct("runs", "masks")).alias("__lg_marks"))
    own, at = docs.columns, docs.columns.index("text")
    joined = docs.withColumn("__lg_id", F.col("doc_id").cast("long")).join(cuts, "__lg_id", "left").select(*[F.col(f"`{c}`") for c in own], "__lg_marks")
    stats = T.StructType([T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])

    def cut(parts):
        import pyarrow as pa

        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        for b in parts:
            marks, texts = b.column(len(own)), b.column(at)
            done = [None] * b.num_rows
            dirty = np.flatnonzero(np.asarray(marks.is_valid()))
            for k in np.flatnonzero(~np.asarray(marks.is_valid())):
                raw = (texts[k].as_py() or "").encode("utf-8", "surrogatepass")
                done[k] = {"n_bytes": len(raw), "n_removed": 0, "n_spans": 0, "kept": raw}
            for part, o, i, (doc, first, count, _, _) in texts_runs(texts.take(pa.array(dirty)), span, gram):
                begin = np.searchsorted(doc, np.arange(len(o)))
                delta = np.zeros(len(part) + 1, np.int32)
                for d in range(len(o) - 1):
                    m = marks[int(dirty[i + d])].as_py()
                    run = np.concatenate([np.frombuffer(x["runs"], np.uint32) for x in m]) + begin[d]
                    mask = np.concatenate([np.frombuffer(x["masks"], np.uint64) for x in m])
                    ok = run < begin[d + 1]  # another row of the same doc_id may have more runs
                    run, mask = run[ok], mask[ok]
                    bit = (mask[:, None] >> np.arange(span - gram + 1, dtype=np.uint64)) & np.uint64(1)
                    r, c = np.nonzero(bit)
                    s = first[run[r]] + c
                    s = s[c < count[run[r]]]
                    np.add.at(delta, s, 1)
                    np.add.at(delta, s + span, -1)
                gone = np.cumsum(delta[:-1]) > 0
                for d in range(len(o) - 1):
                    g = gone[o[d] : o[d + 1]]
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    done[dirty[i + d]] = {"n_bytes": len(g), "n_removed": int(g.sum()), "n_spans": spans, "kept": part[o[d] : o[d + 1]][~g].tobytes()}
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(own))], pa.array(done, kind)], [*own, "__lg_cut"])

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField("__lg_cut", stats)]))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    c = F.col("__lg_cut")
    return out.select("doc_id", c["n_bytes"].alias("n_bytes"), c["n_removed"].alias("n_removed"), c["n_spans"].alias("n_spans"), F.sha2(c["kept"], 256).alias("kept_sha256"))
