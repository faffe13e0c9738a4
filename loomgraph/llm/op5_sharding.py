"""Sharding by balanced label propagation, with DataFrame operations only.

Documents of equal text are linked.  Shards take equally many rows (law ``rows``: counts at most one
apart), and as few links as possible cross shards.

As linked documents of one group are interchangeable, the state of the propagation is a table of
(group, shard, number of members), not of documents and never of links.  Groups above a quota are first cut into
pieces of at most one quota.  Members start in hashed shards, dealt in turn.  In each round every group picks the shard
that holds most of it and can take the rest; its members elsewhere ask to move there; requests are granted by
size while there is room.  During the rounds a shard has room for twice its quota, so that groups can pass each other
also where all documents are linked.  Then every shard above its quota is drained: its smallest groups move, whole but
for those at the ends of the line, to the shards below theirs.  Documents without links have no wish; they fill
the shards up to their exact quotas.

Defined cases: a null text has size 1 and crc32 0 and is linked with nothing; an empty text is a text;
repeated rows are rows of their own; a null doc_id ranks like any other row; fewer rows than shards leave the last
shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, ranked, table

ORDER = ["doc_id", "__lg_key"]


def loads(state: DataFrame) -> dict[int, int]:
    """Linked members in each shard: one number for each shard comes to the driver."""
    from collections import Counter

    return Counter({r["s"]: r["load"] for r in state.groupBy("s").agg(F.sum("c").alias("load")).collect()})


def drained(state: DataFrame, cap: list[int], load: dict[int, int], buckets: int) -> DataFrame:
    """state with no shard above its quota: what lies beyond it, the smallest groups last, goes to shards below theirs."""
    over = [t for t in range(len(cap)) if load[t] > cap[t]]
    if not over:
        return state
    start, end, room = 0, 0, []
    first: dict[int, int] = {}
    for t in over:  # the members to move form one line, shard after shard, and so do the free places
        first[t] = start
        start += load[t] - cap[t]
    for t in range(len(cap)):
        if (free := cap[t] - load[t]) > 0:
            room.append(F.struct(F.lit(t).alias("t"), F.lit(end).cast("long").alias("lo"), F.lit(end + free).cast("long").alias("hi")))
            end += free
    quota = F.element_at(F.array(*[F.lit(c).cast("long") for c in cap]), F.col("s") + 1)
    base = F.element_at(F.array(*[F.lit(first.get(t, 0)).cast("long") for t in range(len(cap))]), F.col("s") + 1)
    lined = state.filter(F.col("s").isin(over)).withColumn("z", F.floor(F.log2(F.col("c").cast("double"))).cast("int")).withColumn("b", F.pmod(F.xxhash64(F.lit(6), "g"), F.lit(buckets)))
    sums = lined.groupBy("s", "z", "b").agg(F.sum("c").alias("n"))
    earlier = W.partitionBy("s").orderBy(F.desc("z"), "b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("s", "z", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("s", "z", "b").orderBy(F.desc("c"), "g").rowsBetween(W.unboundedPreceding, 0)
    upto = lined.join(sums, ["s", "z", "b"]).withColumn("upto", F.col("before") + F.sum("c").over(within) - quota)
    away = upto.filter("upto > 0").select("g", "s", (base + F.greatest(F.lit(0), F.col("upto") - F.col("c"))).alias("lo"), (base + F.col("upto")).alias("hi"))
    put = away.withColumn("to", F.explode(F.array(*room))).withColumn("k", F.least("hi", "to.hi") - F.greatest("lo", "to.lo")).filter("k > 0")
    delta = put.select("g", F.col("to.t").alias("s"), F.col("k").alias("c")).union(put.select("g", "s", -F.col("k")))
    return state.union(delta).groupBy("g", "s").agg(F.sum("c").alias("c")).filter("c > 0")


def shard(docs: DataFrame, scratch: Scratch, *, shards: int = 16, rounds: int = 10, block: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs."""
    key = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.concat(F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(3), "text"))))
    base = scratch.save(
        docs.select("doc_id", key.alias("__lg_key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    )
    n = base.count()
    sizes = base.filter("__lg_key is not null").groupBy("__lg_key").agg(F.count(F.lit(1)).alias("__lg_m")).filter("__lg_m > 1")
    cap = [n // shards + (t < n % shards) for t in range(shards)]
    least = max(1, n // shards)
    tagged = base.join(sizes, "__lg_key", "left")
    members = ranked(tagged.filter("__lg_m is not null"), ["__lg_key"], ["doc_id", "size"], "__lg_r", n)
    members = scratch.save(members.withColumn("g", F.concat_ws("/", "__lg_key", F.floor(F.col("__lg_r") / least).cast("string"))).withColumn("__lg_r", F.col("__lg_r") % least))
    # a group's members are dealt in turn, from a hashed shard on
    turn = F.pmod(F.col("s") - F.pmod(F.xxhash64(F.lit(7), "g"), F.lit(shards)), F.lit(shards))
    share = F.floor(F.col("m") / shards) + (turn < F.col("m") % shards).cast("long")
    state = members.groupBy("g").agg(F.count(F.lit(1)).alias("m")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    state = scratch.save(state.select("g", "s", share.cast("long").alias("c")).filter("c > 0"))
    bucket = max(1, -(-n // 200_000))
    for _ in range(rounds):
        load = loads(state)
        free = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(2 * cap[t] - load[t]).cast("long").alias("free")) for t in range(shards)])
        total = state.groupBy("g").agg(F.sum("c").alias("m"), F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("has"), F.count(F.lit(1)).alias("spread"))
        choice = F.expr(
            """array_max(transform(frees, x -> struct(
                 m - coalesce(try_element_at(has, x.t), 0L) <= x.free AS fits,
                 IF(m - coalesce(try_element_at(has, x.t), 0L) <= x.free, coalesce(try_element_at(has, x.t), 0L), x.free) AS gain,
                 xxhash64(g, x.t) AS tie, x.t AS t)))"""
        )
        goal = total.filter("spread > 1").withColumn("frees", free).withColumn("best", choice).filter("best.gain > 0 or best.fits").select("g", F.col("best.t").alias("t"), "m")
        asks = state.join(goal, "g").filter("s <> t").withColumn("b", F.pmod(F.xxhash64(F.lit(5), "g"), F.lit(bucket))).withColumn("z", F.floor(F.log2(F.col("m").cast("double"))).cast("int"))
        sums = asks.groupBy("t", "z", "b").agg(F.sum("c").alias("asked"))
        earlier = W.partitionBy("t").orderBy(F.desc("z"), "b").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select("t", "z", "b", F.coalesce(F.sum("asked").over(earlier), F.lit(0)).alias("before"))
        within = W.partitionBy("t", "z", "b").orderBy(F.desc("m"), "g", "s").rowsBetween(W.unboundedPreceding, -1)
        left = F.element_at(free, F.col("t") + 1)["free"] - F.col("before") - F.coalesce(F.sum("c").over(within), F.lit(0))
        moves = asks.join(sums, ["t", "z", "b"]).withColumn("k", F.greatest(F.lit(0), F.least("c", left))).filter("k > 0").select("g", "s", "t", "k")
        moves = scratch.save(moves)
        if not moves.take(1):
            break
        delta = moves.select("g", F.col("t").alias("s"), F.col("k").alias("c")).union(moves.select("g", "s", -F.col("k")))
        state = scratch.save(state.union(delta).groupBy("g", "s").agg(F.sum("c").alias("c")).filter("c > 0"))
    state = scratch.save(drained(state, cap, loads(state), bucket))
    # members to shards: the group's ranks are cut at the running sums of its counts; every ``block`` ranks have their own copy of the cuts
    upto = W.partitionBy("g").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    cuts = state.withColumn("hi", F.sum("c").over(upto)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("hi", "s"))).alias("cuts"), F.max("hi").alias("m"))
    cuts = cuts.select("g", "cuts", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / block))).alias("blk"))
    linked = members.withColumn("blk", F.floor(F.col("__lg_r") / block)).join(cuts, ["g", "blk"]).select("doc_id", "size", "text_crc32", F.expr("filter(cuts, x -> x.hi > __lg_r)[0].s").alias("shard"))
    load, upto = loads(state), 0
    fill = []
    for t in range(shards):
        upto += cap[t] - load[t]
        fill.append(F.struct(F.lit(upto).cast("long").alias("hi"), F.lit(t).alias("t")))
    singles = ranked(tagged.filter("__lg_m is null").select("doc_id", "size", "text_crc32"), [], ["doc_id", "text_crc32"], "__lg_r", n)
    singles = singles.withColumn("cuts", F.array(*fill)).select("doc_id", "size", "text_crc32", F.expr("filter(cuts, x -> x.hi > __lg_r)[0].t").alias("shard"))
    placed = scratch.save(linked.union(singles))
    return ranked(placed, ["shard"], ["doc_id", "text_crc32"], "slot", n)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
