"""The graph that is derived from the driver's tables, as DataFrames and as SQL.

seq, the order of insertion, is an expression of kind and key: no global ranking is needed for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = [("region", "r_regionkey", "r_name", "Place"), ("nation", "n_nationkey", "n_name", "Place"), ("customer", "c_custkey", "c_name", "Organization"), ("supplier", "s_suppkey", "s_name", "Organization"), ("part", "p_partkey", "p_name", "Product")]
SHIFT = 1_000_000_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for i, (t, key, name, kind) in enumerate(KINDS):
        n = table(spark, d, t).select(F.concat(F.lit(f"{t}_"), key).alias("id"), F.col(name).alias("label"), F.lit(kind).alias("type"), F.lit("entity").alias("kind"), (F.lit(i * SHIFT) + F.col(key)).cast("long").alias("seq"))
        out = n if out is None else out.unionByName(n)
    return out


def edges(spark: SparkSession, d: str, uses: bool = True) -> DataFrame:
    def e(t, a, b, source, target, relation, i):
        return table(spark, d, t).select(F.concat(F.lit(source), a).alias("source"), F.concat(F.lit(target), b).alias("target"), F.lit(relation).alias("relation"), F.lit(1.0).alias("weight"), (F.lit(i * SHIFT) + F.col(a)).cast("long").alias("seq"))

    out = e("nation", "n_nationkey", "n_regionkey", "nation_", "region_", "part_of", 0)
    out = out.unionByName(e("customer", "c_custkey", "c_nationkey", "customer_", "nation_", "located_in", 1))
    out = out.unionByName(e("supplier", "s_suppkey", "s_nationkey", "supplier_", "nation_", "located_in", 2))
    if uses:
        o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
        u = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(u.select(F.concat(F.lit("customer_"), "o_custkey").alias("source"), F.concat(F.lit("part_"), "l_partkey").alias("target"), F.lit("uses").alias("relation"), F.col("n").cast("double").alias("weight"), (F.lit(3 * SHIFT) + F.col("o_custkey") * 10_000_000 + F.col("l_partkey")).cast("long").alias("seq")))
    return out


NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT '{t}_' || {key} AS id, {name} AS label, '{kind}' AS type, 'entity' AS kind, CAST({i * SHIFT} + {key} AS BIGINT) AS seq FROM {t}" for i, (t, key, name, kind) in enumerate(KINDS)) + ")"
_E = "SELECT '{s}' || {a} AS source, '{t}' || {b} AS target, '{r}' AS relation, 1.0::DOUBLE AS weight, CAST({i} + {a} AS BIGINT) AS seq FROM {f}"
PLACES = "edges AS (" + " UNION ALL ".join(
    [
        _E.format(s="nation_", a="n_nationkey", t="region_", b="n_regionkey", r="part_of", i=0, f="nation"),
        _E.format(s="customer_", a="c_custkey", t="nation_", b="c_nationkey", r="located_in", i=SHIFT, f="customer"),
        _E.format(s="supplier_", a="s_suppkey", t="nation_", b="s_nationkey", r="located_in", i=2 * SHIFT, f="supplier"),
    ]
) + ")"
EDGES = PLACES[:-1] + f" UNION ALL SELECT 'customer_' || o_custkey, 'part_' || l_partkey, 'uses', count(*)::DOUBLE, CAST({3 * SHIFT} + o_custkey * 10000000 + l_partkey AS BIGINT) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey)"
BOTH = "both_ AS (SELECT source AS src, target AS dst, relation, weight, seq FROM edges UNION ALL SELECT target, source, relation, weight, seq FROM edges)"
