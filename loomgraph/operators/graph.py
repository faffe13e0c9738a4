"""Graph reads and mutations as pure functions over nodes(id, label, ..., seq) and edges(source, target, relation, weight, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Relations that a more specific one replaces.
GENERIC = ["related_to", "uses", "uses_technology", "belongs_to", "associated_with"]


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def undirected(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("source", "target")]
    a = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), *cols)
    return a.unionByName(edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), *cols))


def pair_key(a: str = "source", b: str = "target") -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def lookup(nodes: DataFrame, name: Column, node_id: Column) -> DataFrame:
    """By id, else by the id that the name normalises to, else the first label that contains the name."""
    hit = F.when(F.col("id") == name, 0).when(F.col("id") == node_id, 1).when(F.contains(F.lower("label"), F.lower(name)), 2)
    return nodes.withColumn("prio", hit).filter("prio is not null").orderBy("prio", "seq").limit(1).drop("prio")


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Label contains the query, or the query the label."""
    q = F.lit(query.lower())
    return nodes.filter(F.contains(F.lower("label"), q) | F.contains(q, F.lower("label")))


def children(nodes: DataFrame, parent: str, kinds: tuple[str, ...] = ("section", "symbol")) -> DataFrame:
    """Nodes of some kinds below a parent: its id, the separator, and more."""
    return nodes.filter(F.col("id").startswith(f"{parent}__") & F.col("kind").isin(*kinds))


def incident(edges: DataFrame, ids: list[str]) -> DataFrame:
    return edges.filter(F.col("source").isin(ids) | F.col("target").isin(ids))


def neighbors(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Of each node the strongest neighbours (greatest weight per neighbour, then order of insertion); cut before missing nodes drop out."""
    best = undirected(edges).groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.min("seq").alias("seq"))
    top = best.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "seq", "dst"))).filter(F.col("rank") <= most)
    return top.join(nodes.select(F.col("id").alias("dst"), "label"), "dst").select("src", "dst", "label", "weight", "rank")


def layers(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, depth: undirected breadth-first layers 0..depth from seeds(id); the first visit counts."""
    e = undirected(edges).select("src", "dst")
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct()
        front = step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def grouped_relations(edges: DataFrame, nodes: DataFrame, labels: dict[str, str], most: int = 12) -> DataFrame:
    """Of each node its first edges by label of the relation, the other ends' labels joined in order."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    e = undirected(edges).withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("seq", "dst"))).filter(F.col("rank") <= most)
    e = e.join(nodes.select(F.col("id").alias("dst"), "label"), "dst").withColumn("name", F.coalesce(m[F.col("relation")], F.col("relation")))
    return e.groupBy("src", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ", ").alias("ends"))


def dedup_directed(edges: DataFrame) -> DataFrame:
    return first_per(edges, ["source", "target", "relation"], ["seq"])


def one_per_pair(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair: no self-loops; the first specific relation wins, else the first."""
    e = edges.filter("source <> target").select("*", *pair_key())
    generic = F.col("relation").isin(GENERIC).cast("int")
    return first_per(e, ["lo", "hi"], [generic, "seq"]).drop("lo", "hi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    a = edges.join(ids, edges["source"] == ids["id"], "left_anti")
    b = edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, F.col("target") == ids["id"], "left_anti")
    return a.unionByName(b)


def repaired(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without nodes that lack an id or label, dangling edges, and repeated edges."""
    n = nodes.filter("id is not null and label is not null")
    ids = n.select("id")
    e = edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, F.col("target") == ids["id"], "left_semi")
    return n, dedup_directed(e)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(undirected(edges).select(F.col("src").alias("id")), "id", "left_anti")


def merged_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends re-pointed by mapping(old, new), without self-loops and repeats."""
    m = mapping.select(F.col("old"), F.col("new"))
    e = edges.join(m.toDF("source", "ns"), "source", "left").join(m.toDF("target", "nt"), "target", "left")
    e = e.select(F.coalesce("ns", "source").alias("source"), F.coalesce("nt", "target").alias("target"), "relation", "weight", "seq")
    return dedup_directed(e.filter("source <> target"))


def imported_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of an import that are not there yet: no edge of that relation between the two, in either direction."""
    have = edges.select(*pair_key(), "relation")
    return new.select("*", *pair_key()).join(have, ["lo", "hi", "relation"], "left_anti").drop("lo", "hi")


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    return nodes.filter(~F.col("id").isin(ids)), edges.filter(~F.col("source").isin(ids) & ~F.col("target").isin(ids))


def seeds(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose label (3 letters or more) occurs in a turn's text; see activation.containing."""
    from .activation import containing

    texts = turns.select(F.xxhash64("text").alias("text_id"), "text").distinct()
    hit = containing(texts, nodes).join(texts, "text_id").select("text", "id")
    return turns.join(hit, "text").join(nodes, "id")


def merged_facts(facts: DataFrame, new: DataFrame, form) -> DataFrame:
    """facts(node_id, fact, seq) and those of an import whose normal form a node does not have yet."""
    have = facts.select("node_id", form(F.col("fact")).alias("k"))
    fresh = first_per(new.withColumn("k", form(F.col("fact"))), ["node_id", "k"], ["seq"]).join(have, ["node_id", "k"], "left_anti").drop("k")
    return facts.unionByName(fresh)
