"""Which nodes a turn activates: text matches, expansions along edges, caps by intent.

Turns meet nodes through equi-joins on pieces of text, never as turns x nodes; every candidate is then verified,
so the result is that of comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import undirected

SHORT, LONG = 3, 8


def grams(text: Column, n: int) -> Column:
    """Distinct pieces of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """text_id, id: labels(id, label) of three letters or more that lie in texts(text_id, text), without regard to case.

    A label is sought by its last 8 characters, a shorter one by its last 3.
    """
    low = F.lower("label")
    key = F.when(F.length("label") >= LONG, F.substr(low, F.lit(-LONG))).otherwise(F.substr(low, F.lit(-SHORT)))
    want = labels.filter(F.length("label") >= SHORT).select("id", low.alias("__l"), key.alias("__k"))
    t = texts.select("text_id", F.lower("text").alias("__t"))
    pieces = t.select("text_id", F.explode(F.concat(grams(F.col("__t"), SHORT), grams(F.col("__t"), LONG))).alias("__k"))
    # Spark takes pieces of text for no larger than the file that the texts come from, and would broadcast them
    hit = pieces.hint("merge").join(want, "__k").select("text_id", "id", "__l")
    return hit.join(t.hint("merge"), "text_id").filter(F.contains("__t", F.col("__l"))).select("text_id", "id")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def alike(turns: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Turns that say the same: (text_id, rep) of each turn(text_id, text, columns...), and rep, text, columns... of the first of each kind.

    What depends on the text alone is found once a kind and joined to its turns, however many there are.
    """
    said = turns.groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct("text", *columns))).alias("__said"))
    kinds = said.groupBy("__said").agg(F.min("text_id").alias("rep")).localCheckpoint()  # read several times
    members = said.hint("merge").join(kinds, "__said").select("text_id", "rep")
    return members, kinds.select("rep", F.explode("__said").alias("s")).select(F.col("rep").alias("text_id"), "s.text", *[f"s.{c}" for c in columns])


def beginning(words: DataFrame, labels: DataFrame) -> DataFrame:
    """text_id, id: labels(id, l) of four letters or more that begin with one of words(text_id, w).

    The beginnings that are said at all are sought first, so that one shared by very many labels is not shuffled with each of them.
    """
    starts = F.transform(F.sequence(F.lit(SHORT + 1), F.length("l")), lambda k: F.substr("l", F.lit(1), k))
    n = labels.filter(F.length("l") > SHORT)
    first = n.select("l").distinct().select(F.explode(starts).alias("w")).distinct()
    said = words.filter(F.length("w") > SHORT).select("w").distinct().hint("merge").join(first, "w")
    named = n.select("id", F.explode(starts).alias("w")).hint("merge").join(said, "w")
    return words.hint("merge").join(named, "w").select("text_id", "id")


def mentioned(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """text_id, id: nodes(id, label) whose label a turn(text_id, text) holds, or begins with a word of four letters or more
    of it, or consists of two or more words that all occur in it.  Turns of one text are matched once."""
    members, each = alike(turns)
    n = nodes.filter(F.length("label") >= SHORT).select("id", F.lower("label").alias("l"), words_of(F.col("label")).alias("lw"))
    words = each.select("text_id", words_of(F.col("text")).alias("tw"))
    by_word = words.select("text_id", F.explode("tw").alias("w"))
    several = n.filter(F.size("lw") > 1).select("id", "lw", F.explode("lw").alias("w"))
    every = by_word.hint("merge").join(several, "w").groupBy("text_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("lw")).alias("of")).filter("n = of").select("text_id", "id")
    found = containing(each, nodes).unionByName(beginning(by_word, n)).unionByName(every).distinct()
    return members.hint("merge").join(found.withColumnRenamed("text_id", "rep"), "rep").select("text_id", "id")


def by_keyword(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """text_id, id: notes(id, note) that hold a word of four letters or more of a turn, anywhere."""
    w = turns.select("text_id", F.explode(words_of(F.col("text"))).alias("w")).filter(F.length("w") >= 4).withColumn("k", F.substr("w", F.lit(1), F.lit(4)))
    t = notes.select("id", F.lower("note").alias("t"))
    hit = t.select("id", F.explode(grams(F.col("t"), 4)).alias("k")).hint("merge").join(w, "k").select("id", "text_id", "w")
    return hit.join(t.hint("merge"), "id").filter(F.contains("t", F.col("w"))).select("text_id", "id").distinct()


def expanded(active: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """active(text_id, id) with what active folders hold, then what active files hold, then active entities' entity neighbours."""
    kinds = nodes.select("id", "kind")
    held = undirected(edges.filter("relation = 'contains'")).select("src", "dst")
    out = active.select("text_id", "id").distinct()
    for kind in ("folder", "file"):
        of = out.join(kinds.filter(F.col("kind") == kind), "id", "left_semi")
        out = out.unionByName(of.join(held, F.col("id") == F.col("src")).select("text_id", F.col("dst").alias("id"))).distinct()
    entities = kinds.filter("kind = 'entity'").select("id")
    of = out.join(entities, "id", "left_semi")
    near = of.join(undirected(edges).select("src", "dst"), F.col("id") == F.col("src")).select("text_id", F.col("dst").alias("id"))
    return out.unionByName(near.join(entities, "id", "left_semi")).distinct()


def capped(active: DataFrame, nodes: DataFrame, intents: DataFrame, most: int = 15) -> DataFrame:
    """Chat keeps synthesis nodes only; a specific or follow-up turn with more than ``most`` nodes keeps entities, synthesis, files
    and folders, and if those are still more, entities and synthesis.  intents(text_id, intent)."""
    a = active.join(nodes.select("id", "kind"), "id").join(intents, "text_id")
    broad = F.col("kind").isin("entity", "synthesis", "file", "folder")
    n = a.groupBy("text_id").agg(F.count(F.lit(1)).alias("__n"), F.count_if(broad).alias("__broad"))
    narrow = F.col("kind").isin("entity", "synthesis")
    tight = F.col("intent").isin("specific", "followup") & (F.col("__n") > most)
    keep = F.when(F.col("intent") == "chat", F.col("kind") == "synthesis").when(tight & (F.col("__broad") <= most), broad).when(tight, narrow).otherwise(F.lit(True))
    return a.join(n, "text_id").filter(keep).select("text_id", "id", "kind")


def phantoms(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """labels(id, label) found in no text, neither whole nor by their first word."""
    first = labels.select("id", F.substring_index("label", " ", 1).alias("label"))
    found = containing(texts, labels.select("id", "label").unionByName(first)).select("id").distinct()
    return labels.join(found, "id", "left_anti")
