"""Conversation operators over turns(conv_id, turn, role, text): windows, hot pairs, topics, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions.text import change_phrase, count_tokens, word_list

def by_turn():
    return W.partitionBy("conv_id").orderBy("turn")


def prev_assistant(turns: DataFrame) -> DataFrame:
    """Each user turn with the last assistant text before it."""
    last = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(by_turn().rowsBetween(W.unboundedPreceding, -1))
    return turns.withColumn("prev_assistant", last).filter("role = 'user'")


def history_window(turns: DataFrame, last: int = 2) -> DataFrame:
    """System turns, and the last others of each conversation."""
    back = W.partitionBy("conv_id", F.col("role") == "system").orderBy(F.desc("turn"))
    return turns.withColumn("__r", F.row_number().over(back)).filter((F.col("role") == "system") | (F.col("__r") <= last)).drop("__r")


def hot_pairs(turns: DataFrame, pairs: int = 2, budget: int = 400) -> DataFrame:
    """Newest (user, assistant) pairs first, until one overflows the budget of tokens; none after that one."""
    t = turns.withColumn("u_role", F.lag("role").over(by_turn())).withColumn("u_text", F.lag("text").over(by_turn()))
    p = t.filter("role = 'assistant' and u_role = 'user'").withColumn("tokens", count_tokens(F.col("u_text")) + count_tokens(F.col("text")))
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    p = p.withColumn("rank", F.row_number().over(back)).filter(F.col("rank") <= pairs)
    p = p.withColumn("running", F.sum("tokens").over(back.rowsBetween(W.unboundedPreceding, 0)))
    return p.filter(F.col("running") <= budget).select("conv_id", "turn", "rank", "tokens", "running")


def compaction_candidates(turns: DataFrame, hot: int = 2, threshold: int = 60) -> DataFrame:
    """Conversations whose turns before the last ``hot`` hold at least ``threshold`` tokens."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    old = turns.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") > hot)
    return old.groupBy("conv_id").agg(F.sum(count_tokens(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("n_turns")).filter(F.col("tokens") >= threshold)


def topic_change(turns: DataFrame) -> DataFrame:
    """First level: a phrase means changed (confidence 1), no topic yet too, fewer than five words the same (0.9), else undecided."""
    phrase, first = change_phrase(F.col("text")), F.row_number().over(by_turn()) == 1
    verdict = F.when(phrase != "", "changed").when(first, "changed").when(F.size(word_list(F.col("text"))) < 5, "same").otherwise("undecided")
    confidence = F.when((phrase != "") | first, 1.0).when(F.size(word_list(F.col("text"))) < 5, 0.9).otherwise(0.0)
    return turns.select("conv_id", "turn", phrase.alias("phrase"), verdict.alias("verdict"), confidence.alias("confidence"))


def carry_topic(turns: DataFrame, topic) -> DataFrame:
    """The topic of the latest turn that set one."""
    return turns.withColumn("topic", F.last(topic, ignorenulls=True).over(by_turn().rowsBetween(W.unboundedPreceding, 0)))


def turn_metrics(turns: DataFrame) -> DataFrame:
    """For each user turn: its tokens, those of all turns before it, and whether there were any."""
    t = turns.withColumn("tokens", count_tokens(F.col("text")))
    t = t.withColumn("history_tokens", F.coalesce(F.sum("tokens").over(by_turn().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return t.filter("role = 'user'").select("conv_id", "turn", "tokens", "history_tokens", (F.col("history_tokens") > 0).alias("context_hit"))


def session_summary(metrics: DataFrame) -> DataFrame:
    """Averages and sums of a session, rounded half-even."""
    return metrics.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.bround(F.avg("tokens"), 1).alias("avg_tokens"),
        F.bround(F.avg("history_tokens"), 1).alias("avg_history"),
        F.bround(F.avg(F.col("context_hit").cast("double")), 3).alias("hit_rate"),
        F.sum("tokens").alias("sum_tokens"),
    )


def growth(metrics: DataFrame, value: str) -> DataFrame:
    """(last - first) / (n - 1) of a value over a session's turns, 0 with fewer than two."""
    n = F.count(F.lit(1))
    span = F.max_by(value, "turn") - F.min_by(value, "turn")
    return metrics.groupBy("conv_id").agg(F.round(F.when(n < 2, 0.0).otherwise(span / (n - 1)), 6).alias("growth"))
