"""Streams: reply deltas, change logs and session counters with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accumulate_replies(deltas: DataFrame) -> DataFrame:
    """response_id, text: the pieces of each response joined in order once its last piece (done) is in.

    deltas(response_id, seq, piece, done) is a stream; pieces wait in the state of their response.
    """

    def step(key, parts: Iterator, state):
        import pandas as pd

        seqs, pieces, over = state.get if state.exists else ([], [], False)
        seqs, pieces = list(seqs), list(pieces)
        for p in parts:
            seqs += [int(x) for x in p["seq"]]
            pieces += [x or "" for x in p["piece"]]
            over = over or bool(p["done"].any())
        if over:
            state.remove()
            yield pd.DataFrame({"response_id": [key[0]], "text": ["".join(x for _, x in sorted(zip(seqs, pieces, strict=True)))]})
        else:
            state.update((seqs, pieces, over))

    return deltas.groupBy("response_id").applyInPandasWithState(step, "response_id long, text string", "seqs array<long>, pieces array<string>, over boolean", "append", "NoTimeout")


def changelog(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows of a stream of tool calls whose tool writes or deletes; works on tables too."""
    e = events.filter(F.col("event_type").isin(kinds))
    return e.select("event_id", "ts", F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("file"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each tool in tumbling windows, with a watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def topic_state(turns: DataFrame) -> DataFrame:
    """conv_id, turn, topic: the topic in force at each turn of a stream of turns(conv_id, turn, topic); null leaves it as it was.

    The state of a conversation is its topic; turns of one batch are taken in order.
    """

    def step(key, parts: Iterator, state):
        import pandas as pd

        topic = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("turn", kind="stable")
        out = []
        for t, set_ in zip(rows["turn"], rows["topic"], strict=True):
            topic = topic if set_ is None or set_ != set_ else set_
            out.append(topic)
        state.update((topic,))
        yield pd.DataFrame({"conv_id": rows["conv_id"], "turn": rows["turn"], "topic": out})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, topic string", "topic string", "append", "NoTimeout")


def session_totals(metrics: DataFrame) -> DataFrame:
    """Running totals of each session, for streams in update or complete mode and for tables."""
    return metrics.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("tokens").alias("tokens"), F.max("turn").alias("last_turn"))
