"""Context assembly: lines, blocks and message stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "[context]"


def node_line(label: Column, kind: Column, relations: Column, facts: Column, most: int = 3) -> Column:
    """``label [type] - relations; facts``, what is missing being left out."""
    tail = F.concat_ws("; ", F.when(relations != "", relations), F.when(F.size(facts) > 0, F.array_join(F.slice(facts, 1, most), "; ")))
    return F.concat(label, F.lit(" ["), kind, F.lit("]"), F.when(tail != "", F.concat(F.lit(" - "), tail)).otherwise(F.lit("")))


def block(lines: Column) -> Column:
    """The lines within tags; nothing without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit("<context>\n"), F.array_join(lines, "\n"), F.lit("\n</context>"))).otherwise(F.lit(""))


def compose_system(system: Column, addition: Column) -> Column:
    """The system message with an addition behind a mark, once only."""
    return F.when(F.contains(F.coalesce(system, F.lit("")), F.lit(MARK)), system).otherwise(F.concat_ws("\n\n", F.when(system != "", system), F.concat(F.lit(f"{MARK} "), addition)))


def stack(turns: DataFrame, warm: Column, last: int = 2) -> DataFrame:
    """conv_id, messages: the system turn, the warm context, and the last turns in order."""
    msg = F.struct("turn", "role", "text")
    all_ = F.array_sort(F.collect_list(msg))
    g = turns.groupBy("conv_id").agg(all_.alias("m"))
    sys_ = F.filter("m", lambda x: x["role"] == "system")
    rest = F.filter("m", lambda x: x["role"] != "system")
    tail = F.slice(rest, F.greatest(F.size(rest) - last + 1, F.lit(1)), F.lit(last))
    as_text = lambda a: F.transform(a, lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return g.select("conv_id", F.array_join(F.concat(as_text(sys_), F.array(F.concat(F.lit("system: "), warm)), as_text(tail)), "\n").alias("messages"))
