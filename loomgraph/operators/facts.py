"""Order-dependent folds over a node's facts, and the upsert of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import dedup_form, jaccard, word_list


def distinct_facts(facts: DataFrame, alike: float = 0.65) -> DataFrame:
    """node_id, fact, seq: a fact stays unless an earlier one that stayed equals it, contains it, lies in it, or shares words to ``alike``.

    The fold runs in a node's own row over its facts in order of seq, as native expressions.
    """
    item = F.struct("seq", "fact", dedup_form(F.col("fact")).alias("form"))
    kind = "array<struct<seq:bigint,fact:string,form:string>>"
    arr = facts.groupBy("node_id").agg(F.array_sort(F.collect_list(item)).cast(kind).alias("fs"))

    def same(x, y):
        a, b = x["form"], y["form"]
        return (a == b) | F.contains(a, b) | F.contains(b, a) | (jaccard(word_list(a), word_list(b)) >= alike)

    kept = F.aggregate("fs", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return arr.select("node_id", F.explode(kept).alias("k")).select("node_id", F.col("k.fact").alias("fact"), F.col("k.seq").alias("seq"))


def upsert_entities(nodes: DataFrame, delta: DataFrame, now: str, known_types: list[str], seen: DataFrame | None = None) -> DataFrame:
    """nodes(id, label, type, status, created_at, last_active, session_count, pending) after delta(id, label, type, seq).

    New entities become full records from their first row by seq, with an unknown type marked as incomplete; those that exist are only
    touched: label and type stay.  Each later mention of an entity counts a session more, unless ``seen(id)`` says that the node
    has a fact of the present one.
    """
    known = F.col("d_type").isin(known_types)
    first = F.min_by(F.struct("label", "type"), "seq")
    d = delta.groupBy("id").agg(first.alias("f"), F.count(F.lit(1)).cast("int").alias("mentions")).select("id", F.col("f.label").alias("d_label"), F.col("f.type").alias("d_type"), "mentions")
    if seen is not None:
        d = d.join(seen.select("id", F.lit(True).alias("now_seen")).distinct(), "id", "left")
    else:
        d = d.withColumn("now_seen", F.lit(None).cast("boolean"))
    j = nodes.join(d, "id", "full_outer")
    new, hit = F.col("label").isNull(), F.col("d_label").isNotNull()
    more = F.when(~hit | F.coalesce("now_seen", F.lit(False)), 0).otherwise(F.col("mentions"))
    return j.select(
        "id",
        F.coalesce("label", "d_label").alias("label"),
        F.when(new, F.when(known, F.col("d_type")).otherwise("Unknown")).otherwise(F.col("type")).alias("type"),
        F.when(new, F.when(known, "complete").otherwise("incomplete")).otherwise(F.col("status")).alias("status"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        F.when(hit, F.lit(now)).otherwise(F.col("last_active")).alias("last_active"),
        (F.coalesce("session_count", F.lit(0)) + more).cast("int").alias("session_count"),
        F.when(new, F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("type")))).otherwise(F.col("pending")).alias("pending"),
    )


def prose_clusters(docs: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, chunk_index, content: paragraphs joined by blank lines while they fit; a longer paragraph stands alone."""
    paras = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, p):
        fits = F.length(acc["cur"]) + 2 + F.length(p) <= most
        return F.when(acc["cur"] == "", F.struct(acc["done"].alias("done"), p.alias("cur"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit("\n\n"), p).alias("cur"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), p.alias("cur")))

    out = F.aggregate(paras, zero, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
    return docs.select("doc_id", F.posexplode(out).alias("chunk_index", "content"))


UNIT = "path string, kind string, name string, parent string, start_line int, end_line int"


def python_units(files: DataFrame) -> DataFrame:
    """Functions, classes and methods of files(path, text); functions inside functions are left out, as are files that don't parse."""

    def run(parts):
        import ast

        import pyarrow as pa

        for b in parts:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    body = ast.parse(text or "").body
                except (SyntaxError, ValueError):
                    continue
                todo = [(n, None) for n in body]
                while todo:
                    n, parent = todo.pop(0)
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                        is_class = isinstance(n, ast.ClassDef)
                        rows.append((path, "class" if is_class else "method" if parent else "function", n.name, parent, first, n.end_lineno))
                        if is_class:
                            todo = [(m, n.name) for m in n.body] + todo
            names = ["path", "kind", "name", "parent", "start_line", "end_line"]
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("path", "text").mapInArrow(run, T.StructType.fromDDL(UNIT))
