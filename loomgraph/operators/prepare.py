"""From turns to context: seeds, breadth-first layers, lines, budgets and the block that goes before a question.

All turns are prepared at once.  What a node's line says does not depend on the turn, so lines are made once a node and joined to
the layers of each turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions.text import count_tokens

from .activation import SHORT, alike, beginning, by_keyword, containing, words_of
from .graph import undirected
from .rank import within_budget

# Tokens for each intent, names of relations from either end, closing sentences.
BUDGETS = {"overview": 300, "specific": 600, "followup": 400, "chat": 100}
OUTGOING = {
    "uses_technology": "Uses", "works_at": "Works at", "maintains": "Maintains", "part_of": "Part of", "depends_on": "Depends on",
    "created_by": "Created by", "located_in": "Located in", "deployed_on": "Deployed on", "member_of": "Member of", "produces": "Produces",
    "serves": "Serves", "documented_in": "Documented in", "contains": "Contains",
}
INCOMING = {
    "uses_technology": "Used by", "works_at": "Team member", "maintains": "Maintained by", "part_of": "Contains", "created_by": "Creator",
    "depends_on": "Required by", "contains": "Part of",
}
GROUNDING = {
    "specific": "Answer using the knowledge context above. If the answer is not in the context, say so clearly.",
    "overview": "Use the knowledge context above to give a complete overview. Include all relevant entities and their relationships.",
    "followup": "Continue based on the knowledge context and previous conversation.",
}


def mapped(values: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), default)


def entered(turns: DataFrame, nodes: DataFrame, extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Where each of turns(text_id, text, intent) enters the graph: (text_id, rep) of the turns and (rep, id) of the sets of seeds.

    Turns with equal sets of seeds share one, that of their least id; sets are told apart by size and two 64-bit hashes.

    Entities that a reply named (extracted: text_id, id); nodes whose label of three letters or more lies in the text, or begins
    with a word of four letters or more of it; for an overview without any of these all entities; for a chat only synthesis nodes whose
    summary holds such a word, if there are some.  nodes(id, label, kind, summary).
    """
    members, each = alike(turns, "intent") if extracted is None else (turns.select("text_id", F.col("text_id").alias("rep")).distinct(), turns)
    n = nodes.filter(F.length("label") >= SHORT).select("id", F.lower("label").alias("l"))
    words = each.select("text_id", F.explode(words_of(F.col("text"))).alias("w"))
    found = containing(each, nodes).unionByName(beginning(words, n))
    if extracted is not None:
        found = found.unionByName(extracted.join(nodes.select("id").hint("merge"), "id", "left_semi").select("text_id", "id"))
    found = found.distinct().localCheckpoint()  # what is read several times is kept, else plans grow with each use
    bare = each.filter("intent = 'overview'").select("text_id").distinct().join(found.select("text_id").distinct().hint("merge"), "text_id", "left_anti")
    every = nodes.filter(F.coalesce("kind", F.lit("entity")) == "entity").select("id")
    chats = each.filter("intent = 'chat'")
    talk = by_keyword(chats.select("text_id", "text"), nodes.filter("kind = 'synthesis' and summary <> ''").select("id", F.col("summary").alias("note")))
    pairs = found.join(talk.select("text_id").distinct().hint("merge"), "text_id", "left_anti").unionByName(talk).localCheckpoint()
    sets = pairs.groupBy("text_id").agg(F.struct(F.count("id"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit("again"), "id"))).alias("k"))
    first = sets.groupBy("k").agg(F.min("text_id").alias("rep"))
    none = F.broadcast(bare.agg(F.min("text_id").alias("rep")).filter("rep is not null"))
    start = pairs.withColumnRenamed("text_id", "rep").join(first.select("rep").hint("merge"), "rep", "left_semi").select("rep", "id")
    start = start.unionByName(every.crossJoin(none).select("rep", "id"))
    of = sets.hint("merge").join(first, "k").select("text_id", "rep").unionByName(bare.crossJoin(none).select("text_id", "rep"))
    of = of.select(F.col("text_id").alias("rep"), F.col("rep").alias("__set"))
    return members.hint("merge").join(of, "rep").select("text_id", F.col("__set").alias("rep")).localCheckpoint(), start.localCheckpoint()


PACK, SHARE = 1000, 20_000_000


def expanded(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows(rep, id, ...) for each of members(text_id, rep) of the rep.

    Turns that share many rows come in packs of about ``PACK``, and rows that many turns share are dealt out, so that a task writes about
    ``SHARE`` rows of one rep.
    """
    session = rows.sparkSession
    n = members.groupBy("rep").agg(F.count(F.lit(1)).alias("__n")).join(rows.groupBy("rep").agg(F.count(F.lit(1)).alias("__m")).hint("merge"), "rep")
    n = n.select("rep", F.ceil(F.col("__n") / PACK).alias("__packs"), F.least("__m", F.ceil(F.col("__n").cast("double") * F.col("__m") / SHARE)).cast("long").alias("__deal"))
    packs = members.hint("merge").join(n, "rep").groupBy("rep", "__deal", F.pmod(F.xxhash64("text_id"), F.col("__packs")).alias("__pack")).agg(F.collect_list("text_id").alias("__turns"))
    packs = packs.select("rep", "__turns", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__deal") - 1)).alias("__part"))
    dealt = rows.hint("merge").join(n.select("rep", "__deal"), "rep").withColumn("__part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("__deal")))
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    both = dealt.repartition(parts, "rep", "__part").hint("merge").join(packs, ["rep", "__part"])
    return both.select(F.explode("__turns").alias("text_id"), *[c for c in rows.columns if c != "rep"])


def seeds(turns: DataFrame, nodes: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """text_id, id: where each of turns(text_id, text, intent) enters the graph, as ``entered`` says."""
    members, start = entered(turns, nodes, extracted)
    return expanded(start, members)


def layered(turns: DataFrame, nodes: DataFrame, edges: DataFrame, extracted: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """text_id, id, depth: the layers around the seeds of each turn, found once for all turns with the same seeds."""
    members, start = entered(turns, nodes, extracted)
    return expanded(layers(start.withColumnRenamed("rep", "text_id"), nodes, edges, depth).withColumnRenamed("text_id", "rep").localCheckpoint(), members)


def layers(start: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """text_id, id, depth: breadth-first layers 0..depth around start(text_id, id), each turn by itself; nodes that are missing end a way."""
    ids = nodes.select("id")
    e = undirected(edges).select("src", "dst").distinct().join(ids.hint("merge"), F.col("dst") == F.col("id"), "left_semi")
    front = start.select("text_id", "id").distinct()
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = front.hint("merge").join(e, F.col("id") == F.col("src")).select("text_id", F.col("dst").alias("id")).distinct()
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.groupBy("text_id", "id").agg(F.min("depth").alias("depth"))


def ends(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """id, rank, out, relation, other: a node's first edges in order, with the other end's label; cut before missing ends drop out."""
    e = edges.select(F.col("source").alias("id"), F.col("target").alias("dst"), F.lit(True).alias("out"), "relation", "seq")
    e = e.unionByName(edges.filter("source <> target").select(F.col("target").alias("id"), F.col("source").alias("dst"), F.lit(False).alias("out"), "relation", "seq"))
    e = e.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("seq", "dst"))).filter(F.col("rank") <= most)
    return e.hint("merge").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("other")), "dst").select("id", "rank", "out", "relation", "other")


def in_order(key: str, value: str = "x") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda r: r[value])


def hot_lines(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """id, line: label, type and description, relations by name, three facts.  nodes(id, label, type, description), facts(node_id, fact, seq)."""
    name = F.when(F.col("out"), mapped(OUTGOING, F.col("relation"), F.col("relation"))).otherwise(mapped(INCOMING, F.col("relation"), F.concat(F.lit("← "), "relation")))
    by = ends(nodes, edges, 12).withColumn("name", name).groupBy("id", "name").agg(F.min("rank").alias("rank"), F.array_join(in_order("rank", "other"), ", ").alias("o"))
    rel = by.withColumn("x", F.concat(F.lit("    "), "name", F.lit(": "), "o")).groupBy("id").agg(in_order("rank").alias("r"))
    top = facts.withColumn("k", F.row_number().over(W.partitionBy("node_id").orderBy("seq"))).filter("k <= 3 and fact <> ''")
    told = top.withColumn("x", F.concat(F.lit("    * "), "fact")).groupBy(F.col("node_id").alias("id")).agg(in_order("seq").alias("f"))
    none = F.array().cast("array<string>")
    head = F.concat(F.lit("  "), "label", F.lit(" ["), "type", F.lit("]"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(""))
    out = nodes.join(rel.hint("merge"), "id", "left").join(told.hint("merge"), "id", "left")
    return out.select("id", F.array_join(F.concat(F.array(head), F.coalesce("r", none), F.coalesce("f", none)), "\n").alias("line"))


def warm_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, line: label and type, the other ends of the first four edges, description."""
    near = ends(nodes, edges, 4).groupBy("id").agg(F.array_join(in_order("rank", "other"), " + ").alias("near"))
    head = F.concat(F.lit("  "), "label", F.lit(" ["), "type", F.lit("]"))
    tail = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise("")
    return nodes.join(near.hint("merge"), "id", "left").select("id", F.concat(head, F.when(F.col("near") != "", F.concat(F.lit(": "), "near")).otherwise(""), tail).alias("line"))


def assemble(turns: DataFrame, layered: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, overview: str = "", members: DataFrame | None = None) -> DataFrame:
    """text_id, warm_content, warm_tokens, has_context, needs_tool, hot, warm, cold for turns(text_id, intent) and their layers(text_id, id, depth).

    The overview, hot, warm and (for specific and follow-up turns) cold lines share the intent's budget in that order; what overflows is
    skipped, and lines too long for the whole budget are left out before the others are gathered.  The layers stand in tags, cold labels after
    the warm lines, and a sentence by intent closes the block.  A turn without hot and warm nodes gets the overview alone.

    With members(text_id, rep) the layers are those of each rep, by text_id, and all its turns have them.
    """
    text = hot_lines(nodes, edges, facts).withColumn("depth", F.lit(0)).unionByName(warm_lines(nodes, edges).withColumn("depth", F.lit(1)))
    text = text.unionByName(nodes.select("id", F.concat("label", F.lit(" ["), "type", F.lit("]")).alias("line"), F.lit(2).alias("depth")))
    text = text.withColumn("tokens", count_tokens(F.col("line")).cast("long")).join(nodes.select("id", "seq").hint("merge"), "id")
    if members is None:
        members = layered.select("text_id", F.col("text_id").alias("rep")).distinct()
    rows = layered.withColumnRenamed("text_id", "rep").hint("merge").join(text, ["id", "depth"])
    # of lines with equally many tokens a budget takes the first ones only, as many as it would hold of them alone
    most = max(400, *BUDGETS.values())
    lines = rows.select("rep", (F.col("depth") + 1).alias("layer"), "seq", "line", "tokens").filter(F.col("tokens") <= most)
    lines = lines.withColumn("k", F.row_number().over(W.partitionBy("rep", "tokens").orderBy("layer", "seq", "line"))).filter(F.col("k") <= most).filter(F.col("k") * F.col("tokens") <= most)
    few = lines.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("layer", "seq", "line", "tokens"))).alias("lines"))
    count = [F.count_if(F.col("depth") == d).alias(k) for d, k in enumerate(("hot", "warm", "cold"))]
    g = layered.hint("merge").join(nodes.select("id"), "id", "left_semi").groupBy(F.col("text_id").alias("rep")).agg(*count).hint("merge").join(few, "rep", "left")
    none = F.array().cast("array<struct<layer:int,seq:bigint,line:string,tokens:bigint>>")
    # a block depends on the layers and the intent only
    t = turns.select("text_id", F.coalesce("intent", F.lit("")).alias("intent")).join(members.hint("merge"), "text_id", "left")
    out = t.select("rep", "intent").distinct().join(g.hint("merge"), "rep", "left").withColumn("budget", mapped(BUDGETS, F.col("intent"), F.lit(400)).cast("long"))
    out = out.withColumn("lines", F.when(F.col("hot").isNotNull(), F.filter(F.coalesce("lines", none), lambda x: x["tokens"] <= F.col("budget"))))
    ours = F.filter("lines", lambda x: (x["layer"] < 3) | F.col("intent").isin("specific", "followup"))
    if overview:
        lead = F.array(F.struct(F.lit(0).alias("layer"), F.lit(0).cast("long").alias("seq"), F.lit(overview).alias("line"), count_tokens(F.lit(overview)).cast("long").alias("tokens")))
        ours = F.concat(lead, ours)
    out = out.withColumn("kept", within_budget(ours, F.col("budget")))
    none = F.array().cast("array<string>")
    part = lambda k: F.transform(F.filter("kept", lambda x: x["layer"] == k), lambda x: x["line"])
    tag = lambda name, body: F.when(F.size(body) > 0, F.concat(F.array(F.lit(f"<{name}>")), body, F.array(F.lit(f"</{name}>")))).otherwise(none)
    out = out.select("*", *[part(k).alias(f"p{k}") for k in range(4)])
    cold = F.when(F.size("p3") > 0, F.array(F.concat(F.lit("  Also: "), F.array_join("p3", ", ")))).otherwise(none)
    warm = F.when(F.size("p2") > 0, F.concat("p2", cold)).otherwise(none)
    block = F.array_join(F.concat("p0", tag("ctx", F.concat(tag("hot", F.col("p1")), tag("warm", warm)))), "\n")
    out = out.withColumn("block", F.coalesce(block, F.lit(overview)))
    ground = mapped(GROUNDING, F.col("intent"), F.lit(""))
    content = F.when(F.col("block") == "", "").when(ground == "", F.col("block")).otherwise(F.concat("block", F.lit("\n\n"), ground))
    out = out.withColumn("warm_content", content).withColumn("warm_tokens", F.when(F.col("warm_content") == "", 0).otherwise(count_tokens(F.col("warm_content"))))
    sizes = [F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("hot", "warm", "cold")]
    done = out.select(F.col("rep").alias("__rep"), F.col("intent").alias("__intent"), "warm_content", "warm_tokens", *sizes)
    out = t.hint("merge").join(done, F.col("rep").eqNullSafe(F.col("__rep")) & (F.col("intent") == F.col("__intent")))
    return out.select("text_id", "warm_content", "warm_tokens", (F.col("warm_tokens") > 0).alias("has_context"), (F.col("warm_tokens") == 0).alias("needs_tool"), "hot", "warm", "cold")


def prepare(turns: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, extracted: DataFrame | None = None, overview: str = "") -> DataFrame:
    """The context of each of turns(text_id, text, intent), with the number of nodes in each layer."""
    members, start = entered(turns, nodes, extracted)
    return assemble(turns, layers(start.withColumnRenamed("rep", "text_id"), nodes, edges).localCheckpoint(), nodes, edges, facts, overview, members)
