"""Model replies as input columns: finding JSON in them, validating what they claim."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_json(text: str | None, target: str = "object") -> str | None:
    """The first JSON object, or array, of a reply.

    Tried in turn: the balanced piece from the first opening brace on (braces in strings count as well); all up to the last closing
    brace; the same with commas put between a closing bracket or brace and a key on the next line.  Nothing else is searched.
    """
    text = text or ""
    left, right = "{}" if target == "object" else "[]"
    begin, end, depth = text.find(left), text.rfind(right), 0
    if begin < 0:
        return None
    tries = []
    for m in re.finditer(f"[{re.escape(left + right)}]", text[begin:]):
        depth += 1 if m[0] == left else -1
        if not depth:
            tries.append(text[begin : begin + m.end()])
            break
    if end > begin:
        whole = text[begin : end + 1]
        tries += [whole, re.sub(r'([\]}])\s*\n\s*"', r'\1, "', whole)]
    for x in tries:
        try:
            return json.dumps(json.loads(x), ensure_ascii=False)
        except ValueError:
            continue
    return None


def json_object(df: DataFrame, column: str, out: str = "json", target: str = "object") -> DataFrame:
    """Adds the first JSON object, or array, of a reply, in Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at, names = df.columns.index(column), [*df.columns, out]

    def run(parts):
        import pyarrow as pa

        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([first_json(x, target) for x in b.column(at).to_pylist()], pa.string())], names)

    return df.mapInArrow(run, schema)


# Words that are jargon, alone or as the last of several.
JARGON = [
    "index", "query", "table", "column", "row", "field", "file", "folder", "directory", "path", "extension", "endpoint", "request", "response",
    "header", "body", "variable", "function", "method", "class", "module", "parameter", "argument", "flag", "option", "config", "error",
    "exception", "warning", "log", "debug", "migration", "schema", "constraint", "trigger",
]
# Names that are never entities.
NEVER = [
    "xlsx", "csv", "json", "yaml", "toml", "xml", "html", "css", "gin index", "brin index", "btree index", "hash index", "primary key",
    "foreign key", "unique constraint", "null", "true", "false", "none", "undefined", "select", "insert", "update", "delete", "join",
]
# Facts and relations that say nothing.
VAGUE_FACTS = ["was mentioned", "is mentioned", "appeared in conversation", "fue mencionado", "se mencionó", "was discussed"]
VAGUE_RELATIONS = ["related_to", "co_mentioned", "is_related_to", "mentioned_with"]
# Names that the conversation extractor does not take.
BLACKLIST = [
    "user", "assistant", "bot", "ai", "i", "you", "he", "she", "we", "they", "me", "him", "her",
    "today", "yesterday", "tomorrow", "now", "before", "after", "person", "place", "entity", "activity", "work",
    "conversation", "chat", "session", "message", "question", "answer", "topic", "information", "data",
    "hello", "hi", "bye", "goodbye", "thanks", "please", "hola", "chau", "gracias", "por favor", "buenas",
    "necesito", "neecsito", "quiero", "puedo", "tengo", "como", "cuando", "donde", "porque", "sobre",
    "province", "city", "country", "state", "club", "team", "book", "books", "movie", "movies", "film", "films",
    "novel", "novels", "series", "story", "stories", "character", "characters", "author", "writer",
    "world", "life", "death", "year", "years", "time", "part", "parts", "type", "types", "form", "forms", "thing", "things", "people",
    "culture", "popular", "memory", "internet", "web", "one", "two", "three", "four", "five", "six", "seven", "eight",
    "nine", "ten", "hundred", "thousand",
]
NONE = "array<string>"


def garbage(name: Column) -> Column:
    """Jargon, a name that is never an entity, or one of fewer than two characters."""
    low = F.trim(F.lower(name))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return low.isin(NEVER) | low.isin(JARGON) | ((F.size(words) >= 2) & F.element_at(words, -1).isin(JARGON)) | (F.length(low) < 2)


def vague(relation: Column) -> Column:
    return F.replace(F.lower(relation), F.lit(" "), F.lit("_")).isin(VAGUE_RELATIONS)


def _within(result: Column, entities: Column, names: Column, fold, bad_relation) -> Column:
    """entities, relations and facts that go with the valid names."""
    has = lambda x: F.array_contains(names, fold(x))
    relations = F.filter(result["relations"], lambda r: (has(r["source"]) | has(r["target"])) & ~bad_relation(r["relation"]))
    told = lambda f: F.trim(F.lower(f["fact"]))
    facts = F.filter(result["facts"], lambda f: has(f["entity"]) & (F.length(told(f)) >= 10) & ~told(f).isin(VAGUE_FACTS))
    return F.struct(entities.alias("entities"), F.slice(relations, F.lit(1), F.greatest(F.size(entities) * 2, F.lit(1))).alias("relations"), facts.alias("facts"))


def valid_extraction(result: Column, text: Column) -> Column:
    """What of a reply holds: entities(name, type, existing_id) that are no garbage and occur in the text or in the graph; relations with a
    valid end that say something, two for each entity; facts of valid entities of ten characters or more that say something."""
    low = F.lower(text)
    entities = F.filter(result["entities"], lambda e: ~garbage(e["name"]) & (F.contains(low, F.lower(e["name"])) | (F.coalesce(e["existing_id"], F.lit("")) != "")))
    return _within(result, entities, F.transform(entities, lambda e: F.lower(e["name"])), F.lower, vague)


def valid_conversation(result: Column, text: Column) -> Column:
    """The same for the conversation extractor: entities must occur in the text, names count by case, only co_mentioned is vague."""
    entities = F.filter(result["entities"], lambda e: F.contains(F.lower(text), F.lower(e["name"])))
    return _within(result, entities, F.transform(entities, lambda e: e["name"]), lambda x: x, lambda r: r == "co_mentioned")


ENTITY = "struct<name:string,type:string,layer:string,existing_id:string>"
RELATION = "struct<source:string,target:string,relation:string>"
FACT = "struct<entity:string,fact:string,speaker:string>"


def _list(json_: Column, key: str, item: str) -> Column:
    """The objects in a list of a JSON object; other items, and a value that is no list, are left out."""
    raw = F.coalesce(F.from_json(F.get_json_object(json_, f"$.{key}"), "array<string>"), F.array().cast(NONE))
    return F.filter(F.transform(F.filter(raw, lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, item)), lambda x: x.isNotNull())


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def parsed_entities(items: Column, *, strict: bool = True) -> Column:
    """Entities of a reply: name and type given, the type mapped; ``strict`` also leaves out short and blacklisted names."""
    from loomgraph.functions.ontology import mapped_type

    def layer(e):
        up = F.trim(F.upper(F.coalesce(e["layer"], F.lit(""))))
        return F.when(up.isin("PERSONAL", "UNIVERSAL"), up).otherwise("" if strict else "UNIVERSAL")

    bare = lambda e: F.btrim(F.lower(_text(e["name"])), F.lit("!?.,;:\"'()[]"))
    ok = lambda e: (_text(e["name"]) != "") & (F.length(_text(e["type"])) >= 2) & ((F.length(_text(e["name"])) > 3) & ~bare(e).isin(BLACKLIST) if strict else F.lit(True))
    there = lambda e: F.when(~F.lower(e["existing_id"]).isin("null", "none", ""), e["existing_id"])
    return F.transform(F.filter(items, ok), lambda e: F.struct(_text(e["name"]).alias("name"), mapped_type(e["type"]).alias("type"), layer(e).alias("layer"), there(e).alias("existing_id")))


def parsed_relations(items: Column, ok) -> Column:
    got = F.transform(items, lambda r: F.struct(_text(r["source"]).alias("source"), _text(r["target"]).alias("target"), _text(r["relation"]).alias("relation")))
    return F.filter(got, lambda r: (r["source"] != "") & (r["target"] != "") & ok(r["relation"]))


def parsed_facts(items: Column, least: int = 1) -> Column:
    who = lambda f: F.lower(_text(f["speaker"]))
    got = F.transform(items, lambda f: F.struct(_text(f["entity"]).alias("entity"), _text(f["fact"]).alias("fact"), F.when(who(f) == "assistant", "assistant").otherwise("user").alias("speaker")))
    return F.filter(got, lambda f: (f["entity"] != "") & (F.length(f["fact"]) >= least))


def conversation_reply(json_: Column) -> Column:
    """entities, relations (lower case, three letters or more) and facts of the conversation extractor's JSON object."""
    relations = parsed_relations(_list(json_, "relations", RELATION), lambda r: (F.length(r) >= 3) & (F.lower(r) != "co_mentioned"))
    relations = F.transform(relations, lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), F.lower(r["relation"]).alias("relation")))
    return F.struct(parsed_entities(_list(json_, "entities", ENTITY)).alias("entities"), relations.alias("relations"), parsed_facts(_list(json_, "facts", FACT)).alias("facts"))


def update_reply(json_: Column) -> Column:
    """merges, relations (new ones, then the assistant's), corrections, discards, entities and facts of a graph update's JSON object."""
    merges = F.transform(_list(json_, "merges", "struct<`from`:string,`into`:string,reason:string>"), lambda m: F.struct(_text(m["from"]).alias("old"), _text(m["into"]).alias("new")))
    fixes = F.transform(_list(json_, "type_corrections", "struct<id:string,new_type:string>"), lambda x: F.struct(_text(x["id"]).alias("id"), _text(x["new_type"]).alias("type")))
    drops = F.transform(_list(json_, "discards", "struct<id:string>"), lambda x: _text(x["id"]))
    says = lambda r: (r != "") & ~vague(r)
    return F.struct(
        F.filter(merges, lambda m: (m["old"] != "") & (m["new"] != "") & (m["old"] != m["new"])).alias("merges"),
        F.concat(parsed_relations(_list(json_, "new_relations", RELATION), says), parsed_relations(_list(json_, "assistant_relations", RELATION), says)).alias("relations"),
        F.filter(fixes, lambda x: (x["id"] != "") & (x["type"] != "")).alias("corrections"),
        F.filter(drops, lambda x: x != "").alias("discards"),
        parsed_entities(_list(json_, "assistant_entities", ENTITY), strict=False).alias("entities"),
        parsed_facts(_list(json_, "assistant_facts", FACT), 10).alias("facts"),
    )


def resolved_ends(relations: DataFrame, names: DataFrame) -> DataFrame:
    """relations(source, target, relation) with ends that are a model's id, or a label in any case, put as names(model_id, label) has it."""
    keys = names.select(F.lower("model_id").alias("k"), "label").unionByName(names.select(F.lower("label").alias("k"), "label")).groupBy("k").agg(F.min("label").alias("to"))
    out = relations
    for end in ("source", "target"):
        out = out.join(keys.withColumnRenamed("to", f"__{end}"), F.lower(end) == F.col("k"), "left").drop("k").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    return out


def attached_facts(facts: DataFrame, entities: DataFrame, exact: bool = False) -> DataFrame:
    """facts(entity, ...) that belong to one of entities(id, name), by name in any case, or exactly."""
    fold = (lambda c: F.col(c)) if exact else F.lower
    return facts.join(entities.select("id", fold("name").alias("__k")), fold("entity") == F.col("__k")).drop("__k")


def relevant_web(entities: DataFrame, relations: DataFrame, query: Column, node_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Web entities(id, name) that the query names, that the graph has, or that a relation ties to such; relations with an end among them."""
    direct = entities.filter(F.contains(F.lower(query), F.lower("name"))).unionByName(entities.join(node_ids.select("id"), "id", "left_semi")).select("name").distinct()
    tied = relations.join(direct, F.col("source") == F.col("name"), "left_semi").select(F.col("target").alias("name"))
    tied = tied.unionByName(relations.join(direct, F.col("target") == F.col("name"), "left_semi").select(F.col("source").alias("name")))
    names = direct.unionByName(tied).distinct()
    kept = entities.join(names, "name", "left_semi")
    ends = kept.select(F.col("name").alias("e")).distinct()
    held = relations.join(ends, (F.col("source") == F.col("e")), "left").withColumnRenamed("e", "a").join(ends, F.col("target") == F.col("e"), "left")
    return kept, held.filter("a is not null or e is not null").select(*relations.columns)


def grounded(entities: Column, text: Column) -> Column:
    """Entities (array of names) that occur in the text, without regard to case."""
    return F.filter(entities, lambda e: F.contains(F.lower(text), F.lower(e)))


def valid_relations(relations: Column, entities: Column) -> Column:
    """Relations (array of source, target, relation) with at least one valid end; at most two for each entity, and one at least."""
    ok = F.filter(relations, lambda r: F.array_contains(entities, r["source"]) | F.array_contains(entities, r["target"]))
    return F.slice(ok, F.lit(1), F.greatest(F.size(entities) * 2, F.lit(1)))


def valid_facts(facts: Column, entities: Column) -> Column:
    """Facts (array of entity, fact) of a valid entity, ten characters long or more."""
    return F.filter(facts, lambda f: F.array_contains(entities, f["entity"]) & (F.length(f["fact"]) >= 10))
