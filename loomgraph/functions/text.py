"""Text scalars as Column expressions: ids, normal forms, token estimates, classifiers."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored when facts are compared.
ARTICLES = ["el", "la", "los", "las", "un", "una", "de", "del", "en", "the", "a", "an", "of", "in"]

# Signs of a question for details, and of one for a concept.
SPECIFIC = [
    r"\b(show\s+me|display|print|output|paste|give\s+me)\b",
    r"\b(code|function|method|class|variable|import|snippet|implementation)\b",
    r"\b(line\s+\d+|lines?\s+\d+[-–]\d+)\b",
    r"\b(syntax|signature|parameter|argument|return\s+type)\b",
    r"\b(how\s+many|how\s+much|count|number\s+of|percentage|ratio)\b",
    r"\b(exact|exactly|specific|precisely|literal)\b",
    r"\b(date|timestamp|version|release|deadline)\b",
    r"\b\d{4}[-/]\d{2}[-/]\d{2}\b",
    r"\b(step[\s-]by[\s-]step|instructions|how\s+to|tutorial|guide)\b",
    r"\b(example|sample|demo|walkthrough)\b",
    r"\b(file|document|section|chapter|paragraph|page)\b",
    r"\b(says?\s+about|mentions?|states?|contains?|includes?)\b",
    r"\b(quote|excerpt|passage|text)\b",
    r"\b(config|setting|option|flag|env|environment)\b",
    r"\b(error|exception|traceback|stack\s+trace|bug|issue)\b",
]
CONCEPTUAL = [
    r"\b(what\s+is|what\s+are|define|definition|meaning)\b",
    r"\b(explain|describe|overview|summary|summarize)\b",
    r"\b(why|purpose|reason|motivation|goal|philosophy)\b",
    r"\b(difference\s+between|compare|contrast|versus|vs)\b",
    r"\b(concept|idea|approach|strategy|pattern|paradigm)\b",
    r"\b(opinion|think|feel|recommend|suggest|advice)\b",
    r"\b(pros?\s+and\s+cons?|trade[\s-]?offs?|advantages?|disadvantages?)\b",
    r"\b(in\s+general|broadly|overall|high[\s-]level|big\s+picture)\b",
]

# Phrases that announce a change of topic.
CHANGE = [
    "cambiando de tema", "cambiemos de tema", "otra cosa", "ahora sobre", "hablando de otra cosa", "pasemos a",
    "dejando eso", "volviendo a", "te quiero preguntar sobre", "te pregunto otra cosa", "nada que ver pero",
    "changing topic", "on another note", "switching to", "let'?s talk about", "moving on to", "by the way",
    "unrelated,? but", "different question", "going back to",
]

# Phrases that ask for an overview.
OVERVIEW = [
    "cuantos", "cuántos", "how many", "what do we have", "que tenemos", "qué tenemos", "list all", "show all",
    "resumen", "summary", "overview", "inventory", "estructura", "structure",
]


@lru_cache
def decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition (NFKD) holds one ASCII character, these characters, and those with several."""
    one, many = {}, {}
    for k in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        ascii_ = "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if x < "\x80")
        if ascii_:
            (one if len(ascii_) == 1 else many)[chr(k)] = ascii_
    return "".join(one), "".join(one.values()), many


def fold(c: Column) -> Column:
    """Lower case, decomposed, without the non-ASCII characters that remain."""
    accented, plain, many = decomposed()
    low = F.lower(c)
    spread = F.from_json(F.lit(json.dumps(many, ensure_ascii=False)), "map<string,string>")
    letters = F.transform(F.split(low, ""), lambda x: F.coalesce(F.try_element_at(spread, x), x))
    wide = F.when(low.rlike(f"[{''.join(many)}]"), F.array_join(letters, "")).otherwise(low)
    bare = F.regexp_replace(F.translate(wide, accented, plain), r"[^\x00-\x7F]", "")
    return F.when(low.rlike(r"[^\x00-\x7F]"), bare).otherwise(low)


def make_id(c: Column) -> Column:
    return F.btrim(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), F.lit("_"))


def dedup_form(c: Column) -> Column:
    """What two facts must share to be the same: no marks, punctuation, articles or doubled spaces."""
    bare = F.regexp_replace(fold(c), r"[^a-z0-9\s]", "")
    bare = F.regexp_replace(bare, rf"\b({'|'.join(ARTICLES)})\b", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def word_list(c: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def count_tokens(c: Column) -> Column:
    """Estimate: 1.3 tokens a word, at least 1."""
    return F.greatest(F.lit(1), (F.size(word_list(c)).cast("double") * 1.3).cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def specificity(c: Column) -> Column:
    """specific if at least as many signs of detail as of concepts occur, each sign counting once."""
    score = lambda signs: reduce(lambda x, y: x + y, [c.rlike(f"(?i){p}").cast("int") for p in signs])
    return F.when(score(SPECIFIC) >= score(CONCEPTUAL), "specific").otherwise("conceptual")


def change_phrase(c: Column) -> Column:
    """The first phrase that announces a new topic, in lower case; empty without one."""
    return F.lower(F.regexp_extract(c, f"(?i)({'|'.join(CHANGE)})", 1))


def asks_overview(c: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(F.lower(c), F.lit(p)) for p in OVERVIEW])


def strip_think(c: Column) -> Column:
    """Without <think> blocks, closed ones and one left open at the end."""
    closed = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(closed, r"(?s)<think>.*$", ""))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 2), F.lit(".."))).otherwise(c)


def symbol_id(path: Column, name: Column, parent: Column | None = None) -> Column:
    """Id of a unit within a file: the file's, its parent's if it has one, and its own."""
    parts = [make_id(path), *([F.when(parent.isNotNull() & (parent != ""), make_id(parent))] if parent is not None else []), make_id(name)]
    return F.concat_ws("__", *parts)


def plain_id(name: Column) -> Column:
    """The activator's own id: lower case, trimmed, spaces as underscores; accents stay."""
    return F.replace(F.trim(F.lower(name)), F.lit(" "), F.lit("_"))


def strip_fences(c: Column) -> Column:
    """A reply without think blocks and code fences."""
    return F.trim(F.regexp_replace(strip_think(c), r"```(?:json)?\s*", ""))


def topic_verdict(similarity: Column, threshold: float = 0.65) -> Column:
    """same, changed or undecided by the similarity of embeddings; undecided without one."""
    return F.when(similarity >= 0.80, "same").when(similarity < threshold, "changed").otherwise("undecided")


# What the extractor is told about the topic.
HINTS = {
    "keyword": "same (high confidence from keyword match)",
    "same": "same (high confidence from embedding similarity)",
    "changed": "changed (medium confidence — verify)",
    "open": "unresolved — classify the topic yourself",
}


def topic_hint(keyword: Column, similarity: Column, verdict: Column, topic: Column) -> Column:
    """A keyword settles it, then the similarity, then the verdict between its bounds."""
    between = F.when(verdict == "subtopic", F.concat(F.lit("subtopic of "), topic, F.lit(" (medium confidence — verify)"))).when(verdict == "changed", HINTS["changed"]).otherwise(HINTS["same"])
    known = F.when(similarity >= 0.80, HINTS["same"]).when(similarity < 0.65, HINTS["changed"]).otherwise(between)
    return F.when(F.coalesce(keyword, F.lit("")) != "", HINTS["keyword"]).when(verdict.isNotNull() & similarity.isNotNull(), known).otherwise(HINTS["open"])


# A relation as its target would put it.
REVERSED = {
    "located_in": "contains", "managed_by": "manages", "part_of": "includes", "belongs_to": "has_member", "played_for": "has_player",
    "lives_in": "has_resident", "ubicado_en": "contains", "tecnico_de": "manages", "parte_de": "includes", "hincha_de": "fan",
    "juega_en": "has_player", "pertenece_a": "has_member",
}


def reverse_relation(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REVERSED.items() for x in kv]), c), c)


# Signs of a reply without data.
NO_DATA = [
    "i don't have information", "i don't have data", "i can search", "would you like me to search", "shall i look",
    "no tengo información", "no tengo datos", "puedo buscar", "busque en internet", "querés que busque", "quieres que busque",
]


def says_no_data(c: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(F.lower(c), F.lit(p)) for p in NO_DATA])


def blocks_text(blocks: Column) -> Column:
    """The text of content blocks (array of type, text), joined by spaces."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")


def target_url(header: str | None, configured: str) -> str:
    """The header's address, else the configured one, without /v1 and slashes at the end."""
    return (header or configured).rstrip("/").removesuffix("/v1").rstrip("/")
