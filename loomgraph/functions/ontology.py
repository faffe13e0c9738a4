"""Entity types and relations: a registry that is passed around as a value, and expressions over it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entity types with the attributes expected of them.
TYPES = {
    "Person": ["name", "age", "role", "relation_to_owner"],
    "Character": ["name", "alias", "creator", "universe"],
    "Organization": ["name", "type", "industry", "location"],
    "Universe": ["name", "publisher", "characters"],
    "Publisher": ["name", "founded", "country"],
    "Project": ["name", "stack", "scaffold", "architecture", "modules", "status"],
    "Work": ["name", "type", "author", "genre", "year"],
    "Place": ["name", "type", "region", "country"],
    "Technology": ["name", "type", "version"],
    "Document": ["name", "type", "path", "summary"],
    "Rule": ["description", "applies_to", "technology", "severity"],
    "Event": ["name", "date", "location", "description"],
    "Concept": ["name", "domain", "description"],
    "File": ["path", "language", "content_hash"],
    "Symbol": ["name", "symbol_type", "signature", "start_line", "end_line", "language"],
    "Section": ["name", "heading_level", "start_line", "end_line"],
}

# What model replies call these types.
NAMES = {
    "person": "Person", "character": "Character", "organization": "Organization", "universe": "Universe", "publisher": "Publisher",
    "project": "Project", "work": "Work", "place": "Place", "location": "Place", "technology": "Technology", "document": "Document",
    "rule": "Rule", "event": "Event", "concept": "Concept", "entity": "Unknown", "activity": "Project", "comic": "Work", "file": "File",
    "symbol": "Symbol", "section": "Section", "lugar": "Place", "persona": "Person", "personaje": "Character", "entidad": "Unknown",
    "actividad": "Project", "tecnologia": "Technology", "tecnología": "Technology", "documento": "Document", "regla": "Rule",
    "organizacion": "Organization", "organización": "Organization", "proyecto": "Project", "obra": "Work", "universo": "Universe",
    "editorial": "Publisher",
}

# Types that are common knowledge rather than a user's own.
UNIVERSAL = ["Place", "Technology", "Character", "Universe", "Publisher", "Work", "Event", "Concept", "File", "Symbol", "Section"]

# Relations that are known from the start.
RELATIONS = [
    "is_a", "created_by", "alias_of", "part_of", "set_in", "debuted_in", "published_by", "works_at", "lives_in", "owns", "belongs_to",
    "uses_technology", "has_module", "likes", "related_to", "located_in", "managed_by", "played_for", "played_against", "directed_by",
    "won_against", "lost_to", "maintains", "member_of", "depends_on", "alternative_to", "deployed_on", "produces", "serves",
    "documented_in", "participated_in", "triggered_by", "resulted_in", "contains", "defined_in", "child_of", "imports", "calls", "extends",
    "implements",
]
UPPER = ["IS_A", "CREATED_BY", "ALIAS_OF", "PART_OF", "SET_IN", "DEBUTED_IN", "PUBLISHED_BY", "WORKS_AT", "LIVES_IN", "OWNS", "BELONGS_TO", "USES_TECHNOLOGY", "HAS_MODULE", "LIKES", "RELATED_TO", "CONTAINS", "DEFINED_IN", "CHILD_OF", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS"]


@dataclass(frozen=True)
class Ontology:
    types: dict[str, list[str]] = field(default_factory=lambda: dict(TYPES))
    relations: frozenset[str] = frozenset([*RELATIONS, *UPPER])

    def with_type(self, name: str, attributes: list[str]) -> Ontology:
        return replace(self, types={**self.types, name: attributes})

    def with_relation(self, name: str) -> Ontology:
        return replace(self, relations=self.relations | {name})

    def get_type(self, name: str) -> list[str] | None:
        return self.types.get(name)

    def known(self, kind: Column) -> Column:
        return F.coalesce(kind.isin(list(self.types)), F.lit(False))

    def known_relation(self, relation: Column) -> Column:
        return F.coalesce(relation.isin(sorted(self.relations)), F.lit(False))


def mapped_type(raw: Column) -> Column:
    """The type that a reply's word stands for; another word of three letters or more is a type of its own, a shorter one none."""
    clean = F.trim(F.lower(raw))
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    own = F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1_000_000))
    return F.coalesce(F.try_element_at(names, clean), F.when(F.length(clean) >= 3, own).otherwise("Unknown"))


def universal(kind: Column) -> Column:
    return F.coalesce(kind.isin(UNIVERSAL), F.lit(False))
