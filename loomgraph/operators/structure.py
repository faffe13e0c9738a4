"""Structural units of source files: HTML, CSS, plain text, JavaScript and TypeScript, imports and exports.

All take files(path, text).  What regular expressions and windows can tell is native; the two folds whose cuts
depend on earlier cuts run file by file in Arrow batches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .facts import UNIT

# What counts as a component, an id, a custom property and a top-level selector.
COMPONENT = r"<(app-[\w-]+|[A-Z][\w]+)[\s/>]"
HTML_ID = r"id=[\"']([^\"']+)[\"']"
CSS_VARIABLE = r"(--[\w-]+)\s*:"
CSS_SELECTOR = r"^([.#][\w-]+(?:\s*[,>+~]\s*[.#]?[\w-]+)*)\s*\{"

# Languages by suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".md": "markdown", ".html": "html", ".css": "css", ".txt": "plaintext", ".epub": "epub", ".pdf": "pdf"}


def language(path: Column) -> Column:
    """By the suffix, without regard to case; null if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).select("path", (F.col("k") + 1).alias("line_no"), "line")


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, counted from 1, both included."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def html_elements(files: DataFrame) -> DataFrame:
    """path, kind, name, line_no: each component where it occurs first, and every id."""

    def found(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda n, i: F.struct(F.lit(kind).alias("kind"), n.alias("name"), i.alias("at")))

    hits = lines(files).select("path", "line_no", F.explode(F.concat(found(COMPONENT, "component_ref"), found(HTML_ID, "html_id"))).alias("u"))
    every = F.when(F.col("u.kind") == "html_id", F.struct("line_no", "u.at"))
    return hits.groupBy("path", F.col("u.kind").alias("kind"), F.col("u.name").alias("name"), every.alias("__at")).agg(F.min("line_no").alias("line_no")).drop("__at")


def css_units(files: DataFrame) -> DataFrame:
    """path, kind, name, start_line, end_line: custom properties, and selectors that open at depth 0 and close again."""
    braces = lambda ch: F.length("line") - F.length(F.replace("line", F.lit(ch), F.lit("")))
    by = W.partitionBy("path").orderBy("line_no")
    ls = lines(files).withColumn("delta", braces("{") - braces("}"))
    ls = ls.withColumn("after", F.sum("delta").over(by.rowsBetween(W.unboundedPreceding, 0)))
    closes = F.min(F.when(F.col("after") == 0, F.col("line_no"))).over(by.rowsBetween(0, W.unboundedFollowing))
    ls = ls.withColumn("closes", closes)
    name = F.regexp_extract(F.trim("line"), CSS_SELECTOR, 1)
    sel = F.when((F.col("after") - F.col("delta") == 0) & (name != "") & F.col("closes").isNotNull(), F.array(F.struct(F.lit("css_selector").alias("kind"), name.alias("name"), F.col("closes").alias("end_line"))))
    var = F.transform(F.regexp_extract_all("line", F.lit(CSS_VARIABLE), F.lit(1)), lambda v: F.struct(F.lit("css_variable").alias("kind"), v.alias("name"), F.col("line_no").alias("end_line")))
    u = ls.select("path", F.col("line_no").alias("start_line"), F.explode(F.concat(F.coalesce(sel, F.array().cast("array<struct<kind:string,name:string,end_line:int>>")), var)).alias("u"))
    return u.select("path", "u.kind", "u.name", "start_line", "u.end_line")


def by_file(files: DataFrame, parse) -> DataFrame:
    """parse(text) -> rows (kind, name, parent, start_line, end_line), in Arrow batches."""

    def run(parts):
        import pyarrow as pa

        kinds = [pa.string()] * 4 + [pa.int32()] * 2
        names = ["path", "kind", "name", "parent", "start_line", "end_line"]
        for b in parts:
            rows = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in parse(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("path", "text").mapInArrow(run, UNIT)


def _sections(text: str):
    ls = text.split("\n")
    begin, made = 0, 0
    for i in range(len(ls)):
        size, blank = i - begin + 1, not ls[i].strip() and i > 0 and not ls[i - 1].strip()
        last = i == len(ls) - 1
        cut = size > 2 and (blank or size >= 50)
        if not cut and not last:
            continue
        named = [x.strip() for x in ls[begin : i + 1] if x.strip()]
        if named or cut:
            made += 1
            yield "section", named[0][:80] if named else f"Section {made}", None, begin + 1, i + 1
        begin = i + 1


def text_sections(files: DataFrame) -> DataFrame:
    """Sections of plain text: cut after two blank lines or 50 lines, never below three lines; named by the first line with text."""
    return by_file(files, _sections)


# Declarations by their opening words, in order of trial.
_DECLARED = [(re.compile(r"(?:export\s+)?(?:default\s+)?" + p), k) for p, k in [
    (r"(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"(?:abstract\s+)?class\s+(\w+)", "class"), (r"interface\s+(\w+)", "interface"),
    (r"type\s+(\w+)", "type_alias"), (r"const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(|\w+\s*=>)", "function"),
]]
_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*[*#]?(\w+)\s*(?:<[^>]*>)?\([^;]*\{")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with"}
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|/\*.*?\*/|//.*")


def _declarations(text: str):
    """Units that are open wait on a stack with the depth they opened at; a line that falls back to it closes them."""
    depth, comment, waiting, n = 0, False, [], 0
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw
        if comment:
            if "*/" not in line:
                continue
            line, comment = line.split("*/", 1)[1], False
        line = _QUOTED.sub("", line)
        if "/*" in line:
            line, comment = line.split("/*", 1)[0], True
        line = line.strip()
        if depth == 0 and not waiting:
            for pattern, kind in _DECLARED:
                m = pattern.match(line)
                if m:
                    waiting.append([kind, m.group(1), None, n, depth])
                    break
        elif len(waiting) == 1 and waiting[0][0] == "class" and depth == waiting[0][4] + 1:
            m = _METHOD.match(line)
            if m and m.group(1) not in _NOT_METHODS:
                waiting.append(["method", m.group(1), waiting[0][1], n, depth])
        depth += line.count("{") - line.count("}")
        while waiting and depth <= waiting[-1][4] and ("}" in line or line.endswith(";") or n > waiting[-1][3]):
            kind, name, parent, begin, _ = waiting.pop()
            yield kind, name, parent, begin, n
    for kind, name, parent, begin, _ in reversed(waiting):
        yield kind, name, parent, begin, n


def js_units(files: DataFrame) -> DataFrame:
    """Functions, arrow constants, classes with methods, interfaces and type aliases of JavaScript and TypeScript."""
    return by_file(files, _declarations)


# Forms of import and export lines.
PY_IMPORT = r"^(?:from\s+([\w.]+)\s+)?import\s+(.+)"
JS_IMPORT = r"import\s+(?:\{([^}]+)\}|(\w+)|\*\s+as\s+(\w+))\s+from\s+['\"]([^'\"]+)['\"]"
EXPORTS = [(r"^export\s+(?:async\s+)?function\s+(\w+)", "function"), (r"^export\s+class\s+(\w+)", "class"), (r"^export\s+interface\s+(\w+)", "type"), (r"^export\s+type\s+(\w+)", "type"), (r"^export\s+const\s+(\w+)", "variable"), (r"^export\s+default\s+(\w+)", "default")]


def _names(listed: Column) -> Column:
    bare = F.transform(F.split(listed, ","), lambda n: F.trim(F.regexp_replace(F.trim(n), r" as .*$", "")))
    return F.filter(bare, lambda n: (n != "") & (n != "("))


def imports(files: DataFrame) -> DataFrame:
    """path, line_no, source, names, is_local of the import lines of Python and JavaScript files."""
    python = F.col("path").endswith(".py")
    x = F.trim("line")
    listed = _names(F.regexp_replace(F.regexp_extract(x, PY_IMPORT, 2), r"\\+$", ""))
    module = F.regexp_extract(x, PY_IMPORT, 1)
    named, one, star = (F.regexp_extract("line", JS_IMPORT, i) for i in (1, 2, 3))
    js = F.when(named != "", _names(named)).when(one != "", F.array(one)).otherwise(F.array(F.concat(F.lit("* as "), star)))
    hit = lines(files).filter(F.when(python, x.rlike(PY_IMPORT)).otherwise(F.col("line").rlike(JS_IMPORT)))
    source = F.when(python, F.when(module != "", module).otherwise(F.get(listed, F.lit(0)))).otherwise(F.regexp_extract("line", JS_IMPORT, 4))
    out = hit.select("path", "line_no", source.alias("source"), F.when(python, listed).otherwise(js).alias("names"))
    return out.withColumn("is_local", F.col("source").startswith("."))


def exports(files: DataFrame) -> DataFrame:
    """path, line_no, name, kind of the export lines of JavaScript files."""
    x = F.trim("line")
    kind = F.coalesce(*[F.when(x.rlike(p), k) for p, k in EXPORTS])
    name = F.coalesce(*[F.when(x.rlike(p), F.regexp_extract(x, p, 1)) for p, _ in EXPORTS])
    return lines(files).select("path", "line_no", name.alias("name"), kind.alias("kind")).filter("kind is not null")


def normal_path(path: Column) -> Column:
    """Without . steps; a .. step takes back the one before it."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != ".") & (s != ""))
    back = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), back), "/")


def folders(files: DataFrame) -> DataFrame:
    """source, target, kind: every folder above the files, by its path, and what it holds directly."""
    steps = F.split("path", "/")
    chain = files.select("path", steps.alias("s")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(F.array_join(F.slice("s", F.lit(1), i - 1), "/").alias("source"), F.array_join(F.slice("s", F.lit(1), i), "/").alias("target"), F.when(i == F.size("s"), "file").otherwise("folder").alias("kind")))).alias("e"))
    return chain.select("e.source", "e.target", "e.kind").filter("source <> ''").distinct()
