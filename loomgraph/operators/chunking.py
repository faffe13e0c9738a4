"""Chunks of source files by their structural units: code, Markdown, prose.

A file's text and units are one row; chunks are cut from it in Arrow batches, file by file.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2000
CHUNK = "path string, chunk_index int, name string, kind string, line_start int, line_end int, content string, language string"


def code_chunks(units: list[dict], lines: list[str], most: int = MOST) -> list[tuple]:
    """One chunk a unit; a longer one is cut at the first blank line, or its last line, after ``most`` characters."""
    out = []
    for u in units:
        own = lines[u["start_line"] - 1 : u["end_line"]]
        if len("\n".join(own)) <= most:
            out.append((u["name"], u["kind"], u["start_line"], u["end_line"], "\n".join(own)))
            continue
        begin = size = part = 0
        for i, line in enumerate(own):
            size += len(line) + 1
            if size >= most and (not line.strip() or i == len(own) - 1):
                out.append((f"{u['name']}[{part}]", u["kind"], u["start_line"] + begin, u["start_line"] + i, "\n".join(own[begin : i + 1])))
                begin, size, part = i + 1, 0, part + 1
        if begin < len(own):
            out.append((f"{u['name']}[{part}]", u["kind"], u["start_line"] + begin, u["end_line"], "\n".join(own[begin:])))
    return out


def clusters(name: str, kind: str, start: int, own: list[str], most: int = MOST) -> list[tuple]:
    """Paragraphs, runs of lines that are not blank, joined by blank lines while they fit; a longer one stands alone."""
    paras, run = [], []
    for i, line in enumerate([*own, ""]):
        if line.strip():
            run.append((start + i, line))
        elif run:
            paras.append((run[0][0], run[-1][0], "\n".join(x for _, x in run)))
            run = []
    out: list[list] = []
    for a, b, text in paras:
        if out and len(out[-1][2]) + 2 + len(text) <= most:
            out[-1][1:] = [b, f"{out[-1][2]}\n\n{text}"]
        else:
            out.append([a, b, text])
    return [(name, kind, a, b, text) for a, b, text in out]


def markdown_chunks(units: list[dict], lines: list[str], most: int = MOST) -> list[tuple]:
    """One chunk a section under ``parent > name``; sections of fewer than 20 characters drop out, longer ones are cut by paragraphs."""
    out = []
    for u in units:
        own = lines[u["start_line"] - 1 : u["end_line"]]
        text = "\n".join(own)
        name = f"{u['parent']} > {u['name']}" if u["parent"] else u["name"]
        if len(text.strip()) < 20:
            continue
        out += [(name, "section", u["start_line"], u["end_line"], text)] if len(text) <= most else clusters(name, "section", u["start_line"], own, most)
    return out


def prose_chunks(units: list[dict], lines: list[str], most: int = MOST) -> list[tuple]:
    whole = [{"name": "", "kind": "section", "start_line": 1, "end_line": len(lines)}]
    return [c for u in units or whole for c in clusters(u["name"], u["kind"], u["start_line"], lines[u["start_line"] - 1 : u["end_line"]], most)]


def file_chunks(files: DataFrame, units: DataFrame, most: int = MOST) -> DataFrame:
    """Chunks of files(path, language, text) by units(path, name, kind, parent, start_line, end_line), cut as the language asks."""
    u = units.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name", "kind", "parent"))).alias("units"))
    whole = files.select("path", "language", "text").join(u, "path", "left")

    def run(parts):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for b in parts:
            rows = []
            for r in b.to_pylist():
                lines, own = (r["text"] or "").split("\n"), r["units"] or []
                cut = markdown_chunks if r["language"] == "markdown" else prose_chunks if r["language"] in ("epub", "pdf", "plaintext") else code_chunks
                rows += [(r["path"], k, *c, r["language"]) for k, c in enumerate(cut(own, lines, most))]
            cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in CHUNK.split(", ")])

    return whole.mapInArrow(run, CHUNK)


def embedding_text(path: Column, kind: Column, name: Column, content: Column) -> Column:
    """What is embedded of a chunk: its file, its unit if it has a name, its content."""
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), F.when(name != "", F.concat(F.lit("["), kind, F.lit(": "), name, F.lit("]"))), content)


def summaries(replies: DataFrame) -> DataFrame:
    """replies(chunk_id, reply) with summary and topics: of the reply's JSON object, else its first 200 characters and no topics."""
    from .extract import json_object

    j = json_object(replies, "reply")
    own = F.get_json_object("json", "$.summary")
    topics = F.coalesce(F.from_json(F.get_json_object("json", "$.topics"), "array<string>"), F.array().cast("array<string>"))
    return j.select("chunk_id", F.coalesce(own, F.substring(F.trim("reply"), 1, 200)).alias("summary"), topics.alias("topics"))


