"""EPUB and PDF files as lines of text with sections, file by file in Arrow batches of binary rows."""

from __future__ import annotations

import posixpath
import re
import zipfile
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame

BOOK = "path string, content_hash string, name string, parent string, start_line int, end_line int, text string"
BREAKS = {"p", "div", "br"}
HEADING = re.compile(r"(#{1,6})\s+(.+)")
LEAST = 50


class _Text(HTMLParser):
    """Text with headings as # lines and a line feed after blocks; script and style are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.mute, self.level, self.in_title = [], "", 0, 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "title":
            self.in_title = True
        elif re.fullmatch(r"h[1-6]", tag):
            self.level = int(tag[1])
            self.out.append("\n" + "#" * self.level + " ")
        elif tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag == "title":
            self.in_title = False
        elif re.fullmatch(r"h[1-6]", tag) and self.level:
            self.level = 0
            self.out.append("\n")
        elif tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.mute:
            self.out.append(" ".join(data.split()) if self.level else data)


def html_text(html: str) -> tuple[str, str]:
    """(text, title) of a page: lines stripped, at most one blank line in a row."""
    p = _Text()
    p.feed(html)
    p.close()
    joined = re.sub(r"\n{3,}", "\n\n", "".join(p.out))
    return "\n".join(x.strip() for x in joined.split("\n")).strip(), p.title.strip()


def _chapters(raw: bytes):
    """(name, html) of the documents in reading order."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        book = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in book.iter() if e.tag.endswith("}item")}
        for ref in (e.get("idref") for e in book.iter() if e.tag.endswith("}itemref")):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[ref]))
            yield name, z.read(name).decode("utf-8", "replace")


def epub_rows(raw: bytes):
    """(name, parent, start_line, end_line, text) of chapters with 50 characters or more, and of their h2 and h3 parts (text null)."""
    at = 1
    for name, html in _chapters(raw):
        text, title = html_text(html)
        if len(text.strip()) < LEAST:
            continue
        ls = text.split("\n")
        heads = [(i, len(m.group(1)), m.group(2).strip()) for i, x in enumerate(ls) if (m := HEADING.match(x)) and len(m.group(1)) <= 3]
        chapter = heads[0][2] if heads else title or posixpath.basename(name).rsplit(".", 1)[0]
        yield chapter, None, at, at + len(ls) - 1, text
        ends = [h[0] for h in heads[1:]] + [len(ls)]
        for (i, level, part), end in zip(heads, ends, strict=True):
            if level > 1:
                yield part, chapter, at + i, at + end - 1, None
        at += len(ls)


def epub_sections(files: DataFrame) -> DataFrame:
    """Sections of files(path, content): lines are counted through the book; a file that can't be read gives one row without a name."""

    def run(parts):
        import hashlib

        import pyarrow as pa

        kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()]
        names = ["path", "content_hash", "name", "parent", "start_line", "end_line", "text"]
        for b in parts:
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                digest = hashlib.sha256(raw or b"").hexdigest()
                try:
                    rows += [(path, digest, *r) for r in list(epub_rows(raw or b""))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration):
                    rows.append((path, digest, None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, BOOK)


def page_sections(pages: DataFrame) -> DataFrame:
    """path, name, start_line, end_line of pages(path, page, text) that a PDF reader gave: one section for each page with text."""
    from pyspark.sql import functions as F
    from pyspark.sql import Window as W

    p = pages.filter(F.trim("text") != "").withColumn("n", F.size(F.split("text", "\n", -1)))
    end = F.sum("n").over(W.partitionBy("path").orderBy("page").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    first = F.get(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return p.select("path", F.coalesce(F.substring(first, 1, 80), F.concat(F.lit("Page "), "page")).alias("name"), (end - F.col("n") + 1).alias("start_line"), end.alias("end_line"))
