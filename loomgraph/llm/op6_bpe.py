"""BPE encoding and decoding for word vocabularies in the tokenizers JSON format.

A text is cut at added tokens, normalised (NFC, white space, lower case), split into words, and each
word's bytes become symbols, the last with the end-of-word suffix.  Merging goes by a segment tree over
the ranks of adjacent pairs: its root names the leftmost pair of the lowest rank; a merge changes three
leaves, each with a logarithmic path to the root; it ends when no pair has a rank.  Decoding joins the
tokens with spaces, as a tokenizer without a decoder does.

Letters, numbers and lower case go by Python's Unicode data; texts with characters that the library's Unicode
version treats otherwise are split by its own normalizer and pre-tokenizer.  Merging is the same for all.

Words are merged once and kept in a dictionary of bounded size per Python worker.

Defined cases: a null text is encoded as an empty one, no tokens; texts may have any length; repeated
rows are encoded alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOCABULARY = "word_bpe_49k.json"
NONE = 1 << 62


def vocabulary_path(name: str) -> str:
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


def byte_symbols() -> list[str]:
    """The printable character of each byte in byte-level BPE: itself, or the next free one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


def char_class(kind: str, most: int) -> str:
    """Ranges of a regular expression's class for the characters of a general category, up to a code point."""
    import regex  # its Unicode data are newer than the standard library's

    text = "".join(chr(i) for i in range(most + 1) if not 0xD800 <= i < 0xE000)
    runs = [x.group() for x in regex.finditer(rf"\p{{{kind}}}+", text)]
    return "".join(re.escape(x[0]) + (f"-{re.escape(x[-1])}" if len(x) > 1 else "") for x in runs)


def word_pattern(most: int) -> re.Pattern:
    letters, numbers = char_class("L", most), char_class("N", most)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


def latin(text: str) -> bool:
    """Whether the pattern over code points up to U+00FF will do, whose classes are bitmaps."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def splitter(j: dict):
    """The library's normalizer and pre-tokenizer of a tokenizer's JSON, without its vocabulary: text to words."""
    from tokenizers import Tokenizer

    bare = Tokenizer.from_str(json.dumps(j | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}))
    byte = {s: b for b, s in enumerate(byte_symbols())}

    def split(text: str) -> list[str]:
        got = bare.pre_tokenizer.pre_tokenize_str(bare.normalizer.normalize_str(text))
        return [bytes(map(byte.__getitem__, x)).decode() for x, _ in got]

    return split


SPACE = "\t-\r \x85\xa0  -     　"  # Unicode's White_Space
BITS, LOW = 20, (1 << 20) - 1  # of an id, and of a place in a word's tree


class WordBPE:
    def __init__(self, path: str, keep: int = 150_000):
        with open(vocabulary_path(path), encoding="utf-8") as f:
            j = json.load(f)
        m = j["model"]
        self.vocab: dict[str, int] = m["vocab"]
        self.suffix = m.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        # left id << BITS | right id -> rank << BITS | merged id
        self.pair: dict[int, int] = {}
        for rank, x in enumerate(m["merges"]):
            a, b = x if isinstance(x, list) else x.split(" ")
            self.pair[self.vocab[a] << BITS | self.vocab[b]] = rank << BITS | self.vocab[a + b]
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        wide, narrow = (word_pattern(most).findall for most in (sys.maxunicode, 0xFF))
        self.words = lambda text: (narrow if latin(text) else wide)(text)
        self.outside = splitter(j)
        self.tried: set[str] = set()
        self.odd: set[str] = set()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        bpe = self

        class Known(dict):
            """Words of late; when it is full it becomes the older half, from which words come back when met again."""

            old: dict = {}

            def __missing__(self, word):
                if len(self) >= keep:
                    self.old = dict(self)
                    self.clear()
                out = self[word] = self.old.get(word) or bpe.packed(bpe.merge(word))
                return out

        self.known = Known()

    def merge(self, word: str) -> list[int]:
        """Ids of one word.  Leaves of the segment tree are rank << bits | place; its root is their minimum."""
        data = word.encode("utf-8", "surrogatepass")
        inner, pair = self.inner, self.pair
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        if n == 1:
            return ids
        if n == 2:
            hit = pair.get(ids[0] << BITS | ids[1])
            return ids if hit is None else [hit & LOW]
        bits = (n - 2).bit_length()
        size = 1 << bits
        place = size - 1
        new = [0] * n  # what the pair that starts at a place becomes
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            hit = pair.get(ids[i] << BITS | ids[i + 1])
            if hit is not None:
                tree[size + i] = hit >> BITS << bits | i
                new[i] = hit & LOW
        for k in range(place, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != NONE:
            i = root & place
            j = after[i]
            ids[i] = new[i]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            changed = [(i, k)]
            if j < n - 1:
                changed.append((j, n))
            if (h := before[i]) >= 0:
                changed.append((h, i))
            for x, y in changed:
                leaf = NONE
                if y < n:
                    hit = pair.get(ids[x] << BITS | ids[y])
                    if hit is not None:
                        leaf = hit >> BITS << bits | x
                        new[x] = hit & LOW
                k = size + x
                if tree[k] == leaf:
                    continue
                tree[k] = leaf
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    if b < a:
                        a = b
                    if tree[k] == a:
                        break
                    tree[k] = a
                    k >>= 1
        return [x for x in ids if x >= 0]

    def packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.token.__getitem__, ids))

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case goes by single characters: no final sigma
            text = text.replace("Σ", "σ")
        return text.lower()

    def split(self, text: str) -> list[str]:
        """The words of a text.

        Unicode versions differ: each character beyond U+00FF is tried once against the library, and texts
        with one that it treats otherwise are split by it.
        """
        if not latin(text):
            for c in set(text) - self.tried:
                self.tried.add(c)
                trial = f"a{c}{c}0 {c}"
                if self.words(self.normal(trial)) != self.outside(trial):
                    self.odd.add(c)
            if not self.odd.isdisjoint(text):
                return self.outside(text)
        return self.words(self.normal(text))

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        if self.cut is None or not any(a in text for a in self.added):
            return list(map(self.known.__getitem__, self.split(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.packed([self.added[part]]))
            elif part:
                out += map(self.known.__getitem__, self.split(part))
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text."""
        got = self.pieces(text or "")
        if not got:
            return b"", ""
        ids, tokens = zip(*got, strict=True)
        return b"".join(ids), " ".join(tokens)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str = VOCABULARY, rows: int = 256) -> DataFrame:
    """docs with a struct __lg_bpe(ids binary, decoded string, n_tokens long); ids are packed as in ``encode``."""
    at, own = docs.columns.index("text"), docs.columns
    stats = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()), T.StructField("n_tokens", T.LongType())])

    def run(parts):
        import pyarrow as pa

        bpe = loaded(path)
        kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string()), ("n_tokens", pa.int64())])
        for whole in parts:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                got = [bpe.encode(t) for t in b.column(at).to_pylist()]
                ids, dec = pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.string())
                n = pa.array([len(x[0]) // 4 for x in got], pa.int64())
                out = pa.StructArray.from_arrays([ids, dec, n], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*b.columns, out], [*own, "__lg_bpe"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__lg_bpe", stats)]))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    b = F.col("__lg_bpe")
    return out.select("doc_id", b["n_tokens"].alias("n_tokens"), F.sha2(b["ids"], 256).alias("ids_sha256"), F.sha2(b["decoded"].cast("binary"), 256).alias("decoded_sha256"))
