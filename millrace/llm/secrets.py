"""Secrets by keyword prefilter, anchored expressions and embedded checksums.

An Aho-Corasick automaton finds the keywords that every secret has: the names of assignments, key
prefixes, and four hexadecimal digits in a row. Only at such hits does an anchored expression run.
Token formats that carry a checksum are reported only if it holds.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import frugal, with_texts

BASE_KINDS = ("assign", "access", "hex")
#: Found besides the base kinds: checksummed tokens, private key blocks.
MORE_KINDS = ("checked_token", "private_key")
KINDS = BASE_KINDS + MORE_KINDS
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,value:string>>"

# Names of assignments, prefixes of tokens that end in a checksum, a key block's frame.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
CHECKED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
KEY_HEAD = "-----BEGIN "

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(?:[A-Za-z0-9+/=\s:,]|-(?!----))*+-----END \1-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def prefilter() -> ahocorasick.Automaton:
    """Over lower-cased text. Every run of 16 hexadecimal digits has one of the runs of four."""
    found = ahocorasick.Automaton()
    digits = ("hex", 4)
    for x in itertools.product("0123456789abcdef", repeat=4):
        found.add_word("".join(x), digits)
    for x in NAMES:
        found.add_word(x, ("assign", len(x)))
    found.add_word("akia", ("access", 4))
    for x in CHECKED:
        found.add_word(x, ("checked_token", len(x)))
    found.add_word(KEY_HEAD.lower(), ("private_key", len(KEY_HEAD)))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """The CRC32 of a token's body in base 62, six characters."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end) in code points, by start, then kind as listed."""
    found = []
    free = dict.fromkeys(KINDS, 0)  # up to where a kind has consumed the text
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    names = []
    for last, (kind, width) in prefilter().iter(low):
        at = last + 1 - width
        if kind != "hex":
            names.append((at, kind))
        elif at >= free["hex"] and (m := HEX_RUN.match(text, at)):  # none where the hit begins with A-F
            free["hex"] = m.end()
            if m.end() - at >= 16:
                found.append((kind, *m.span()))
    for at, kind in sorted(names):  # hits come by their last character
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[2]) >= 12:
                    found.append((kind, *m.span()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if len(m[0]) >= 18:
                    found.append((kind, *m.span()))
        elif kind == "checked_token":
            if (m := TOKEN.match(text, at)) and checksum(m[1]) == m[2]:
                free[kind] = m.end()
                found.append((kind, *m.span()))
        elif m := KEY_BLOCK.match(text, at):
            free[kind] = m.end()
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans): the secrets of each text.

    Spans are ordered by start, then kind as in ``KINDS``; positions are code points, the end is
    exclusive, ``value`` is the text between. A null or empty text has no spans. Each row is taken
    by itself: repeated rows and null ids pass through, other columns are ignored, an empty table
    gives an empty one. A text of any length is scanned whole.
    """
    rows = with_texts(df).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for batch in batches:
            spans = []
            for x in batch.column(1):
                text = x.as_py()
                spans.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in spans_of(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [id_col, "spans"])

    return rows.mapInArrow(frugal(scan), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, spans {SPAN_TYPE}")


def masked(text: str | None) -> str | None:
    """The text with each secret replaced by its kind in brackets; of overlapping spans the leftmost, longest."""
    if not text:
        return text
    out, end = [], 0
    for kind, a, b in sorted(spans_of(text), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if b <= end:
            continue
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = b
    return "".join(out) + text[end:]


def mask_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets in its text masked.

    All rows and columns stay, repeated rows and null ids too, whatever the columns' names; null and empty texts
    stay as they are; long texts are scanned whole, in time in proportion; an empty table gives an empty one.
    """
    names = with_texts(df).columns
    place = names.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([masked(x.as_py()) for x in batch.column(place)], pa.string())
            columns = list(batch.columns)
            columns[place] = texts
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(frugal(scan), df.schema)
