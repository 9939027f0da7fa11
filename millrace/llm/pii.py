"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the places where personal data can be: at-signs, schemes,
plus signs, digits and identifier cues. A local parser then expands each anchor to the boundaries
of the email, address or account around it and validates what it found. Text without anchors costs
the automaton's pass alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import frugal, with_texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: Found besides the base kinds: web and mail addresses, IPv6 and street addresses, account numbers.
MORE_KINDS = ("url", "ipv6", "street", "iban", "account", "ssn")
KINDS = BASE_KINDS + MORE_KINDS
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,value:string>>"

# Anchors.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
#: Names of kinds of streets by where a language has them: "12 Elm Street", "12 rue de la Paix", "Calle Mayor 12", "Lindenstraße 12".
NUMBER_NAME_KIND = ("street", "avenue", "road", "boulevard", "lane", "drive", "court", "square", "terrace", "st", "ave", "rd", "blvd", "ln", "dr")
NUMBER_KIND_NAME = ("rue", "avenue", "boulevard", "chemin", "allée", "quai", "impasse")
KIND_NAME_NUMBER = ("calle", "avenida", "plaza", "paseo", "camino")
NAME_KIND_NUMBER = ("straße", "strasse", "str.", "platz", "weg", "allee", "gasse", "ring", "damm")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "social security")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGIT_RUN = re.compile(r"[0-9]+")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"""[^\s<>"'`{}|\\^]+""")
COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]*::?[0-9A-Fa-f:]*(?![0-9A-Za-z:])")
FULL_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
#: A street's own name: up to four words in capitals, small words between.
NAMES = r"(?:(?:de|du|des|del|la|las|los|le|les|l'|d')\x20?){0,3}[^\W\d_a-z][\w'-]{0,30}(?:\x20(?:(?:de|du|des|del|la|le|y|et)\x20){0,2}[^\W\d_a-z][\w'-]{0,30}){0,3}"
BEFORE = 110  # characters that an address can have before its street's kind
HOUSE = re.compile(r"(?<!\w)[0-9]{1,6}[A-Za-z]?(?:\x20[A-Z][\w'-]{1,30}){1,3}\x20\Z")
HOUSE_AT = re.compile(r"(?<!\w)[0-9]{1,5}(?:\x20?(?:bis|ter))?,?\x20\Z")
NAME_AFTER = re.compile(r"\x20" + NAMES)
NAME_NUMBER = re.compile(r"\x20" + NAMES + r",?\x20(?:[nN][.º°o]{1,2}\x20?)?[0-9]{1,5}(?!\w)")
NAME_BEFORE = re.compile(r"(?<!\w)(?:[^\W\d_a-z][\w'-]{0,30}[\x20-])?[^\W\d_a-z][\w'-]{1,30}[\x20-]?\Z")
NUMBER_AFTER = re.compile(r"\x20[0-9]{1,4}(?:\x20?[a-h])?(?!\w)")
AFTER_CUE = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|#))?\x20?[:#=]?\x20?", re.I)
ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9A-Za-z])")
SSN = re.compile(r"[0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4}(?![0-9A-Za-z])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Over lower-cased text."""
    found = ahocorasick.Automaton()
    for x in "@+0123456789":
        found.add_word(x, (x if x in "@+" else "digit", 1))
    found.add_word("::", ("colons", 2))
    found.add_word(":", ("colon", 1))
    for x in SCHEMES:
        found.add_word(x, ("scheme", len(x)))
    kinds: dict[str, set[str]] = {}
    for form, names in (("end", NUMBER_NAME_KIND), ("middle", NUMBER_KIND_NAME), ("start", KIND_NAME_NUMBER), ("part", NAME_KIND_NUMBER)):
        for x in names:
            kinds.setdefault(x, set()).add(form)
    for x, forms in kinds.items():
        found.add_word(x, (("street", *sorted(forms)), len(x)))
    for x in ACCOUNT_CUES:
        found.add_word(x, (x, len(x)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = int(x) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ssn(text: str) -> bool:
    """Areas 000, 666 and from 900 on, group 00 and serial 0000 are never given out."""
    digits = "".join(x for x in text if x in DIGITS)
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def is_account(text: str) -> bool:
    """Six digits or more that are not all the same."""
    digits = {x for x in text if x in DIGITS}
    return len(digits) > 1


def street_at(text: str, at: int, end: int, forms: tuple[str, ...]) -> tuple[int, int] | None:
    """The address around a street's kind, which is ``text[at:end]``, in one of the forms that the kind takes."""
    if text[end : end + 1].isalnum():
        return None
    first = max(0, at - BEFORE)
    if "end" in forms and text[at].isupper() and (m := HOUSE.search(text[first:at])):
        return first + m.start(), end + (text[end : end + 1] == "." and end - at < 5)
    if "middle" in forms and (n := NAME_AFTER.match(text, end)) and (m := HOUSE_AT.search(text[first:at])):
        return first + m.start(), n.end()
    if "start" in forms and not (at and text[at - 1].isalnum()) and (n := NAME_NUMBER.match(text, end)):
        return at, n.end()
    if "part" in forms and (n := NUMBER_AFTER.match(text, end)) and (m := NAME_BEFORE.search(text[first:at])):
        return first + m.start(), n.end()
    return None


def is_iban(text: str) -> bool:
    compact = text.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(x, 36)) for x in turned)) % 97 == 1


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def is_ipv6(text: str) -> bool:
    parts = text.split(":")
    return text.count("::") == 1 and ":::" not in text and 3 <= len(parts) <= 8 and all(len(x) <= 4 for x in parts) and any(x.isdigit() for x in text)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end) in code points, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys((*KINDS, "chain"), 0)  # up to where a kind has consumed the text

    def keep(kind: str, start: int, end: int) -> None:
        found[kind].append((start, end))
        free[kind] = end

    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    # Lower-casing keeps the places: only ASCII letters change, so that a non-ASCII letter in a street's kind is found in small letters alone.
    for last, (anchor, width) in anchors().iter(low):
        at = last + 1 - width
        if anchor == "digit":
            if at and text[at - 1] in DIGITS:  # the run's first digit has been the anchor
                continue
            if at >= free["ip"]:
                if m := DOTTED.match(text, at):
                    free["ip"] = m.end()
                    if all(map(small, m[0].split("."))):
                        keep("ip", *m.span())
            if at >= free["chain"] and (m := GROUPED.match(text, at)):
                free["chain"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    keep("card", *m.span())
        elif anchor == "@":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                keep("email", start, m.end())
        elif anchor == "+":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                free["phone"] = m.end()
                if 9 <= sum(x in DIGITS for x in m[0]) <= 15:
                    keep("phone", *m.span())
        elif anchor == "scheme":
            if at >= free["url"] and not (at and text[at - 1].isalnum()) and (m := URL.match(text, at + width)):
                end = at + width + len(m[0].rstrip(".,;:!?)]"))
                if end > at + width:
                    keep("url", at, end)
        elif anchor == "colons":
            if at >= free["ipv6"]:
                start = at
                while start > free["ipv6"] and at - start < 40 and text[start - 1] in "0123456789abcdefABCDEF:":
                    start -= 1
                if (m := COLONS.match(text, start, start + 60)) and is_ipv6(m[0]):
                    keep("ipv6", *m.span())
        elif anchor == "colon":
            if at >= free["ipv6"]:
                start = at
                while start > free["ipv6"] and at - start < 4 and text[start - 1] in "0123456789abcdefABCDEF":
                    start -= 1
                if m := FULL_IPV6.match(text, start):
                    keep("ipv6", *m.span())
        elif anchor[0] == "street":
            if (m := street_at(text, at, last + 1, anchor[1:])) and m[0] >= free["street"]:
                keep("street", *m)
        elif not (at and text[at - 1].isalnum()):
            after = AFTER_CUE.match(text, last + 1).end()
            kind, form = {"iban": ("iban", IBAN), "ssn": ("ssn", SSN), "social security": ("ssn", SSN)}.get(anchor, ("account", ACCOUNT))
            if after >= free[kind] and (m := form.match(text, after)):
                if {"iban": is_iban, "ssn": is_ssn, "account": is_account}[kind](m[0]):
                    keep(kind, *m.span())
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans): the personal data of each text.

    Spans are ordered by kind as in ``KINDS``, then start; positions are code points, the end is
    exclusive, ``value`` is the text between. A null or empty text has no spans. Each row is taken
    by itself: repeated rows and null ids pass through, other columns are ignored, an empty table
    gives an empty one. A text of any length is scanned whole in one pass.
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


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the leftmost, longest."""
    out, end = [], 0
    for kind, a, b in sorted(spans_of(text), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
            end = b
    return "".join(out) + text[end:]
