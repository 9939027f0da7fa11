"""Words of many texts at once, as 64-bit hashes, by array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken together up to so many bytes; a longer one is taken alone, its words hashed part by part.
CHUNK = 1 << 18
#: An odd number, so that its powers have inverses modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
BLANKS = (0x20, *range(0x09, 0x0E))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts that spread every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A number for each byte, 0 for blanks; LOWER has equal ones for a letter's two cases.
EXACT = mixed(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
EXACT[list(BLANKS)] = 0
LOWER = EXACT.copy()
LOWER[0x41:0x5B] = EXACT[0x61:0x7B]
SOLID = np.ones(256, bool)
SOLID[list(BLANKS)] = False


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k for k below n."""
    made = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(n, x, U)
        row[0] = 1
        made.append(np.multiply.accumulate(row))
    return made[0], made[1]


def parts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about CHUNK bytes that end behind a blank or with the data."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and SOLID[data[end - 1]]:
            blank = np.flatnonzero(~SOLID[data[end : end + CHUNK]])
            end = end + int(blank[0]) + 1 if len(blank) else min(end + CHUNK, len(data))
        yield at, end
        at = end


def words_of(data: np.ndarray, tables: tuple[np.ndarray, ...], counted: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(start, end) of each word of the bytes ``data``, its hash by each of ``tables``, and its sum of each of ``counted``.

    A word's hash is a polynomial of its bytes' numbers, finalised together with its length.
    """
    found: list[tuple] = []
    for at, end in parts(data):
        part = data[at:end]
        solid = SOLID[part]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        up, down = powers(max(CHUNK + 4096, len(part)))
        sizes = (ends - starts).astype(U) * U(BASE)
        hashes = [mixed(np.add.reduceat(t[part] * up[: len(part)], starts) * down[starts] + sizes) for t in tables]
        sums = [np.add.reduceat(t[part], starts, dtype=np.int64) for t in counted]
        found.append((starts + at, ends + at, *hashes, *sums))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, [np.zeros(0, U) for _ in tables], [none for _ in counted]
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return columns[0], columns[1], columns[2 : 2 + len(tables)], columns[2 + len(tables) :]


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' bytes with a line feed behind each, where each begins)."""
    starts = np.cumsum([0, *(len(x) + 1 for x in raws)])[:-1]
    return np.frombuffer(b"\n".join([*raws, b""]), np.uint8), starts


def groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, the texts' bytes) for runs of a column's rows of about CHUNK bytes; null is empty."""
    first, out, size = 0, [], 0
    for k, x in enumerate(texts):
        raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
        if out and size + len(raw) > CHUNK:
            yield first, out
            first, out, size = k, [], 0
        out.append(raw)
        size += len(raw)
    if out:
        yield first, out
