"""Best-fit packing by patterns.

Documents are tokenised and cut into pieces of at most ``SEQUENCE`` tokens. Only the histogram of
piece lengths, at most ``SEQUENCE`` numbers, decides the packing: patterns of a few lengths that
fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded, and what is left is packed best fit, longest first. The plan is a list of
segments per length; a piece finds its place by its rank among the pieces of its length.
"""

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import frugal, give_back, settle, with_texts

SEQUENCE = 1024
#: The id that ends each document.
END_ID = 2
#: At most so many documents of one length in an enumerated pattern.
MOST_EQUAL = 8
ROUNDS = 400
#: Pieces a ranking bucket.
BUCKET_PIECES = 100_000

#: Characters on which the two tokenising libraries cannot differ: the others go to the slower one.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*+\Z")
#: Runs that the faster library's expressions do not bear.
LONG_RUN = re.compile(r"\s{5000}|\S{5000}")


@lru_cache(maxsize=2)
def own_encoder(path: str):
    """The file's own library; loaded only where a text needs it, as it takes memory."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """(an encoder of the same merges that is four times as fast, the special tokens)."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model.get("added_tokens", ())}
    # The printable stand-ins for bytes of byte-level vocabularies. Printable Latin-1 stands for itself, the others follow from U+0100.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the public vocabulary's own word pattern
    return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={}), tuple(special)


def token_ids(text: str, path: str) -> np.ndarray:
    """The document's ids, with END_ID behind them, as the file's own library gives them."""
    fast, special = fast_encoder(path)
    if COMMON.match(text) and not any(x in text for x in special) and not (len(text) > 5000 and LONG_RUN.search(text)):
        ids = fast.encode_to_numpy(text)
    else:
        ids = np.array(own_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids, np.uint32(END_ID)).astype("<u4")


def bounds(n: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones behind one that may be shorter."""
    first = n - (n - 1) // SEQUENCE * SEQUENCE
    return [(0, first), *((s, SEQUENCE) for s in range(first, n, SEQUENCE))]


def tokenise(df: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) for each piece of each row's text; null text is empty.

    Every row has a piece, as END_ID is always there; repeated rows and null ids are rows like
    others; other columns are ignored; an empty table gives an empty one. ``with_ids``: without it
    the ids themselves are left out.
    """
    rows = with_texts(df).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            taken, out = [], []
            for k, x in enumerate(batch.column(1)):
                ids = token_ids(x.as_py(), path)
                for piece, (start, length) in enumerate(bounds(len(ids))):
                    own = ids[start : start + length]
                    taken.append(k)
                    out.append((piece, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            made = [batch.column(0).take(pa.array(taken, pa.int64())), *columns]
            yield pa.RecordBatch.from_arrays(made[: 5 + with_ids], names[: 5 + with_ids])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(frugal(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def patterns(counts: np.ndarray) -> np.ndarray:
    """Patterns that fill a sequence, as rows of lengths with 0 for none: a pair, a triple, or up to MOST_EQUAL of one length and one other."""
    have = counts > 0
    lengths = np.flatnonzero(have)
    found = []
    i, j = np.meshgrid(lengths.astype(np.int16), lengths.astype(np.int16), indexing="ij", sparse=True)
    k = SEQUENCE - i - j
    for n, ok in ((2, (i <= j) & (k == 0)), (3, (i <= j) & (k >= j) & have[np.clip(k, 0, SEQUENCE)] & (k > 0))):
        a, b = np.nonzero(ok)
        found.append(np.stack([lengths[a], lengths[b], SEQUENCE - lengths[a] - lengths[b]][:n], axis=1))
    for m in range(3, MOST_EQUAL + 1):
        other = SEQUENCE - m * lengths
        ok = (other == 0) | (other > 0) & have[np.clip(other, 0, SEQUENCE)]
        found.append(np.concatenate([np.repeat(lengths[ok, None], m, axis=1), other[ok, None]], axis=1))
    width = MOST_EQUAL + 1
    return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in found]).astype(np.int64)


def fitted(shapes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns, least squares to the histogram, by multiplicative steps, which keep signs."""
    if not len(shapes):
        return np.zeros(0)
    rows, part = np.nonzero(shapes)
    at = shapes[rows, part]
    uses = np.bincount(at, minlength=SEQUENCE + 1)
    aim = np.bincount(rows, weights=counts[at], minlength=len(shapes))
    x = np.bincount(rows, weights=(counts / np.maximum(uses, 1))[at], minlength=len(shapes)) / np.bincount(rows, minlength=len(shapes))
    for _ in range(ROUNDS):
        made = np.bincount(at, weights=x[rows], minlength=SEQUENCE + 1)
        x *= aim / np.maximum(np.bincount(rows, weights=made[at], minlength=len(shapes)), 1e-12)
    return x


def plan(histogram: dict[int, int]) -> np.ndarray:
    """Segments (length, first rank, pieces, first sequence, offset), sorted: the pieces of these ranks go to sequences one after the other."""
    left = np.zeros(SEQUENCE + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    ranks = np.zeros(SEQUENCE + 1, np.int64)
    segments: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        segments.append((length, int(ranks[length]), n, sequence, offset))
        ranks[length] += n
        left[length] -= n

    if left[SEQUENCE]:
        n = int(left[SEQUENCE])
        put(SEQUENCE, n, 0, 0)
        sequences = n
    shapes = patterns(left)
    repeats = fitted(shapes, left.astype(float))
    for k in np.argsort(-repeats, kind="stable"):
        n = int(np.floor(repeats[k] + 0.5))
        if n <= 0:
            break
        lengths, times = np.unique(shapes[k][shapes[k] > 0], return_counts=True)
        n = min(n, int((left[lengths] // times).min()))
        if n <= 0:
            continue
        offset = 0
        for length in shapes[k][shapes[k] > 0]:
            put(int(length), n, sequences, offset)
            offset += int(length)
        sequences += n
    # Best fit, longest first, for runs of sequences with equal room.
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length in range(SEQUENCE, 0, -1):
        while left[length]:
            best = next((r for r in range(length, SEQUENCE) if room.get(r)), None)
            if best is None:
                n = int(left[length])
                each = SEQUENCE // length
                first, n = sequences, -(-n // each)
                sequences += n
                best = SEQUENCE
            else:
                first, n = room[best].pop()
            each = min(best // length, -(-int(left[length]) // n)) if best < SEQUENCE else SEQUENCE // length
            used = SEQUENCE - best
            for _ in range(each):
                m = min(n, int(left[length]))
                if not m:
                    break
                put(length, m, first, used)
                if m < n:
                    if used < SEQUENCE:
                        room[SEQUENCE - used].append((first + m, n - m))
                    n = m
                used += length
            if used < SEQUENCE:
                room[SEQUENCE - used].append((first, n))
    return np.array(sorted(segments), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with sequence_id and offset, which replace columns of these names.

    Pieces of a length are ranked by a hash of (doc_id, piece), in buckets, so that a frequent
    length is spread over tasks. Repeated pieces and null ids are pieces like others, and ties between them
    go either way. Sequences hold at most SEQUENCE tokens without gaps. Lengths are from 1 to
    SEQUENCE, without nulls. ``pieces`` is read several times: settle it first. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark, others = pieces.sparkSession, pieces.columns
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most SEQUENCE rows
    segments = spark.sparkContext.broadcast(plan(histogram))
    give_back()
    buckets = max(16, -(-sum(histogram.values()) // BUCKET_PIECES))
    row = F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")
    dealt = pieces.select(row, "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).alias("bucket"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row.doc_id", "row.piece")) - 1
    ranked = dealt.withColumn("place", rank).join(firsts, ["length", "bucket"]).select("row", "length", (F.col("first") + F.col("place")).cast("long").alias("rank"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segments.value
        # Segments are sorted by length and first rank: the last that is not behind the piece is its own.
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            own = table[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], ["row", "sequence_id", "offset"])

    kind = T.StructType([T.StructField("row", ranked.schema["row"].dataType), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select("row", F.col("length").cast("long"), "rank").mapInArrow(find, kind).select("row.*", "sequence_id", "offset")


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text): a row per piece without its ids."""
    return pack(settle(tokenise(docs, path, with_ids=False), "pieces"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids; a sequence is at most SEQUENCE of them."""
    gathered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return gathered.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
