"""Media columns: content-addressed payloads in tar shards.

Each task stores the payloads of its rows as lossless greyscale images, once per content, in tar
shards of its own on the shared file system, so that no payload is ever shuffled; the index then keeps
one place per content. Rows carry digest, shard, offset and length. Metadata columns come from range
reads of the images' headers; whole images are read only for features.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import qualified, settle, shared_root, with_texts

#: Bytes of a payload row; a payload is a positive multiple of it.
WIDTH = 64
#: A shard is closed behind the payload that reaches this many bytes.
SHARD_BYTES = 1 << 30
# The image format's signature and a header's bytes up to the data.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
INDEX = "digest string, shard string, offset long, length long"


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """An 8-bit greyscale image, a sample per byte, without row filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from an image's first HEADER_BYTES."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIBB", start[16:26])


def decode(image: bytes) -> bytes:
    width, height, *_ = header(image[:HEADER_BYTES])
    at, data = 8, []
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def store(df: DataFrame) -> DataFrame:
    """Write the payloads of ``df``'s texts; returns the index (digest, shard, offset, length), one row a content.

    A task writes a content once, under names of its own, and its index rows count only if the
    task ends well, so lost executors and repeated tasks leave no wrong rows. The shards stay when
    the application ends. A content that
    several tasks hold is stored by each; the index has the first place by shard and offset. Null
    text is empty; an empty table gives an empty index. ``text`` is the only column read.
    """
    spark = df.sparkSession
    root = qualified(spark, f"{shared_root(spark)}/media-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        seen: set[bytes] = set()
        out, name = None, ""
        for batch in batches:
            rows = []
            for x in batch.column(0):
                payload = payload_of(x.as_py())
                digest = hashlib.sha256(payload)
                if digest.digest() in seen:
                    continue
                seen.add(digest.digest())
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    name = f"shard-{uuid.uuid4().hex}.tar"
                    out = fs.open_output_stream(f"{folder}/{name}")
                image = encode(payload)
                entry = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                entry.size = len(image)
                out.write(entry.tobuf(tarfile.GNU_FORMAT))
                rows.append((digest.hexdigest(), f"{root}/{name}", out.tell(), len(image)))
                out.write(image)
                out.write(bytes(-len(image) % tarfile.BLOCKSIZE))
                if out.tell() >= SHARD_BYTES:
                    out.write(bytes(2 * tarfile.BLOCKSIZE))
                    out.close()
                    out = None
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(2 * tarfile.BLOCKSIZE))
            out.close()

    places = settle(with_texts(df).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(write, INDEX), "media-places")
    return places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def by_shard(index: DataFrame) -> DataFrame:
    """Rows of a shard together, in the order of the file. A shard is one task's writing, bounded by SHARD_BYTES."""
    return index.repartition("shard").sortWithinPartitions("shard", "offset")


def ranges(batch: pa.RecordBatch, opened: dict, most: int | None = None) -> Iterator[bytes]:
    """The stored bytes of the batch's rows, at most ``most`` of each."""
    for shard, offset, length in zip(*(batch.column(x).to_pylist() for x in ("shard", "offset", "length")), strict=True):
        if shard not in opened:
            for f in opened.values():
                f.close()
            opened.clear()
            fs, path = pyarrow.fs.FileSystem.from_uri(shard)
            opened[shard] = fs.open_input_file(path)
        yield opened[shard].read_at(length if most is None else min(most, length), offset)


def describe(index: DataFrame) -> DataFrame:
    """The index with width, height, bit_depth and colour_type, from range reads of the headers alone.

    Rows that repeat are read each; an empty index gives an empty table; a range that holds no image of this store is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            heads = np.array([header(x) for x in ranges(batch, opened, HEADER_BYTES)], np.int32).reshape(-1, 4)
            names = [*batch.schema.names, "width", "height", "bit_depth", "colour_type"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(heads[:, k]) for k in range(4))], names)

    return by_shard(index).mapInArrow(read, f"{INDEX}, width int, height int, bit_depth int, colour_type int")


def features(described: DataFrame) -> DataFrame:
    """Per content (digest, shard, offset, length, ...): what its stored bytes hold, read back whole.

    Each row is taken by itself; an empty table gives an empty one. ``feature``: the header's metadata, and the samples' mean and entropy in bits.
    """
    place = INDEX.replace(" string", "").replace(" long", "").split(", ")
    names = [*place, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            out = []
            shape = zip(*(batch.column(x).to_pylist() for x in ("width", "height", "bit_depth")), strict=True)
            for (width, height, depth), image in zip(shape, ranges(batch, opened), strict=True):
                payload = decode(image)
                share = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
                entropy = -float(np.sum(share[share > 0] * np.log2(share[share > 0])))
                feature = f"gray{depth}:{width}x{height}:mean={float(share @ np.arange(256)):.3f}:entropy={abs(entropy):.3f}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in place), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return described.mapInArrow(read, f"{INDEX}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def referenced(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest): each row's reference to its payload. Null text is empty."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(raw)
    padded = F.greatest(F.ceil(size / WIDTH) * WIDTH, F.lit(WIDTH)).cast("int")
    return df.select("doc_id", size.cast("long").alias("n_bytes"), F.sha2(F.rpad(raw, padded, F.lit(b"\x00")), 256).alias("digest"))


def media_columns(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, digest, shard, offset, length), a row for each of ``df``: doc_id, text.

    The last four are where the payload is stored. Writes the shards. Equal texts have equal values; repeated rows and null ids are rows like
    others; other columns are ignored; an empty table gives an empty one.
    """
    read = features(describe(settle(store(df), "media-index")))
    last = ["digest", "shard", "offset", "length"]
    joined = referenced(df).join(read, "digest")
    return joined.select(*(x for x in joined.columns if x not in last), *last)
