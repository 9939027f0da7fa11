"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the ASCII control blanks; a word is a longest run of anything else.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a local session gets a
    folder of its own; a session with executors elsewhere gets an error, as they could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/millrace"
    return root.rstrip("/")


def work_root(spark: SparkSession) -> str:
    """This application's folder for tables that cut lineage; it goes with the application."""
    return f"{shared_root(spark)}/millrace-{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str) -> tuple:
    """(the Hadoop file system of ``path``, the path there)."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark would take, so that other libraries find the same place."""
    fs, found = folder(spark, path)
    return fs.makeQualified(found).toString()


def remove(spark: SparkSession, path: str) -> None:
    fs, found = folder(spark, path)
    fs.delete(found, True)


#: The tables settled in each open ``Scope``, innermost last.
OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


class Scope:
    """``with Scope(spark) as scope: ...`` deletes at its end the tables settled inside, but for those that ``scope.out`` settles."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> Scope:
        OPEN.set((*OPEN.get(), self.paths))
        return self

    def out(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` settled outside, where it stays until the scope around ends; ``kept`` has its path."""
        inside = OPEN.get()
        OPEN.set((*inside[:-1], self.kept))
        try:
            return settle(df, label)
        finally:
            OPEN.set(inside)
            if len(inside) > 1:
                inside[-2].extend(self.kept)

    def __exit__(self, *error: object) -> None:
        OPEN.set(OPEN.get()[:-1])
        for path in self.paths:
            remove(self.spark, path)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation.

    The table goes with the ``Scope`` that is open, or else when the application ends.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    fs, root = folder(spark, work_root(spark))
    fs.deleteOnExit(root)
    if OPEN.get():
        OPEN.get()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many rows, the side of a join that has a few short columns is broadcast: some 10 MB.
BROADCAST_ROWS = 200_000
#: A sieve has at most two to this power of rows, each of 64 bits, however many keys it stands for.
SIEVE_SLOTS = 1 << 19


def is_small(df: DataFrame) -> bool:
    """Whether a count shows that ``df``, settled before, may be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """``df``, settled before, to be joined: broadcast if a count shows that it is small, by shuffle otherwise."""
    return F.broadcast(df) if is_small(df) else df


def sieve(wanted: DataFrame, key: str) -> DataFrame:
    """(slot, bits): a bitmap of the hash-like keys ``key``. Its size has a bound, so it may be broadcast; the more keys, the more others pass too."""
    slot, bit = F.pmod(key, F.lit(SIEVE_SLOTS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))
    return wanted.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def sifted(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose key may be among those of ``wanted``, and rows whose key is not; neither needs a shuffle."""
    found = F.broadcast(settle(sieve(wanted, key), "sieve")).alias("s")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.col(f"d.{key}")), F.lit(64)).cast("int"))
    joined = df.alias("d").join(found, F.pmod(F.col(f"d.{key}"), F.lit(SIEVE_SLOTS)) == F.col("s.slot"), "left")
    held = F.coalesce(F.col("s.bits").bitwiseAND(bit) != 0, F.lit(False))
    return joined.where(held).select("d.*"), joined.where(~held).select("d.*")


def met(df: DataFrame, key: str, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` and ``side``, settled before, ready to be joined where ``key`` agrees: a small side is broadcast, before a large one ``df`` is sifted."""
    return (df, F.broadcast(side)) if is_small(side) else (sifted(df, key, side)[0], side)


def clear_work(spark: SparkSession) -> None:
    """Delete the tables that this application has settled; none may be in use."""
    remove(spark, work_root(spark))


#: Bytes of an Arrow batch of texts, unless the session has another bound than Spark's own of 64 MB.
BATCH_BYTES = 2 << 20
SPARKS_OWN = "67108864b"


def with_texts(df: DataFrame) -> DataFrame:
    """``df``, whose texts are about to go to Python: the session's Arrow batches get a smaller bound in bytes, as a few columns of Python objects follow from each."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == SPARKS_OWN:
        conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not all C libraries have it
    if trim:
        trim(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a task's batches; at its end the worker, which Spark reuses, gives memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def span_strings(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans of these kinds, comma-joined in their order."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
