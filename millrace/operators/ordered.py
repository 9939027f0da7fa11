"""Operators on ordered rows that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank as ``rn``; Catalyst cuts each task's rows to k a key before the shuffle.

    Null keys are one key; ties in ``order`` go either way; a column ``rn`` of ``df`` is an error; an empty table gives an empty one.
    """
    if "rn" in df.columns:
        raise ValueError("the column rn would be replaced")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= k)


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the latest right row of its key at or before ``on``, null without one.

    One shuffle: both sides are united and the last right row is carried forward. The right row is
    carried as a struct, so its null values count as values. As in SQL, null keys and null times
    match nothing: left rows with one stay, with nulls, and right rows with one are left out. Of right rows with equal times the
    one with the largest values is taken. Names in ``take`` must not be the left side's.
    """
    right = right.dropna(subset=[*by, on])
    own = F.struct(*(F.col(c) for c in left.columns))
    held = F.struct(*(F.col(c) for c in take))
    keys = [F.col(c) for c in (*by, on)]
    lefts = left.select(*keys, F.lit(1).alias("_side"), own.alias("_left"), F.lit(None).cast(right.select(held.alias("s")).schema["s"].dataType).alias("_right"))
    rights = right.select(*keys, F.lit(0).alias("_side"), F.lit(None).cast(left.select(own.alias("s")).schema["s"].dataType).alias("_left"), held.alias("_right"))
    window = Window.partitionBy(*by).orderBy(on, "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lefts.unionByName(rights).withColumn("_at", F.last("_right", ignorenulls=True).over(window))
    known = F.lit(True)
    for k in keys:
        known = known & k.isNotNull()
    return carried.where("_side = 1").select("_left.*", *(F.when(known, F.col(f"_at.{c}")).alias(c) for c in take))


def sessions(df: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, n): runs of a key's rows with at most ``gap`` between neighbours."""
    spans = df.groupBy(key, F.session_window(at, gap).alias("span")).agg(F.count("*").alias("n"))
    return spans.select(key, F.col("span.start").alias("start"), "n")
