"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts are a group. A group that takes over half of a shard of any resource is cut into
pieces; large groups and pieces are items of their own; all other groups are dealt by their digest
into a fixed number of bundles, which are the other items. So what is packed on the driver is
bounded by the number of shards, whatever the number of documents. Items go, largest first, to the
shard where the dot product of the item with the shard's residual capacity is highest, among the
shards that are about equally far from full in bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import n_words, settle

N_SHARDS = 40
#: Bundles a shard: the grain of small groups.
BUNDLES = 256
#: Groups over this part of a shard are items, those over WHOLE are cut into pieces of about this part.
LARGE, WHOLE = 1 / 16, 1 / 2
#: Of a cut group, rows of one id that are over this part of a shard are dealt to its pieces row by row.
COPIES = 1 / 256
#: Part of a shard's bytes by which shards may differ in the end.
GIVE = 0.005
RESOURCES = ("bytes", "tokens", "rows")
#: Bytes of a row besides its text.
ROW_BYTES = 16


def place(items: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each item; ``items`` has a row of RESOURCES each.

    Resources are in parts of a shard's share. An item goes where item . residual is highest, among
    the shards with about most bytes left: less than the most by half of what is left on average,
    GIVE, or the item's bytes, whichever is most. Items go by their largest part, then by bytes, so bytes end equal but for the last items. Ties go to the lower number.
    """
    shares = items / np.maximum(items.sum(axis=0) / n_shards, 1e-12)
    left = np.ones((n_shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for k in np.lexsort((np.arange(len(items)), -shares[:, 0], -shares.max(axis=1))) if len(items) else ():
        x = shares[k]
        near = left[:, 0] >= left[:, 0].max() - max(left[:, 0].mean() / 2, GIVE, x[0])
        at = int(np.argmax(np.where(near, left @ x, -np.inf)))
        out[k] = at
        left[at] -= x
    return out


def measured(df: DataFrame) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, digest, salt): a null text is taken as an empty one; words stand for tokens; salts differ, and are fixed once the rows are settled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), n_words(text).alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("salt")
    )


def sums() -> list[Column]:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]


def shard(df: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``df``: doc_id, text.

    Slots count from 0 in each shard without gaps. Rows with equal texts share a shard unless they
    are over half of one. Repeated rows and null ids are rows like others, and a group of them is
    cut like others; rows that agree in id and text may swap places. Other columns are ignored. An empty table gives an empty one.
    """
    spark = df.sparkSession
    rows = settle(measured(df), "shard-rows")
    total = rows.agg(*sums()).first()
    caps = {x: max(total[x] or 0, 1) / n_shards for x in RESOURCES}
    share = F.greatest(*(F.col(x) / F.lit(caps[x]) for x in RESOURCES))
    # At most n_shards / LARGE groups a resource.
    large = settle(rows.groupBy("digest").agg(*sums()).withColumn("share", share).where(F.col("share") > LARGE), "shard-large")
    pieces = F.when(F.col("share") > WHOLE, F.least(F.col("rows"), F.ceil(F.col("share") / F.lit(LARGE)))).otherwise(F.lit(1)).cast("long")
    known = F.broadcast(large.select("digest", pieces.alias("pieces"), F.lit(True).alias("large")))
    # Within cut groups, ids of many rows: at most n_shards / COPIES a resource.
    cut = F.broadcast(large.select("digest", pieces.alias("pieces")).where("pieces > 1"))
    copies = settle(rows.join(cut, "digest").groupBy("digest", "doc_id").agg(*sums()).where(share > COPIES).select("digest", "doc_id", F.lit(True).alias("copied")), "shard-copies")
    alike = (F.col("a.digest") == F.col("b.digest")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("digest"), F.lit(n_shards * BUNDLES)).cast("string"))
    piece = F.concat(F.col("digest"), F.lit("/"), F.pmod(F.when(F.col("copied"), F.xxhash64("salt")).otherwise(F.xxhash64("doc_id")), F.col("pieces")).cast("string"))
    salted = rows.alias("a").join(F.broadcast(copies).alias("b"), alike, "left").select("a.*", "b.copied")
    dealt = salted.join(known, "digest", "left").withColumn("item", F.when(F.col("large"), piece).otherwise(bundle))
    items = sorted(dealt.groupBy("item").agg(*sums()).collect())  # at most a few times n_shards * (BUNDLES + 1 / LARGE)
    shards = place(np.array([[x[r] for r in RESOURCES] for x in items], float).reshape(-1, len(RESOURCES)), n_shards)
    used, starts = [0] * n_shards, []
    for x, at in zip(items, shards, strict=True):
        starts.append((x["item"], int(at), used[at]))
        used[at] += x["rows"]
    placed = F.broadcast(spark.createDataFrame(starts, "item string, shard int, first long"))
    slot = F.row_number().over(Window.partitionBy("item").orderBy("doc_id", "digest")) - 1
    numbered = dealt.select("doc_id", "size", "text_crc32", "item", slot.alias("slot"))
    return numbered.join(placed, "item").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("slot")).cast("long").alias("slot"))
