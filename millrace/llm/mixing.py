"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

Targets: the whole is shared by weight, no source above its cap of ``max_epochs`` times its size,
the excess shared again by weight among the others until none is above. With sources ordered by
cap over weight, those that end at their cap come first, so one pass over the sources finds the
water level.

Sampling: a source's target is whole repetitions of all its documents and a seeded fraction of them
once more. The fraction is drawn from each size tier by itself, so documents of all sizes are in it:
tiers, the largest first, get their part of the words as quotas, and what a tier cannot hold
goes on to the next. Of a tier, the documents with the smallest seeded keys are taken that its
quota holds; where they end is found from sizes per key bucket, and then within the one bucket
in which it falls, so no source's documents ever meet in one task. What is then missing, less than
a few documents, is filled from the next documents of all tiers, the largest first.
Rows that agree in id, text and source have one key; if only some of them are taken, they are
numbered, part by part of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import n_words, settle, small

# The weights, dealt to the sources in their order.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the key that make a bucket.
BUCKET_DIGITS = 3
#: So many rows behind the end of each tier's quota are tried for what is missing in the end.
FILLS = 64


def same_source() -> Column:
    return F.col("a.source").eqNullSafe(F.col("b.source"))


def key_of(doc_id: Column, text: Column, seed: str) -> Column:
    """The seeded sampling key: hexadecimal, so its order is the same in any engine."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def tier_of(text: Column) -> Column:
    """Number of binary digits of the text's bytes."""
    return F.length(F.bin(F.octet_length(F.coalesce(text, F.lit("")))))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, tier, key, bucket): a document's size is its number of words, 0 for null text."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), tier_of(F.col("text")).alias("tier"), key_of(F.col("doc_id"), F.col("text"), seed).alias("key"))
    return rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size; one row each) with their target.

    Weights go to the sources by code point, null last. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level if exactly the sources before this one are at their caps; right at the first that stays below its own.
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    tried = weighed.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)
    # No source below its cap: there are no words at all.
    return tried.select("source", "source_size", F.coalesce(F.least("cap", first["level"] * F.col("weight")), F.col("cap")).alias("target"))


def quotas(tiers: DataFrame) -> DataFrame:
    """(source, tier, total, quota): the words that each tier gives to the fraction.

    ``tiers``: source, tier, total (words), least (its smallest document), source_size, need. At most some thirty rows a source meet.
    """
    # Words given up to a tier are the part of ``need`` that its source's words up to it are.
    want = "least(b.need, cast(floor(cast(b.need as double) * (s.above + x.total) / b.source_size + 0.5) as bigint)) - s.given"
    quota = f"if({want} < x.least, 0L, least({want}, x.total))"
    step = f"named_struct('above', s.above + x.total, 'given', s.given + {quota}, 'made', concat(s.made, array(named_struct('tier', x.tier, 'total', x.total, 'quota', {quota}))))"
    start = "named_struct('above', 0L, 'given', 0L, 'made', cast(array() as array<struct<tier:int,total:bigint,quota:bigint>>))"
    by_source = tiers.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("tier", "total", "least")), asc=False).alias("tiers"))
    made = by_source.alias("b").select("b.source", F.expr(f"inline(aggregate(b.tiers, {start}, (s, x) -> {step}, s -> s.made))"))
    return made


def ends(rows: DataFrame, by_bucket: DataFrame, quota: DataFrame) -> DataFrame:
    """(source, tier, quota, cut_bucket, last_bucket, cut_key, copies, passed): where each tier's quota ends.

    Keys before ``cut_key`` are taken, and ``copies`` rows of that key; ``passed`` words in all. Null
    if the whole tier is taken. Up to ``last_bucket`` there are FILLS rows behind it, if there are as many.
    """
    tier = same_source() & (F.col("a.tier") == F.col("b.tier"))
    order = Window.partitionBy("source", "tier").orderBy("bucket")
    upto = by_bucket.withColumn("upto", F.sum("bucket_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n_upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = upto.alias("a").join(small(quota).alias("b"), tier).where("b.quota < b.total").select("a.*", "b.quota", (F.col("a.upto") - F.col("a.bucket_size")).alias("before"))
    at = F.min(F.when(F.col("upto") > F.col("quota"), F.struct("bucket", "before", "n_upto")))
    cut = held.groupBy("source", "tier", "quota").agg(at.alias("cut"))
    last = held.alias("a").join(cut.alias("b"), tier).where((F.col("a.bucket") >= F.col("b.cut.bucket")) & (F.col("a.n_upto") - F.col("a.n") < F.col("b.cut.n_upto") + FILLS))
    cuts = settle(last.groupBy("b.source", "b.tier", "b.quota", "b.cut").agg(F.max("a.bucket").alias("last_bucket")).select("source", "tier", "quota", "cut", "last_bucket"), "mix-cuts")
    inside = rows.alias("a").join(small(cuts).alias("b"), tier & (F.col("a.bucket") == F.col("b.cut.bucket"))).groupBy("a.source", "a.tier", "a.key", "b.quota", "b.cut").agg(F.count("*").alias("n"), F.max("a.size").alias("size"))
    words = F.col("n") * F.col("size")
    by_key = Window.partitionBy("source", "tier").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = inside.withColumn("passed", F.col("cut.before") + F.sum(words).over(by_key) - words)
    stop = passed.where((F.col("passed") <= F.col("quota")) & (F.col("passed") + words > F.col("quota"))).withColumn("copies", F.expr("(quota - passed) div size"))
    stop = stop.select("source", "tier", F.col("key").alias("cut_key"), "copies", (F.col("passed") + F.col("copies") * F.col("size")).alias("passed"))
    found = cuts.alias("a").join(stop.alias("b"), tier).select("a.source", "a.tier", "a.quota", F.col("a.cut.bucket").alias("cut_bucket"), "a.last_bucket", "b.cut_key", "b.copies", "b.passed")
    every = quota.where("quota = total").select("source", "tier", "quota", *(F.lit(None).cast("string").alias(x) for x in ("cut_bucket", "last_bucket", "cut_key")), F.lit(None).cast("long").alias("copies"), F.col("quota").alias("passed"))
    return settle(found.unionByName(every), "mix-ends")


def fills(rows: DataFrame, end: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, key, copies, n): the keys of which ``copies`` of the ``n`` rows are taken besides all before the cuts."""
    tier = same_source() & (F.col("a.tier") == F.col("b.tier"))
    given = end.groupBy("source").agg(F.sum("passed").alias("passed"))
    lacking = settle(shares.alias("a").join(given.alias("b"), same_source()).select("a.source", (F.col("a.need") - F.col("b.passed")).alias("lacking")), "mix-lacking")
    near = rows.alias("a").join(small(end).alias("b"), tier & F.col("a.bucket").between(F.col("b.cut_bucket"), F.col("b.last_bucket")) & (F.col("a.key") >= F.col("b.cut_key")))
    units = near.groupBy("a.source", "a.tier", "a.key", "b.cut_key", "b.copies").agg(F.count("*").alias("n"), F.max("a.size").alias("size"))
    units = units.withColumn("copies", F.when(F.col("key") == F.col("cut_key"), F.col("copies")).otherwise(F.lit(0)))
    rest = F.col("n") - F.col("copies")
    before = F.coalesce(F.sum(rest).over(Window.partitionBy("source", "tier").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = settle(units.withColumn("before", before).where(F.col("before") < FILLS).select("source", "tier", "key", "n", "copies", "size"), "mix-units")
    tried = units.alias("a").join(small(lacking).alias("b"), same_source()).where(F.col("a.size") <= F.col("b.lacking")).select("a.source", "b.lacking", F.struct((-F.col("a.tier")).alias("order"), "a.key", (F.col("a.n") - F.col("a.copies")).alias("n"), "a.size").alias("unit"))
    by_source = tried.groupBy("source").agg(F.first("lacking").alias("lacking"), F.sort_array(F.collect_list("unit")).alias("units"))  # at most FILLS a tier
    take = "least(x.n, s.lacking div x.size)"
    step = f"named_struct('lacking', s.lacking - {take} * x.size, 'made', if(s.lacking < x.size, s.made, concat(s.made, array(named_struct('key', x.key, 'more', {take})))))"
    start = "named_struct('lacking', lacking, 'made', cast(array() as array<struct<key:string,more:bigint>>))"
    picked = by_source.select("source", F.expr(f"inline(aggregate(units, {start}, (s, x) -> {step}, s -> s.made))"))
    both = units.alias("a").join(picked.alias("b"), same_source() & (F.col("a.key") == F.col("b.key")), "left").select("a.source", "a.key", (F.col("a.copies") + F.coalesce("b.more", F.lit(0))).alias("copies"), "a.n")
    return settle(both.where("copies > 0"), "mix-fills")


def drawn(keyed: DataFrame, rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc, source_size, target, repeats) for each row of ``keyed`` (doc, source, tier, key); ``rows``: the ``sized`` rows, settled before."""
    by_bucket = settle(rows.groupBy("source", "tier", "bucket").agg(F.sum("size").alias("bucket_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")), "mix-buckets")
    shares = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    need = F.floor(F.round(F.col("target") - F.col("whole") * F.col("source_size"), 6)).cast("long")
    shares = settle(shares.withColumn("whole", whole).withColumn("need", need), "mix-shares")
    filled, rows = by_bucket.where("n > 0"), rows.where("size > 0")
    tiers = filled.groupBy("source", "tier").agg(F.sum("bucket_size").alias("total"), F.min("least").alias("least"))
    quota = settle(quotas(tiers.alias("a").join(small(shares).alias("b"), same_source()).select("a.*", "b.source_size", "b.need")), "mix-quotas")
    end = ends(rows, filled, quota)
    picks = fills(rows, end, shares)
    joined = keyed.alias("a").join(small(shares).alias("b"), same_source(), "left").select("a.*", "b.source_size", "b.target", "b.whole")
    joined = joined.alias("a").join(small(end).alias("b"), same_source() & (F.col("a.tier") == F.col("b.tier")), "left").select("a.*", F.coalesce((F.col("b.passed") > 0) & (F.col("b.cut_key").isNull() | (F.col("a.key") < F.col("b.cut_key"))), F.lit(False)).alias("before"))
    joined = joined.alias("a").join(small(picks).alias("b"), same_source() & (F.col("a.key") == F.col("b.key")), "left").select("a.*", "b.copies", "b.n")

    def out(df: DataFrame, once: Column) -> DataFrame:
        repeats = F.when(F.col("source_size") > 0, F.col("whole") + once.cast("long")).otherwise(F.lit(0)).cast("long")
        return df.select("doc", "source_size", "target", repeats.alias("repeats"))

    of_some = F.coalesce(F.col("copies") < F.col("n"), F.lit(False))
    sure = out(joined.where(~of_some), F.col("before") | F.col("copies").isNotNull())
    if picks.where("copies < n").isEmpty():
        return sure
    # Of rows with one key, so many are taken: they are numbered within each part of a table that fixes their places.
    tied = settle(joined.where(of_some).withColumn("place", F.monotonically_increasing_id()), "mix-tied")
    tied = tied.withColumn("part", F.shiftright("place", 33))
    counts = tied.groupBy("source", "key", "part").agg(F.count("*").alias("m"))
    firsts = settle(counts.withColumn("first", F.coalesce(F.sum("m").over(Window.partitionBy("source", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "mix-firsts")
    nth = F.row_number().over(Window.partitionBy("source", "key", "part").orderBy("place"))
    numbered = tied.withColumn("nth", nth).alias("a").join(small(firsts).alias("b"), same_source() & (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part"))).select("a.*", "b.first")
    return sure.unionByName(out(numbered, F.col("first") + F.col("nth") <= F.col("copies")))


def mix(df: DataFrame, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc, source_size, target, repeats): each row of ``df`` as the struct ``doc``, and how often the mix takes it.

    Of a source, every document is taken as often as its target holds the source whole, and a
    fraction of them once more, never beyond the target. Reruns agree, as keys depend on
    seed, doc_id and text alone; of rows that agree in id, text and source as many are
    taken as fit, any of them. A null source is a source, the last; a null text has no words; a source without words has
    target 0 and is not taken; a document without words goes with its key and the others of its tier. A null doc_id has a key like others. Other columns stay in ``doc``,
    whatever their names. An empty table gives an empty one.
    """
    rows = settle(sized(df, seed), "mix-rows")
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"), "source", tier_of(F.col("text")).alias("tier"), key_of(F.col("doc_id"), F.col("text"), seed).alias("key"))
    return drawn(keyed, rows, weights, max_epochs)


def mixed(df: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as ``mix`` takes it; nulls, repeated rows, empty tables and other columns as there."""
    taken = mix(df).where(F.col("repeats") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("doc.*")
