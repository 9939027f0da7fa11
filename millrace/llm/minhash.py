"""Near-duplicate groups by SuperMinHash.

A document's set is its distinct five-word shingles. Documents with equal sets are one class, and
all work on similarity is between classes. Each class has a SuperMinHash signature: every element
walks a random permutation of the slots, its value at step j lying in [j, j + 1), and a slot keeps
its smallest value. All elements take a step together; once a document's slots are all filled no later
step can lower any, so most documents stop after one or two.

Bands of the signature bring classes together in buckets. Within a bucket whole signatures are
compared, and classes whose agree in enough slots are candidates of each other. Only what hangs
together by such candidates is a family, so that classes which share a passage but little else are in
none, however many meet in a bucket. Of the classes in families the full sets are read, once
each, and confirm the links within a family; union-find groups them by confirmed links alone.

Buckets and families are compared in blocks of bounded size. One larger than a block is first
compared with one centre: those near it are in one component already, so only the others are
compared with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scope, frugal, is_small, met, settle, sifted, small, with_texts
from millrace.llm.components import MOST_NODES, Groups, components
from millrace.llm.words import LOWER, U, groups, joined, mixed, words_of

SHINGLE = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
#: At the limit a link is missed by all bands with a probability of (1 - 0.75 ** 4) ** 32 = 5e-6, above it less.
BANDS, BAND_SLOTS = 32, 4
SLOTS = BANDS * BAND_SLOTS
#: Signatures of candidates agree in so many slots: at the limit fewer do with a probability of 3e-5.
AGREE = 76
#: Sizes of a part of a bucket or family that is compared at once, in classes and in shingles.
PART_CLASSES, PART_SHINGLES = 512, 1_000_000
#: Columns of a membership matrix, and pairs that are counted at once.
COLUMNS, PAIRS = 1024, 1_000_000


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """The shingle set of each text, as sorted distinct 64-bit hashes."""
    data, begins = joined(raws)
    starts, _, (h,), _ = words_of(data, (LOWER,))
    firsts = np.searchsorted(starts, [*begins, len(data)])

    def rolled(x: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(x) - n + 1, n, U)
        for k in range(n):
            total = total * U(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k]
        return mixed(total)

    whole = rolled(h, SHINGLE) if len(h) >= SHINGLE else np.zeros(0, U)
    sets = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a < SHINGLE:
            sets.append(rolled(h[a:b], b - a) if b > a else np.zeros(0, U))
            continue
        own = np.sort(whole[a : b - SHINGLE + 1])
        sets.append(own[np.flatnonzero(np.diff(own, prepend=~own[:1]))])
    return sets


def class_of(shingles: np.ndarray) -> int:
    """The class: a 64-bit hash of the set, signed."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, a row of SLOTS values each; a value is its step and 32 random bits. Sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    slots = np.full((len(sets), SLOTS), np.iinfo(U).max, U)
    if not len(sets):
        return slots
    element = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), sizes)
    ways = None  # permutations of the elements that still walk
    for step in range(SLOTS):
        drawn = mixed(element + U((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        to = step + ((drawn & U(0xFFFFFFFF)) % U(SLOTS - step)).astype(np.int64)
        if ways is None:
            at = to
        else:
            row = np.arange(len(element))
            at = ways[row, to].astype(np.int64)
            ways[row, to] = ways[row, step]
            ways[row, step] = at
        np.minimum.at(slots.reshape(-1), own * SLOTS + at, (drawn >> U(32)) | U(step << 32))
        open_ = (slots == np.iinfo(U).max).any(axis=1)
        if not open_.any():
            break
        walks = open_[own]
        if ways is None:
            ways = np.broadcast_to(np.arange(SLOTS, dtype=np.uint8), (int(walks.sum()), SLOTS)).copy()
            row = np.arange(len(ways))
            ways[row, 0], ways[row, to[walks]] = to[walks], 0
        elif not walks.all():
            ways = ways[walks]
        element, own = element[walks], own[walks]
    return slots


def bands(slots: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of each signature; equal keys mean equal slots of the same band."""
    parts = mixed(slots).reshape(len(slots), BANDS, BAND_SLOTS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(slots), BANDS)).copy()
    for k in range(BAND_SLOTS):
        key = mixed(key * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.astype(np.int64)


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets of x with sets of y, exact.

    Rare shingles are counted pair by pair, frequent ones by a product of membership matrices.
    """
    out = np.zeros((len(x), len(y)))
    hashes, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    first = np.searchsorted(place, np.arange(len(hashes)))
    left = np.add.reduceat((row < len(x)).astype(np.int64), first)
    right = np.diff(first, append=len(place)) - left
    pairs = left * right
    is_dense = (pairs * 400 > out.size) & (out.size > 4096)
    sparse, dense = np.flatnonzero((pairs > 0) & ~is_dense), np.flatnonzero(is_dense)
    ends = np.cumsum(pairs[sparse])
    while len(sparse):
        n = max(1, int(np.searchsorted(ends, PAIRS)))
        now, many = sparse[:n], pairs[sparse[:n]]
        # Each shingle's rows of x come before its rows of y.
        own = np.repeat(now, many)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        a = row[first[own] + nth // right[own]]
        b = row[first[own] + left[own] + nth % right[own]] - len(x)
        out += np.bincount(a * len(y) + b, minlength=out.size).reshape(out.shape)
        sparse, ends = sparse[n:], ends[n:] - ends[n - 1]
    at = np.full(len(hashes), -1)
    for k in range(0, len(dense), COLUMNS):
        at[:] = -1
        at[dense[k : k + COLUMNS]] = np.arange(len(dense[k : k + COLUMNS]))
        has = at[place] >= 0
        held = np.zeros((len(x) + len(y), min(COLUMNS, len(dense) - k)), np.float32)
        held[row[has], at[place[has]]] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def linked(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(i, j) of the sets of x and y that are similar enough, compared in full."""
    if not x or not y:
        return np.zeros((0, 2), int)
    both = overlaps(x, y).astype(np.int64)
    sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    return np.argwhere(100 * both >= PERCENT * (sizes - both))


def agreeing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """(i, j) of the signatures of x and y that agree in at least AGREE slots."""
    a, b = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, SLOTS) for z in (x, y))
    rows = max(1, (1 << 21) // (len(b) * SLOTS))  # some MB at once
    same = [np.count_nonzero(a[k : k + rows, None, :] == b[None, :, :], axis=2) for k in range(0, len(a), rows)]
    return np.argwhere(np.concatenate(same) >= AGREE)


def confirmed(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """(i, j) of the shingle sets of x and y that are linked."""
    a, b = ([np.frombuffer(s, U) for s in z] for z in (x, y))
    return linked(a, b)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, bands, slots) for each row; empty sets have no bands and no slots.

    ``slots`` has a byte of each slot's value: agreement of bytes is agreement of slots, but for one pair in 256 that agrees by chance.
    """
    rows = with_texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, keys: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            drawn = signatures([s for s in sets if len(s)])
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[1:] = np.cumsum([BANDS * bool(len(s)) for s in sets])
            flat = bands(drawn).reshape(-1)
            low = iter((mixed(drawn) & U(0xFF)).astype(np.uint8))
            columns = [
                pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())), pa.array([next(low).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays([ids, keys, *columns], ["doc_id", "text_key", "n_shingles", "class", "bands", "slots"])

        for batch in batches:
            for first, raws in groups(batch.column(2)):
                yield out(batch.column(0).slice(first, len(raws)), batch.column(1).slice(first, len(raws)), shingle_sets(raws))

    return rows.mapInArrow(frugal(draw), f"doc_id {kind}, text_key long, n_shingles long, class long, bands array<long>, slots binary")


def compared(rows: DataFrame, match: Callable[[list[bytes], list[bytes]], np.ndarray], whole: bool = False) -> DataFrame:
    """Links (a, b) of classes that ``match`` finds; ``rows``: block, side, class, payload.

    A block is two sides of a bounded number of classes, or one that is compared with itself. Rows
    come sorted by block. Of the pairs that match those are returned that join what earlier ones of
    the task have not, and a block whose classes are joined already is passed over; with
    ``whole``, all that join what earlier ones of their block have not.
    """

    most = MOST_NODES

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, groups = None, [], Groups()
        sides: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})

        def close() -> None:
            x, y = sides if sides[1] else (sides[0], sides[0])
            names, others = list(x), list(y)
            if whole or len(groups.parent) > most:
                groups.parent.clear()
            if x and len({groups.find(z) for z in (*names, *others)}) > 1:
                for i, j in match(list(x.values()), list(y.values())).tolist():
                    a, b = names[i], others[j]
                    if groups.find(a) != groups.find(b):
                        groups.add([(a, b)])
                        found.append((a, b))
            for s in sides:
                s.clear()

        for batch in batches:
            for block, side, own, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    close()
                    at = block
                sides[side].setdefault(own, payload)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
                found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return with_texts(rows).repartition("block").sortWithinPartitions("block").select("block", "side", "class", "payload").mapInArrow(frugal(check), "a long, b long")


def parts(classes: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(classes / PART_CLASSES), F.ceil(shingles / PART_SHINGLES)).cast("long")


def star_blocks(members: DataFrame) -> DataFrame:
    """``members`` with block and side: each part of a group on one side, its centre on the other."""
    centre = F.col("class") == F.col("centre")
    part = F.when(centre, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), F.col("parts"))))
    return members.withColumn("part", F.explode(part)).select("class", "payload", F.concat_ws("/", "group", "part").alias("block"), centre.cast("int").alias("side"))


def all_blocks(members: DataFrame) -> DataFrame:
    """``members`` (with ``near``: whether matched with the centre) with block and side, a row for each block.

    A group's near classes and its others are dealt to parts. Two parts are compared unless both are of near ones.
    """
    count = lambda near, x: F.coalesce(F.sum(F.when(F.col("near") == near, x)), F.lit(0))
    of = lambda near: parts(count(near, F.lit(1)), count(near, F.col("n")))
    sums = settle(members.groupBy("group").agg(of(False).alias("far_parts"), of(True).alias("near_parts")), "block-sums")
    own = members.drop("parts").join(small(sums), "group")
    own = own.withColumn("part", F.pmod(F.xxhash64("class"), F.when(F.col("near"), F.col("near_parts")).otherwise(F.col("far_parts"))))
    none = F.array().cast("array<struct<block:string,side:int>>")

    def with_each(n: str, block) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), block)).otherwise(none)

    def block(kind: str, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.concat_ws("/", F.col("group"), F.lit(kind), i, j).alias("block"), side.cast("int").alias("side"))

    part = F.col("part")
    among = with_each("far_parts", lambda k: block("far", F.least(k, part), F.greatest(k, part), part > k))
    across = with_each("near_parts", lambda k: block("near", part, k, F.lit(0)))
    back = with_each("far_parts", lambda k: block("near", k, part, F.lit(1)))
    blocks = F.when(F.col("near"), back).otherwise(F.concat(among, across))
    return own.withColumn("b", F.explode(blocks)).select("class", "payload", "b.block", "b.side")


def matched(members: DataFrame, match: Callable[[list[bytes], list[bytes]], np.ndarray], label: str) -> DataFrame:
    """Links (a, b) that match within groups and leave nothing of a group apart that a match would join.

    ``members``, settled before: group, class, n (shingles), weight, payload. The centre of a group is a class of the largest weight.
    """
    sums = members.groupBy("group").agg(F.count("*").alias("size"), parts(F.count("*"), F.sum("n")).alias("parts"), F.max_by("class", F.struct("weight", "class")).alias("centre"))
    sums = settle(sums.where("size > 1"), f"{label}-sums")
    own = members.join(small(sums), "group")
    whole = own.where("parts = 1").select("class", "payload", F.col("group").cast("string").alias("block"), F.lit(0).alias("side"))
    found = settle(compared(whole, match), f"{label}-links")
    if sums.where("parts > 1").isEmpty():
        return found
    large = own.where("parts > 1")
    star = settle(compared(star_blocks(large), match, whole=True), f"{label}-star")
    near = star.select(F.col("a").alias("near_class"), F.col("b").alias("near_centre")).distinct()
    is_near = (F.col("class") == F.col("near_class")) & (F.col("centre") == F.col("near_centre"))
    rest = large.join(small(settle(near, f"{label}-near")), is_near, "left").select("group", "class", "n", "payload", (F.col("near_class").isNotNull() | (F.col("class") == F.col("centre"))).alias("near"))
    return found.union(star).union(settle(compared(all_blocks(settle(rest, f"{label}-rest")), match), f"{label}-all"))


def meetings(classes: DataFrame) -> DataFrame:
    """(group, class, n, weight, payload) for each class in each bucket that it shares; the payload is its signature."""
    banded = classes.select("class", F.explode("bands").alias("group"))
    shared = settle(banded.groupBy("group").agg(F.count("*").alias("weight")).where("weight > 1"), "shared-bands")
    rows = classes.select("class", F.lit(1).alias("n"), F.col("slots").alias("payload"), F.explode("bands").alias("group"))
    rows, side = met(rows, "group", shared)  # signatures go through a shuffle only for buckets that are shared
    return settle(rows.join(side, "group").select("group", "class", "n", "weight", "payload"), "meetings")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``, settled before (group, class, weight, rep, text_key), with n and payload, the shingle set of a document of the class.

    Each task makes a class's set once, however often its document is repeated.
    """
    d, side = met(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), "text_key", wanted)
    own = F.col("d.doc_id").eqNullSafe(F.col("w.rep")) & (F.col("d.text_key") == F.col("w.text_key"))
    texts = d.alias("d").join(side.alias("w"), own).select("w.group", "w.class", "w.weight", "d.text")

    def cut_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = []
            for k, own in enumerate(batch.column(1).to_pylist()):
                if own not in seen:
                    seen.add(own)
                    new.append(k)
            kept = batch.take(pa.array(new, pa.int64()))
            for first, raws in groups(kept.column(3)):
                sets = shingle_sets(raws)
                rows = kept.slice(first, len(raws))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["group", "class", "weight", "n", "payload"])

    return settle(with_texts(texts).mapInArrow(frugal(cut_sets), "group long, class long, weight long, n long, payload binary"), "sets")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that make the components whole. ``classes``, settled before: class, n, bands, slots, rep, text_key."""
    meeting = meetings(classes)
    families = components(matched(meeting, agreeing, "candidates"))
    # A family's centre is the class that meets most others.
    weights = meeting.groupBy("class").agg(F.sum("weight").alias("weight"))
    own = settle(families.select(F.col("node").alias("class"), F.col("label").alias("group")).join(weights, "class"), "families")
    wanted = settle(classes.select("class", "rep", "text_key").join(small(own), "class").select("group", "class", "weight", "rep", "text_key"), "wanted")
    return matched(sets_of(docs, wanted), confirmed, "confirmed")


def grouped(docs: DataFrame) -> DataFrame:
    """``near_duplicates``, and ``first``: whether a row agrees in id and text with the first of its group, null ids last; null without shingles."""
    sketches = settle(sketch(docs), "sketches")
    filled = sketches.where(F.col("n_shingles") > 0)
    own = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_key"))
    classes = settle(filled.groupBy("class").agg(own.alias("own"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("slots").alias("slots")).select("class", "n", "bands", "slots", F.col("own.doc_id").alias("rep"), "own.text_key"), "classes")
    with Scope(docs.sparkSession) as scope:
        labels = small(scope.out(components(links(docs, classes)), "labels"))
    # Only classes in components are many to a label; the others name themselves.
    inside = settle(classes.select("class", "rep", "text_key").join(labels.select(F.col("node").alias("class"), "label"), "class"), "labelled")
    head = F.struct(F.col("rep").isNull().alias("void"), F.col("rep").alias("doc_id"), "text_key")
    smallest = settle(inside.groupBy("label").agg(F.min("rep").alias("component"), F.min(head).alias("head")), "smallest")
    in_groups = settle(inside.join(small(smallest), "label").select("class", "component", "head"), "named")
    alone = F.col("s.head").isNull()
    named = classes.select("class", "rep", head.alias("own")).alias("g").join(small(in_groups).alias("s"), F.col("g.class") == F.col("s.class"), "left").select(
        "g.class", F.when(alone, F.col("g.rep")).otherwise(F.col("s.component")).alias("component"), F.when(alone, F.col("g.own")).otherwise(F.col("s.head")).alias("head")
    )
    joined = sketches.select("doc_id", "text_key", "n_shingles", "class").alias("d").join(named.alias("n"), (F.col("d.class") == F.col("n.class")) & (F.col("d.n_shingles") > 0), "left")
    component = F.when(F.col("d.n_shingles") > 0, F.col("n.component")).otherwise(F.col("d.doc_id"))
    first = F.when(F.col("d.n_shingles") > 0, F.col("d.doc_id").eqNullSafe(F.col("n.head.doc_id")) & (F.col("d.text_key") == F.col("n.head.text_key")))
    return joined.select("d.doc_id", "d.text_key", "d.n_shingles", component.alias("component_id"), F.col("d.doc_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row of ``docs``: doc_id, text.

    component_id is the smallest doc_id of the documents reachable over links, kept says whether it
    is the row's own. A null or blank text has no shingles and is linked with nothing; a text of
    fewer than five words is one shingle. Rows are documents of their own even if ids repeat; rows
    that agree in id and text get equal results. A null id is larger than any other: a component of null ids has a
    null component_id, and its rows are kept. Other columns are ignored. An empty table gives an empty one.
    """
    return grouped(docs).drop("first")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each group of near-duplicates.

    The one has the smallest id, null ids last; of rows that agree in id and text, one stays, chosen by their columns' hash.
    Rows without shingles are no duplicates and all stay.
    """
    pairs = grouped(docs).where(F.col("first").isNotNull()).groupBy("doc_id", "text_key", "first").agg(F.count("*").alias("n"))
    gone = settle(pairs.where(~F.col("first") | (F.col("n") > 1)).select("doc_id", "text_key", "first"), "gone")
    repeated = gone.where("first")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).withColumn("text_key", F.xxhash64("doc.text")).alias("d")
    same = F.col("d.doc.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key"))
    if is_small(gone):
        kept = d.join(F.broadcast(gone).alias("g"), same, "left_anti").select("doc.*")
    else:  # only rows that may go are shuffled
        held, free = sifted(d, "text_key", gone)
        kept = held.alias("d").join(gone.alias("g"), same, "left_anti").select("doc.*").unionByName(free.select("doc.*"))
    if repeated.isEmpty():
        return kept
    # Partial aggregation leaves each task one row of a pair, however often it repeats.
    hashed = F.xxhash64(*(F.col(f"d.doc.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    one = d.join(small(repeated).alias("g"), same).groupBy("g.doc_id", "g.text_key").agg(F.min_by("d.doc", hashed).alias("doc"))
    return kept.unionByName(one.select("doc.*"))
