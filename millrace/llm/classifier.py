"""Quality classifier: a factorisation machine.

Features of a text are its hashed words, statistics of its structure, and its length as metadata.
The score is linear terms plus all pairwise interactions through low-rank factors, computed in time
linear in the number of features by the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.
"""

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import frugal, give_back, with_texts
from millrace.llm.words import BASE, EXACT, LOWER, U, groups, joined, mixed, words_of

#: At most 15: places go to the driver in 16 bits.
WORD_BITS = 14
#: The model is fitted on at most so many labelled rows, those with the smallest hash of their id.
MAX_TRAIN_ROWS = 8_000
FACTORS = 8
EPOCHS = 12
BATCH = 64
RATE = 0.08
#: Weight decay of the words and of the factors.
DECAY = 2e-4
THRESHOLD = 0.3
#: Labels of ids with this remainder are never learnt from.
FOLDS, HELD_OUT = 5, 0

STATS = (
    "length", "word_length", "symbols", "bars", "bangs", "digits", "capitals", "shouted", "stops", "commas",
    "line_words", "repeated_lines", "repeated_words", "top_word", "repeated_windows", "distinct_words",
)
SIZE = (1 << WORD_BITS) + len(STATS) + 1


def marks(chars: bytes) -> np.ndarray:
    """1 for these bytes, 0 for others."""
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


SYMBOLS, BARS, BANGS, DIGITS, STOPS, COMMAS = map(marks, (b"#*$%&<>", b"|", b"!", b"0123456789", b".", b","))
CAPITALS, SMALL = marks(bytes(range(0x41, 0x5B))), marks(bytes(range(0x61, 0x7B)))
#: Second bytes of the Latin-1 capitals, whose first is 0xC3.
LATIN_CAPITALS = marks(bytes(x for x in range(0x80, 0x9F) if x != 0x97))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order that sorts x, where its distinct values begin in it, how often each comes)."""
    order = np.argsort(x)
    ordered = x[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(x) else np.zeros(0, np.int64)
    return order, at, np.diff(at, append=len(x))


def features(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, list[float]]]:
    """For each text: (places of its distinct words, their values, statistics). The values have length 1."""
    data, begins = joined(raws)
    starts, ends, (exact, lower), (capitals, small) = words_of(data, (EXACT, LOWER), (CAPITALS, SMALL))
    firsts = np.searchsorted(starts, [*begins, len(data)])
    n_words = np.diff(firsts)
    count = lambda x: np.add.reduceat(x, begins, dtype=np.int64) if len(begins) else np.zeros(0)
    latin = np.append((data[:-1] == 0xC3) & LATIN_CAPITALS[data[1:]].astype(bool), False)
    shout = np.append(0, np.cumsum((ends - starts > 1) & (capitals > 0) & (small == 0)))
    n = np.maximum(n_words, 1)
    sizes = np.array([len(x) for x in raws], float)
    shares = [sizes, *(count(t[data]) for t in (SYMBOLS, BARS, BANGS, DIGITS)), count(CAPITALS[data]) + count(latin), shout[firsts[1:]] - shout[firsts[:-1]], count(STOPS[data]), count(COMMAS[data])]
    by_text = np.stack([np.log1p(sizes), *(x / n for x in shares)], axis=1) if raws else np.zeros((0, 10))
    places = (lower & U((1 << WORD_BITS) - 1)).astype(np.int64)
    whole = mixed((exact[:-2] * U(BASE) + exact[1:-1]) * U(BASE) + exact[2:]) if len(exact) > 2 else np.zeros(0, U)
    made = []
    for k, raw in enumerate(raws):
        a, b = int(firsts[k]), int(firsts[k + 1])
        order, at, counts = runs(exact[a:b])
        values = np.log1p(counts)
        if len(values):
            values /= math.sqrt(float(values @ values))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        n_own, n_lines, n_windows = max(b - a, 1), max(len(lines), 1), len(runs(whole[a : b - 2])[1]) if b - a > 2 else 0
        stats = [
            *by_text[k], math.log1p(n_own / n_lines), 1 - len(set(lines)) / n_lines if lines else 0.0, 1 - len(at) / n_own if b > a else 0.0,
            int(counts.max(initial=0)) / n_own, 1 - n_windows / max(n_own - 2, 1) if n_windows else 0.0, math.log1p(len(at)),
        ]
        made.append((places[a:b][order[at]], values, stats))
    return made


def features_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
    """``features`` of a column's texts, null as empty."""
    for _, raws in groups(texts):
        yield from features(raws)


@dataclass
class Model:
    """Weights of a fitted machine. Places: hashed words, then the statistics, then the constant."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, texts: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each text, places, values), statistics standardised and clipped."""
        stats = np.clip((np.array([s for _, _, s in texts]).reshape(-1, len(STATS)) - self.mean) / self.spread, -4, 4) / 2
        tail = np.arange(1 << WORD_BITS, SIZE)
        at = [np.concatenate([a, tail]) for a, _, _ in texts]
        values = [np.concatenate([v, s, [1.0]]) for (_, v, _), s in zip(texts, stats, strict=True)]
        starts = np.cumsum([0, *map(len, at)])[:-1]
        return starts, np.concatenate(at), np.concatenate(values)

    def logits(self, starts: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logit of each text, sums of its factors)."""
        parts = self.factors[at] * values[:, None]
        sums = np.add.reduceat(parts, starts)
        squares = np.add.reduceat((parts * parts).sum(axis=1), starts)
        return np.add.reduceat(self.weights[at] * values, starts) + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def score(self, texts: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.rows(texts))[0], -30, 30)))


def fit(texts: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray) -> Model:
    """Adaptive gradient steps on the logistic loss, in a fixed seeded order. Without rows, every score is one half.

    Places and values of ``texts`` may be of narrow types, as only a step's own rows are widened.
    """
    stats = np.array([s for _, _, s in texts], float).reshape(-1, len(STATS))
    random = np.random.default_rng(7)
    model = Model(np.zeros(len(STATS)), np.ones(len(STATS)), np.zeros(SIZE), random.normal(0, 0.02, (SIZE, FACTORS)))
    if not len(texts):
        model.factors[:] = 0
        return model
    model.mean, model.spread = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    seen_w, seen_f = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2)
    for epoch in range(EPOCHS):
        order = random.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            first, a, v = model.rows([texts[i] for i in rows])
            own = np.repeat(np.arange(len(rows)), np.diff(first, append=len(a)))
            logit, sums = model.logits(first, a, v)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) / len(rows)
            places, place = np.unique(a, return_inverse=True)
            # Gradients by place: v x (sum - v x) for the factors.
            weight = error[own] * v
            by_w = np.bincount(place, weights=weight, minlength=len(places)) + DECAY * model.weights[places]
            pull = weight[:, None] * (sums[own] - model.factors[a] * v[:, None])
            by_f = np.stack([np.bincount(place, weights=pull[:, f], minlength=len(places)) for f in range(FACTORS)], axis=1) + DECAY * model.factors[places]
            seen_w[places] += by_w**2
            seen_f[places] += by_f**2
            model.weights[places] -= RATE * by_w / np.sqrt(seen_w[places])
            model.factors[places] -= RATE / 4 * by_f / np.sqrt(seen_f[places])
    return model


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each list of a column without nulls, in the column's own memory."""
    found = []
    for chunk in column.chunks:
        values = chunk.values.to_numpy()
        found += [values[a:b] for a, b in pairwise(chunk.offsets.to_pylist())]
    return found


def fold(doc_id: str = "doc_id"):
    """The remainder that decides whether a label may be learnt from; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)).cast("int")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on the labelled ids outside the held-out fold, at most ``most`` of them, one row an id.

    ``labels``: doc_id, quality. Labels with a null id or quality, or without a document, teach
    nothing. Of several labels of an id the smallest counts, of several documents the one
    whose text has the smallest hash. The features are made by the executors; the driver gets those of the bounded
    sample alone. Empty tables give a model whose scores are all one half.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold() != HELD_OUT))
    by_id = usable.groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("quality"))
    sample = by_id.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    rows = with_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "quality", F.xxhash64("text").alias("text_key"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(features_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([a.astype(np.int16) for a, _, _ in made], pa.list_(pa.int16())), pa.array([v.astype(np.float32) for _, v, _ in made], pa.list_(pa.float32())), pa.array([s for _, _, s in made], pa.list_(pa.float64()))],
                ["doc_id", "quality", "text_key", "places", "values", "stats"],
            )

    drawn = rows.mapInArrow(frugal(features), "doc_id string, quality int, text_key long, places array<smallint>, values array<float>, stats array<double>")
    one = drawn.groupBy("doc_id").agg(F.min(F.struct("text_key", "quality", "places", "values", "stats")).alias("row"))
    found = one.select("doc_id", "row.quality", "row.places", "row.values", "row.stats").toArrow()
    # Tasks end in any order; the fit takes rows in one.
    order = [k for *_, k in sorted((zlib.crc32(i.encode()), i, k) for k, i in enumerate(found["doc_id"].to_pylist()))]
    rows, quality = list(zip(*(lists(found[c]) for c in ("places", "values", "stats")), strict=True)), found["quality"].to_pylist()
    model = fit([rows[k] for k in order], np.array([quality[k] for k in order], float))
    del found, rows
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, score): each row of ``docs`` as the struct ``doc``, with the score of its whole text.

    Null text is empty; an empty text has a score like others. Repeated rows, null ids and other
    columns of any name pass through; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * (FACTORS + 1) numbers
    rows = with_texts(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    place = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(features(raws)) for _, raws in groups(batch.column(0).field(place))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], ["doc", "score"])

    kind = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(frugal(scored), kind)
