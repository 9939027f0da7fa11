import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import classifier, queries
from millrace.llm import words as hashed
from millrace.llm.classifier import Model, features, fit, lists, score, train
from tests.llm.conftest import HARD, PROSE


def test_linear_time_score_equals_all_pairs():
    r = np.random.default_rng(3)
    model = Model(np.zeros(len(classifier.STATS)), np.ones(len(classifier.STATS)), r.normal(size=classifier.SIZE), r.normal(size=(classifier.SIZE, classifier.FACTORS)) / 4)
    texts = features([t.encode() for t in (PROSE, "one", "")])
    starts, at, values = model.rows(texts)
    logits, _ = model.logits(starts, at, values)
    for k, got in enumerate(logits):
        own = slice(starts[k], starts[k + 1] if k + 1 < len(starts) else None)
        a, v = at[own], values[own]
        pairs = sum(float(model.factors[a[i]] @ model.factors[a[j]]) * v[i] * v[j] for i in range(len(a)) for j in range(i))
        assert abs(got - (float(model.weights[a] @ v) + pairs)) < 1e-6


def slow_features(text):
    """Values by word and statistics, word by word."""
    raw = text.encode()
    words = raw.split()
    counts, n = Counter(words), max(len(words), 1)
    values = {w: math.log1p(c) for w, c in counts.items()}
    length = math.sqrt(sum(v * v for v in values.values()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = set(zip(words, words[1:], words[2:], strict=False))
    chars = [sum(c in x for c in text) / n for x in ("#*$%&<>", "|", "!", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", ".", ",")]
    shouted = sum(len(w) > 1 and w.isupper() for w in words) / n
    stats = [math.log1p(len(raw)), len(raw) / n, *chars[:5], shouted, *chars[5:], math.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / len(lines) if lines else 0, 1 - len(counts) / n if words else 0]
    return sorted(v / length for v in values.values()), [*stats, max(counts.values(), default=0) / n, 1 - len(windows) / max(n - 2, 1) if windows else 0, math.log1p(len(counts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB É×Þ漢#|!.,5\n\t"), max_size=40), max_size=5), st.sampled_from([1, 9, hashed.CHUNK]))
def test_features_equal_those_word_by_word(texts, chunk):
    was, hashed.CHUNK = hashed.CHUNK, chunk
    try:
        found = features([t.encode() for t in texts])
    finally:
        hashed.CHUNK = was
    for t, (places, values, stats) in zip(texts, found, strict=True):
        want = slow_features(t)
        assert len(places) == len(values) and sorted(values) == pytest.approx(want[0]) and stats == pytest.approx(want[1])
    for a, b in ("aB Ab", "ab ab"), ("ÄB", "ÄB "):
        assert set(features([a.encode()])[0][0]) == set(features([b.encode()])[0][0])


def test_pairs_are_learnt():
    """Labels that no single word decides: both words or neither."""
    r = np.random.default_rng(5)
    texts, labels = [], []
    for _ in range(1200):
        a, b = r.integers(2), r.integers(2)
        texts.append(" ".join(["alpha" if a else "beta", "gamma" if b else "delta"] * 3))
        labels.append(int(a == b))
    rows = features([t.encode() for t in texts])
    model = fit(rows[:800], np.array(labels[:800], float))
    assert ((model.score(rows[800:]) >= 0.5) == np.array(labels[800:])).mean() > 0.95


def test_fit_widens_a_step_and_not_the_sample(monkeypatch):
    monkeypatch.setattr(classifier, "EPOCHS", 1)
    r = np.random.default_rng(2)
    texts = [(np.sort(r.choice(1 << classifier.WORD_BITS, 500, replace=False)).astype(np.int16), r.random(500, np.float32), r.random(len(classifier.STATS))) for _ in range(3000)]
    labels = r.integers(0, 2, len(texts)).astype(float)
    tracemalloc.start()
    try:
        fit(texts, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6, peak  # one copy of all rows in wide types is 25 MB


def test_narrow_types_teach_the_same():
    texts = features([f"{PROSE} {k} {k % 7}".encode() for k in range(300)])
    labels = np.arange(300) % 2.0
    narrow = [(a.astype(np.int16), v.astype(np.float32), s) for a, v, s in texts]
    models = [fit(x, labels) for x in (narrow, [(a.astype(np.int64), v.astype(float), s) for a, v, s in narrow])]
    assert (models[0].weights == models[1].weights).all() and (models[0].factors == models[1].factors).all()


def test_lists_of_chunks_and_slices():
    want = [[1, 2], [], [3], [4, 5, 6], []]
    whole = pa.array(want, pa.list_(pa.int16()))
    assert [x.tolist() for x in lists(pa.chunked_array([whole[:2], whole[2:4], whole[4:], whole[:0]]))] == want
    assert lists(pa.chunked_array([], pa.list_(pa.int16()))) == []


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op6_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_teach_nothing(spark, docs):
    ids = [k for k in range(400)]
    texts = [(k, PROSE + f" {k}" if k % 2 else "### $$$ %%%") for k in ids]
    held = [k for k in ids if zlib.crc32(str(k).encode()) % 5 == 0]
    right = [(k, k % 2) for k in ids]
    turned = [(k, 1 - k % 2 if k in held else k % 2) for k in ids]
    models = [train(docs(*texts), spark.createDataFrame(x, "doc_id long, quality int")) for x in (right, turned)]
    assert (models[0].weights == models[1].weights).all() and (models[0].factors == models[1].factors).all()


def test_sample_is_bounded(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    assert train(docs(*[f"a{k}" for k in range(100)]), labels, most=0).score(features([b"x"]))[0] == 0.5


def test_repeated_rows_do_not_lift_the_bound(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda texts, labels: seen.append(labels.tolist()) or fit(texts, labels))
    ids = [1] * 500 + list(range(2, 40))
    labels = spark.createDataFrame([(k, k % 2) for k in ids] + [(1, 0)], "doc_id long, quality int")
    df = docs(*((1, f"text {k % 3}") for k in range(2000)), *((k, f"text {k}") for k in range(2, 40)))
    for most in (10, 100):
        train(df, labels, most=most)
    usable = [k for k in range(1, 40) if zlib.crc32(str(k).encode()) % 5]
    assert [len(x) for x in seen] == [10, len(usable)]
    models = [train(x, labels, most=100) for x in (df.repartition(3), df.repartition(7))]
    assert (models[0].weights == models[1].weights).all()


def test_hard_rows(spark, docs):
    rows = [(None, PROSE), (1, PROSE), (1, PROSE), *((100 + k, x) for k, x in enumerate(HARD))]
    df = docs(*rows, clashing=True)
    labels = spark.createDataFrame([(1, 1), (100, 0), (101, None), (None, 1), (9999, 0), (1, 0)], "doc_id long, quality int")
    found = score(df, train(df, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert found[0].doc.asDict().keys() == set(df.columns)
    assert score(df.limit(0), train(df, labels.limit(0))).collect() == []
