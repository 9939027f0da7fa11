import time

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
MORE = ", spans string, score double, kept string, size string, key string, bucket string, target string, repeats string, shard string, slot string, piece string, length string, digest string, item string, doc string, text_key string, component_id string, label string, failed string, words string"


@pytest.fixture
def docs(spark):
    """Makes documents of texts: (doc_id, text) pairs, or texts numbered from 0."""

    def make(*texts, source="s", clashing=False):
        rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
        rows = [(i, t, "en", source, None if t is None else len(t)) for i, t in rows]
        if clashing:
            rows = [(*r, *["1"] * 1, 1.0, *["1"] * (MORE.count(",") - 2)) for r in rows]
        return spark.createDataFrame(rows, DOCS + MORE * clashing)

    return make


PROSE = "the quick brown fox jumps over a lazy dog while seven wizards mix potions and forty sailors sing about distant harbours under pale moonlight before morning comes again"
HARD = [None, "", " \t\n", "one", "x" * 300_000, "word " * 60_000, PROSE, PROSE, "äöü ß 漢字 😀 \u0130stanbul", "\x00\x01 \x0b\x0c\r\n end"]


def assert_linear(work, part, chars=150_000):
    """Four times the text takes far less than sixteen times the time, the best of three counting."""
    took = []
    for n in (chars, 4 * chars):
        text, best = part * (n // len(part)), 1e9
        for _ in range(3):
            began = time.perf_counter()
            work(text)
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 9 * took[0] + 0.02, took
