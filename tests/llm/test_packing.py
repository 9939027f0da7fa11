import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from millrace.llm import packing, queries
from millrace.llm.packing import SEQUENCE, bounds, patterns, plan, sequences, token_ids, tokenise
from tests.llm.conftest import HARD

PATH = queries.tokenizer_path()


def test_ids_equal_the_files_own_library():
    slow = Tokenizer.from_file(PATH)
    r = random.Random(1)
    letters = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x250), 0x0A, 0x09, 0x0D)] + list("  's're'll\n\n 09")
    texts = ["".join(r.choices(letters, k=r.randrange(80))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "漢字    x", "a  b   c \n\n d", "\x00\x1f", "😀", " " * 20_000 + "x", "ab" * 9_000, "", "don't we'LL"]
    for t in texts:
        assert token_ids(t, PATH).tolist() == [*slow.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_bounds():
    assert bounds(1) == [(0, 1)] and bounds(1024) == [(0, 1024)] and bounds(1025) == [(0, 1), (1, 1024)] and bounds(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def check_plan(histogram):
    used = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, first, offset in plan(histogram).tolist():
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            used[s].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items() if n}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    return len(used), -(-sum(k * n for k, n in histogram.items()) // SEQUENCE)


def test_plans_are_valid_and_close_to_the_bound():
    r = random.Random(2)
    assert check_plan({}) == (0, 0)
    assert check_plan({1024: 5, 1: 1}) == (6, 6)
    assert check_plan({600: 10}) == (10, 6)
    assert check_plan({100: 25, 24: 3})[0] == 3
    for n in (5, 100, 2000, 30_000):
        h = defaultdict(int)
        for _ in range(n):
            h[min(SEQUENCE, max(1, int(r.lognormvariate(5.5, 1))))] += 1
        made, least = check_plan(h)
        assert made <= least * 1.01 + 2
    made, least = check_plan({k: 7 for k in range(1, 1024)})
    assert made <= least + 2


def test_packing_round_trip(docs):
    texts = [*HARD, *["short one"] * 300, *("word " * k for k in range(1, 400, 7))]
    rows = docs(*texts, (5000, "dup"), (5000, "dup"), (None, "none"), clashing=True)
    pieces = tokenise(rows, PATH).cache()
    placed = packing.pack(pieces).collect()
    pieces.unpersist()
    texts = {k: t for k, t in enumerate(texts)} | {5000: "dup", None: "none"}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in placed:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
    assert by_doc.keys() == texts.keys() and len(by_doc[5000]) == 2
    for k, own in by_doc.items():
        if k != 5000:
            own.sort(key=lambda p: p.piece)
            assert [i for p in own for i in p.ids] == token_ids(texts[k] or "", PATH).tolist()
            assert [(p.start, p.length) for p in own] == bounds(sum(p.length for p in own))
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) <= SEQUENCE


def test_sequences_hold_the_pieces(docs):
    made = packing.pack(tokenise(docs("a b c", "d", "e f"), PATH)).cache()
    (s,) = sequences(made).collect()
    assert s.ids == [i for p in sorted(made.collect(), key=lambda p: p.offset) for i in p.ids]


def test_columns_of_the_same_names_are_replaced(docs):
    pieces = tokenise(docs(*["a b c"] * 3, (None, "x"), (None, "x")), PATH, with_ids=False).selectExpr("*", "'q' as sequence_id", "'r' as offset", "'s' as rank")
    made = packing.pack(pieces)
    assert sorted(made.columns) == sorted(pieces.columns)
    assert sorted(r.offset for r in made.collect()) == [0, 4, 8, 12, 14] and {r["rank"] for r in made.collect()} == {"s"}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    slow = Tokenizer.from_file(PATH)
    names = sorted(texts)
    ids = {k: [*e.ids, 2] for k, e in zip(names, slow.encode_batch([texts[k] for k in names], add_special_tokens=False), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in queries.op5_packing(spark, sf_dir).collect():
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for k, own in by_doc.items():
        own.sort(key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own))) and [p.start for p in own] == [sum(q.length for q in own[:j]) for j in range(len(own))]
        assert all(p.length == 1024 for p in own[1:]) and sum(p.length for p in own) == len(ids[k])
        assert [p.ids_crc32 for p in own] == [zlib.crc32(np.array(ids[k][p.start : p.start + p.length], "<u4").tobytes()) for p in own]
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(by_sequence) <= 1.01 * least + 1


def test_empty_table(docs):
    assert packing.packed(docs("x").limit(0), PATH).collect() == []


def test_patterns_are_all_pairs_and_triples_and_small():
    counts = np.zeros(SEQUENCE + 1, np.int64)
    have = [1, 2, 300, 341, 342, 424, 512, 600, 723, 724, 1022]
    counts[have] = 1
    found = [tuple(x[x > 0].tolist()) for x in patterns(counts)]
    small = {tuple(sorted(x)) for x in found if len(x) < 4}
    assert {(i, j) for i in have for j in have if i <= j and i + j == SEQUENCE} <= small
    assert {(i, j, k) for i in have for j in have for k in have if i <= j <= k and i + j + k == SEQUENCE} <= small
    assert all(sum(x) == SEQUENCE and set(x) <= set(have) for x in found)
    tracemalloc.start()
    try:
        patterns(np.ones(SEQUENCE + 1, np.int64))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6, peak  # it was 49 MB with grids of wide numbers
