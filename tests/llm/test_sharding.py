import zlib
from collections import defaultdict

import numpy as np

from millrace.llm import queries
from millrace.llm.sharding import GIVE, place, shard
from tests.llm.conftest import HARD


def brute_place(items, n):
    shares = [[x / max(sum(i[r] for i in items) / n, 1e-12) for r, x in enumerate(i)] for i in items]
    left, out = [[1.0] * 3 for _ in range(n)], {}
    for k in sorted(range(len(items)), key=lambda k: (-max(shares[k]), -shares[k][0], k)):
        near = [s for s in range(n) if left[s][0] >= max(x[0] for x in left) - max(sum(x[0] for x in left) / n / 2, GIVE, shares[k][0])]
        best = max(near, key=lambda s: (round(sum(a * b for a, b in zip(left[s], shares[k], strict=True)), 9), -s))
        out[k] = best
        left[best] = [a - b for a, b in zip(left[best], shares[k], strict=True)]
    return [out[k] for k in range(len(items))]


def test_place_equals_brute_force():
    r = np.random.default_rng(1)
    for n in (1, 7, 60):
        items = r.integers(1, 1000, (n, 3)).astype(float)
        assert place(items, 5).tolist() == brute_place(items.tolist(), 5)
    assert place(np.zeros((0, 3)), 5).tolist() == []


def check(rows, texts, n_shards=40):
    size, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[text].add(r.shard)
        assert 0 <= r.shard < n_shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size, {k: len(v) for k, v in slots.items()}, groups


def test_joint_balance(docs):
    r = np.random.default_rng(2)
    texts = [" ".join(["w" * int(r.integers(1, 12))] * int(r.integers(1, 200))) for _ in range(3000)]
    found = shard(docs(*texts)).collect()
    size, rows, groups = check(found, dict(enumerate(texts)))
    assert max(size.values()) / min(size.values()) < 1.01
    assert max(rows.values()) / min(rows.values()) < 1.1
    tokens = defaultdict(int)
    for x in found:
        tokens[x.shard] += len(texts[x.doc_id].split())
    assert max(tokens.values()) / min(tokens.values()) < 1.1
    assert all(len(v) == 1 for v in groups.values())


def test_a_hot_group_is_cut_and_others_stay_whole(docs):
    texts = ["copy " * 20] * 900 + [f"one {k}" * 15 for k in range(1800)] + ["twin " * 30, "twin " * 30]
    size, rows, groups = check(shard(docs(*texts)).collect(), dict(enumerate(texts)))
    assert max(size.values()) / min(size.values()) < 1.05
    assert len(groups["copy " * 20]) > 1 and all(len(v) == 1 for t, v in groups.items() if t != "copy " * 20)


def test_a_hot_group_of_repeated_and_null_ids_is_cut(docs):
    rows = [(None, "copy " * 20)] * 450 + [(7, "copy " * 20)] * 450 + [(100 + k, f"one {k}" * 15) for k in range(1800)]
    found = shard(docs(*rows)).collect()
    size, n_rows, groups = check(found, dict(rows))
    assert len(found) == len(rows) and len(size) == 40
    assert max(size.values()) / min(size.values()) < 1.05
    assert len({r.shard for r in found if r.doc_id is None}) > 1 and len({r.shard for r in found if r.doc_id == 7}) > 1
    assert all(len(v) == 1 for t, v in groups.items() if t != "copy " * 20)


def test_hard_rows(docs):
    rows = [(None, "x"), (7, "x"), (7, "x"), *((100 + k, t) for k, t in enumerate(HARD))]
    found = shard(docs(*rows, clashing=True)).collect()
    assert len(found) == len(rows)
    check(found, dict(rows))
    assert shard(docs("x").limit(0)).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_sharding(spark, sf_dir).collect()
    size, _, _ = check(rows, texts)
    assert len(rows) == len(texts) and len(size) == 40 and max(size.values()) / min(size.values()) < 1.02
    assert [(r.shard, r.slot) for r in sorted(rows, key=lambda r: r.doc_id)] == [(r.shard, r.slot) for r in sorted(queries.op10_sharding(spark, sf_dir).collect(), key=lambda r: r.doc_id)]
