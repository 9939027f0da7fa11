import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, sql
from millrace.llm.mixing import mix, mixed, sized, targets
from tests.helpers import assert_same
from tests.llm.conftest import HARD


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by clamping and sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = float(most * sizes[s])
        left = sum(sizes.values()) - sum(fixed.values())


def test_targets_equal_repeated_clamping(spark):
    r = random.Random(1)
    for n in (1, 2, 5, 20):
        sizes = {(None if k == 3 else f"s{k}"): r.choice([0, 1, 10, 100, 100_000]) for k in range(n)}
        if not sum(sizes.values()):
            continue
        got = {x.source: x.target for x in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(filled(sizes))


def test_sources_come_near_their_targets(spark):
    r = random.Random(2)
    rows = [(k, " ".join(["w"] * r.randrange(1, 60)), r.choice(["a"] * 6 + ["b", "c", "", None, "é"])) for k in range(4000)]
    found = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for x in found:
        n = len(x.doc.text.split())
        sizes[x.doc.source] += n
        taken[x.doc.source] += n * x.repeats
        target[x.doc.source] = x.target
        assert 0 <= x.repeats <= 3
    assert target == pytest.approx(filled(sizes))
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def taken_of(found):
    """Per source: words taken, target, size of its smallest document."""
    out = defaultdict(lambda: [0, 0.0, 10**9])
    for x in found:
        n = len((x.doc.text or "").split())
        own = out[x.doc.source]
        own[0], own[1], own[2] = own[0] + n * x.repeats, x.target, min(own[2], n or 10**9)
    return out


@pytest.mark.parametrize("ids", ["null", "one", "some", "copies"])
def test_repeated_and_null_ids(docs, ids, sf_dir):
    texts = ["w x y z" if ids == "copies" else f"w x y {k}" for k in range(1000)]
    id_of = {"null": lambda k: None, "one": lambda k: 7, "some": lambda k: k % 10, "copies": lambda k: None}[ids]
    rows = [(id_of(k), t) for k, t in enumerate(texts)]
    # 4,000 words beside 2,000 of a source with a weight of 1 to 1.4: 3,500 of the 6,000.
    df = docs(*rows, (5000, "v " * 2000)).withColumn("source", F.when(F.col("doc_id") == 5000, "b").otherwise("a"))
    found = mix(df.repartition(5), weights=(7.0, 5.0)).collect()
    assert len(found) == 1001 and {x.repeats for x in found if x.doc.source == "a"} == {0, 1}
    taken, target, _ = taken_of(found)["a"]
    assert (taken, target) == (3500, 3500.0)


def test_the_fraction_has_documents_of_all_sizes(docs):
    sizes = [1 + k % 7 for k in range(900)] + [200 + k % 50 for k in range(90)] + [5000] * 10
    df = docs(*[f"{k} " * n for k, n in enumerate(sizes)], (9000, "v " * 60_000)).withColumn("source", F.when(F.col("doc_id") == 9000, "b").otherwise("a"))
    found = mix(df, weights=(1.0, 2.0)).collect()
    taken, target, _ = taken_of(found)["a"]
    assert 0 <= target - taken < 2
    part = target / sum(sizes)
    for low, high in ((1, 8), (200, 250), (5000, 5001)):
        own = [x.repeats for x in found if x.doc.source == "a" and low <= len(x.doc.text.split()) < high]
        assert abs(sum(own) / len(own) - part) < 0.15


@pytest.mark.parametrize("seed", ["mix-1", "mix-2"])
def test_a_huge_document_keeps_no_source_from_its_target(docs, seed):
    rows = [(k, "w " * 100, "s0") for k in range(1000)] + [(1000, "w " * 100_000, "s0"), (1001, "w " * 200_000, "s1")]
    # A weight of 1 to 3: s0, of 200,000 words, gets 100,000.
    found = mix(docs(*[r[:2] for r in rows]).drop("source").withColumn("source", F.when(F.col("doc_id") > 1000, "s1").otherwise("s0")), seed=seed, weights=(1.0, 3.0)).collect()
    taken = sum(len(x.doc.text.split()) * x.repeats for x in found if x.doc.source == "s0")
    assert {x.target for x in found if x.doc.source == "s0"} == {100_000.0} and taken == 100_000


def test_reruns_agree_whatever_the_partitions(docs):
    df = docs(*[f"a b {k}" for k in range(200)])
    runs = [sorted((r.doc.doc_id, r.repeats) for r in mix(x).collect()) for x in (df, df.repartition(7))]
    assert runs[0] == runs[1]


def test_hard_rows(docs):
    rows = [(None, "a b"), (7, "a b"), (7, "a b"), *((100 + k, t) for k, t in enumerate(HARD))]
    df = docs(*rows, source=None, clashing=True)
    found = mix(df).collect()
    assert len(found) == len(rows) and {r.repeats for r in found} == {1}
    assert mixed(df).columns == df.columns and mixed(df).count() == len(rows)
    assert {r.repeats for r in mix(docs(None, "", " ")).collect()} == {0}
    assert mix(df.limit(0)).collect() == [] == sized(df.limit(0)).collect()


def test_many_sources_are_joined_by_shuffle(docs, monkeypatch):
    from millrace.llm import common

    df = docs(*[f"a b {k}" for k in range(50)])
    wanted = sorted((r.doc.doc_id, r.repeats) for r in mix(df).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted((r.doc.doc_id, r.repeats) for r in mix(df).collect()) == wanted


def test_query_equals_its_sql(spark, sf_dir):
    assert_same(queries.op9_mixing(spark, sf_dir), sql.OP9, sf_dir)
    for x in queries.op9_mixing(spark, "/root/testdata/sf0.01").collect():
        assert x.taken <= 3 * x.size
    for nodes in ("Python", "Arrow", "Pandas"):
        assert nodes not in queries.op9_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
