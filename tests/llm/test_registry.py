import importlib
import re

import pytest

from millrace.llm import common, queries


def test_all_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert [sum(bool(re.match(rf"op{n}_", x)) for x in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(entry.oracle_sql())


def test_work_folder(spark):
    class Other:
        conf = {}

    class Conf:
        def __init__(self, **kv):
            self.kv = kv

        def get(self, key, default=None):
            return self.kv.get(key, default)

    Other.sparkContext = spark.sparkContext
    Other.conf = Conf(**{"spark.checkpoint.dir": "hdfs://x/shared/", "spark.master": "yarn"})
    assert common.work_root(Other) == f"hdfs://x/shared/millrace-{spark.sparkContext.applicationId}"
    Other.conf = Conf(**{"spark.master": "local[2]"})
    assert common.work_root(Other).startswith("file:///tmp/checkpoints/millrace/")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        Other.conf = Conf(**{"spark.master": master})
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.work_root(Other)


def test_sides_are_broadcast_only_up_to_the_bound(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = common.settle(spark.range(100), "numbers")
    assert "strategy=broadcast" in plan(spark.range(1000).join(common.small(df), "id"))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 99)
    assert "strategy=broadcast" not in plan(spark.range(1000).join(common.small(df), "id"))


def test_a_sieve_loses_nothing_and_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_SLOTS", 128)
    rows = spark.range(20_000).selectExpr("xxhash64(id) as key", "id")
    wanted = common.settle(rows.where("id % 40 = 0").select("key"), "wanted")
    assert common.sieve(wanted, "key").count() <= 128
    held, free = common.sifted(rows, "key", wanted)
    assert held.join(wanted, "key").count() == 500 and free.join(wanted, "key").count() == 0
    assert held.count() + free.count() == 20_000 and held.count() < 3000


def test_scopes_delete_what_was_settled_inside(spark):
    fs, root = common.folder(spark, common.work_root(spark))
    names = lambda: {x.getPath().getName().rsplit("-", 1)[0] for x in fs.listStatus(root)}
    with common.Scope(spark) as outer:
        with common.Scope(spark) as inner:
            common.settle(spark.range(3), "scope-inside")
            kept = inner.out(spark.range(5), "scope-kept")
        assert "scope-inside" not in names() and kept.count() == 5
        assert outer.paths == inner.kept
    assert not {"scope-inside", "scope-kept"} & names()
