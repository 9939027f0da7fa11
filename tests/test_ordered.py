from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.ordered import as_of, sessions, top_k


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


def test_as_of_takes_the_latest_row_whatever_its_values(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(1)), (3, "b", at(9)), (4, "a", at(7))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(3), 30, 1), ("a", at(5), 50, 2), ("a", at(6), None, None)], "k string, ts timestamp, v int, u int")
    got = {r.id: (r.v, r.u) for r in as_of(left, right, ["k"], "ts", ["v", "u"]).collect()}
    assert got == {1: (50, 2), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_as_of_on_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", at(5))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([], "k string, ts timestamp, v int")
    assert as_of(left, right, ["k"], "ts", ["v"]).collect()[0].v is None
    assert as_of(left.limit(0), right, ["k"], "ts", ["v"]).count() == 0


def test_as_of_on_nulls(spark):
    left = spark.createDataFrame([(1, None, at(5)), (2, "a", None), (3, "a", at(5))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([(None, at(3), 30), ("a", None, 9), ("a", at(4), 40)], "k string, ts timestamp, v int")
    assert {r.id: r.v for r in as_of(left, right, ["k"], "ts", ["v"]).collect()} == {1: None, 2: None, 3: 40}


def test_top_k_keeps_no_column_silently(spark):
    with pytest.raises(ValueError, match="rn"):
        top_k(spark.range(3).withColumn("rn", F.lit(1)), ["id"], [F.col("rn")], 1)


def test_top_k(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 5)], "k string, v int")
    assert sorted((r.k, r.v, r.rn) for r in top_k(df, ["k"], [F.desc("v")], 2).collect()) == [("a", 2, 2), ("a", 3, 1), ("b", 5, 1)]


def test_sessions_split_at_the_gap(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(9)), ("a", at(20))], "k string, ts timestamp")
    assert sorted(r.n for r in sessions(df, "k", "ts", "10 minutes").collect()) == [1, 2]
