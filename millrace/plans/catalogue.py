"""Registered queries over the test tables, each with its SQL.

claims to be one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import dot, norm
from millrace.operators.ordered import as_of, sessions, top_k
from millrace.plans.views import run
from millrace.sources.tables import streamed, table
from millrace.streaming.windows import counts, drained, stream_root


def revenue() -> Column:
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")


def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    made = rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), revenue(), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))
    return made


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    made = lines.groupBy("o_orderkey", "o_orderdate").agg(revenue())
    return made.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return top_k(rows, ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


def customers_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted by nation first, so that neither the joins nor the rollup, which triples its rows, sees a row a customer.
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("m"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = counts.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.sum("m").alias("n"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "30 minutes")


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return as_of(bought, viewed, ["user_id"], "ts", ["view_id", "view_value"])


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(norm(F.col("embedding")), 4).alias("norm"), F.round(dot(F.col("embedding"), F.reverse("embedding")), 4).alias("turned"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events, drained into a folder for streams: the windows that its watermark has closed."""
    path = f"{stream_root(spark)}/hourly-events-{uuid.uuid4().hex}"
    drained(counts(streamed(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "1 hour"), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows").withColumn("start", F.col("start").cast("timestamp_ntz"))


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over views."""
    return run(spark, sf_dir, ["lineitem", "supplier", "nation"], "SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 25 GROUP BY n_name")


FLAGSHIP = top_orders
SQL = {
    "line_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "top_orders": """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "top_lines": """SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rn
FROM lineitem QUALIFY rn <= 3""",
    "customers_by_place": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "user_sessions": """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
SELECT user_id, min(ts) AS start, count(*) AS n FROM numbered GROUP BY user_id, session""",
    "last_view": """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "hourly_events": """WITH hours AS (SELECT date_trunc('hour', ts) AS start, event_type FROM events)
SELECT start, event_type, count(*) AS n FROM hours WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
    "supplier_lines": """SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem, supplier, nation
WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_quantity > 25 GROUP BY n_name""",
    "vector_norms": """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm,
round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * embedding[len(embedding) + 1 - i]::DOUBLE)), 4) AS turned FROM embeddings""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (line_summary, top_orders, top_lines, customers_by_place, user_sessions, last_view, vector_norms, hourly_events, supplier_lines)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
