"""Streams of events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """(start, by, n) per tumbling window; rows later than ``late`` behind the newest are dropped."""
    spans = events.withWatermark(at, late).groupBy(F.window(at, width).alias("span"), by).agg(F.count("*").alias("n"))
    return spans.select(F.col("span.start").alias("start"), by, "n")


def drained(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what the stream's source holds now to ``path``, exactly once however often it is restarted."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_root(spark: SparkSession) -> str:
    """A folder that driver and executors share: below ``spark.checkpoint.dir``, or a local one for local sessions without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/millrace"
    return f"{root.rstrip('/')}/streams-{spark.sparkContext.applicationId}"
