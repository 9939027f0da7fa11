"""The tables of a folder as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import table


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Make ``folder/name.parquet`` the temporary view ``name``; filters and columns of a query reach the scan."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def run(spark: SparkSession, folder: str, names: list[str], query: str) -> DataFrame:
    register(spark, folder, names)
    return spark.sql(query)
