"""Reading the tables and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text", "xml")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream; times without zone become instants, as watermarks need them."""
    # A stream takes a single file only by a pattern.
    rows = spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if isinstance(f.dataType, T.TimestampNTZType)})


def write(df: DataFrame, path: str, form: str = "parquet", **options: str) -> None:
    if form not in FORMATS:
        raise ValueError(f"{form} is none of {', '.join(FORMATS)}")
    df.write.format(form).options(**options).save(path)


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    if form not in FORMATS:
        raise ValueError(f"{form} is none of {', '.join(FORMATS)}")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)
