"""Tables that an operator stores on its way, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.streaming.ingest import scratch


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: lineage ends here, and a lost executor costs one task."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A stored table of keys, marked for broadcast if a count finds at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
