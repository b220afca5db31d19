"""Registration of queries, and the inputs that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The labelled series of ``embeddings``, for DuckDB.
SERIES = """s AS (SELECT vec_id AS series_id, CAST(label AS VARCHAR) AS label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
#: The label stream of ``events``: t is a row's place in its stream (from 1), sim a similarity in [0, 1).
STREAM = """e AS (SELECT user_id % 16 AS stream_id, event_id, event_type AS label, value,
  row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS t, CAST(event_id % 97 AS DOUBLE) / 97 AS sim FROM events)"""


def query(sql: str | None = None):
    """Register a function under its name, with its DuckDB twin if SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as labelled series; every fifth is of the test split."""
    e = table(spark, sf_dir, "embeddings")
    split = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    return e.select(F.col("vec_id").alias("series_id"), F.col("label").cast("string").alias("label"), split.alias("split"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as 16 label streams: stream_id, ts, event_id, label, value, sim."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 16).alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("label"), "value", ((F.col("event_id") % 97).cast("double") / 97).alias("sim"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, digits: int = 6) -> str:
    """The same for DuckDB."""
    return f"round({expression}, {digits}) + 0.0::DOUBLE"


def values_of(series_df: DataFrame, series_id: int) -> Column:
    """The values of one series as a literal array."""
    row = series_df.where(F.col("series_id") == series_id).select("values").first()
    return F.array(*[F.lit(float(x)) for x in (row[0] if row else [])])
