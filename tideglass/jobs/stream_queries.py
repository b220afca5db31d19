"""Streaming jobs over ``events`` and ``embeddings``, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.jobs.attention_queries import _D
from tideglass.jobs.base import ORACLE, STREAM, query, r, rounded, series
from tideglass.jobs.forest_queries import ACCEPTED, TRAINED_AT, _trained
from tideglass.operators import pairs
from tideglass.shared import application_folder
from tideglass.streaming import streams


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streams.read_stream(spark, f"{sf_dir}/events.parquet")
    return e.select((F.col("user_id") % 16).alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("label"), "value", ((F.col("event_id") % 97).cast("double") / 97).alias("sim"))


def _folder(spark: SparkSession) -> str:
    return f"{application_folder(spark)}/{uuid.uuid4().hex}/stream"


def _ended(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = _folder(spark)
    return streams.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint")


@query(f"WITH {STREAM} SELECT stream_id, event_id, label, {r('value')} AS value FROM e")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events through a streaming source and sink."""
    return rounded(_ended(spark, _rows(spark, sf_dir).select("stream_id", "event_id", "label", "value")))


@query(f"WITH {_D} SELECT stream_id, event_id, changed, {r('magnitude')} AS magnitude FROM d")
def stream_label_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ended(spark, streams.drift_stream(_rows(spark, sf_dir))))


@query(ORACLE["streaming_attention"])
def stream_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ended(spark, streams.attention_stream(_rows(spark, sf_dir))))


@query()
def stream_early_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``classify`` as a stream: the test series arrive point by point, a quarter of their length at a time."""
    folder = _folder(spark)
    test = series(spark, sf_dir).where("split = 'test'")
    points = test.select("series_id", F.col("label").alias("asked_label"), F.size("values").alias("expected"), F.posexplode("values").alias("at", "value"))
    points = points.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("at")))
    for quarter in range(4):
        points.where(F.floor(4 * F.col("at") / F.col("expected")) == quarter).write.mode("append").parquet(f"{folder}/arrived")
    files, model = len(spark.read.parquet(f"{folder}/arrived").inputFiles()), _trained(spark, sf_dir)
    answers = streams.early_answers(streams.read_stream(spark, f"{folder}/arrived", -(-files // 4)), model, TRAINED_AT, *ACCEPTED)
    streams.run_batches(answers, streams.early_classify(spark, folder, model), f"{folder}/checkpoint")
    return rounded(spark.read.parquet(f"{folder}/decisions").drop("batch"))


@query()
def co_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of incremental training: shapelets of the test series come in four batches to a model of the train series."""
    folder = _folder(spark)
    new = _trained(spark, sf_dir, "test").shapelets
    places = F.col("i") + pairs.MAX_SHAPELETS
    rows = new.select(F.lit(0).cast("long").alias("stream_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i")).alias("ts"), F.col("i").alias("event_id"), places.alias("i"), "label", "values")
    number = new.count()
    for part in range(4):
        rows.where(F.floor(4 * F.col("event_id") / max(1, number)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/arrived")
    training = streams.CoTraining(folder, _trained(spark, sf_dir), TRAINED_AT, w=20, least=10)
    streams.run_batches(streams.read_stream(spark, f"{folder}/arrived", 1), training, f"{folder}/checkpoint")
    return rounded(training.log())
