"""Streams against their batch twins: growing series with late, repeated and shuffled points, rows without time, long co-training."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import attention, classify, drift, match, pairs
from tideglass.sources import series as src
from tideglass.streaming import streams

AT = "2024-01-01 00:00:00"
POINTS = "series_id long, ts timestamp, at int, value double, asked_label string, expected int"


@pytest.fixture(scope="module")
def synthetic(spark):
    rows = src.synthetic_series(spark, 60, 40, 0.1, seed=3).withColumn("split", F.when(F.col("series_id") % 5 == 0, "test").otherwise("train"))
    return spark.createDataFrame(rows.collect(), rows.schema)


@pytest.fixture(scope="module")
def model(synthetic):
    return classify.train(synthetic.where("split = 'train'"), AT, 4)


def rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def test_growing_series_equal_whole_ones(spark, model, synthetic, tmp_path):
    test = synthetic.where("split = 'test'")
    want = rounded(classify.classify(test, model, AT, 0.6, 0.62).collect())
    assert {r[3] for r in want} == {"early", "forest"}
    rnd, points = random.Random(1), []
    for r in test.collect():
        for at, v in enumerate(r["values"]):
            points.append((r["series_id"], datetime(2024, 1, 1) + timedelta(seconds=at), at, v, None, len(r["values"])))
    # shuffled, a tenth twice, with points that say nothing
    points += rnd.sample(points, len(points) // 10) + [(points[0][0], None, None, 1.0, None, None), (points[0][0], None, 3, None, None, 40)]
    rnd.shuffle(points)
    for k in range(4):
        spark.createDataFrame(points[k::4], POINTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # points after all decisions change nothing
    spark.createDataFrame(points[:200], POINTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get(streams._PROVIDER)
    answers = streams.early_answers(streams.read_stream(spark, str(tmp_path / "in"), 1), model, AT, 0.6, 0.62)
    streams.run_batches(answers, streams.early_classify(spark, str(tmp_path), model), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "decisions"))
    assert rounded(got.drop("batch").collect()) == want and got.select("batch").distinct().count() > 1
    assert spark.conf.get(streams._PROVIDER) == before


def test_the_matcher_answers_as_the_tables_do(spark, model, synthetic):
    asked = match.prefixes(synthetic.where("split = 'test'").select("series_id", F.col("label").alias("asked_label"), "values"))
    want = {(r["series_id"], r["length"]): (r["c_label"], round(r["sim"], 9), round(r["match_confidence"], 9)) for r in match.early_match(asked, model.cache, AT, 0.0, 0.0).collect()}
    made = match.matcher(model.cache, AT)
    got = {}
    for r in asked.collect():
        found = made.match(np.array(r["values"]), r["asked_label"])
        if found:
            got[r["series_id"], r["length"]] = (found[0], round(found[1], 9), round(found[2], 9))
    assert got == want and len(got) > 50
    assert match.matcher(model.cache.limit(0), AT).match(np.ones(20), None) is None


def test_streams_of_rows_without_time_and_large_ids(spark, tmp_path):
    big = 2**53 + 1
    rows = [(None if k % 2 else big, None if k < 3 else datetime(2024, 1, 1) + timedelta(seconds=k), None if k == 1 else big + k, "ab"[k // 30 % 2], None if k % 7 == 0 else 0.9) for k in range(120)]
    schema = "stream_id long, ts timestamp, event_id long, label string, sim double"
    # the first batch has rows without time only
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: streams.read_stream(spark, str(tmp_path / "in"), 1)
    got = streams.run_to_end(streams.drift_stream(source(), 20, 10), str(tmp_path / "a"), str(tmp_path / "b"))
    want = drift.label_drift(spark.createDataFrame(rows, schema), 20, 10)
    key = lambda r: str(r)
    round9 = lambda df: sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in df.select("stream_id", "event_id", "changed", "magnitude").collect()), key=key)
    assert round9(got) == round9(want) and any(r[2] for r in round9(got))
    got = streams.run_to_end(streams.attention_stream(source(), frame=20), str(tmp_path / "c"), str(tmp_path / "d"))
    want = attention.streaming_attention(spark.createDataFrame(rows, schema), frame=20)
    fine = lambda df: sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in df.select("stream_id", "event_id", "label", "weight").collect()), key=key)
    assert fine(got) == fine(want) and len(fine(got)) > 100


def test_attention_call_by_call_equals_all_calls(spark):
    rnd = random.Random(2)
    rows = [("all", call, rnd.choice(["a", "b", "c", None, "d"]), rnd.random()) for call in range(6) for _ in range(rnd.choice([0, 1, 5, 40]))]
    seen = spark.createDataFrame(rows, "key string, call int, label string, sim double")
    held = spark.createDataFrame([], "label string, n long, weight double")
    for call in range(6):
        held = spark.createDataFrame(attention.next_attention(held, seen.where(F.col("call") == call), 0.2).collect(), held.schema)
    want = attention.latest_attention(attention.normalised_attention(attention.attention_weights(seen, 0.2)))
    assert {r["label"]: round(r["weight"], 9) for r in held.collect()} == {r["label"]: round(r["weight"], 9) for r in want.collect()}


def test_long_co_training_takes_all_rows_and_reads_bounded_state(spark, model, tmp_path, monkeypatch):
    """Five batches of 55 shapelets: the pool passes 200 rows, and trees grow from all of it."""
    monkeypatch.setattr(pairs, "MAX_SHAPELETS", 10)
    made = src.synthetic_series(spark, 275, 18, 0.3, seed=8)
    rows = made.select(F.lit(0).cast("long").alias("stream_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("series_id")).alias("ts"), F.col("series_id").alias("event_id"), (F.col("series_id") + 5000).alias("i"), "label", "values")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    steps = streams.CoTraining(str(tmp_path / "co"), model, AT, w=30, least=10, due_threshold=2.0, score_threshold=2.0)
    lengths = []
    for b in range(5):
        steps(rows.where(F.floor(F.col("event_id") / 55) == b), b)
        lengths.append((len(steps.version("state", b).first()["labels"]), steps.version("attention", b).count()))
    log = [r.asDict() for r in steps.log().orderBy("iteration").collect()]
    assert [r["pool"] for r in log] == [r["training_rows"] for r in log] == [55, 110, 165, 220, 275]
    assert [r["trees_updated"] for r in log] == [4] * 5 and all(r["selected"] > 10 for r in log)
    roots = steps.version("forest", 4).where("parent_id = -1").collect()
    assert [r["n"] for r in roots] == [275] * 4
    # the windows' labels and a row for each label are all that is kept of the past
    assert lengths[1:] == [(59, 3)] * 4
    found = {r["event_id"]: r for r in drift.label_drift(rows, 30, 10).collect()}
    assert [(r["changed"], round(r["magnitude"], 9), r["kind"]) for r in log] == [(f["changed"], round(f["magnitude"], 9), f["kind"]) for f in (found[55 * b + 54] for b in range(5))]
    assert steps.version("cache", 4).count() == log[-1]["cached"] < model.cache.count() + sum(r["selected"] for r in log)
