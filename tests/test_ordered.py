"""Jobs along streams against plain loops: in small chunks, with null streams, values and times, and ids past 2 ** 53."""

import datetime
import math
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from tideglass.operators import attention, drift, match, ordered

BIG = 2**53 + 1
SCHEMA = "stream_id long, ts timestamp, event_id long, label string, sim double"


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 37)


def time(k):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k)


def sample(seed=1, sizes=((None, 420), (BIG, 300), (BIG + 2, 37), (-5, 260), (8, 1))):
    """Rows of streams in order; labels change over time, some labels, sims and times are null."""
    rnd, rows = random.Random(seed), []
    for stream, n in sizes:
        for k in range(n):
            label = rnd.choice(["a", "b", "c"] if k % 200 < 120 else ["c", "d", None])
            rows.append((stream, None if k < 2 else time(k // 2), BIG + k, label, rnd.choice([None, float("nan"), rnd.random(), 0.9])))
    return rows


def streams(rows):
    """Rows of each stream in order, nulls first."""
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {s: sorted(own, key=lambda r: (r[1] is not None, r[1] or time(0), r[2])) for s, own in out.items()}


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(random.Random(0).sample(rows, len(rows)), schema)


def test_rows_are_placed_without_gaps(spark):
    rows = sample()
    got = ordered.placed(frame(spark, rows), "stream_id", ["ts", "event_id"]).orderBy("_row").collect()
    assert [r["_row"] for r in got] == list(range(len(rows)))
    want = [r for s in sorted(streams(rows), key=lambda s: (s is not None, s or 0)) for r in streams(rows)[s]]
    assert [(r["stream_id"], r["event_id"]) for r in got] == [(r[0], r[2]) for r in want]


def drifts(labels, w=100, least=50):
    """(changed, magnitude) of each row of a stream by counting both windows anew."""
    for t in range(len(labels)):
        recent = [x for x in labels[max(0, t - w + 2) : t + 1] if x is not None]
        history = [x for x in labels[max(0, t - 2 * w + 2) : max(0, t - w + 2)] if x is not None]
        if len(recent) < least or len(history) < least:
            yield False, 0.0
            continue
        p, q = (Counter(x) for x in (recent, history))
        total = 0.0
        for x in set(p) | set(q):
            a, b = p[x] / len(recent), q[x] / len(history)
            total += sum(y * math.log2(y / ((a + b) / 2)) / 2 for y in (a, b) if y)
        yield math.sqrt(max(0.0, total)) > 0.1, math.sqrt(max(0.0, total))


def test_label_drift_equals_the_loop(spark):
    rows = sample()
    got = {(r["stream_id"], r["event_id"]): (r["ts"], r["changed"], round(r["magnitude"], 9)) for r in drift.label_drift(frame(spark, rows)).collect()}
    want = {(s, r[2]): (r[1], c, round(m, 9)) for s, own in streams(rows).items() for r, (c, m) in zip(own, drifts([x[3] for x in own]), strict=True)}
    assert got == want
    assert {s: any(c for k, (_, c, _) in got.items() if k[0] == s) for s in (None, BIG)} == {None: True, BIG: True}


def test_windows_in_chunks_equal_lists(spark):
    rows = sample(9)
    got = {(r["stream_id"], r["event_id"]): (r["recent"], r["history"]) for r in drift.drift_windows(frame(spark, rows), 20).collect()}
    want = {}
    for s, own in streams(rows).items():
        labels = [r[3] for r in own]
        for t, r in enumerate(own):
            want[s, r[2]] = tuple([x for x in part if x is not None] for part in (labels[max(0, t - 18) : t + 1], labels[max(0, t - 38) : max(0, t - 18)]))
    assert got == want
    numbers = [(s, t, e, None if x is None or x != x else x) for s, t, e, _, x in rows]
    df = frame(spark, numbers, "stream_id long, ts timestamp, event_id long, earliness double")
    got = {(r["stream_id"], r["event_id"]): r["mean_earliness"] for r in drift.rolling_earliness(df, 30).collect()}
    for s, own in streams(numbers).items():
        for t, r in enumerate(own):
            there = [x[3] for x in own[max(0, t - 29) : t + 1] if x[3] is not None]
            assert got[s, r[2]] == (pytest.approx(sum(there) / len(there)) if there else None)


def shares(rows, n=100):
    held = deque(maxlen=n)
    for r in rows:
        held.append(r[3:])
        if r[4] is not None and r[4] >= 0.8:
            weights = {}
            for label in {x for x, _ in held}:
                sims = [s for x, s in held if x == label]
                there = [s for s in sims if s is not None and s == s]
                weight = 0.4 * len(sims) + 0.3 * (sum(there) / len(there) if there else 0.0)
                weights[label] = max(0.0, math.log2(weight)) if weight > 0 else 0.0
            for label, x in weights.items():
                yield r[2], label, x / sum(weights.values()) if sum(weights.values()) else 1 / len(weights)


def test_streaming_attention_equals_the_loop(spark):
    rows = sample(2)
    key = lambda r: str(r)
    got = sorted(((r["stream_id"], r["event_id"], r["label"], round(r["weight"], 9)) for r in attention.streaming_attention(frame(spark, rows)).collect()), key=key)
    assert got == sorted(((s, e, label, round(x, 9)) for s, own in streams(rows).items() for e, label, x in shares(own)), key=key)


def test_attention_after_a_null_similarity(spark):
    rows = [(1, time(k), k, "ab"[k % 2], None if k == 0 else 0.9) for k in range(300)]
    last = attention.streaming_attention(frame(spark, rows)).where("event_id = 299").collect()
    assert [round(r["weight"], 9) for r in last] == [0.5, 0.5]


@pytest.mark.parametrize("decay", [0.95, 0.5])
def test_decayed_frequency_equals_the_loop(spark, decay):
    rows = sample(3)
    want = {}
    for s, own in streams(rows).items():
        held = {}
        for r in own:
            held = {x: v * decay for x, v in held.items() if v * decay >= 0.01}
            held[r[3]] = held.get(r[3], 0.0) + 1
            want[s, r[2]] = (r[3], round(held[r[3]], 9))
    got = {(r["stream_id"], r["event_id"]): (r["label"], round(r["frequency"], 9)) for r in attention.decayed_frequency(frame(spark, rows), decay).collect()}
    assert got == want


def test_faint_labels_are_dropped(spark):
    rows = [(1, time(k), k, "a" if k in (0, 150) else "b", 0.5) for k in range(151)]
    assert attention.decayed_frequency(frame(spark, rows)).where("event_id = 150").first()["frequency"] == 1.0
    with pytest.raises(ValueError, match="decay"):
        attention.decayed_frequency(frame(spark, rows), 1.0)


def outcomes(seed=4):
    rnd = random.Random(seed)
    right = lambda k: rnd.random() < (0.97 if k % 160 < 80 else 0.4)
    return [(s, t, e, rnd.choice([None, True]) if k % 50 == 7 else right(k), rnd.choice([0.1, 0.2, None, 0.6])) for k, (s, t, e, _, _) in enumerate(sample(seed))]


def test_adaptive_threshold_equals_the_loop(spark):
    rows = outcomes()
    got = {(r["stream_id"], r["event_id"]): (r["correct"], round(r["threshold"], 9)) for r in match.adaptive_threshold(frame(spark, rows, "stream_id long, ts timestamp, event_id long, correct boolean, earliness double")).collect()}
    want = {}
    for s, own in streams(rows).items():
        t = 0.6
        for k, r in enumerate(own):
            last = own[max(0, k - 49) : k + 1]
            right, early = ([x[c] for x in last if x[c] is not None] for c in (3, 4))
            if len(last) >= 10 and right:
                accuracy = sum(right) / len(right)
                if accuracy < 0.6:
                    t = max(0.4, t - 0.01)
                elif accuracy > 0.85 and early and sum(early) / len(early) < 0.3:
                    t = min(0.85, t + 0.01)
            want[s, r[2]] = (r[3], round(t, 9))
    assert got == want and len({v[1] for v in want.values()}) > 10


def test_earliness_threshold_equals_the_loop(spark):
    rnd = random.Random(6)
    rows = [(s, t, e, rnd.random() ** (0.2 if k % 90 < 40 else 4)) for k, (s, t, e, _, _) in enumerate(sample(5))]
    got = {(r["stream_id"], r["event_id"]): round(r["threshold"], 9) for r in drift.earliness_threshold(frame(spark, rows, "stream_id long, ts timestamp, event_id long, earliness double")).collect()}
    want = {}
    for s, own in streams(rows).items():
        t = 0.85
        for k, r in enumerate(own):
            mean = sum(x[3] for x in own[max(0, k - 10) : k]) / max(1, min(10, k))
            t = t if k < 10 else min(0.95, t * 1.05) if mean > 0.7 else max(0.5, t * 0.95) if mean < 0.3 else t
            want[s, r[2]] = round(t, 9)
    assert got == want and len(set(want.values())) > 10


def test_folds_keep_other_columns_exactly(spark):
    rows = [(None if k % 3 else BIG, time(k), k, True, 0.1, None if k % 5 == 0 else BIG + k) for k in range(90)]
    df = spark.createDataFrame(rows, "stream_id long, ts timestamp, event_id long, correct boolean, earliness double, other long").withColumn("odd name", F.lit(1)).withColumn("list", F.array(F.lit(1), F.lit(None)))
    got = {r["event_id"]: r for r in match.adaptive_threshold(df).collect()}
    assert all(got[k]["other"] == r[5] and got[k]["stream_id"] == r[0] and got[k]["ts"] == r[1] and got[k]["list"] == [1, None] for k, r in enumerate(rows))
    assert list(got[0].asDict()) == [*df.columns, "threshold"]


def test_confidence_follows_feedback_in_order_with_ties(spark):
    rnd = random.Random(7)
    rows = [(s, k // 3, 0.5, rnd.choice([None, rnd.random()])) for s, n in ((None, 250), (BIG, 120), (3, 1)) for k in range(n)]
    want = {}
    for s, at, start, new in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3] is not None, r[3] or 0)):
        v = want.get(s, start)
        want[s] = v if new is None else 0.9 * v + 0.1 * new
    for seed in (0, 1):
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "shapelet_id long, at long, start double, new double")
        got = {r["shapelet_id"]: r["confidence"] for r in match.confidence_ema(df).collect()}
        assert {s: round(v, 9) for s, v in got.items()} == {s: round(v, 9) for s, v in want.items()}


def test_a_hot_stream_is_worked_on_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 2000)
    # so few rows would be put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 7 + F.floor(F.col("id") / 300) % 3).cast("string").alias("label"))
    table = ordered.placed(rows, "stream_id", ["ts", "event_id"])
    parts = table.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 15_000
    got = drift.label_drift(rows).withColumn("part", F.spark_partition_id()).toPandas()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["part"].nunique() > 4 and got["changed"].sum() > 1000


def test_empty_streams(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert drift.label_drift(none).count() == attention.streaming_attention(none).count() == attention.decayed_frequency(none).count() == 0
    assert match.adaptive_threshold(none.selectExpr("stream_id", "ts", "event_id", "true AS correct", "sim AS earliness")).count() == 0
    assert match.confidence_ema(spark.createDataFrame([], "shapelet_id long, at long, start double, new double")).count() == 0
    with pytest.raises(ValueError, match="starts at"):
        match.adaptive_threshold(none.selectExpr("stream_id", "ts", "event_id", "true AS correct", "sim AS earliness"), start=0.9)
