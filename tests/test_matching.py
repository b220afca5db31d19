"""Warping, matching, classification, forest and co-training against plain loops."""

import math
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import plain
from tideglass.functions import kernels, scalars
from tideglass.jobs import match_queries
from tideglass.operators import attention, classify, drift, forest, match, pairs, profile
from tideglass.sources import series as src
from tideglass.streaming import streams

AT = "2024-01-01 00:00:00"


def test_warping_equals_plain_loops():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 50, 2)
        x, y, radius = rng.normal(size=n).cumsum(), rng.normal(size=m).cumsum(), int(rng.integers(1, 4))
        exact = plain.table(x, y)[0]
        assert kernels.dtw(x, y) == pytest.approx(exact)
        assert kernels.dtw(x, y, radius) == pytest.approx(plain.warped(x, y, radius))
        assert kernels.dtw(x, y, 60) == pytest.approx(exact)
    a, b = np.sin(np.linspace(0, 6, 64)), np.sin(np.linspace(1, 7, 40))
    assert kernels.dtw(a, b, 1) <= 1.05 * kernels.dtw(a, b)


def test_metrics_equal_plain_loops_and_expressions(spark):
    rng = np.random.default_rng(1)
    some = [rng.normal(size=int(n)) for n in rng.integers(1, 30, 40)] + [np.ones(5), np.zeros(4), np.array([2.0])]
    a, b = some, [some[(3 * k + 1) % len(some)] for k in range(len(some))]
    got = np.empty(len(a))
    for at, x, y in kernels.by_lengths(a, b):
        got[at] = kernels.multi_metric(x, y)
    assert got == pytest.approx([plain.multi_metric(list(x), list(y)) for x, y in zip(a, b, strict=True)])
    same = [(k, [float(v) for v in rng.normal(size=12)], [float(v) for v in rng.normal(size=12)]) for k in range(20)]
    rows = spark.createDataFrame(same, "k int, a array<double>, b array<double>").select("k", scalars.multi_metric_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert {r["k"]: pytest.approx(r["s"]) for r in rows} == {k: plain.multi_metric(x, y) for k, x, y in same}
    big = [1e9, 1e9 + 1, 1e9 + 2, 1e9 + 4]
    one = spark.range(1).select(scalars.pearson01_prefix(F.array(*map(F.lit, big)), F.array(*[F.lit(x - 1e9) for x in big])).alias("r")).first()
    assert one["r"] == pytest.approx(1.0)


def test_early_match_equals_plain_loops(spark):
    data = "/root/testdata/sf0.001"
    cache = match_queries._cache(spark, data)
    asked = match_queries._queries(spark, data).where("series_id % 25 = 0 and length % 4 = 0")
    got = {(r["series_id"], r["length"]): r for r in match.early_match(asked, cache, match_queries.AS_OF, 0.3, 0.3).collect()}
    held, now, want = [r.asDict() for r in cache.collect()], datetime.fromisoformat(match_queries.AS_OF), {}
    for q in asked.collect():
        found = plain.early_match(list(q["values"]), q["asked_label"], held, now, 0.3, 0.3)
        if found:
            want[q["series_id"], q["length"]] = found
    assert got.keys() == want.keys() and len(want) > 20
    for k, (shapelet, label, sim, sure) in want.items():
        assert (got[k]["c_shapelet_id"], got[k]["c_label"]) == (shapelet, label)
        assert got[k]["sim"] == pytest.approx(sim) and got[k]["match_confidence"] == pytest.approx(sure)


@pytest.fixture(scope="module")
def synthetic(spark):
    rows = src.synthetic_series(spark, 60, 40, 0.1, seed=3).withColumn("split", F.when(F.col("series_id") % 5 == 0, "test").otherwise("train"))
    return spark.createDataFrame(rows.collect(), rows.schema)


@pytest.fixture(scope="module")
def model(synthetic):
    return classify.train(synthetic.where("split = 'train'"), AT, 4)


def walked(values, nodes, shapelets):
    """{tree: (label, path)} of one series, in plain loops."""
    out = {}
    for tree in {n["tree_id"] for n in nodes}:
        own = {n["node_id"]: n for n in nodes if n["tree_id"] == tree}
        at, path = 0, [0]
        while own[at]["label"] is None:
            sim = 1 / (1 + plain.distance(values, shapelets[own[at]["shapelet_id"]]))
            side = "left" if sim < own[at]["threshold"] else "right"
            at = next(k for k, n in own.items() if n["parent_id"] == at and n["side"] == side)
            path.append(at)
        out[tree] = (own[at]["label"], path)
    return out


def test_forest_equals_plain_loops(spark, model, synthetic):
    nodes, held = [r.asDict() for r in model.nodes.collect()], {r["i"]: r for r in model.shapelets.collect()}
    values = {i: list(r["values"]) for i, r in held.items()}
    drawn = {}
    for r in forest.bootstrap(model.shapelets, 4).orderBy("place").collect():
        drawn.setdefault(r["tree_id"], []).append(r["i"])
    made = plain.grown(drawn, {i: (r["label"], values[i]) for i, r in held.items()})
    clean = lambda x: None if x is None or x != x else x
    got = sorted((n["tree_id"], n["node_id"], n["parent_id"], n["side"], clean(n["shapelet_id"]), clean(n["threshold"]), n["label"]) for n in nodes)
    assert [g[:5] + g[6:] for g in got] == [m[:5] + m[6:] for m in made]
    assert [g[5] or 0 for g in got] == pytest.approx([m[5] or 0 for m in made])
    test = synthetic.where("split = 'test'")
    found = {(r["series_id"], r["tree_id"]): (r["label"], list(r["path"])) for r in forest.predict_trees(test, model.nodes, model.shapelets).collect()}
    want = {(r["series_id"], t): w for r in test.collect() for t, w in walked(list(r["values"]), nodes, values).items()}
    assert found == want


def test_classify_equals_plain_loops(spark, model, synthetic):
    test = synthetic.where("split = 'test'")
    nodes, cache = [r.asDict() for r in model.nodes.collect()], [r.asDict() for r in model.cache.collect()]
    shapelets = {r["i"]: list(r["values"]) for r in model.shapelets.collect()}
    now = datetime.fromisoformat(AT)
    for least in (0.5, 0.62):
        got = {r["series_id"]: r for r in classify.classify(test, model, AT, 0.6, least).collect()}
        assert len(got) == test.count()
        for r in test.where("series_id % 2 = 0").collect():
            v, n = list(r["values"]), len(r["values"])
            early = None
            for length in range(math.floor(n * 0.3), math.ceil(n * 0.8) + 1):
                found = plain.early_match(plain.normalised(v[:length]), None, cache, now, 0.6, least)
                if found and length >= n * 0.3:
                    early = (found[1], found[3], length)
                    break
            mine = got[r["series_id"]]
            if early:
                assert (mine["method"], mine["predicted_label"]) == ("early", early[0])
                assert mine["confidence"] == pytest.approx(early[1]) and mine["observation_ratio"] == pytest.approx(early[2] / n)
            else:
                votes = Counter(label for label, _ in walked(v, nodes, shapelets).values())
                assert (mine["method"], mine["predicted_label"]) == ("forest", min(votes.items(), key=lambda c: (-c[1], c[0]))[0])


def test_vote_ties_go_to_the_first_label(spark):
    rows = [(1, x, 1.0) for x in ("1", "10")] + [(2, x, 1.0) for x in ("ab", "a")] + [(3, x, 1.0) for x in ("10", "10", "1")]
    got = {r["series_id"]: (r["label"], r["votes"]) for r in forest.vote(spark.createDataFrame(rows, "series_id long, label string, confidence double")).collect()}
    assert got == {1: ("1", 1), 2: ("a", 1), 3: ("10", 2)}


def test_bootstrap_of_places_with_gaps(spark):
    rows = [(7 * k + 3, "ab"[k % 2]) for k in range(12)]
    drawn = forest.bootstrap(spark.createDataFrame(rows, "i long, label string"), 3)
    assert drawn.count() == 36 and drawn.where("i % 7 <> 3").count() == 0


def test_profile_edges(spark, tmp_path):
    rows = [("train", 1, "a", [1e9, 1e9 + 1, 1e9 + 2]), ("test", 2, None, [1.0]), ("test", 3, "b", [1.0, 3.0]), ("test", 4, "a", [])]
    df = spark.createDataFrame(rows, "split string, series_id long, label string, values array<double>")
    got = {r["split"]: r for r in profile.dataset_stats(df).collect()}
    assert got["train"]["std_value"] == pytest.approx(math.sqrt(2 / 3)) and got["test"]["class_distribution"] == {"a": 1, "b": 1}
    assert [r[0] for r in profile.unseen_labels(df).collect()] == ["b"]
    issues = profile.validate_series(df)
    assert profile.validation_status(issues).first()["status"] == "failed"
    assert profile.validation_status(issues.where("severity = 'warning'")).first()["status"] == "warnings"
    assert tuple(profile.validation_status(issues.limit(0)).first()) == ("passed", 0, 0)
    info = spark.read.json(src.write_dataset_info(df, str(tmp_path / "info")))
    assert {r["split"]: r["samples"] for r in info.collect()} == {"train": 1, "test": 3, "overall": 4}


def test_windows_count_as_lists_do():
    rng = np.random.default_rng(5)
    windows, labels = drift.LabelWindows(9), []
    for k in range(200):
        label = None if k % 11 == 0 else "abcd"[int(rng.integers(0, 2 + k // 70))]
        labels.append(label)
        windows.push(label)
        recent, history = ([x for x in part if x is not None] for part in (labels[-8:], labels[-17:-8]))
        assert windows.counts == (Counter(recent), Counter(history)) and windows.sizes == [len(recent), len(history)]
    assert drift.LabelWindows(9, windows.labels()).counts == windows.counts
    frame, seen = attention.AttentionFrame(5), []
    for k in range(40):
        seen.append(("ab"[k % 3 == 0], k / 40))
        frame.push(*seen[-1])
        assert {x: list(v) for x, v in frame.sims.items()} == {x: [s for y, s in seen[-5:] if y == x] for x in {x for x, _ in seen[-5:]}}


def test_decayed_frequency_equals_sums(spark):
    rows = [(k % 2, k, k, "ab"[k % 3 == 0]) for k in range(60)]
    got = {r["event_id"]: r["frequency"] for r in attention.decayed_frequency(spark.createDataFrame(rows, "stream_id long, ts long, event_id long, label string")).collect()}
    for stream in (0, 1):
        own = [(e, x) for s, _, e, x in rows if s == stream]
        for t, (e, x) in enumerate(own):
            assert got[e] == pytest.approx(sum(0.95 ** (t - u) for u, (_, y) in enumerate(own[: t + 1]) if y == x))


def test_streams_drop_late_rows_and_forget_silent_streams(spark, tmp_path):
    base = datetime(2024, 1, 1)
    parts = [
        [(1, base + timedelta(seconds=k), k, "a") for k in range(30)],
        [(1, base + timedelta(hours=5, seconds=k), 100 + k, "b") for k in range(30)],
        # a day late: dropped; then a stream that was silent for longer than is remembered
        [(1, base - timedelta(days=1), 200, "z"), (2, base + timedelta(days=3), 300, "a")],
        [(1, base + timedelta(days=3, hours=1, seconds=k), 400 + k, "a") for k in range(30)],
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "stream_id long, ts timestamp, event_id long, label string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = streams.drift_stream(streams.read_stream(spark, str(tmp_path / "in"), 1), w=10, least=5, forget=timedelta(days=1))
    got = {r["event_id"]: r for r in streams.run_to_end(live, str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    assert 200 not in got and len(got) == 91
    assert got[100]["magnitude"] > 0
    # nothing is held of the labels b, so the first rows have no history
    assert all(got[400 + k]["magnitude"] == 0 for k in range(9))


def test_co_training_keeps_versions_and_equals_its_steps(spark, model, synthetic, tmp_path):
    new = pairs.indexed(synthetic.where("split = 'test'").select(F.col("series_id").alias("id"), "label", F.slice("values", 3, 18).alias("values")))
    rows = new.select(F.lit(0).cast("long").alias("stream_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i")).alias("ts"), F.col("i").alias("event_id"), (F.col("i") + 1000).alias("i"), "label", "values")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    batches = [rows.where(F.col("event_id") < 6), rows.where(F.col("event_id") >= 6)]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = streams.CoTraining(str(tmp_path / "live"), model, AT, w=5, least=2)
    streams.run_batches(streams.read_stream(spark, str(tmp_path / "in"), 1), live, str(tmp_path / "cp"))
    got = [tuple(r) for r in live.log().orderBy("iteration").collect()]
    steps = streams.CoTraining(str(tmp_path / "steps"), model, AT, w=5, least=2)
    steps(batches[0], 0)
    steps(batches[1], 1)
    steps(batches[1], 1)  # a batch that comes again
    assert [tuple(r) for r in steps.log().orderBy("iteration").collect()] == got
    log = pd.DataFrame(got, columns=[c.split(" ")[0] for c in streams.LOG.split(", ")])
    assert list(log["iteration"]) == [1, 2] and list(log["rows"]) == [6, 6] and list(log["pool"]) == [6, 12]
    assert log["due"][0] and log["score"][0] == 0 and log["trees_updated"][0] == 4
    # scores of a version are those of its trees on the batch
    nodes, held = [r.asDict() for r in live.version("forest", 0).collect()], {r["i"]: list(r["values"]) for r in live.version("shapelets", 0).collect()}
    visits, right = Counter(), Counter()
    for r in batches[0].collect():
        for tree, (label, path) in walked(list(r["values"]), nodes, held).items():
            visits.update((tree, k) for k in path)
            right.update((tree, k) for k in path if label == r["label"])
    for r in live.version("scores", 0).collect():
        own = [right[n] / visits[n] for n in visits if n[0] == r["tree_id"]]
        assert r["score"] == pytest.approx(0.4 * sum(own) / len(own))
    # weak trees hold new shapelets only, the cache has grown by the chosen ones
    assert {n["shapelet_id"] for n in nodes if n["shapelet_id"] == n["shapelet_id"] and n["shapelet_id"] is not None} <= {r["i"] for r in batches[0].collect()}
    sizes = [live.version("cache", k).count() for k in (-1, 0, 1)]
    assert sizes == [model.cache.count(), sizes[0] + log["selected"][0], sizes[1] + log["selected"][1]] and list(log["cached"]) == sizes[1:]
