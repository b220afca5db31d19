"""Null keys, sparse ids, order statistics, greedy choice and range joins against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain
from tideglass.operators import extract, match, ordered, pairs, profile

SERIES = "split string, series_id long, label string, values array<double>"


def test_null_labels_and_ids_are_sampled(spark):
    rows = [("train", k if k % 10 else None, None if k % 3 == 0 else "b", [1.0 * k]) for k in range(60)]
    df = spark.createDataFrame(rows, SERIES)
    got = {r["label"]: r["count"] for r in profile.stratified_sample(df, 30).groupBy("label").count().collect()}
    assert got == {None: 10, "b": 20}
    three = spark.createDataFrame([("train", i, "a", [1.0]) for i in (None, 1, 2)], SERIES)
    assert profile.every_nth_series(three, 3).count() == 3
    parts = profile.split_series(df.drop("split"), 0.5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 30, "test": 30}
    placed = profile.ordinal(three, ["series_id"], F.floor(F.col("series_id") / 4096)).orderBy("ordinal").collect()
    assert [(r["series_id"], r["ordinal"]) for r in placed] == [(None, 0), (1, 1), (2, 2)]


def test_candidates_of_sparse_and_null_ids(spark):
    rng = np.random.default_rng(0)
    ids = [None, 5, 10**15, 2 * 10**15, 3 * 10**15]
    df = spark.createDataFrame([("train", i, "a", [float(x) for x in rng.normal(size=20)]) for i in ids], SERIES)
    every = extract.subsequence_candidates(df, 5, 6, most=None)
    per = every.groupBy("series_id").count().first()["count"]
    for most in (0, per - 1, per, 3 * per):
        got = [r[0] for r in extract.subsequence_candidates(df, 5, 6, most=most).select("series_id").distinct().collect()]
        assert len(got) == most // per + 1 and set(got) == set(ids[: most // per + 1])


def test_sums_before(spark):
    rows = [(None if k == 0 else k * 10**12, k % 7) for k in range(100)]
    got = ordered.sums_before(spark.createDataFrame(random.Random(1).sample(rows, 100), "id long, n long"), "id", "n", "before").collect()
    assert {r["id"]: r["before"] for r in got} == {i: sum(n for _, n in rows[:k]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0] * 500 + [4.0], [float(k % 83) ** 3 for k in range(3000)], [1e308, -1e308, 0.0, 5e-324] * 50, [1e9 + k * 1e-6 for k in range(999)]])
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(x,) for x in [*values, None, math.nan]], "x double").repartition(3)
    points = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = ordered.quantiles(df, "x", points, few=20, bins=16)
    rank = sorted(values)
    want = [rank[int(p * (len(rank) - 1))] + (p * (len(rank) - 1) - int(p * (len(rank) - 1))) * (rank[min(len(rank) - 1, int(p * (len(rank) - 1)) + 1)] - rank[int(p * (len(rank) - 1))]) for p in points]
    assert got == pytest.approx(want)
    assert ordered.quantiles(df.where("x > 1e308"), "x", [0.5]) == [None]


def test_pair_distribution_has_quartiles(spark):
    cells = spark.createDataFrame([(0, k, v) for k, v in enumerate([0.1, 0.2, 0.4, 0.9, 0.0, -1.0])], "i long, j long, value double")
    row = pairs.pair_distribution(cells, 4).first()
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx((0.175, 0.3, 0.525))
    assert pairs.pair_distribution(cells.limit(0)).count() == 0 and pairs.pair_stats(cells.limit(0)).first()["median"] is None


def greedy(rows, k, against):
    chosen = []
    for r in sorted(rows, key=lambda r: (-round(r[2], 9), r[1])):
        if len(chosen) < k and not any(1 / (1 + plain.distance(r[3], c[3])) > 0.95 for c in chosen[:against]):
            chosen.append(r)
    return [r[1] for r in chosen]


@pytest.mark.parametrize(("k", "against", "pool"), [(12, 5, 7), (40, 6, 4), (3, 5, 2), (500, 50, 2000)])
def test_diverse_top_equals_the_greedy_loop(spark, k, against, pool):
    rnd = random.Random(3)
    bases = [[rnd.gauss(0, 0.02) for _ in range(rnd.choice([4, 4, 5]))] for _ in range(4)]
    rows = []
    for n in range(130):
        base = rnd.choice(bases)
        values = [x + rnd.gauss(0, 0.002) for x in base] if rnd.random() < 0.7 else [rnd.gauss(0, 1) for _ in base]
        rows.append((rnd.choice([None, "a", "b"]), f"c{n}", round(rnd.random(), 2), values))
    df = spark.createDataFrame(rows, "label string, candidate_id string, info_gain double, values array<double>")
    got = {}
    for r in extract.diverse_top(df, ["label"], k, against, pool=pool).orderBy("place").collect():
        got.setdefault(r["label"], []).append(r["candidate_id"])
    assert got == {x: greedy([r for r in rows if r[0] == x], k, against) for x in (None, "a", "b")}


def test_length_candidates_equal_a_loop(spark):
    rng = random.Random(5)
    tiers = spark.createDataFrame([(k, rng.choice(["a", None]), rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 40, 64, 1000, 10_000, 13_000]), rng.choice(["label", "recent", "quality", "ring"])) for k in range(200)], "shapelet_id long, label string, length int, tier string")
    queries = spark.createDataFrame([(s, n, a) for s, n in enumerate([0, 1, 2, 5, 10, 12, 13, 20, 23, 24, 64, 1000, 9999, 10_000]) for a in ("a", None)], "series_id long, length int, asked_label string")
    got = sorted((r["series_id"], r["asked_label"] or "", r["c_shapelet_id"]) for r in match.length_candidates(queries, tiers).collect())
    held = [r for r in tiers.collect() if r["tier"] != "ring"]
    want = sorted((q["series_id"], q["asked_label"] or "", t["shapelet_id"]) for q in queries.collect() for t in held if math.floor(q["length"] * 0.7) <= t["length"] <= math.floor(q["length"] * 1.3) and (t["tier"] != "label" or t["label"] is not None and t["label"] == q["asked_label"]))
    assert got == want


def test_totals_are_told_from_null_keys(spark):
    rows = [(None, "a", "a", 0.5, 0.2, True), ("x", "a", "b", 0.5, 0.2, False)]
    got = match.evaluate(spark.createDataFrame(rows, "key string, label string, predicted_label string, confidence double, earliness double, early boolean"), ["key"])
    assert sorted((r["level"], str(r["key"]), r["accuracy"]) for r in got.collect()) == [(0, "None", 1.0), (0, "x", 0.0), (1, "None", 0.5)]
