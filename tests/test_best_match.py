"""Candidates that come to the queries: nothing with values is shuffled, and results are those of plain loops."""

import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain
from tideglass.functions import kernels
from tideglass.jobs import match_queries
from tideglass.operators import match

DATA = "/root/testdata/sf0.001"
NOW = datetime.fromisoformat(match_queries.AS_OF)


def exchanges(df):
    """The shuffles of a plan, as it will run first."""
    return [x for x in re.findall(r"(\w*Exchange) (.*)", df._jdf.queryExecution().executedPlan().toString()) if x[0] != "BroadcastExchange"]


def test_queries_stay_where_they_are(spark):
    best = match.best_match(match_queries._queries(spark, DATA), match.cache_tiers(match_queries._cache(spark, DATA)), match_queries.AS_OF)
    assert exchanges(best) == [] and best.count() > 2000


def test_early_decisions_measure_once_and_shuffle_decisions_only(spark):
    found = match.early_decision(match_queries._queries(spark, DATA), match_queries._cache(spark, DATA), match_queries.AS_OF, 0.3, 0.3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    # one shuffle, of what each task has decided
    assert len(exchanges(found)) == 1 and "hashpartitioning(series_id" in exchanges(found)[0][1]
    assert re.search(r"partial_min", plan) and found.count() == 100


def test_early_matches_measure_once_and_shuffle_nothing(spark):
    found = match.early_match(match_queries._queries(spark, DATA), match_queries._cache(spark, DATA), match_queries.AS_OF, 0.3, 0.3)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and exchanges(found) == []


def test_evaluated_decisions_shuffle_no_values(spark):
    found = match_queries._predictions(spark, DATA)
    assert all("hashpartitioning(series_id" in x[1] for x in exchanges(found)) and len(exchanges(found)) <= 2
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def _odd(spark):
    """Queries of null, known and unknown labels, with repeated ids, and cache rows that repeat."""
    rng = np.random.default_rng(3)
    held = [r.asDict() for r in match_queries._cache(spark, DATA).where("shapelet_id < 60").collect()]
    held += [{**held[0], "shapelet_id": 1000}, {**held[1], "shapelet_id": 1001}]
    asked = [(k // 2, int(n), [None, "3", "none", "7"][k % 4], [float(x) for x in rng.normal(size=n).round(2)]) for k, n in enumerate(rng.integers(15, 70, 60))]
    asked.append((None, len(held[1]["values"]), held[1]["label"], held[1]["values"]))
    asked.append((99, 30, None, [float("nan"), *[1.0] * 29]))
    return held, asked


@pytest.mark.parametrize("sent", [match.MOST_SENT, 0])
def test_odd_queries_equal_plain_loops(spark, monkeypatch, sent):
    monkeypatch.setattr(match, "MOST_SENT", sent)
    held, asked = _odd(spark)
    cache = spark.createDataFrame(held, match_queries._cache(spark, DATA).schema)
    queries = spark.createDataFrame(asked, "series_id long, length int, asked_label string, values array<double>")
    if not sent:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = match.early_match(queries, cache, match_queries.AS_OF, 0.0, 0.0)
        rows = [tuple(r) for r in got.select("series_id", "length", "c_shapelet_id", F.round("sim", 9), F.round("match_confidence", 9)).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for series_id, n, label, values in asked[:-1]:
        found = plain.early_match(values, label, held, NOW, 0.0, 0.0)
        if found:
            want.append((series_id, n, found[0], round(found[2], 9), round(found[3], 9)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r for r in rows if r[0] != 99), key=key) == sorted(want, key=key) and len(want) > 40
    # a similarity that is no number is 0
    assert [r[3] for r in rows if r[0] == 99] == [0.0]


def test_most_similar_pairs_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(7)
    for trial in range(12):
        monkeypatch.setattr(kernels, "POINTS", [400, 1_000_000][trial % 2])
        monkeypatch.setattr(kernels, "DENSE", [1 << 14, 200][trial % 3 == 0])
        sides = [[rng.normal(size=int(n)).round(1) for n in rng.integers(trial % 2 * 3, 40, 25)] for _ in range(2)]
        sides[1][3] = sides[1][7] = -sides[0][2]
        owner = np.sort(rng.integers(0, 25, 120))
        other = rng.integers(0, 25, 120)
        flat = [(np.concatenate([*x, [0.0]]), np.cumsum([0, *map(len, x)])[:-1], np.array([*map(len, x)])) for x in sides]
        pairs = [(v, s[k], n[k]) for (v, s, n), k in zip(flat, (owner, other), strict=True)]
        sims = [round(float(kernels.multi_metric(sides[0][i][None], sides[1][j][None])[0]), 9) for i, j in zip(owner, other, strict=True)]
        want = {}
        for k, i in enumerate(owner.tolist()):
            if i not in want or sims[k] > want[i][1]:
                want[i] = (k, sims[k])
        got = {i: (k, round(s, 9)) for i, k, s in zip(*(x.tolist() for x in kernels.most_similar(*pairs, owner)), strict=True)}
        assert got == want
        good = {i: (k, round(s, 9)) for i, k, s in zip(*(x.tolist() for x in kernels.most_similar(*pairs, owner, 0.5)), strict=True) if s >= 0.5}
        assert good == {i: w for i, w in want.items() if w[1] >= 0.5}
