"""Kernels and scalar functions against direct loops, with edge inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.functions import kernels, scalars


def _direct(shapelet, series):
    best = []
    for k in range(len(series) - len(shapelet) + 1):
        w = series[k : k + len(shapelet)]
        if w.std() > 0:
            best.append(np.linalg.norm(shapelet - (w - w.mean()) / w.std()))
    return min(best) if best else 0.0


def test_znorm_min_dist_equals_loops():
    rng = np.random.default_rng(0)
    series = rng.normal(size=60)
    shapelets = rng.normal(size=(7, 9))
    shapelets = (shapelets - shapelets.mean(1, keepdims=True)) / shapelets.std(1, keepdims=True)
    assert np.allclose(kernels.znorm_min_dist(shapelets, series), [_direct(s, series) for s in shapelets])
    own = (series[5:14] - series[5:14].mean()) / series[5:14].std()
    assert kernels.znorm_min_dist(own[None], series)[0] < 1e-7


def test_znorm_min_dist_edges():
    x = np.array([[1.0, -1.0, 0.0]])
    assert kernels.znorm_min_dist(x, np.zeros(2))[0] == math.inf
    assert kernels.znorm_min_dist(x, np.ones(9))[0] == 0.0
    assert kernels.znorm_min_dist(x, np.ones(9), "strided")[0] == 10.0
    assert list(kernels.strided_starts(300, 20, "strided")[:2]) == [0, 14]
    assert list(kernels.strided_starts(120, 20, "strided")[:2]) == [0, 5]


def test_dtw():
    assert kernels.dtw(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3])) == 0
    assert kernels.dtw(np.array([]), np.array([1.0])) == math.inf
    a, b = np.array([0.0, 1, 2]), np.array([2.0, 4, 1, 3])
    assert kernels.dtw(a, b, 1) >= kernels.dtw(a, b)


def test_pair_distances_are_symmetric():
    x = np.random.default_rng(1).normal(size=(5, 8))
    d = kernels.pair_distances(x, x)
    assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0)


def test_scalar_edges(spark):
    rows = [(1, [3.0, 3.0, 3.0]), (2, []), (3, None), (4, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: r for r in df.select("id", scalars.z_normalise(F.col("v")).alias("z"), scalars.min_max_normalise(F.col("v")).alias("m"), scalars.prefix_normalise(F.col("v")).alias("p")).collect()}
    assert got[1]["z"] == [0.0] * 3 and got[1]["m"] == [0.0] * 3 and got[1]["p"] == [0.0] * 3
    assert got[2]["z"] == [] and got[2]["p"] == []
    assert got[3]["z"] is None
    assert got[4]["m"] == [0.0, 0.5, 1.0]
    a, b = F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(5.0))
    one = spark.range(1).select(scalars.pearson01_prefix(a, b).alias("r"), scalars.cosine_prefix(F.array(F.lit(0.0), F.lit(0.0)), b).alias("c"), scalars.minkowski(a, F.array(F.lit(1.0)), 1).alias("d")).first()
    assert one["r"] == 0 and one["c"] == 0 and one["d"] == math.inf


@pytest.mark.parametrize("counts, expected", [([1, 1], 1.0), ([4], 0.0), ([], 0.0)])
def test_entropy(spark, counts, expected):
    c = F.array(*[F.lit(x) for x in counts]) if counts else F.array().cast("array<int>")
    assert spark.range(1).select(scalars.entropy_of_counts(c)).first()[0] == pytest.approx(expected)


def test_warping_in_windows_equals_warping_in_tables(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, m, radius = int(rng.integers(1, 60)), int(rng.integers(1, 60)), int(rng.integers(1, 4))
        a, b = rng.integers(-2, 3, (5, n)).astype(float), rng.integers(-2, 3, (5, m)).astype(float)
        want = kernels.warped(a, b, radius), kernels.warped(a, b, None)
        monkeypatch.setattr(kernels, "DENSE", 0)
        assert kernels.warped(a, b, radius) == pytest.approx(want[0]) and kernels.warped(a, b, None) == pytest.approx(want[1])
        monkeypatch.undo()


def test_warping_long_series_takes_linear_memory():
    import tracemalloc

    x = np.sin(np.linspace(0, 60, 5_000))
    y = np.sin(np.linspace(0.5, 60.5, 4_801))
    tracemalloc.start()
    d = kernels.dtw(x, y, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a table would take 190 MB
    assert 0 < d < 5000 and peak < 20 << 20
