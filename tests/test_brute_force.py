"""Queries without a twin against loops over their own tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain
from tideglass.functions import kernels
from tideglass.jobs import extract_queries, forest_queries, registry
from tideglass.jobs.base import series
from tideglass.operators import classify, extract, forest, profile

DATA = "/root/testdata/sf0.001"


def greedy(rows, k=200, against=50):
    """Ids of (id, gain, values) chosen down the ranking."""
    chosen = []
    for i, _, values in sorted(rows, key=lambda r: (-round(r[1], 9), r[0])):
        x = np.asarray(values, float)
        if len(chosen) < k and not any(1 / (1 + kernels.distance(x, y)) > 0.95 for _, y in chosen[:against]):
            chosen.append((i, x))
    return [i for i, _ in chosen]


@pytest.fixture(scope="module")
def informative(spark):
    """The informative candidates of the train series, by operators that have twins."""
    train, found = extract_queries._train(spark, DATA), extract_queries._candidates(spark, DATA)
    gains = extract.candidate_info_gain(extract.min_distances(found, profile.stratified_sample(train))).where("info_gain > 0.01")
    return [tuple(r) for r in gains.join(found, "candidate_id").select("label", "candidate_id", "info_gain", "values").collect()]


def test_diverse_top_of_the_given_table(spark, informative):
    got = {}
    for r in registry.QUERIES["diverse_top"](spark, DATA).collect():
        got.setdefault(r["label"], []).append(r["candidate_id"])
    labels = {r[0] for r in informative}
    assert got.keys() == labels
    # two of the ten labels: the loop is slow
    for x in sorted(labels)[:2]:
        assert sorted(got[x]) == sorted(greedy([r[1:] for r in informative if r[0] == x]))


def test_extracted_shapelets_of_the_given_table(spark, informative):
    got = [r["candidate_id"] for r in extract.extract_shapelets(extract_queries._train(spark, DATA)).select("candidate_id").collect()]
    assert sorted(got) == sorted(greedy([r[1:] for r in informative])) and len(got) == 200


def test_forest_and_weak_trees_of_the_given_table(spark):
    model = forest_queries._trained(spark, DATA)
    new = classify.train(series(spark, DATA).where("split = 'test'"), forest_queries.TRAINED_AT, 1).shapelets
    clean = lambda x: None if x is None or x != x else x
    nodes = lambda df: sorted((n["tree_id"], n["node_id"], n["parent_id"], n["side"], clean(n["shapelet_id"]), clean(n["threshold"]), n["label"]) for n in df.collect())

    def by_loops(shapelets, drawn):
        held = {r["i"]: (r["label"], np.asarray(r["values"], float)) for r in shapelets.collect()}
        return plain.grown(drawn, held, kernels.distance)

    def drawn(shapelets, trees, seed, names):
        out = {}
        for r in forest.bootstrap(shapelets, trees, seed).orderBy("place").collect():
            out.setdefault(names[r["tree_id"]], []).append(r["i"])
        return out

    first = by_loops(model.shapelets, drawn(model.shapelets, forest_queries.TREES, 42, range(forest_queries.TREES)))
    assert nodes(model.nodes) == [tuple(n) for n in first]
    scores = spark.createDataFrame([(t, 0.1 if t % 3 == 0 else 0.9) for t in range(forest_queries.TREES)], "tree_id int, score double")
    weak = [t for t in range(forest_queries.TREES) if t % 3 == 0]
    again = by_loops(new, drawn(new, len(weak), 43, weak))
    want = sorted([n for n in first if n[0] not in weak] + again, key=lambda n: n[:2])
    assert nodes(forest.retrain_weak_trees(model.nodes, scores, new, 0.4)) == want
    assert model.nodes.where(F.col("label").isNull()).count() > 0
