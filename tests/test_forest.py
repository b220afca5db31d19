"""Trees that grow level by level, walks over arrays, and leaves without rows."""

import numpy as np
from pyspark.sql import functions as F

from tideglass.operators import forest

SCHEMA = "i long, label string, values array<double>"


def shapelets(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        kind = "abc"[k % 3]
        x = np.linspace(0, 3, int(rng.integers(5, 9)))
        rows.append((1000 - 3 * k, kind, [float(v) for v in {"a": np.sin(x), "b": np.cos(x), "c": x}[kind] + rng.normal(0, 0.3, len(x))]))
    return spark.createDataFrame(rows, SCHEMA)


def nodes(df):
    return sorted((tuple(None if v != v else v for v in r) for r in df.collect()), key=lambda r: r[:2])


def test_levels_give_the_trees_of_one_task(spark, monkeypatch):
    held = shapelets(spark)
    want = nodes(forest.train_forest(held, 4))
    monkeypatch.setattr(forest, "MOST_SHAPELETS", 100)
    assert nodes(forest.train_forest(held, 4)) == want and max(r[4] for r in want) > 2
    assert {r[0] for r in nodes(forest.train_forest(held, 2, tree_ids=[7, 3]))} == {3, 7}


def test_more_shapelets_than_a_task_takes(spark):
    held = shapelets(spark, 450)
    grown = forest.train_forest(held, 2)
    roots = grown.where("parent_id = -1").collect()
    assert [r["n"] for r in roots] == [450, 450]
    walks = forest.predict_trees(held.withColumnRenamed("i", "series_id"), grown, held)
    right = walks.join(held.select(F.col("i").alias("series_id"), F.col("label").alias("truth")), "series_id").agg(F.avg((F.col("label") == F.col("truth")).cast("int"))).first()[0]
    assert right > 0.6


def test_walks_of_an_empty_forest_and_of_no_series(spark):
    held = shapelets(spark, 30)
    grown = forest.train_forest(held, 2)
    assert forest.predict_trees(held.limit(0).withColumnRenamed("i", "series_id"), grown, held).count() == 0
    assert forest.predict_trees(held.withColumnRenamed("i", "series_id"), grown.limit(0), held).count() == 0
    # a shapelet that is not there is as like as not: 0.5
    alone = forest.predict_trees(held.withColumnRenamed("i", "series_id"), grown, held.limit(0)).collect()
    assert len(alone) == 60 and len({tuple(r["path"]) for r in alone}) <= 2


def test_leaves_without_rows_have_their_own_label(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (None, "c")], "leaf int, label string")
    leaves = spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "leaf int, label string")
    got = sorted(map(tuple, forest.leaf_class_probabilities(rows, leaves).collect()), key=str)
    assert got == sorted([(1, "a", 0.5), (1, "b", 0.25), (1, None, 0.25), (None, "c", 1.0), (2, "b", 1.0)], key=str)
