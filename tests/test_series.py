"""Sources, sampling, drift, forest and matching on small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.jobs import forest_queries, registry
from tideglass.operators import drift, extract, forest, match, pairs, profile
from tideglass.sources import series as src
from tideglass.streaming import streams


@pytest.fixture(scope="module")
def synthetic(spark):
    return src.synthetic_series(spark, 60, 60, 0.1, seed=3).withColumn("split", F.when(F.col("series_id") % 5 == 0, "test").otherwise("train"))


def test_synthetic_without_noise(spark):
    rows = {r["label"]: r["values"] for r in src.synthetic_series(spark, 3, 5, 0).collect()}
    assert rows["class_A"] == pytest.approx(np.sin(np.linspace(0, 4 * np.pi, 5)), abs=1e-12)
    assert rows["class_B"] == pytest.approx(np.cos(np.linspace(0, 4 * np.pi, 5)))
    assert rows["class_C"] == pytest.approx(np.linspace(0, 1, 5))


def test_files(spark, tmp_path):
    (tmp_path / "Set").mkdir()
    (tmp_path / "Set" / "Set_TRAIN.tsv").write_text("a\t1\t2\nb\t3\tx\n")
    with pytest.raises(FileNotFoundError):
        src.read_labelled_series(spark, str(tmp_path), "Set")
    (tmp_path / "Set" / "Set_test.csv").write_text("a,5\n")
    rows = {(r["split"], r["label"]): r["values"] for r in src.read_labelled_series(spark, str(tmp_path), "Set").collect()}
    assert rows == {("train", "a"): [1.0, 2.0], ("train", "b"): [3.0, None], ("test", "a"): [5.0]}
    assert src.read_or_synthesise(spark, str(tmp_path), "None", n=6, length=10).count() > 6
    with pytest.raises(FileNotFoundError):
        src.read_or_synthesise(spark, str(tmp_path), "None", use_synthetic=False)
    with pytest.raises(ValueError):
        src.write_rows(spark.range(1), str(tmp_path / "x"), "npz")


def test_snapshots(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 0.5)], "i long, j long, value double")
    for k in (0, 3):
        src.write_snapshot(cells, str(tmp_path / "s"), k, "init", {"k": str(k)})
    assert [r[0] for r in src.list_snapshots(spark, str(tmp_path / "s")).collect()] == [0, 3]
    assert src.read_snapshot(spark, str(tmp_path / "s"), 1) is None


def test_exact_split(synthetic):
    assert profile.split_series(synthetic).where("split = 'train'").count() == 48


def test_drift_finds_a_planted_shift(spark):
    rows = [(0, 1_700_000_000 + k, k, "a" if k < 250 or k % 2 else "b") for k in range(500)]
    df = spark.createDataFrame(rows, "stream_id long, s long, event_id long, label string").select("stream_id", F.timestamp_seconds("s").alias("ts"), "event_id", "label")
    found = {r["event_id"]: r for r in drift.label_drift(df, threshold=0.25).collect()}
    assert not found[240]["changed"] and found[330]["changed"] and found[330]["kind"] == "new_classes:b"
    assert found[100]["kind"] == "insufficient_data" and found[100]["magnitude"] == 0
    assert not found[499]["changed"] and 0 <= found[330]["magnitude"] <= 1


def test_extraction_and_forest_label_the_synthetic_classes(spark, synthetic):
    train, test = synthetic.where("split = 'train'"), synthetic.where("split = 'test'")
    shapelets = extract.extract_shapelets(train, 20, 20)
    assert 0 < shapelets.count() <= 200
    whole = pairs.indexed(train.select(F.col("series_id").alias("id"), "label", "values"))
    nodes = forest.train_forest(whole, 10)
    assert nodes.where("label is null and threshold is null").count() == 0
    votes = forest.vote(forest.predict_trees(test, nodes, whole)).join(test.select("series_id", F.col("label").alias("truth")), "series_id")
    assert votes.select(F.avg((F.col("label") == F.col("truth")).cast("double"))).first()[0] >= 0.6
    assert votes.where("confidence < 0 or confidence > 1").count() == 0


def test_diverse_top_is_diverse(spark):
    rows = [(f"c{k}", 1.0 - k / 100, [float(k // 2), 0.0]) for k in range(20)]
    df = spark.createDataFrame(rows, "candidate_id string, info_gain double, values array<double>").withColumn("all", F.lit(1))
    assert sorted(r[0] for r in extract.diverse_top(df, ["all"]).select("candidate_id").collect()) == sorted(f"c{k}" for k in range(0, 20, 2))


def test_diverse_top_goes_down_the_whole_ranking(spark):
    rows = [(key, f"{key}{k:02}", 1.0 - k / 100, [float(k // 8 if key == "a" else k), 0.0]) for key in "ab" for k in range(24)]
    df = spark.createDataFrame(rows, "label string, candidate_id string, info_gain double, values array<double>")
    got = sorted(r[0] for r in extract.diverse_top(df, ["label"], k=3, pool=4).select("candidate_id").collect())
    assert got == ["a00", "a08", "a16", "b00", "b01", "b02"]
    assert extract.diverse_top(df.limit(0), ["label"]).count() == 0


def test_extraction_queries_take_all_lengths(spark):
    found = registry.QUERIES["extract_shapelets"](spark, "/root/testdata/sf0.001")
    assert 0 < found.count() <= 200
    assert found.where("length NOT IN (16, 17)").count() > 0


def test_forest_refuses_too_many_shapelets_and_learns_from_extracted_ones(spark):
    rows = [(k, "ab"[k % 2], [float(k), 0.0]) for k in range(forest.MOST_SHAPELETS + 1)]
    with pytest.raises(ValueError):
        forest.train_forest(spark.createDataFrame(rows, "i long, label string, values array<double>"), 2)
    shapelets = forest_queries._trained(spark, "/root/testdata/sf0.001").shapelets
    assert 0 < shapelets.where("size(values) BETWEEN 6 AND 32").count() == shapelets.count() <= forest.MOST_SHAPELETS


def test_ranking_is_numbered_in_ranges_of_scores(spark):
    scores = [0.5, None, float("nan"), -1.0, 0.5, 0.75, 3.0, 0.0, 0.1234, 0.1233]
    df = spark.createDataFrame([(k, k + 1, s) for k, s in enumerate(scores)], "i long, j long, score double")
    got = pairs.ranked(df)
    assert [r["i"] for r in got.orderBy("rank").collect()] == [2, 6, 5, 0, 4, 8, 9, 7, 3, 1]
    assert got.schema["rank"].dataType.simpleString() == "int"
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(_bucket" in plan and "row_number() windowspecdefinition(round" not in plan


def test_vote_edges(spark):
    rows = [(1, "b", 0.5), (1, "a", 1.0), (2, None, None)]
    got = {r["series_id"]: r for r in forest.vote(spark.createDataFrame(rows, "series_id long, label string, confidence double")).collect()}
    assert got[1]["label"] == "a" and got[1]["votes"] == 1 and got[1]["confidence"] == pytest.approx(0.7 * 0.75 + 0.15)
    assert got[2]["label"] is None and got[2]["confidence"] == 0 and got[2]["votes"] == 0


def test_retraining_without_new_rows_keeps_the_forest(spark, synthetic):
    whole = pairs.indexed(synthetic.select(F.col("series_id").alias("id"), "label", "values"))
    nodes = forest.train_forest(whole, 2)
    scores = spark.createDataFrame([(0, 0.1), (1, 0.9)], "tree_id int, score double")
    assert forest.retrain_weak_trees(nodes, scores, whole.limit(0)).count() == nodes.count()
    again = forest.retrain_weak_trees(nodes, scores, whole)
    assert {r[0] for r in again.select("tree_id").distinct().collect()} == {0, 1}


def test_prefixes_of_64_points(spark):
    df = spark.createDataFrame([(1, [float(k) for k in range(64)])], "series_id long, values array<double>")
    lengths = sorted(r[0] for r in match.prefixes(df).select("length").collect())
    assert lengths == list(range(20, 53))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "series_id long, label string, split string, values array<double>")
    assert extract.extract_shapelets(none).count() == 0
    assert profile.dataset_stats(none).count() == 0
    assert profile.every_nth_series(none).count() == 0
    assert pairs.upper_pairs(spark.createDataFrame([], "i long, label string, values array<double>")).count() == 0


def test_streams_over_several_files_equal_the_batch(spark, tmp_path):
    rows = [(k % 3, 1_700_000_000 + k, k, "abc"[(k * k) % 3], (k % 10) / 10) for k in range(900)]
    df = spark.createDataFrame(rows, "stream_id long, s long, event_id long, label string, sim double").select("stream_id", F.timestamp_seconds("s").alias("ts"), "event_id", "label", "sim")
    for part in range(3):
        df.where((F.col("event_id") >= part * 300) & (F.col("event_id") < part * 300 + 300)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = streams.drift_stream(streams.read_stream(spark, str(tmp_path / "in"), 1))
    got = streams.run_to_end(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = streams.run_to_end(live, str(tmp_path / "out"), str(tmp_path / "cp"))  # a restart adds nothing
    want = drift.label_drift(df)
    a = sorted((r["event_id"], r["changed"], round(r["magnitude"], 6)) for r in got.collect())
    b = sorted((r["event_id"], r["changed"], round(r["magnitude"], 6)) for r in want.collect())
    assert a == b


def test_stream_early_classify_equals_classify(spark):
    want = sorted(map(tuple, registry.QUERIES["classify"](spark, "/root/testdata/sf0.001").select("series_id", "predicted_label", "confidence", "method", "earliness", "observation_ratio").collect()))
    got = sorted(map(tuple, registry.QUERIES["stream_early_classify"](spark, "/root/testdata/sf0.001").select("series_id", "predicted_label", "confidence", "method", "earliness", "observation_ratio").collect()))
    assert got == want and {r[3] for r in got} == {"early", "forest"}


def test_tables_are_removed_and_clusters_need_a_folder(spark, tmp_path):
    import os

    from tideglass import shared

    root = shared.shared_root(spark).removeprefix("file:")
    table = shared.materialise(spark.range(3), "some")
    other = shared.materialise(spark.range(4), "other")
    shared.discard(table, spark.range(2))
    assert other.count() == 4 and not os.path.exists(table._written_to) and other._written_to.startswith(root)
    shared.discard_all(spark)
    assert not os.path.exists(other._written_to)
    before = spark.conf.get("spark.checkpoint.dir")
    held = type("Held", (), {"conf": type("Conf", (), {"get": staticmethod(lambda k, d=None: {"spark.master": "local-cluster[2,1,1024]"}.get(k, ""))})})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_root(held)
    assert spark.conf.get("spark.checkpoint.dir") == before
