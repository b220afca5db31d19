"""Pair tables and rankings of the series of ``embeddings``, at most 2000 as the matrix allows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.jobs.base import SERIES, query, r, rounded, series, values_of
from tideglass.jobs.scalar_queries import sim
from tideglass.operators import pairs
from tideglass.shared import materialise, shared_root
from tideglass.sources import series as src


def _shapelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(pairs.indexed(series(spark, sf_dir).withColumnRenamed("series_id", "id")), "shapelets")


def _first(shapelets: DataFrame):
    return values_of(shapelets.withColumnRenamed("i", "series_id"), 0)


#: h: shapelets by place; u: similarities above the diagonal; c: the cells that a new matrix fills.
_H = f"{SERIES}, h AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY series_id) - 1 AS i FROM s ORDER BY series_id LIMIT 2000)"
_U = _H + f", u AS MATERIALIZED (SELECT a.i, b.i AS j, {sim('a.v', 'b.v')} AS value FROM h a JOIN h b ON a.i < b.i)"
_CELLS = "c AS MATERIALIZED (SELECT i, i AS j, CAST(0 AS DOUBLE) AS value FROM h UNION ALL SELECT 0, j, 1 / (1 + (1 - value)) FROM u WHERE i = 0 UNION ALL SELECT j, 0, value FROM u WHERE i = 0)"
_BOTH = "b AS (SELECT i, j, value FROM u UNION ALL SELECT j, i, value FROM u)"
_RANK = f"{_U}, {_CELLS}, {_BOTH}, k AS (SELECT i, j, CASE WHEN c.value >= 0 THEN c.value ELSE 1 / (1 + (1 - b.value)) END AS score FROM b LEFT JOIN c USING (i, j)), k2 AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, i, j) AS rank FROM k)"


@query(f"WITH {_H} SELECT series_id AS id, i FROM h")
def cap_shapelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapelets(spark, sf_dir).select("id", "i")


@query(f"WITH {_U}, {_BOTH} SELECT i, j, {r('value')} AS value FROM b UNION ALL SELECT i, i, 1 FROM h")
def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.pairwise_similarity(_shapelets(spark, sf_dir)))


@query(f"WITH {_H}, x AS (SELECT b.i, {sim('a.v', 'b.v')} AS sim FROM h a JOIN h b ON a.i = 0) SELECT row_number() OVER (ORDER BY round(sim, 9) DESC, i)::INTEGER AS rank, i, {r('sim')} AS sim FROM x")
def rank_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _shapelets(spark, sf_dir)
    return rounded(pairs.rank_by_similarity(_first(h), h))


def _cells(h: DataFrame) -> DataFrame:
    return pairs.init_pairs(h, _first(h))


@query(f"WITH {_U}, {_CELLS} SELECT i, j, {r('value')} AS value FROM c")
def init_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(_shapelets(spark, sf_dir)))


@query(f"WITH {_RANK} SELECT i, j, {r('score')} AS score FROM k2")
def build_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ordered pairs; ranks of near-equal scores depend on the last digits and are left out."""
    h = _shapelets(spark, sf_dir)
    return rounded(pairs.build_ranking(pairs.upper_pairs(h), _cells(h)).drop("rank"))


@query(f"WITH {_RANK} SELECT max(rank) AS ranks, {r('sum(score)', 3)} AS total FROM k2")
def rebuild_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and ranking made anew from the shapelets: the last rank and the sum of the scores."""
    h = _shapelets(spark, sf_dir)
    return rounded(pairs.build_ranking(pairs.upper_pairs(h), _cells(h)).agg(F.max("rank").cast("long").alias("ranks"), F.sum("score").alias("total")), 3)


#: Every fifth shapelet comes later: places of the others first, then theirs.
_NEW = f"{SERIES}, h AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY split = 'test', series_id) - 1 AS i FROM (SELECT * FROM s ORDER BY series_id LIMIT 2000)), u AS MATERIALIZED (SELECT a.i, b.i AS j, b.split, {sim('a.v', 'b.v')} AS value FROM h a JOIN h b ON a.i < b.i)"
_OLD_CELLS = "o AS (SELECT i, i AS j, CAST(0 AS DOUBLE) AS value FROM h WHERE split = 'train' UNION ALL SELECT 0, j, 1 / (1 + (1 - value)) FROM u WHERE i = 0 AND split = 'train' UNION ALL SELECT j, 0, value FROM u WHERE i = 0 AND split = 'train')"
_ADDED = f"{_NEW}, {_OLD_CELLS}, a AS (SELECT * FROM o UNION ALL SELECT i, j, CASE WHEN i = 0 THEN 1 / (1 + (1 - value)) ELSE value END FROM u WHERE split = 'test' UNION ALL SELECT j, i, value FROM u WHERE split = 'test' UNION ALL SELECT i, i, 0 FROM h WHERE split = 'test')"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    h = _shapelets(spark, sf_dir).drop("i").withColumn("i", (F.row_number().over(Window.orderBy(F.col("split") == "test", "id")) - 1).cast("long"))
    h = materialise(h, "shapelets_old_new")
    return h, h.where("split = 'train'"), h.where("split = 'test'")


@query(f"WITH {_ADDED} SELECT i, j, {r('value')} AS value FROM a")
def add_shapelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, old, new = _old_new(spark, sf_dir)
    return rounded(pairs.add_shapelets(_cells(old), old, new, _first(h)))


@query(f"WITH {_ADDED}, k AS (SELECT u.i, u.j, coalesce(o.value, -1) AS score FROM (SELECT i, j FROM u WHERE split = 'train' UNION ALL SELECT j, i FROM u WHERE split = 'train') u LEFT JOIN o USING (i, j) UNION ALL SELECT i, j, 1 / (1 + (1 - value)) FROM u WHERE split = 'test') SELECT i, j, {r('score')} AS score FROM k")
def update_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, old, new = _old_new(spark, sf_dir)
    before = pairs.build_ranking(pairs.upper_pairs(old), _cells(old))
    fresh = pairs.upper_pairs(h).join(F.broadcast(new.select(F.col("i").alias("j"))), "j", "left_semi")
    return rounded(pairs.update_ranking(before, _cells(old), fresh.select("i", "j", "value")).drop("rank"))


@query(f"WITH {_RANK} SELECT i, j, {r('c.value')} AS value FROM k2 JOIN c USING (i, j) WHERE rank <= 5000 AND c.value >= 0")
def top_k_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _shapelets(spark, sf_dir)
    cells = _cells(h)
    return rounded(pairs.top_k_pairs(pairs.build_ranking(pairs.upper_pairs(h), cells), cells, 5_000).drop("rank"))


@query(f"WITH {_ADDED} SELECT count(*) AS pairs, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {r('min(value)')} AS low, {r('max(value)')} AS high, {r('quantile_cont(value, 0.5)')} AS median FROM a WHERE i < j AND value >= 0")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, old, new = _old_new(spark, sf_dir)
    return rounded(pairs.pair_stats(pairs.add_shapelets(_cells(old), old, new, _first(h))))


@query(
    f"""WITH {_U}, f AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM u), g AS (SELECT least(29, floor((value - lo) / (hi - lo) * 30)) AS bin, lo, hi, f.n AS whole, count(*) AS n FROM u, f GROUP BY ALL)
SELECT CAST(bin AS INTEGER) AS bin, {r('lo + bin * (hi - lo) / 30')} AS low, n, {r('sum(n) OVER (ORDER BY bin) / CAST(whole AS DOUBLE)')} AS cdf,
{r('(SELECT quantile_cont(value, 0.25) FROM u WHERE value > 0)')} AS q1, {r('(SELECT quantile_cont(value, 0.5) FROM u WHERE value > 0)')} AS median, {r('(SELECT quantile_cont(value, 0.75) FROM u WHERE value > 0)')} AS q3 FROM g"""
)
def pair_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.pair_distribution(pairs.upper_pairs(_shapelets(spark, sf_dir))))


#: Snapshot 0: the cells of a new matrix with placeholders above the diagonal; 1: all similarities.
_SNAP = f"{_U}, {_CELLS}, z AS (SELECT 0 AS snapshot_id, i, j, value FROM c UNION ALL SELECT 0, i, j, -1 FROM u WHERE i > 0 UNION ALL SELECT 1, i, j, value FROM u)"


def _snapshots(spark: SparkSession, sf_dir: str) -> str:
    h = _shapelets(spark, sf_dir)
    upper = materialise(pairs.upper_pairs(h), "upper")
    path = f"{shared_root(spark)}/snapshots/{uuid.uuid4().hex}"
    src.write_snapshot(_cells(h).union(upper.where("i > 0").select("i", "j", F.lit(-1.0))), path, 0, "init", {"shapelets": "first"})
    src.write_snapshot(upper, path, 1, "rebuild", {})
    return path


@query(f"WITH {_SNAP} SELECT snapshot_id, CASE WHEN snapshot_id = 0 THEN 'init' ELSE 'rebuild' END AS operation, count(*) AS cells FROM z GROUP BY ALL")
def write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_snapshots(spark, sf_dir)).groupBy("snapshot_id", "operation").agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {_SNAP} SELECT i, j, {r('value')} AS value FROM z WHERE snapshot_id = 1")
def read_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.read_snapshot(spark, _snapshots(spark, sf_dir), 1).select("i", "j", "value"))


@query(f"WITH {_SNAP} SELECT DISTINCT snapshot_id FROM z")
def list_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.list_snapshots(spark, _snapshots(spark, sf_dir))


@query(f"WITH {_SNAP}, p AS (SELECT snapshot_id, max(i) + 1 AS shapelets, count(*) AS cells, avg(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS share, coalesce(avg(CASE WHEN value >= 0 AND i <> j THEN value END), 0) AS m FROM z GROUP BY 1) SELECT snapshot_id, shapelets, cells, {r('share')} AS placeholder_share, {r('m')} AS mean_value, {r('m - lag(m) OVER (ORDER BY snapshot_id)')} AS change FROM p")
def snapshot_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.snapshot_evolution(spark.read.parquet(_snapshots(spark, sf_dir))))


@query(f"WITH {_SNAP}, n AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY round(value, 9) DESC, i, j) AS place FROM z WHERE i < j AND value >= 0) SELECT snapshot_id, CAST(place AS INTEGER) AS place, i, j, {r('value')} AS value FROM n WHERE place <= 5")
def top_rankings_per_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.top_rankings_per_snapshot(spark.read.parquet(_snapshots(spark, sf_dir))))


@query(f"WITH {_U} SELECT i, j, {r('value')} AS value FROM u")
def write_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as CSV and read again."""
    path = src.write_rows(pairs.upper_pairs(_shapelets(spark, sf_dir)), f"{shared_root(spark)}/pairs/{uuid.uuid4().hex}", "csv")
    return rounded(spark.read.option("header", True).schema("i long, j long, value double").csv(path))
