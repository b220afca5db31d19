"""Extraction over the series of ``embeddings``: every n-th series as the operator samples, and all lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.jobs.base import SERIES, query, r, rounded, series
from tideglass.jobs.pair_queries import _U, _shapelets
from tideglass.jobs.profile_queries import draw_sql
from tideglass.operators import extract, pairs, profile

_TRAIN = SERIES + ", t AS (SELECT *, row_number() OVER (ORDER BY series_id) - 1 AS k, count(*) OVER () AS n FROM s WHERE split = 'train')"
_CAND = _TRAIN + """, lr AS (SELECT CAST(greatest(5, floor(min(len(v)) * 0.1)) AS BIGINT) AS low, CAST(least(50, floor(max(len(v)) * 0.5)) AS BIGINT) AS high FROM t),
l AS (SELECT series_id, label, v, unnest(range(low, high + 1)) AS length FROM t, lr WHERE k % greatest(1, n // 50) = 0),
c0 AS (SELECT series_id, label, length, v, unnest(range(0, len(v) - length + 1, length // 2)) AS start FROM l WHERE length < len(v)),
c1 AS (SELECT series_id, label, length, start, v[start + 1:start + length] AS x FROM c0),
c2 AS (SELECT *, list_avg(x) AS mu, list_stddev_pop(x) AS sd FROM c1),
c AS MATERIALIZED (SELECT concat_ws('-', series_id, length, start) AS candidate_id, series_id, label, length, start, list_transform(x, lambda y: (y - mu) / sd) AS z FROM c2 WHERE sd >= 0.01)"""
#: m: the sampled series; d: least distance of each candidate to each of them.
_DIST = _CAND + f""", m0 AS (SELECT series_id, label, v, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'series_id')}, series_id) AS k, count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS n FROM t),
m AS (SELECT series_id, label, v FROM m0 WHERE k <= greatest(1, floor(CAST(c AS DOUBLE) / n * least(50, n)))),
w0 AS (SELECT series_id, label, length, v[start + 1:start + length] AS x FROM (SELECT series_id, label, v, length, unnest(range(0, len(v) - length + 1)) AS start FROM m, (SELECT unnest(range(low, high + 1)) AS length FROM lr))),
w1 AS (SELECT *, list_avg(x) AS mu, list_stddev_pop(x) AS sd FROM w0),
w AS MATERIALIZED (SELECT series_id, label, length, list_transform(x, lambda y: (y - mu) / sd) AS z, sd FROM w1),
d AS MATERIALIZED (SELECT candidate_id, w.series_id, w.label, min(list_distance(c.z, w.z)) AS distance FROM c JOIN w USING (length) WHERE w.sd >= 0.001 GROUP BY ALL)"""
_THRESH = _DIST + """, p AS (SELECT candidate_id, quantile_cont(1 / (1 + distance), [0.2, 0.4, 0.5, 0.6, 0.8]) AS q, max(1 / (1 + distance)) - min(1 / (1 + distance)) AS range FROM d GROUP BY 1),
h AS (SELECT candidate_id, unnest(CASE WHEN range > 0.01 THEN q ELSE [0.3::DOUBLE, 0.5, 0.7] END) AS threshold FROM p)"""


def gain_sql(rows: str, keys: str) -> str:
    """CTEs g(keys, threshold, nl, nr, gain) from ``rows`` (keys, threshold, label, l 0/1)."""
    e = lambda n, s: f"CASE WHEN {n} > 0 THEN log2({n}) - {s} / {n} ELSE 0 END"
    x = lambda c: f"CASE WHEN {c} > 0 THEN {c} * log2({c}) ELSE 0 END"
    return (
        f"g0 AS (SELECT {keys}, threshold, label, CAST(sum(l) AS DOUBLE) AS l, CAST(sum(1 - l) AS DOUBLE) AS r FROM {rows} GROUP BY ALL), "
        f"g1 AS (SELECT {keys}, threshold, sum(l) AS nl, sum(r) AS nr, sum({x('l')}) AS sl, sum({x('r')}) AS sr, sum({x('(l + r)')}) AS sa FROM g0 GROUP BY ALL), "
        f"g AS (SELECT {keys}, threshold, nl, nr, {e('(nl + nr)', 'sa')} - nl / (nl + nr) * ({e('nl', 'sl')}) - nr / (nl + nr) * ({e('nr', 'sr')}) AS gain FROM g1)"
    )


_GAIN = _THRESH + ", x AS (SELECT candidate_id, threshold, label, CASE WHEN 1 / (1 + distance) >= threshold THEN 1 ELSE 0 END AS l FROM d JOIN (SELECT DISTINCT * FROM h) USING (candidate_id)), " + gain_sql("x", "candidate_id") + ", b AS (SELECT candidate_id, greatest(0, coalesce(max(CASE WHEN nl >= 2 AND nr >= 2 THEN gain END), 0)) AS info_gain FROM g GROUP BY 1)"


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).where("split = 'train'")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    bounds = extract.length_range(train).first()
    return extract.subsequence_candidates(profile.every_nth_series(train), bounds["min_length"], bounds["max_length"])


def _distances(spark: SparkSession, sf_dir: str, rule: str = "strided") -> DataFrame:
    return extract.min_distances(_candidates(spark, sf_dir), profile.stratified_sample(_train(spark, sf_dir)), rule)


@query(f"WITH {SERIES} SELECT CAST(greatest(5, floor(min(len(v)) * 0.1)) AS INTEGER) AS min_length, CAST(least(50, floor(max(len(v)) * 0.5)) AS INTEGER) AS max_length FROM s")
def length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.length_range(series(spark, sf_dir))


@query(f"WITH {_CAND} SELECT candidate_id, series_id, label, CAST(length AS INTEGER) AS length, CAST(start AS INTEGER) AS start, {r('z[1]')} AS first, {r('z[length]')} AS last FROM c")
def subsequence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return rounded(c.select("candidate_id", "series_id", "label", "length", "start", F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last")))


@query(f"WITH {_DIST.replace('w.sd >= 0.001', 'w.sd > 0')} SELECT candidate_id, series_id, label, {r('distance')} AS distance FROM d")
def min_subsequence_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_distances(spark, sf_dir, "full"))


@query(f"WITH {_DIST} SELECT candidate_id, series_id, label, {r('distance')} AS distance FROM d")
def strided_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_distances(spark, sf_dir))


@query(f"WITH {_THRESH} SELECT candidate_id, {r('threshold')} AS threshold FROM h")
def percentile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract.percentile_thresholds(_distances(spark, sf_dir)))


@query(f"WITH {_GAIN} SELECT candidate_id, {r('info_gain')} AS info_gain FROM b")
def candidate_info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract.candidate_info_gain(_distances(spark, sf_dir)))


@query(f"WITH {_GAIN} SELECT candidate_id, {r('info_gain')} AS info_gain FROM b WHERE info_gain > 0.01")
def informative_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract.informative_candidates(extract.candidate_info_gain(_distances(spark, sf_dir))))


@query()
def diverse_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most informative candidates of each label that are unlike each other."""
    train, found = _train(spark, sf_dir), _candidates(spark, sf_dir)
    best = extract.candidate_info_gain(extract.min_distances(found, profile.stratified_sample(train))).where("info_gain > 0.01").join(found, "candidate_id")
    return rounded(extract.diverse_top(best, ["label"]).select("label", "candidate_id", "info_gain"))


@query(
    f"""WITH {SERIES}, a AS (SELECT *, greatest(5, floor(len(v) * 0.05)) AS lo, least(20, floor(len(v) * 0.2)) AS hi FROM s ORDER BY {draw_sql(42, 'series_id')}, series_id LIMIT 50),
b AS (SELECT *, CAST(lo + {draw_sql(43, 'series_id')} % greatest(1, hi - lo + 1) AS INTEGER) AS length FROM a), c AS (SELECT *, CAST({draw_sql(44, 'series_id')} % greatest(1, len(v) - length + 1) AS INTEGER) AS start FROM b),
d AS (SELECT *, v[start + 1:start + length] AS x FROM c) SELECT series_id, label, start, length, {r('(x[1] - list_avg(x)) / list_stddev_pop(x)')} AS first FROM d WHERE list_stddev_pop(x) > 0.01"""
)
def fallback_shapelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract.fallback_shapelets(series(spark, sf_dir)).select("series_id", "label", "start", "length", F.get("values", F.lit(0)).alias("first")))


_GRID = _U + ", y AS (SELECT i, j, value FROM u UNION ALL SELECT j, i, value FROM u UNION ALL SELECT i, i, 1 FROM h), x AS (SELECT y.i, h.label, t.threshold, CASE WHEN y.value * 5 - 0.05 >= t.threshold THEN 1 ELSE 0 END AS l FROM y JOIN h ON h.i = y.j, (SELECT CAST(unnest(range(0, 17)) AS DOUBLE) * 0.8 / 16 + 0.1 AS threshold) t), " + gain_sql("x", "i") + ", k AS (SELECT i, CASE WHEN nl >= 2 AND nr >= 2 AND round(gain, 9) > 0 THEN gain END AS gain, threshold FROM g), z AS (SELECT i, coalesce(arg_max(threshold, [round(gain, 9), -threshold]) FILTER (gain IS NOT NULL), 0.5) AS threshold, coalesce(max(gain), 0) AS info_gain FROM k GROUP BY i)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of every shapelet to all, itself included, spread over the thresholds' range."""
    h = _shapelets(spark, sf_dir)
    return pairs.pairwise_similarity(h).join(h.select(F.col("i").alias("j"), "label"), "j").select("i", "label", (F.col("value") * 5 - 0.05).alias("value"))


@query(f"WITH {_GRID} SELECT i, {r('threshold')} AS threshold, {r('info_gain')} AS info_gain FROM z")
def grid_info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract.grid_info_gain(_labelled(spark, sf_dir), ["i"]))


@query(f"WITH {_GRID} SELECT i FROM z WHERE info_gain >= 0.01")
def select_high_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.select_high_quality(_labelled(spark, sf_dir), 0.01)


@query()
def extract_shapelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction over the train split and all lengths."""
    return rounded(extract.extract_shapelets(_train(spark, sf_dir)).select("candidate_id", "label", "length", "info_gain"))
