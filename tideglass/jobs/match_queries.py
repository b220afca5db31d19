"""Cache, matching and early classification over ``embeddings`` and the outcomes in ``events``.

The train series' first 40 values are the cached shapelets; the test series'
prefixes ask. Counters come from the ids, so that DuckDB has them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.scalars import prefix_normalise
from tideglass.jobs.base import SERIES, STREAM, query, r, rounded, series, stream
from tideglass.operators import match

AS_OF = "2024-01-02 00:00:00"

_NORM = "list_transform({0}, lambda x: (x - list_avg({0})) / (list_stddev_pop({0}) + 1e-8::DOUBLE))"
_CACHE = SERIES + """, c0 AS (SELECT *, 30 + series_id % 20 AS n FROM s WHERE split = 'train'), c1 AS (SELECT series_id AS shapelet_id, label, v[1:n] AS x, n AS length FROM c0),
c AS (SELECT shapelet_id, label, length, list_transform(x, lambda y: (y - list_avg(x)) / (list_stddev_pop(x) + 1e-8::DOUBLE)) AS x, CAST(shapelet_id * 7 % 11 AS DOUBLE) / 11 AS confidence, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(shapelet_id) AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(2 * shapelet_id % 1440) AS last_accessed, shapelet_id % 5 AS usage_count, shapelet_id % 5 AS total_matches, shapelet_id % 3 % greatest(1, shapelet_id % 5 + 1) AS successful_matches,
  CAST(shapelet_id % 7 AS DOUBLE) / 7 AS success_rate, CAST(shapelet_id % 13 AS DOUBLE) / 13 AS discriminative_score FROM c1)"""
_TIERS = _CACHE + """, n AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, shapelet_id DESC) AS late, row_number() OVER (PARTITION BY label ORDER BY success_rate DESC, confidence DESC, last_accessed DESC, shapelet_id) AS own,
  row_number() OVER (ORDER BY success_rate DESC, confidence DESC, discriminative_score DESC, shapelet_id) AS best FROM c),
t AS (SELECT *, 'ring' AS tier FROM n WHERE late <= 200 UNION ALL SELECT *, 'label' FROM n WHERE own <= 50 UNION ALL SELECT *, 'quality' FROM n WHERE best <= 40 UNION ALL SELECT *, 'recent' FROM n WHERE late <= 20)"""
_PREFIX = _TIERS + """, q0 AS (SELECT series_id, label AS asked_label, v, CAST(unnest(range(CAST(floor(len(v) * 0.3) AS BIGINT), least(CAST(ceil(len(v) * 0.8) AS BIGINT), CAST(floor(len(v) * 0.3) AS BIGINT) + least(100, len(v)) - 1) + 1)) AS INTEGER) AS length FROM s WHERE split = 'test'),
q1 AS (SELECT series_id, asked_label, length, len(v) AS n, v[1:length] AS p FROM q0 WHERE length >= len(v) * 0.3),
q AS (SELECT series_id, asked_label, length, n, list_transform(p, lambda x: (x - list_avg(p)) / (list_stddev_pop(p) + 1e-8::DOUBLE)) AS a FROM q1)"""
_LEN = _PREFIX + """, k AS (SELECT q.series_id, q.asked_label, q.length, q.a, t.* EXCLUDE (length), t.length AS c_length FROM q JOIN t ON t.length BETWEEN CAST(floor(q.length * 0.7) AS BIGINT) AND CAST(floor(q.length * 1.3) AS BIGINT) WHERE tier <> 'ring' AND (tier <> 'label' OR t.label = q.asked_label))"""
_SCORE = _LEN + """, z AS (SELECT DISTINCT ON (series_id, length, shapelet_id) *, CAST(0.3 AS DOUBLE) * success_rate + CAST(0.2 AS DOUBLE) * confidence + CAST(0.2 AS DOUBLE) * discriminative_score
  + CAST(0.15 AS DOUBLE) / (1 + date_diff('second', last_accessed, TIMESTAMP '2024-01-02 00:00:00') / CAST(3600 AS DOUBLE)) + CASE WHEN label = asked_label THEN 0.15 ELSE 0 END AS score FROM k)"""
_TOP = _SCORE + ", p AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, length ORDER BY round(score, 9) DESC, shapelet_id) AS place FROM z WHERE score > 0.1) WHERE place <= 10)"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("series_id")
    length = (30 + i % 20).cast("int")
    born = F.lit("2024-01-01 00:00:00").cast("timestamp")
    after = lambda minutes: F.timestamp_seconds(F.unix_timestamp(born) + minutes * 60)
    return series(spark, sf_dir).where("split = 'train'").select(
        i.alias("shapelet_id"), "label", prefix_normalise(F.slice("values", 1, length)).alias("values"), length.alias("length"), ((i * 7 % 11).cast("double") / 11).alias("confidence"), after(i).alias("created_at"), after(2 * i % 1440).alias("last_accessed"),
        (i % 5).alias("usage_count"), (i % 5).alias("total_matches"), (i % 3 % F.greatest(F.lit(1), i % 5 + 1)).alias("successful_matches"), ((i % 7).cast("double") / 7).alias("success_rate"), ((i % 13).cast("double") / 13).alias("discriminative_score"),
    )


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = series(spark, sf_dir).where("split = 'test'").withColumnRenamed("label", "asked_label").select("series_id", "asked_label", "values")
    return match.prefixes(test)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.scored_candidates(_queries(spark, sf_dir), match.cache_tiers(_cache(spark, sf_dir)), AS_OF)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).where("split = 'test'").select("series_id", "label", F.size("values").alias("n"))
    d = match.early_decision(_queries(spark, sf_dir), _cache(spark, sf_dir), AS_OF, 0.3, 0.3)
    early = F.col("length").isNotNull()
    return s.join(d, "series_id", "left").select("series_id", "label", "predicted_label", "confidence", F.when(early, match.earliness(F.col("length").cast("double") / F.col("n"))).alias("earliness"), early.alias("early"))


@query(f"WITH {_TIERS} SELECT shapelet_id, tier FROM t")
def cache_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.cache_tiers(_cache(spark, sf_dir)).select("shapelet_id", "tier")


@query(f"WITH {_LEN} SELECT series_id, length, shapelet_id, tier FROM k")
def length_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = match.length_candidates(_queries(spark, sf_dir), match.cache_tiers(_cache(spark, sf_dir)))
    return k.select("series_id", "length", F.col("c_shapelet_id").alias("shapelet_id"), F.col("c_tier").alias("tier"))


@query(f"WITH {_SCORE} SELECT series_id, length, shapelet_id, {r('score')} AS score FROM z")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("series_id", "length", F.col("c_shapelet_id").alias("shapelet_id"), "score"))


@query(f"WITH {_TOP} SELECT series_id, length, shapelet_id, CAST(place AS INTEGER) AS place FROM p")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.top_candidates(_scored(spark, sf_dir)).select("series_id", "length", F.col("c_shapelet_id").alias("shapelet_id"), "place")


# The queries on matches have no SQL: unequal lengths are compared by warping.
@query()
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = match.best_match(_queries(spark, sf_dir), match.cache_tiers(_cache(spark, sf_dir)), AS_OF)
    return rounded(best.select("series_id", "length", F.col("c_shapelet_id").alias("shapelet_id"), "sim"))


@query(
    f"""WITH {_TOP}, m AS (SELECT *, CAST(shapelet_id * 31 % 101 AS DOUBLE) / 101 AS sim FROM p WHERE place = 1)
SELECT series_id, length, {r('greatest(0, least(1, sim * (CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * (CAST(0.4 AS DOUBLE) * confidence + CAST(0.3 AS DOUBLE) * success_rate + CAST(0.3 AS DOUBLE) * discriminative_score))))')} AS match_confidence FROM m"""
)
def match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of each prefix' first candidate, with a similarity that follows from the shapelet's number."""
    first = match.top_candidates(_scored(spark, sf_dir)).where("place = 1").withColumn("sim", (F.col("c_shapelet_id") * 31 % 101).cast("double") / 101)
    sure = match.match_confidence(F.col("sim"), F.col("c_confidence"), F.col("c_success_rate"), F.col("c_discriminative_score"))
    return rounded(first.select("series_id", "length", sure.alias("match_confidence")))


@query()
def early_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(match.early_match(_queries(spark, sf_dir), _cache(spark, sf_dir), AS_OF, 0.3, 0.3))


@query(f"WITH {_PREFIX} SELECT series_id, length, {r('a[1]', 5)} AS first, {r('a[length]', 5)} AS last FROM q")
def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_queries(spark, sf_dir).select("series_id", "length", F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last")), 5)


@query()
def early_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(match.early_decision(_queries(spark, sf_dir), _cache(spark, sf_dir), AS_OF, 0.3, 0.3))


@query(f"WITH {_PREFIX} SELECT series_id, length, {r('greatest(0.1, least(0.9, 0.1 + 0.8 * (1 - CAST(length AS DOUBLE) / n)))')} AS earliness FROM q")
def earliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_queries(spark, sf_dir).select("series_id", "length", match.earliness(F.col("length").cast("double") / F.col("n")).alias("earliness")))


#: Predictions that follow from the series' numbers: every seventh failed, every third early, every eleventh series without a label.
_PRED = SERIES + """, t AS (SELECT series_id, CASE WHEN series_id % 11 <> 0 THEN label END AS label, CASE WHEN series_id % 7 <> 0 THEN CASE WHEN series_id % 4 = 0 THEN CAST(series_id % 10 AS VARCHAR) ELSE label END END AS predicted, CAST(series_id % 13 AS DOUBLE) / 13 AS conf,
  greatest(0.1, least(0.9, 0.1 + 0.8 * (1 - CAST(series_id % 17 AS DOUBLE) / 16))) AS ea, series_id % 3 = 0 AS early FROM s),
q AS (SELECT label, coalesce(CAST(label = predicted AS DOUBLE), 0) AS hit, CASE WHEN predicted IS NOT NULL THEN conf ELSE 0 END AS conf, CASE WHEN predicted IS NOT NULL THEN ea ELSE 1 END AS ea, CAST(early AND predicted IS NOT NULL AS DOUBLE) AS early FROM t),
v AS (SELECT label, GROUPING(label) AS level, avg(hit) AS accuracy, avg(conf) AS mean_confidence, avg(ea) AS mean_earliness, avg(early) AS early_rate, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total FROM q GROUP BY ROLLUP (label))"""


def _made_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, done = F.col("series_id"), F.col("series_id") % 7 != 0
    predicted = F.when(done, F.when(i % 4 == 0, (i % 10).cast("string")).otherwise(F.col("label")))
    early = match.earliness((i % 17).cast("double") / 16)
    return series(spark, sf_dir).select(F.when(i % 11 != 0, F.col("label")).alias("label"), predicted.alias("predicted_label"), F.when(done, (i % 13).cast("double") / 13).alias("confidence"), F.when(done, early).alias("earliness"), F.when(done, i % 3 == 0).alias("early"))


@query(
    f"""WITH {_PRED} SELECT label, CAST(level AS INTEGER) AS level, {r('accuracy')} AS accuracy, {r('mean_confidence')} AS mean_confidence, {r('mean_earliness')} AS mean_earliness, {r('early_rate')} AS early_rate, correct, total,
{r('coalesce(2 * accuracy * (1 - mean_earliness) / nullif(accuracy + 1 - mean_earliness, 0), 0)')} AS harmonic_mean FROM v"""
)
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label and in total: predictions of all series, some failed and some of series without a label."""
    return rounded(match.evaluate(_made_predictions(spark, sf_dir), ["label"]))


@query(f"WITH {_PRED} SELECT label, {r('coalesce(2 * accuracy * mean_earliness / nullif(accuracy + mean_earliness, 0), 0)')} AS harmonic_mean FROM v WHERE level = 0")
def harmonic_mean_earliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = match.evaluate(_made_predictions(spark, sf_dir), ["label"]).where("level = 0")
    return rounded(per.select("label", match.harmonic_mean_earliness(F.col("accuracy"), F.col("mean_earliness")).alias("harmonic_mean")))


@query()
def evaluate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the early decisions on the test series."""
    return rounded(match.evaluate(_predictions(spark, sf_dir), ["label"]))


#: Outcomes of shapelets: an event is a match of the shapelet of its number modulo 400.
_OUT = _CACHE + ", o AS (SELECT event_id % 400 AS shapelet_id, CAST(event_id AS BIGINT) AS k, event_type = 'click' AS success, event_type <> 'view' AS matched, value FROM events)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("event_id") % 86400)
    return s.select((F.col("event_id") % 400).alias("shapelet_id"), "event_id", (F.col("label") == "click").alias("success"), (F.col("label") != "view").alias("matched"), at.alias("at"), "value")


@query(
    f"""WITH {_OUT}, n AS (SELECT shapelet_id, count(*) AS n, sum(CAST(success AS BIGINT)) AS g, max(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(k % 86400)) AS moment FROM o GROUP BY 1)
SELECT shapelet_id, CAST(usage_count + coalesce(n, 0) AS BIGINT) AS usage_count, CAST(total_matches + coalesce(n, 0) AS BIGINT) AS total_matches, CAST(successful_matches + coalesce(g, 0) AS BIGINT) AS successful_matches,
{r('CASE WHEN n > 0 THEN CAST(successful_matches + g AS DOUBLE) / greatest(1, total_matches + n) ELSE success_rate END')} AS success_rate, epoch(greatest(last_accessed, coalesce(moment, last_accessed)))::BIGINT AS last_accessed FROM c LEFT JOIN n USING (shapelet_id)"""
)
def usage_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = match.usage_update(_cache(spark, sf_dir), _outcomes(spark, sf_dir))
    return rounded(c.select("shapelet_id", "usage_count", "total_matches", "successful_matches", "success_rate", F.unix_timestamp("last_accessed").alias("last_accessed")))


@query(
    f"""WITH {_OUT}, w AS (SELECT shapelet_id, value / 100 AS v, row_number() OVER (PARTITION BY shapelet_id ORDER BY k DESC) - 1 AS b FROM o)
SELECT shapelet_id, {r('any_value(confidence) * pow(CAST(0.9 AS DOUBLE), count(*)) + sum(CAST(0.1 AS DOUBLE) * pow(CAST(0.9 AS DOUBLE), b) * v)')} AS confidence FROM w JOIN c USING (shapelet_id) GROUP BY shapelet_id"""
)
def confidence_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _cache(spark, sf_dir).select("shapelet_id", F.col("confidence").alias("start"))
    feedback = _outcomes(spark, sf_dir).join(start, "shapelet_id").select("shapelet_id", F.col("event_id").alias("at"), "start", (F.col("value") / 100).alias("new"))
    return rounded(match.confidence_ema(feedback))


_M10 = STREAM + """, a AS (SELECT stream_id, event_id, t, event_id % 200 < CASE WHEN t % 160 < 80 THEN 190 ELSE 90 END AS correct, sim / 2 AS ea FROM e),
b AS (SELECT *, CASE WHEN count(*) OVER w < 10 THEN 0 WHEN avg(CAST(correct AS DOUBLE)) OVER w < 0.6 THEN -1 WHEN avg(CAST(correct AS DOUBLE)) OVER w > 0.85 AND avg(ea) OVER w < 0.3 THEN 1 ELSE 0 END AS step FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, list(CAST(step AS DOUBLE)) OVER (PARTITION BY stream_id ORDER BY t) AS steps FROM b)"""


@query(f"WITH {_M10} SELECT stream_id, event_id, {r('list_reduce(steps, lambda a, x: CASE WHEN x < 0 THEN greatest(CAST(0.4 AS DOUBLE), a - 0.01) WHEN x > 0 THEN least(CAST(0.85 AS DOUBLE), a + 0.01) ELSE a END, CAST(0.6 AS DOUBLE))')} AS threshold FROM l")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir).withColumn("t", F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")))
    correct = F.col("event_id") % 200 < F.when(F.col("t") % 160 < 80, 190).otherwise(90)
    outcomes = rows.select("stream_id", "ts", "event_id", correct.alias("correct"), (F.col("sim") / 2).alias("earliness"))
    return rounded(match.adaptive_threshold(outcomes).select("stream_id", "event_id", "threshold"))


@query(
    f"""WITH {_OUT} SELECT (SELECT count(*) FROM o) AS attempts, {r('(SELECT avg(CAST(matched AS DOUBLE)) FROM o)')} AS match_rate, {r('(SELECT avg(CASE WHEN matched THEN CAST(success AS DOUBLE) END) FROM o)')} AS hit_rate, {r('avg(success_rate)')} AS mean_success,
{r('avg(confidence)')} AS mean_confidence, {r('avg(discriminative_score)')} AS mean_discriminative, {r('avg(usage_count)')} AS mean_usage, CAST(sum(CASE WHEN last_accessed >= TIMESTAMP '2024-01-01 23:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS last_hour FROM c"""
)
def matcher_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(match.matcher_metrics(_cache(spark, sf_dir), _outcomes(spark, sf_dir), AS_OF))
