"""Attention and drift over the label streams of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.jobs.base import STREAM, query, r, rounded, stream, table
from tideglass.operators import attention, drift


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call of a stream is a user's events together, calls in the order of users."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 16).alias("key"), F.col("user_id").alias("call"), F.col("event_type").alias("label"), ((F.col("event_id") % 97).cast("double") / 97).alias("sim"))


_W = """m AS (SELECT user_id % 16 AS key, user_id AS call, event_type AS label, CAST(event_id % 97 AS DOUBLE) / 97 AS sim FROM events),
g AS (SELECT key, call, label, count(*) AS n, avg(sim) AS a FROM m WHERE sim >= 0.8 GROUP BY ALL),
w AS (SELECT key, call, label, CAST(0.4 AS DOUBLE) * n / sum(n) OVER (PARTITION BY key ORDER BY call RANGE UNBOUNDED PRECEDING) + CAST(0.3 AS DOUBLE) * least(least(sum(n) OVER (PARTITION BY key, label ORDER BY call RANGE UNBOUNDED PRECEDING), 100) / CAST(10 AS DOUBLE), 1) + CAST(0.3 AS DOUBLE) * a AS weight FROM g),
x AS (SELECT *, CASE WHEN weight > 0 THEN greatest(0, log2(weight) * 1) ELSE 0 END AS p FROM w),
s AS (SELECT key, call, label, CASE WHEN sum(p) OVER k > 0 THEN p / sum(p) OVER k ELSE CAST(1 AS DOUBLE) / count(*) OVER k END AS weight FROM x WINDOW k AS (PARTITION BY key, call)),
l AS (SELECT key, label, arg_max(weight, call) AS weight FROM s GROUP BY ALL)"""


@query(f"WITH {_W} SELECT key, call, label, {r('weight')} AS weight FROM w")
def attention_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attention.attention_weights(_matches(spark, sf_dir)))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.normalised_attention(attention.attention_weights(_matches(spark, sf_dir)))


@query(f"WITH {_W} SELECT key, call, label, {r('weight')} AS weight FROM s")
def normalised_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shares(spark, sf_dir))


@query(f"WITH {_W} SELECT key, label, {r('weight')} AS weight FROM l")
def latest_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attention.latest_attention(_shares(spark, sf_dir)))


@query(f"WITH {_W}, t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(weight, 9) DESC, label) AS rank FROM l) SELECT key, label, {r('weight')} AS weight, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3")
def top_attention_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attention.top_attention_labels(attention.latest_attention(_shares(spark, sf_dir)), 3))


@query(f"WITH {_W}, c AS (SELECT key, label, count(*) AS frequency FROM m WHERE sim >= 0.8 GROUP BY ALL) SELECT key, label, frequency, least(frequency, 100) AS sequence_length, CAST(sum(frequency) OVER (PARTITION BY key) AS BIGINT) AS evaluations FROM c")
def attention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.attention_summary(_matches(spark, sf_dir))


@query(
    f"""WITH {STREAM}, w AS (SELECT a.stream_id, a.event_id, b.label, CAST(0.4 AS DOUBLE) * count(*) + CAST(0.3 AS DOUBLE) * avg(b.sim) AS w FROM e a JOIN e b ON a.stream_id = b.stream_id AND b.t BETWEEN a.t - 99 AND a.t WHERE a.sim >= 0.8 GROUP BY ALL),
x AS (SELECT *, CASE WHEN w > 0 THEN greatest(0, log2(w)) ELSE 0 END AS p FROM w)
SELECT stream_id, event_id, label, {r('CASE WHEN sum(p) OVER k > 0 THEN p / sum(p) OVER k ELSE CAST(1 AS DOUBLE) / count(*) OVER k END')} AS weight FROM x WINDOW k AS (PARTITION BY stream_id, event_id)"""
)
def streaming_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attention.streaming_attention(stream(spark, sf_dir)))


_A7 = STREAM + """, p AS (SELECT *, coalesce(t - lag(t) OVER k, 0) AS gap FROM e WINDOW k AS (PARTITION BY stream_id, label ORDER BY t)),
l AS (SELECT *, list(CAST(gap AS DOUBLE)) OVER (PARTITION BY stream_id, label ORDER BY t) AS gaps FROM p)"""


@query(f"WITH {_A7} SELECT stream_id, event_id, label, {r('list_reduce(gaps, lambda a, x: 1 + CASE WHEN a * pow(CAST(0.95 AS DOUBLE), x) >= 0.01 THEN a * pow(CAST(0.95 AS DOUBLE), x) ELSE 0 END, CAST(0 AS DOUBLE))')} AS frequency FROM l")
def decayed_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attention.decayed_frequency(stream(spark, sf_dir)))


_D = STREAM + """, f AS (SELECT stream_id, event_id, t, list(label) OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 98 PRECEDING AND CURRENT ROW) AS recent,
  coalesce(list(label) OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 198 PRECEDING AND 99 PRECEDING), []) AS history FROM e),
u AS (SELECT stream_id, event_id, t, len(recent) AS nr, len(history) AS nh, recent, history, unnest(list_sort(list_distinct(list_concat(recent, history)))) AS label FROM f WHERE len(recent) >= 50 AND len(history) >= 50),
q AS (SELECT stream_id, event_id, t, label, CAST(len(list_filter(recent, lambda x: x = label)) AS DOUBLE) / nr AS p, CAST(len(list_filter(history, lambda x: x = label)) AS DOUBLE) / nh AS q FROM u),
j AS (SELECT stream_id, event_id, t, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END))) AS magnitude,
  string_agg(CASE WHEN q = 0 THEN label END, ',' ORDER BY label) AS new, string_agg(CASE WHEN p = 0 THEN label END, ',' ORDER BY label) AS gone,
  string_agg(CASE WHEN abs(p - q) > 0.1 THEN label || ':' || printf('%.2f', abs(p - q)) END, ';' ORDER BY label) AS moved FROM q GROUP BY ALL),
d AS (SELECT e.stream_id, e.event_id, e.t, coalesce(magnitude > 0.1, false) AS changed, coalesce(magnitude, 0) AS magnitude,
  CASE WHEN j.t IS NULL THEN 'insufficient_data' WHEN new IS NOT NULL THEN 'new_classes:' || new WHEN gone IS NOT NULL THEN 'disappeared_classes:' || gone WHEN moved IS NOT NULL THEN 'proportion_changes:' || moved ELSE 'minor_shift' END AS kind
  FROM e LEFT JOIN j ON j.stream_id = e.stream_id AND j.event_id = e.event_id)"""


@query(f"WITH {_D} SELECT stream_id, event_id, len(recent) AS recent, len(history) AS history FROM f")
def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_windows(stream(spark, sf_dir)).select("stream_id", "event_id", F.size("recent").cast("long").alias("recent"), F.size("history").cast("long").alias("history"))


@query(f"WITH {_D} SELECT stream_id, event_id, changed, {r('magnitude')} AS magnitude FROM d")
def label_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.label_drift(stream(spark, sf_dir)).drop("ts", "kind"))


@query(f"WITH {_D} SELECT stream_id, event_id, kind FROM d")
def drift_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.label_drift(stream(spark, sf_dir)).select("stream_id", "event_id", "kind")


@query(f"WITH {_D}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t DESC) AS nth FROM d WHERE changed) SELECT stream_id, event_id, {r('magnitude')} AS magnitude, kind, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= 10")
def drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.drift_log(drift.label_drift(stream(spark, sf_dir))).drop("ts", "changed"))


@query(f"WITH {_D} SELECT d.stream_id, d.event_id, changed OR e.value / 100 < 0.6 OR d.t % 10 = 0 AS due FROM d JOIN e USING (event_id)")
def update_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each row would start a retraining, with a hundredth of its value as the mean tree score."""
    rows = stream(spark, sf_dir)
    found = drift.label_drift(rows).withColumn("t", F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")))
    return found.join(rows.select("event_id", "value"), "event_id").select("stream_id", "event_id", drift.update_due(F.col("changed"), F.col("value") / 100, F.col("t")).alias("due"))


@query(f"WITH {STREAM} SELECT stream_id, event_id, {r('avg(sim) OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)')} AS mean_earliness FROM e")
def rolling_earliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir).withColumnRenamed("sim", "earliness")
    return rounded(drift.rolling_earliness(rows).select("stream_id", "event_id", "mean_earliness"))


_N9 = STREAM + """, m AS (SELECT *, pow(sim, CASE WHEN t % 40 < 20 THEN 0.2 ELSE 4 END) AS ea FROM e),
a AS (SELECT stream_id, event_id, t, CASE WHEN count(ea) OVER b < 10 THEN 0 WHEN avg(ea) OVER b > 0.7 THEN 1 WHEN avg(ea) OVER b < 0.3 THEN -1 ELSE 0 END AS step FROM m WINDOW b AS (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, list(CAST(step AS DOUBLE)) OVER (PARTITION BY stream_id ORDER BY t) AS steps FROM a)"""


@query(f"WITH {_N9} SELECT stream_id, event_id, {r('list_reduce(steps, lambda a, x: CASE WHEN x > 0 THEN least(CAST(0.95 AS DOUBLE), a * 1.05) WHEN x < 0 THEN greatest(CAST(0.5 AS DOUBLE), a * 0.95) ELSE a END, CAST(0.85 AS DOUBLE))')} AS threshold FROM l")
def earliness_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir).withColumn("t", F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")))
    early = F.pow("sim", F.when(F.col("t") % 40 < 20, 0.2).otherwise(4.0))
    return rounded(drift.earliness_threshold(rows.select("stream_id", "ts", "event_id", early.alias("earliness"))).select("stream_id", "event_id", "threshold"))
