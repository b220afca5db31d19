"""Forest operators over the shapelets of ``embeddings``; votes and scores also over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.jobs.base import SERIES, query, r, rounded, series, table
from tideglass.jobs.extract_queries import gain_sql
from tideglass.jobs.pair_queries import _BOTH, _U, _shapelets
from tideglass.jobs.profile_queries import draw_sql
from tideglass.operators import classify as classification
from tideglass.operators import forest, pairs

TREES = 10
TRAINED_AT = "2024-01-01 00:00:00"
#: Least similarity and confidence of an early decision: prefixes of these series are not very like shapelets.
ACCEPTED = (0.5, 0.4)

_BOOT = f"{_U}, bt AS (SELECT tree_id, place, {draw_sql(42, 'tree_id', 'place')} % (SELECT count(*) FROM h) AS i FROM (SELECT unnest(range(0, 10)) AS tree_id), (SELECT i AS place FROM h)), boot AS (SELECT tree_id, place, i, h.label FROM bt JOIN h USING (i))"


@query(f"WITH {_BOOT} SELECT CAST(tree_id AS INTEGER) AS tree_id, CAST(place AS INTEGER) AS place, i, label FROM boot")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.bootstrap(_shapelets(spark, sf_dir), TREES)


_SPLIT = _BOOT + f""", {_BOTH}, p AS (SELECT * FROM b UNION ALL SELECT i, i, 1 FROM h), ref AS (SELECT tree_id, arg_min(i, place) AS ref FROM boot GROUP BY 1),
x AS (SELECT tree_id, label, threshold, CASE WHEN value * 5 < threshold THEN 1 ELSE 0 END AS l FROM boot JOIN ref USING (tree_id) JOIN p ON p.i = ref AND p.j = boot.i, (SELECT CAST(unnest(range(1, 10)) AS DOUBLE) / 10 AS threshold)), {gain_sql('x', 'tree_id')},
k AS (SELECT tree_id, arg_max(threshold, [round(gain, 9), -threshold]) AS threshold, max(gain) AS gain FROM g WHERE nl >= 2 AND nr >= 2 AND round(gain, 9) > 0 GROUP BY 1)"""


@query(f"WITH {_SPLIT} SELECT CAST(tree_id AS INTEGER) AS tree_id, {r('threshold')} AS threshold, {r('gain')} AS gain FROM k")
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _shapelets(spark, sf_dir)
    return rounded(forest.best_split(forest.bootstrap(h, TREES), pairs.pairwise_similarity(h), spread=5.0))


def _trained(spark: SparkSession, sf_dir: str, split: str = "train") -> classification.Model:
    """A model of the shapelets extracted from all series of a split."""
    return classification.train(series(spark, sf_dir).where(F.col("split") == split), TRAINED_AT, TREES)


@query()
def train_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).nodes


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _trained(spark, sf_dir)
    return forest.predict_trees(series(spark, sf_dir), model.nodes, model.shapelets)


@query()
def predict_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark, sf_dir).select("series_id", "tree_id", "label", "confidence", F.array_join("path", "-").alias("path"))


#: Events as tree predictions: a user's event is a tree's vote for its type, every ninth without a label.
_VOTES = "v AS (SELECT user_id AS series_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS label, value / 100 AS confidence, event_id % 10 AS tree_id FROM events)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series_id"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("label"), (F.col("value") / 100).alias("confidence"), (F.col("event_id") % 10).alias("tree_id"), "event_id")


@query(
    f"""WITH {_VOTES}, c AS (SELECT series_id, label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, label) AS k FROM c) WHERE k = 1),
w AS (SELECT series_id, count(label) AS m, sum(CASE WHEN label IS NOT NULL THEN confidence END) AS c FROM v GROUP BY 1)
SELECT series_id, label, {r('CASE WHEN m > 0 THEN CAST(0.7 AS DOUBLE) * round(c, 9) / m + CAST(0.3 AS DOUBLE) * n / m ELSE 0 END')} AS confidence, coalesce(n, 0) AS votes FROM w LEFT JOIN b USING (series_id)"""
)
def vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forest.vote(_votes(spark, sf_dir)))


#: Leaves by user: some have users of every third number only, whose events are left out.
_LEAVES = "v AS (SELECT user_id % 40 AS leaf, event_type AS label FROM events WHERE event_id % 9 <> 0 AND user_id % 3 <> 0), f AS (SELECT DISTINCT user_id % 40 AS leaf, 'own' AS label FROM events)"


@query(f"WITH {_LEAVES} SELECT leaf, label, {r('count(*) / sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY leaf)')} AS share FROM v GROUP BY leaf, label UNION ALL SELECT leaf, label, 1.0::DOUBLE FROM f WHERE leaf NOT IN (SELECT leaf FROM v)")
def leaf_class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the types that fall into each leaf; a leaf that only users of every third number have is empty."""
    e = table(spark, sf_dir, "events").withColumn("leaf", F.col("user_id") % 40)
    leaves = e.select("leaf", F.lit("own").alias("label")).distinct()
    rows = e.where("event_id % 9 <> 0 and user_id % 3 <> 0").select("leaf", F.col("event_type").alias("label"))
    return rounded(forest.leaf_class_probabilities(rows, leaves))


#: A walk visits the root, a node of depth 1 and one of depth 2, by the digits of the event's number.
_WALKS = "w AS (SELECT event_id % 10 AS tree_id, [0, 1 + event_id % 2, 3 + event_id % 4] AS path, event_type = 'click' AS ok FROM events), a AS (SELECT tree_id, node_id, count(*) AS visits, sum(CAST(ok AS BIGINT)) AS correct FROM (SELECT tree_id, unnest(path) AS node_id, ok FROM w) GROUP BY ALL), m AS (SELECT tree_id, avg(CAST(correct AS DOUBLE) / visits) AS a FROM a GROUP BY 1), u AS (SELECT tree_id, count(*) AS predictions, sum(CAST(value > 50 AS BIGINT)) AS hits FROM (SELECT event_id % 10 AS tree_id, value FROM events) GROUP BY 1), sc AS (SELECT tree_id, CAST(0.6 AS DOUBLE) * hits / predictions + CAST(0.4 AS DOUBLE) * a AS score FROM u JOIN m USING (tree_id))"


def _event_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    path = F.array(F.lit(0).cast("long"), 1 + F.col("event_id") % 2, 3 + F.col("event_id") % 4)
    return e.select((F.col("event_id") % 10).alias("tree_id"), path.alias("path"), (F.col("event_type") == "click").alias("right"), (F.col("value") > 50).alias("hit"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _event_walks(spark, sf_dir)
    usage = w.groupBy("tree_id").agg(F.count(F.lit(1)).alias("predictions"), F.sum(F.col("hit").cast("long")).alias("cache_hits"))
    return forest.tree_scores(forest.node_accuracy(w), usage)


@query(f"WITH {_WALKS} SELECT tree_id, node_id, visits, CAST(correct AS BIGINT) AS correct, {r('CAST(correct AS DOUBLE) / visits')} AS accuracy FROM a")
def node_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forest.node_accuracy(_event_walks(spark, sf_dir)))


@query(f"WITH {_WALKS} SELECT tree_id, {r('score')} AS score FROM sc")
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir))


@query(f"WITH {_WALKS} SELECT {r('avg(score)')} AS mean, {r('stddev_pop(score)')} AS std, {r('min(score)')} AS low, {r('max(score)')} AS high, CAST(sum(CAST(score >= 0.4 AS BIGINT)) AS BIGINT) AS good FROM sc")
def forest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forest.forest_stats(_scores(spark, sf_dir), 0.4))


@query()
def retrain_weak_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest after trees of a score below 0.4 were grown anew from the test series' shapelets."""
    nodes = _trained(spark, sf_dir).nodes
    new = _trained(spark, sf_dir, "test").shapelets
    return forest.retrain_weak_trees(nodes, _scores(spark, sf_dir).withColumn("tree_id", F.col("tree_id").cast("int")), new, 0.4)


@query(f"WITH {SERIES}, a AS (SELECT label, count(*) AS weight FROM s WHERE split = 'test' GROUP BY 1 ORDER BY weight DESC, label LIMIT 5) SELECT series_id AS i, label FROM s WHERE label IN (SELECT label FROM a)")
def retraining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of the labels that most test series have."""
    s = series(spark, sf_dir)
    attention = s.where("split = 'test'").groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return forest.retraining_rows(s.select(F.col("series_id").alias("i"), "label"), attention)


@query(f"WITH {_WALKS} SELECT tree_id, {r('0.5 - score')} AS improvement, {r('avg(0.5 - score) OVER ()')} AS mean_improvement FROM sc")
def score_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the trees' scores to an even 0.5."""
    before = _scores(spark, sf_dir)
    return rounded(forest.score_improvement(before, before.select("tree_id", F.lit(0.5).alias("score"))))


@query()
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test series: its early decision, or the forest's vote on the whole series."""
    test = series(spark, sf_dir).where("split = 'test'")
    return rounded(classification.classify(test, _trained(spark, sf_dir), TRAINED_AT, *ACCEPTED, asked_label=F.col("label")))
