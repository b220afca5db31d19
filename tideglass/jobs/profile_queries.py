"""Sources, profiles and sampling over the series of ``embeddings``, ``lineitem`` and ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.jobs.base import SERIES, query, r, rounded, series, table
from tideglass.operators import profile
from tideglass.shared import shared_root
from tideglass.sources import series as src


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/series/{uuid.uuid4().hex}"


@query(f"WITH {SERIES} SELECT 'embeddings' AS dataset, split, label, count(*) AS n, {r('sum(list_sum(v))')} AS total, min(len(v)) AS shortest FROM s GROUP BY split, label")
def read_labelled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series written as TSV files and read again: rows and sum of values of each split and label."""
    folder = _folder(spark)
    line = F.concat_ws("\t", "label", F.concat_ws("\t", F.transform("values", lambda x: x.cast("string"))))
    for split in ("train", "test"):
        series(spark, sf_dir).where(F.col("split") == split).select(line.alias("value")).write.text(f"{folder}/embeddings/E_{split.upper()}.tsv")
    found = src.read_labelled_series(spark, folder, "embeddings")
    return rounded(found.groupBy("dataset", "split", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.min(F.size("values")).cast("long").alias("shortest")))


@query("SELECT 'set_' || label AS dataset, count(*) AS n FROM embeddings WHERE label IN (1, 2, 3, 4, 5, 6) AND label <> 3 GROUP BY label ORDER BY dataset LIMIT 4")
def select_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series counted by dataset (one for each label) after all four ways to select datasets."""
    named = series(spark, sf_dir).withColumn("dataset", F.concat(F.lit("set_"), "label"))
    kept = src.select_datasets(named, [f"set_{k}" for k in range(1, 10)], ["set_3"], "_[1-6]$", 4)
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


#: The rows of each label of a key as one text.
_CLASSES = "(SELECT k AS split, string_agg(label || ':' || n, ';' ORDER BY label) AS d FROM (SELECT {0} AS k, label, count(*) AS n FROM s GROUP BY ALL) GROUP BY k)"


def _listed(classes: str) -> Column:
    """The same of a map of labels to rows."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(classes)), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")


_POINTS = "p AS (SELECT l_suppkey AS series_id, CAST(l_quantity AS DOUBLE) AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS k FROM lineitem)"


@query(f"WITH {_POINTS} SELECT series_id, count(*) AS n, {r('sum(v * k)')} AS moment, {r('arg_min(v, k)')} AS first, {r('arg_max(v, k)')} AS last FROM p GROUP BY series_id")
def series_from_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of quantities for each supplier, in shipping order."""
    found = src.series_from_points(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "l_quantity")
    moment = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(found.select(F.col("l_suppkey").alias("series_id"), F.size("values").cast("long").alias("n"), moment.alias("moment"), F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last")))


@query(f"WITH {SERIES} SELECT series_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS seq, {r('unnest(v)')} AS value FROM s")
def points_from_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every series with its place."""
    return rounded(src.points_from_series(series(spark, sf_dir), ["series_id"]))


@query(
    f"WITH {SERIES} SELECT split, count(*) AS samples, count(DISTINCT label) AS classes, min(len(v)) AS min_length, max(len(v)) AS max_length, avg(len(v)) AS avg_length, {r('min(list_min(v))')} AS min_value, "
    f"{r('max(list_max(v))')} AS max_value, {r('sum(list_sum(v)) / sum(len(v))')} AS mean_value, {r('sqrt(sum(list_sum(list_transform(v, lambda x: x * x))) / sum(len(v)) - pow(sum(list_sum(v)) / sum(len(v)), 2))')} AS std_value, any_value(d) AS class_distribution FROM s JOIN {_CLASSES.format('split')} USING (split) GROUP BY split"
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.dataset_stats(series(spark, sf_dir)).withColumn("class_distribution", _listed("class_distribution")))


_INFO = f"count(*) AS samples, count(DISTINCT label) AS classes, min(len(v)) AS min_length, max(len(v)) AS max_length, {r('sum(list_sum(v)) / sum(len(v))')} AS mean_value, any_value(d) AS class_distribution"


@query(f"""WITH {SERIES} SELECT split, {_INFO} FROM s JOIN {_CLASSES.format('split')} USING (split) GROUP BY split UNION ALL SELECT 'overall', {_INFO} FROM s, {_CLASSES.format("'overall'")}""")
def write_dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each split and of all series written as JSON and read again."""
    path = src.write_dataset_info(series(spark, sf_dir), f"{_folder(spark)}/info")
    info = spark.read.schema("split string, samples long, classes long, min_length long, max_length long, mean_value double, class_distribution map<string,long>").json(path)
    return rounded(info.withColumn("class_distribution", _listed("class_distribution")))


@query(f"WITH {SERIES} SELECT split, label, count(*) AS n, {r('count(*) / sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY split)')} AS share FROM s GROUP BY split, label")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.class_distribution(series(spark, sf_dir), "split"))


#: Series with planted faults: labels of series divisible by 35 are new, series divisible by 21 are short, by 49 unlabelled.
_FAULTY = """f AS (SELECT series_id, split, CASE WHEN series_id % 49 = 0 THEN NULL WHEN series_id % 35 = 0 THEN 'x' || label ELSE label END AS label, CASE WHEN series_id % 21 = 0 THEN v[1:60] ELSE v END AS v FROM s)"""


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("series_id")
    label = F.when(i % 49 == 0, None).when(i % 35 == 0, F.concat(F.lit("x"), "label")).otherwise(F.col("label"))
    return series(spark, sf_dir).select("series_id", "split", label.alias("label"), F.when(i % 21 == 0, F.slice("values", 1, 60)).otherwise(F.col("values")).alias("values"))


@query(
    f"""WITH {SERIES}, {_FAULTY}, a AS (SELECT split, arg_min(len(v), series_id) AS n FROM f GROUP BY split)
SELECT 'error' AS severity, 'missing' AS "check", split, CAST(count(*) AS VARCHAR) AS detail FROM f WHERE label IS NULL OR v IS NULL GROUP BY split
UNION ALL SELECT 'warning', 'length', split, CAST(count(*) AS VARCHAR) FROM f JOIN a USING (split) WHERE len(v) <> n GROUP BY split
UNION ALL SELECT 'warning', 'unseen_label', 'test', label FROM (SELECT DISTINCT label FROM f WHERE split = 'test' AND label IS NOT NULL AND label NOT IN (SELECT label FROM f WHERE split = 'train' AND label IS NOT NULL))"""
)
def validate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.validate_series(_faulty(spark, sf_dir))


@query(
    f"""WITH {SERIES}, {_FAULTY}, a AS (SELECT split, arg_min(len(v), series_id) AS n FROM f GROUP BY split), e AS (SELECT count(DISTINCT split) AS errors FROM f WHERE label IS NULL OR v IS NULL),
w AS (SELECT (SELECT count(DISTINCT split) FROM f JOIN a USING (split) WHERE len(v) <> n) + (SELECT count(DISTINCT label) FROM f WHERE split = 'test' AND label NOT IN (SELECT label FROM f WHERE split = 'train' AND label IS NOT NULL)) AS warnings)
SELECT CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'warnings' ELSE 'passed' END AS status, errors, warnings FROM e, w"""
)
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.validation_status(profile.validate_series(_faulty(spark, sf_dir)))


@query(f"WITH {SERIES}, {_FAULTY} SELECT DISTINCT label FROM f WHERE split = 'test' AND label IS NOT NULL AND label NOT IN (SELECT label FROM f WHERE split = 'train' AND label IS NOT NULL)")
def unseen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.unseen_labels(_faulty(spark, sf_dir))


def draw_sql(*parts: object) -> str:
    """The integer of ``functions.scalars.draw`` in DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 8) AS BIGINT)"


@query(f"WITH {SERIES}, d AS (SELECT series_id, row_number() OVER (ORDER BY {draw_sql(42, 'series_id')}, series_id) AS k, count(*) OVER () AS n FROM s) SELECT series_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM d")
def split_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.split_series(series(spark, sf_dir)).select("series_id", "split")


@query(
    f"""WITH {SERIES}, d AS (SELECT series_id, label, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'series_id')}, series_id) AS k, count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS n FROM s)
SELECT series_id, label FROM d WHERE k <= greatest(1, floor(CAST(c AS DOUBLE) / n * least(50, n)))"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.stratified_sample(series(spark, sf_dir)).select("series_id", "label")


@query(f"WITH {SERIES}, d AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS k, count(*) OVER () AS n FROM s) SELECT series_id FROM d WHERE k % greatest(1, n // 50) = 0")
def every_nth_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.every_nth_series(series(spark, sf_dir)).select("series_id")


@query(f"WITH {SERIES}, {_FAULTY} SELECT count(*) AS shapelets, min(len(v)) AS min_length, max(len(v)) AS max_length, {r('avg(len(v))')} AS avg_length, {r('stddev_pop(len(v))')} AS std_length FROM f")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.length_summary(_faulty(spark, sf_dir)))
