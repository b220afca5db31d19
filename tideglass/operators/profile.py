"""Profiles, validation and sampling of labelled series (split, series_id, label, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.scalars import draw
from tideglass.operators.ordered import numbered


def dataset_stats(series: DataFrame) -> DataFrame:
    """One row for each split: sizes, statistics of all values, and class_distribution (a map of labels to rows).

    The deviation is merged from centred sums, so that large values lose nothing.
    """
    v = F.col("values")
    rows = series.select("split", "label", F.size(v).alias("n"), F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    points = series.select("split", F.explode(v).alias("x")).groupBy("split").agg(F.avg("x").alias("mean_value"), F.stddev_pop("x").alias("std_value"))
    classes = series.where("label is not null").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("class_distribution"))
    sizes = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("label").alias("classes"),
        F.min("n").cast("long").alias("min_length"),
        F.max("n").cast("long").alias("max_length"),
        F.avg("n").alias("avg_length"),
        F.min("low").alias("min_value"),
        F.max("high").alias("max_value"),
    )
    return sizes.join(points, "split", "left").join(classes, "split", "left")


def class_distribution(series: DataFrame, *keys: str) -> DataFrame:
    """Rows and share of each label (of each key)."""
    counts = series.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def unseen_labels(series: DataFrame) -> DataFrame:
    """Labels of the test split that the train split lacks; null is no label."""
    labels = lambda split: series.where((F.col("split") == split) & F.col("label").isNotNull()).select("label").distinct()
    return labels("test").join(labels("train"), "label", "left_anti")


def validate_series(series: DataFrame) -> DataFrame:
    """(severity, check, split, detail) of what is wrong; no row where all is well.

    Errors: rows without label or values, a split without rows. Warnings: rows
    whose length differs from the split's first row, labels only in the test split.
    """
    splits = series.sparkSession.createDataFrame([("train",), ("test",)], "split string")
    first = series.groupBy("split").agg(F.min_by(F.size("values"), "series_id").alias("first"))
    missing = series.where("label is null or values is null").groupBy("split").count().select(F.lit("error").alias("severity"), F.lit("missing").alias("check"), "split", F.col("count").cast("string").alias("detail"))
    empty = splits.join(series.select("split").distinct(), "split", "left_anti").select(F.lit("error"), F.lit("empty"), "split", F.lit("0"))
    ragged = series.join(F.broadcast(first), "split").where(F.size("values") != F.col("first")).groupBy("split").count().select(F.lit("warning"), F.lit("length"), "split", F.col("count").cast("string"))
    unseen = unseen_labels(series).select(F.lit("warning"), F.lit("unseen_label"), F.lit("test"), "label")
    return missing.union(empty).union(ragged).union(unseen)


def validation_status(issues: DataFrame) -> DataFrame:
    """One row (status, errors, warnings) of what ``validate_series`` found: failed with an error, warnings with a warning, else passed."""
    n = lambda kind: F.coalesce(F.sum((F.col("severity") == kind).cast("long")), F.lit(0).cast("long")).alias(kind + "s")
    status = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warnings").otherwise("passed")
    return issues.agg(n("error"), n("warning")).select(status.alias("status"), "errors", "warnings")


def split_series(series: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Exactly ``floor(n * ratio)`` rows as train, by the order of md5 draws; a null id comes first.

    Rows are numbered by a range sort, not in one task.
    """
    drawn = series.drop("split").withColumn("_draw", draw(seed, F.col("series_id")))
    ranked = numbered(drawn, ["_draw", "series_id"])
    n = ranked.count()
    return ranked.withColumn("split", F.when(F.col("ordinal") < int(n * ratio), "train").otherwise("test")).drop("_draw", "ordinal")


def ordinal(rows: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """``rows`` with their 0-based place in the whole order. ``bucket`` must not fall as the order rises; null is one.

    Rows are numbered inside each bucket, and the rows of bucket counts are summed
    up: for buckets that are few. ``ordered.numbered`` needs none.
    """
    rows = rows.withColumn("_bucket", bucket)
    before = rows.groupBy("_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    placed = rows.withColumn("_inside", inside).join(before.withColumnRenamed("_bucket", "_own"), F.col("_bucket").eqNullSafe(F.col("_own")))
    return placed.withColumn("ordinal", F.col("_before") + F.col("_inside")).drop("_bucket", "_own", "_before", "_inside")


def stratified_sample(series: DataFrame, cap: int = 50, seed: int = 42) -> DataFrame:
    """Per label ``max(1, floor(count / n * cap'))`` rows, cap' = min(cap, n), by md5 order; all if a label has no more. Null is a label."""
    by_label = Window.partitionBy("label").orderBy("_draw", "series_id")
    sizes = series.groupBy("label").agg(F.count(F.lit(1)).alias("_k"))
    n = sizes.agg(F.sum("_k")).first()[0] or 0
    sizes = sizes.withColumn("_take", F.greatest(F.lit(1), F.floor(F.col("_k") / F.lit(float(max(1, n))) * min(cap, n))))
    # no label takes more than the cap, which tasks cut before they shuffle
    rows = series.withColumn("_draw", draw(seed, F.col("series_id"))).withColumn("_nth", F.row_number().over(by_label)).where(F.col("_nth") <= max(1, cap))
    taken = rows.join(sizes.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label"))).where("_nth <= _take")
    return taken.drop("_draw", "_nth", "_label", "_k", "_take")


def every_nth_series(series: DataFrame, target: int = 50) -> DataFrame:
    """Rows whose place by series_id (null first) is a multiple of ``max(1, n // target)``."""
    n = series.count()
    placed = numbered(series, ["series_id"])
    return placed.where(F.col("ordinal") % max(1, n // target) == 0).drop("ordinal")


def length_summary(shapelets: DataFrame) -> DataFrame:
    """Shortest, longest, mean and population deviation of the lengths."""
    n = F.size("values")
    return shapelets.agg(F.count(F.lit(1)).alias("shapelets"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.avg(n).alias("avg_length"), F.stddev_pop(n.cast("double")).alias("std_length"))
