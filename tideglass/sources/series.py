"""Reading, building and writing labelled series: (dataset, split, series_id, label, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tideglass.operators.profile import dataset_stats, ordinal


def read_labelled_series(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Header-less TSV or CSV files of a dataset, label first; TRAIN or TEST in the name gives the split.

    Raises FileNotFoundError without a pair of both. ``series_id`` follows file
    name and row order inside a split.
    """
    try:
        lines = spark.read.text(f"{root}/{dataset}", recursiveFileLookup=True)
    except AnalysisException as e:
        raise FileNotFoundError(f"no dataset {dataset}") from e
    name = F.upper(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    folder = F.upper(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    kind = F.concat_ws("/", folder, name)
    rows = lines.select(
        F.when(kind.contains("TRAIN"), "train").when(kind.contains("TEST"), "test").alias("split"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"),
        F.split(F.trim("value"), F.when(name.contains(".CSV"), ",").otherwise("\t")).alias("cells"),
    ).where("split is not null and size(cells) > 1")
    if rows.select("split").distinct().count() < 2:
        raise FileNotFoundError(f"dataset {dataset} needs a TRAIN and a TEST file")
    # numbered by files, whose sizes are then summed up
    numbered = [ordinal(rows.where(F.col("split") == split), ["place"], F.struct("place.file_path", "place.file_block_start")) for split in ("train", "test")]
    return numbered[0].unionByName(numbered[1]).select(
        F.lit(dataset).alias("dataset"),
        "split",
        F.col("ordinal").cast("long").alias("series_id"),
        F.col("cells")[0].alias("label"),
        F.transform(F.slice("cells", 2, F.size("cells") - 1), lambda x: F.trim(x).try_cast("double")).alias("values"),
    )


def select_datasets(series: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Datasets by list, exclusion, regular expression and number (the first names)."""
    if include is not None:
        series = series.where(F.col("dataset").isin(include))
    if exclude:
        series = series.where(~F.col("dataset").isin(exclude))
    if pattern:
        series = series.where(F.col("dataset").rlike(pattern))
    if limit is not None:
        series = series.join(F.broadcast(series.select("dataset").distinct().orderBy("dataset").limit(limit)), "dataset", "left_semi")
    return series


def series_from_points(points: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One row for each key: its values in order. A series must fit one row."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_value"))))
    return points.groupBy(*keys).agg(F.transform(rows, lambda r: r["_value"]).alias("values"))


def points_from_series(series: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """One row for each value: keys, seq (from 0), value."""
    return series.select(*keys, F.posexplode(values).alias("seq", "value"))


def synthetic_series(spark: SparkSession, n: int, length: int, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """class_A: sine over [0, 4 pi], class_B: cosine, class_C: a line from 0 to 1, each with normal noise; remainders go to the first classes."""
    kind = (F.col("id") % 3).cast("int")
    step = F.lit(1.0 / max(1, length - 1))
    at = F.sequence(F.lit(0), F.lit(length - 1))
    shapes = F.when(kind == 0, F.transform(at, lambda i: F.sin(i * step * F.lit(4 * 3.141592653589793)))).when(kind == 1, F.transform(at, lambda i: F.cos(i * step * F.lit(4 * 3.141592653589793)))).otherwise(F.transform(at, lambda i: i * step))
    rows = spark.range(n).select(F.col("id").alias("series_id"), F.element_at(F.array(*map(F.lit, ("class_A", "class_B", "class_C"))), kind + 1).alias("label"), shapes.alias("values"))
    if not noise:
        return rows
    points = rows.select("series_id", "label", F.posexplode("values").alias("seq", "value")).withColumn("value", F.col("value") + F.lit(noise) * normal(seed, F.col("series_id"), F.col("seq")))
    return series_from_points(points, ["series_id", "label"], ["seq"], "value")


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal draw that depends on the seed and the parts alone."""
    u, v = ((F.shiftrightunsigned(F.xxhash64(F.lit(seed + k), *parts), 11).cast("double") + 0.5) / float(1 << 53) for k in (0, 1))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def read_or_synthesise(spark: SparkSession, root: str, dataset: str, use_synthetic: bool = True, n: int = 50, length: int = 100, seed: int = 0) -> DataFrame:
    """The dataset's files, or synthetic train and test splits where they are missing and that is allowed."""
    try:
        return read_labelled_series(spark, root, dataset)
    except FileNotFoundError:
        if not use_synthetic:
            raise
    parts = [synthetic_series(spark, k, length, seed=s).select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "series_id", "label", "values") for split, k, s in (("train", n, seed), ("test", max(1, 2 * n // 5), seed + 100))]
    return parts[0].unionByName(parts[1])


def write_rows(rows: DataFrame, path: str, form: str = "parquet") -> str:
    """Pairs, rankings or statistics as parquet, csv or json; another form raises ValueError."""
    if form not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown form {form}")
    rows.write.mode("overwrite").format(form).option("header", True).save(path)
    return path


def write_dataset_info(series: DataFrame, path: str) -> str:
    """The statistics of each split, and of all series as the split ``overall``, as JSON."""
    return write_rows(dataset_stats(series).unionByName(dataset_stats(series.withColumn("split", F.lit("overall")))), path, "json")


def write_snapshot(pairs: DataFrame, path: str, snapshot_id: int, operation: str, meta: dict[str, str]) -> None:
    """Append a numbered snapshot of pairs with its operation and metadata; writing an id again replaces it."""
    note = F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]) if meta else F.create_map().cast("map<string,string>")
    rows = pairs.select("*", F.lit(operation).alias("operation"), F.to_json(note).alias("meta"))
    rows.write.mode("overwrite").parquet(f"{path}/snapshot_id={snapshot_id}")


def read_snapshot(spark: SparkSession, path: str, snapshot_id: int) -> DataFrame | None:
    """A snapshot's rows, or None without one of that id."""
    found = spark.read.parquet(path).where(F.col("snapshot_id") == snapshot_id)
    return found if found.limit(1).count() else None


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id) in order."""
    return spark.read.parquet(path).select("snapshot_id").distinct().orderBy("snapshot_id")
