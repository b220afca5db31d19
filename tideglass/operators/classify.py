"""Training from series to a model, and labels for whole or growing series by cache and forest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.operators import extract, forest, match, pairs
from tideglass.shared import materialise

#: Confidence of a shapelet that was never matched.
NEW_CONFIDENCE = 0.5


@dataclass
class Model:
    """What training leaves, as written tables: shapelets (i, id, label, info_gain, values), forest nodes, and the cache."""

    shapelets: DataFrame
    nodes: DataFrame
    cache: DataFrame


def cache_rows(shapelets: DataFrame, at: Column, discriminative: Column) -> DataFrame:
    """Shapelets (i, label, values) as new rows of the cache: values normalised as prefixes are, no match yet."""
    zero = F.lit(0).cast("long")
    return shapelets.select(
        F.col("i").alias("shapelet_id"),
        "label",
        match.prefix_normalise(F.col("values")).alias("values"),
        F.size("values").alias("length"),
        F.lit(NEW_CONFIDENCE).alias("confidence"),
        at.alias("created_at"),
        at.alias("last_accessed"),
        zero.alias("usage_count"),
        zero.alias("total_matches"),
        zero.alias("successful_matches"),
        F.lit(0.0).alias("success_rate"),
        discriminative.cast("double").alias("discriminative_score"),
    )


def train(series: DataFrame, at: str, n_trees: int = 10, seed: int = 42) -> Model:
    """Shapelets extracted from labelled series, a forest grown on them, and the cache that they start with."""
    found = extract.extract_shapelets(series, seed=seed).select(F.col("candidate_id").alias("id"), "label", "info_gain", "values")
    shapelets = materialise(pairs.indexed(found), "trained_shapelets")
    nodes = materialise(forest.train_forest(shapelets, n_trees, seed), "trained_forest")
    return Model(shapelets, nodes, materialise(cache_rows(shapelets, F.lit(at).cast("timestamp"), F.col("info_gain")), "trained_cache"))


def early_rows(decisions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Predictions of early decisions (series_id, length, predicted_label, confidence) of series of ``expected`` values."""
    ratio = F.col("length") / F.col("expected")
    return decisions.join(sizes, "series_id").select("series_id", "predicted_label", "confidence", F.lit("early").alias("method"), match.earliness(ratio).alias("earliness"), ratio.alias("observation_ratio"))


def voted_rows(series: DataFrame, nodes: DataFrame, shapelets: DataFrame) -> DataFrame:
    """Predictions of whole series by the forest's vote: nothing is saved of the series."""
    voted = forest.vote(forest.predict_trees(series, nodes, shapelets))
    return voted.select("series_id", F.col("label").alias("predicted_label"), "confidence", F.lit("forest").alias("method"), F.lit(0.0).alias("earliness"), F.lit(1.0).alias("observation_ratio"))


def classify(series: DataFrame, model: Model, as_of: str, threshold: float = 0.6, least_confidence: float = 0.7, asked_label: Column | None = None) -> DataFrame:
    """(series_id, predicted_label, confidence, method, earliness, observation_ratio) of every series (series_id, values).

    The shortest prefix that matches the cache decides; a series without one gets
    the forest's vote on all its values. ``asked_label`` names a label whose
    shapelets are asked first.
    """
    asked = F.lit(None).cast("string") if asked_label is None else asked_label
    queries = match.prefixes(series.select("series_id", asked.alias("asked_label"), "values"))
    early = materialise(match.early_decision(queries, model.cache, as_of, threshold, least_confidence), "early_decisions")
    late = series.join(early.select("series_id"), "series_id", "left_anti").select("series_id", "values")
    return early_rows(early, series.select("series_id", F.size("values").alias("expected"))).unionByName(voted_rows(late, model.nodes, model.shapelets))
