"""Pair tables of shapelets (id, values), their rankings and statistics.

Pairs come from blocks: shapelets are packed into blocks of ``BLOCK`` and block
meets block by an equal key, so that memory is two blocks a task. Matrices here
are bounded by ``cap_shapelets``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions import kernels
from tideglass.functions.scalars import rank_score, similarity
from tideglass.operators.ordered import numbered, quantiles
from tideglass.operators.profile import ordinal

MAX_SHAPELETS = 2_000
BLOCK = 256
PLACEHOLDER = -1.0
#: Ranges of scores, for each unit, that a ranking is numbered by.
RANGES = 1_024


def cap_shapelets(shapelets: DataFrame, cap: int = MAX_SHAPELETS) -> DataFrame:
    """The first ``cap`` shapelets by id; the rest is rejected."""
    return shapelets.orderBy("id").limit(cap)


def indexed(shapelets: DataFrame, cap: int | None = MAX_SHAPELETS) -> DataFrame:
    """The kept shapelets with their place i (from 0); at most ``cap`` rows, or all (None)."""
    if cap is None:
        return numbered(shapelets, ["id"], "i")
    return cap_shapelets(shapelets, cap).withColumn("i", (F.row_number().over(Window.orderBy("id")) - 1).cast("long"))


def _blocked(shapelets: DataFrame) -> DataFrame:
    return shapelets.groupBy(F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "values"))).alias("rows"))


def _similarities(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for left, right in zip(frame["left"], frame["right"], strict=True):
            i, j = (np.array([r["i"] for r in side]) for side in (left, right))
            a, b = ([np.asarray(r["values"], float) for r in side] for side in (left, right))
            if len({len(x) for x in [*a, *b]}) == 1:
                d = kernels.pair_distances(np.stack(a), np.stack(b))
            else:
                d = kernels.distances([x for x in a for _ in b], b * len(a)).reshape(len(a), len(b))
            at = np.argwhere(i[:, None] < j[None, :])
            yield pd.DataFrame({"i": i[at[:, 0]], "j": j[at[:, 1]], "value": 1 / (1 + d[at[:, 0], at[:, 1]])})


def upper_pairs(shapelets: DataFrame) -> DataFrame:
    """(i, j, value) for i < j: the similarity of every two of the given (i, values)."""
    left = _blocked(shapelets)
    number = left.agg(F.max("block")).first()[0]
    if number is None:
        return shapelets.sparkSession.createDataFrame([], "i long, j long, value double")
    right = left.select(F.col("block").alias("other"), F.col("rows").alias("right"))
    met = left.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(number)))).join(right, "other").select(F.col("rows").alias("left"), "right")
    return met.repartition(met.sparkSession.sparkContext.defaultParallelism).mapInPandas(_similarities, "i long, j long, value double")


def pairwise_similarity(shapelets: DataFrame) -> DataFrame:
    """All cells (i, j, value): symmetric, 1 on the diagonal."""
    upper = upper_pairs(shapelets)
    return upper.union(upper.select("j", "i", "value")).union(shapelets.select("i", F.col("i").alias("j"), F.lit(1.0)))


def rank_by_similarity(reference: Column, shapelets: DataFrame) -> DataFrame:
    """(rank, i, sim): shapelets by falling similarity to one reference, ties by place."""
    scored = shapelets.select("i", similarity(reference, F.col("values")).alias("sim"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("sim", 9)), "i")))


def init_pairs(shapelets: DataFrame, first: Column) -> DataFrame:
    """The cells that a new matrix fills: diagonal 0, row 0 rank scores, column 0 similarities to ``first``, the values of shapelet 0."""
    sims = shapelets.where("i > 0").select("i", similarity(first, F.col("values")).alias("sim"))
    zero = F.lit(0).cast("long")
    return shapelets.select("i", F.col("i").alias("j"), F.lit(0.0).alias("value")).union(sims.select(zero, "i", rank_score(F.col("sim")))).union(sims.select("i", zero, "sim"))


def build_ranking(upper: DataFrame, cells: DataFrame) -> DataFrame:
    """(rank, i, j, score) of all ordered pairs: the stored cell where it is not below 0, else the pair's rank score."""
    both = upper.union(upper.select("j", "i", "value")).withColumn("score", rank_score(F.col("value"))).drop("value")
    scored = both.join(cells, ["i", "j"], "left").select("i", "j", F.when(F.col("value") >= 0, F.col("value")).otherwise(F.col("score")).alias("score"))
    return ranked(scored)


def ranked(scored: DataFrame) -> DataFrame:
    """Rank by falling score, ties by (i, j), numbered by ranges of scores: NaN first, null last, as they sort."""
    score = F.round("score", 9)
    place = F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(F.coalesce(-F.floor(score * RANGES).cast("double"), F.lit(float("inf"))))
    return ordinal(scored, [F.desc(score), "i", "j"], place).withColumn("rank", (F.col("ordinal") + 1).cast("int")).drop("ordinal")


def add_shapelets(cells: DataFrame, old: DataFrame, new: DataFrame, first: Column) -> DataFrame:
    """Cells after adding ``new`` shapelets, whose places follow those of ``old``.

    Each new one is compared to all before it, symmetrically; a value that is not
    finite becomes the placeholder; cell (0, new) is the rank score.
    """
    upper = upper_pairs(old.select("i", "values").union(new.select("i", "values"))).join(F.broadcast(new.select(F.col("i").alias("j"))), "j").select("i", "j", "value")
    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(PLACEHOLDER)).otherwise(F.col("value"))
    upper = upper.select("i", "j", value.alias("value"))
    above = upper.select("i", "j", F.when((F.col("i") == 0) & (F.col("value") >= 0), rank_score(F.col("value"))).otherwise(F.col("value")).alias("value"))
    added = above.union(upper.select("j", "i", "value")).union(new.select("i", F.col("i").alias("j"), F.lit(0.0)))
    return cells.unionByName(added.join(cells.select("i", "j"), ["i", "j"], "left_anti"))


def update_ranking(old: DataFrame, cells: DataFrame, upper_new: DataFrame) -> DataFrame:
    """Old entries keep their stored cell (placeholders sink); new ones (existing, new) get rank scores; all are ranked anew."""
    kept = old.select("i", "j").join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(PLACEHOLDER)).alias("score"))
    return ranked(kept.union(upper_new.select("i", "j", rank_score(F.col("value")))))


def top_k_pairs(ranking: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The first k ranks whose cells are filled: fewer than k where some are placeholders; none for k <= 0."""
    best = ranking.where(F.col("rank") <= max(0, k))
    return best.join(cells, ["i", "j"]).where("value >= 0").select("rank", "i", "j", "value")


def pair_stats(cells: DataFrame) -> DataFrame:
    """Count, mean, population deviation, extremes and median of the filled cells above the diagonal."""
    v = cells.where("i < j and value >= 0")
    return v.agg(F.count("value").alias("pairs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high")).withColumn("median", F.lit(quantiles(v, "value", [0.5])[0]).cast("double"))


def pair_distribution(cells: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, low, n, cdf, q1, median, q3): histogram of the cells above 0 over their range, with the cumulative share and, on each row, the quartiles of all."""
    v = cells.where("value > 0")
    quartiles = [F.lit(q).cast("double").alias(name) for q, name in zip(quantiles(v, "value", [0.25, 0.5, 0.75]), ("q1", "median", "q3"), strict=True)]
    facts = v.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n")).first()
    lo, hi = (F.lit(facts[k] or 0.0).cast("double") for k in ("lo", "hi"))
    place = F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins))).otherwise(0).cast("int")
    counts = v.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    cdf = F.sum("n").over(Window.orderBy("bin")) / F.lit(float(max(1, facts["n"])))
    return counts.select("bin", (lo + F.col("bin") * (hi - lo) / bins).alias("low"), "n", cdf.alias("cdf"), *quartiles)


def snapshot_evolution(snapshots: DataFrame) -> DataFrame:
    """Per snapshot: shapelets, cells, share of placeholders, mean of the filled cells off the diagonal, and its change."""
    filled = F.when((F.col("value") >= 0) & (F.col("i") != F.col("j")), F.col("value"))
    per = snapshots.groupBy("snapshot_id").agg(
        (F.max("i") + 1).alias("shapelets"), F.count(F.lit(1)).alias("cells"), F.avg(F.when(F.col("value") < 0, 1.0).otherwise(0.0)).alias("placeholder_share"), F.coalesce(F.avg(filled), F.lit(0.0)).alias("mean_value")
    )
    return per.withColumn("change", F.col("mean_value") - F.lag("mean_value").over(Window.orderBy("snapshot_id")))


def top_rankings_per_snapshot(snapshots: DataFrame, n: int = 5) -> DataFrame:
    """The n best filled pairs above the diagonal of each snapshot."""
    order = Window.partitionBy("snapshot_id").orderBy(F.desc(F.round("value", 9)), "i", "j")
    return snapshots.where("i < j and value >= 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("snapshot_id", "place", "i", "j", "value")
