"""Shapelet extraction: candidates, distances, thresholds, gains, and a diverse choice.

Series have (series_id, label, values); candidates (candidate_id, series_id,
start, length, label, values).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tideglass.functions import kernels
from tideglass.functions.scalars import draw, pop_std, z_normalise
from tideglass.operators.ordered import sums_before
from tideglass.operators.profile import every_nth_series, stratified_sample
from tideglass.shared import discard, materialise

MAX_CANDIDATES, KEPT, SAMPLED = 50_000, 200, 50
#: Candidates of one length that a task measures together.
CANDIDATE_BLOCK = 256


def length_range(series: DataFrame) -> DataFrame:
    """(min_length, max_length): a tenth of the shortest series, at least 5; half of the longest, at most 50."""
    n = F.size("values")
    return series.agg(F.greatest(F.lit(5), F.floor(F.min(n) * 0.1)).cast("int").alias("min_length"), F.least(F.lit(50), F.floor(F.max(n) * 0.5)).cast("int").alias("max_length"))


def subsequence_candidates(series: DataFrame, low: int, high: int, least_std: float = 0.01, most: int | None = MAX_CANDIDATES) -> DataFrame:
    """Subsequences of each length in [low, high] shorter than the series, from every (length // 2)-th start, z-normalised.

    Near-constant ones are left out. With ``most``, series in id order give
    candidates until more than that many are there.
    """
    lengths = series.select("series_id", "label", "values", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("length")).where(F.col("length") < F.size("values"))
    starts = F.sequence(F.lit(0), F.size("values") - F.col("length"), F.greatest(F.lit(1), F.floor(F.col("length") / 2)).cast("int"))
    cut = lengths.select("series_id", "label", "length", F.explode(starts).alias("start"), "values").withColumn("values", F.slice("values", F.col("start") + 1, F.col("length")))
    kept = cut.where(pop_std(F.col("values")) >= least_std)
    if most is not None:
        counts = sums_before(kept.groupBy("series_id").count(), "series_id", "count", "before")
        chosen = counts.where(F.col("before") <= most).select(F.col("series_id").alias("_id"))
        kept = kept.join(chosen, F.col("series_id").eqNullSafe(F.col("_id")), "left_semi")
    name = F.concat_ws("-", "series_id", "length", "start")
    return kept.select(name.alias("candidate_id"), "series_id", "start", "length", "label", z_normalise(F.col("values")).alias("values"))


def min_distances(candidates: DataFrame, series: DataFrame, rule: str = "strided", block: int = 64) -> DataFrame:
    """(candidate_id, series_id, label, distance) of every candidate to every series.

    A task measures blocks of candidates of one length against blocks of series;
    series are dealt into numbered blocks and every block of candidates meets
    each number once.
    """
    number = max(1, -(-series.count() // block))
    blocks = series.withColumn("block", F.pmod(F.xxhash64("series_id"), F.lit(number)).cast("int"))
    packed = blocks.groupBy("block").agg(F.collect_list(F.struct("series_id", "label", "values")).alias("series"))
    numbers = packed.select(F.max("block").alias("n")).first()["n"]
    if numbers is None:
        return candidates.sparkSession.createDataFrame([], "candidate_id string, series_id long, label string, distance double")
    parts = candidates.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK).alias("parts"))
    placed = candidates.join(F.broadcast(parts), "length")  # one row for each length
    groups = placed.groupBy("length", F.pmod(F.xxhash64("candidate_id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("candidate_id", "values")).alias("candidates"))
    met = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(numbers)))).join(packed, "block")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for some, others in zip(frame["candidates"], frame["series"], strict=True):
                ids = np.array([c["candidate_id"] for c in some], object)
                shapelets = np.stack([np.asarray(c["values"], float) for c in some])
                found = [kernels.znorm_min_dist(shapelets, np.asarray(s["values"], float), rule) for s in others]
                repeated = {k: np.repeat(np.array([s[k] for s in others], object), len(ids)) for k in ("series_id", "label")}
                yield pd.DataFrame({"candidate_id": np.tile(ids, len(others)), **repeated, "distance": np.concatenate(found)}).astype({"series_id": "int64"})

    return met.mapInPandas(measure, "candidate_id string, series_id long, label string, distance double")


def percentile_thresholds(distances: DataFrame) -> DataFrame:
    """(candidate_id, threshold): the 20, 40, 50, 60 and 80 % points of 1 / (1 + distance), or fixed ones for a narrow range."""
    sim = 1 / (1 + F.col("distance"))
    points = F.percentile(sim, F.array(*[F.lit(p) for p in (0.2, 0.4, 0.5, 0.6, 0.8)]))
    per = distances.groupBy("candidate_id").agg(points.alias("p"), (F.max(sim) - F.min(sim)).alias("range"))
    fixed = F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7)])
    return per.select("candidate_id", F.explode(F.when(F.col("range") > 0.01, F.col("p")).otherwise(fixed)).alias("threshold"))


def candidate_info_gain(distances: DataFrame, least: int = 2) -> DataFrame:
    """(candidate_id, info_gain): the best gain of any threshold with at least ``least`` rows on each side; 0 without one.

    The distances are measured once and written, as thresholds and gains both read them.
    """
    distances = materialise(distances, "distances")
    sim = 1 / (1 + F.col("distance"))
    sides = distances.join(percentile_thresholds(distances).distinct(), "candidate_id").select("candidate_id", "threshold", "label", F.when(sim >= F.col("threshold"), 1).otherwise(0).alias("left"))
    return best_gain(sides, ["candidate_id"], least).select("candidate_id", F.greatest(F.lit(0.0), "info_gain").alias("info_gain"))


def gains(sides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, n_left, n_right, gain) from rows (keys, threshold, label, left 0/1)."""
    return gains_of_counts(sides.groupBy(*keys, "threshold", "label").agg(F.sum("left").alias("l"), F.sum(1 - F.col("left")).alias("r")), keys)


def gains_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The same from counted rows (keys, threshold, label, l, r)."""

    def part(c: str) -> tuple:
        n = F.sum(c)
        return n, F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c).cast("double"))).otherwise(0.0))

    nl, sl = part("l")
    nr, sr = part("r")
    whole = counts.withColumn("a", F.col("l") + F.col("r")).groupBy(*keys, "threshold").agg(nl.alias("n_left"), nr.alias("n_right"), sl.alias("sl"), sr.alias("sr"), F.sum(F.col("a") * F.log2(F.col("a").cast("double"))).alias("sa"))

    def entropy(n, s):
        return F.when(n > 0, F.log2(n.cast("double")) - s / n).otherwise(0.0)

    n = F.col("n_left") + F.col("n_right")
    gain = entropy(n, F.col("sa")) - F.col("n_left") / n * entropy(F.col("n_left"), F.col("sl")) - F.col("n_right") / n * entropy(F.col("n_right"), F.col("sr"))
    return whole.select(*keys, "threshold", "n_left", "n_right", gain.alias("gain"))


def best_gain(sides: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, info_gain): the highest gain with enough rows on both sides, else 0."""
    enough = (F.col("n_left") >= least) & (F.col("n_right") >= least)
    return gains(sides, keys).groupBy(*keys).agg(F.coalesce(F.max(F.when(enough, F.col("gain"))), F.lit(0.0)).alias("info_gain"))


def informative_candidates(scored: DataFrame, least: float = 0.01) -> DataFrame:
    """Candidates of more gain than ``least``, best first."""
    return scored.where(F.col("info_gain") > least).orderBy(F.desc("info_gain"), "candidate_id")


def diverse_top(scored: DataFrame, keys: list[str], k: int = KEPT, against: int = 50, most_similar: float = 0.95, pool: int = 2_000) -> DataFrame:
    """Greedy choice down each key's ranking (candidate_id, info_gain, values): no more than ``most_similar`` to any of
    the first ``against`` chosen, at most k. Null keys are keys.

    Only the first ``against`` chosen reject others. They are chosen one after
    another, from ``pool`` candidates of a key at a time, and after each round all
    tasks drop what is too similar to them, so that a round chooses one at least.
    Once they stand, what they have not dropped follows by rank.
    """
    order = Window.partitionBy("_key").orderBy(F.desc(F.round("info_gain", 9)), "candidate_id")
    columns = [*scored.columns, "place"]
    keyed = scored.withColumn("_key", F.to_json(F.struct(*keys)))
    rest = materialise(keyed.withColumn("place", F.row_number().over(order)), "ranked")
    first, far = min(against, k), 1 / most_similar - 1

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        # warping meets both ends, so ends far apart need no warping
        if len(x) != len(y) and abs(x[0] - y[0]) + (abs(x[-1] - y[-1]) if len(x) > 1 < len(y) else 0) > far + 1e-9:
            return False
        return 1 / (1 + kernels.distance(x, y)) > most_similar

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        held = int(frame["chosen"].iloc[0])
        chosen, rows = [], []
        for at, values in enumerate(frame["values"]):
            x = np.asarray(values, float)
            if held + len(chosen) < first and not any(alike(x, y) for y in chosen):
                chosen.append(x)
                rows.append(at)
        return frame.iloc[rows].drop(columns="chosen")

    @F.pandas_udf(BooleanType())
    def unlike(values: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([not any(alike(np.asarray(x, float), np.asarray(y, float)) for y in ys) for x, ys in zip(values, others, strict=True)], dtype=bool)

    chosen = rest.limit(0)
    while True:
        counts = chosen.groupBy("_key").agg(F.count(F.lit(1)).alias("chosen"))
        open_rows = rest.join(counts, "_key", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0))).where(F.col("chosen") < first)
        part = open_rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("place"))).where(F.col("_nth") <= pool).drop("_nth")
        more = materialise(part.groupBy("_key").applyInPandas(choose, rest.schema), "chosen_more")
        if not more.limit(1).count():
            break
        chosen = materialise(chosen.unionByName(more), "chosen")
        # at most ``against`` rows of each key, in one array
        new = more.groupBy("_key").agg(F.collect_list("values").alias("others"), F.max("place").alias("_seen"))
        # a key without new ones is full, and its rest was looked at when it became so
        looked = rest.join(chosen.select("_key", "place"), ["_key", "place"], "left_anti").join(new, "_key", "left")
        kept = looked.where(F.col("others").isNull() | unlike("values", F.coalesce("others", F.array().cast("array<array<double>>"))))
        left = materialise(kept.select(rest.columns), "ranked_rest")
        discard(rest, more)
        rest = left
    counts = chosen.groupBy("_key").agg(F.count(F.lit(1)).alias("chosen"))
    following = rest.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("place"))).where(F.col("_nth") <= k).join(counts, "_key").where(F.col("_nth") <= k - F.col("chosen"))
    result = materialise(chosen.select(columns).unionByName(following.select(columns)), "diverse")
    discard(chosen, rest)
    return result


def fallback_shapelets(series: DataFrame, seed: int = 42, number: int = 50) -> DataFrame:
    """min(number, n) random subsequences of 5 to 20 % of a series' length (5 to 20 points), by md5 draws."""
    n = F.size("values")
    low, high = F.greatest(F.lit(5), F.floor(n * 0.05)).cast("int"), F.least(F.lit(20), F.floor(n * 0.2)).cast("int")
    picked = series.withColumn("draw", draw(seed, F.col("series_id"))).orderBy("draw", "series_id").limit(number)
    length = (low + draw(seed + 1, F.col("series_id")) % F.greatest(F.lit(1), high - low + 1)).cast("int")
    cut = picked.withColumn("length", length).withColumn("start", (draw(seed + 2, F.col("series_id")) % F.greatest(F.lit(1), n - F.col("length") + 1)).cast("int"))
    part = F.slice("values", F.col("start") + 1, F.col("length"))
    return cut.where(pop_std(part) > 0.01).select("series_id", "label", "start", "length", z_normalise(part).alias("values"))


def grid_info_gain(pairs: DataFrame, keys: list[str], least: int = 2, steps: int = 17, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(keys, threshold, info_gain) over an even grid of thresholds from rows (keys, label, value): the lowest best one; (0.5, 0) without any."""
    grid = F.array(*[F.lit(round(low + (high - low) * i / (steps - 1), 10)) for i in range(steps)])
    sides = pairs.select(*keys, "label", "value", F.explode(grid).alias("threshold")).withColumn("left", F.when(F.col("value") >= F.col("threshold"), 1).otherwise(0))
    enough = (F.col("n_left") >= least) & (F.col("n_right") >= least) & (F.round("gain", 9) > 0)
    best = F.max(F.when(enough, F.struct(F.round("gain", 9).alias("g"), (-F.col("threshold")).alias("t"), F.col("gain").alias("gain"))))
    return gains(sides, keys).groupBy(*keys).agg(best.alias("b")).select(*keys, F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"), F.coalesce("b.gain", F.lit(0.0)).alias("info_gain"))


def select_high_quality(pairs: DataFrame, least_gain: float = 0.01) -> DataFrame:
    """Shapelets i of rows (i, label, value) with enough grid gain; all, if there are fewer than three."""
    if pairs.select("i").distinct().limit(3).count() < 3:
        return pairs.select("i").distinct()
    return grid_info_gain(pairs, ["i"]).where(F.col("info_gain") >= least_gain).select("i")


def extract_shapelets(series: DataFrame, low: int | None = None, high: int | None = None, seed: int = 42) -> DataFrame:
    """(candidate_id, label, length, info_gain, values): ranges, sampling, candidates, distances, gains, diverse choice.

    Every n-th series gives candidates and a stratified sample measures them, one
    sample for all. Random subsequences stand in where nothing is informative.
    """
    bounds = length_range(series).first()
    if bounds["min_length"] is None:
        return series.sparkSession.createDataFrame([], "candidate_id string, label string, length int, info_gain double, values array<double>")
    found = subsequence_candidates(every_nth_series(series), low or bounds["min_length"], high or bounds["max_length"])
    scored = candidate_info_gain(min_distances(found, stratified_sample(series, SAMPLED, seed)))
    best = informative_candidates(scored).join(found, "candidate_id").withColumn("all", F.lit(1))
    chosen = diverse_top(best, ["all"]).select("candidate_id", "label", "length", "info_gain", "values")
    if chosen.limit(1).count():
        return chosen
    return fallback_shapelets(series, seed).select(F.concat_ws("-", F.lit("r"), "series_id").alias("candidate_id"), "label", "length", F.lit(0.0).alias("info_gain"), "values")
