"""Shapelet cache and early matching.

Cache rows: shapelet_id, label, values, length, confidence, created_at,
last_accessed, usage_count, total_matches, successful_matches, success_rate,
discriminative_score. Queries: series_id, length, values (a normalised prefix).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tideglass.functions import kernels
from tideglass.functions.scalars import prefix_normalise
from tideglass.operators.drift import LastRows
from tideglass.operators.ordered import folded_ends, scanned
from tideglass.shared import discard, materialise

CACHE_SIZE, LOOKBACK = 200, 10


def cache_tiers(cache: DataFrame, cache_size: int = CACHE_SIZE, lookback: int = LOOKBACK) -> DataFrame:
    """Cache rows by tier: ring (the latest), label (the best of each label), quality (the best of all), recent.

    Each window keeps a bounded number of rows, which tasks cut before they shuffle.
    """

    def best(name: str, window, most: int) -> DataFrame:
        return cache.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= most).drop("_nth").withColumn("tier", F.lit(name))

    latest = Window.orderBy(F.desc("created_at"), F.desc("shapelet_id"))
    of_label = Window.partitionBy("label").orderBy(F.desc("success_rate"), F.desc("confidence"), F.desc("last_accessed"), "shapelet_id")
    quality = Window.orderBy(F.desc("success_rate"), F.desc("confidence"), F.desc("discriminative_score"), "shapelet_id")
    return (
        best("ring", latest, cache_size)
        .unionByName(best("label", of_label, cache_size // 4))
        .unionByName(best("quality", quality, max(10, cache_size // 5)))
        .unionByName(best("recent", latest, 2 * lookback))
    )


def length_candidates(queries: DataFrame, tiers: DataFrame) -> DataFrame:
    """Query and cache row pairs whose cache length is 0.7 to 1.3 times the query's, from the label, quality and recent tiers.

    The range becomes an equal join of powers of two, of which it meets two or three,
    however long a query is. A query with a null label asks no label tier. Rows that
    several tiers hold stay one for each tier.
    """
    low, high = F.floor(F.col("length") * 0.7).cast("int"), F.floor(F.col("length") * 1.3).cast("int")
    power = lambda n: F.length(F.bin(F.greatest(n, F.lit(1)).cast("long")))
    wanted = queries.withColumn("_power", F.explode(F.sequence(power(low), power(high))))
    held = tiers.where("tier <> 'ring'").select(*[F.col(c).alias(f"c_{c}") for c in tiers.columns], power(F.col("length")).alias("_power"))
    met = wanted.join(held, "_power").where(F.col("c_length").between(low, high)).drop("_power")
    return met.where("c_tier <> 'label' or c_label = asked_label")


def candidate_score(success: Column, confidence: Column, discriminative: Column, age_seconds: Column, same_label: Column) -> Column:
    return 0.3 * success + 0.2 * confidence + 0.2 * discriminative + 0.15 / (1 + age_seconds / 3600) + F.when(same_label, 0.15).otherwise(0.0)


def scored_candidates(queries: DataFrame, tiers: DataFrame, as_of: str) -> DataFrame:
    """Length candidates without duplicates, each with its score at the time ``as_of``."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("c_last_accessed").cast("timestamp"))).cast("double")
    score = candidate_score(F.col("c_success_rate"), F.col("c_confidence"), F.col("c_discriminative_score"), age, F.coalesce(F.col("c_label") == F.col("asked_label"), F.lit(False)))
    return length_candidates(queries, tiers).drop("c_tier").dropDuplicates(["series_id", "length", "c_shapelet_id"]).withColumn("score", score)


def top_candidates(scored: DataFrame, lookback: int = LOOKBACK, least: float = 0.1) -> DataFrame:
    """The best ``lookback`` candidates of each query above the least score, ties by id."""
    order = Window.partitionBy("series_id", "length").orderBy(F.desc(F.round("score", 9)), "c_shapelet_id")
    return scored.where(F.col("score") > least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= lookback)


#: What a candidate brings to a query besides its values.
CARRIED = ("shapelet_id", "label", "confidence", "success_rate", "discriminative_score")
#: Bytes of candidates that are sent to all tasks.
MOST_SENT = 64 << 20


def _lists(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each list among the array's values."""
    ends = x.offsets.to_numpy().astype(np.int64)
    return ends[:-1], np.diff(ends)


@F.arrow_udf(StructType([StructField("place", IntegerType()), StructField("sim", DoubleType())]))
def _most_similar(values: pa.Array, others: pa.Array) -> pa.Array:
    (first, number), (start, length), (other_start, other_length) = _lists(others), _lists(values), _lists(others.values)
    owner = np.repeat(np.arange(len(first)), number)
    at = np.concatenate([np.arange(0), *(np.arange(f, f + n) for f, n in zip(first.tolist(), number.tolist(), strict=True))])
    sides = ((x.to_numpy(zero_copy_only=False), s[k], n[k]) for x, s, n, k in ((values.values, start, length, owner), (others.values.values, other_start, other_length, at)))
    place, sim = np.full(len(first), -1, np.int32), np.full(len(first), np.nan)
    asked, pair, found = kernels.most_similar(*sides, owner)
    place[asked], sim[asked] = at[pair] - first[asked], found
    return pa.StructArray.from_arrays([pa.array(place), pa.array(sim)], ["place", "sim"])


def asked_candidates(queries: DataFrame, tiers: DataFrame, as_of: str) -> DataFrame:
    """(asked_label, length, rows): the top candidates, in their places, of each two that queries ask with, as a written table.

    Which candidates a query has follows from its label and length alone, so they are
    found once for all queries that share them; values are joined to the chosen ones only.
    """
    held = materialise(tiers.where("tier <> 'ring'").withColumn("row", F.monotonically_increasing_id()), "match_tiers")
    asked = queries.select("asked_label", "length").distinct().withColumn("series_id", F.col("asked_label"))
    top = top_candidates(scored_candidates(asked, held.drop("values"), as_of))
    found = top.join(held.select(F.col("row").alias("c_row"), "values"), "c_row")
    rows = F.sort_array(F.collect_list(F.struct("place", *[F.col(f"c_{c}").alias(c) for c in CARRIED], "values")))
    out = materialise(found.groupBy("asked_label", "length").agg(rows.alias("rows")), "match_candidates")
    discard(held)
    return out


def best_match(queries: DataFrame, tiers: DataFrame, as_of: str) -> DataFrame:
    """Each query, without its values, with its most similar candidate (c_shapelet_id, c_label, ...) and its ``sim`` by four metrics; the first by place wins ties.

    Unequal lengths are compared by warping. Queries stay where they are: the
    candidates come to them, and each is compared to all of its own in one
    task, many pairs of any lengths at once. More than ``MOST_SENT`` bytes of
    candidates are joined by label and length.
    """
    found = asked_candidates(queries, tiers, as_of)
    size = found.agg(F.sum(F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + 100 + 8 * F.size(r["values"])))).first()[0] or 0
    held = found.withColumnsRenamed({"asked_label": "_label", "length": "_length"})
    held = F.broadcast(held) if size <= MOST_SENT else held
    met = queries.join(held, F.col("asked_label").eqNullSafe(F.col("_label")) & (F.col("length") == F.col("_length")))
    # a function that may be repeated runs once for a filter and again for the rows
    once = _most_similar.asNondeterministic()
    best = met.withColumn("_best", once(F.col("values"), F.col("rows.values"))).withColumn("_row", F.get("rows", F.col("_best.place")))
    return best.select(*[c for c in queries.columns if c != "values"], *[F.col(f"_row.{c}").alias(f"c_{c}") for c in CARRIED], F.col("_best.sim").alias("sim"))


def match_confidence(sim: Column, confidence: Column, success: Column, discriminative: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sim * (0.7 + 0.3 * (0.4 * confidence + 0.3 * success + 0.3 * discriminative))))


def early_match(queries: DataFrame, cache: DataFrame, as_of: str, threshold: float = 0.6, least_confidence: float = 0.5) -> DataFrame:
    """(series_id, length, c_shapelet_id, c_label, sim, match_confidence) of the queries that match well enough."""
    found = best_match(queries, cache_tiers(cache), as_of)
    sure = match_confidence(F.col("sim"), F.col("c_confidence"), F.col("c_success_rate"), F.col("c_discriminative_score"))
    return found.select("series_id", "length", "c_shapelet_id", "c_label", "sim", sure.alias("match_confidence")).where((F.col("sim") >= threshold) & (F.col("match_confidence") >= least_confidence))


#: Candidates and bytes of values of a matcher that goes with the tasks.
MOST_CANDIDATES, MOST_BYTES = 1_000_000, 64 << 20


class Matcher:
    """The cache as one prefix after another asks it: by label and length the candidates in their places, and their values.

    Which candidates a prefix has follows from its length and label alone, so they
    are found for all lengths that the cache allows at once.
    """

    def __init__(self, asked: list, values: dict[int, list[float]], labels: set):
        number, sizes = {i: k for k, i in enumerate(values)}, [len(v) for v in values.values()]
        self.flat = np.array([x for v in values.values() for x in v], float)
        self.start, self.length = np.cumsum([0, *sizes])[:-1], np.array(sizes, int)
        self.labels, self.by = labels, {}
        for r in sorted(asked, key=lambda r: r["place"]):
            self.by.setdefault((r["asked_label"], r["length"]), []).append((number[r["c_shapelet_id"]], r))

    def matches(self, prefixes: list[np.ndarray], label: str | None, least: float = 0.0) -> Iterator[tuple[int, str, float, float]]:
        """(place, label, similarity, confidence) of the best match of normalised prefixes that one label asks with, in their order.

        All pairs are measured together. Prefixes whose best match is not as similar as ``least`` may be left out.
        """
        rows = [self.by.get((label if label in self.labels else None, len(p)), []) for p in prefixes]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        if not len(owner):
            return
        sizes = np.array([len(p) for p in prefixes])
        at = np.array([k for r in rows for k, _ in r])
        sides = (np.concatenate(prefixes), (np.cumsum(sizes) - sizes)[owner], sizes[owner]), (self.flat, self.start[at], self.length[at])
        first = np.searchsorted(owner, np.arange(len(rows)))
        for k, pair, sim in zip(*(x.tolist() for x in kernels.most_similar(*sides, owner, least)), strict=True):
            r = rows[k][pair - first[k]][1]
            sure = sim * (0.7 + 0.3 * (0.4 * r["c_confidence"] + 0.3 * r["c_success_rate"] + 0.3 * r["c_discriminative_score"]))
            yield k, r["c_label"], sim, max(0.0, min(1.0, sure))

    def match(self, prefix: np.ndarray, label: str | None) -> tuple[str, float, float] | None:
        """(label, similarity, confidence) of the best match of a normalised prefix."""
        return next((found[1:] for found in self.matches([prefix], label)), None)


def matcher(cache: DataFrame, as_of: str) -> Matcher:
    """The matcher of a cache; one of too many candidates or bytes is an error, found before anything is collected."""
    tiers = materialise(cache_tiers(cache), "matcher_tiers")
    lengths = tiers.agg(F.min("length").alias("low"), F.max("length").alias("high")).first()
    if lengths["low"] is None:
        return Matcher([], {}, set())
    labels = tiers.select("label").union(tiers.limit(1).select(F.lit(None).cast("string"))).distinct()
    sizes = F.sequence(F.lit(int(lengths["low"] / 1.3)), F.lit(int(lengths["high"] / 0.7) + 2))
    queries = labels.select(F.col("label").alias("series_id"), F.col("label").alias("asked_label"), F.explode(sizes).alias("length"))
    found = materialise(top_candidates(scored_candidates(queries, tiers, as_of)).select("asked_label", "length", "place", "c_shapelet_id", "c_label", "c_confidence", "c_success_rate", "c_discriminative_score"), "matcher_candidates")
    used = tiers.join(found.select(F.col("c_shapelet_id").alias("shapelet_id")).distinct(), "shapelet_id", "left_semi").dropDuplicates(["shapelet_id"]).select("shapelet_id", "values")
    size = used.agg(F.coalesce(F.sum(8 * F.size("values")), F.lit(0))).first()[0]
    if found.count() > MOST_CANDIDATES or size > MOST_BYTES:
        raise ValueError(f"a matcher has at most {MOST_CANDIDATES} candidates and {MOST_BYTES} bytes of values")
    made = Matcher(found.collect(), {r["shapelet_id"]: r["values"] for r in used.collect()}, {r[0] for r in labels.collect()})
    discard(tiers, found)
    return made


def pruned(cache: DataFrame) -> DataFrame:
    """The cache rows that some tier holds."""
    return cache.join(cache_tiers(cache).select("shapelet_id").distinct(), "shapelet_id", "left_semi").select(cache.columns)


def usage_update(cache: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The cache after matches (shapelet_id, success, at): counters, success rate and last access."""
    news = outcomes.groupBy("shapelet_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("success").cast("int")).alias("_s"), F.max("at").alias("_at"))
    n, s = F.coalesce("_n", F.lit(0)), F.coalesce("_s", F.lit(0))
    total, good = F.col("total_matches") + n, F.col("successful_matches") + s
    changed = {
        "usage_count": F.col("usage_count") + n,
        "total_matches": total,
        "successful_matches": good,
        "success_rate": F.when(n > 0, good / F.greatest(total, F.lit(1))).otherwise(F.col("success_rate")),
        "last_accessed": F.greatest("last_accessed", F.coalesce("_at", "last_accessed")),
    }
    return cache.join(news, "shapelet_id", "left").select(*[changed.get(c, F.col(c)).alias(c) for c in cache.columns])


def confidence_ema(feedback: DataFrame, keep: float = 0.9, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """(shapelet_id, confidence) after feedback (shapelet_id, at, start, new) in order: each keeps 90 % of the value before.

    Feedback of one ``at`` goes by ``new``, the smaller first; a null ``new``
    changes nothing. Steps are composed in chunks, so a hot shapelet is split.
    """

    def step(_: None, row: tuple) -> tuple[float, float] | None:
        return None if row[0] is None else (keep, (1 - keep) * row[0])

    ends = folded_ends(feedback.select("shapelet_id", *order, F.col("new").cast("double").alias("new")), "shapelet_id", [*order, "new"], ["new"], lambda: None, step, 1, -1e300, 1e300)
    starts = feedback.groupBy("shapelet_id").agg(F.max("start").alias("start")).withColumnRenamed("shapelet_id", "_id")
    return ends.join(starts, F.col("shapelet_id").eqNullSafe(F.col("_id"))).select("shapelet_id", (F.col("start") * F.col("slope") + F.col("add")).alias("confidence"))


class Outcomes:
    """The last 50 outcomes of a stream: whether they were right, and their earliness."""

    def __init__(self):
        self.correct, self.early = LastRows(50), LastRows(50)

    def push(self, correct: bool | None, early: float | None) -> None:
        self.correct.rows.append(correct)
        self.early.rows.append(early)


def adaptive_threshold(outcomes: DataFrame, start: float = 0.6, low: float = 0.4, high: float = 0.85, rate: float = 0.01) -> DataFrame:
    """Outcomes (stream_id, ts, event_id, correct, earliness) with the threshold after each.

    From 10 outcomes on, the last 50 lower it (accuracy below 0.6) or raise it
    (accuracy over 0.85 with mean earliness below 0.3), within its bounds. Nulls
    count as outcomes, but in no mean.
    """

    def step(held: Outcomes, row: tuple) -> tuple[float, float] | None:
        held.push(*row)
        if len(held.correct.rows) < 10:
            return None
        (_, accuracy), (_, early) = held.correct.mean(), held.early.mean()
        if accuracy is None:
            return None
        return (1.0, -rate) if accuracy < 0.6 else (1.0, rate) if accuracy > 0.85 and early is not None and early < 0.3 else None

    return scanned(outcomes, "stream_id", ["ts", "event_id"], ["correct", "earliness"], Outcomes, step, 50, start, low, high, "threshold")


def matcher_metrics(cache: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """One row: shares of matches, hits and correct ones among the outcomes, and means over the cache."""
    o = outcomes.agg(F.count(F.lit(1)).alias("attempts"), F.avg(F.col("matched").cast("double")).alias("match_rate"), F.avg(F.when(F.col("matched"), F.col("success").cast("double"))).alias("hit_rate"))
    hour = F.col("last_accessed").cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    c = cache.agg(F.avg("success_rate").alias("mean_success"), F.avg("confidence").alias("mean_confidence"), F.avg("discriminative_score").alias("mean_discriminative"), F.avg("usage_count").alias("mean_usage"), F.sum(hour.cast("long")).alias("last_hour"))
    return o.withColumn("_k", F.lit(1)).join(c.withColumn("_k", F.lit(1)), "_k").drop("_k")


def prefixes(series: DataFrame, least: float = 0.3, step: int = 1, stop: float = 0.8, most: int = 100, expected: Column | None = None) -> DataFrame:
    """(series_id, length, n, values): normalised prefixes from 30 % of a series, up to the first of 80 %, at most min(100, n).

    Of a series that is still growing to ``expected`` values, those that are there already.
    """
    n = F.size("values") if expected is None else expected
    start = F.floor(n * F.lit(least)).cast("int")
    end = F.least(F.ceil(n * F.lit(stop)).cast("int"), start + (F.least(F.lit(most), n) - 1) * step, n, F.size("values"))
    rows = series.withColumn("n", n).withColumn("length", F.explode(F.when(end >= start, F.sequence(start, end, F.lit(step))).otherwise(F.array().cast("array<int>"))))
    rows = rows.where(F.col("length") >= F.col("n") * F.lit(least))
    return rows.withColumn("values", prefix_normalise(F.slice("values", 1, F.col("length"))))


def early_decision(queries: DataFrame, cache: DataFrame, as_of: str, threshold: float = 0.6, least_confidence: float = 0.7) -> DataFrame:
    """Each series with its shortest accepted prefix: predicted_label, confidence, length."""
    found = early_match(queries, cache, as_of, threshold, least_confidence)
    return found.groupBy("series_id").agg(F.min(F.struct("length", F.col("c_label").alias("predicted_label"), F.col("match_confidence").alias("confidence"))).alias("d")).select("series_id", "d.*")


def earliness(ratio: Column) -> Column:
    """0.1 to 0.9, higher for a decision after a smaller share of the series."""
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), 0.1 + 0.8 * (1 - ratio)))


def evaluate(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and in total: accuracy, confidence, earliness, early share, counts and the harmonic mean.

    ``level`` tells totals (one bit for each key that is summed over) from rows of a null key (0).

    Predictions: keys, label, predicted_label, confidence, earliness, early; a
    failed one (null label) counts as unknown with confidence 0 and earliness 1.
    """
    right = F.coalesce((F.col("label") == F.col("predicted_label")).cast("double"), F.lit(0.0))
    per = predictions.rollup(*keys).agg(
        F.grouping_id().cast("int").alias("level"),
        F.avg(right).alias("accuracy"),
        F.avg(F.coalesce("confidence", F.lit(0.0))).alias("mean_confidence"),
        F.avg(F.coalesce("earliness", F.lit(1.0))).alias("mean_earliness"),
        F.avg(F.coalesce(F.col("early").cast("double"), F.lit(0.0))).alias("early_rate"),
        F.sum(right).cast("long").alias("correct"),
        F.count(F.lit(1)).alias("total"),
    )
    late = 1 - F.col("mean_earliness")
    return per.withColumn("harmonic_mean", F.coalesce(F.try_divide(2 * F.col("accuracy") * late, F.col("accuracy") + late), F.lit(0.0)))


def harmonic_mean_earliness(accuracy: Column, early: Column) -> Column:
    return F.coalesce(F.try_divide(2 * accuracy * early, accuracy + early), F.lit(0.0))
