"""Label attention: weights of labels from matches, and their PerMax shares."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideglass.functions.scalars import dot
from tideglass.operators.ordered import in_chunks, placed

THRESHOLD = 0.8
FRAME = 100


def permax(weight: Column, over: WindowSpec, scale: float = 1.0) -> Column:
    """max(0, log2(weight) * scale) over its sum; even shares where all are 0."""
    x = F.when(weight > 0, F.greatest(F.lit(0.0), F.log2(weight) * scale)).otherwise(0.0)
    whole = F.sum(x).over(over)
    return F.when(whole > 0, x / whole).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(over))


def permax_attention(queries: DataFrame, rows: DataFrame, scale: float = 1.0, permax_scale: float = 1.0) -> DataFrame:
    """(grp, dim, value): each group's query attends to the group's rows (grp, values), which are keys and values.

    Scores are dot products times ``scale`` / sqrt(dimension), at least 1e-8.
    Sums are taken per dimension, so a large group is summed in parts.
    """
    scored = rows.join(queries, "grp").withColumn("score", F.greatest(dot(F.col("query"), F.col("values")) * scale / F.sqrt(F.size("values").cast("double")), F.lit(1e-8)))
    x = F.greatest(F.lit(0.0), F.log2("score") * permax_scale)
    sums = scored.groupBy("grp").agg(F.sum(x).alias("whole"), F.count(F.lit(1)).alias("n"))
    shares = scored.join(sums, "grp").withColumn("share", F.when(F.col("whole") > 0, x / F.col("whole")).otherwise(F.lit(1.0) / F.col("n")))
    return shares.select("grp", "share", F.posexplode("values").alias("dim", "x")).groupBy("grp", "dim").agg(F.sum(F.col("share") * F.col("x")).alias("value"))


def attention_weights(matches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, call, label, weight) from (key, call, label, sim), calls in order.

    Matches of at least ``threshold`` count: 0.4 * share of the label in all
    counts so far, 0.3 * its running count (at most 100) over 10, at most 1,
    0.3 * mean similarity.
    """
    per = matches.where(F.col("sim") >= threshold).groupBy("key", "call", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("sim").alias("mean_sim"))
    so_far = Window.partitionBy("key").orderBy("call").rangeBetween(Window.unboundedPreceding, 0)
    of_label = Window.partitionBy("key", "label").orderBy("call").rangeBetween(Window.unboundedPreceding, 0)
    return per.select(
        "key", "call", "label", (0.4 * F.col("n") / F.sum("n").over(so_far) + 0.3 * F.least(F.least(F.sum("n").over(of_label), F.lit(100)) / 10.0, F.lit(1.0)) + 0.3 * F.col("mean_sim")).alias("weight")
    )


def normalised_attention(weights: DataFrame, scale: float = 1.0) -> DataFrame:
    """Shares of the labels of each call."""
    return weights.withColumn("weight", permax(F.col("weight"), Window.partitionBy("key", "call"), scale))


def next_attention(held: DataFrame, matches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(label, n, weight), the running counts and latest shares of labels, after one more call with matches (label, sim).

    What ``latest_attention`` gives of all calls' normalised weights, from what the
    calls before left: one row for each label that ever matched.
    """
    per = matches.where(F.col("sim") >= threshold).groupBy("label").agg(F.count(F.lit(1)).alias("new"), F.avg("sim").alias("mean"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = held.select("label", "n", "weight", none("long", "new"), none("double", "mean")).unionByName(per.select("label", none("long", "n"), none("double", "weight"), "new", "mean"))
    rows = both.groupBy("label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("weight").alias("weight"), F.sum("new").alias("new"), F.max("mean").alias("mean"))
    every = Window.partitionBy()
    n = F.col("n") + F.coalesce("new", F.lit(0))
    raw = 0.4 * F.col("new") / F.sum(n).over(every) + 0.3 * F.least(F.least(n, F.lit(100)) / 10.0, F.lit(1.0)) + 0.3 * F.col("mean")
    rows = rows.withColumn("raw", F.when(F.col("new").isNotNull(), raw)).withColumn("x", F.when(F.col("raw") > 0, F.greatest(F.lit(0.0), F.log2("raw"))).when(F.col("raw").isNotNull(), 0.0))
    whole = F.sum("x").over(every)
    share = F.when(whole > 0, F.col("x") / whole).otherwise(F.lit(1.0) / F.count("x").over(every))
    return rows.select("label", n.alias("n"), F.when(F.col("x").isNotNull(), share).otherwise(F.col("weight")).alias("weight"))


def latest_attention(shares: DataFrame) -> DataFrame:
    """The last share written for each label."""
    return shares.groupBy("key", "label").agg(F.max_by("weight", "call").alias("weight"))


def top_attention_labels(latest: DataFrame, k: int = 5) -> DataFrame:
    """The k highest labels of each key, ties by label."""
    order = Window.partitionBy("key").orderBy(F.desc(F.round("weight", 9)), "label")
    return latest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def attention_summary(matches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per key and label: how often it matched, its sequence length (at most 100), and the key's evaluations."""
    counts = matches.where(F.col("sim") >= threshold).groupBy("key", "label").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.select("key", "label", "frequency", F.least("frequency", F.lit(100)).cast("long").alias("sequence_length"), F.sum("frequency").over(Window.partitionBy("key")).alias("evaluations"))


class AttentionFrame:
    """The labels and similarities of a stream's last ``frame`` rows, counted by label.

    A row of a null (or NaN) similarity counts for its label, but not in its mean;
    a label without any has mean 0.
    """

    def __init__(self, frame: int = FRAME, rows: Iterable[tuple[str, float]] = ()):
        self.frame = frame
        self.rows: deque = deque()
        self.sims: dict[str, deque] = {}
        for label, sim in rows:
            self.push(label, sim)

    def push(self, label: str, sim: float | None) -> None:
        self.rows.append((label, sim))
        self.sims.setdefault(label, deque()).append(None if sim is None or sim != sim else sim)
        if len(self.rows) > self.frame:
            old, _ = self.rows.popleft()
            self.sims[old].popleft()
            if not self.sims[old]:
                del self.sims[old]

    def shares(self) -> list[tuple[str, float]]:
        """(label, share of the weights 0.4 * count + 0.3 * mean similarity), by PerMax."""
        raw = {}
        for label, sims in self.sims.items():
            there = [s for s in sims if s is not None]
            weight = 0.4 * len(sims) + 0.3 * (sum(there) / len(there) if there else 0.0)
            raw[label] = max(0.0, log2(weight)) if weight > 0 else 0.0
        whole = sum(raw.values())
        return [(x, v / whole if whole > 0 else 1 / len(raw)) for x, v in raw.items()]


def streaming_attention(rows: DataFrame, threshold: float = THRESHOLD, frame: int = FRAME) -> DataFrame:
    """(stream_id, event_id, label, weight): label shares over the last ``frame`` rows, given at rows of at least ``threshold``.

    All rows of the frame count, with weight 0.4 * count + 0.3 * mean similarity.
    A row needs the rows of its frame only, so chunks of a stream are worked on apart.
    """

    def step(held: AttentionFrame, row: tuple, wanted: bool) -> list[tuple]:
        label, sim = row
        held.push(label, sim)
        return held.shares() if wanted and sim is not None and sim >= threshold else []

    table = placed(rows.select("stream_id", "ts", "event_id", F.col("label").alias("_label"), "sim"), "stream_id", ["ts", "event_id"])
    return in_chunks(table, "stream_id", ["_label", "sim"], "label string, weight double", lambda: AttentionFrame(frame), step, frame, ["stream_id", "event_id"])


#: Smaller counts are dropped.
FAINT = 0.01


def decayed_frequency(rows: DataFrame, decay: float = 0.95) -> DataFrame:
    """(stream_id, event_id, label, frequency): at each row all labels' counts fall to ``decay`` of theirs, those below
    ``FAINT`` are dropped, and the row's label gains one.

    What a count of before a chunk leaves falls below the precision of a double
    within a bounded number of rows, which are the chunk's margin.
    """
    if not 0 < decay < 1:
        raise ValueError("counts must fall: a decay between 0 and 1")

    def step(held: dict, row: tuple, wanted: bool) -> list[tuple]:
        (label,) = row
        t = held["t"] = held["t"] + 1
        last, value = held["labels"].get(label, (t, 0.0))
        value *= decay ** (t - last)
        value = (value if value >= FAINT else 0.0) + 1.0
        held["labels"][label] = (t, value)
        if len(held["labels"]) > 2 * held["kept"]:
            held["labels"] = {x: (at, v) for x, (at, v) in held["labels"].items() if v * decay ** (t - at) >= FAINT}
            held["kept"] = max(1000, len(held["labels"]))
        return [(value,)] if wanted else []

    # 2 ** -70 of the highest count
    margin = ceil((70 * log(2) - log(1 - decay)) / -log(decay))
    table = placed(rows.select("stream_id", "ts", "event_id", "label"), "stream_id", ["ts", "event_id"])
    return in_chunks(table, "stream_id", ["label"], "frequency double", lambda: {"t": 0, "labels": {}, "kept": 1000}, step, margin, ["stream_id", "event_id", "label"])
