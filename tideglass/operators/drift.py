"""Drift of label streams (stream_id, ts, event_id, label) over count windows, and thresholds that follow a stream."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable
from math import log2, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.ordered import in_chunks, placed, scanned, with_margins

WINDOW, LEAST, CHANGE = 100, 50, 0.1


def drift_windows(rows: DataFrame, w: int = WINDOW) -> DataFrame:
    """Each row with ``recent``, the labels of the last w - 1 rows, and ``history``, those of the up to w rows before."""
    table = with_margins(placed(rows, "stream_id", ["ts", "event_id"]), 2 * w)
    by_time = Window.partitionBy("_chunk", "stream_id").orderBy("_row")
    recent, history = by_time.rowsBetween(-(w - 2), 0), by_time.rowsBetween(-(2 * w - 2), -(w - 1))
    found = table.withColumn("recent", F.collect_list("label").over(recent)).withColumn("history", F.collect_list("label").over(history))
    return found.where("not _before").drop("_row", "_chunk", "_before")


class LabelWindows:
    """The labels of a stream's last w - 1 rows and of the up to w rows before, counted; null labels fill a place only."""

    def __init__(self, w: int = WINDOW, labels: Iterable[str | None] = ()):
        self.w = w
        self.rows: tuple[deque, deque] = (deque(), deque())
        self.counts: tuple[Counter, Counter] = (Counter(), Counter())
        self.sizes = [0, 0]
        for label in labels:
            self.push(label)

    def _add(self, side: int, label: str | None, sign: int) -> None:
        if label is not None:
            self.sizes[side] += sign
            self.counts[side][label] += sign
            if not self.counts[side][label]:
                del self.counts[side][label]

    def push(self, label: str | None) -> None:
        self.rows[0].append(label)
        self._add(0, label, 1)
        if len(self.rows[0]) >= self.w:
            old = self.rows[0].popleft()
            self._add(0, old, -1)
            self.rows[1].append(old)
            self._add(1, old, 1)
            if len(self.rows[1]) > self.w:
                self._add(1, self.rows[1].popleft(), -1)

    def labels(self) -> list[str | None]:
        """All labels that are held, oldest first."""
        return [*self.rows[1], *self.rows[0]]

    def drift(self, least: int = LEAST, threshold: float = CHANGE) -> tuple[bool, float, str]:
        """(changed, magnitude, kind); too few rows give (false, 0, insufficient_data)."""
        n, m = self.sizes
        if n < least or m < least:
            return False, 0.0, "insufficient_data"
        recent, history = self.counts
        shares = {x: (recent[x] / n, history[x] / m) for x in sorted(recent.keys() | history.keys())}
        size = root_js_divergence(shares.values())
        return size > threshold, size, drift_kind(shares)


def root_js_divergence(shares: Iterable[tuple[float, float]]) -> float:
    """Square root of the Jensen-Shannon divergence (base 2) of pairs of shares."""
    total = 0.0
    for p, q in shares:
        mean = (p + q) / 2
        total += (p * log2(p / mean) if p else 0.0) / 2 + (q * log2(q / mean) if q else 0.0) / 2
    return sqrt(max(0.0, total))


def drift_kind(shares: dict[str, tuple[float, float]]) -> str:
    """The first that holds: new labels, vanished labels, shares changed by over 0.1, a minor shift."""
    new, gone = [x for x, (_, q) in shares.items() if not q], [x for x, (p, _) in shares.items() if not p]
    moved = [f"{x}:{abs(p - q):.2f}" for x, (p, q) in shares.items() if abs(p - q) > 0.1]
    if new:
        return "new_classes:" + ",".join(new)
    if gone:
        return "disappeared_classes:" + ",".join(gone)
    return "proportion_changes:" + ";".join(moved) if moved else "minor_shift"


def label_drift(rows: DataFrame, w: int = WINDOW, least: int = LEAST, threshold: float = CHANGE) -> DataFrame:
    """(stream_id, ts, event_id, changed, magnitude, kind) of each row; too few rows give (false, 0, insufficient_data).

    Labels are counted as they come and go. A row needs the 2w - 2 rows before it
    at most, so chunks of a stream are worked on apart. A null stream is a stream,
    a null label fills a place of the windows only.
    """

    def step(windows: LabelWindows, row: tuple, wanted: bool) -> list[tuple]:
        windows.push(row[0])
        return [windows.drift(least, threshold)] if wanted else []

    table = placed(rows.select("stream_id", "ts", "event_id", "label"), "stream_id", ["ts", "event_id"])
    return in_chunks(table, "stream_id", ["label"], "changed boolean, magnitude double, kind string", lambda: LabelWindows(w), step, 2 * w, ["stream_id", "ts", "event_id"])


def drift_log(drift: DataFrame, last: int = 10) -> DataFrame:
    """The last changes of each stream."""
    order = Window.partitionBy("stream_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return drift.where("changed").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= last)


def update_due(changed: Column, mean_tree_score: Column, iteration: Column, threshold: float = 0.6, every: int = 10) -> Column:
    return changed | (mean_tree_score < threshold) | (iteration % every == 0)


def rolling_earliness(rows: DataFrame, frame: int = 100) -> DataFrame:
    """``rows`` (stream_id, ts, event_id, earliness) with ``mean_earliness`` of the last ``frame`` rows of the stream, this one included."""
    table = with_margins(placed(rows, "stream_id", ["ts", "event_id"]), frame)
    last = Window.partitionBy("_chunk", "stream_id").orderBy("_row").rowsBetween(-(frame - 1), 0)
    return table.withColumn("mean_earliness", F.avg("earliness").over(last)).where("not _before").drop("_row", "_chunk", "_before")


class LastRows:
    """The last values of a stream, null ones too, with their number and sum; sums are taken anew, so that nothing adds up."""

    def __init__(self, size: int):
        self.rows: deque = deque(maxlen=size)

    def mean(self) -> tuple[int, float | None]:
        """(how many values are there, their mean)."""
        there = [x for x in self.rows if x is not None]
        return len(there), sum(there) / len(there) if there else None


def earliness_threshold(rows: DataFrame, start: float = 0.85, low: float = 0.5, high: float = 0.95) -> DataFrame:
    """``rows`` (stream_id, ts, event_id, earliness) with the threshold after each: from 10 earlier rows with a value on, the
    mean of the 10 before moves it up by 5 % (over 0.7) or down by 5 % (below 0.3), within its bounds."""

    def step(held: LastRows, row: tuple) -> tuple[float, float] | None:
        n, mean = held.mean()
        held.rows.append(row[0])
        return None if n < 10 else (1.05, 0.0) if mean > 0.7 else (0.95, 0.0) if mean < 0.3 else None

    return scanned(rows, "stream_id", ["ts", "event_id"], ["earliness"], lambda: LastRows(10), step, 10, start, low, high, "threshold")
