"""Structured Streaming jobs over label streams, growing series and new shapelets.

State is kept by stream and bounded: the last labels of the two drift windows,
the last rows of the attention frame, the values of a growing series until it is decided. Rows that come later than the watermark are
dropped; inside a micro-batch rows are ordered by (ts, event_id); the state of a
stream that is silent for ``FORGET`` of event time is removed. These rules are
ours: the windows themselves count rows. What incremental training keeps are
tables with a version for each micro-batch.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideglass.functions import kernels
from tideglass.operators import attention, classify, drift, extract, forest, match, pairs
from tideglass.shared import discard, materialise

LATENESS = "10 minutes"
FORGET = timedelta(days=30)
_STATE = "kept string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a table (a folder or one file) as a stream, with the schema that they have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a path may be a file


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write all that is there to Parquet, exactly once for each checkpoint, and read it."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch to ``work(rows, batch_id)``, which must not mind a batch that comes again.

    The stream keeps its state in RocksDB, as keyed states with timers need; a stream
    has the settings of its start, so the session's own are back at once.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        started = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_PROVIDER, before)
    started.awaitTermination()


def _stateful(stream: DataFrame, key: str, columns: list[str], output: str, step: Callable[[list, list[tuple]], tuple[list, list[tuple]]], forget: timedelta = FORGET) -> DataFrame:
    """``step(kept, rows)`` per key and micro-batch: the ordered rows against what was kept gives the new state and rows."""
    names = [c.strip().split(" ")[0] for c in output.split(",")]
    kinds = dict(stream.dtypes)
    # ids go as text, so that large ones beside nulls stay what they are
    as_text = {"event_id"} & set(columns)
    types = ", ".join([f"{key} string"] + [f"{c} string" if c in as_text else t.strip() for c, t in zip(names[1:], output.split(",")[1:], strict=True)])

    def known(x: object) -> object:
        return None if x is None or x != x else x

    def each(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        times = [None if t is pd.NaT else t for t in rows["ts"]]
        # rows without a time come first, as in tables
        order = sorted(range(len(rows)), key=lambda i: (times[i] is not None, times[i] or 0, known(rows["event_id"].iloc[i]) is not None, int(known(rows["event_id"].iloc[i]) or 0)))
        at, kept = json.loads(state.get[0]) if state.exists else (None, [])
        there = [int(t.timestamp() * 1000) for t in times if t is not None]
        silence = max(1, int(forget.total_seconds() * 1000))
        # a state that is due to go may still be there when rows come
        gone = at is not None and there and min(there) > at + silence
        values = [tuple(known(x) for x in r) for r in rows[columns].iloc[order].itertuples(index=False, name=None)]
        kept, out = step([] if gone else kept, values)
        at = max([*there, *([] if at is None else [at])], default=None)
        state.update((json.dumps((at, kept)),))
        state.setTimeoutTimestamp(max(at or 0, state.getCurrentWatermarkMs()) + silence)
        yield pd.DataFrame([(k[0], *r) for r in out], columns=names)

    slim = stream.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("string").alias(c) if c == "event_id" else F.col(c) for c in dict.fromkeys(["ts", "event_id", *columns])])
    found = slim.withWatermark("ts", LATENESS).groupBy(key).applyInPandasWithState(each, types, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({key: F.col(key).cast(kinds[key]), **{c: F.col(c).cast(kinds[c]) for c in as_text}})


def drift_stream(stream: DataFrame, w: int = 100, least: int = 50, threshold: float = 0.1, forget: timedelta = FORGET) -> DataFrame:
    """(stream_id, event_id, changed, magnitude) of each row of (stream_id, ts, event_id, label)."""

    def step(kept: list, rows: list[tuple]) -> tuple[list, list[tuple]]:
        windows, out = drift.LabelWindows(w, kept), []
        for event_id, label in rows:
            windows.push(label)
            out.append((event_id, *windows.drift(least, threshold)[:2]))
        return windows.labels(), out

    return _stateful(stream, "stream_id", ["event_id", "label"], "stream_id long, event_id long, changed boolean, magnitude double", step, forget)


def attention_stream(stream: DataFrame, threshold: float = 0.8, frame: int = 100, forget: timedelta = FORGET) -> DataFrame:
    """(stream_id, event_id, label, weight): label shares over the last rows, given at rows of (…, label, sim) that match."""

    def step(kept: list, rows: list[tuple]) -> tuple[list, list[tuple]]:
        held, out = attention.AttentionFrame(frame, kept), []
        for event_id, label, sim in rows:
            held.push(label, sim)
            if sim is not None and sim >= threshold:
                out.extend((event_id, *share) for share in held.shares())
        return list(held.rows), out

    return _stateful(stream, "stream_id", ["event_id", "label", "sim"], "stream_id long, event_id long, label string, weight double", step, forget)


#: Prefixes of a series that ask the cache together; those after the first match are in vain.
TOGETHER = 16


class GrowingSeries(StatefulProcessor):
    """The state of a series whose points arrive: its values up to the first that is missing, those beyond, and whether it is decided.

    A series asks the cache with every new prefix, shortest first, and gives one row
    in its life: the first prefix that matches, or all its values if none of a
    whole series does. Then its values go and only the mark of the decision
    stays, until the series is silent for ``forget`` of event time.
    """

    def __init__(self, matcher: match.Matcher, threshold: float, least_confidence: float, forget: timedelta):
        self.matcher, self.threshold, self.least = matcher, threshold, least_confidence
        self.silence = int(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", "decided boolean, asked_label string, expected int, run array<double>, ahead array<int>, ahead_values array<double>, until long")

    def _answer(self, run: list[float], tried: int, expected: int, label: str | None) -> tuple | None:
        start = math.floor(expected * 0.3)
        last = min(math.ceil(expected * 0.8), start + min(100, expected) - 1, expected, len(run))
        lengths = [n for n in range(max(tried + 1, start, 1), last + 1) if n >= expected * 0.3]
        for k in range(0, len(lengths), TOGETHER):
            some = lengths[k : k + TOGETHER]
            for at, found, sim, sure in self.matcher.matches([kernels.prefix_normalised(np.array(run[:n], float)) for n in some], label, self.threshold):
                if sim >= self.threshold and sure >= self.least:
                    return found, sure, some[at], expected, None
        return (None, None, None, expected, run) if len(run) >= expected else None

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        decided, label, expected, run, ahead, ahead_values, until = self.state.get() or (False, None, None, [], [], [], None)
        new, latest = [], None
        for frame in rows:
            new.extend(zip(*(frame[c].tolist() for c in ("at", "value", "asked_label", "expected")), strict=True))
            times = frame["ts"].dropna()
            if len(times):
                latest = max(latest or 0, int(times.max().timestamp() * 1000))
        if latest is not None:
            # one timer is set at a time; when it is due, a later time puts it off
            if until is None:
                self.handle.registerTimer(latest + self.silence)
            until = max(until or 0, latest + self.silence)
        answer, run, held = None, list(run), dict(zip(ahead, ahead_values, strict=True))
        if not decided:
            tried = len(run)
            # of points that come together the smallest value counts; null ones are missing
            for at, value, asked, size in sorted((p for p in new if p[0] == p[0] and p[1] == p[1] and p[0] is not None and p[1] is not None), key=lambda p: p[:2]):
                label = max(x for x in (label, asked) if x is not None) if label is not None or asked is not None else None
                expected = max(x for x in (expected, size) if x is not None and x == x) if expected is not None or size == size and size is not None else None
                if at >= len(run):
                    held.setdefault(int(at), float(value))
            while len(run) in held:
                run.append(held.pop(len(run)))
            answer = self._answer(run, tried, int(expected), label) if expected is not None and len(run) > tried else None
            decided = answer is not None
            if decided:
                run, held = [], {}
        self.state.update((decided, label, None if expected is None else int(expected), run, list(held), list(held.values()), until))
        if answer is not None:
            yield pd.DataFrame({"series_id": [key[0]], **{c: [x] for c, x in zip(_ANSWER, answer, strict=True)}}).astype({"length": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        held = self.state.get()
        if held and held[-1] is not None and held[-1] > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(held[-1])
        else:
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


_ANSWER = ("predicted_label", "confidence", "length", "expected", "values")


def early_answers(points: DataFrame, model: classify.Model, as_of: str, threshold: float = 0.6, least_confidence: float = 0.7, forget: timedelta = FORGET) -> DataFrame:
    """A stream with one row for each series of points (series_id, ts, at, value, asked_label, expected): its early
    decision, or its whole values where no prefix is like the cache. State is kept by series; a batch costs what its own rows do."""
    kind = points.schema["series_id"].dataType.simpleString()
    rows = points.select("series_id", "ts", "at", "value", "asked_label", "expected").withWatermark("ts", LATENESS).groupBy("series_id")
    schema = f"series_id {kind}, predicted_label string, confidence double, length int, expected int, values array<double>"
    return rows.transformWithStateInPandas(GrowingSeries(match.matcher(model.cache, as_of), threshold, least_confidence, forget), schema, "append", "EventTime")


def early_classify(spark: SparkSession, folder: str, model: classify.Model) -> Callable[[DataFrame, int], None]:
    """A foreachBatch job on ``early_answers``: decisions of the batch, as ``decisions`` in the folder; whole series get the forest's vote.

    A batch that comes again overwrites its own.
    """
    made = "series_id long, predicted_label string, confidence double, method string, earliness double, observation_ratio double"
    spark.createDataFrame([], made).write.mode("overwrite").parquet(f"{folder}/decisions/batch=-1")

    def work(rows: DataFrame, batch: int) -> None:
        answers = materialise(rows, "early_answers")
        ratio = F.col("length") / F.col("expected")
        early = answers.where("length is not null").select("series_id", "predicted_label", "confidence", F.lit("early").alias("method"), match.earliness(ratio).alias("earliness"), ratio.alias("observation_ratio"))
        voted = classify.voted_rows(answers.where("length is null").select("series_id", "values"), model.nodes, model.shapelets)
        early.unionByName(voted).write.mode("overwrite").parquet(f"{folder}/decisions/batch={batch}")
        discard(answers)

    return work


LOG = "iteration long, rows long, changed boolean, magnitude double, kind string, score double, due boolean, trees_updated long, training_rows long, improvement double, selected long, pool long, cached long"


class CoTraining:
    """Incremental training, a step for each micro-batch of new shapelets (stream_id, ts, event_id, i, label, values).

    The tables of ``folder`` have a version for each batch; a batch that comes
    again reads the version before and overwrites its own, so that the result
    has each batch once. Places ``i`` of new shapelets are new ones. A batch

    * joins the pool, and drift of the labels is measured over the pool as one
      stream, batch after batch and by time in a batch;
    * is matched to the cache, whose counters it moves and whose similarities
      move the labels' attention;
    * where a change, weak trees or the count of iterations call for it, grows the
      weak trees anew from all pool rows of the labels with most attention;
    * walks down the trees, whose scores follow from their nodes' accuracy;
    * gives its most informative shapelets to the cache, which keeps what its tiers hold.

    What a version holds is bounded whatever came before: the labels of the two
    drift windows, a row for each label's attention, the forest with the shapelets
    that it compares with, and the pruned cache. Only a batch that grows trees
    reads the pool, of which it needs all rows.
    """

    def __init__(self, folder: str, model: classify.Model, as_of: str, score_threshold: float = 0.25, due_threshold: float = 0.25, w: int = drift.WINDOW, least: int = drift.LEAST, least_gain: float = 0.01, every: int = 10):
        self.folder, self.as_of, self.spark = folder, as_of, model.nodes.sparkSession
        self.score_threshold, self.due_threshold, self.w, self.least, self.least_gain, self.every = score_threshold, due_threshold, w, least, least_gain, every
        trees = model.nodes.select("tree_id").distinct()
        start = {
            "shapelets": self._used(model.shapelets.select("i", "label", "values"), model.nodes),
            "forest": model.nodes,
            "cache": match.pruned(model.cache),
            "scores": trees.select("tree_id", F.lit(0.0).alias("score")),
            "attention": self.spark.createDataFrame([], "label string, n long, weight double"),
            "state": self.spark.createDataFrame([([], 0)], "labels array<string>, pool long"),
        }
        for name, table in start.items():
            self._write(table, name, -1)
        self.schemas = {name: table.schema for name, table in start.items()}

    @staticmethod
    def _used(shapelets: DataFrame, nodes: DataFrame) -> DataFrame:
        """The shapelets that the nodes compare with."""
        return shapelets.join(F.broadcast(nodes.select(F.col("shapelet_id").alias("i")).distinct()), "i", "left_semi")

    def _write(self, table: DataFrame, name: str, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def version(self, name: str, batch: int) -> DataFrame:
        """A table as a batch left it (-1: as training began)."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}/batch={batch}")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log/batch=*")

    def _matches(self, new: DataFrame, cache: DataFrame) -> DataFrame:
        """(i, label, shapelet_id, c_label, sim): the most similar cached shapelet of each new one."""
        queries = new.select(F.col("i").alias("series_id"), F.col("label").alias("asked_label"), F.size("values").alias("length"), match.prefix_normalise(F.col("values")).alias("values"))
        best = match.best_match(queries, match.cache_tiers(cache), self.as_of)
        return best.select(F.col("series_id").alias("i"), F.col("asked_label").alias("label"), F.col("c_shapelet_id").alias("shapelet_id"), "c_label", "sim")

    def _training(self, batch: int, attention_table: DataFrame) -> DataFrame:
        """(i, label, values): all pool rows of the labels with most attention."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schemas["pool"].fields)
        pool = self.spark.read.schema(f"{fields}, batch int").parquet(f"{self.folder}/pool").where(F.col("batch") <= batch)
        chosen = forest.retraining_rows(pool.select("i", "label"), attention_table.select("label", "weight"))
        return chosen.join(pool.select("i", "values"), "i")

    def _survivors(self, new: DataFrame) -> DataFrame:
        """(i, label, values, info_gain): the new shapelets whose similarities to the batch tell labels apart."""
        placed = materialise(pairs.indexed(new.select(F.col("i").alias("id"), "label", "values"), None), "co_new")
        labels = placed.select(F.col("i").alias("j"), "label")
        own = pairs.pairwise_similarity(placed).join(labels, "j").select("i", "label", "value")
        gains = materialise(extract.grid_info_gain(own, ["i"]).select("i", "info_gain"), "co_gains")
        # fewer than three shapelets are all kept
        good = gains.where(F.col("info_gain") >= self.least_gain) if placed.limit(3).count() == 3 else gains
        return placed.join(good, "i").select(F.col("id").alias("i"), "label", "values", "info_gain")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        before = batch - 1
        self._write(rows, "pool", batch)
        self.schemas.setdefault("pool", rows.schema)
        new = self.version("pool", batch)
        number, state = new.count(), self.version("state", before).first()
        latest = new.orderBy(F.desc("ts"), F.desc("event_id")).limit(2 * self.w - 1).select("label").collect()
        windows = drift.LabelWindows(self.w, [*state["labels"], *[r["label"] for r in reversed(latest)]])
        changed, magnitude, kind = windows.drift(self.least) if number else (False, 0.0, "insufficient_data")
        self._write(self.spark.createDataFrame([(windows.labels(), state["pool"] + number)], self.schemas["state"]), "state", batch)
        scores, nodes, cache = (self.version(name, before) for name in ("scores", "forest", "cache"))
        score = scores.agg(F.avg("score")).first()[0] or 0.0
        due = bool(self.spark.range(1).select(drift.update_due(F.lit(changed), F.lit(score), F.lit(batch), self.due_threshold, self.every)).first()[0])

        matches = materialise(self._matches(new, cache), "co_matches")
        self._write(attention.next_attention(self.version("attention", before), matches.select("label", "sim"), 0.0), "attention", batch)

        trained, weak = 0, 0
        if due:
            training = materialise(self._training(batch, self.version("attention", batch)), "co_training")
            trained = training.count()
            weak = scores.where(F.col("score") < self.score_threshold).count() if trained else 0
            self._write(forest.retrain_weak_trees(nodes, scores, training, self.score_threshold, 43 + batch), "forest", batch)
            known = self.version("shapelets", before).unionByName(training.select("i", "label", "values")).dropDuplicates(["i"])
            self._write(self._used(known, self.version("forest", batch)), "shapelets", batch)
            discard(training)
        else:
            self._write(nodes, "forest", batch)
            self._write(self.version("shapelets", before), "shapelets", batch)

        walks = forest.predict_trees(new.select(F.col("i").alias("series_id"), "values"), self.version("forest", batch), self.version("shapelets", batch))
        walks = materialise(walks.join(new.select(F.col("i").alias("series_id"), F.col("label").alias("truth")), "series_id").select("tree_id", "path", (F.col("label") == F.col("truth")).alias("right")), "co_walks")
        usage = walks.groupBy("tree_id").agg(F.count(F.lit(1)).alias("predictions"), F.lit(0).alias("cache_hits"))
        fresh = forest.tree_scores(forest.node_accuracy(walks), usage)
        # a batch without shapelets leaves the scores as they were
        self._write(fresh if number else scores, "scores", batch)
        improvement = forest.score_improvement(scores, self.version("scores", batch)).agg(F.avg("improvement")).first()[0]

        survivors = materialise(self._survivors(new), "co_survivors")
        at = F.timestamp_seconds(F.unix_timestamp(F.lit(self.as_of).cast("timestamp")) + batch + 1)
        moved = match.usage_update(cache, matches.select("shapelet_id", (F.col("label") == F.col("c_label")).alias("success"), at.alias("at")))
        grown = materialise(moved.unionByName(classify.cache_rows(survivors, at, F.col("info_gain"))), "co_cache")
        self._write(match.pruned(grown), "cache", batch)
        facts = (batch + 1, number, changed, magnitude, kind, score, due, weak, trained, improvement, survivors.count(), state["pool"] + number, self.version("cache", batch).count())
        self._write(self.spark.createDataFrame([facts], LOG), "log", batch)
        discard(matches, walks, survivors, grown)
