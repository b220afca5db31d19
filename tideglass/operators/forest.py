"""Bootstrap forest of similarity splits.

Shapelets have (i, label, values); ``pairs`` has all
their similarities (i, j, value). A forest is a flat table of nodes.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tideglass.functions import kernels
from tideglass.functions.scalars import draw
from tideglass.operators.extract import gains, gains_of_counts
from tideglass.operators.ordered import numbered
from tideglass.shared import discard, materialise

NODES = "tree_id int, node_id int, parent_id int, side string, depth int, node_type string, shapelet_id long, threshold double, label string, confidence double, n long, class_counts string"
THRESHOLDS = tuple(round(0.1 + 0.1 * k, 10) for k in range(9))
#: Shapelets up to which a tree grows in one task; with more, trees grow level by level over all tasks.
MOST_SHAPELETS = 200
#: Trees and nodes of a forest that goes with the tasks, and bytes of the shapelets that it compares with.
MOST_TREES, MOST_NODES, MOST_BYTES = 100, 100_000, 64 << 20


def bootstrap(shapelets: DataFrame, n_trees: int, seed: int = 42) -> DataFrame:
    """(tree_id, place, i, label): for each tree as many draws with replacement as there are shapelets."""
    placed = numbered(shapelets.select(F.col("i").cast("long").alias("i"), "label"), ["i"], "nth")
    n = placed.count()
    # tasks deal the places of a tree among themselves
    places = shapelets.sparkSession.range(n).select(F.col("id").alias("place"))
    trees = places.select("place", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id")) if n_trees else places.limit(0).withColumn("tree_id", F.lit(0))
    return trees.withColumn("nth", draw(seed, F.col("tree_id"), F.col("place")) % max(1, n)).join(placed, "nth").select("tree_id", "place", "i", "label")


def best_split(rows: DataFrame, pairs: DataFrame, least: int = 2, spread: float = 1.0) -> DataFrame:
    """(tree_id, threshold, gain) of each tree's root rows: the best similarity split around its first row.

    Left is below a threshold of 0.1 to 0.9, right at or above it; each side
    needs ``least`` rows; the lowest of the best thresholds; no row without a
    gain. ``spread`` widens similarities that lie close together.
    """
    reference = rows.groupBy("tree_id").agg(F.min_by("i", "place").alias("ref"))
    sims = rows.join(reference, "tree_id").join(pairs.select(F.col("i").alias("ref"), F.col("j").alias("i"), "value"), ["ref", "i"])
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    sides = sims.select("tree_id", "label", F.explode(grid).alias("threshold"), "value").withColumn("left", F.when(F.col("value") * spread < F.col("threshold"), 1).otherwise(0))
    enough = (F.col("n_left") >= least) & (F.col("n_right") >= least) & (F.round("gain", 9) > 0)
    best = F.max(F.when(enough, F.struct(F.round("gain", 9).alias("g"), (-F.col("threshold")).alias("t"), F.col("gain").alias("gain"))))
    return gains(sides, ["tree_id"]).groupBy("tree_id").agg(best.alias("b")).where("b is not null").select("tree_id", (-F.col("b.t")).alias("threshold"), F.col("b.gain").alias("gain"))


def _entropy(labels: list) -> float:
    n = len(labels)
    return -sum(c / n * np.log2(c / n) for c in Counter(labels).values()) if n else 0.0


def train_forest(shapelets: DataFrame, n_trees: int = 10, seed: int = 42, max_depth: int = 5, min_split: int = 4, min_leaf: int = 2, tree_ids: list[int] | None = None) -> DataFrame:
    """Nodes of ``n_trees`` trees, grown from their bootstrap rows.

    A node's reference is the first of its own rows; a node that is pure, small
    or without a gain is a leaf of its majority label (the first in order of
    ties) with confidence 1. ``tree_ids`` names other trees than 0, 1, ...
    Up to ``MOST_SHAPELETS`` shapelets, a tree is one task's work; with more,
    all trees grow together, level by level.
    """
    many = shapelets.limit(MOST_SHAPELETS + 1).count() > MOST_SHAPELETS
    values = shapelets.select("i", "values")
    rows = bootstrap(shapelets, n_trees, seed)
    if tree_ids is not None:
        rows = rows.withColumn("tree_id", F.element_at(F.array(*[F.lit(t) for t in tree_ids]), F.col("tree_id") + 1))
    rows = rows.join(values, "i")
    if many:
        return _grown_by_levels(rows, max_depth, min_split, min_leaf)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place").reset_index(drop=True)
        x = [np.asarray(v, float) for v in frame["values"]]
        labels, ids, tree = list(frame["label"]), list(frame["i"]), int(frame["tree_id"].iloc[0])
        out: list[tuple] = []

        def node(at: list[int], parent: int, side: str, depth: int) -> None:
            own = len(out)
            mine = [labels[k] for k in at]
            counts = Counter(mine)
            text = json.dumps(dict(sorted(counts.items())))
            best = (0.0, None, None)
            if len(counts) > 1 and len(at) >= min_split and depth < max_depth:
                sims = 1 / (1 + kernels.distances([x[k] for k in at], [x[at[0]]] * len(at)))
                for t in THRESHOLDS:
                    left = [k for k, s in zip(at, sims, strict=True) if s < t]
                    right = [k for k, s in zip(at, sims, strict=True) if s >= t]
                    if min(len(left), len(right)) >= min_leaf:
                        gain = _entropy(mine) - sum(len(p) / len(at) * _entropy([labels[k] for k in p]) for p in (left, right))
                        if gain > best[0] + 1e-12:
                            best = (gain, t, (left, right))
            if best[1] is None:
                label = max(sorted(counts), key=lambda c: counts[c])
                out.append((tree, own, parent, side, depth, "LDN", None, None, label, 1.0, len(at), text))
                return
            out.append((tree, own, parent, side, depth, "PDN" if depth % 2 == 0 else "SDN", ids[at[0]], best[1], None, None, len(at), text))
            node(best[2][0], own, "left", depth + 1)
            node(best[2][1], own, "right", depth + 1)

        node(list(range(len(frame))), -1, "root", 0)
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in NODES.split(", ")]).astype({"shapelet_id": "Int64"})

    return rows.groupBy("tree_id").applyInPandas(grow, NODES)


@F.pandas_udf(DoubleType())
def _similarity(values: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series(1 / (1 + kernels.distances(values.tolist(), other.tolist())))


def _grown_by_levels(rows: DataFrame, max_depth: int, min_split: int, min_leaf: int) -> DataFrame:
    """The nodes of all trees from rows (tree_id, place, i, label, values).

    A level counts labels by node, compares all rows to the references of their
    nodes, counts labels by ranges of similarity, and deals the rows to the sides
    of the best thresholds. What comes to the driver are the nodes, whose number the depth bounds.
    """
    keys = ["tree_id", "node"]
    spark, found = rows.sparkSession, {}
    if rows.select("tree_id").distinct().count() > MOST_TREES:
        raise ValueError(f"a forest has at most {MOST_TREES} trees")
    level = materialise(rows.withColumn("node", F.lit(1)), "forest_level")
    for depth in range(max_depth + 1):
        counts = level.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "i")).alias("first"))
        facts = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("label", F.lit("\0")), "n")))).alias("counts")).collect()
        for r in facts:
            found[r["tree_id"], r["node"]] = {"n": r["n"], "ref": r["first"]["i"], "counts": {None if x == "\0" else x: c for x, c in r["counts"].items()}, "split": None}
        grows = [(r["tree_id"], r["node"], r["first"]["i"], r["first"]["place"]) for r in facts if r["n"] >= min_split and len(r["counts"]) > 1]
        if depth == max_depth or not grows:
            break
        open_nodes = F.broadcast(spark.createDataFrame(grows, "tree_id int, node int, ref long, ref_place long"))
        # one row for each node that grows
        references = level.join(open_nodes, keys).where("place = ref_place").select(*keys, F.col("values").alias("ref_values"))
        sims = level.join(F.broadcast(references), keys).withColumn("sim", _similarity("values", "ref_values")).drop("ref_values")
        sims = materialise(sims, "forest_sims")
        above = sum((F.col("sim") >= t).cast("int") for t in THRESHOLDS)
        ranges = sims.groupBy(*keys, "label", above.alias("above")).agg(F.count(F.lit(1)).alias("n"))
        grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(THRESHOLDS)])
        sides = ranges.select(*keys, "label", "n", "above", F.explode(grid).alias("g")).groupBy(*keys, F.col("g.t").alias("threshold"), "label").agg(F.sum(F.when(F.col("above") <= F.col("g.k"), F.col("n")).otherwise(0)).alias("l"), F.sum(F.when(F.col("above") > F.col("g.k"), F.col("n")).otherwise(0)).alias("r"))
        good = gains_of_counts(sides, keys).where((F.col("n_left") >= min_leaf) & (F.col("n_right") >= min_leaf) & (F.col("gain") > 1e-12))
        best = good.groupBy(*keys).agg(F.max(F.struct(F.round("gain", 11).alias("g"), (-F.col("threshold")).alias("t"))).alias("b")).select(*keys, (-F.col("b.t")).alias("threshold")).collect()
        for r in best:
            found[r["tree_id"], r["node"]]["split"] = r["threshold"]
        splits = F.broadcast(spark.createDataFrame([tuple(r) for r in best], "tree_id int, node int, threshold double"))
        below = sims.join(splits, keys).withColumn("node", F.col("node") * 2 + (F.col("sim") >= F.col("threshold")).cast("int")).drop("sim", "threshold")
        grown = materialise(below, "forest_level")
        discard(level, sims)
        level = grown
    discard(level)
    out: list[tuple] = []

    def add(tree: int, node: int, parent: int, side: str, depth: int, number: list[int]) -> None:
        own, f = number[0], found[tree, node]
        number[0] += 1
        text = json.dumps(dict(sorted(f["counts"].items(), key=lambda c: (c[0] is not None, c[0]))))
        if f["split"] is None:
            label = max(sorted(f["counts"], key=lambda c: (c is not None, c)), key=lambda c: f["counts"][c])
            out.append((tree, own, parent, side, depth, "LDN", None, None, label, 1.0, f["n"], text))
            return
        out.append((tree, own, parent, side, depth, "PDN" if depth % 2 == 0 else "SDN", f["ref"], f["split"], None, None, f["n"], text))
        add(tree, 2 * node, own, "left", depth + 1, number)
        add(tree, 2 * node + 1, own, "right", depth + 1, number)

    for tree in sorted({t for t, _ in found}):
        add(tree, 1, -1, "root", 0, [0])
    return spark.createDataFrame(out, NODES)


class Walker:
    """A tree as arrays: the place of each node's shapelet, its threshold, the nodes below it, and its label."""

    def __init__(self, nodes: list[dict], places: dict[int, int]):
        by = {n["node_id"]: k for k, n in enumerate(nodes)}
        self.ids = np.array([n["node_id"] for n in nodes])
        self.leaf = np.array([n["label"] is not None or n["node_type"] == "LDN" for n in nodes])
        self.label = [n["label"] for n in nodes]
        self.confidence = [n["confidence"] for n in nodes]
        # a shapelet that is not there is as like as not
        self.place = np.array([places.get(n["shapelet_id"], len(places)) for n in nodes])
        self.threshold = np.array([n["threshold"] if not leaf else 0.0 for n, leaf in zip(nodes, self.leaf, strict=True)], float)
        self.below = np.zeros((len(nodes), 2), int)
        for k, n in enumerate(nodes):
            if n["parent_id"] in by:
                self.below[by[n["parent_id"]], int(n["side"] == "right")] = k
        self.root = by[0]

    def walk(self, sims: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(leaf of each series, nodes that were visited at each step, -1 after the leaf) from similarities [shapelet, series]."""
        at = np.full(sims.shape[1], self.root)
        steps, going = [self.ids[at]], ~self.leaf[at]
        while going.any():
            k = np.flatnonzero(going)
            right = sims[self.place[at[k]], k] >= self.threshold[at[k]]
            at[k] = self.below[at[k], right.astype(int)]
            steps.append(np.where(going, self.ids[at], -1))
            going = going & ~self.leaf[at]
        return at, steps


def predict_trees(series: DataFrame, nodes: DataFrame, shapelets: DataFrame) -> DataFrame:
    """(series_id, tree_id, label, confidence, path): every series walked down every tree.

    The forest and the shapelets that it compares with go with the tasks; more than
    ``MOST_NODES`` nodes or ``MOST_BYTES`` of shapelets are an error, found before anything is sent. All series of
    a batch go down a tree together, a level at a time.
    """
    forest = [r.asDict() for r in nodes.limit(MOST_NODES + 1).collect()]
    if len(forest) > MOST_NODES:
        raise ValueError(f"a forest that goes with the tasks has at most {MOST_NODES} nodes")
    asked = shapelets.join(F.broadcast(nodes.select(F.col("shapelet_id").alias("i")).distinct()), "i", "left_semi")
    size = asked.agg(F.coalesce(F.sum(8 * F.size("values")), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"a forest that goes with the tasks compares with at most {MOST_BYTES} bytes of shapelets")
    used = {r["i"]: np.asarray(r["values"], float) for r in asked.select("i", "values").collect()}
    places, known = {i: k for k, i in enumerate(used)}, list(used.values())
    trees: dict[int, list[dict]] = {}
    for n in forest:
        trees.setdefault(n["tree_id"], []).append(n)
    walkers = {t: Walker(own, places) for t, own in sorted(trees.items())}
    kind = series.schema["series_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(v, float) for v in batch.column(1).to_pylist()]
            # the similarities of all series of a batch to a shapelet are measured at once
            sims = np.full((len(known) + 1, len(rows)), 0.5)
            for k, x in enumerate(known):
                sims[k] = 1 / (1 + kernels.distances(rows, [x] * len(rows)))
            for t, tree in walkers.items():
                at, steps = tree.walk(sims)
                paths = [p[p >= 0].tolist() for p in np.stack(steps, 1)]
                columns = [pa.array([t] * len(rows), pa.int32()), pa.array([tree.label[k] for k in at], pa.string()), pa.array([tree.confidence[k] for k in at], pa.float64()), pa.array(paths, pa.list_(pa.int32()))]
                yield pa.record_batch([batch.column(0), *columns], names=["series_id", "tree_id", "label", "confidence", "path"])

    return series.select("series_id", "values").mapInArrow(walk, f"series_id {kind}, tree_id int, label string, confidence double, path array<int>")


def vote(predictions: DataFrame) -> DataFrame:
    """(series_id, label, confidence, votes): the majority of the labelled trees, ties by label; null and 0 without any."""
    per = predictions.groupBy("series_id", "label").agg(F.count("label").alias("n"), F.sum(F.when(F.col("label").isNotNull(), F.col("confidence"))).alias("c"))
    best = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("n")).alias("n"), "label")))
    whole = per.groupBy("series_id").agg(best.alias("b"), F.sum("n").alias("all"), F.sum("c").alias("c"))
    confidence = F.when(F.col("all") > 0, 0.7 * F.round("c", 9) / F.nullif(F.col("all"), F.lit(0)) - 0.3 * F.col("b.n") / F.nullif(F.col("all"), F.lit(0))).otherwise(0.0)
    return whole.select("series_id", F.col("b.label").alias("label"), confidence.alias("confidence"), F.coalesce(-F.col("b.n"), F.lit(0)).cast("long").alias("votes"))


def leaf_class_probabilities(rows: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(leaf, label, share) from rows (leaf, label); of ``leaves`` (leaf, label), one without rows gives its own label the share 1."""
    counts = rows.groupBy("leaf", "label").count()
    shares = counts.select("leaf", "label", (F.col("count") / F.sum("count").over(Window.partitionBy("leaf"))).alias("share"))
    if leaves is None:
        return shares
    filled = rows.select(F.col("leaf").alias("_leaf")).distinct()
    empty = leaves.join(filled, F.col("leaf").eqNullSafe(F.col("_leaf")), "left_anti").select("leaf", "label", F.lit(1.0).alias("share"))
    return shares.unionByName(empty)


def node_accuracy(walks: DataFrame) -> DataFrame:
    """(tree_id, node_id, visits, correct, accuracy) from walks (tree_id, path, right)."""
    steps = walks.select("tree_id", F.explode("path").alias("node_id"), F.coalesce("right", F.lit(False)).cast("int").alias("right"))
    found = steps.groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("visits"), F.sum("right").alias("correct"))
    return found.withColumn("accuracy", F.col("correct") / F.col("visits"))


def tree_scores(accuracy: DataFrame, usage: DataFrame) -> DataFrame:
    """(tree_id, score): 0.6 * cache hits over predictions + 0.4 * mean node accuracy; 0 without predictions."""
    mean = accuracy.groupBy("tree_id").agg(F.avg("accuracy").alias("a"))
    hit = F.when(F.col("predictions") > 0, F.col("cache_hits") / F.col("predictions"))
    return usage.join(mean, "tree_id", "left").select("tree_id", F.when(F.col("predictions") > 0, 0.6 * hit + 0.4 * F.coalesce("a", F.lit(0.0))).otherwise(0.0).alias("score"))


def forest_stats(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("low"), F.max("score").alias("high"), F.sum((F.col("score") >= threshold).cast("long")).alias("good"))


def retrain_weak_trees(nodes: DataFrame, scores: DataFrame, new: DataFrame, threshold: float = 0.5, seed: int = 43) -> DataFrame:
    """The forest with the trees below the threshold grown anew from the ``new`` shapelets; as it was without new ones."""
    weak = sorted(r[0] for r in scores.where(F.col("score") < threshold).select("tree_id").collect())
    if not weak or not new.limit(1).count():
        return nodes
    return nodes.where(~F.col("tree_id").isin(weak)).unionByName(train_forest(new, len(weak), seed, tree_ids=weak))


def retraining_rows(candidates: DataFrame, attention: DataFrame, k: int = 5, least: int = 10, seed: int = 42) -> DataFrame:
    """All of at most ``least`` candidates (i, label); else those of the k labels (label, weight) of most attention, filled up to ``least``."""
    if candidates.count() <= least:
        return candidates
    best = attention.orderBy(F.desc(F.round("weight", 9)), "label").limit(k).select("label")
    chosen = candidates.join(F.broadcast(best), "label", "left_semi").select(candidates.columns)
    missing = least - chosen.count()
    if missing <= 0:
        return chosen
    rest = candidates.join(chosen.select("i"), "i", "left_anti").select(candidates.columns)
    return chosen.union(rest.orderBy(draw(seed, F.col("i")), "i").limit(missing))


def score_improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tree_id, improvement) of the trees in both, with the mean over them."""
    both = before.select("tree_id", F.col("score").alias("old")).join(after.select("tree_id", F.col("score").alias("new")), "tree_id")
    found = both.select("tree_id", (F.col("new") - F.col("old")).alias("improvement"))
    return found.withColumn("mean_improvement", F.avg("improvement").over(Window.partitionBy()))
