"""Centroid clustering (Lloyd's rounds) of integer vectors by partial-distance search.

Vectors become integers and are written once. A round reads them, finds each one's
nearest centroid and hands on, for each task and centroid, a count and sums: the new
centroids are exact, whatever the order of rows and tasks. Centroids (a fixed number
of fixed size) are all that comes to the driver and goes with the tasks.

The search takes the dimensions in falling order of their variance, a slice at a
time. The centroid that is nearest on the first slice is measured in full; every other
one goes on from its first slice and is abandoned for a vector as soon as its sum is
strictly above the best whole distance that the vector has. What survives is measured
in all dimensions, so the result, ties included, is that of the full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import map_slices
from tideglass.shared import materialise

#: Components are multiplied by this before they are rounded down.
SCALE = 1024
DIMENSIONS, CENTROIDS, ROUNDS, SEED = 64, 8, 10, 3
#: Dimensions that are added before survivors are looked at again.
SLICE = 8
#: Integer components are below this in size, so that distances and a task's sums fit 64 bits; a larger one is an error.
LARGEST = 1 << 27


@dataclass
class Clustering:
    """Final centroids, the distances summed over each one's vectors, and the order in which dimensions are searched."""

    centroids: list[list[int]]
    inertia: list[int]
    order: list[int]


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): ``floor(SCALE * x)`` of every component, of rows with exactly ``dimensions`` components, none null or
    non-finite. A null id stays; a component of ``LARGEST`` or more is an error."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.floor(c * F.lit(float(SCALE)))
    v = F.transform(x, lambda c: F.when(F.abs(c * F.lit(float(SCALE))) < LARGEST, whole(c).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {SCALE} must be below {LARGEST}")).cast("int")))
    return vectors.where((F.size(embedding) == dimensions) & ~bad).select(F.col(vec_id).alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, number: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors of the smallest sha256 of ``seed:vec_id``, in that order; of equal ids the smaller vector first. Rows with a null id are none."""
    drawn = vectors.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [list(r["v"]) for r in drawn.orderBy("h", "v").limit(number).collect()]


def by_variance(vectors: DataFrame, dimensions: int = DIMENSIONS) -> list[int]:
    """Dimensions in falling order of their variance, ties by number."""
    found = vectors.agg(*[F.var_pop(F.get("v", F.lit(d))).alias(str(d)) for d in range(dimensions)]).first()
    return sorted(range(dimensions), key=lambda d: (-(found[d] or 0.0), d))


def nearest(vectors: np.ndarray, centroids: np.ndarray, width: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, ties to the smaller number, by partial distances."""
    n, dimensions = vectors.shape
    head = np.stack([np.square(vectors[:, :width] - c[:width]).sum(1) for c in centroids], 1)
    label = head.argmin(1)
    rest = vectors[:, width:] - centroids[label, width:]
    best = head[np.arange(n), label] + np.square(rest).sum(1)
    first = label.copy()
    for k, centroid in enumerate(centroids):
        alive = np.flatnonzero((first != k) & (head[:, k] <= best))
        partial = head[alive, k]
        for at in range(width, dimensions, width):
            partial = partial + np.square(vectors[alive, at : at + width] - centroid[at : at + width]).sum(1)
            on = partial <= best[alive]
            alive, partial = alive[on], partial[on]
        # survivors have all dimensions; an equal one wins by a smaller number
        won = (partial < best[alive]) | (k < label[alive])
        best[alive[won]], label[alive[won]] = partial[won], k
    return label, best


def _matrix(column: pa.Array, order: list[int]) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)[:, order].astype(np.int64)


def _round(vectors: DataFrame, centroids: list[list[int]], order: list[int]) -> dict[int, tuple[int, list[int], int]]:
    """{centroid: (vectors, sums by dimension, summed distances)} after each vector has gone to its nearest one."""
    table = np.array(centroids, np.int64)[:, order]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, far = np.zeros(len(table), np.int64), np.zeros(table.shape, np.int64), [0] * len(table)
        for batch in batches:
            v = _matrix(batch.column(0), order)
            label, best = nearest(v, table)
            for k in np.unique(label):
                mine = label == k
                number[k] += mine.sum()
                total[k] += v[mine].sum(0)
                far[k] += sum(best[mine].tolist())
        there = np.flatnonzero(number)
        parts = [total[k][np.argsort(order)].tolist() for k in there]
        yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(number[there]), pa.array(parts, pa.list_(pa.int64())), pa.array([str(far[k]) for k in there], pa.string())], names=["k", "n", "sums", "far"])

    parts = map_slices(vectors.select("v"), sums, "k int, n long, sums array<long>, far string")
    whole = parts.groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(d))) for d in range(table.shape[1])]).alias("sums"), F.sum(F.col("far").cast("decimal(38,0)")).alias("far"))
    return {r["k"]: (r["n"], r["sums"], int(r["far"])) for r in whole.collect()}


def fit(vectors: DataFrame, number: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> Clustering:
    """Centroids of written vectors (vec_id, v) after ``rounds`` rounds; without vectors there are none, and of fewer vectors than ``number`` as many."""
    centroids = first_centroids(vectors, number, seed)
    order = by_variance(vectors, dimensions) if centroids else list(range(dimensions))
    if not centroids:
        return Clustering([], [], order)
    for _ in range(rounds):
        found = _round(vectors, centroids, order)
        centroids = [[s // found[k][0] for s in found[k][1]] if k in found else c for k, c in enumerate(centroids)]
    last = _round(vectors, centroids, order)
    return Clustering(centroids, [last[k][2] if k in last else 0 for k in range(len(centroids))], order)


def clustered(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", number: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Rows whose vector is null, of another length, or has null or non-finite
    components take no part. Rows with a null id are clustered, but are never
    first centroids; without any id there are no centroids and no rows. Repeated rows are
    rows like others; equal ones share a cluster. An empty table gives an empty
    result. Other columns play no part, whatever their names.
    """
    rows = materialise(integer_vectors(vectors, vec_id, embedding, dimensions), "cluster_vectors")
    model = fit(rows, number, rounds, seed, dimensions)
    kind = rows.schema["vec_id"].dataType.simpleString()
    order, table = model.order, np.array(model.centroids, np.int64).reshape(len(model.centroids), dimensions)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids]
    inertia, whole = model.inertia, sum(model.inertia)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, best = nearest(_matrix(batch.column(1), order), table[:, order])
            own = [pa.array([x[k] for k in label.tolist()], t) for x, t in ((inertia, pa.int64()), ([whole] * len(inertia), pa.int64()), (digests, pa.string()))]
            yield pa.record_batch([batch.column(0), pa.array(label.astype(np.int32)), pa.array(best), *own], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return map_slices(rows if model.centroids else rows.limit(0), assign, schema)


def oracle_sql(number: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> str:
    """The same in DuckDB: a table of centroids and one of assignments for each round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < {number})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, k, list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM v, c{n})")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{n} JOIN v USING (r), range(1, {dimensions + 1}) t(i) GROUP BY k, i)")
            parts.append(f"m{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY k)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))")
    return f"""WITH {', '.join(parts)},
i AS (SELECT k, CAST(sum(d) AS BIGINT) AS own FROM a{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, own AS cluster_inertia, CAST((SELECT sum(own) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN i USING (k) JOIN c{rounds} USING (k)"""
