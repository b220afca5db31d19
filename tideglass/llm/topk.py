"""Exact top-k search by distributed histogram selection.

Vectors become integers, so scores are integers with known bounds. Queries and
candidates are packed into blocks, and every query block meets every candidate
block once in each round. A round scores everything again (a matrix product of
two blocks) and returns a histogram of each query's scores inside its interval;
the sums of the histograms show which bin holds the k-th score, and that bin is
the next interval. When an interval is one score wide, that is the k-th score:
the last round keeps what is above it and, of the ties at it, the smallest ids.

A task's memory is two blocks and their scores. Histograms are small, whatever
the number of candidates, and are summed by key; scores are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.llm.common import map_slices, written
from tideglass.shared import materialise

K = 5
#: Components are multiplied by this before they are rounded down.
SCALE = 256
#: Queries and candidates of one block.
QUERY_BLOCK, BLOCK = 512, 4096
#: Bins of a histogram: a round narrows every interval by this factor.
BINS = 1024
#: Query blocks of up to so many bytes go to all tasks; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): ``floor(SCALE * x)`` of every component. Rows without id, without
    components, or with null or non-finite components are left out."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where((F.size(embedding) > 0) & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def _pack(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            out = {"dim": [], "ids": [], "data": [], "norm": []}
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for k in range(0, len(at), rows):
                    part = at[k : k + rows]
                    m = np.stack([flat[starts[i] : starts[i + 1]] for i in part]).astype(np.float64)
                    out["dim"].append(int(dim))
                    out["ids"].append(ids[part].astype(np.int64).tobytes())
                    out["data"].append(m.tobytes())
                    out["norm"].append(int(np.ceil(np.sqrt((m * m).sum(1).max()))))
            yield pa.record_batch([pa.array(out["dim"], pa.int32()), pa.array(out["ids"], pa.binary()), pa.array(out["data"], pa.binary()), pa.array(out["norm"], pa.int64())], names=["dim", "ids", "data", "norm"])

    return pack


#: The score of a query's own row.
_OWN = np.iinfo(np.int64).min
_BLOCK_SCHEMA = "dim int, ids binary, data binary, norm long"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of (vec_id, v) packed by task: dim, ids, data (doubles), norm (the longest vector's, rounded up)."""
    return rows.mapInArrow(_pack(size), _BLOCK_SCHEMA)


def _scores(q_ids: bytes, q_data: bytes, ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores); a query's own row scores the least integer, out of every interval."""
    q, c = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
    s = (np.frombuffer(q_data).reshape(-1, dim) @ np.frombuffer(data).reshape(-1, dim).T).astype(np.int64)
    s[q[:, None] == c[None, :]] = _OWN
    return q, c, s


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (query, bin) of one task; a bin is a BINS-th of the query's interval [low, low + span)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            q, _, s = _scores(r["q_ids"], r["q_data"], r["ids"], r["data"], r["dim"])
            low, span = (np.frombuffer(r[k], np.int64)[:, None] for k in ("low", "span"))
            inside = (s >= low) & (s < low + span)
            place = np.where(inside, (s - low) // -(-span // BINS), 0)
            flat = (np.arange(len(q))[:, None] * BINS + place)[inside]
            counts = np.bincount(flat, minlength=len(q) * BINS).reshape(len(q), BINS)
            for i, query in enumerate(q.tolist()):
                if query in sums:
                    sums[query] += counts[i]
                else:
                    sums[query] = counts[i]
            if len(sums) > 8 * QUERY_BLOCK:
                yield _histogram_rows(sums)
                sums = {}
    if sums:
        yield _histogram_rows(sums)


def _histogram_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    ids = np.fromiter(sums, np.int64, len(sums))
    counts = np.stack(list(sums.values()))
    row, place = np.nonzero(counts)
    return pa.record_batch([pa.array(ids[row]), pa.array(place.astype(np.int32)), pa.array(counts[row, place])], names=["query_id", "bin", "n"])


def _kept(k: int):
    """What is above the k-th score, and the smallest ids of those at it, for each pair of blocks."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for r in batch.to_pylist():
                q, c, s = _scores(r["q_ids"], r["q_data"], r["ids"], r["data"], r["dim"])
                least = np.frombuffer(r["low"], np.int64)
                for i in np.flatnonzero((s >= least[:, None]).any(1)):
                    at = np.flatnonzero(s[i] >= least[i])
                    at = at[np.lexsort((c[at], -s[i][at]))][:k]
                    out[0].append(np.full(len(at), q[i]))
                    out[1].append(c[at])
                    out[2].append(s[i][at])
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            yield pa.record_batch(cols, names=["query_id", "vec_id", "score"])

    return keep


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Queries of one dimension packed into numbered blocks, with their intervals."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for dim in sorted({len(r["v"]) for r in rows}):
                part = [r for r in rows if len(r["v"]) == dim]
                for k in range(0, len(part), QUERY_BLOCK):
                    some = part[k : k + QUERY_BLOCK]
                    packed = {name: np.array([r[name] for r in some], np.int64).tobytes() for name in ("query_id", "low", "span")}
                    out.append({"dim": dim, "q_ids": packed["query_id"], "q_data": np.array([r["v"] for r in some], np.float64).tobytes(), "low": packed["low"], "span": packed["span"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("dim", pa.int32()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("low", pa.binary()), ("span", pa.binary())]))

    packed = queries.select("query_id", "v", "low", "span").mapInArrow(pack, "dim int, q_ids binary, q_data binary, low binary, span binary")
    return materialise(packed, "topk_query_blocks")


def _met(candidates: DataFrame, query_blocks: DataFrame, n_queries: int, dim_bytes: int) -> DataFrame:
    """Every query block beside every candidate block of its dimension.

    This is the stated query set against all rows, in blocks. Few queries are
    sent to all tasks; more are dealt by dimension and block number instead,
    with a copy of a candidate block for each number.
    """
    if n_queries * dim_bytes <= BROADCAST_BYTES:
        return candidates.join(F.broadcast(query_blocks), "dim")
    parts = max(1, n_queries * dim_bytes // BROADCAST_BYTES)
    dealt = query_blocks.withColumn("part", F.pmod(F.xxhash64("q_ids"), F.lit(parts)))
    copies = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("long"))
    return copies.join(dealt, ["dim", "part"])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products with the other rows of its dimension.

    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where
    there are fewer candidates; ties go to the smaller id. A query is a row
    whose id ``is_query`` accepts; rows with the query's id are no candidates.
    Of repeated rows with one query id the one with the smallest vector asks; repeated candidates
    each take a rank. Null ids and null, empty or non-finite vectors take no
    part, so an empty table gives an empty result. Scores must stay below 2**53.
    """
    spark: SparkSession = vectors.sparkSession
    rows = integer_vectors(vectors, vec_id, embedding)
    packed = materialise(blocks(rows, BLOCK), "topk_candidates")
    query_rows = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    query_rows = materialise(query_rows, "topk_queries")
    facts = query_rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    longest = packed.agg(F.max("norm")).first()[0]
    result_schema = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], result_schema)
    bytes_each = 8 * (facts["dim"] + 3)
    norm = F.ceil(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).cast("long")
    bound = norm * F.lit(int(longest))
    state = query_rows.select("query_id", "v", (-bound).alias("low"), (2 * bound + 1).alias("span"), F.lit(k).cast("long").alias("need"))
    state = materialise(state, "topk_intervals_0")
    rounds = 0
    while state.where("span > 1").limit(1).count():
        rounds += 1
        met = _met(packed, _query_blocks(state.where("span > 1")), facts["n"], bytes_each)
        sums = map_slices(met, _histograms, "query_id long, bin int, n long", rows=4).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # from the highest bin down to the one in which the counts reach what is still needed
        hist = sums.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("h"))
        none = F.lit(None).cast("int")
        found = F.aggregate(
            "h",
            F.struct(F.col("need").alias("need"), none.alias("bin")),
            lambda a, x: F.when(a["bin"].isNotNull(), a).when(x["n"] >= a["need"], F.struct(a["need"].alias("need"), x["bin"].alias("bin"))).otherwise(F.struct((a["need"] - x["n"]).alias("need"), none.alias("bin"))),
        )
        step = state.join(hist, "query_id", "left").withColumn("at", F.when(F.col("h").isNotNull(), found))
        width = F.ceil(F.col("span") / BINS).cast("long")
        # with fewer candidates than asked for, everything from the low end on is kept
        open_, hit = F.col("span") > 1, F.col("at.bin").isNotNull()
        step = step.select(
            "query_id",
            "v",
            F.when(open_ & hit, F.col("low") + F.col("at.bin") * width).otherwise(F.col("low")).alias("low"),
            F.when(open_ & hit, F.least(width, F.col("span") - F.col("at.bin") * width)).otherwise(F.lit(1)).cast("long").alias("span"),
            F.when(open_ & hit, F.col("at.need")).otherwise(F.col("need")).alias("need"),
        )
        state = written(step, f"topk_intervals_{rounds}", 4)
    met = _met(packed, _query_blocks(state), facts["n"], bytes_each)
    kept = map_slices(met, _kept(k), "query_id long, vec_id long, score long", rows=4)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
