"""Work along ordered streams in parts: overlapping chunks, and scans by composed functions.

``placed`` sorts all rows by stream and order over the whole cluster and numbers them
without gaps, so that a stream, however hot, lies in as many partitions as its rows
need. ``in_chunks`` then walks over chunks of consecutive rows, each with the rows just
before it as a margin: what depends on a bounded number of rows before a row is worked
out in each chunk by itself. ``scanned`` is for states that depend on all rows before:
where every step is a clamped linear function, steps compose to one of the same form,
so chunks are folded apart and only one function a chunk is run through in order.

Null streams are streams, null order values come first, and columns that are handed
through keep their values and types exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.shared import discard, materialise

#: Rows of a chunk; a margin is no longer.
CHUNK = 16_384
#: A clamped linear function: min(high, max(low, slope * x + add)).
FUNCTION = ("slope", "add", "low", "high")
_ARROW = {"boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "long": pa.int64()}


def placed(rows: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """``rows``, written, with ``_row``: their places, from 0, by key and order (nulls first), all keys one after another.

    Partitions of the range sort are counted and the counts summed up, one row for each partition.
    """
    by = [F.asc_nulls_first(c) for c in (key, *order)]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    table = materialise(ranged, "placed")
    part = F.shiftright("_row", 33)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    numbered = table.join(F.broadcast(counts), part == F.col("_part")).withColumn("_row", F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1))
    numbered = numbered.drop("_part", "_before")
    numbered._written_to = table._written_to
    return numbered


def numbered(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """``rows``, written, with their places, from 0, in the whole order (nulls first)."""
    return placed(rows, order[0], order[1:]).withColumnRenamed("_row", name)


def sums_before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows``, written, with the sum of ``value`` over all rows before each, by ``order`` (nulls first, no ties).

    Sums run inside the partitions of a range sort, whose totals are summed up, one row for each.
    """
    by = F.asc_nulls_first(order)
    table = materialise(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "sums_before")
    earlier = lambda w: F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = table.groupBy("_part").agg(F.sum(value).alias("_v")).select("_part", earlier(Window.orderBy("_part")).alias("_before"))
    inside = table.withColumn("_v", F.col(value)).withColumn("_inside", earlier(Window.partitionBy("_part").orderBy(by)))
    return inside.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside", "_v")


def quantiles(rows: DataFrame, column: str, points: list[float], few: int = 10_000, bins: int = 1024) -> list[float | None]:
    """The quantiles of a column by linear interpolation between neighbours; None without values. Nulls and NaN are none.

    The k-th values that are asked for are closed in on by histograms of ``bins``
    ranges, each round over all rows, until the rows of an interval are few or all
    the same; only these come together.
    """
    v = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    facts = v.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    n = facts["n"]
    if not n:
        return [None] * len(points)
    at = [p * (n - 1) for p in points]
    # of each rank: the interval [low, high] that holds it, how many values lie below it, and in it
    held = {k: (facts["low"], facts["high"], 0, n) for x in at for k in (int(x), min(n - 1, int(x) + 1))}
    found: dict[int, float] = {}
    while len(found) < len(held):
        todo: dict[tuple, list[int]] = {}
        for k, (low, high, below, size) in held.items():
            if k not in found:
                if low == high:
                    found[k] = low
                else:
                    todo.setdefault((low, high, below, size), []).append(k)
        for (low, high, below, size), ranks in todo.items():
            inside = v.where((F.col("v") >= low) & (F.col("v") <= high))
            if size <= few:
                values = sorted(r["v"] for r in inside.collect())
                found.update({k: values[k - below] for k in ranks})
                continue
            # halves, so that no difference is beyond a double; the least and the highest value are always told apart
            width = high / 2 - low / 2
            place = F.floor(F.least(F.lit(bins - 1.0), (F.col("v") / 2 - low / 2) / width * bins)) if width > 0 else (F.col("v") > low).cast("long")
            counts = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
            for k in ranks:
                before = below
                for r in counts:
                    if k < before + r["n"]:
                        held[k] = (r["low"], r["high"], before, r["n"])
                        break
                    before += r["n"]
    return [found[int(x)] + (x - int(x)) * (found[min(n - 1, int(x) + 1)] - found[int(x)]) for x in at]


def same(a: object, b: object) -> bool:
    """Equality of stream ids in which null equals null, and NaN NaN."""
    return a == b or (a != a and b != b)


def with_margins(table: DataFrame, margin: int, size: int | None = None) -> DataFrame:
    """Rows of ``placed`` with their ``_chunk``, and the ``margin`` rows before each chunk once more, marked by ``_before``.

    A window by ``_chunk`` and key, ordered by ``_row``, sees what a window over the key's last ``margin`` rows sees.
    """
    size = max(size or CHUNK, margin, 1)
    chunk = F.floor(F.col("_row") / size)
    at = F.when(F.col("_row") % size >= size - margin, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return table.withColumn("_chunk", F.explode(at)).withColumn("_before", F.col("_row") < F.col("_chunk") * size)


def in_chunks(table: DataFrame, key: str, columns: list[str], new: str, start: Callable[[], object], step: Callable[[object, tuple, bool], list[tuple]], margin: int, keep: list[str], size: int | None = None) -> DataFrame:
    """Of each row of ``placed`` the rows that ``step`` gives: the ``keep`` columns as they are, and the ``new`` ones.

    ``step(state, row, wanted)`` gets a row's ``columns``; of rows of the margin (not
    ``wanted``) only the state counts. The state starts anew with each key and
    each margin, so it must follow from ``margin`` rows. Keep ``_chunk`` or
    ``_goes_on`` (the key began in an earlier chunk) to have them too.
    """
    size = max(size or CHUNK, margin, 1)
    chunk = F.floor(F.col("_row") / size)
    at = F.when(F.col("_row") % size >= size - margin, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    needed = [c for c in dict.fromkeys([key, "_row", *columns, *keep]) if c not in ("_chunk", "_goes_on")]
    slim = table.select(*[F.col(f"`{c}`") for c in needed], F.explode(at).alias("_chunk"))
    ordered = slim.repartition("_chunk").sortWithinPartitions("_chunk", "_row")
    names = [c.strip().split(" ") for c in new.split(",")]
    made = {"_chunk": "long", "_goes_on": "boolean"}
    schema = ", ".join([f"`{c}` {made.get(c) or table.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` {t}" for c, t in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, current, state, goes_on = -1, None, None, False
        for batch in batches:
            places, out, going = [], [[] for _ in names], []
            numbers = [batch.column(c).to_pylist() for c in ("_chunk", "_row", key)]
            values = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            for k, (c, row, own, value) in enumerate(zip(*numbers, values, strict=True)):
                wanted = row >= c * size
                if c != chunk or not same(own, current):
                    # a key whose first row here is of the margin began before the chunk
                    goes_on = not wanted
                    chunk, current, state = c, own, start()
                for found in step(state, value, wanted):
                    if wanted:
                        places.append(k)
                        going.append(goes_on)
                        for held, x in zip(out, found, strict=True):
                            held.append(x)
            own_columns = [pa.array(going, pa.bool_()) if c == "_goes_on" else batch.column(c).take(pa.array(places, pa.int64())) for c in keep]
            yield pa.record_batch([*own_columns, *[pa.array(held, _ARROW[t]) for held, (_, t) in zip(out, names, strict=True)]], names=[*keep, *[c for c, _ in names]])

    return ordered.mapInArrow(work, schema)


def after(f: tuple, g: tuple) -> tuple:
    """The function that is ``g`` after ``f``; slopes are not negative and bounds finite."""
    (a, c, low, high), (b, d, least, most) = f, g
    clamp = lambda x: min(most, max(least, x))
    return a * b, c * b + d, clamp(low * b + d), clamp(high * b + d)


class Running:
    """The composition of the functions of a chunk's rows of one key, from the first wanted row on, and what ``step`` needs of the rows before."""

    def __init__(self, held: object, low: float, high: float):
        self.held, self.function = held, (1.0, 0.0, low, high)


def scanned(rows: DataFrame, key: str, order: list[str], columns: list[str], held: Callable[[], object], step: Callable[[object, tuple], tuple | None], margin: int, start: float, low: float, high: float, name: str, size: int | None = None) -> DataFrame:
    """``rows`` with the running state ``name``: of each key ``start``, then x -> min(high, max(low, slope * x + add)) at each row.

    ``step(held, row)`` gives a row's (slope, add) from its ``columns`` and what
    is held of at most ``margin`` rows before it, or None for no change. All
    states lie within the bounds, ``start`` too.
    """
    if not low <= start <= high:
        raise ValueError(f"the state starts at {start}, outside of [{low}, {high}]")
    keep = [c for c in rows.columns if c != name]
    table = placed(rows.select(*[F.col(f"`{c}`") for c in keep]), key, order)

    def compose(state: Running, row: tuple, wanted: bool) -> list[tuple]:
        change = step(state.held, row)
        if not wanted:
            return []
        if change is not None:
            state.function = after(state.function, (*change, low, high))
        return [state.function]

    new = ", ".join(f"_{c} double" for c in FUNCTION)
    margin = max(1, margin)
    size = max(size or CHUNK, margin)
    chunked = in_chunks(table, key, columns, new, lambda: Running(held(), low, high), compose, margin, [*keep, "_row", "_chunk", "_goes_on"], size)
    folded = materialise(chunked, "folded")
    discard(table)
    own = lambda x: F.least(F.col("_high"), F.greatest(F.col("_low"), F.col("_slope") * x + F.col("_add")))
    coming = _carried(folded, key, start, size)
    joined = folded.join(coming, "_chunk", "left")
    return joined.select(*[F.col(f"`{c}`") for c in keep], own(F.when(F.col("_goes_on"), F.col("_coming")).otherwise(F.lit(start))).alias(name))


def _carried(folded: DataFrame, key: str, start: float, size: int) -> DataFrame:
    """(_chunk, _coming): the state with which a chunk's first key comes from the chunk before.

    One row for each chunk, its last, is run through in order: the composed
    function of the chunk's last key, which forgets what came where that key
    began in the chunk.
    """
    last = folded.where(F.col("_row") % size == size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch in batches:
            out = []
            for goes_on, slope, add, low, high in zip(*(batch.column(c).to_pylist() for c in ("_goes_on", "_slope", "_add", "_low", "_high")), strict=True):
                # in its first chunk a key begins anew
                state = min(high, max(low, slope * (state if goes_on else start) + add))
                out.append(state)
            yield pa.record_batch([pa.array([c + 1 for c in batch.column("_chunk").to_pylist()], pa.int64()), pa.array(out, pa.float64())], names=["_chunk", "_coming"])

    ordered = last.repartition(key).sortWithinPartitions(key, "_chunk")
    return ordered.select("_chunk", "_goes_on", "_slope", "_add", "_low", "_high").mapInArrow(run, "_chunk long, _coming double")


def folded_ends(rows: DataFrame, key: str, order: list[str], columns: list[str], held: Callable[[], object], step: Callable[[object, tuple], tuple | None], margin: int, low: float, high: float, size: int | None = None) -> DataFrame:
    """(key, slope, add): the composed functions of all rows of each key, of steps as in ``scanned`` whose bounds are never met."""
    table = placed(rows.select(*dict.fromkeys([key, *order, *columns])), key, order)

    def compose(state: Running, row: tuple, wanted: bool) -> list[tuple]:
        change = step(state.held, row)
        if wanted and change is not None:
            state.function = after(state.function, (*change, low, high))
        return [state.function[:2]] if wanted else []

    chunked = in_chunks(table, key, columns, "_slope double, _add double", lambda: Running(held(), low, high), compose, max(1, margin), [key, "_row", "_chunk"], size)
    ends = chunked.groupBy(key, "_chunk").agg(F.max_by(F.struct("_slope", "_add"), "_row").alias("f"))
    # a key has one row for each chunk that it meets
    run = F.aggregate(F.sort_array(F.collect_list(F.struct("_chunk", "f._slope", "f._add"))), F.struct(F.lit(1.0).alias("slope"), F.lit(0.0).alias("add")), lambda f, g: F.struct((f["slope"] * g["_slope"]).alias("slope"), (f["add"] * g["_slope"] + g["_add"]).alias("add")))
    return ends.groupBy(key).agg(run.alias("f")).select(key, "f.slope", "f.add")
