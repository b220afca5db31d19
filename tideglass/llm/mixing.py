"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets ``floor(r)`` sure copies and a fraction ``r - floor(r)`` of
one more, where ``r`` is its source's target over its source's size. The
fractions are rounded in pairs: one unit of a pair takes mass (in words) from
the other until one of them is whole or empty, with the odds that keep every
document's expected copies. A pair keeps its total mass, so a group of any size
is off by less than one document, and as long documents come first, by less than
a short one mostly. Groups of about ``FAN_IN`` documents are
rounded at once, each leaves one undecided residual, and the residuals of
``FAN_IN`` groups meet on the next level, up to one residual per source.

Only DataFrame functions are used. No text is shuffled: the first step reduces
a document to (doc_id, source, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import WORD_PATTERN, fresh
from tideglass.shared import discard, materialise

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at this many times its source's size.
MOST = 3
#: Units that one group of the reduction tree takes.
FAN_IN = 64
#: Rows that are alike and are made again from their number at once.
ALIKE = 4096
SEED = 20_240_607


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the size is the number of words; a null text has none."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` in order with ``nth`` (from 0) and the sums of columns over all rows before, written once.

    Ranges of the order are summed apart, and only their sums are run through
    in one place.
    """
    parts = materialise(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), f"{name}_parts")
    one = {"nth": F.lit(1).cast("long"), **{k: F.col(c) for k, c in sums.items()}}
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in one.items()])
    whole = whole.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in one])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = parts.join(F.broadcast(whole), "_part")  # one row for each range
    out = materialise(found.select(*rows.columns, *[(F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in one.items()]), name)
    discard(parts)
    return out


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target), one row for each source.

    Shares 100% of all words by weight. Where a target passes ``most`` times its
    source's size it stops there and the excess goes to the others by weight.
    That fixed point is ``min(weight * level, cap)``; the level is found in the
    order in which the sources fill up. Sources are ordered by code point, null
    last, and there may be as many as fit a table.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    named = _running(per_source, [F.col("source").asc_nulls_last()], {}, "mix_sources").withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    whole = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    filled = _running(named.withColumn("fill", F.col("cap").cast("double") / F.col("weight")).withColumnRenamed("nth", "place"), [F.col("fill"), F.col("place")], {"cap_before": "cap", "weight_before": "weight"}, "mix_fills")
    level = (F.lit(whole["size"]) - F.col("cap_before")).cast("double") / (F.lit(whole["weight"]) - F.col("weight_before"))
    found = filled.select(level.alias("level"), "fill", "nth").where("level <= fill").agg(F.min_by("level", F.struct("fill", "nth"))).first()[0]
    return filled.select("source", "source_size", "n_docs", F.least(F.col("weight") * F.lit(float(found or 0.0)), F.col("cap").cast("double")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the given values."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _unit() -> Column:
    """Long documents first: what a group leaves undecided is then one of its shortest."""
    return F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(SEED + 1), "doc_id").alias("draw"), "doc_id", "size", "rows", "sure", "mass")


def _round_group(units: Column, level: int, id_type: str) -> Column:
    """Fold an array of (order, draw, doc_id, size, rows, sure, mass) into (out: decided units, rest: the undecided one)."""
    unit = f"doc_id:{id_type},size:bigint,rows:bigint,sure:bigint"
    start = F.struct(F.lit(None).cast(f"struct<{unit},mass:double>").alias("rest"), F.array().cast(f"array<struct<{unit},take:int>>").alias("out"))

    def fields(x: Column) -> list[Column]:
        return [x[c].alias(c) for c in ("doc_id", "size", "rows", "sure")]

    def decided(x: Column, take: int) -> Column:
        return F.struct(*fields(x), F.lit(take).alias("take"))

    def left(x: Column, mass: Column) -> Column:
        return F.struct(*fields(x), mass.alias("mass"))

    def merge(acc: Column, x: Column) -> Column:
        a = acc["rest"]
        up = F.least(a["size"] - a["mass"], x["mass"])
        down = F.least(a["mass"], x["size"] - x["mass"])
        goes_up = (up + down == 0) | (_uniform(F.lit(SEED), F.lit(level), a["doc_id"], x["doc_id"], a["size"], x["size"]) * (up + down) < down)
        # which of the two is settled, and how
        pick = (
            F.when(goes_up & (a["size"] - a["mass"] <= x["mass"]), F.struct(left(x, x["mass"] - up).alias("rest"), decided(a, 1).alias("done")))
            .when(goes_up, F.struct(left(a, a["mass"] + up).alias("rest"), decided(x, 0).alias("done")))
            .when(a["mass"] <= x["size"] - x["mass"], F.struct(left(x, x["mass"] + down).alias("rest"), decided(a, 0).alias("done")))
            .otherwise(F.struct(left(a, a["mass"] - down).alias("rest"), decided(x, 1).alias("done")))
        )
        both = F.transform(F.array(pick), lambda p: F.struct(p["rest"].alias("rest"), F.concat(acc["out"], F.array(p["done"])).alias("out")))
        return F.when(a.isNull(), F.struct(left(x, x["mass"]).alias("rest"), acc["out"].alias("out"))).otherwise(both[0])

    return F.aggregate(units, start, merge)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fan_in: int = FAN_IN) -> DataFrame:
    """How often the mix takes each document.

    Returns one row for each input row: doc_id, source, size, source_size,
    target, copies (0 to ``most``), taken (copies * size). A null text has size
    0, a null source is a source of its own, an empty table gives an empty
    result, and documents without words take part with 0 taken words. Rows with
    a null id take part like others. Rows of one id, source and size are alike:
    they are rounded together, so that any number of them is one unit, and as
    many of them as the mix takes once more have one copy more. Draws depend on
    ids and sizes alone, so reruns agree. Other columns play no part.
    """
    rows = materialise(sized(docs), "mix_sizes")
    goals = materialise(targets(rows, weights, most), "mix_targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumnRenamed("source", "goal_source").withColumn("r", copies).withColumn("base", F.floor("r").cast("int")).withColumn("groups", F.ceil(F.col("n_docs") / fan_in))
    alike = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    more = (F.col("r") - F.col("base")) * F.col("rows")
    units = alike.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source").withColumn("sure", F.floor(more)).withColumn("mass", (more - F.col("sure")) * F.col("size"))
    keys = ["source", "source_size", "target", "base"]
    unit = ["doc_id", "size", "rows", "sure"]
    open_unit = F.col("mass") > 0
    settled = [units.where(~open_unit).select(*unit, F.lit(0).alias("take"), *keys)]
    largest = goals.agg(F.max("groups")).first()[0] or 1
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.col("groups"))
    state = units.where(open_unit).select(*keys, place.alias("grp"), _unit().alias("unit"))
    level, id_type = 0, docs.schema["doc_id"].dataType.simpleString()
    while True:
        folded = state.groupBy(*keys, "grp").agg(_round_group(F.array_sort(F.collect_list("unit")), level, id_type).alias("fold"))
        folded = materialise(folded, f"mix_level_{level}")
        settled.append(folded.select(F.inline("fold.out"), *keys).select(*unit, "take", *keys))
        rest = folded.where(F.col("fold.rest").isNotNull()).select(*keys, "grp", "fold.rest.*")
        if largest <= 1:
            break
        largest = -(-largest // fan_in)
        level += 1
        state = rest.select(*keys, F.floor(F.col("grp") / fan_in).alias("grp"), _unit().alias("unit"))
    last = _uniform(F.lit(SEED + 2), F.col("doc_id"), F.col("size")) * F.col("size") < F.col("mass")
    settled.append(rest.select(*unit, last.cast("int").alias("take"), *keys))
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    # one row for each of the rows that are alike, in parts of a bounded number
    result = result.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / ALIKE))).alias("part"))
    result = result.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(ALIKE).cast("long"), F.col("rows") - F.col("part") * ALIKE))).alias("nth"))
    n = F.col("base") + F.when(F.col("part") * ALIKE + F.col("nth") <= F.col("sure") + F.col("take"), 1).otherwise(0)
    return result.select("doc_id", "source", "size", "source_size", "target", n.cast("int").alias("copies"), (n * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row as often as ``mix`` takes it, with the columns of ``docs``, whatever their names.

    Copies are joined by doc_id where ids tell the rows apart. Where ids are null
    or repeated, the rows are numbered and written first, and the number stands
    for the id; the draws then depend on how the table is cut into partitions.
    """
    key, copies, nth = (fresh(docs.columns, name) for name in ("_mix_key", "_mix_copies", "_mix_nth"))
    facts = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if facts["rows"] == facts["ids"]:
        rows, own = docs, docs["doc_id"]
        slim = docs
    else:
        number = fresh(docs.columns, "_mix_row")
        rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "mix_rows")
        own = rows[number]
        slim = rows.select(F.col(number).alias("doc_id"), "source", "text")
    taken = mix(slim, **settings).where("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias(copies))
    columns = [rows[f"`{c}`"] for c in docs.columns]
    return rows.join(taken, own == F.col(key)).select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(nth)).drop(nth)
