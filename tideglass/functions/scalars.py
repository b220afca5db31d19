"""Column expressions over array<double> values; every one is a built-in expression.

A null array gives null. Empty and constant arrays have the results stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(values), F.size(values).cast("double"))


def pop_std(values: Column) -> Column:
    """Population standard deviation; null for an empty array."""
    spread = F.transform(F.array(F.struct(values.alias("v"), mean(values).alias("m"))), lambda s: F.aggregate(s["v"], F.lit(0.0), lambda t, x: t + (x - s["m"]) * (x - s["m"])))
    return F.sqrt(F.try_divide(F.get(spread, F.lit(0)), F.size(values).cast("double")))


def _with(values: Column, facts: dict[str, Column], each) -> Column:
    """Transform ``values`` by ``each(x, facts)``; the facts are computed once for the array."""
    held = F.array(F.struct(values.alias("v"), *[c.alias(k) for k, c in facts.items()]))
    return F.get(F.transform(held, lambda s: F.transform(s["v"], lambda x: each(x, s))), F.lit(0))


def z_normalise(values: Column) -> Column:
    """(x - mean) / population deviation; zeros for a constant array."""
    return _with(values, {"m": mean(values), "d": pop_std(values)}, lambda x, s: F.when(s["d"] > 0, (x - s["m"]) / s["d"]).otherwise(0.0))


def min_max_normalise(values: Column) -> Column:
    """To [0, 1]; zeros for a constant array."""
    return _with(values, {"a": F.array_min(values), "b": F.array_max(values)}, lambda x, s: F.when(s["b"] > s["a"], (x - s["a"]) / (s["b"] - s["a"])).otherwise(0.0))


def prefix_normalise(values: Column) -> Column:
    """(x - mean) / (population deviation + 1e-8); an empty array stays empty."""
    return _with(values, {"m": mean(values), "d": pop_std(values)}, lambda x, s: (x - s["m"]) / (s["d"] + F.lit(1e-8)))


def minkowski(a: Column, b: Column, p: int) -> Column:
    """Distance of order 1 or 2 of equally long arrays; infinite for unequal lengths."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    same = F.size(a) == F.size(b)
    found = total(gap) if p == 1 else F.sqrt(total(F.transform(gap, lambda g: g * g)))
    return F.when(same, found).otherwise(F.lit(float("inf")))


def auto_p(a: Column, b: Column, threshold: float = 0.1) -> Column:
    """The first order of 1 and 2 whose distance exceeds the threshold, else 2."""
    return F.when(minkowski(a, b, 1) > threshold, 1).otherwise(2)


def distance(a: Column, b: Column, threshold: float = 0.1) -> Column:
    """Minkowski distance of order ``auto_p`` of equally long arrays."""
    d1 = minkowski(a, b, 1)
    return F.when(d1 > threshold, d1).otherwise(minkowski(a, b, 2))


def similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + distance(a, b))


def rank_score(sim: Column) -> Column:
    """Rises with the similarity: 1 / (1 + (1 - sim))."""
    return 1 / (1 + (1 - sim))


def common(a: Column, b: Column) -> tuple[Column, Column]:
    """Both arrays cut to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine_prefix(a: Column, b: Column) -> Column:
    """Cosine on the common prefix; 0 for a prefix of at most one value or a zero vector."""
    x, y = common(a, b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) <= 1) | (norm == 0), 0.0).otherwise(F.try_divide(dot(x, y), norm))


def pearson01_prefix(a: Column, b: Column) -> Column:
    """(r + 1) / 2 on the common prefix; 0 for a prefix of at most one value or a constant one."""
    x, y = common(a, b)
    held = F.array(F.struct(x.alias("x"), y.alias("y"), mean(x).alias("mx"), mean(y).alias("my")))
    none = F.struct(*[F.lit(0.0).alias(k) for k in ("xy", "xx", "yy")])

    def sums(s: Column) -> Column:
        gaps = F.zip_with(s["x"], s["y"], lambda p, q: F.struct((p - s["mx"]).alias("p"), (q - s["my"]).alias("q")))
        return F.aggregate(gaps, none, lambda t, g: F.struct((t["xy"] + g["p"] * g["q"]).alias("xy"), (t["xx"] + g["p"] * g["p"]).alias("xx"), (t["yy"] + g["q"] * g["q"]).alias("yy")))

    def share(s: Column) -> Column:
        norm = F.sqrt(s["xx"]) * F.sqrt(s["yy"])
        return F.when(norm < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), (F.try_divide(s["xy"], norm) + 1) / 2))

    return F.when(F.size(x) <= 1, 0.0).otherwise(F.get(F.transform(F.transform(held, sums), share), F.lit(0)))


def length_similarity(a: Column, b: Column) -> Column:
    """Square of the shorter over the longer length."""
    r = F.try_divide(F.least(F.size(a), F.size(b)).cast("double"), F.greatest(F.size(a), F.size(b)))
    return r * r


def adaptive_weights(a: Column, b: Column) -> Column:
    """struct(distance, cosine, pearson, length): metric weights by the ratio of the lengths, summing to 1."""
    r = F.try_divide(F.least(F.size(a), F.size(b)).cast("double"), F.greatest(F.size(a), F.size(b)))
    raw = {
        "distance": 0.3 * F.when(r > 0.8, 1.1).otherwise(1.0),
        "cosine": 0.3 * F.when(r < 0.5, 1.2).otherwise(1.0),
        "pearson": 0.2 * F.when(r < 0.5, 1.1).otherwise(1.0),
        "length": 0.2 * F.when(r < 0.5, 0.5).when(r > 0.8, 1.2).otherwise(1.0),
    }
    whole = raw["distance"] + raw["cosine"] + raw["pearson"] + raw["length"]
    return F.struct(*[(c / whole).alias(k) for k, c in raw.items()])


def multi_metric_similarity(a: Column, b: Column, base: Column | None = None) -> Column:
    """Weighted sum of four similarities, clipped to [0, 1]; ``base`` is the distance similarity of unequal lengths."""
    w = adaptive_weights(a, b)
    first = similarity(a, b) if base is None else base
    mixed = w["distance"] * first + w["cosine"] * cosine_prefix(a, b) + w["pearson"] * pearson01_prefix(a, b) + w["length"] * length_similarity(a, b)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)), F.lit(0.0))


def entropy_of_counts(counts: Column) -> Column:
    """-sum p log2 p of an array of counts; 0 for no counts."""
    n = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c.cast("double"))
    held = F.transform(F.array(F.struct(counts.alias("c"), n.alias("n"))), lambda s: F.aggregate(s["c"], F.lit(0.0), lambda t, c: t - F.when(c > 0, c / s["n"] * F.log2(c / s["n"])).otherwise(0.0)))
    return F.get(held, F.lit(0))


def draw(seed: int, *parts: Column) -> Column:
    """A non-negative integer below 2**32 from md5 of the seed and the parts; equal on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
