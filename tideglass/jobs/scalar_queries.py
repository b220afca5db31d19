"""Array functions over every series, and over every series with the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions import kernels, scalars
from tideglass.jobs.base import SERIES, query, r, rounded, series, table


def _points(expression: str) -> str:
    return f"WITH {SERIES}, m AS (SELECT *, list_sum(v) / len(v) AS mu, list_min(v) AS lo, list_max(v) AS hi FROM s), d AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) / len(v)) AS sd FROM m) SELECT series_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS seq, {r(f'unnest(list_transform(v, lambda x: {expression}))')} AS value FROM d"


def _exploded(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    return rounded(series(spark, sf_dir).select("series_id", F.posexplode(f(F.col("values"))).alias("seq", "value")))


@query(_points("CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END"))
def z_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, scalars.z_normalise)


@query(_points("CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END"))
def min_max_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, scalars.min_max_normalise)


@query(_points("(x - mu) / (sd + 1e-8::DOUBLE)"))
def prefix_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, scalars.prefix_normalise)


#: Every series a and the next one b; c is b without its last values.
PAIRS = f"""{SERIES}, p AS (SELECT x.series_id, x.v AS a, y.v AS b, y.v[1:len(y.v) - 24] AS c FROM s x JOIN s y ON y.series_id = x.series_id + 1)"""
_D1 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: abs(z[1] - z[2])))"
_D2 = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def d1(a: str, b: str) -> str:
    return _D1.format(a, b)


def d2(a: str, b: str) -> str:
    return _D2.format(a, b)


def sim(a: str, b: str) -> str:
    return f"(1 / (1 + CASE WHEN {d1(a, b)} > 0.1 THEN {d1(a, b)} ELSE {d2(a, b)} END))"


def cosine(a: str, b: str) -> str:
    dot = "list_inner_product({}, {})"
    return f"coalesce({dot.format(a, b)} / nullif(sqrt({dot.format(a, a)}) * sqrt({dot.format(b, b)}), 0), 0)"


def pearson01(a: str, b: str) -> str:
    n = f"len({a})"
    cov = f"(list_inner_product({a}, {b}) - list_sum({a}) * list_sum({b}) / {n})"
    var = lambda x: f"greatest(0, list_inner_product({x}, {x}) - list_sum({x}) * list_sum({x}) / {n})"
    return f"coalesce(greatest(0, ({cov} / nullif(sqrt({var(a)}) * sqrt({var(b)}), 0) + 1) / 2), 0)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("series_id", "values")
    nxt = s.select((F.col("series_id") - 1).alias("series_id"), F.col("values").alias("b"))
    return s.withColumnRenamed("values", "a").join(nxt, "series_id").withColumn("c", F.slice("b", 1, F.size("b") - 24))


def _pair(expression: str) -> str:
    return f"WITH {PAIRS} SELECT series_id, {r(expression)} AS value FROM p"


def _each(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    """``f(a, b, c)`` of every pair."""
    return rounded(_pairs(spark, sf_dir).select("series_id", f(F.col("a"), F.col("b"), F.col("c")).alias("value")))


@query(f"WITH {PAIRS} SELECT series_id, {r(d1('a', 'b'))} AS first_order, {r(d2('a', 'b'))} AS second_order FROM p")
def minkowski(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairs(spark, sf_dir).select("series_id", scalars.minkowski(F.col("a"), F.col("b"), 1).alias("first_order"), scalars.minkowski(F.col("a"), F.col("b"), 2).alias("second_order")))


@query(f"WITH {PAIRS} SELECT series_id, CAST(CASE WHEN {d1('a', 'b')} > 8.5 THEN 1 ELSE 2 END AS INTEGER) AS p FROM p")
def auto_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order under a threshold that both branches occur with."""
    return _pairs(spark, sf_dir).select("series_id", scalars.auto_p(F.col("a"), F.col("b"), 8.5).alias("p"))


def _kernel(spark: SparkSession, sf_dir: str, f, name: str) -> DataFrame:
    def each(frames):
        for frame in frames:
            frame["value"] = f(frame["a"].tolist(), frame["c"].tolist())
            yield frame[["series_id", "value"]]

    return rounded(_pairs(spark, sf_dir).mapInPandas(each, "series_id long, value double")).withColumnRenamed("value", name)


@query()
def dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping distance of every series to the shortened next one."""
    return _kernel(spark, sf_dir, kernels.distances, "dtw")


@query()
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every series to the shortened next one, whose length differs."""
    return _kernel(spark, sf_dir, kernels.distances, "distance")


@query(_pair(sim("a", "b")))
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda a, b, c: scalars.similarity(a, b))


@query(_pair(f"1 / (1 + (1 - {sim('a', 'b')}))"))
def rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda a, b, c: scalars.rank_score(scalars.similarity(a, b)))


@query(_pair(cosine("a[1:len(c)]", "c")))
def cosine_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda a, b, c: scalars.cosine_prefix(a, c))


@query(_pair(pearson01("a[1:len(c)]", "c")))
def pearson01_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda a, b, c: scalars.pearson01_prefix(a, c))


@query(_pair("pow(CAST(len(c) AS DOUBLE) / len(a), 2)"))
def length_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda a, b, c: scalars.length_similarity(a, c))


_W = "SELECT CAST(n AS DOUBLE) / m AS q FROM"
_WEIGHTS = """w AS (SELECT *, 0.3 * CASE WHEN q > 0.8 THEN 1.1 ELSE 1 END AS d, 0.3 * CASE WHEN q < 0.5 THEN 1.2 ELSE 1 END AS c, 0.2 * CASE WHEN q < 0.5 THEN 1.1 ELSE 1 END AS p, 0.2 * CASE WHEN q < 0.5 THEN 0.5 WHEN q > 0.8 THEN 1.2 ELSE 1 END AS l FROM q)"""


@query(
    f"WITH {SERIES}, q AS (SELECT series_id, CAST(1 + series_id % 64 AS DOUBLE) / len(v) AS q FROM s), {_WEIGHTS} SELECT series_id, {r('CAST(d AS DOUBLE) / CAST(d + c + p + l AS DOUBLE)')} AS distance, {r('CAST(c AS DOUBLE) / CAST(d + c + p + l AS DOUBLE)')} AS cosine, {r('CAST(p AS DOUBLE) / CAST(d + c + p + l AS DOUBLE)')} AS pearson, {r('CAST(l AS DOUBLE) / CAST(d + c + p + l AS DOUBLE)')} AS length FROM w"
)
def adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every series against its own prefix of 1 to 64 values."""
    w = scalars.adaptive_weights(F.col("values"), F.slice("values", 1, (1 + F.col("series_id") % 64).cast("int")))
    return rounded(series(spark, sf_dir).select("series_id", w.alias("w")).select("series_id", "w.*"))


_MULTI = "(0.33 * {sim} + 0.3 * {cos} + 0.2 * {pea} + 0.24) / 1.07"


def multi_sql(a: str, b: str) -> str:
    """Multi-metric similarity of equally long arrays."""
    return f"greatest(0, least(1, {_MULTI.format(sim=sim(a, b), cos=cosine(a, b), pea=pearson01(a, b))}))"


@query(_pair(multi_sql("a", "b")))
def multi_metric_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda a, b, c: scalars.multi_metric_similarity(a, b))


@query(f"WITH {SERIES}, c AS (SELECT split, label, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split) AS p FROM c) SELECT split, {r('-sum(p * log2(p))')} AS entropy FROM t GROUP BY split")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = series(spark, sf_dir).groupBy("split", "label").count().groupBy("split").agg(F.collect_list("count").alias("counts"))
    return rounded(counts.select("split", scalars.entropy_of_counts(F.col("counts")).alias("entropy")))


@query(
    f"""WITH {SERIES}, g AS (SELECT label, v[1] > 0 AS side FROM s), h AS (
SELECT 0 AS part, label, count(*) AS n FROM g GROUP BY label UNION ALL SELECT 1 + CAST(side AS INTEGER), label, count(*) FROM g GROUP BY ALL),
t AS (SELECT part, CAST(sum(n) AS DOUBLE) AS n, -sum(n / CAST(m AS DOUBLE) * log2(n / CAST(m AS DOUBLE))) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY part) AS m FROM h) GROUP BY part)
SELECT {r('sum(CASE WHEN part = 0 THEN e ELSE -e * n / (SELECT n FROM t WHERE part = 0) END)')} AS info_gain FROM t"""
)
def info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of the split by the sign of the first value."""
    sides = series(spark, sf_dir).select("label", F.when(F.get("values", F.lit(0)) > 0, 1).otherwise(0).alias("side"))
    counts = sides.groupBy("label").agg(F.sum("side").alias("right"), F.sum(1 - F.col("side")).alias("left"))
    whole = counts.agg(F.collect_list("left").alias("l"), F.collect_list("right").alias("r"), F.collect_list(F.col("left") + F.col("right")).alias("a"), F.sum("left").alias("nl"), F.sum("right").alias("nr"))
    e = {k: scalars.entropy_of_counts(F.col(k)) for k in "lra"}
    n = (F.col("nl") + F.col("nr")).cast("double")
    return rounded(whole.select((e["a"] - F.col("nl") / n * e["l"] - F.col("nr") / n * e["r"]).alias("info_gain")))


@query(
    f"""WITH e AS (SELECT user_id, event_type AS label, sum(value) / 100 AS w FROM events GROUP BY ALL), p AS (SELECT *, CASE WHEN w > 0 THEN greatest(0, log2(w)) ELSE 0 END AS x FROM e)
SELECT user_id, label, {r("CASE WHEN sum(x) OVER u > 0 THEN x / sum(x) OVER u ELSE 1.0::DOUBLE / count(*) OVER u END", 5)} AS weight FROM p WINDOW u AS (PARTITION BY user_id)"""
)
def permax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each user's event types by the logarithm of their values."""
    from tideglass.operators.attention import permax as share

    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("label")).agg((F.sum("value") / 100).alias("w"))
    return rounded(e.select("user_id", "label", share(F.col("w"), Window.partitionBy("user_id")).alias("weight")), 5)


@query(
    f"""WITH {SERIES}, k AS (SELECT label, v AS q FROM s), q AS (SELECT label, arg_min(v, series_id) AS q FROM s GROUP BY label),
x AS (SELECT s.label, series_id, v, greatest(0, log2(greatest(list_inner_product(q.q, v) * 2 / sqrt(len(v)) * 64, 1e-8))) AS w FROM s JOIN q USING (label)),
y AS (SELECT label, v, CASE WHEN sum(w) OVER l > 0 THEN w / sum(w) OVER l ELSE 1.0::DOUBLE / count(*) OVER l END AS w FROM x WINDOW l AS (PARTITION BY label)),
z AS (SELECT label, w, unnest(v) AS value, unnest(range(0, len(v))) AS dim FROM y)
SELECT label, CAST(dim AS INTEGER) AS dim, {r('sum(w * value)', 5)} AS value FROM z GROUP BY label, dim"""
)
def permax_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention of each label's first series over all series of its label."""
    from tideglass.operators.attention import permax_attention as attend

    s = series(spark, sf_dir).select(F.col("label").alias("grp"), "series_id", "values")
    queries = s.groupBy("grp").agg(F.min_by("values", "series_id").alias("query"))
    return rounded(attend(queries, s, scale=128.0).select(F.col("grp").alias("label"), "dim", "value"), 5)
