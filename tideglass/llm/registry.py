"""Queries of the thirteen operations over their whole tables, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import clusters, fingerprints, langid, licenses, lm, mixing, neardup, pages, pieces, private, quality, topk, turns
from tideglass.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Queries that SQL can express.
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every whole document; the target is the documents labelled as of quality 1."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extracted(table(spark, sf_dir, "pages"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's probability of quality 1, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(table(spark, sf_dir, "labels"), docs, held_out=F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    scored = quality.scored(docs.select("doc_id", held_out, "text"), net, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every 50th vector by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op4_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license templates that every whole document contains."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLE["op5_licenses"] = licenses.oracle_sql()


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole document's ids and of what they decode to."""
    return pieces.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's component of near duplicates."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op7_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix of all sources by weight takes of it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's language, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs, learn=~held_out)
    scored = langid.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


@query
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds from eight first centroids."""
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


ORACLE["op11_clusters"] = clusters.oracle_sql()


@query
def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    found = turns.repaired(turns.damaged(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", *turns.FACTS, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))


@query
def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, plain and disguised, in every whole document."""
    found = private.personal_data(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in private.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
