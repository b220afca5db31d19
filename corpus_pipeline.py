"""A corpus from documents to tokens: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, whatever others there are. Null texts, texts
without words and texts without letters have no known language and go there; null
and repeated ids, null sources and rows that are alike are documents like others. An
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import langid, mixing, neardup, pieces, quality
from tideglass.llm.common import BATCH_ROWS, fresh, table
from tideglass.shared import materialise


def bounded(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in the pipeline's session, as executors run one stage after another.

    Stages give plans that run later, so the pipeline, unlike the library, leaves the setting as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(BATCH_ROWS, int(spark.conf.get(key)))))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more, learned from the labels of the documents at hand."""
    bounded(spark)
    net = quality.fit(table(spark, sf_dir, "labels"), docs)
    score = fresh(docs.columns, "_quality")
    return quality.scored(docs, net, name=score).where(F.col(score) >= 0.5).select(*[f"`{c}`" for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are near a centroid of some language; ``lang`` stays as it came."""
    bounded(spark)
    model = langid.fit(docs, learn=F.lit(True))
    names = tuple(fresh(docs.columns, n) for n in ("_lang", "_cosine", "_accepted"))
    return langid.scored(docs, model, names=names).where(F.col(names[2])).select(*[f"`{c}`" for c in docs.columns])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates.

    Where ids are null or repeated, rows are numbered and written first, and the
    number stands for the id: every row is then a document of its own.
    """
    facts = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    key = "doc_id"
    if facts["rows"] != facts["ids"]:
        key = fresh(docs.columns, "_row")
        docs = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline_rows")
    kept = neardup.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(fresh(docs.columns, "_kept_id")))
    rows = docs.join(kept, docs[key] == kept[kept.columns[0]], "left_semi")
    return rows if key == "doc_id" else rows.drop(key)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix by source weights takes it."""
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix."""
    bounded(spark)
    return pieces.encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", tokenised),
]
#: SQL cannot train the classifiers or encode texts; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline_{k}")
    return docs
