"""Every stage of the pipeline acts on all that the one before kept."""

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operations import brute_components

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], DATA).toPandas()
        if k < 4:
            assert list(out.columns) == docs.columns
            kept.append(spark.createDataFrame(out, docs.schema))
    n = [d.count() for d in kept]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert n[0] >= n[1] >= n[2] > n[3] > 0
    assert kept[1].join(labels.where("quality = 0"), "doc_id").count() <= 0.1 * labels.where("quality = 0").count()
    assert kept[1].join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * labels.where("quality = 1").count()
    assert n[1] - n[2] <= 2
    rows = [(r["doc_id"], r["text"]) for r in kept[2].collect()]
    assert sorted(r["doc_id"] for r in kept[3].collect()) == [r[0] for r in brute_components(rows) if r[3]]
    copies = kept[4].groupBy("doc_id").count()
    assert copies.agg(F.max("count")).first()[0] <= 3 and copies.join(kept[3], "doc_id", "left_anti").count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sizes = {r["doc_id"]: len(library.encode(r["text"], add_bos=True, add_eos=True)) for r in kept[4].collect()}
    assert len(out) == n[4] and all(sizes[i] == k for i, k in zip(out["doc_id"], out["n_tokens"], strict=True))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'").limit(60).drop("n_chars")
    rows = [(None, None, "en", "s"), (None, "", None, None), (5, " \n ", "en", "s"), (5, "12 345 67 .", "en", "s")]
    some = docs.where("length(text) > 300").limit(4)
    again = some.unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(some.limit(2).withColumn("text", F.concat(F.lit("Nobody ever said so before. "), F.reverse("text"))))
    odd = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).unionByName(again)
    odd = odd.withColumns({"lang_pred": F.lit("mine"), "copies": F.lit(1), "_quality": F.lit("q"), "_row": F.lit(0), "n_chars": F.length("text")})
    odd = spark.createDataFrame(odd.collect(), odd.schema)
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, DATA)
        assert kept.columns == odd.columns
        kept = spark.createDataFrame(kept.collect(), odd.schema)
        assert kept.select("text").subtract(before.select("text")).count() == 0 and kept.where("lang_pred <> 'mine'").count() == 0
    once = corpus_pipeline.one_of_near_duplicates(spark, odd, DATA)
    texts = [(k, r["text"]) for k, r in enumerate(odd.collect())]
    assert once.count() == sum(r[3] for r in brute_components(texts))
    assert corpus_pipeline.tokenised(spark, kept, DATA).count() == kept.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), DATA).count() == 0
