from collections import Counter

import corpus_pipeline
from ledgerloom.llm import langid, mixing, packing, pii
from pyspark.sql import functions as F

from .helpers import DATA, awkward, empty
from .test_nearcopies import plain_kept


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == docs.columns, name
        if name == "language_id":
            want = before.where(F.col("text").rlike(r"\p{L}"))
            assert Counter(map(tuple, after.collect())) == Counter(map(tuple, want.collect()))
        if name == "near_dedup":
            want = plain_kept([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in after.collect()) == want
        if name == "pii":
            assert after.count() == before.count() and pii.find(after).where(F.size("pii") > 0).count() == 0
        if name == "mixing":
            assert after.count() == mixing.mix(before).agg(F.sum("copies")).first()[0]
        if name == "packing":
            want = packing.pack(before).agg(F.sum("length")).first()
            assert after.agg(F.sum("length")).first() == want
        before = after
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_awkward_documents(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == awkward(spark).columns
    assert packing.pack(docs).count() > 0
    assert langid.UNKNOWN == "und"


def test_stages_keep_columns_of_any_name(spark):
    own = ["row", "h", "base", "threshold", "copy", "taken", "keep_id", "hash", "was", "now", "lang_pred", "size", "key", "n"]
    docs = awkward(spark).select("*", *[F.lit(7).alias(c) for c in own])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.where(" AND ".join(f"`{c}` = 7" for c in own)).count() == docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0


def test_empty_documents(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
