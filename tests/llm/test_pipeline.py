"""The pipeline stage by stage, beside plain statements of what each keeps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from shardloom.llm import simhash

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def scratch(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.dtypes == docs.dtypes
        assert 0 < after.count() <= docs.count()


def test_planted_cases(spark):
    rnd = random.Random(9)
    letters = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    words = lambda n: [f"w{rnd.randint(0, 9999)}" for _ in range(n)]
    passage, base = words(60), words(300)
    edited = list(base)
    edited[100] = "edited"
    texts = {90_001: base, 90_002: base, 90_003: edited, 90_004: [*words(80), *passage, *words(80)], 90_005: [*words(50), *passage, *words(50)], 90_006: words(120)}
    rows = [(i, " ".join(w), "en", "planted", len(" ".join(w))) for i, w in texts.items()]
    docs = letters.unionByName(spark.createDataFrame(rows, letters.schema))
    kept = pipeline.near_copies(spark, docs, SF_DIR)
    # one word of three hundred: whether the copy goes is for the fingerprints to say
    apart = (simhash.simhash(" ".join(base)) ^ simhash.simhash(" ".join(edited))) & (1 << 64) - 1
    edited_stays = {90_003} if apart.bit_count() > 2 else set()
    assert {r.doc_id for r in kept.collect() if r.doc_id > 90_000} == {90_001, 90_004, 90_005, 90_006} | edited_stays
    cut = {r.doc_id: r for r in pipeline.repeated_passages(spark, kept, SF_DIR).collect()}
    assert cut[90_005].text.split() == [*texts[90_005][:50], *texts[90_005][110:]]
    assert cut[90_005].n_chars == len(cut[90_005].text)
    assert all(cut[i].text == " ".join(texts[i]) for i in (90_001, 90_004, 90_006))


def test_run_packs_what_is_left(spark):
    out = pipeline.run(spark, SF_DIR).toPandas()
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    assert out.groupby("sequence_id").length.sum().max() <= 2048


def test_run_takes_null_columns_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (3, None, "en", None, None), (70_000, "", None, None, 0), (70_001, "a b", None, None, 3), (70_001, "a b", None, None, 3)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_leave_columns_of_any_name_alone(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(80)
    names = ("score", "lang_pred", "n_words", "n_removed", "kept_text", "fingerprint", "component_id", "block", "hash", "rank")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.dtypes == docs.dtypes, name
        rows = after.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in names), name
    assert pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= 80
