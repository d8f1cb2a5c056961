"""The corpus pipeline: language id, near-copy removal, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.llm import language, packing, simhash, substring_dedup
from shardloom.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    dictionaries = language.fit(docs, ~held_out)
    found = docs.withColumn("__language", language.prediction(F.col("text"), dictionaries))
    return found.where(language.is_clear(F.col("__language"))).drop("__language")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link (3-word shingles, two differing bits)."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id holds are cut out; documents without any stay as they are."""
    # The columns come along under names that no result of the operator has.
    rest = {c: f"__doc_{i}" for i, c in enumerate(docs.columns) if c != "doc_id"}
    found = substring_dedup.dedup(docs.select("doc_id", *[F.col(c).alias(n) for c, n in rest.items()]), text_col=rest["text"], carry=tuple(rest.values()))
    cut = F.col("n_removed") > 0
    columns = {c: F.col(n) for c, n in rest.items()} | {"doc_id": F.col("doc_id")}
    columns["text"] = F.when(cut, F.col("kept_text")).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.char_length("kept_text").cast("long")).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.place(digests)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packed)]
ORACLE_SQL = None  # compression, fingerprints and tokenizers have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
