"""Captions and annotations to bucketed, sharded training samples in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.annotations import normalise, prompt_texts
from ..functions.fixed_values import SHARD_SIZE
from ..functions.names import row_key
from ..functions.text import clean_caption, visible_text_prompt
from ..operators.buckets import with_bucket
from ..operators.joins import exclude_holdout


def prepare_samples(
    rows: DataFrame, excluded: DataFrame, index: str, stem: str = "captions", shard_size: int = SHARD_SIZE
) -> DataFrame:
    """``index, caption, annotations, height, width`` to prompt, key, shard and bucket; held-out rows are left out.

    Narrow except for the holdout anti-join, which is broadcast when the list is small.
    """
    kept = exclude_holdout(rows, excluded, index)
    prompted = kept.withColumn("clean", clean_caption(F.col("caption")))
    # Texts come from the raw list, so that a plan without the annotations column never normalises it.
    prompted = prompted.withColumn("texts", prompt_texts(F.col("annotations")))
    prompted = prompted.withColumn("annotations", normalise(F.col("annotations")))
    prompted = prompted.withColumn("prompt", visible_text_prompt(F.col("clean"), F.col("texts")))
    keyed = prompted.withColumn("key", row_key(F.lit(stem), F.col(index))).withColumn(
        "shard_no", F.expr(f"{index} div {shard_size}")
    )
    return with_bucket(keyed, "height", "width")
