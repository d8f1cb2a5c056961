"""Samples, sidecar captions and scores to collated same-bucket batches in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.annotations import transcript
from ..operators.buckets import collate, same_bucket_batches, with_bucket
from ..operators.index import BLOCK_ROWS, total_rows
from ..operators.joins import caption_or_default, overlay_captions, scores_of_present_types
from ..operators.sampling import weighted_caption
from ..operators.splits import ranged


def training_batches(
    samples: DataFrame,
    captions: DataFrame,
    scores: DataFrame,
    index: str,
    ranks: int,
    batch_size: int,
    seed,
    threshold: float = 0.5,
    temperature: float = 0.5,
    default: str = "prompt",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Batches of ``batch_size`` samples of one worker and one aspect ratio, with caption and transcript arrays.

    ``samples`` has a dense ``index``, the caption map ``fields``, ``annotations``, ``texts``, ``height`` and
    ``width``.  Sidecar ``captions`` overlay the map; one caption type per sample is drawn by its score among the
    types it has, without scores it is ``default``.  Workers take contiguous ranges; rests come as shorter batches.
    """
    overlaid = overlay_captions(samples, captions, [index])
    drawn = weighted_caption(scores_of_present_types(overlaid, scores, [index]), [index], threshold, temperature, seed, default)
    chosen = overlaid.join(drawn.select(index, "caption_type"), index, "left")
    kind = F.coalesce("caption_type", F.lit(default))
    ready = chosen.select(
        index, "height", "width", kind.alias("caption_type"),
        caption_or_default(F.col("fields"), kind, default).alias("caption"),
        transcript(F.col("annotations"), F.col("texts")).alias("transcript"),
    )
    split = ranged(with_bucket(ready, "height", "width"), index, total_rows(samples), ranks)
    batched = same_bucket_batches(split, index, batch_size, drop_last=False, block_rows=block_rows)
    return collate(batched, index, ["caption_type", "caption", "transcript"])
