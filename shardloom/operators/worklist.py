"""Class requests and generation work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import CLASS_COUNT


def parse_class_counts(requests: DataFrame, text: str, keys: list[str], classes: int = CLASS_COUNT) -> DataFrame:
    """One line per entry of JSON requests ``{class id: count}`` with the reason of a rejected one.

    A class id must be a canonical integer in ``[0, classes)``, a count a
    positive integer; a request that is no object or an empty one is rejected whole.
    """
    parsed = F.from_json(F.col(text), "map<string,variant>")
    entries = requests.select(*keys, F.explode_outer(parsed).alias("raw_id", "raw_count"))
    trimmed = F.trim("raw_id")
    canonical = F.regexp_like(trimmed, F.lit(r"^(0|-?[1-9]\d*)$"))
    class_id = F.when(canonical, trimmed.try_cast("bigint"))
    count = F.when(
        F.schema_of_variant("raw_count").isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
        F.try_variant_get("raw_count", "$", "bigint"),
    )
    reason = (
        F.when(F.col("raw_id").isNull(), "not a request")
        .when(~canonical, "invalid class id")
        .when(count.isNull() | (count <= 0), "invalid count")
        .when(class_id.isNull() | ~class_id.between(0, classes - 1), "class id out of range")
    )
    return entries.select(
        *keys, "raw_id", F.when(reason.isNull(), class_id).alias("class_id"), F.when(reason.isNull(), count).alias("n"),
        reason.alias("reject"),
    )
