"""Checks that return violation tables instead of stopping at the first problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..functions.fixed_values import SAMPLE_FIELDS, SHARD_EXTENSIONS
from ..functions.image_header import image_header
from ..functions.names import split_name


def rule(condition: Column, name: str) -> Column:
    """The rule name where the rule is broken; unknown counts as broken."""
    return F.when(~F.coalesce(condition, F.lit(False)), F.lit(name))


def violations(df: DataFrame, keys: list[str], rules: list[Column]) -> DataFrame:
    """One pass over the rows, one line per broken rule."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def describe_members(members: DataFrame) -> DataFrame:
    """Tar members as ``shard, key, ext, record, width, height``.

    Image sizes come from the payload's header, record sizes from the record;
    an unreadable image has no size.
    """
    key, ext = split_name(F.col("name"))
    named = members.select("shard", key.alias("key"), F.regexp_replace(ext, r"^\.", "").alias("ext"), "content")
    is_image = F.col("ext") == "jpg"
    sized = named.withColumn("image", image_header(F.when(is_image, F.col("content"))))
    sized = sized.withColumn("record", F.when(F.col("ext") == "json", F.decode("content", "UTF-8")))

    def side(name: str) -> Column:
        written = F.get_json_object("record", f"$.{name}").try_cast("int")
        return F.when(is_image, F.col(f"image.{name}")).otherwise(written).alias(name)

    return sized.select("shard", "key", "ext", "record", side("width"), side("height"))


def member_flags(members: DataFrame) -> DataFrame:
    """0/1 columns for the rules on single members: ``ext`` and ``record`` (JSON text, null for images).

    Texts are judged where they are read; only the flags travel further.
    """
    is_json = F.col("ext") == "json"

    def judged(parsed: Column) -> Column:
        record, present = parsed["record"], parsed["present"]
        texts = F.coalesce(F.try_variant_get(record, "$.texts", "array<string>"), F.array().cast("array<string>"))
        # Bound, because a lambda would read the prompt anew for each text.
        said = let(F.try_variant_get(record, "$.prompt", "string"), lambda prompt: F.forall(texts, lambda t: F.contains(prompt, t)))
        rules = {
            "unexpected member": F.col("ext").isin(SHARD_EXTENSIONS),
            "unreadable record": ~is_json | record.isNotNull(),
            "text not in prompt": ~is_json | said,
        }
        for field in SAMPLE_FIELDS:
            rules[f"missing {field}"] = ~is_json | F.array_contains(present, field)
        return F.struct(*[(~F.coalesce(ok, F.lit(False))).cast("int").alias(name) for name, ok in rules.items()])

    # A record is parsed once for all rules; a field that holds null is present.
    parsed = F.struct(F.try_parse_json("record").alias("record"), F.json_object_keys("record").alias("present"))
    return members.select("shard", "key", "ext", "width", "height", F.inline(F.transform(F.array(parsed), judged)))


def sample_rules(members: DataFrame) -> DataFrame:
    """One line per key with the broken rules of the sample: its members, its pair, its size."""
    flagged = member_flags(members)
    names = flagged.columns[5:]
    n, sized = F.count(F.lit(1)), F.count("width")
    per_key = flagged.groupBy("shard", "key").agg(
        *[F.max(F.col(f"`{name}`")).alias(name) for name in names],
        (F.count_if(F.col("ext") == "jpg") * F.count_if(F.col("ext") == "json") > 0).alias("paired"),
        (
            ((sized == n) | (sized == 0))
            & F.min("width").eqNullSafe(F.max("width"))
            & F.min("height").eqNullSafe(F.max("height"))
        ).alias("one_size"),
    )
    broken = [F.when(F.col(f"`{name}`") == 1, F.lit(name)) for name in names]
    broken += [rule(F.col("paired"), "incomplete pair"), rule(F.col("one_size"), "sizes differ")]
    return per_key.select("shard", "key", F.array_compact(F.array(*broken)).alias("rules"))


def verify_shards(members: DataFrame, shards: DataFrame) -> DataFrame:
    """All shard rules as one table ``shard, key, rule``; empty means the shards are fine.

    Archives are read once: every sample also counts one towards its shard,
    the shard list counts its declared number down, and what is not zero is wrong.
    """
    nothing = F.lit(None).cast("string")
    lines = F.transform("rules", lambda r: F.struct(F.col("key"), r.alias("rule"), F.lit(1).cast("bigint").alias("n")))
    counted = F.array(F.struct(nothing.alias("key"), F.lit("wrong count").alias("rule"), F.lit(1).cast("bigint").alias("n")))
    found = sample_rules(members).select("shard", F.inline(F.concat(lines, counted)))
    declared = shards.select(
        "shard", nothing.alias("key"), F.lit("wrong count").alias("rule"), (-F.col("nsamples").cast("bigint")).alias("n")
    )
    sums = found.unionByName(declared).groupBy("shard", "key", "rule").agg(F.sum("n").alias("n"))
    return sums.where("n <> 0").drop("n")


def verify_store(images: DataFrame, labels: DataFrame, index: DataFrame) -> DataFrame:
    """Counts of a converted store, keys without image or label, images that are not square.

    ``images`` is ``key, width, height``; every row is checked.  With a column ``mode`` images that are not RGB are
    counted too (``not_rgb``); an unknown size or mode is not right.
    """
    zero = F.lit(0)
    one = F.lit(1)
    modes = [("not_rgb", F.col("mode") == "RGB")] if "mode" in images.columns else []
    rules = [("not_square", F.col("width") == F.col("height")), *modes]
    broken = [(~F.coalesce(ok, F.lit(False))).cast("int").alias(name) for name, ok in rules]
    none = [zero.alias(name) for name, _ in rules]
    tagged = (
        images.select("key", one.alias("i"), zero.alias("l"), zero.alias("x"), *broken)
        .unionByName(labels.select("key", zero.alias("i"), one.alias("l"), zero.alias("x"), *none))
        .unionByName(index.select("key", zero.alias("i"), zero.alias("l"), one.alias("x"), *none))
    )
    names = [name for name, _ in rules]
    per_key = tagged.groupBy("key").agg(*[F.max(c).alias(c) for c in ("i", "l", "x", *names)])
    return per_key.agg(
        F.sum("i").alias("images"),
        F.sum("l").alias("labels"),
        F.sum("x").alias("indexed"),
        F.count_if((F.col("x") == 1) & (F.col("i") == 0)).alias("index_without_image"),
        F.count_if((F.col("i") == 1) & (F.col("l") == 0)).alias("image_without_label"),
        *[F.sum(name).alias(name) for name in names],
    )


def describe_images(images: DataFrame, payload: str = "payload") -> DataFrame:
    """``key, width, height, mode`` of stored images for :func:`verify_store`, read from their headers."""
    found = images.withColumn("__header", image_header(F.col(payload)))
    return found.select("key", *[F.col(f"__header.{f}").alias(f) for f in ("width", "height", "mode")])


def holdout_violations(listed: DataFrame, value: str, source_count: int) -> DataFrame:
    """Rules on a holdout list given as raw JSON text values: integers, not booleans, in range, no duplicates."""
    raw = F.trim(F.col(value))
    whole = F.regexp_like(raw, F.lit(r"^-?(0|[1-9]\d*)$"))
    number = F.when(whole, raw.try_cast("bigint"))
    single = violations(
        listed.withColumn("__n", number),
        [value],
        [
            rule(whole, "not an integer"),
            rule(~whole | F.coalesce(F.col("__n").between(0, source_count - 1), F.lit(False)), "out of range"),
        ],
    )
    repeated = (
        listed.select(number.alias("__n")).where("__n is not null").groupBy("__n").agg(F.count(F.lit(1)).alias("c"))
        .where("c > 1")
        .select(F.col("__n").cast("string").alias(value), F.lit("duplicate").alias("rule"))
    )
    return single.unionByName(repeated)


def worklist_report(work: DataFrame, requested: DataFrame) -> DataFrame:
    """Per class: requested, generated, and pairs made more than once. ``work`` is ``class_id, image_index``."""
    pairs = work.groupBy("class_id", "image_index").agg(F.count(F.lit(1)).alias("c"))
    made = pairs.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("generated"),
        F.count_if(F.col("c") > 1).alias("repeated"),
        F.max("image_index").alias("last"),
    )
    zero = F.lit(0).cast("bigint")
    joined = requested.select("class_id", F.col("n").cast("bigint").alias("requested")).join(made, "class_id", "full_outer")
    return joined.select(
        "class_id",
        F.coalesce("requested", zero).alias("requested"),
        F.coalesce("generated", zero).alias("generated"),
        F.coalesce("repeated", zero).alias("repeated"),
        (
            F.col("requested").eqNullSafe(F.col("generated"))
            & (F.coalesce("repeated", zero) == 0)
            & (F.col("last") == F.col("requested") - 1)
        ).alias("complete"),
    )
