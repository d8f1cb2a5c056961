"""Arrays of text annotations: normalise, filter, put in reading order, serialise.

An annotation is ``struct<polygon: array<array<float>>, text, valid: boolean, rec_score: double, ...>``.
Two readings of ``valid`` exist on purpose: prompts drop only an explicit false,
transcripts also drop an explicit null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import squeeze, strip

ANNOTATION = "struct<polygon:array<array<float>>,text:string,valid:boolean,rec_score:double>"


def normalise(annotations: Column) -> Column:
    """Null list becomes empty, null polygon becomes empty, text becomes a string; other fields stay."""
    fixed = F.transform(
        annotations,
        lambda a: a.withField("polygon", F.coalesce(a["polygon"], F.array().cast("array<array<float>>"))).withField(
            "text", a["text"].cast("string")
        ),
    )
    return F.coalesce(fixed, F.array().cast(f"array<{ANNOTATION}>"))


def from_json_text(payload: Column) -> Column:
    """Annotations out of JSON text with per-annotation knowledge of absent fields.

    ``valid`` keeps the prompt reading, ``keep`` carries the transcript reading,
    ``extra`` holds the whole original entry.
    """
    entries = F.try_variant_get(F.try_parse_json(payload), "$", "array<variant>")
    return F.transform(
        entries,
        lambda v: F.struct(
            F.try_variant_get(v, "$.polygon", "array<array<float>>").alias("polygon"),
            F.try_variant_get(v, "$.text", "string").alias("text"),
            F.try_variant_get(v, "$.valid", "boolean").alias("valid"),
            F.try_variant_get(v, "$.rec_score", "double").alias("rec_score"),
            F.when(F.try_variant_get(v, "$.valid", "variant").isNull(), True)
            .otherwise(F.coalesce(F.try_variant_get(v, "$.valid", "boolean"), F.lit(False)))
            .alias("keep"),
            v.alias("extra"),
        ),
    )


def from_positional(payload: Column) -> Column:
    """The positional form ``[polygon, [text, score]]`` as annotation structs; entries of another shape drop out."""
    entries = F.try_variant_get(F.try_parse_json(payload), "$", "array<variant>")
    structs = F.transform(
        entries,
        lambda v: F.struct(
            F.try_variant_get(v, "$[0]", "array<array<float>>").alias("polygon"),
            F.try_variant_get(v, "$[1][0]", "string").alias("text"),
            F.lit(True).alias("valid"),
            F.try_variant_get(v, "$[1][1]", "double").alias("rec_score"),
            (
                (F.size(F.try_variant_get(v, "$", "array<variant>")) == 2)
                & (F.size(F.try_variant_get(v, "$[1]", "array<variant>")) == 2)
            ).alias("well_formed"),
        ),
    )
    return F.filter(structs, lambda a: F.coalesce(a["well_formed"], F.lit(False)))


def prompt_texts(annotations: Column) -> Column:
    """Texts that go into the prompt, in stored order: not explicitly invalid, not blank."""
    lines = F.transform(annotations, lambda a: F.when(F.coalesce(a["valid"], F.lit(True)), squeeze(a["text"])))
    return F.coalesce(F.filter(lines, lambda t: F.length(t) > 0), F.array().cast("array<string>"))


def centre(polygon: Column) -> tuple[Column, Column]:
    """(mean y, mean x) in 32-bit floats; +infinity for an unusable polygon."""
    flat = F.flatten(polygon)
    even = F.filter(flat, lambda _, i: i % 2 == 0)
    odd = F.filter(flat, lambda _, i: i % 2 == 1)
    regular = F.forall(polygon, lambda p: F.size(p) == F.size(F.get(polygon, F.lit(0))))
    usable = (
        F.coalesce(regular, F.lit(False))
        & (F.size(flat) > 0)
        & (F.size(flat) % 2 == 0)
        & ~F.exists(flat, lambda v: v.isNull())
    )

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0).cast("float"), lambda acc, v: (acc + v.cast("float")).cast("float"))
        return F.when(usable, (total / F.size(values)).cast("float")).otherwise(F.lit(float("inf")).cast("float"))

    return mean(odd), mean(even)


def reading_entries(annotations: Column, keep, min_score: float) -> Column:
    """Surviving annotations as ``struct(y, x, ordinal, text)`` in reading order (stable on ties)."""

    def entry(a: Column, i: Column) -> Column:
        y, x = centre(a["polygon"])
        text = strip(a["text"])
        survives = (
            keep(a)
            & (F.coalesce(a["rec_score"], F.lit(1.0)) >= F.lit(float(min_score)))
            & F.coalesce(F.length(text) > 0, F.lit(False))
        )
        return F.when(survives, F.struct(y.alias("y"), x.alias("x"), i.alias("ordinal"), text.alias("text")))

    return F.array_sort(F.array_compact(F.transform(annotations, entry)))


def keep_valid(a: Column) -> Column:
    """Transcript reading of a present ``valid`` field: null counts as false."""
    return F.coalesce(a["valid"], F.lit(False))


def keep_flag(a: Column) -> Column:
    """For annotations parsed from JSON, where absent and null differ."""
    return a["keep"]


def keep_all(a: Column) -> Column:
    return F.lit(True)


def transcript(annotations: Column, texts: Column, keep=keep_valid, min_score: float = 0.0, separator: str = "\n"):
    """Reading-order transcript.

    Rejected structured labels never fall back to ``texts``; only a sample
    without any structured label does.
    """
    entries = reading_entries(annotations, keep, min_score)
    plain = F.filter(F.transform(texts, strip), lambda t: F.length(t) > 0)
    return (
        F.when(F.size(entries) > 0, F.array_join(F.transform(entries, lambda e: e["text"]), separator))
        .when(F.coalesce(F.size(annotations), F.lit(0)) > 0, F.lit(""))
        .otherwise(F.coalesce(F.array_join(plain, separator), F.lit("")))
    )
