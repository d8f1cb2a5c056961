"""Conversations as training texts, by Spark expressions alone.

Template: a block per run of turns of one role, blocks on lines of their own.  A block is ``### Role: `` and the
texts of its turns, each ended by ``</turn>``::

    ### User: first question</turn>second question</turn>
    ### Assistant: answer</turn>

A text that holds such a mark gets a backslash after the mark's first character (``<\\/turn>``,
``#\\## Assistant:``); where backslashes stand there already, one more is put in.  A mark of the template is thus
never found inside a text, and taking one backslash out of each such place gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END = "</turn>"
#: Roles with a label of their own; any other is written URL-encoded behind an equals sign.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
_LABEL = r"(?:System|User|Assistant|=[-.*_+%A-Za-z0-9]*+)"
_ESCAPE = rf"(?<=<)\\*+(?=/turn>)|(?<=#)\\*+(?=## {_LABEL}:)"
_UNESCAPE = rf"(?<=<)\\(?=\\*+/turn>)|(?<=#)\\(?=\\*+## {_LABEL}:)"
_HEADER = rf"^\n?### ({_LABEL}): "


def escape(text: Column) -> Column:
    """``text`` with the marks of the template broken up."""
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"\\$0"))


def unescape(text: Column) -> Column:
    """What :func:`escape` was given."""
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit(""))


def _label(role: Column) -> Column:
    known = F.coalesce(*[F.when(role == r, F.lit(name)) for r, name in LABELS.items()])
    return F.coalesce(known, F.concat(F.lit("="), F.url_encode(role)))


def _role(label: Column) -> Column:
    known = F.coalesce(*[F.when(label == name, F.lit(r)) for r, name in LABELS.items()])
    return F.coalesce(known, F.url_decode(F.substr(label, F.lit(2))))


def format_conversations(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): one text per conversation and the loss mask of its turns.

    ``turns`` has conv_id, turn, role, text; other columns are ignored, whatever their names.  Turns go by
    number, a null number first, equal numbers by role and text; repeated rows are turns like any other; null
    role and text are empty.  Rows without conv_id belong to no conversation and are left out; an empty
    table gives none.  ``mask`` runs along ``formatted`` in code points, an entry per turn: ``skip`` for what
    stands before its text, ``length`` of its escaped text, ``loss`` for the turns of role ``learned``.

    Texts are escaped where they are read and move once.  A conversation is one value, so its texts together
    must stay below the 2 GB that a value of Spark can hold; every step on its arrays is linear.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")
    )
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    found = rows.groupBy("conv_id").agg(sorted_turns.alias("t"))
    t, starts, n = F.col("t"), F.col("starts"), F.size("t")
    begins = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (t[F.greatest(i - 1, F.lit(0))]["role"] != t[i]["role"])
    )
    # A run of turns of one role is the slice up to the next start.
    runs = F.transform(
        starts,
        lambda s, k: F.struct(
            _label(t[s]["role"]).alias("label"),
            (t[s]["role"] == learned).alias("loss"),
            F.transform(F.slice(t, s + 1, F.coalesce(F.get(starts, k + 1), n) - s), lambda x: x["text"]).alias("texts"),
        ),
    )
    found = found.withColumn("starts", begins).select("conv_id", runs.alias("runs"))
    blocks = F.transform(
        "runs", lambda r: F.concat(F.lit("### "), r["label"], F.lit(": "), F.array_join(r["texts"], END), F.lit(END))
    )
    end = len(END)
    mask = F.transform(
        "runs",
        lambda r, k: F.transform(
            r["texts"],
            lambda x, j: F.struct(
                # the mark before, and at the start of a run its line break and header
                F.when(j > 0, end).otherwise(F.when(k > 0, end + 1).otherwise(0) + 6 + F.char_length(r["label"])).alias("skip"),
                F.char_length(x).alias("length"),
                r["loss"].alias("loss"),
            ),
        ),
    )
    return found.select("conv_id", F.array_join(blocks, "\n").alias("formatted"), F.flatten(mask).alias("mask"))


def read_back(formatted: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, turns, learned) and the columns of ``carry`` out of (conv_id, formatted, mask).

    ``turns`` are the roles and texts of the conversation, found by the marks alone; ``learned`` are the texts
    that the mask lays open, unescaped.
    """
    parts = F.slice(F.split("formatted", END, -1), 1, F.size("mask"))
    cut = formatted.select("conv_id", *carry, "mask", parts.alias("parts")).withColumn(
        "heads", F.transform("parts", lambda p: F.regexp_extract(p, _HEADER, 1))
    )
    # Places of the headers; a turn belongs to the last one at or before it.
    texts = F.zip_with(
        "parts", "heads", lambda p, h: unescape(F.when(h == "", p).otherwise(F.regexp_replace(p, _HEADER, "")))
    )
    at = F.filter(F.sequence(F.lit(0), F.size("heads") - 1), lambda i: F.col("heads")[i] != "")
    cut = cut.withColumn("texts", texts).withColumn("at", at)
    roles = F.flatten(
        F.transform(
            "at",
            lambda s, k: F.array_repeat(
                _role(F.col("heads")[s]), F.coalesce(F.get(F.col("at"), k + 1), F.size("heads")) - s
            ),
        )
    )
    turns = F.zip_with(roles, "texts", lambda r, x: F.struct(r.alias("role"), x.alias("text")))
    # The masked stretch of a part is its end: a part stops where the mark after the text begins.
    open_parts = F.filter(F.arrays_zip("parts", "mask"), lambda z: z["mask"]["loss"])
    learned = F.transform(open_parts, lambda z: unescape(F.right(z["parts"], z["mask"]["length"])))
    return cut.select("conv_id", *carry, turns.alias("turns"), learned.alias("learned"))
