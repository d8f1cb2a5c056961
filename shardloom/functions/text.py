"""Text columns: whitespace, captions, prompts, flags, transcripts of visible text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed_values import (
    SIZE_FLAG_VALUE,
    VISIBLE_TEXT_PATTERN,
    TEXT_TEMPLATE_HEAD,
    TEXT_TEMPLATE_TAIL,
    VISIBLE_END,
    VISIBLE_LINK,
    VISIBLE_MANY,
    VISIBLE_ONE,
)

# Every character that Python's str.split() and str.strip() treat as space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# The same characters as text, for the expressions that take a character set.
SPACES = "".join(
    chr(c)
    for first, last in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(first, last + 1)
)
_TO_SPACE = SPACES.replace(" ", "")


def squeeze(text: Column) -> Column:
    """Runs of whitespace become one space; ends are trimmed."""
    return _squeeze(text, _TO_SPACE)


def _squeeze(text: Column, chars: str) -> Column:
    # Mapping to plain spaces first leaves a trivial pattern, about twice as fast as one class of all spaces.
    return F.trim(F.regexp_replace(F.translate(text, chars, " " * len(chars)), "  +", " "))


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace at both ends, keep the inside."""
    return F.trim(text, F.lit(SPACES))


def clean_caption(caption: Column) -> Column:
    return _squeeze(F.coalesce(caption, F.lit("")), _TO_SPACE + "*")


def visible_text_prompt(clean: Column, texts: Column) -> Column:
    """Append the quoted visible texts to a clean caption; unchanged without texts."""
    n = F.size(texts)
    last = F.element_at(texts, -1)
    head = F.array_join(F.slice(texts, F.lit(1), F.greatest(n - 1, F.lit(0))), '", "')
    visible = (
        F.when(n == 1, F.concat(F.lit(VISIBLE_ONE + '"'), last, F.lit('"')))
        .when(n == 2, F.concat(F.lit(VISIBLE_MANY + '"'), head, F.lit('" and "'), last, F.lit('"')))
        .otherwise(F.concat(F.lit(VISIBLE_MANY + '"'), head, F.lit('", and "'), last, F.lit('"')))
    )
    base = F.rtrim(clean, F.lit(" ."))
    return F.when(n <= 0, clean).otherwise(F.concat(base, F.lit(VISIBLE_LINK), visible, F.lit(VISIBLE_END)))


def template_prompt(text: Column) -> Column:
    return F.concat(F.lit(TEXT_TEMPLATE_HEAD), text, F.lit(TEXT_TEMPLATE_TAIL))


def join_visible_texts(texts: Column) -> Column:
    """One normalised line out of an array of texts, blanks left out."""
    lines = F.filter(F.transform(texts, squeeze), lambda t: F.length(t) > 0)
    return F.array_join(lines, " ")


def first_line(text: Column) -> Column:
    return strip(F.element_at(F.split(text, "\n"), 1))


def target_text(prompt: Column) -> Column:
    """Visible text asked for by a prompt: quoted words, else the raw phrase, else the whole prompt."""
    pattern = VISIBLE_TEXT_PATTERN
    phrase = F.regexp_extract(prompt, pattern, 1)
    words = F.regexp_extract_all(phrase, F.lit(r'"([^"]*)"'), F.lit(1))
    return (
        F.when(~F.regexp_like(prompt, F.lit(pattern)), prompt)
        .when(F.size(words) > 0, F.array_join(words, " | "))
        .otherwise(strip(phrase))
    )


def before_flags(prompt: Column) -> Column:
    """The prompt up to its first size flag."""
    for flag in ("--aspect_ratio", "--ar", "--hw"):
        prompt = F.substring_index(prompt, flag, 1)
    return prompt


def flag_pair(prompt: Column, flag: str) -> Column:
    """``[a, b]`` of the first ``--flag a:b``; null when the flag is absent."""
    pattern = f"--{flag}{SIZE_FLAG_VALUE}"
    pair = F.transform(F.split(F.regexp_extract(prompt, pattern, 1), ":"), lambda s: s.try_cast("double"))
    return F.when(F.regexp_like(prompt, F.lit(pattern)), pair)


def prompt_ratio(prompt: Column) -> Column:
    """height/width asked for in the prompt, 1.0 by default."""
    long, short = flag_pair(prompt, "aspect_ratio"), flag_pair(prompt, "ar")
    pair = F.coalesce(long, short)
    return F.coalesce(pair[0] / pair[1], F.lit(1.0))


def tokens(text: Column) -> Column:
    """Whitespace tokens; an empty text has none."""
    return F.array_remove(F.split(squeeze(text), " "), "")


def token_window(ids: Column, prefix: int, max_len: int, pad: str) -> tuple[Column, Column]:
    """Pad or cut to ``prefix + max_len - 2``, keep the first token and the last ``max_len - 1``.

    Returns the window and its 0/1 mask.  Without a prefix the length is ``max_len``.
    """
    length = prefix + max_len - 2 if prefix else max_len
    padded = F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)
    real = F.least(F.size(ids), F.lit(length))
    mask = F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))

    def window(values: Column) -> Column:
        return F.concat(F.slice(values, 1, 1), F.slice(values, length - max_len + 2, max_len - 1))

    return window(padded), window(mask)


def list_literal(text: Column) -> Column:
    """``[a, b]`` becomes an array of trimmed entries; anything else is a one-entry array."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(
        text.startswith("[") & text.endswith("]"), F.transform(F.split(inner, ","), strip)
    ).otherwise(F.array(text))


def with_prefix(prompt: Column, lines: list[str] | None) -> Column:
    """System prompt lines in front of the prompt, only when configured."""
    return F.concat(F.lit("\n".join(lines)), prompt) if lines else prompt
