"""Array-of-float columns: norms, cosines, pixel range maps, padding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    """L2 norm, floored so that a zero vector stays zero after division."""
    squares = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.greatest(F.sqrt(squares), F.lit(1e-12))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda v: v.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def to_signed(pixels: Column) -> Column:
    return F.transform(pixels, lambda x: (x / 255.0 - 0.5) / 0.5)


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def to_uint8_round(values: Column) -> Column:
    return F.transform(values, lambda x: _clip((x + 1) * 127.5 + 0.5, 0.0, 255.0).cast("int"))


def to_uint8_clip_first(values: Column) -> Column:
    return F.transform(values, lambda x: ((_clip(x, -1.0, 1.0) + 1) * 127.5 + 0.5).cast("int"))


def to_uint8_shift(values: Column) -> Column:
    return F.transform(values, lambda x: _clip(x * 127.5 + 128.0, 0.0, 255.0).cast("int"))


def pad_last(values: Column, length: int) -> tuple[Column, Column]:
    """Repeat the last entry up to ``length``; the mask marks the real entries."""
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(values)), F.array_repeat(F.lit(0), missing))
    return F.concat(values, F.array_repeat(F.element_at(values, -1), missing)), mask
