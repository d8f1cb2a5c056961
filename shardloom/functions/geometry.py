"""Image geometry as integer columns: bucket ratio, resize and crop sizes."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, functions as F


def _constants(values: list) -> Column:
    """A constant array out of SQL literals: one call, folded into the plan."""
    return F.expr(f"array({', '.join(map(str, values))})")


def nearest_bucket(ratio: Column, table: list[tuple[str, int, int]]) -> Column:
    """Ordinal of the nearest entry of an ascending table, first entry on ties.

    The table is literal in the plan, so the theta join needs neither shuffle nor
    broadcast.  A grid of cells narrower than half the closest pair of midpoints
    gives the first candidate; at most two comparisons with the following
    entries settle the rest.  The expression is small on purpose: the JVM does
    not compile methods above 8000 bytes, and a comparison per entry is above that.
    """
    values = [float(r) for r, _, _ in table]
    if values != sorted(values):
        raise ValueError("The ratio table must be ascending")
    middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
    step = min([b - a for a, b in zip(middles, middles[1:])] or [1.0]) / 2
    low = values[0]
    cells = math.ceil((values[-1] - low) / step) + 2
    # One cell of slack below, so rounding at a cell edge never skips the true entry.
    first = [bisect.bisect_left(middles, low + (c - 1) * step) for c in range(cells)]
    cell = F.greatest(F.lit(0.0), F.least(F.lit(float(cells - 1)), F.floor((ratio - low) / step).cast("double")))
    start = F.get(_constants(first), cell.cast("int"))
    padded = _constants([f"{v!r}D" for v in values + [1e300, 1e300]])

    def distance(offset: int) -> Column:
        return F.abs(F.get(padded, start + offset) - ratio)

    return start + F.when(distance(0) <= distance(1), 0).when(distance(1) <= distance(2), 1).otherwise(2)


def bucket_entry(ordinal: Column, table: list[tuple[str, int, int]]) -> dict[str, Column]:
    """Ratio text, height and width of a table entry."""

    def entry(column: list) -> Column:
        return F.get(_constants(column), ordinal)

    return {
        "ratio": entry([f"'{r}'" for r, _, _ in table]),
        "bucket_h": entry([h for _, h, _ in table]),
        "bucket_w": entry([w for _, _, w in table]),
    }


def cover_resize(h: Column, w: Column, bucket_h: Column, bucket_w: Column) -> tuple[Column, Column]:
    """Size that covers the bucket before a centre crop; fractions are cut."""
    h, w = h.cast("double"), w.cast("double")
    tall = bucket_h / h > bucket_w / w
    same = (h == bucket_h) & (w == bucket_w)
    new_h = F.when(tall, bucket_h).otherwise((h * bucket_w / w).cast("int"))
    new_w = F.when(tall, (w * bucket_h / h).cast("int")).otherwise(bucket_w)
    return F.when(same, bucket_h).otherwise(new_h).cast("int"), F.when(same, bucket_w).otherwise(new_w).cast("int")


def halve_scale_crop(w: Column, h: Column, size: int) -> dict[str, Column]:
    """Halve while the short side is at least twice ``size``, scale (half to even), crop the centre."""
    # Halving goes on while size * 2^k still fits into the short side: the bit length of the quotient.
    halvings = F.length(F.bin(F.floor(F.least(w, h) / size))) - 1
    factor = F.pow(F.lit(2.0), halvings)
    hw, hh = F.floor(w / factor), F.floor(h / factor)
    scale = F.lit(float(size)) / F.least(hw, hh)
    sw, sh = F.bround(hw * scale).cast("int"), F.bround(hh * scale).cast("int")
    return {
        "halvings": halvings,
        "scaled_w": sw,
        "scaled_h": sh,
        "crop_x": F.floor((sw - size) / 2).cast("int"),
        "crop_y": F.floor((sh - size) / 2).cast("int"),
    }


def fit_envelope(w: Column, h: Column, max_w: int, max_h: int, divisor: int) -> tuple[Column, Column]:
    """Shrink into an envelope, sides floored to a multiple of ``divisor`` and at least one multiple."""
    scale = F.least(F.lit(1.0), F.lit(float(max_w)) / w, F.lit(float(max_h)) / h)

    def side(v: Column) -> Column:
        return F.greatest(F.lit(divisor), (F.floor(v * scale / divisor) * divisor).cast("int"))

    return side(w), side(h)
