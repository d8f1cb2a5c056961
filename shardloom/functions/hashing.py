"""Portable hash uniforms: repeatable draws that do not depend on partitioning or retries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCALE = float(1 << 52)


def uniform(seed, *keys: Column) -> Column:
    """A double in [0, 1) from 52 bits of the md5 of ``seed:key:...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(_SCALE)


def standard_normal(seed, *keys: Column) -> Column:
    """Box-Muller over two independent hash uniforms."""
    u1 = F.lit(1.0) - uniform(f"{seed}a", *keys)
    u2 = uniform(f"{seed}b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def stable_seed(seed: int, class_id: Column, index: Column, class_stride: int) -> Column:
    """Seed of one output: independent of worker, order and batch size."""
    return F.lit(seed).cast("bigint") + class_id.cast("bigint") * F.lit(class_stride) + index.cast("bigint")
