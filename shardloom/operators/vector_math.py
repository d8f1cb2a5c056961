"""Cosines whose last bit does not depend on how rows are batched."""

from __future__ import annotations

import numpy as np
import pandas as pd


def row_sums(m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m))
    for d in range(m.shape[1]):
        out += m[:, d]
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt(row_sums(m * m)), 1e-12)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products summed dimension by dimension, so that a value does not depend on the shape of the batch."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += a[:, d, None] * b[None, :, d]
    return out


def finite_vectors(batch: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that hold a vector of finite numbers, and those vectors at unit length."""
    rows = batch.to_numpy()
    arrays = [None if v is None else np.asarray(v, dtype="float64") for v in rows]
    some = np.array([i for i, v in enumerate(arrays) if v is not None and v.ndim == 1 and np.isfinite(v).all()], dtype=np.int64)
    return some, unit_rows(np.stack([arrays[i] for i in some])) if len(some) else np.zeros((0, 0))
