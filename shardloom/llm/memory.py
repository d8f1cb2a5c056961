"""Memory of Python workers, which live on from task to task."""

from __future__ import annotations

import ctypes

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not every C library has it
    _trim = None


def give_back() -> None:
    """Return freed memory to the system, so that one large batch does not stay with the worker."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
