"""Words of whole Arrow text columns as numpy positions and names by hash; residues for names of stretches."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words(NamedTuple):
    """Words of several texts: bytes, start and end of each word, and the first word of each text (n + 1 numbers)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def split(texts: pa.Array | pa.ChunkedArray, between: np.ndarray = SPACE) -> Words:
    """Words between the bytes marked in ``between`` (0x20 and 0x09 to 0x0D); null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    base = int(offsets[0])
    data = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - base
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, in place on unsigned 64-bit integers."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KEYS = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def names128(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128-bit name of each word in two halves.

    The bytes of a word of at most 16 are shuffled by three invertible rounds, so such words of one length have
    one name only if they are equal; a longer word is named by the XXH3 hash of its bytes.
    """
    size = words.end - words.start
    padded = np.concatenate([words.data, np.zeros(16, np.uint8)])
    at = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,), writeable=False)
    left, right = at[words.start], at[words.start + 8]
    bits = np.arange(9, dtype=np.uint64) * np.uint64(8)
    kept = np.append((np.uint64(1) << bits[:8]) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
    left &= kept[np.minimum(size, 8)]
    right &= kept[np.clip(size - 8, 0, 8)]
    right ^= mix(left + size.astype(np.uint64) * _KEYS[0])
    left ^= mix(right + _KEYS[1])
    right ^= mix(left + _KEYS[2])
    long = np.flatnonzero(size > 16)
    if len(long):
        data = words.data.data
        digests = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(words.start[long].tolist(), words.end[long].tolist())]
        own = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
        left[long], right[long] = own[:, 0], own[:, 1]
    return left, right


def names(words: Words) -> np.ndarray:
    """64-bit name of each word: the first half of its 128-bit name."""
    return names128(words)[0]


# ---------------------------------------------------------------- arithmetic modulo 2**61 - 1

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)


def reduced(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers modulo 2**61 - 1."""
    x = (x >> np.uint64(61)) + (x & _P)
    return np.minimum(x, x - _P)  # the difference wraps around where there is nothing to take away


#: Products that are formed at a time: their parts stay in the processor's cache.
_AT_ONCE = 1 << 14


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Product modulo 2**61 - 1 of two arrays of residues, by halves of 30 and 31 bits."""
    out = np.empty(len(a), np.uint64)
    for at in range(0, len(a), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        x, y = a[part], b if np.ndim(b) == 0 else b[part]
        x_high, x_low, y_high, y_low = x >> np.uint64(31), x & np.uint64(0x7FFFFFFF), y >> np.uint64(31), y & np.uint64(0x7FFFFFFF)
        middle = x_low * y_high
        middle += x_high * y_low
        total = x_high * y_high
        total += total
        total += middle >> np.uint64(30)
        middle &= np.uint64(0x3FFFFFFF)
        middle <<= np.uint64(31)
        total += middle
        x_low *= y_low
        total += x_low
        out[part] = reduced(total)
    return out


def running_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... n residues, modulo 2**61 - 1."""
    low, high = np.zeros(len(x) + 1, np.uint64), np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x & np.uint64(0xFFFFFFFF), out=low[1:])
    np.cumsum(x >> np.uint64(32), out=high[1:])
    total = times(reduced(high), np.uint64(1 << 32))
    total += reduced(low)
    return reduced(total)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a residue; kept for the next call."""
    known = _powers.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, times(known, np.uint64(pow(base, len(known), PRIME)))])
    _powers[base] = known
    return known[:n]
