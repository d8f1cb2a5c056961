"""Format, size and colour mode of images out of the first bytes of their payload."""

from __future__ import annotations

import struct
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Bytes of a payload that are looked at first; most headers end well before.
PREFIX_BYTES = 16 << 10

# Fixed values of the formats: PNG colour types, JPEG component counts, and the names that image libraries give them.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}

HEADER = (
    T.StructType()
    .add("width", T.IntegerType())
    .add("height", T.IntegerType())
    .add("format", T.StringType())
    .add("mode", T.StringType())
    .add("error", T.StringType())
)
_FOUND = T.StructType([*HEADER.fields]).add("resume", T.LongType())


class Header(NamedTuple):
    """What a header says; ``resume`` is the offset from which more bytes are needed to go on."""

    width: int | None = None
    height: int | None = None
    format: str | None = None
    mode: str | None = None
    resume: int | None = None


NOTHING = Header()


def _png(data: bytes) -> Header:
    if len(data) < 24:
        return Header(format="PNG", resume=0)
    width, height = struct.unpack(">II", data[16:24])
    if len(data) < 26:
        return Header(width, height, "PNG", None, 0)
    depth, colour = data[24], data[25]
    mode = "1" if (depth, colour) == (1, 0) else PNG_MODES.get(colour)
    return Header(width, height, "PNG", mode)


def _jpeg(data: bytes, at: int, offset: int) -> Header:
    """Walks the segments of a JPEG from ``at`` in ``data``, which begins at ``offset`` of the payload."""
    while True:
        while at < len(data) and at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1  # fill bytes before a marker
        if at + 4 > len(data):
            return Header(format="JPEG", resume=offset + at)
        if data[at] != 0xFF:
            return NOTHING
        marker = data[at + 1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a body
            at += 2
            continue
        if marker in (0xD9, 0xDA):  # the picture begins or ends before any frame header
            return NOTHING
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                return Header(format="JPEG", resume=offset + at)
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            if at + 10 > len(data):
                return Header(width, height, "JPEG", None, offset + at)
            return Header(width, height, "JPEG", JPEG_MODES.get(data[at + 9]))
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        if length < 2:
            return NOTHING
        at += 2 + length


def _webp(data: bytes) -> Header:
    if len(data) < 30:
        return Header(format="WebP", resume=0)
    chunk = data[12:16]
    if chunk == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", data[26:30])
        return Header(width & 0x3FFF, height & 0x3FFF, "WebP", "RGB")
    if chunk == b"VP8L" and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return Header((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "WebP", "RGBA" if bits >> 28 & 1 else "RGB")
    if chunk == b"VP8X":
        width, height = (int.from_bytes(data[i : i + 3], "little") + 1 for i in (24, 27))
        return Header(width, height, "WebP", "RGBA" if data[20] & 0x10 else "RGB")
    return NOTHING


def parse(data: bytes, offset: int = 0) -> Header:
    """Header in ``data``; with an ``offset``, ``data`` begins there, where an earlier look at a JPEG had to stop."""
    if offset:
        return _jpeg(data, 0, offset)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"\xff\xd8":
        return _jpeg(data, 2, 0)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    return NOTHING


@F.pandas_udf(_FOUND)
def _look(data: pd.Series, offset: pd.Series) -> pd.DataFrame:
    found = [NOTHING if d is None else parse(bytes(d), int(o)) for d, o in zip(data, offset)]
    return pd.DataFrame(
        {
            "width": pd.array([h.width for h in found], dtype="Int32"),
            "height": pd.array([h.height for h in found], dtype="Int32"),
            "format": [h.format for h in found],
            "mode": [h.mode for h in found],
            "error": [None if h.width is not None else "unreadable image header" for h in found],
            "resume": pd.array([h.resume for h in found], dtype="Int64"),
        }
    )


def image_header(payload: Column, prefix: int = PREFIX_BYTES) -> Column:
    """(width, height, format, mode, error) of an image payload; an unreadable one has an error text.

    Only the first ``prefix`` bytes go to Python.  A JPEG whose frame header lies behind long comments, colour
    profiles or thumbnails gets a second look from the segment at which the first had to stop, with the rest of
    the payload; such payloads are few, for all others nothing is sent twice.
    """
    size = F.octet_length(payload)
    first = _look(F.substring(payload, 1, prefix), F.lit(0).cast("long"))
    more = first["resume"].isNotNull() & (size > prefix)
    rest = F.when(more & (first["resume"] < size), F.substr(payload, (first["resume"] + 1).cast("int"), F.lit(2**31 - 1)))
    second = _look(rest, F.coalesce(F.when(more, first["resume"]), F.lit(0).cast("long")))
    chosen = F.when(more, second).otherwise(first)
    return F.struct(*[chosen[f].alias(f) for f in HEADER.fieldNames()])


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a whole payload, None when its header cannot be read."""
    found = parse(data)
    return (found.width, found.height) if found.width is not None else None
