"""Image headers: every format and mode, headers beyond the prefix, and what is sent to Python."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from shardloom.functions.image_header import image_header, parse
from shardloom.operators import verify


def png(width, height, depth=8, colour=2):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">IIBB", width, height, depth, colour) + bytes(7)


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def jpeg(width, height, components=3, before=(), start=0xC0):
    frame = b"\x08" + struct.pack(">HHB", height, width, components) + bytes(3 * components)
    return b"\xff\xd8" + b"".join(before) + segment(start, frame) + segment(0xDA, b"\x01") + bytes(50)


def webp(chunk, body):
    return b"RIFF" + bytes(4) + b"WEBP" + chunk + len(body).to_bytes(4, "little") + body


LOSSY = webp(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 640 | 0x4000, 480))
LOSSLESS = webp(b"VP8L", b"\x2f" + (99 | 49 << 14 | 1 << 28).to_bytes(4, "little") + bytes(8))
EXTENDED = webp(b"VP8X", b"\x10\x00\x00\x00" + (1999).to_bytes(3, "little") + (999).to_bytes(3, "little"))
PROFILE = [segment(0xE2, b"ICC_PROFILE\0" + b"\xff" * 60000) for _ in range(4)]

CASES = [
    (png(3, 4), (3, 4, "PNG", "RGB", None)), (png(3, 4, colour=0), (3, 4, "PNG", "L", None)), (png(3, 4, 1, 0), (3, 4, "PNG", "1", None)),
    (png(3, 4, colour=3), (3, 4, "PNG", "P", None)), (png(3, 4, colour=4), (3, 4, "PNG", "LA", None)), (png(3, 4, colour=6), (3, 4, "PNG", "RGBA", None)),
    (png(3, 4)[:24], (3, 4, "PNG", None, None)),
    (jpeg(30, 40), (30, 40, "JPEG", "RGB", None)), (jpeg(30, 40, 1), (30, 40, "JPEG", "L", None)), (jpeg(30, 40, 4, start=0xC2), (30, 40, "JPEG", "CMYK", None)),
    (jpeg(30, 40, before=[segment(0xC4, bytes(30)), b"\xff\xff", segment(0xE1, b"Exif")]), (30, 40, "JPEG", "RGB", None)),
    (jpeg(31, 41, before=PROFILE), (31, 41, "JPEG", "RGB", None)),
    (LOSSY, (640, 480, "WebP", "RGB", None)), (LOSSLESS, (100, 50, "WebP", "RGBA", None)), (EXTENDED, (2000, 1000, "WebP", "RGBA", None)),
]
BROKEN = [b"", b"GIF89a", png(3, 4)[:20], jpeg(3, 4)[:8], b"\xff\xd8\xff\xda\x00\x02", b"\xff\xd8\xff\xe0\x00\x00", jpeg(3, 4, before=PROFILE)[:200_000], LOSSY[:25], b"\xff\xd8" + b"\xff" * 40_000]


@pytest.mark.parametrize("prefix", [1 << 14, 30, 12, 1 << 20])
def test_headers_do_not_depend_on_the_prefix(spark, prefix):
    rows = [(i, p) for i, (p, _) in enumerate(CASES)] + [(100 + i, p) for i, p in enumerate(BROKEN)] + [(200, None)]
    df = spark.createDataFrame(rows, "i int, payload binary")
    got = {r.i: tuple(r.h) for r in df.select("i", image_header(F.col("payload"), prefix).alias("h")).collect()}
    for i, (_, expected) in enumerate(CASES):
        assert got[i] == expected, i
    for i in [200, *range(100, 100 + len(BROKEN))]:
        assert got[i][:2] == (None, None) and got[i][4] == "unreadable image header", i


def test_a_second_look_goes_on_where_the_first_stopped():
    payload = jpeg(31, 41, before=PROFILE)
    first = parse(payload[: 1 << 14])
    assert first.width is None and (1 << 14) < first.resume < len(payload)
    assert parse(payload[first.resume :], first.resume)[:4] == (31, 41, "JPEG", "RGB")


def test_only_a_prefix_goes_to_python(spark):
    df = spark.createDataFrame([(1, b"x")], "i int, payload binary")
    plan = df.select(image_header(F.col("payload")).alias("h"))._jdf.queryExecution().executedPlan().toString()
    assert "_look(substring(payload" in plan and "_look(payload" not in plan


def test_store_finds_grey_and_palette_images(spark):
    payloads = [png(8, 8), png(8, 8, colour=0), png(8, 8, colour=3), jpeg(8, 8), jpeg(8, 9), jpeg(8, 8, 1), b"broken", None]
    images = spark.createDataFrame([(f"k{i}", p) for i, p in enumerate(payloads)], "key string, payload binary")
    report = verify.verify_store(verify.describe_images(images), images.select("key"), images.select("key")).first()
    assert (report.images, report.not_square, report.not_rgb) == (8, 3, 5)
    assert "not_rgb" not in verify.verify_store(verify.describe_images(images).drop("mode"), images, images).columns
