"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut every ``chunk_chars`` characters; each chunk also sees the start of the next one.  Chunks
are pre-tokenised by themselves, wherever their cut fell.  From a pre-token start on, the pattern looks only
forward, so two neighbours that share one start agree on all later ones: the first start they share in the
overlap is the stitch.  The stretches between stitches hold whole pre-tokens and are encoded apart.  A text
with a seam that has no shared start (one pre-token longer than the overlap) is put together and encoded
as one.  Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from .chunking import arrow_schema, pieces, plain, repeated, short_texts


SLICE = 1024  # rows of an Arrow batch that are worked on at once


@functools.lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file; built once per process."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_bytes(text: str, rank_file: str, pattern: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    return np.array(encoding(rank_file, pattern).encode_ordinary(text), "<u4").tobytes()


def decode_bytes(ids: bytes, rank_file: str, pattern: str) -> bytes:
    return encoding(rank_file, pattern).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def starts(text: str, pattern: regex.Pattern) -> list[int]:
    return [m.start() for m in pattern.finditer(text)]


def encode(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = 1 << 16, overlap: int = 1 << 10,
) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, one row per row of ``docs``.

    Null text counts as empty and gives no ids.  Repeated rows give repeated results, a null id stays null.
    Other columns of ``docs`` are not looked at.  ``rank_file`` must exist on the executors.
    """
    if not 0 < overlap <= chunk_chars:
        raise ValueError("the overlap must be positive and no longer than a chunk")

    rows = plain(docs, id_col, text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [encode_bytes(t, rank_file, pattern) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    short = short_texts(rows, chunk_chars).mapInArrow(whole, "doc_id long, ids binary")
    columns = ["__row", "doc_id", "copies", "chunk_no", "n_chunks", "start", "piece"]
    seams = "__row string, doc_id long, copies long, chunk_no int, n_chunks int, start long, piece string, head array<long>, tail array<long>"

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, schema = regex.compile(pattern), arrow_schema(seams)
        for batch in batches:
            data = batch.to_pydict()
            data["head"], data["tail"] = [], []
            for piece, at in zip(data["piece"], data["start"]):
                found = starts(piece, cut)
                data["head"].append([at + s for s in found if s < overlap])
                data["tail"].append([at + s for s in found if s >= chunk_chars])
            yield pa.RecordBatch.from_pydict(data, schema=schema)

    seamed = pieces(rows, chunk_chars, overlap).select(columns).mapInArrow(pretokenise, seams)
    order = Window.partitionBy("__row").orderBy("chunk_no")
    whole_text = Window.partitionBy("__row")
    shared = seamed.withColumn(
        "from", F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    ).withColumn("to", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    inner = F.col("chunk_no") > 0
    stitched = (
        shared.withColumn("seamless", F.max(inner & F.col("from").isNull()).over(whole_text))
        .withColumn("from", F.when(inner, F.col("from")).otherwise(F.lit(0)))
        .select(*columns, "from", "to", "seamless")
        .repartition("__row", "chunk_no")
    )
    parts = "__row string, doc_id long, copies long, chunk_no int, ids binary, rest string"

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(parts)
        for batch in batches:
            data = batch.to_pydict()
            ids, rest = [None] * batch.num_rows, [None] * batch.num_rows
            for i, piece in enumerate(data["piece"]):
                at, end, last = data["start"][i], data["to"][i], data["chunk_no"][i] == data["n_chunks"][i] - 1
                if data["seamless"][i]:
                    rest[i] = piece if last else piece[:chunk_chars]
                else:
                    stretch = piece[data["from"][i] - at : None if last else end - at]
                    ids[i] = encode_bytes(stretch, rank_file, pattern)
            out = {k: data[k] for k in ("__row", "doc_id", "copies", "chunk_no")} | {"ids": ids, "rest": rest}
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    encoded = stitched.mapInArrow(encode_pieces, parts)
    joined = encoded.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("copies").alias("copies"),
        F.sort_array(F.collect_list(F.struct("chunk_no", "ids", "rest"))).alias("parts"),
    )
    final = "doc_id long, copies long, ids binary"

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(final)
        for batch in batches:
            ids = []
            for own in batch.column("parts").to_pylist():
                if own[0]["rest"] is not None:
                    ids.append(encode_bytes("".join(p["rest"] for p in own), rank_file, pattern))
                else:
                    ids.append(b"".join(p["ids"] for p in own))
            out = {"doc_id": batch.column("doc_id"), "copies": batch.column("copies"), "ids": pa.array(ids, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(out.values()), schema=schema)

    long = joined.select("doc_id", "copies", "parts").mapInArrow(put_together, final)
    return short.unionByName(repeated(long, "doc_id", "ids"))


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the raw bytes of its ids in ``out`` (replaced if there); null ids give null."""
    rest = encoded.drop(out)
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"`{out}` binary"])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                decoded = [None if x is None else decode_bytes(x, rank_file, pattern) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, out])

    return rest.mapInArrow(raw, spec)
