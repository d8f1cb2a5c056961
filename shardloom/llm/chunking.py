"""Long texts in pieces: short texts are worked on where they are read, pieces of long ones are spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null text as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def short_texts(rows: DataFrame, chunk_chars: int) -> DataFrame:
    """The rows of :func:`plain` whose text is no longer than a chunk."""
    return rows.where(F.char_length("text") <= chunk_chars)


def pieces(rows: DataFrame, chunk_chars: int, overlap: int = 0) -> DataFrame:
    """The pieces of all longer texts: (__row, chunk_no, copies, doc_id, n_chunks, start, piece).

    Pieces start every ``chunk_chars`` characters and run ``overlap`` characters into the next one.
    ``__row`` tells rows of equal id but other text apart; rows equal in both are one with its ``copies``.
    The exchange deals rows out by (``__row``, ``chunk_no``), so the pieces of one text spread over tasks.
    """
    spec = "__row string, doc_id long, chunk_no int, n_chunks int, start long, piece string"
    schema = arrow_schema(spec)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cuts = range(0, len(text), chunk_chars)
                n = len(cuts)
                columns = [[row] * n, [doc] * n, range(n), [n] * n, cuts, [text[c : c + chunk_chars + overlap] for c in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")))
    long = rows.where(F.char_length("text") > chunk_chars).select(key.alias("__row"), "doc_id", "text")
    return long.mapInArrow(cut, spec).groupBy("__row", "chunk_no").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "n_chunks", "start", "piece")]
    )


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of each row as often as ``copies`` says."""
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy")
    return rows.select(*columns, again).drop("__copy")


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string."""
    kinds = {
        "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split(" ", 1) for c in ddl.split(","))])
