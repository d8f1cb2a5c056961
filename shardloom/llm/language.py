"""Language identification by compression: the dictionary that compresses a text best names its language.

Per language a raw-content dictionary is filled with text of labelled rows.  A text is lower-cased, reduced
to its letters, cut into blocks and each block is compressed with every dictionary; the sum of the sizes
decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .memory import give_back

UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str | None) -> str:
    """The lower-case words of letters of a whole text."""
    return "" if text is None else _OTHER.sub(" ", text.lower()).strip()


def fit(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    dictionary_bytes: int = 1 << 16, sample_docs: int = 300, sample_text_chars: int = 16_384,
) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the language with most labelled rows first.

    The sample is bounded: per language the ``sample_docs`` distinct usable texts that come first by hash; of each
    the first ``sample_text_chars`` characters teach (texts are always classified whole).  Rows without id, text or
    language are not used; repeated ids and texts change nothing; without any usable row the list is empty.  A
    language is filled by one task out of its sample; what reaches the driver is a dictionary per label.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    first = Window.partitionBy("lang").orderBy("hash")
    # hashes alone are ranked; the texts of the few chosen rows are fetched afterwards, once each
    hashes = rows.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n"))
    chosen = hashes.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs)
    texts = rows.join(F.broadcast(chosen.select("lang", "hash")), ["lang", "hash"])  # sample_docs lines per language
    texts = texts.groupBy("lang", "hash").agg(F.min(F.left("text", F.lit(sample_text_chars))).alias("text"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("hash")
        content = b""
        for text in table.column("text").to_pylist():
            if len(content) < dictionary_bytes:
                content += letters(text).encode() + b" "
        return pa.table({"lang": table.column("lang").slice(0, 1), "content": pa.array([content[:dictionary_bytes]], pa.binary())})

    filled = texts.groupBy("lang").applyInArrow(fill, "lang string, content binary")
    counts = hashes.groupBy("lang").agg(F.sum("n").alias("n"))
    found = filled.join(counts, "lang").orderBy(F.desc("n"), "lang").select("lang", "content").collect()
    return [(r["lang"], bytes(r["content"])) for r in found if bytes(r["content"]).strip()]


@functools.lru_cache(maxsize=2)
def compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dictionaries:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False)))
    return out


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], level: int = 12, block: int = 2048) -> tuple[str, float]:
    """(language, score); the score is the relative margin to the second best, 0 to 1."""
    content = letters(text).encode()
    if not content or not dictionaries:
        return UNKNOWN, 0.0
    blocks = [content[i : i + block] for i in range(0, len(content), block)]
    sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in compressors(dictionaries, level)]
    if len(sizes) == 1:
        return dictionaries[0][0], 1.0
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min(s for i, s in enumerate(sizes) if i != best)
    return dictionaries[best][0], (second - sizes[best]) / second


def prediction(text: Column, dictionaries: list[tuple[str, bytes]]) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column, from the text alone."""
    fixed = tuple(dictionaries)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([classify(t, fixed) for t in texts], columns=["lang_pred", "score"])
            give_back()

    return predict(text)


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone and without a shuffle.

    Null texts, texts without a letter, and all texts when there are no dictionaries: ``und`` with score 0.
    Equal texts get equal results; equal sizes go to the language with more labelled rows.  Columns of the
    names ``lang_pred`` and ``score`` are replaced.  A very long text is compressed block by block in one task.
    """
    rest = docs.drop("lang_pred", "score")
    found = rest.withColumn("__found", prediction(F.col(text_col), dictionaries))
    return found.select(*rest.columns, "__found.lang_pred", "__found.score")


def is_clear(found: Column, min_margin: float = 0.002) -> Column:
    """Whether a prediction names a language by a margin that is not narrow."""
    return (found["lang_pred"] != UNKNOWN) & (found["score"] >= min_margin)


def accepted(identified: DataFrame, min_margin: float = 0.002) -> DataFrame:
    """Rows with a language whose margin is not narrow."""
    return identified.where(is_clear(F.struct("lang_pred", "score"), min_margin))
