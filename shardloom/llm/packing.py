"""Packing documents into fixed windows by best-fit decreasing.

Tokens of a document are cut into full windows first; what is left of it is placed whole.  A segment tree
over remaining capacities finds the tightest open window.  Pieces are numbered, dealt out by hash to groups of
bounded size, and each group is packed by itself: with thousands of pieces in a group the padding is that of its
last windows.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..session import materialise
from .chunking import arrow_schema, plain
from .memory import give_back

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the split of byte-level BPE
#: Text before U+0250 is classed alike by both pre-tokenisers; words with later characters are left to the library itself.
_LATER = re.compile("[\u0250-\U0010ffff]")
#: A place that no pre-token crosses: after a word, before a single space or line break with a word behind it.
_BETWEEN = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Bytes of text whose ids are held at once.
_SLICE = 4 << 20


class TextEncoder:
    """Ids of a byte-level BPE tokenizer file.

    Texts are encoded whole by a second implementation of the same merges.  Stretches of words that hold later
    characters, and texts that hold a special token, go to the library; short stretches met before are looked up.
    """

    def __init__(self, tokenizer_file: str, max_known: int = 50_000):
        self.library = Tokenizer.from_file(tokenizer_file)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        with open(tokenizer_file, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        self.direct = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not spec.get("normalizer")
        if self.direct:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(shown)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
            self.core = tiktoken.Encoding("whole", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, np.ndarray] = {}
        self.max_known = max_known

    def _by_library(self, text: str) -> np.ndarray:
        if text in self.known:
            return self.known[text]
        ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) < 64:
            if len(self.known) >= self.max_known:
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, np.uint32)
        if not self.direct or (self.special and self.special.search(text)):
            return self._by_library(text)
        if text.isascii() or not _LATER.search(text):
            return self.core.encode_to_numpy(text, disallowed_special=())
        out, plain = [], []

        def flush():
            if plain:
                out.append(self.core.encode_to_numpy("".join(plain), disallowed_special=()))
                plain.clear()

        for stretch in _BETWEEN.split(text):
            if _LATER.search(stretch):
                flush()
                out.append(self._by_library(stretch))
            else:
                plain.append(stretch)
        flush()
        return np.concatenate(out)


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_file: str) -> TextEncoder:
    return TextEncoder(tokenizer_file)


def token_pieces(
    docs: DataFrame, tokenizer_file: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): the full windows of each document and the piece that is left.

    Every document ends with ``end_id``, so an empty or null text is one piece of one token.  A document
    whose tokens fill its windows exactly has no further piece.  Columns beside id and text are ignored, whatever
    their names; repeated rows are documents of their own.  A very long text is encoded by one task, which holds
    its ids.  Nothing is shuffled.
    """
    spec = "doc_id long, start long, length long, ids binary, doc_tokens long"
    schema, end = arrow_schema(spec), np.array([end_id], np.uint32)

    def pieces(docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        total = np.array([len(i) + 1 for i in ids], np.int64)
        held = np.concatenate([x for i in ids for x in (i, end)]).astype("<u4")
        count = -(-total // window)
        doc = np.repeat(np.arange(len(ids)), count)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
        length = np.minimum(total[doc] - start, window)
        ends = np.zeros(len(doc) + 1, np.int64)
        np.cumsum(length, out=ends[1:])  # the pieces follow each other as the ids do
        own = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(4 * ends), pa.py_buffer(held)])
        columns = [pa.array(docs, pa.int64()).take(pa.array(doc)), start, length, own.cast(pa.binary()), total[doc]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file).encode
        for batch in batches:
            names, ids, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                names.append(doc.as_py())
                ids.append(encode(text.as_py()))
                size += ids[-1].nbytes
                if size >= _SLICE:
                    yield pieces(names, ids)
                    names, ids, size = [], [], 0
            if names:
                yield pieces(names, ids)
            give_back()

    return plain(docs, id_col, text_col).mapInArrow(cut, spec)


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree that finds the least sufficient capacity."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        node = self.leaves + capacity
        while node:
            self.filled[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``need``, or None."""
        filled, node = self.filled, self.leaves + need
        while not filled[node]:
            while node & 1:  # up while this is a right child
                node >>= 1
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # ran off the right edge
                return None
        while node < self.leaves:
            node = 2 * node if filled[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            filled[node] -= 1
            node >>= 1
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece; ``lengths`` in the order in which equal ones are placed."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, used = (window, used), used + 1
        capacity, number[i] = found
        offset[i] = window - capacity
        if capacity > need:
            tree.add(capacity - need, found[1])
    return number, offset


def place(pieces: DataFrame, n_rows: int | None = None, window: int = 2048, group_rows: int = 16_384) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Pieces are written once with a number of their own, counted, and dealt out by a hash of that number to groups of
    about ``group_rows``, so neither one long document nor an id that repeats fills a group.  Sequence ids carry
    the group in their upper half.  All columns of ``pieces`` are carried along.  Equal lengths are placed by
    doc_id, start and number; repeated rows are pieces like any other.  ``n_rows`` is not used any more.
    """
    columns = pieces.columns
    numbered = materialise(pieces.withColumn("__number", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(numbered.count() / group_rows))
    dealt = numbered.withColumn("__group", F.pmod(F.xxhash64("__number"), F.lit(groups)))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "__number")])
        number, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        group = table.column("__group").to_numpy()
        out = table.select(columns).append_column("sequence_id", pa.array((group << 32) + number))
        return out.append_column("offset", pa.array(offset))

    return dealt.groupBy("__group").applyInArrow(pack, f"{spec}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_file: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of ``docs`` with their ids and places: (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""
    return place(token_pieces(docs, tokenizer_file, window, end_id), window=window)
