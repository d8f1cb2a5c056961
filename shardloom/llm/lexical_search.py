"""Ranked lexical search: term at a time, rarest first, with a limit on the accumulators.

The documents are indexed once: every row becomes its length in terms and the counts of the terms that some
query asks for.  Tasks then rank their own blocks of documents.  In a block a query's terms are added up from
the rarest to the commonest; every document met gets an accumulator until the terms that are left could not
lift a new one to the k-th score known by then.  From there on only the accumulators there are get updated,
exactly.  Each task keeps k lines per query over all its blocks, whose k-th score is the bar of the next block,
and the lines of the tasks meet in one ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .memory import give_back

_IN_TERM = np.ones(256, bool)
_IN_TERM[:128] = [chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text that are cut into terms at a time.
_SLICE = 4 << 20
#: Postings that are ranked at a time.
_BLOCK = 1 << 21
#: Bytes of query texts that are shipped with the tasks; more of them are searched for in several passes.
MAX_QUERY_BYTES = 8 << 20
_INDEX = "doc_id long, n long, terms array<int>, counts array<long>"
_INDEX_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``_SLICE`` that end between two texts or, inside a long text, between two terms."""
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        to = int(offsets[np.searchsorted(offsets, at + _SLICE, side="right") - 1])
        if to <= at:  # inside a long text
            to, end = min(at + _SLICE, stop), int(offsets[np.searchsorted(offsets, at, side="right")])
            while to < end and _IN_TERM[data[to]]:
                to += 1
            to = min(to, end)
        yield at, to
        at = to


def terms_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each term, terms) of a column of texts, slice by slice; ASCII letters are lower-cased, null has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for lo, hi in _slices(data, offsets):
        inside = _IN_TERM[data[lo:hi]]
        edge = np.zeros(hi - lo + 1, bool)
        between = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")]
        edge[between - lo] = True
        start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
        end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
        ends = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=ends[1:])
        letters = _LOWER[data[lo:hi][inside]]
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        yield np.searchsorted(offsets, start + lo, side="right") - 1, words


class Query(NamedTuple):
    """An item: its id and how often it asks for which terms of the vocabulary."""

    item_id: int | None
    terms: Counter


def _queries(rows: list) -> tuple[list[Query], pa.Array]:
    """The items and their vocabulary."""
    column = pa.array([r["text"] for r in rows], pa.string())
    owners, words = [np.zeros(0, np.int64)], [pa.array([], pa.large_binary())]
    for row, found in terms_of(column):
        owners.append(row)
        words.append(found)
    coded = pa.concat_arrays(words).dictionary_encode()
    asked = [Counter() for _ in rows]
    for row, term in zip(np.concatenate(owners).tolist(), coded.indices.to_pylist()):
        asked[row][term] += 1
    return [Query(r["item_id"], c) for r, c in zip(rows, asked)], coded.dictionary


def _index(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, counts): a line per document that has a term; ``terms`` are the asked ones, ascending."""
    size = max(1, len(vocabulary))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, counts = np.zeros(batch.num_rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, words in terms_of(batch.column(1)):
                n += np.bincount(rows, minlength=batch.num_rows)
                term = pc.index_in(words, value_set=vocabulary)
                asked = term.is_valid().to_numpy(zero_copy_only=False)
                found = rows[asked] * size + term.drop_null().to_numpy()
                key, count = np.unique(found, return_counts=True)
                keys.append(key)
                counts.append(count)
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, place, np.concatenate(counts))
            some = np.flatnonzero(n)
            ends = np.zeros(len(some) + 1, np.int32)
            ends[1:] = np.searchsorted(key, (some + 1) * size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)), pa.array(n[some]),
                    pa.ListArray.from_arrays(ends, pa.array((key % size).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(count)),
                ],
                schema=_INDEX_ARROW,
            )
            give_back()

    return docs.mapInArrow(cut, _INDEX)


class Block:
    """Postings of some documents by term: the documents that hold it, ascending, and what it is worth in each."""

    def __init__(self, doc_id: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, total: int, length: int):
        self.doc_id = doc_id
        m = 100 - 75 + (75 * n * total) // length
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        worth = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.doc, self.worth = doc[order], worth[order]
        self.term, self.first = np.unique(terms[order], return_index=True)
        self.most = np.maximum.reduceat(self.worth, self.first) if len(self.term) else np.zeros(0, np.int64)
        self.stop = np.append(self.first[1:], len(order))
        self.place = {t: i for i, t in enumerate(self.term.tolist())}
        self.score = np.zeros(len(n), np.int64)

    def rank(self, plan: list[tuple[int, int]], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a query: the ``k`` best and any tied with the last, those below ``bar`` may lack.

        ``plan`` has (term, weight times its repeats), the rarest term first.
        """
        plan = [(self.place[t], g) for t, g in plan if t in self.place]
        left = np.cumsum([0, *[g * int(self.most[p]) for p, g in reversed(plan)]])[::-1]
        score, at = self.score, 0
        while at < len(plan) and left[at] >= bar:
            p, gain = plan[at]
            own = slice(self.first[p], self.stop[p])
            score[self.doc[own]] += gain * self.worth[own]
            at += 1
            if at < len(plan) and left[at] >= bar:
                met = score[score > 0]
                if len(met) >= k:
                    bar = max(bar, int(np.partition(met, -k)[-k]))
        kept = np.flatnonzero(score)
        found = score[kept]
        score[kept] = 0
        for p, gain in plan[at:]:  # no new accumulators
            own = self.doc[self.first[p] : self.stop[p]]
            place = np.minimum(np.searchsorted(own, kept), len(own) - 1)
            found += np.where(own[place] == kept, gain * self.worth[self.first[p] + place], 0)
        if len(found) > k:
            best = found >= np.partition(found, -k)[-k]
            kept, found = kept[best], found[best]
        return kept, found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, postings = [], 0
    for batch in batches:
        held.append(batch)
        postings += len(batch.column("terms").flatten()) + batch.num_rows
        if postings >= _BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, postings = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pass(docs: DataFrame, rows: list, k: int) -> DataFrame:
    queries, vocabulary = _queries(rows)
    index = materialise(_index(docs, vocabulary), "postings")
    total, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held_by = index.select(F.explode("terms").alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in held_by.collect()}  # at most a line per asked term
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    plans = [
        [(t, weight[t] * q.terms[t]) for t in sorted(q.terms, key=lambda t: (df.get(t, 0), t)) if weight.get(t)]
        for q in queries
    ]
    ids = [q.item_id for q in queries]
    spec = "item_no int, item_id long, doc_id long, score long"
    schema = pa.schema([("item_no", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int, int | None]]] = [[] for _ in plans]
        for table in _blocks(batches):
            terms, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
            ends = terms.offsets.to_numpy()
            block = Block(
                table.column("doc_id").combine_chunks(), table.column("n").to_numpy(), ends - ends[0],
                terms.flatten().to_numpy(), counts.flatten().to_numpy(), total, length,
            )
            for no, plan in enumerate(plans):
                bar = -best[no][-1][0] if len(best[no]) == k else 0
                kept, found = block.rank(plan, k, bar)
                if len(kept):
                    names = block.doc_id.take(pa.array(kept)).to_pylist()
                    new = [(-s, d is None, d or 0, d) for s, d in zip(found.tolist(), names)]
                    best[no] = sorted([*best[no], *new], key=lambda x: x[:3])[:k]
            give_back()
        lines = [(no, ids[no], d, -s) for no, found in enumerate(best) for s, _, _, d in found]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*lines), schema)] if lines else [pa.array([], f.type) for f in schema], schema=schema)

    return index.mapInArrow(rank, spec)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.  A term is a run of
    ASCII letters and digits and of any characters beyond ASCII, ASCII letters lower-cased.  A row is a
    document, also when its id or text repeats or is null; null and empty texts have no term and are no
    document of the statistics.  Equal scores go by doc_id, a null one last.  Rows equal in item_id and text are
    one item; items without terms, and tables without documents, give no line.

    Long texts are cut into terms slice by slice.  Queries travel with the tasks, so they are taken in passes of
    at most ``MAX_QUERY_BYTES`` of text.  Every pass reads the documents once and its index twice and shuffles ``k``
    lines per item and task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    passes = max(1, math.ceil(2 * size / MAX_QUERY_BYTES)) if size > MAX_QUERY_BYTES else 1
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = []
    for no in range(passes):
        part = items.where(dealt == no).orderBy("item_id", "text").collect()  # bounded by MAX_QUERY_BYTES
        found.append(_pass(docs, part, k).withColumn("pass_no", F.lit(no)))
    lines = reduce(DataFrame.unionAll, found)
    order = Window.partitionBy("pass_no", "item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lines.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
