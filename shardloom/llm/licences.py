"""Licence scans: winnowed fingerprints find candidates, banded alignment tells coverage and spans.

Words are runs of ASCII letters, digits and non-ASCII bytes, compared without case.  Hashes of ``gram`` words
are winnowed (the least of every ``guarantee - gram + 1`` consecutive ones is kept), so every match of
``guarantee`` words shares a fingerprint.  The inverted index of the templates is small and fixed; it is
shipped with the tasks and nothing is shuffled.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunking import arrow_schema
from .licence_texts import NOTICES, all_notices
from .words import Words, mix, names, split

__all__ = ["NOTICES", "scan"]

#: Templates of fewer words must stand in the text word for word: one other word may be another licence.
SHORT_WORDS = 13

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Template(NamedTuple):
    licence: str
    number: int
    words: np.ndarray


class Match(NamedTuple):
    start: int
    end: int
    matched: int


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[Words, np.ndarray]:
    words = split(texts, _BETWEEN)
    return words, names(words._replace(data=_LOWER[words.data]))


def winnow(name: np.ndarray, doc: np.ndarray, gram: int, guarantee: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, place) of the kept hashes over consecutive words of each text; short texts keep one."""
    n = len(name) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for step in range(gram):
        value = value * np.uint64(0x9E3779B97F4A7C15) + name[step : step + n]
    value = mix(value)
    real = doc[:n] == doc[gram - 1 :]
    width = guarantee - gram + 1
    kept = np.zeros(n, bool)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    # windows run over the places of one text; past its end a place counts as the largest value
    masked = np.where(real, value, top)
    best, at = masked.copy(), np.arange(n)
    for step in range(1, width):
        other = np.full(n, top)
        same = doc[: n - step] == doc[step:n]
        other[: n - step] = np.where(same, masked[step:], top)
        less = other < best
        best, at = np.where(less, other, best), np.where(less, np.arange(n) + step, at)
    # a window counts if it is full, or if it is the first of its text
    full = np.zeros(n, bool)
    m = n - width + 1
    if m > 0:
        full[:m] = real[:m] & real[width - 1 :] & (doc[:m] == doc[width - 1 : n])
    first = np.concatenate([[True], doc[1:n] != doc[: n - 1]])
    kept[at[(full | first) & real]] = True
    places = np.flatnonzero(kept & real)
    return value[places], places


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> Match | None:
    """Best local alignment near the diagonal ``text place - template place = shift``.

    A match scores 1, a mismatch or a gap costs 1; cells outside the band are not looked at.
    """
    width = 2 * band + 1
    score = [(0, -1, 0)] * (width + 1)  # (score, first text word, matches) by diagonal of the row before
    best: tuple[int, int, int, int] | None = None
    for i, word in enumerate(template.tolist()):
        row: list[tuple[int, int, int]] = []
        left = (0, -1, 0)
        for d in range(width):
            j = i + shift + d - band
            if 0 <= j < len(text):
                equal = word == text[j]
                s, start, hits = score[d]
                take = (s + 1, start if s > 0 else j, hits + 1) if equal and s > 0 else (1, j, 1) if equal else (s - 1, start, hits)
                up, side = score[d + 1], left
                cell = max(take, (up[0] - 1, up[1], up[2]), (side[0] - 1, side[1], side[2]), key=lambda c: (c[0], c[2]))
                if cell[0] <= 0:
                    cell = (0, -1, 0)
                elif equal and cell is take and (best is None or (cell[0], cell[2]) > (best[0], best[3])):
                    best = (cell[0], cell[1], j + 1, cell[2])
            else:
                cell = (0, -1, 0)
            row.append(cell)
            left = cell
        score = [*row, (0, -1, 0)]
    return None if best is None else Match(best[1], best[2], best[3])


class Index:
    """Templates and the inverted index of their fingerprints."""

    def __init__(self, notices: tuple[tuple[str, str], ...], gram: int, guarantee: int):
        self.templates: list[Template] = []
        places: list[tuple[int, int, int]] = []
        for number, (licence, text) in enumerate(notices):
            _, name = words_of(pa.array([text]))
            if len(name) < gram:
                raise ValueError(f"template {number} has fewer than {gram} words")
            self.templates.append(Template(licence, number, name))
            value, at = winnow(name, np.zeros(len(name), np.int64), gram, guarantee)
            places += [(int(v), number, int(p)) for v, p in zip(value, at)]
        self.known = np.unique(np.array([p[0] for p in places], np.uint64))
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for value, number, place in places:
            self.at[value].append((number, place))


def matches(index: Index, name: np.ndarray, hits: list[tuple[int, int]], band: int, least: float) -> list[tuple[Template, Match]]:
    """Matches of one text, of whose words ``hits`` (fingerprint, place; by place) are known to the index.

    Each template goes through its fingerprints from left to right, and each shift that a fingerprint tells is
    aligned unless a match covers its place or the shift has failed.  Of the matches that overlap, whatever their
    templates, the one stays that explains most: matched words times coverage, then the earlier template.
    """
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for value, place in hits:
        for number, at in index.at[value]:
            places[number].append((place, place - at))
    found: list[tuple[float, int, Match]] = []
    for number in sorted(places):
        words = index.templates[number].words
        done, failed = 0, set()
        for place, shift in sorted(places[number]):
            if place < done or shift in failed:
                continue
            stop, ends = len(name), done
            while True:  # to the left of what it finds, as long as the place itself is not covered
                m = _aligned(words, name, max(done, shift - band), min(stop, shift + len(words) + band + 1), shift, band, least)
                if m is None:
                    break
                found.append((m.matched * m.matched / len(words), number, m))
                ends = max(ends, m.end)
                if m.start <= place:
                    break
                stop = m.start
            if ends == done:
                failed.add(shift)
            done = ends
    chosen: list[tuple[int, int, int, Match]] = []
    taken: list[int] = []  # starts of what was chosen, and beside them the ends
    until: list[int] = []
    for _, number, m in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        at = bisect.bisect_left(taken, m.end)
        if at and until[at - 1] > m.start:
            continue
        taken.insert(at, m.start)
        until.insert(at, m.end)
        chosen.append((m.start, m.end, number, m))
    return [(index.templates[number], m) for _, _, number, m in sorted(chosen)]


def _aligned(words: np.ndarray, name: np.ndarray, low: int, high: int, shift: int, band: int, least: float) -> Match | None:
    """Alignment of a template inside ``[low, high)`` of a text, if it covers enough."""
    if len(words) < SHORT_WORDS:
        first, last = max(low, shift), shift + len(words)
        whole = shift >= low and last <= high and bool((name[first:last] == words).all())
        return Match(shift, last, len(words)) if whole else None
    # no alignment matches more words than the two have in common
    if high <= low or np.isin(name[low:high], words).sum() < least * len(words):
        return None
    m = align(words, name[low:high], shift - low, band)
    if m is None or m.matched < least * len(words):
        return None
    return Match(m.start + low, m.end + low, m.matched)


def scan(
    docs: DataFrame, notices: tuple[tuple[str, str], ...] = all_notices(), gram: int = 3, guarantee: int = 4, band: int = 8,
    min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, licence, template, coverage, start_word, end_word, start_byte, end_byte): one row per match.

    ``coverage`` is the share of the template's words that the alignment matches; spans are half open and do not
    overlap: where templates compete for words, the one that explains most of them stays, so the two-clause text
    is not taken for the three-clause one.  Templates below ``SHORT_WORDS`` words must stand word for word.  Null and
    empty texts have none; repeated rows give repeated results; a null id stays null; other columns are ignored.  A
    very long text is scanned by one task, in time that grows with its length.  Nothing is shuffled.
    """
    spec = "doc_id long, licence string, template int, coverage double, start_word int, end_word int, start_byte long, end_byte long"
    schema, index = arrow_schema(spec), Index(notices, gram, guarantee)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in found_in(part)], schema=schema)

    def found_in(batch: pa.RecordBatch) -> Iterator[tuple]:
        words, name = words_of(batch.column(1))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        value, place = winnow(name, doc, gram, guarantee)
        hit = np.isin(value, index.known)
        value, place = value[hit], place[hit]
        owner = doc[place]
        ends = np.flatnonzero(np.diff(owner)) + 1
        ids, offsets = batch.column(0), np.concatenate([[0], np.cumsum([0 if s is None else len(s.encode()) for s in batch.column(1).to_pylist()])]) if len(owner) else None
        for own in np.split(np.arange(len(owner)), ends) if len(owner) else []:
            d = int(owner[own[0]])
            first, last = int(words.first[d]), int(words.first[d + 1])
            hits = list(zip(value[own].tolist(), (place[own] - first).tolist()))
            for template, m in matches(index, name[first:last], hits, band, min_coverage):
                byte = words.start[first + m.start] - offsets[d], words.end[first + m.end - 1] - offsets[d]
                coverage = m.matched / len(template.words)
                yield ids[d].as_py(), template.licence, template.number, coverage, m.start, m.end, int(byte[0]), int(byte[1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(find, spec)
