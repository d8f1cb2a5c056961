"""Exact removal of repeated word windows by recompression.

A text is a string of word names.  A round first names maximal runs of one symbol, then splits the symbols
into two classes by a hash and names every (first class, second class) pair; round by round the string
shrinks to one symbol.  Names are hashes of their parts, so all tasks name alike without exchanging
dictionaries, and equal substrings get equal symbols except near their ends.  How far a symbol depends on
the words around it is carried along with it: inside that stretch it is *certain*, it appears in every other
occurrence of the stretch at the same place.

Three exchanges of packed names do the work.  Documents lie in blocks by hash of their id; the exchange of
their texts is made once and read by all three steps.

1. Every window of ``size`` words picks one anchor, a certain symbol of the highest round there is (named by
   the words it depends on); documents also send their symbols of ``2 * size`` words and more.  Blocks learn
   which anchors lie in more than one document and the smallest document of each long symbol.
2. A long symbol that a smaller document holds covers its words at once: all windows inside are repeats
   (a copied document is covered by the symbol of its whole text).  Windows outside whose anchor is shared, and
   those without a certain symbol, are sent by their names of twice 61 bits to find their smallest document.
3. Words covered by a repeated window go.

Anchors only rule windows out, so their 64 bits cannot make a wrong result; windows and long symbols are
told apart by two names of 61 bits over two independent halves of the words' 128-bit hashes.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .memory import give_back
from .words import PRIME, mix, names128, powers, reduced, running_sums, split, times

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_P61 = np.uint64(PRIME)
_ANCHOR, _LONG, _RANGES, _WINDOW = 0, 1, 2, 3
_PACKED = "bucket long, block long, kind int, data binary"
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
_RANGE = np.dtype([("row", "<i4"), ("start", "<i4"), ("end", "<i4")])


class Symbols(NamedTuple):
    """Symbols of one round: names, the words they span, their texts, and the words they depend on (first rounds only)."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    low: np.ndarray | None
    high: np.ndarray | None


def word_symbols(name: np.ndarray, doc: np.ndarray) -> Symbols:
    at = np.arange(len(name))
    return Symbols(name.copy(), at, at + 1, doc, at, at + 1)


def name_runs(s: Symbols, number: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Maximal runs of one symbol become one symbol; every symbol now depends on its neighbours being others.

    Also gives the first and the last old symbol of each new one.
    """
    n = len(s.name)
    first = np.flatnonzero(np.concatenate([[True], (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])]))
    if len(first) == n and s.low is None:
        return s, first, first
    last = np.concatenate([first[1:], [n]]) - 1
    name, times = s.name[first], last - first + 1
    long = np.flatnonzero(times > 1)
    if len(long):
        salt = np.uint64((0xA0761D6478BD642F + 2 * number) & 0xFFFFFFFFFFFFFFFF)
        name[long] = mix(name[long] * _BASE[0] + times[long].astype(np.uint64) * _BASE[1] + salt)
    low, high = s.low, s.high
    if low is not None:
        low = np.concatenate([[-1], low[:-1]])[first]
        high = np.concatenate([high[1:], [high[-1] + 1]])[last]
    return Symbols(name, s.start[first], s.end[last], s.doc[first], low, high), first, last


def name_pairs(s: Symbols, number: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Neighbours of the first and the second class become one symbol; results as in :func:`name_runs`."""
    salt = np.uint64((0xE7037ED1A0B428DB * (number + 1)) & 0xFFFFFFFFFFFFFFFF)
    second = ((s.name ^ salt) * _BASE[0]).view(np.int64) < 0
    joins = np.concatenate([~second[:-1] & second[1:] & (s.doc[1:] == s.doc[:-1]), [False]])  # with the next one
    head = np.flatnonzero(np.concatenate([[True], ~joins[:-1]]))
    pair = joins[head]
    tail = head + pair
    name = s.name[head]
    left, right = head[pair], tail[pair]
    name[pair] = mix(s.name[left] * _BASE[1] + mix(s.name[right] ^ salt))
    # a single symbol of the first class depends on what follows, one of the second on what precedes
    low, high = s.low, s.high
    if low is not None:
        single_second, single_first = ~pair & second[head], ~pair & ~second[head]
        low = np.where(single_second, np.concatenate([[-1], low[:-1]])[head], low[head])
        high = np.where(single_first, np.concatenate([high[1:], [high[-1] + 1]])[tail], high[tail])
    return Symbols(name, s.start[head], s.end[tail], s.doc[head], low, high), head, tail


class Spans:
    """64-bit names of any stretch of words from prefix sums; for anchors, which only rule windows out."""

    def __init__(self, name: np.ndarray):
        n = len(name)
        base = _BASE[0]
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.full(n + 1, pow(int(base), -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(name * power[:-1], out=self.sums[1:])

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Stretches:
    """Names of any stretch of words that decide: two polynomials modulo 2**61 - 1 over the halves of the words' names.

    Polynomials modulo a power of two, as the anchors have them, give some unequal stretches equal values
    whatever the base (those in Thue-Morse order); modulo a prime with a base of its own nothing of the kind is known.
    """

    _BASES = (0x1B873593CC9E2D51 % PRIME, 0x0F58FE1D5A3C9B27 % PRIME)

    def __init__(self, halves: tuple[np.ndarray, np.ndarray]):
        self.halves = halves
        self.ready: list[tuple[np.ndarray, np.ndarray] | None] = [None, None]

    def _sums(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums and powers of the inverse; a half that is never asked for is never summed."""
        if self.ready[which] is None:
            base, half = self._BASES[which], self.halves[which]
            sums = running_sums(times(reduced(half), powers(base, len(half))))
            self.ready[which] = sums, powers(pow(base, -1, PRIME), len(half) + 1)
        return self.ready[which]

    def name(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Mixed with the length; ``which`` half of the name, 61 bits of it each."""
        sums, inverse = self._sums(which)
        value = times(reduced(sums[end] + (_P61 - sums[start])), inverse[start])
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors_of_windows(rounds: list[Symbols], window: np.ndarray, size: int, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, found) of the windows that start at the words ``window``.

    The anchor is the least-named certain symbol of the highest round that has one in the window; this
    depends on the words of the window alone.
    """
    anchor, found = np.zeros(len(window), np.uint64), np.zeros(len(window), bool)
    words = len(spans.sums) - 1
    for s in reversed(rounds):
        fits = s.high - s.low <= size
        low, high = s.low[fits], s.high[fits]
        rest = np.flatnonzero(~found)  # windows without a symbol of a higher round
        if not len(low) or not len(rest):
            continue
        name = spans.name(np.maximum(low, 0), np.minimum(high, words))
        # for every word: how many stretches begin before it, and how many have ended there
        begun = np.cumsum(np.bincount(low + 1, minlength=words + 2))
        ended = np.cumsum(np.bincount(high, minlength=words + 2))
        first, past = begun[window[rest]], ended[window[rest] + size]
        some = past > first
        rest, first, count = rest[some], first[some], (past - first)[some]
        best, step, at = name[first], 1, np.flatnonzero(count > 1)
        while len(at):
            best[at] = np.minimum(best[at], name[first[at] + step])
            step += 1
            at = at[count[at] > step]
        anchor[rest] = best
        found[rest] = True
    return anchor, found


class Block:
    """The documents of one block: their words, windows, rounds and names."""

    def __init__(self, table: pa.Table, size: int, anchor_rounds: int = 2):
        self.table = table.sort_by([("doc_id", "ascending"), ("__text_hash", "ascending")])
        self.size = size
        self.words = split(self.table.column("__text"))
        counts = np.diff(self.words.first)
        self.row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        ids = self.table.column("doc_id")
        known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        halves = names128(self.words)
        self.name = halves[0]
        self.spans = Spans(self.name)
        self.stretches = Stretches(halves)
        at = np.arange(max(0, len(self.name) - size + 1))
        same = self.row[at] == self.row[at + size - 1] if len(at) else np.zeros(0, bool)
        self.window = at[same & known[self.row[at]]] if len(at) else at
        self.known = known
        self.anchor_rounds = anchor_rounds

    def rounds(self, on_anchor_round, on_round) -> None:
        """All rounds until each text is one symbol or nothing changes any more."""
        if not len(self.name):
            return
        s, number = word_symbols(self.name, self.row), 0
        while True:
            runs, first, last = name_runs(s, number)
            on_round(s, runs, first, last)
            pairs, first, last = name_pairs(runs, number)
            on_round(runs, pairs, first, last)
            if number < self.anchor_rounds:
                on_anchor_round(runs)
                on_anchor_round(pairs)
            number += 1
            if len(pairs.name) == len(s.name) and number > 40 or len(pairs.name) == 1 + np.count_nonzero(np.diff(pairs.doc)):
                return
            s = pairs if number < self.anchor_rounds else pairs._replace(low=None, high=None)

    def analyse(self) -> tuple[list[Symbols], np.ndarray, np.ndarray, np.ndarray]:
        """(anchor rounds, and start, end and name of the long symbols): a symbol counts when it first reaches
        ``2 * size`` words, eight times that and so on, or is a whole text."""
        kept: list[Symbols] = []
        long: list[np.ndarray] = []
        least = 2 * self.size
        first, last = self.words.first[:-1], self.words.first[1:]

        def grown(before: Symbols, after: Symbols, left: np.ndarray, right: np.ndarray) -> None:
            fresh = np.flatnonzero(right > left)
            fresh = fresh[after.end[fresh] - after.start[fresh] >= self.size]
            if not len(fresh):
                return
            start, end, doc = after.start[fresh], after.end[fresh], after.doc[fresh]
            left, right, span = left[fresh], right[fresh], end - start
            # the parts of a run are alike, a pair has two
            widest = np.maximum(before.end[left] - before.start[left], before.end[right] - before.start[right])
            whole = (start == first[doc]) & (end == last[doc])
            tier = lambda x: np.floor(np.log(np.maximum(x, 1) / least) / math.log(8))
            step = (span >= least) & ((widest < least) | (tier(span) > tier(widest)))
            long.append(np.stack([start, end])[:, (whole | step) & self.known[doc]])

        self.rounds(kept.append, grown)
        start, end = np.concatenate(long, axis=1) if long else np.zeros((2, 0), np.int64)
        return kept, start, end, self.stretches.name(start, end)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> bytes:
        """Stretches of words as (row, start, end) inside their texts."""
        out = np.zeros(len(start), _RANGE)
        out["row"] = self.row[start] if len(start) else 0
        out["start"] = start - self.words.first[out["row"]]
        out["end"] = end - self.words.first[out["row"]]
        return out.tobytes()


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` places lies in a stretch."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def least_per_name(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distinct (a, b) with the smallest document of each."""
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    out = np.zeros(int(first.sum()), _ENTRY)
    out["a"], out["b"], out["doc"] = a[first], b[first], doc[first]
    return out


def packed(block: int, kind: int, rows: np.ndarray, key: np.ndarray, buckets: int) -> list[tuple]:
    """Rows dealt out to buckets by ``key``."""
    if not len(rows):
        return []
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    firsts = bucket[np.concatenate([[0], cuts])].tolist()
    return [(f, block, kind, part.tobytes()) for f, part in zip(firsts, np.split(rows, cuts))]


def as_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "block", "kind", "data"])


def received(table: pa.Table, kind: int, dtype) -> np.ndarray:
    data = table.column("data").filter(pa.array(table.column("kind").to_numpy() == kind)).to_pylist()
    return np.frombuffer(b"".join(data), dtype)


def gathered(table: pa.Table, kind: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a kind in a bucket, and the block each came from."""
    own = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    parts = [np.frombuffer(d, dtype) for d in own.column("data").to_pylist()]
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(own.column("block").to_numpy(), [len(p) for p in parts])


def replies(bucket: int, kind: int, rows: np.ndarray, block: np.ndarray) -> list[tuple]:
    order = np.argsort(block, kind="stable")
    rows, block = rows[order], block[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    if not len(rows):
        return []
    firsts = block[np.concatenate([[0], cuts])].tolist()
    return [(bucket, f, kind, part.tobytes()) for f, part in zip(firsts, np.split(rows, cuts))]


def smaller_elsewhere(rows: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose name a smaller document of another block holds, with that document, and their blocks."""
    order = np.lexsort((rows["doc"], rows["b"], rows["a"]))
    rows, block = rows[order], block[order]
    if not len(rows):
        return rows, block
    fresh = np.concatenate([[True], (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])])
    least = rows["doc"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    later = rows["doc"] > least
    out = rows[later].copy()
    out["doc"] = least[later]
    return out, block[later]


def find_entries(a: np.ndarray, b: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the names (a, b) that are among ``entries``, and the document given there."""
    if not len(entries) or not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    entries = entries[np.argsort(entries["a"], kind="stable")]
    at = np.searchsorted(entries["a"], a)
    at[at == len(entries)] = 0
    hit = np.flatnonzero(entries["a"][at] == a)
    good = entries["b"][at[hit]] == b[hit]
    return hit[good], entries["doc"][at[hit[good]]]


def dedup(
    docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    block_bytes: int = 7 << 18, bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, *carry, n_words, n_removed, kept_text), one row per row of ``docs``.

    Words are what lies between the bytes 0x20 and 0x09 to 0x0D.  A word goes when a window of ``size`` words
    over it also starts in a document of smaller id; windows are judged on the input.  Null texts have no
    words.  Texts shorter than a window lose nothing.  Rows without id neither lose words nor take any from
    others; rows of one id are one document to this rule.  ``kept_text`` joins the kept words by one space.
    Columns of ``carry`` come along under their names, all others are ignored; the names of the result are not to
    be carried.

    Documents are dealt by hash of id and text to blocks of about ``block_bytes`` of text, names to buckets for
    about ``bucket_bytes`` of it, so neither grows with the table and an id that repeats is spread by its texts.
    A very long text is worked on by one task, which holds some ten times its bytes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size_all = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(size_all / bucket_bytes))
    blocks = max(2 * partitions, math.ceil(size_all / block_bytes))
    own_hash = F.xxhash64(text)
    spread = F.xxhash64(F.col(id_col).cast("long"), own_hash)
    # a text that comes along is the one that is worked on, null or not; it travels once
    rows = docs.select(
        F.pmod(spread, F.lit(blocks)).alias("block"), F.col(id_col).cast("long").alias("doc_id"), own_hash.alias("__text_hash"),
        text.alias("__text"), *[F.col(c).isNull().alias("__no_text") if c == text_col else F.col(c).alias(f"__carry_{c}") for c in carry],
    )
    by_block = rows.groupBy("block")

    def name_symbols(table: pa.Table) -> pa.Table:
        number = int(table.column("block")[0].as_py())
        block = Block(table, size)
        kept, start, end, name = block.analyse()
        anchor, found = anchors_of_windows(kept, block.window, size, block.spans)
        anchor, doc = anchor[found] >> np.uint64(1), block.ids[block.row[block.window[found]]]
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
        firsts = np.flatnonzero(fresh)
        lasts = np.concatenate([firsts[1:], [len(anchor)]])[: len(firsts)] - 1
        several = (doc[firsts] != doc[lasts]).astype(np.uint64)
        sent = (anchor[firsts] << np.uint64(1)) | several  # the last bit: more than one document here
        long = least_per_name(name, block.stretches.name(start, end, 1), block.ids[block.row[start]])
        return as_table(packed(number, _ANCHOR, sent, anchor[firsts], buckets) + packed(number, _LONG, long, long["a"], buckets))

    def share(table: pa.Table) -> pa.Table:
        bucket = int(table.column("bucket")[0].as_py())
        sent, block = gathered(table, _ANCHOR, np.uint64)
        order = np.argsort(sent, kind="stable")
        sent, block = sent[order], block[order]
        anchor = sent >> np.uint64(1)
        next_same = np.concatenate([anchor[1:] == anchor[:-1], [False]]) if len(anchor) else np.zeros(0, bool)
        same = next_same | np.concatenate([[False], next_same[:-1]]) if len(anchor) else next_same
        shared = same | ((sent & np.uint64(1)) == 1)
        out = replies(bucket, _ANCHOR, anchor[shared], block[shared])
        return as_table(out + replies(bucket, _LONG, *smaller_elsewhere(*gathered(table, _LONG, _ENTRY))))

    def name_windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return as_table([])
        number = int(left.column("block")[0].as_py())
        block = Block(left, size)
        kept, start, end, name = block.analyse()
        # long symbols of smaller documents, in other blocks or in this one
        second, doc = block.stretches.name(start, end, 1), block.ids[block.row[start]]
        known = np.concatenate([received(right, _LONG, _ENTRY), least_per_name(name, second, doc)])
        known = least_per_name(known["a"], known["b"], known["doc"])
        hit, least = find_entries(name, second, known)
        repeat = hit[doc[hit] > least]
        start, end = start[repeat], end[repeat]
        # windows inside a repeated symbol are done
        inside = covered(len(block.name), start, np.maximum(start, end - size + 1))
        window = block.window[~inside[block.window]]
        anchor, found = anchors_of_windows(kept, window, size, block.spans)
        shared = np.sort(received(right, _ANCHOR, np.uint64))
        anchor >>= np.uint64(1)
        at = np.searchsorted(shared, anchor)
        at[at == len(shared)] = 0
        open_windows = window[~found | ((shared[at] == anchor) if len(shared) else False)]
        a, b = (block.stretches.name(open_windows, open_windows + size, w) for w in (0, 1))
        doc = block.ids[block.row[open_windows]]
        entries = least_per_name(a, b, doc)
        hit, least = find_entries(a, b, entries)
        here = open_windows[hit[doc[hit] > least]]
        done = [(number % buckets, number, _RANGES, block.ranges(np.concatenate([start, here]), np.concatenate([end, here + size])))]
        return as_table(done + packed(number, _WINDOW, entries, entries["a"], buckets))

    def resolve(table: pa.Table) -> pa.Table:
        bucket = int(table.column("bucket")[0].as_py())
        passed = table.filter(pa.array(table.column("kind").to_numpy() == _RANGES)).select(["bucket", "block", "kind", "data"])
        found = replies(bucket, _WINDOW, *smaller_elsewhere(*gathered(table, _WINDOW, _ENTRY)))
        return pa.concat_tables([passed.cast(as_table([]).schema), as_table(found)])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    result = ", ".join(["`doc_id` bigint", *[f"`__carry_{c}` {fields[c]}" for c in carry], "n_words long", "n_removed long", "kept_text string"])

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, size)
        first = block.words.first
        done = received(right, _RANGES, _RANGE)
        base = first[done["row"]]
        start, end = base + done["start"], base + done["end"]
        entries = received(right, _WINDOW, _ENTRY)
        if len(entries):
            a = block.stretches.name(block.window, block.window + size)
            # a bitmap of the high bits leaves few windows to look up
            seen = np.zeros(1 << 22, bool)
            seen[entries["a"] >> np.uint64(42)] = True
            near = seen[a >> np.uint64(42)]
            window, a = block.window[near], a[near]
            hit, least = find_entries(a, block.stretches.name(window, window + size, 1), entries)
            window = window[hit[block.ids[block.row[window[hit]]] > least]]
            start, end = np.concatenate([start, window]), np.concatenate([end, window + size])
        gone = covered(len(block.name), start, end)
        running = np.concatenate([[0], np.cumsum(gone)])
        removed = running[first[1:]] - running[first[:-1]]
        out = block.table.select(["doc_id"])
        for c in carry:
            out = out.append_column(f"__carry_{c}", given_texts(block) if c == text_col else block.table.column(f"__carry_{c}"))
        out = out.append_column("n_words", pa.array(np.diff(first), pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
        return out.append_column("kept_text", kept_texts(block, ~gone))

    sent = by_block.applyInArrow(lambda table: _then_give_back(name_symbols(table)), _PACKED)
    answered = sent.groupBy("bucket").applyInArrow(lambda table: _then_give_back(share(table)), _PACKED)
    asked = by_block.cogroup(answered.groupBy("block")).applyInArrow(lambda key, a, b: _then_give_back(name_windows(key, a, b)), _PACKED)
    resolved = asked.groupBy("bucket").applyInArrow(lambda table: _then_give_back(resolve(table)), _PACKED)
    final = by_block.cogroup(resolved.groupBy("block")).applyInArrow(lambda key, a, b: _then_give_back(remove(key, a, b)), result)
    return final.select("doc_id", *[F.col(f"__carry_{c}").alias(c) for c in carry if c != "doc_id"], "n_words", "n_removed", "kept_text")


def _then_give_back(table: pa.Table) -> pa.Table:
    give_back()
    return table


def given_texts(block: Block) -> pa.ChunkedArray:
    """The texts as they came, null ones too."""
    texts, none = block.table.column("__text"), block.table.column("__no_text")
    return pc.if_else(none, pa.scalar(None, texts.type), texts) if pc.any(none).as_py() else texts


def kept_texts(block: Block, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    words = block.words
    start, size = words.start[kept], (words.end - words.start)[kept]
    counts = np.add.reduceat(np.concatenate([kept, [False]]).astype(np.int64), np.minimum(words.first[:-1], len(kept)))
    counts[words.first[1:] == words.first[:-1]] = 0
    to = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    total = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    place = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[place] = words.data[total]
    ends = np.concatenate([to, [len(out)]])
    last = np.cumsum(counts)
    data, texts = out.tobytes(), []
    for a, b in zip((last - counts).tolist(), last.tolist()):
        texts.append(data[ends[a] : ends[b] - 1].decode() if b > a else "")
    return pa.array(texts, pa.string())
