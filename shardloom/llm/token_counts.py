"""Token counts by a compiled finite-state transducer of a piece vocabulary with score-ordered merges.

The merge tokenizer is compiled into a deterministic transducer over characters.  Its theory: a sequence of
pieces is what the merges give exactly when every two neighbours are, so the last piece of each prefix is
fixed by the prefix, and a piece may follow another or not.  A state holds, for every position from which a
piece may still grow, the place in the piece trie, the piece before that position, and how many tokens
lie between; a transition adds the (possibly negative) change of the token count.  States and transitions
are compiled when first met.  A character outside the vocabulary costs its UTF-8 bytes and resets the
state, and so does a space after a non-space, because no piece holds a space in its inside.

A chunk of a text is a state map: what it does from any entry state is fixed by its ``head`` (the unfinished
unit up to its first reset), the tokens between its first and last reset, and its ``tail`` (the open unit,
which names the exit state).  Maps compose associatively; a prefix scan over the chunks gives the count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from .chunking import arrow_schema, pieces, plain, repeated, short_texts

SPACE = "▁"  # the vocabulary writes spaces so; the sign itself in a text is the same to it


class Transducer:
    """Lazily compiled transducer of one vocabulary; ``max_states`` bounds the memory, beyond it it starts anew."""

    def __init__(self, model_file: str, max_states: int = 200_000, max_units: int = 200_000):
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as file:
            model.ParseFromString(file.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        plain_text = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix
        if not plain_text or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisation with a leading space mark is compiled")
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("only BPE vocabularies with byte fallback are compiled")
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == p.NORMAL}
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
            raise ValueError("user-defined or unused pieces are not compiled")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space in its inside")
        if any(c not in self.rank for c in set("".join(self.rank))):
            raise ValueError("a piece holds a character that is no piece itself")
        self.child: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for piece in self.rank:
            node = 0
            for char in piece:
                if char not in self.child[node]:
                    self.child[node][char] = len(self.child)
                    self.child.append({})
                    self.piece.append(None)
                node = self.child[node][char]
            self.piece[node] = piece
        self.max_states, self.max_units = max_states, max_units
        self.follows: dict[tuple[str | None, str], bool] = {}
        self.units: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, None, 0),)
        self.number = {start: 0}
        self.state = [start]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The merges by their definition: best-ranked neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _may_follow(self, before: str | None, piece: str) -> bool:
        known = self.follows.get((before, piece))
        if known is None:
            if len(self.follows) >= 2 * self.max_states:
                self.follows.clear()
            expected = [piece] if before is None else [before, piece]
            known = self.follows[before, piece] = self.merged("".join(expected)) == expected
        return known

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of ``state`` under ``char``: (next state, emitted tokens)."""
        if char not in self.child[0]:
            move = 0, len(char.encode())
        else:
            growing, last, count = [], None, 0
            for node, before, offset in self.state[state]:
                node = self.child[node].get(char)
                if node is None:
                    continue
                piece = self.piece[node]
                if piece is not None and last is None and self._may_follow(before, piece):
                    last, count = piece, offset + 1
                if self.child[node]:
                    growing.append((node, before, offset))
            assert last is not None, "every prefix has one last piece"
            target = (*((n, b, o - count) for n, b, o in growing), (0, last, 0))
            number = self.number.get(target)
            if number is None:
                number = self.number[target] = len(self.state)
                self.state.append(target)
                self.moves.append({})
            move = number, count
        self.moves[state][char] = move
        return move

    def run(self, unit: str) -> int:
        """Tokens of a unit from the start state."""
        known = self.units.get(unit)
        if known is not None:
            return known
        if len(self.state) > self.max_states:
            self._reset()
        state, total, moves = 0, 0, self.moves
        for char in unit:
            move = moves[state].get(char)
            if move is None:
                move = self._compile(state, char)
            state = move[0]
            total += move[1]
        if len(unit) <= 64:
            if len(self.units) >= self.max_units:
                self.units.clear()
            self.units[unit] = total
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        state_map = chunk_map(" " + text, self)
        return self.run(state_map.head) if state_map.open else self.run(state_map.head) + state_map.inner + self.run(state_map.tail)


class ChunkMap(NamedTuple):
    """State map of a chunk: without a reset inside (``open``) ``head`` is all of it and ``tail`` is empty."""

    head: str
    inner: int
    tail: str
    open: bool


def chunk_map(text: str, transducer: Transducer) -> ChunkMap:
    """The state map of a chunk of text (spaces not yet escaped)."""
    text = text.replace(" ", SPACE)
    parts = text.split(SPACE)
    units: list[str] = []
    if "" in parts[1:-1] or parts[-1] == "":
        # runs of spaces: a run belongs to the unit it leads
        marks = ""
        for i, part in enumerate(parts):
            if i:
                marks += SPACE
            if part or (i == len(parts) - 1 and marks):
                units.append(marks + part)
                marks = ""
            elif i == 0:
                units.append("")
    else:
        units = [parts[0], *(SPACE + p for p in parts[1:])]
    # the first unit continues whatever came before; a chunk that starts with a space still may
    # continue a run of spaces, so its first marked unit is part of the head
    head = units[0] if units[0] or len(units) == 1 else units[0] + units[1]
    rest = units[1:] if units[0] or len(units) == 1 else units[2:]
    if not rest:
        return ChunkMap(head, 0, "", True)
    run = transducer.run
    return ChunkMap(head, sum(map(run, rest[:-1])), rest[-1], False)


def compose(a: ChunkMap, b: ChunkMap, transducer: Transducer) -> ChunkMap:
    """The map of a chunk followed by another: the open unit of ``a`` runs on into the head of ``b``."""
    seam = chunk_map((a.head if a.open else a.tail) + b.head, transducer)
    first = seam if a.open else ChunkMap(a.head, a.inner + (0 if seam.open else transducer.run(seam.head) + seam.inner), seam.head if seam.open else seam.tail, False)
    if b.open:
        return first
    last = first.head if first.open else first.tail
    inner = b.inner + (0 if first.open else first.inner + transducer.run(last))
    return ChunkMap(first.head, inner, b.tail, False)


@functools.lru_cache(maxsize=1)
def compiled(model_file: str) -> Transducer:
    return Transducer(model_file)


def count_tokens(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 16
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of ``docs``; bytes are those of UTF-8.

    Null and empty texts have no tokens.  Repeated rows give repeated results, a null id stays null, other
    columns are not looked at.  ``model_file`` must exist on the executors.
    """
    rows = plain(docs, id_col, text_col)
    spec = "doc_id long, n_bytes long, n_tokens long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model_file)
        for batch in batches:
            counts = [transducer.count(t) for t in batch.column(1).to_pylist()]
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    short = short_texts(rows, chunk_chars).mapInArrow(whole, spec)
    maps = "__row string, doc_id long, copies long, chunk_no int, n_bytes long, head string, inner long, tail string, open boolean"

    def map_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, schema = compiled(model_file), arrow_schema(maps)
        for batch in batches:
            data = batch.to_pydict()
            first = [" " if n == 0 else "" for n in data["chunk_no"]]
            found = [chunk_map(f + p, transducer) for f, p in zip(first, data["piece"])]
            out = {k: data[k] for k in ("__row", "doc_id", "copies", "chunk_no")}
            out["n_bytes"] = [len(p.encode()) for p in data["piece"]]
            out |= dict(zip(ChunkMap._fields, map(list, zip(*found)))) if found else {k: [] for k in ChunkMap._fields}
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    dealt = pieces(rows, chunk_chars).select("__row", "doc_id", "copies", "chunk_no", "piece").mapInArrow(map_pieces, maps)
    of_text = dealt.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("copies").alias("copies"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.struct("chunk_no", *ChunkMap._fields))).alias("maps"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model_file)
        for batch in batches:
            counts = []
            for own in batch.column(3).to_pylist():
                chunks = [ChunkMap(*(m[k] for k in ChunkMap._fields)) for m in own]
                total = functools.reduce(lambda a, b: compose(a, b, transducer), chunks)
                counts.append(transducer.run(total.head) + total.inner + transducer.run(total.tail))
            columns = [*batch.columns[:3], pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copies", "n_bytes", "n_tokens"])

    long = of_text.select("doc_id", "copies", "n_bytes", "maps").mapInArrow(
        scan, "doc_id long, copies long, n_bytes long, n_tokens long"
    )
    return short.unionByName(repeated(long, "doc_id", "n_bytes", "n_tokens"))
