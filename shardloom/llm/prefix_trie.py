"""The prefix trie of conversations by van Emde Boas recursion.

Depths 0 to 2**K - 1 are cut at half: the turns up to the cut are one long letter, and conversations with equal
letters share a cut node, which is the root of a forest of half the height.  The trie above and all forests
below are cut the same way, all problems of one height in one round of joins, so K rounds name every node.  A
node is named by its depth and the smallest conversation that passes through it.  Totals are put together in
rounds of growing height: what a lower forest holds is grafted onto the nodes between its root and the root of
the problem that was cut there.

Only names, digests and counts travel; texts are digested where they are read.  Every round writes its table,
so no plan holds more than one round and a lost executor costs one round's tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, scratch_path
from .chunking import arrow_schema

#: Letters of 2**6 turns are digests of at most so many digests, so no group grows with a conversation.
_FAN = 6


def _digest(parts: list[Column]) -> Column:
    """SHA-256 of a list of texts, each behind its length."""
    told = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]
    return F.unhex(F.sha2(F.concat(*told), 256))


class Parts:
    """A table that grows by parts, each written whole; any number of parts is read in one scan."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema, self.folder, self.paths = df.sparkSession, df.schema, scratch_path(df.sparkSession, name), []
        self.add(df)

    def add(self, df: DataFrame) -> None:
        self.paths.append(f"{self.folder}/part-{len(self.paths)}")
        df.select(self.schema.fieldNames()).write.parquet(self.paths[-1])

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_bytes): the turns of each conversation in order, ``pos`` from 0.

    Equal rows are counted before they are put in order.  The order is a range partitioning, so a conversation
    with most of the rows is spread over as many tasks as any other stretch of rows; what stands in the
    partitions before is added from a table of counts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _digest([role, text]).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    rows = rows.groupBy("conv_id", "turn", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"))
    ranged = rows.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "trie-turns")
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "digest").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "part").agg(F.sum("copies").alias("n"))
    counts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = ranged.withColumn("at", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(counts, ["conv_id", "part"])
    first = F.col("offset") + F.col("at")
    return placed.select(
        "conv_id", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("pos"), "digest", "n_bytes"
    )


def rebuild(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, depth) and their rebuilt turns (conv_id, pos, digest, n_bytes).

    A conversation c begins with the first h turns of conversation ``c - c % group``, where
    h is the CRC-32 of c in decimal modulo ``heads``; its own turns follow from the h-th on.
    """
    turns = materialise(numbered_turns(turns), "trie-numbered")
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    sizes = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    sizes = sizes.withColumn("h", head).withColumn("source", F.expr(f"conv_id - conv_id % {group}"))
    known = sizes.select(F.col("conv_id").alias("source"), F.col("n").alias("source_n"))
    taken = F.least("h", F.coalesce("source_n", F.lit(0)))
    convs = sizes.join(known, "source", "left").withColumn("taken", taken.cast("long"))
    convs = convs.select(
        "conv_id", "source", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")
    )
    convs = materialise(convs, "trie-conversations")
    # At most heads - 1 turns of a source meet the few conversations that begin with it.
    first = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "source")
    begun = first.join(convs.select("conv_id", "source", "taken"), "source").where("pos < taken")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "digest", "n_bytes"]
    rebuilt = begun.select(*columns).unionByName(own.select(*columns))
    return convs.select("conv_id", "depth"), materialise(rebuilt, "trie-rebuilt")


def _letters(turns: DataFrame, height: int) -> list[DataFrame]:
    """Element j has (conv_id, block, letter) of blocks of 2**(6 j) turns: digests of the digests in order."""
    out = [turns.select("conv_id", F.col("pos").alias("block"), F.col("digest").alias("letter"))]
    for _ in range(_FAN, height, _FAN):
        out.append(materialise(_joined(out[-1], _FAN), "trie-letters"))
    return out


def _joined(letters: DataFrame, height: int) -> DataFrame:
    """Letters of blocks of 2**height blocks; an incomplete one at a conversation's end is not asked for."""
    if height == 0:
        return letters
    own = F.sort_array(F.collect_list(F.struct("block", "letter")))
    wide = F.unhex(F.sha2(F.array_join(F.transform(own, lambda x: F.hex(x["letter"])), ""), 256))
    return letters.groupBy("conv_id", F.shiftright("block", height).alias("wide")).agg(wide.alias("letter")).withColumnRenamed("wide", "block")


def name_nodes(convs: DataFrame, turns: DataFrame, height: int, root: int | None) -> DataFrame:
    """(conv_id, depth, name): the smallest conversation that shares the first ``depth`` turns with ``conv_id``.

    ``root`` is the smallest conversation of all.
    """
    at_root = [F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("name")]
    named = Parts(convs.select("conv_id", *at_root), "trie-names")
    letters = _letters(turns, height)
    for k in reversed(range(height)):
        half, base = 1 << k, k // _FAN
        # The upper half of each problem of height 2**(k + 1), where the conversation reaches the cut.
        whole = letters[base].join(convs, "conv_id").where(
            f"shiftright(block, {k % _FAN}) % 2 = 0 and ((shiftright(block, {k % _FAN}) + 1) * {half}) <= depth"
        )
        cut = _joined(whole.select("conv_id", "block", "letter"), k % _FAN).select(
            "conv_id", (F.col("block") * half).alias("depth"), "letter"
        )
        above = named.read().where(F.col("depth") % (2 * half) == 0)
        asked = cut.join(above, ["conv_id", "depth"])
        same = asked.groupBy("depth", "name", "letter").agg(F.min("conv_id").alias("below"), F.count(F.lit(1)).alias("n"))
        # A prefix of one conversation is named by it.  The others are written, so that the join with a prefix that
        # very many share is one of two plain exchanges, which adaptive execution splits.
        shared = materialise(same.where("n > 1").drop("n"), "trie-shared")
        level = asked.join(shared, ["depth", "name", "letter"], "left")
        level = level.select("conv_id", (F.col("depth") + half).alias("depth"), F.coalesce("below", "conv_id").alias("name"))
        named.add(level)
    return named.read()


def _graft(named: DataFrame, own: DataFrame, height: int, columns: list[str]) -> DataFrame:
    """(depth, name, *columns): sums over the subtree of each node, itself included."""
    grafts = Parts(own.select("depth", "name", *columns), "trie-totals")
    for k in range(height):
        half = 1 << k
        cuts = grafts.read().where(F.col("depth") % (2 * half) == half)
        lower = cuts.groupBy("depth", "name").agg(*[F.sum(c).alias(c) for c in columns])
        lower = lower.select(F.col("name").alias("conv_id"), F.expr(f"depth div {2 * half}").alias("problem"), *columns)
        # The way up from a cut node is that of the conversation it is named by.
        way = named.where(F.col("depth") % (2 * half) < half).withColumn("problem", F.expr(f"depth div {2 * half}"))
        onto = way.join(lower, ["conv_id", "problem"]).groupBy("depth", "name").agg(*[F.sum(c).alias(c) for c in columns])
        grafts.add(onto)
    return grafts.read().groupBy("depth", "name").agg(*[F.sum(c).alias(c) for c in columns])


def _ends(convs: DataFrame, named: DataFrame) -> DataFrame:
    """(depth, name, n_ends, ends_sha256) of the nodes where a conversation ends: ids in order, joined by commas.

    The ids are sorted by range, so those of one node may lie in many tasks, and joined to stretches there.  A
    digest has to be taken in order; the task of a node streams its stretches through it, however many they are.
    """
    stretch = "depth long, name long, first long, n long, ids binary"
    spec = "depth long, name long, n_ends long, ends_sha256 string"
    schemas = arrow_schema(stretch), arrow_schema(spec)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, name, conv = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((np.diff(depth) != 0) | (np.diff(name) != 0)) + 1
            lines = [
                (int(depth[a]), int(name[a]), int(conv[a]), int(z - a), ",".join(map(str, conv[a:z].tolist())).encode())
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv)]) if z > a
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(schemas[0].names, x)) for x in lines], schema=schemas[0])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, count, done = None, None, 0, []
        for batch in batches:
            for depth, name, _, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, name) != current:
                    if current is not None:
                        done.append((*current, count, state.hexdigest()))
                    current, state, count = (depth, name), hashlib.sha256(), 0
                state.update(b"," + ids if count else ids)
                count += n
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schemas[1].names, d)) for d in done], schema=schemas[1])
                done = []
        if current is not None:
            done.append((*current, count, state.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(schemas[1].names, d)) for d in done], schema=schemas[1])

    last = convs.join(named, ["conv_id", "depth"]).select("depth", "name", "conv_id")
    ranged = last.repartitionByRange("depth", "name", "conv_id").sortWithinPartitions("depth", "name", "conv_id")
    stretches = ranged.mapInArrow(join, stretch)
    return stretches.repartition("depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(digest, spec)


def prefix_trie(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see :func:`rebuild`).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256): a node is a
    distinct sequence of ``depth`` turns, conv_id the smallest conversation that starts with it, n_leaves and
    saved_tokens are taken over its subtree; a token is a UTF-8 byte of the node's last text, saved by every
    conversation but the first.

    ``turns`` has conv_id, turn, role, text; other columns are ignored, whatever their names.  Turns go by
    number, a null number first; equal numbers by the digest of role and text; repeated rows are turns like any
    other; null role and text are empty.  Rows without conv_id belong to no conversation.  An empty table has
    no node, not even a root.
    """
    convs, rebuilt = rebuild(turns, group, heads)
    deepest, root = convs.agg(F.max("depth"), F.min("conv_id")).first()
    height = (deepest or 0).bit_length()
    named = name_nodes(convs, rebuilt, height, root)
    members = named.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("n_convs"))
    # The conversation that a node is named by tells its parent and its last turn.
    by = named.where("conv_id = name").select("conv_id", "depth")
    parents = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_conv_id"))
    texts = rebuilt.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes")
    nodes = by.join(parents, ["conv_id", "depth"], "left").join(texts, ["conv_id", "depth"], "left")
    nodes = nodes.withColumnRenamed("conv_id", "name").join(members, ["depth", "name"])
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    own = nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = materialise(
        own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn(
            "saved_tokens", (F.col("n_convs") - 1) * F.coalesce("n_bytes", F.lit(0).cast("long"))
        ),
        "trie-own",
    )
    totals = _graft(named, own, height, ["n_leaves", "saved_tokens"])
    out = own.drop("n_leaves", "saved_tokens", "n_bytes").join(totals, ["depth", "name"])
    out = out.join(_ends(convs, named), ["depth", "name"], "left")
    return out.select(
        F.col("name").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("n_ends", F.lit(0).cast("long")).alias("n_ends"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
