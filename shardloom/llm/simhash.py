"""SimHash near duplicates with a hierarchical index in Gray order.

Distinct fingerprints are sorted by their rank in the Gray code and cut into blocks.  Fingerprints that lie
together share bits; a node keeps the bits its whole group shares (mask and value), less those of the nodes
above it.  A search walks down and adds up differing bits: once the sum passes the limit, the group is
pruned as a whole.  The upper nodes (one pattern a block, of bounded number) decide which blocks a
fingerprint is sent to; inside a block the walk goes on to single fingerprints.  A block gives back a
spanning forest of its links, not its pairs, so a dense group of near copies stays small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .components import connected_components
from .memory import give_back

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LINE = 1 << 15  # bits in one line of a bitmap


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: majority bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(sizes) - sizes
    last = np.minimum(np.arange(n) + shingle, len(words)) - 1
    bounds = zip(start[:n].tolist(), (start[last] + sizes[last] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in bounds), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")
            give_back()

    return of(text)


def gray_key(value: Column) -> Column:
    """Rank of a 64-bit value in the Gray code, as a signed number of the same order."""
    for step in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, step))
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def gray_rank(values: np.ndarray) -> np.ndarray:
    rank = values.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def shared_bits(all_and: np.ndarray, all_or: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """AND and OR of consecutive groups."""
    at = np.arange(0, len(all_and), group)
    return np.bitwise_and.reduceat(all_and, at), np.bitwise_or.reduceat(all_or, at)


def levels(all_and: np.ndarray, all_or: np.ndarray, fan_out: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(residual mask, value) of each level, top first; a node's mask lacks the bits of its ancestors."""
    stack = [(all_and, all_or)]
    while len(stack[-1][0]) > fan_out:
        stack.append(shared_bits(*stack[-1], fan_out))
    out, above = [], None
    for both, either in reversed(stack):
        mask = ~(both ^ either)
        fresh = mask if above is None else mask & ~np.repeat(above, fan_out)[: len(mask)]
        out.append((fresh, both))
        above = mask
    return out


def walk(queries: np.ndarray, tree: list[tuple[np.ndarray, np.ndarray]], fan_out: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, node of the lowest level) for all nodes whose accumulated differences stay within the limit."""
    q = np.repeat(np.arange(len(queries)), len(tree[0][0]))
    node = np.tile(np.arange(len(tree[0][0])), len(queries))
    seen = np.zeros(len(q), np.int64)
    for depth, (mask, value) in enumerate(tree):
        if depth:
            q, seen = np.repeat(q, fan_out), np.repeat(seen, fan_out)
            node = (node[:, None] * fan_out + np.arange(fan_out)[None, :]).ravel()
            real = node < len(mask)
            q, seen, node = q[real], seen[real], node[real]
        seen = seen + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
        kept = seen <= limit
        q, node, seen = q[kept], node[kept], seen[kept]
    return q, node


def block_links(entries: np.ndarray, queries: np.ndarray, limit: int, leaf: int = 64, fan_out: int = 8):
    """(query number, entry number, distance) of all pairs within the limit; ``entries`` in Gray order."""
    parents = shared_bits(entries, entries, leaf * fan_out)
    leaves = shared_bits(entries, entries, leaf)
    found = []
    for p in range(len(parents[0])):
        mask = ~(parents[0][p] ^ parents[1][p])
        seen = np.bitwise_count((queries ^ parents[0][p]) & mask)
        under = np.flatnonzero(seen <= limit)
        if not len(under):
            continue
        near, so_far = queries[under], seen[under]
        for c in range(p * fan_out, min((p + 1) * fan_out, len(leaves[0]))):
            full = ~(leaves[0][c] ^ leaves[1][c])
            more = so_far + np.bitwise_count((near ^ leaves[0][c]) & (full & ~mask))
            kept = np.flatnonzero(more <= limit)
            own = entries[c * leaf : (c + 1) * leaf]
            for at in range(0, len(kept), 1 << 15):
                part = kept[at : at + (1 << 15)]
                total = more[part, None] + np.bitwise_count((near[part, None] ^ own[None, :]) & ~full)
                i, j = np.nonzero(total <= limit)
                if len(i):
                    found.append((under[part[i]].astype(np.uint32), (c * leaf + j).astype(np.uint32), total[i, j].astype(np.uint8)))
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*found))


def spanning_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the edges of a minimum spanning forest over nodes 0 to n - 1."""
    up, chosen = np.arange(n), []

    def roots(x: np.ndarray) -> np.ndarray:
        x = up[x]
        while True:
            higher = up[x]
            if (higher == x).all():
                return x
            x = higher

    for w in np.unique(weight):
        edges = np.flatnonzero(weight == w)
        ra, rb = roots(a[edges]), roots(b[edges])
        apart = ra != rb
        low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        _, first = np.unique(low * n + high, return_index=True)
        for e, x, y in zip(edges[apart][first].tolist(), low[first].tolist(), high[first].tolist()):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                chosen.append(e)
    return np.array(chosen, np.int64)


def links(
    values: DataFrame, limit: int, block_rows: int = 4096, max_blocks: int = 1 << 20
) -> DataFrame:
    """(a, b, distance): a spanning forest, block by block, of the pairs at ``limit`` differing bits or fewer.

    ``values`` has the distinct fingerprints in ``fingerprint`` (long).  Linked values stay linked through
    the forest; a caller that goes on to check links must not rely on it.  At most ``max_blocks`` block patterns (16 bytes each) are shipped with the tasks; beyond
    ``max_blocks * block_rows`` values the blocks grow.
    """
    spark, fan_out = values.sparkSession, 16
    n = values.count()
    n_blocks = max(1, min(max_blocks, math.ceil(n / block_rows)))
    cut = values.select("fingerprint", gray_key(F.col("fingerprint")).alias("key"))
    blocks = materialise(cut.repartitionByRange(n_blocks, "key").select("fingerprint", F.spark_partition_id().alias("block")), "gray-blocks")
    shape = blocks.groupBy("block").agg(F.bit_and("fingerprint").alias("both"), F.bit_or("fingerprint").alias("either"))
    shape = shape.orderBy("block").toPandas()
    number = shape["block"].to_numpy(np.int64)
    tree = levels(shape["both"].to_numpy(np.int64).view(np.uint64), shape["either"].to_numpy(np.int64).view(np.uint64), fan_out) if n else []

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            home = batch.column(1).to_numpy()
            for at in range(0, len(own), 2048):
                q, node = walk(own[at : at + 2048], tree, fan_out, limit)
                target = number[node]
                ahead = target >= home[at : at + 2048][q]  # a pair is searched from its earlier block
                q, target = q[ahead], target[ahead]
                order = np.argsort(target, kind="stable")
                q, target = q[order], target[order]
                cuts = np.flatnonzero(np.diff(target)) + 1
                groups = np.split(own[at : at + 2048][q], cuts)
                if len(q):
                    firsts = target[np.concatenate([[0], cuts])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(firsts, pa.int32()), pa.array([g.tobytes() for g in groups], pa.binary())], ["block", "values"]
                    )

    sent = blocks.mapInArrow(route, "block int, values binary").groupBy("block").agg(F.collect_list("values").alias("queries"))
    held = blocks.groupBy("block").agg(F.collect_list("fingerprint").alias("entries"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n_row in range(batch.num_rows):
                entries = batch.column(0)[n_row].values.to_numpy().view(np.uint64)
                entries = entries[np.argsort(gray_rank(entries))]
                queries = np.frombuffer(b"".join(batch.column(1)[n_row].as_py()), np.uint64)
                q, e, distance = block_links(entries, queries, limit)
                known, at = np.unique(np.concatenate([entries, queries]), return_inverse=True)
                b, a = at[: len(entries)][e], at[len(entries) :][q]
                forest = spanning_forest(a, b, distance, len(known))
                signed = known.view(np.int64)
                columns = [pa.array(signed[a[forest]]), pa.array(signed[b[forest]]), pa.array(distance[forest].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "distance"])

    return held.join(sent, "block").select("entries", "queries").mapInArrow(search, "a long, b long, distance int")


def _firsts(values: DataFrame, limit: int) -> DataFrame:
    """(fingerprint, first): the smallest ``least`` of the group of each line of ``values`` (fingerprint, least)."""
    found = connected_components(links(values.select("fingerprint"), limit), "simhash")
    joined = values.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    first = joined.groupBy("component").agg(F.min("least").alias("first"))
    return materialise(joined.join(first, "component").select("fingerprint", "first"), "simhash-labels")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as long, component_id), one row per row of ``docs``.

    Fingerprints at ``limit`` differing bits or fewer link; ``component_id`` is the smallest doc_id reachable.
    Texts without a word (null ones too) have fingerprint 0 and link like others; texts of any length are read
    whole.  Rows without id take part and get the component of what they link with, null if no row with an id is
    reachable.  Repeated rows give repeated results.  Other columns are not looked at.  No rows give no rows.
    """
    marked = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fingerprint")), "fingerprints"
    )
    labels = _firsts(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), limit)
    return marked.join(labels.withColumnRenamed("first", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _parted(rows: DataFrame, key: Column, keys: DataFrame, tag: str, max_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is not among ``keys``, all others): the latter hold every row whose key is, and a few more.

    ``key`` and the one column of ``keys`` are non-null longs, hashes already; no column of ``rows`` starts with
    ``tag``.  A bitmap with 32 bits or more for each key tells the rows apart where they are read, so that only the
    others need a join.  It is broadcast in lines of 4 KiB, 16 MiB at most: beyond four million keys it tells fewer
    rows apart.
    """
    bits = min(max_bits, max(_LINE, 1 << (32 * keys.count()).bit_length()))
    cut = lambda k: k.bitwiseAND(F.lit(bits - 1))
    line, bit = f"{tag}line", f"{tag}bit"
    places = keys.select(cut(F.col(keys.columns[0])).alias(bit))
    # each line is made in one task from its keys, not merged from a line of every task
    lines = places.select(F.shiftright(bit, 15).alias(line), F.col(bit).bitwiseAND(F.lit(_LINE - 1)).alias(bit)).repartition(line)
    lines = lines.groupBy(line).agg(F.bitmap_construct_agg(bit).alias(f"{tag}bits"))
    own = rows.withColumn(bit, cut(key)).withColumn(line, F.shiftright(bit, 15)).withColumn(bit, F.col(bit).bitwiseAND(F.lit(_LINE - 1)))
    met = own.join(F.broadcast(lines), line, "left")
    byte = F.col(f"{tag}bits").substr((F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    among = F.coalesce(F.getbit(value, F.col(bit).bitwiseAND(F.lit(7)).cast("int")), F.lit(0)) == 1
    return met.where(~among).select(*rows.columns), met.where(among).select(*rows.columns)


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicates`, all columns as they are.

    The row of the smallest id stays; of rows that share it, that of the least SHA-256 of the text; of rows equal
    in both, any one.  Rows without id come last: one stays only where its whole group has no id.
    """
    content = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    own_id = F.col(id_col).cast("long")
    marked = materialise(
        docs.select(own_id.alias("doc_id"), content.alias("content"), fingerprint(F.col(text_col), shingle).alias("fingerprint")), "fingerprints"
    )
    rows = marked.groupBy("doc_id", "content", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content")
    firsts = _firsts(rows.groupBy("fingerprint").agg(F.min(order).alias("least")), limit)
    lost = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("content") == F.col("first.content")))
    tag = "__"  # in front of names that no column of docs has
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    decided = rows.join(firsts, "fingerprint").select(F.col("doc_id").alias(f"{tag}id"), F.col("content").alias(f"{tag}content"), lost.alias("lost"), "n")
    decided = materialise(decided.where("lost or n > 1").drop("n"), "simhash-decided")
    # Texts stay where they are read, but for rows that the bitmap of the decided ones cannot rule out.
    own = f"{tag}own_content"
    named = docs.withColumn(own, F.coalesce(content, F.lit("")))
    clear, open_rows = _parted(named, F.xxhash64(own_id, own), decided.select(F.xxhash64(f"{tag}id", f"{tag}content")), tag)
    same = own_id.eqNullSafe(F.col(f"{tag}id")) & (F.col(own) == F.col(f"{tag}content"))
    alone = open_rows.join(decided.drop("lost"), same, "left_anti")
    again = open_rows.join(decided.where("not lost").drop("lost"), same, "left_semi")
    one = again.groupBy(own_id.alias("__id"), F.col(own).alias("__content")).agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return clear.unionByName(alone).drop(own).unionByName(one.select("__row.*"))
