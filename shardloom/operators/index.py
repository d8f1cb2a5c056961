"""Positions without a global sort on one task.

Every position here is found in two phases: counts per block of rows (combined
on the map side), a running sum over that small block table, and a rank inside
each bounded block.  With the default block of 2^20 rows, 10^12 rows give a
block table of 10^6 lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLOCK_ROWS = 1 << 20
BIN_ROWS = 4096
# Tables of files, bins or exclusions up to this many lines (of some 200 bytes) are broadcast; longer ones are joined.
MAX_BROADCAST_LINES = 200_000


def total_rows(df: DataFrame) -> Column:
    """Row count as a scalar subquery: stays lazy, needs no join."""
    return df.select(F.count(F.lit(1))).scalar()


def with_row_index(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet rows with ``source_file``, ``source_path`` and their physical ``source_row``; no shuffle, no window."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    chosen = [F.col(c) for c in (df.columns if columns is None else columns)]
    return df.select(
        *chosen,
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.row_index").alias("source_row"),
    )


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """One line per file: rows and the global index of its first row, files in path order."""
    files = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("source_path"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return running_before(files, "source_path", "rows", "first_index")


def _small(table: DataFrame, schema: str) -> DataFrame | None:
    """``table`` as a broadcast side, or None when it has more than ``MAX_BROADCAST_LINES`` lines."""
    lines = table.limit(MAX_BROADCAST_LINES + 1).collect()
    if len(lines) > MAX_BROADCAST_LINES:
        return None
    return F.broadcast(table.sparkSession.createDataFrame(lines, schema))


def with_global_index(
    spark: SparkSession, path: str, columns: list[str] | None = None, name: str = "global_index"
) -> DataFrame:
    """Global row index over files in path order: file offset plus row index.

    The offsets (one line per file, from row counts) are found first, so rows meet them without a shuffle.
    """
    rows = with_row_index(spark, path, columns)
    offsets = file_offsets(spark, path).select("source_path", "first_index")
    small = _small(offsets, "source_path string, first_index bigint")
    joined = rows.join(offsets if small is None else small, "source_path")
    return joined.withColumn(name, F.col("first_index") + F.col("source_row")).drop("first_index", "source_path")


def first_rows(
    spark: SparkSession, path: str, share: float, columns: list[str] | None = None, name: str = "global_index"
) -> DataFrame:
    """The first ``floor(share * rows)`` rows in path order; files beyond them are not read."""
    offsets = file_offsets(spark, path).select("source_path", "rows", "first_index")
    ends = offsets.agg(F.coalesce(F.floor(F.sum("rows") * share), F.lit(0)).cast("bigint"))
    limit = ends.first()[0]
    wanted = offsets.where(F.col("first_index") < limit).collect()  # one line per file that is read
    if not wanted:
        return with_row_index(spark, path, columns).withColumn(name, F.col("source_row")).drop("source_path").limit(0)
    rows = with_row_index(spark, [r["source_path"] for r in wanted], columns)
    starts = spark.createDataFrame([(r["source_path"], r["first_index"]) for r in wanted], "source_path string, first_index bigint")
    joined = rows.join(F.broadcast(starts) if len(wanted) <= MAX_BROADCAST_LINES else starts, "source_path")
    indexed = joined.withColumn(name, F.col("first_index") + F.col("source_row")).drop("first_index", "source_path")
    return indexed.where(F.col(name) < limit)


def running_before(
    small: DataFrame, order: str, value: str, out: str, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Sum of ``value`` over earlier lines of a small table (files, shards, blocks) per ``keys``."""
    scope = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = scope.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return small.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint"))


def positions(
    df: DataFrame,
    index: str,
    keys: tuple[str, ...] = (),
    name: str = "pos",
    size_name: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Dense 0-based position of each row in its key group, ordered by a unique integer ``index``.

    A hot key is spread over as many blocks as its index range needs, so no
    group has to fit in one task.  ``size_name`` adds the size of the group.
    """
    blocked = df.withColumn("__block", F.expr(f"{index} div {block_rows}"))
    counts = blocked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = running_before(counts, "__block", "__rows", "__before", keys)
    if size_name:
        scope = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        offsets = offsets.withColumn(size_name, F.sum("__rows").over(scope))
    # Rank first: the rows are then spread by (keys, block), not by the keys of the small table.
    in_block = Window.partitionBy(*keys, "__block").orderBy(index)
    ranked = blocked.withColumn("__rank", F.row_number().over(in_block) - 1)
    return (
        ranked.join(offsets.drop("__rows"), [*keys, "__block"])
        .withColumn(name, F.col("__before") + F.col("__rank"))
        .drop("__block", "__before", "__rank")
    )


def shard_ranges(shards: DataFrame, order: str = "ordinal", nsamples: str = "nsamples") -> DataFrame:
    """Half-open index range ``[start, stop)`` of every shard of the list."""
    ranged = running_before(shards, order, nsamples, "start")
    return ranged.withColumn("stop", F.col("start") + F.col(nsamples).cast("bigint"))


def locate(
    rows: DataFrame, index: str, ranges: DataFrame, bin_rows: int = BIN_ROWS, how: str = "inner", small: bool = False
) -> DataFrame:
    """Range join ``start <= index < stop`` as an equi join on index bins plus a residual.

    Disjoint ranges add at most one line per bin they touch, so the exploded
    side has ``total / bin_rows + shards`` lines and a huge shard is spread
    over many bins.  Empty ranges match nothing.  ``small`` says that the binned ranges may be broadcast.
    """
    binned = ranges.where(F.col("stop") > F.col("start")).withColumn(
        "__bin", F.explode(F.expr(f"sequence(start div {bin_rows}, (stop - 1) div {bin_rows})"))
    )
    left = rows.withColumn("__bin", F.expr(f"{index} div {bin_rows}"))
    inside = (
        (left["__bin"] == binned["__bin"])
        & (left[index] >= binned["start"])
        & (left[index] < binned["stop"])
    )
    return left.join(F.broadcast(binned) if small else binned, inside, how).drop("__bin")


def shard_groups(shards: DataFrame, prefix: str = "prefix", order: str = "ordinal") -> DataFrame:
    """Runs of consecutive shards with one prefix; ``group_start`` is the index offset of the run.

    Works on the shard list (one line per shard), never on samples.
    """
    line = Window.partitionBy(F.lit(0)).orderBy(order)
    changed = F.coalesce((F.lag(prefix).over(line) != F.col(prefix)).cast("int"), F.lit(1))
    runs = shard_ranges(shards, order).withColumn("__new", changed)
    runs = runs.withColumn("group_no", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    starts = runs.where("__new = 1").select("group_no", F.col("start").alias("group_start"))
    return runs.drop("__new").join(starts, "group_no")


def dense_renumber(df: DataFrame, index: str, excluded: DataFrame, source_count: int, name: str = "new_index"):
    """Drop excluded source indices and close the gaps: new = old - number of excluded below.

    The exclusion list is turned into ranges of kept indices with their shift, so samples take part in one
    binned range join and no window.  Bins widen with ``source_count``: the table has at most 50 000 lines
    plus two per exclusion and is broadcast while it is small.  An index out of range stops the job.
    """
    stop = F.col(index).cast("bigint")
    outside = excluded.select(stop.alias("stop")).where((F.col("stop") < 0) | (F.col("stop") >= source_count)).head()
    if outside:
        raise ValueError(f"Excluded index out of range: {outside['stop']}")
    listed = excluded.where(stop.isNotNull()).select(stop.alias("stop")).distinct()
    # An excluded index ends the kept range that starts after its predecessor in the list.
    cuts = positions(listed, "stop", name="shift")
    before = cuts.select((F.col("shift") + 1).alias("shift"), (F.col("stop") + 1).alias("start"))
    kept = cuts.join(before, "shift", "left").select(
        F.coalesce("start", F.lit(0).cast("bigint")).alias("start"), "stop", F.col("shift").cast("bigint").alias("shift")
    )
    tail = listed.agg(F.max("stop").alias("m"), F.count(F.lit(1)).alias("n")).select(
        F.coalesce(F.col("m") + 1, F.lit(0)).cast("bigint").alias("start"),
        F.lit(source_count).cast("bigint").alias("stop"),
        F.col("n").cast("bigint").alias("shift"),
    )
    ranges = kept.unionByName(tail)
    bin_rows = max(1 << 16, -(-source_count // 50_000))
    small = _small(ranges, "start bigint, stop bigint, shift bigint")
    return (
        locate(df, index, ranges if small is None else small, bin_rows=bin_rows, small=small is not None)
        .withColumn(name, F.col(index) - F.col("shift"))
        .drop("start", "stop", "shift")
    )


def expand_counts(df: DataFrame, count: str, name: str, chunk: int = 1 << 16) -> DataFrame:
    """One row per 0-based number below ``count``; big counts are spread over tasks in chunks."""
    chunked = df.where(F.col(count) > 0).withColumn(
        "__chunk", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {chunk})"))
    )
    spread = chunked.repartition(*[F.col(c) for c in df.columns], F.col("__chunk"))
    stop = F.least(F.col("__chunk") * chunk + chunk, F.col(count).cast("bigint")) - 1
    return spread.withColumn(name, F.explode(F.sequence(F.col("__chunk") * chunk, stop))).drop("__chunk")


def chunks(df: DataFrame, index: str, size: int, columns: list[str]) -> DataFrame:
    """Fixed-size chunks of a densely indexed list; a group never holds more than ``size`` rows."""
    return (
        df.groupBy(F.expr(f"{index} div {size}").alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct(index, *columns))).alias("items"))
    )
