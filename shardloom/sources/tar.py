"""Tar shards: data source with index-driven reads and a transactional sink, index table, range reads, table functions."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, StringEndsWith, StringStartsWith,
)
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.fixed_values import SHARD_SIZE
from ..functions.names import shard_name, split_name
from ..session import scratch_path
from . import cache
from .sinks import filesystem_of
from .tar_sink import TarShardWriter, first_ordinal, visible_shards

MEMBER_SCHEMA = "shard string, member_ordinal int, name string, header long, offset long, size long, content binary"
MEMBER_ARROW = [
    ("shard", pa.string()), ("member_ordinal", pa.int32()), ("name", pa.string()), ("header", pa.int64()),
    ("offset", pa.int64()), ("size", pa.int64()), ("content", pa.binary()),
]
INDEX_SCHEMA = "shard string, member_ordinal int, name string, header long, offset long, size long"
#: About so many bytes of an archive are one input partition where its index is known.
SPLIT_BYTES = 64 << 20
#: Many small ranges are bundled into about so many input partitions.
PARTITIONS = 256
#: Ranges this close together are read at once, up to the second number of bytes.
READ_GAP, READ_BYTES = 1 << 16, 8 << 20
#: Arrow batches of payloads end at about so many bytes.
BATCH_BYTES = 1 << 25


def write_shards(
    samples: DataFrame,
    folder: str,
    index: str,
    members: dict[str, str],
    stem: str | Column = "shard",
    shard_size: int = SHARD_SIZE,
    may_lack: frozenset[str] | set[str] = frozenset(),
    together: bool = False,
) -> DataFrame:
    """Write tar shards of ``shard_size`` samples and return ``url, nsamples, size_bytes``.

    A null payload stops the job, unless its extension is in ``may_lack``; then the sample has no such member.

    ``samples`` has ``key``, an ``index`` (dense per stem) and one binary column per member (``members`` maps
    extension to column).  Payloads move once, to the task of their shard, where sorted rows stream into the
    archive: neither a shard nor a partition has to fit in memory.  The archives become visible when the whole
    job is done; shards of the same name are replaced.  With ``together`` every shard is in one partition of
    ``samples`` already, in order, and nothing moves.
    """
    spark = samples.sparkSession
    register(spark)
    name = shard_name(F.lit(stem) if isinstance(stem, str) else stem, F.expr(f"{index} div {shard_size}"))
    chosen = samples.select(
        name.alias("shard"), F.col(index).alias("sample_no"), F.col("key").cast("string").alias("key"),
        *[F.col(c).cast("binary").alias(ext) for ext, c in members.items()],
    )
    if not together:
        chosen = chosen.repartition("shard").sortWithinPartitions("shard", "sample_no")
    arranged = chosen.drop("sample_no")
    report = scratch_path(spark, "shards")
    writer = arranged.write.format("tarshards").mode("append").option("replace", "true").option("report", report)
    writer.option("may_lack", ",".join(sorted(may_lack))).save(folder)
    listed = spark.read.schema("shard string, nsamples long, size_bytes long").json(report)
    return listed.select(F.concat(F.lit(f"{folder}/"), "shard").alias("url"), "nsamples", "size_bytes")


def _members(uri: str, wanted: Callable[[str, int], bool], with_content: bool, first: int = 0, start: int = 0, stop: int | None = None):
    """Regular members whose header begins in ``[start, stop)``, in order; ``first`` is the ordinal of the first.

    ``start`` must be the header of a member.  Reading streams, so the size of the archive does not matter; the
    payload of a member that is not ``wanted`` is skipped.
    """
    filesystem, path = filesystem_of(uri)
    with filesystem.open_input_file(path) as stream:
        stream.seek(start)
        with tarfile.open(fileobj=stream, mode="r:") as archive:
            ordinal = first
            while (member := archive.next()) is not None and (stop is None or member.offset < stop):
                archive.members = []
                if not member.isreg() or not member.name:
                    continue
                if wanted(member.name, ordinal):
                    content = archive.extractfile(member).read() if with_content else None
                    yield ordinal, member.name, member.offset, member.offset_data, member.size, content
                ordinal += 1


class _Range:
    """The members of an archive from one header to another, or all."""

    def __init__(self, uri: str, first: int = 0, start: int = 0, stop: int | None = None):
        self.uri, self.first, self.start, self.stop = uri, first, start, stop


class _Ranges(InputPartition):
    """Ranges that one task reads one after the other."""

    def __init__(self, ranges: list[_Range]):
        super().__init__(tuple((r.uri, r.start) for r in ranges[:1]))
        self.ranges = ranges


def _bundled(ranges: list[tuple[_Range, int]]) -> list[_Ranges]:
    """Ranges (with their bytes) of many blocks or small archives as partitions of like size, in order.

    There are about ``PARTITIONS`` of them, as long as none gets above ``SPLIT_BYTES``, so their number does not
    follow the number of blocks.  Spark wants one partition at least.
    """
    most = min(SPLIT_BYTES, max(1, sum(n for _, n in ranges) // PARTITIONS))
    out, held = [], 0
    for r, n in ranges:
        if not out or held + n > most:
            out.append([])
            held = 0
        held += n
        last = out[-1][-1] if out[-1] else None
        if last is not None and last.uri == r.uri and last.stop is not None and last.stop == r.start:
            last.stop = r.stop  # neighbours are one range
        else:
            out[-1].append(r)
    return [_Ranges(rs) for rs in out or [[]]]


#: Filters that the reader answers by itself, as tests of a value.
_TESTS: dict[type[Filter], Callable] = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


class TarShardReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields]
        wanted = options.get("extensions")
        self.extensions = {e.strip().lstrip(".") for e in wanted.split(",")} if wanted else None
        self.path, self.blocks = options["path"], options.get("blocks")
        self.parts = options.get("parts", "false").lower() == "true"
        self.paths = set(json.loads(options["archives"])) if "archives" in options else None
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Tests of shard, name and ordinal are answered here: by leaving out archives, blocks and payloads."""
        for f in filters:
            column = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            if column in ("shard", "name", "member_ordinal") and f.value is not None:
                value = frozenset(f.value) if isinstance(f, In) else f.value
                self.filters.append((column, type(f), value))
            else:
                yield f

    def _passes(self, column: str, value) -> bool:
        return all(_TESTS[kind](value, wanted) for c, kind, wanted in self.filters if c == column)

    def _may_hold(self, column: str, least, most) -> bool:
        """Whether values between ``least`` and ``most`` can pass the tests of a column."""
        for c, kind, wanted in self.filters:
            if c != column:
                continue
            if kind is In and not any(least <= v <= most for v in wanted):
                return False
            if kind is EqualTo and not least <= wanted <= most:
                return False
            if kind in (GreaterThan, GreaterThanOrEqual) and not _TESTS[kind](most, wanted):
                return False
            if kind in (LessThan, LessThanOrEqual) and not _TESTS[kind](least, wanted):
                return False
            if kind is StringStartsWith and (most < wanted or least[: len(wanted)] > wanted):
                return False
        return True

    def partitions(self):
        shards = [u for u in visible_shards(self.path) if self._passes("shard", u) and (self.paths is None or u in self.paths)]
        if not self.blocks:
            return _bundled(self._whole(shards))
        import pyarrow.dataset as ds

        filesystem, path = filesystem_of(self.blocks)
        table = ds.dataset(path, filesystem=filesystem, format="parquet").to_table(
            ["shard", "first_ordinal", "last_ordinal", "start", "stop", "min_name", "max_name"]
        )
        known, ranges = set(), []
        for b in table.to_pylist():
            known.add(b["shard"])
            held = self._may_hold("name", b["min_name"], b["max_name"])
            if held and self._may_hold("member_ordinal", b["first_ordinal"], b["last_ordinal"]):
                ranges.append((_Range(b["shard"], b["first_ordinal"], b["start"], b["stop"]), b["stop"] - b["start"]))
        visible = set(shards)
        ranges = [r for r in ranges if r[0].uri in visible] + self._whole([u for u in shards if u not in known])
        return _bundled(sorted(ranges, key=lambda r: (r[0].uri, r[0].start)))

    def _whole(self, shards: list[str]) -> list[tuple[_Range, int]]:
        """Whole archives with their sizes."""
        if not shards:
            return []
        filesystem = filesystem_of(shards[0])[0]
        sizes = [f.size or 0 for f in filesystem.get_file_info([filesystem_of(u)[1] for u in shards])]
        return [(_Range(u, first_ordinal(u) if self.parts else 0), n) for u, n in zip(shards, sizes)]

    def read(self, partition):
        def wanted(name: str, ordinal: int) -> bool:
            named = self.extensions is None or name.rsplit(".", 1)[-1] in self.extensions
            return named and self._passes("name", name) and self._passes("member_ordinal", ordinal)

        rows, held = [], 0
        for r in partition.ranges:
            for ordinal, name, header, offset, size, content in _members(r.uri, wanted, "content" in self.fields, r.first, r.start, r.stop):
                rows.append(
                    {"shard": r.uri, "member_ordinal": ordinal, "name": name, "header": header, "offset": offset,
                     "size": size, "content": content}
                )
                held += len(content) if content is not None else 0
                if len(rows) == 4096 or held > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        """Members travel to Spark as Arrow batches of bounded size."""
        fields = [(n, t) for n, t in MEMBER_ARROW if n in self.fields]
        fields.sort(key=lambda f: self.fields.index(f[0]))
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


class TarShardSource(DataSource):
    """``spark.read.format("tarshards").load(folder)`` and ``df.write.format("tarshards").save(folder)``.

    An archive, or a bundle of small ones, is one input partition; with ``blocks`` (a table of :func:`member_blocks`) it is cut into byte
    ranges and only blocks that can hold what is asked for are opened.  Filters on shard, name and member_ordinal
    are answered by the source.  Options for reading: ``extensions`` (comma list of wanted ones), ``blocks``, ``archives`` (JSON list of those to read); ``parts``
    (archives written with ``parts``: ordinals go on through the parts of a shard, see :func:`shard_of_part`); give
    ``INDEX_SCHEMA`` to leave payloads unread.  Writing: see :class:`TarShardWriter`.
    """

    @classmethod
    def name(cls):
        return "tarshards"

    def schema(self):
        return MEMBER_SCHEMA

    def reader(self, schema):
        return TarShardReader(schema, self.options)

    def writer(self, schema, overwrite):
        return TarShardWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``tarshards`` known to the session and let Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarShardSource)


def read_members(
    spark: SparkSession, folder: str, extensions: str | None = None, content: bool = True, blocks: str | None = None
) -> DataFrame:
    """Members of the archives of a folder (or of one archive); ``blocks`` is the path of a block table."""
    register(spark)
    reader = spark.read.format("tarshards").schema(MEMBER_SCHEMA if content else INDEX_SCHEMA)
    if extensions:
        reader = reader.option("extensions", extensions)
    if blocks:
        reader = reader.option("blocks", blocks)
    return reader.load(folder)


def shard_of_part(uri: Column) -> Column:
    """URI of the shard that the archive of a part belongs to."""
    return F.regexp_replace(uri, r"@\d{9,}\.tar$", ".tar")


def member_blocks(index: DataFrame, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Write the block table of an index: a line per ``split_bytes`` of an archive, with where its members begin and
    end and the range of their names.  100 TB make some 1.6 million lines, which readers load when they plan.
    """
    block = F.expr(f"header div {split_bytes}")
    end = F.col("offset") + F.ceil(F.col("size") / 512) * 512
    lines = index.groupBy("shard", block.alias("block")).agg(
        F.min("header").alias("start"), F.max(end).cast("long").alias("stop"), F.min("member_ordinal").alias("first_ordinal"),
        F.max("member_ordinal").alias("last_ordinal"), F.min("name").alias("min_name"), F.max("name").alias("max_name"),
    )
    lines.write.parquet(path)
    return path


def fetch_members(wanted: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of ``wanted`` (lines of an index: shard, offset, size and any others) with the payload as ``content``.

    Only the asked byte ranges are read: rows are dealt out by archive and stretch of ``split_bytes``, so a huge
    archive is read by many tasks, and ranges that lie close together are read at once.  A null shard, offset
    or size gives a null payload.
    """
    spec = StructType([*wanted.schema.fields, StructField("content", BinaryType())])
    names = wanted.columns

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = stream = None
        try:
            for batch in batches:
                uris, offsets, sizes = (batch.column(c).to_pylist() for c in ("shard", "offset", "size"))
                out, held, sent, at = [], 0, 0, 0
                while at < len(uris):
                    uri, lo, to = uris[at], offsets[at], at + 1
                    if uri is None or lo is None or sizes[at] is None:
                        out.append(None)
                        at += 1
                        continue
                    hi = lo + sizes[at]
                    while (
                        to < len(uris) and uris[to] == uri and offsets[to] is not None and sizes[to] is not None
                        and lo <= offsets[to] <= hi + READ_GAP and offsets[to] + sizes[to] - lo <= READ_BYTES
                    ):
                        hi, to = max(hi, offsets[to] + sizes[to]), to + 1
                    if uri != current:
                        if stream is not None:
                            stream.close()
                        filesystem, path = filesystem_of(uri)
                        current, stream = uri, filesystem.open_input_file(path)
                    content = stream.read_at(hi - lo, lo)
                    if len(content) != hi - lo:
                        raise ValueError(f"{uri} ends before {hi}")
                    out += [content[offsets[i] - lo : offsets[i] - lo + sizes[i]] for i in range(at, to)]
                    held, at = held + hi - lo, to
                    if held > BATCH_BYTES:
                        yield add(batch.slice(sent, at - sent), out)
                        out, held, sent = [], 0, at
                if sent < len(uris):
                    yield add(batch.slice(sent), out)
        finally:
            if stream is not None:
                stream.close()

    def add(rows: pa.RecordBatch, contents: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary())], names=[*names, "content"])

    stretch = F.expr(f"offset div {split_bytes}")
    dealt = wanted.repartition("shard", stretch).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(fetch, spec)


def shard_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size_bytes, mtime`` of the archives that readers see."""
    uris = visible_shards(folder)
    filesystem, _ = filesystem_of(folder)
    found = filesystem.get_file_info([filesystem_of(u)[1] for u in uris])
    lines = [(u, f.size, f.mtime_ns) for u, f in zip(uris, found)]
    return spark.createDataFrame(lines, "path string, size_bytes long, mtime long")


def member_index(spark: SparkSession, folder: str, index_path: str) -> DataFrame:
    """Index table ``(shard, member_ordinal, name, header, offset, size)``, kept at ``index_path``.

    Archives that came or changed since the last call are read, the lines of others are reused.
    """

    def build(paths: list[str]) -> DataFrame:
        register(spark)
        return spark.read.format("tarshards").schema(INDEX_SCHEMA).option("archives", json.dumps(paths)).load(folder)

    return cache.cached(spark, index_path, cache.stamped(shard_listing(spark, folder)), build, "shard")


def find_members(index: DataFrame, names: DataFrame) -> DataFrame:
    """Index lines of the members with the given names."""
    return index.join(names.select("name").distinct(), "name", "left_semi")


def keep_sample_members(members: DataFrame, name: str = "name") -> DataFrame:
    """Members that belong to a sample: named, not a pax header, with a dot in the name."""
    named = (F.length(name) > 0) & (F.col(name) != ".") & F.contains(F.col(name), F.lit("."))
    pax = F.contains(F.col(name), F.lit("PaxHeader")) | F.contains(F.col(name), F.lit("@PaxHeader"))
    return members.where(named & ~pax)


def assemble_samples(members: DataFrame, value: str = "content") -> DataFrame:
    """Samples of a shard: ``key``, position of the first member, map of extension to payload.

    A repeated extension keeps its last payload; that is settled before any
    map is built, so a map holds one entry per distinct extension.
    """
    key, ext = split_name(F.col("name"))
    split = keep_sample_members(members).withColumn("key", key).withColumn("ext", ext)
    # Both aggregations run on this one partitioning: payloads are shuffled once.
    split = split.repartition("shard", "key")
    single = split.groupBy("shard", "key", "ext").agg(
        F.max_by(value, "member_ordinal").alias("v"), F.min("member_ordinal").alias("first")
    )
    return single.groupBy("shard", "key").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "v")))).alias("members"),
        F.min("first").alias("first_ordinal"),
    )


@udtf(returnType="member_ordinal int, name string, size long, content binary")
class UnpackTar:
    """``LATERAL tar_unpack(content)``: members of an archive held in a binary column, which must fit in a row."""

    def eval(self, content: bytes):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as archive:
            for ordinal, member in enumerate(m for m in archive if m.isreg() and m.name):
                yield ordinal, member.name, member.size, archive.extractfile(member).read()


@udtf
class TarMembers:
    """``tar_members(TABLE(idx) PARTITION BY (shard, part) ORDER BY offset)``: payloads of the index lines of a table.

    The table has shard, offset and size and may have any other columns; the result has all of them and content.
    A partition may be a whole archive or a byte range of it, so archives of any size are read by many tasks;
    one archive is open at a time and only the asked ranges are read.
    """

    @staticmethod
    def analyze(idx: AnalyzeArgument) -> AnalyzeResult:
        if not idx.isTable:
            raise ValueError("tar_members takes a table: tar_members(TABLE(idx) PARTITION BY shard)")
        found = {f.name: f.dataType.simpleString() for f in idx.dataType.fields}
        for column, kinds in (("shard", {"string"}), ("offset", {"int", "bigint"}), ("size", {"int", "bigint"})):
            if found.get(column) not in kinds:
                raise ValueError(f"tar_members needs a column {column} of {' or '.join(sorted(kinds))}")
        return AnalyzeResult(StructType([*idx.dataType.fields, StructField("content", BinaryType())]))

    def __init__(self):
        self.current = self.stream = None

    def eval(self, idx):
        if idx["shard"] is None or idx["offset"] is None or idx["size"] is None:
            yield (*idx, None)
            return
        if idx["shard"] != self.current:
            self.terminate()
            filesystem, path = filesystem_of(idx["shard"])
            self.current, self.stream = idx["shard"], filesystem.open_input_file(path)
        content = self.stream.read_at(idx["size"], idx["offset"])
        if len(content) != idx["size"]:
            raise ValueError(f"{idx['shard']} ends before {idx['offset'] + idx['size']}")
        yield (*idx, content)

    def terminate(self):
        if self.stream is not None:
            self.stream.close()
            self.current = self.stream = None


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("tar_unpack", UnpackTar)
    spark.udtf.register("tar_members", TarMembers)
