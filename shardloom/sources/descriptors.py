"""Dataset descriptors: JSON documents that list shards or point to component descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed_values import DESCRIPTOR_VERSION, DESCRIPTOR_VERSION_FIELD
from ..functions.names import url_dir, url_merge
from ..operators.index import positions, running_before
from .files import require_rows
from .sinks import write_documents

_SHARD = "url:string,nsamples:long,filesize:long,weight:double,name:string,dataset:string,source_url:string"
DESCRIPTOR = (
    f"{DESCRIPTOR_VERSION_FIELD} int, name string, base_path string, weight double, "
    f"shardlist array<struct<{_SHARD}>>, "
    f"datasets array<struct<source_url:string,base:string,name:string,weight:double,shardlist:array<struct<{_SHARD}>>>>, "
    "base string"
)


def _require(ok: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def _plain_path(url: Column) -> Column:
    return F.regexp_replace(url, "^file:/+", "/")


def parse_descriptors(docs: DataFrame, text: str) -> DataFrame:
    """Descriptor documents held as JSON text, parsed in place."""
    return docs.withColumn("d", F.from_json(F.col(text), DESCRIPTOR)).drop(text)


def resolve(docs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Shard lines of descriptors ``source, base, d`` in list order.

    Own shards come first, then each component's; URLs are rebased, ``weight``
    and ``name`` default to the descriptor's, a component's weight comes from
    the reference to it.  ``components`` is ``source_url, c`` for components
    given by URL, one level deep.
    """
    checked = docs.where(
        _require(F.col(f"d.{DESCRIPTOR_VERSION_FIELD}") == DESCRIPTOR_VERSION, "Unknown descriptor version")
    )
    own = checked.select("source", "base", F.col("d.name").alias("d_name"), F.col("d.weight").alias("d_weight"),
                         F.lit(-1).alias("component"), F.posexplode("d.shardlist").alias("pos", "s"))
    own = own.select(
        "source", "component", "pos",
        F.when(F.col("base").isNull(), F.col("s.url")).otherwise(url_merge(F.col("base"), F.col("s.url"))).alias("url"),
        F.col("s.nsamples").alias("nsamples"),
        F.col("s.filesize").alias("filesize"),
        F.coalesce("s.weight", "d_weight").alias("weight"),
        F.coalesce("s.name", "d_name").alias("name"),
        F.col("s.dataset").alias("dataset"),
    )
    parts = checked.select("source", F.posexplode("d.datasets").alias("component", "c"))
    inline = parts.where("c.source_url is null").select("source", "component", "c", F.lit(None).cast("string").alias("from_url"))
    linked = None
    if components is not None:
        refs = parts.where("c.source_url is not null").select(
            "source", "component", F.col("c.source_url").alias("source_url"), F.col("c.weight").alias("w")
        )
        # The reader names local files by URI; both sides drop that prefix.
        named = components.select(_plain_path(F.col("source_url")).alias("__at"), "c")
        linked = refs.withColumn("__at", _plain_path(F.col("source_url"))).join(named, "__at", "left").where(
            _require(F.col("c").isNotNull(), "Component descriptor not found")
        ).select(
            "source", "component",
            F.struct(
                F.lit(None).cast("string").alias("source_url"),
                F.col("c.base").alias("base"),
                F.col("c.name").alias("name"),
                F.col("w").alias("weight"),
                F.col("c.shardlist").alias("shardlist"),
            ).alias("c"),
            F.col("source_url").alias("from_url"),
        )
        inline = inline.unionByName(linked)
    sub = inline.where(_require(F.col("c.shardlist").isNotNull(), "Component without a shard list")).select(
        "source", "component", "c", "from_url", F.posexplode("c.shardlist").alias("pos", "s")
    )
    base = F.coalesce(F.col("c.base"), url_dir(F.col("from_url")))
    sub = sub.select(
        "source", "component", "pos",
        F.when(base.isNull(), F.col("s.url")).otherwise(url_merge(base, F.col("s.url"))).alias("url"),
        F.col("s.nsamples").alias("nsamples"),
        F.col("s.filesize").alias("filesize"),
        F.coalesce("s.weight", "c.weight").alias("weight"),
        F.col("s.name").alias("name"),
        F.coalesce("s.dataset", "c.name").alias("dataset"),
    )
    lines = own.unionByName(sub)
    return lines.where(
        _require(F.col("url").isNotNull() & F.col("nsamples").isNotNull(), "Shard without url or nsamples")
    )


def read_descriptor(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """Resolved shard list of one descriptor file and of the descriptors it points to; no shards is an error."""
    own_base = F.lit(base) if base is not None else url_dir(F.lit(path))
    raw = spark.read.schema(DESCRIPTOR).option("multiLine", "true").json(path)
    docs = raw.select(F.lit(path).alias("source"), own_base.alias("base"), F.struct("*").alias("d"))
    linked = docs.select(F.explode("d.datasets.source_url").alias("u")).where("u is not null").distinct()
    urls = [r["u"] for r in linked.collect()]  # one entry per component descriptor, the reader needs the paths
    components = None
    if urls:
        loaded = spark.read.schema(DESCRIPTOR).option("multiLine", "true").json(urls)
        components = loaded.select(
            F.col("_metadata.file_path").alias("source_url"), F.struct("*").alias("c")
        )
    return require_rows(resolve(docs, components).orderBy("component", "pos"), "No shards found")


def merge(lines: DataFrame, scalars: DataFrame) -> DataFrame:
    """Totals per descriptor directory next to the scalar fields of the merge, last descriptor winning.

    ``lines`` is ``source_no, dir, nsamples``; ``scalars`` is ``source_no, field, value``.
    """
    per_dir = lines.groupBy("dir").agg(F.sum("nsamples").alias("samples"), F.count(F.lit(1)).alias("shards"))
    last = scalars.groupBy("field").agg(F.max_by("value", "source_no").alias("value"))
    return per_dir.select(
        F.lit("samples").alias("kind"), F.col("dir").alias("name"), F.col("samples").cast("string").alias("value")
    ).unionByName(last.select(F.lit("field").alias("kind"), F.col("field").alias("name"), "value"))


def merged_list(lines: DataFrame, order: str = "pos") -> DataFrame:
    """The shard list of merged descriptors: every line with its dense ``ordinal``, list after list.

    ``lines`` has ``source_no`` and ``order`` (unique integers inside a list) and any other columns.  Lists are
    numbered in parallel; only their lengths meet in one place.
    """
    placed = positions(lines, order, ("source_no",), "__at")
    lengths = running_before(lines.groupBy("source_no").agg(F.count(F.lit(1)).alias("__n")), "source_no", "__n", "__before")
    found = placed.join(lengths.drop("__n"), "source_no")
    return found.select(*lines.columns, (F.col("__before") + F.col("__at")).alias("ordinal"))


def write_descriptor(shards: DataFrame, folder: str, name: str, part_size: int = 10_000) -> DataFrame:
    """Write a descriptor for ``ordinal, url, nsamples``: parts of at most ``part_size`` shards plus one
    top document that names them as component datasets.  Returns the written files.

    No task holds more than one part, however long the shard list is.
    """
    numbered = shards.withColumn("part", F.expr(f"ordinal div {part_size}"))
    parts = numbered.groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "url", "nsamples"))).alias("list")
    )
    entries = F.transform("list", lambda s: F.struct(s["url"].alias("url"), s["nsamples"].alias("nsamples")))
    body = F.to_json(
        F.struct(F.lit(DESCRIPTOR_VERSION).alias(DESCRIPTOR_VERSION_FIELD), F.lit(name).alias("name"), entries.alias("shardlist"))
    )
    target = F.concat(F.lit(f"{folder}/part-"), F.format_string("%06d", F.col("part")), F.lit(".json"))
    written = write_documents(parts.select(target.alias("path"), body.alias("text")))
    # The part table has total / part_size lines.
    top = written.groupBy(F.lit(1)).agg(F.sort_array(F.collect_list(F.struct(F.col("path").alias("source_url")))).alias("datasets"))
    document = F.to_json(
        F.struct(
            F.lit(DESCRIPTOR_VERSION).alias(DESCRIPTOR_VERSION_FIELD),
            F.lit(name).alias("name"),
            F.array().cast("array<struct<url:string,nsamples:bigint>>").alias("shardlist"),
            "datasets",
        )
    )
    return write_documents(top.select(F.lit(f"{folder}/descriptor.json").alias("path"), document.alias("text")))


def descriptor_json(shards: DataFrame, keys: list[str], name: Column) -> DataFrame:
    """One descriptor text per group of shards; groups are meant to be list parts of bounded length."""
    entries = F.transform(
        F.sort_array(F.collect_list(F.struct("ordinal", "url", "nsamples"))),
        lambda s: F.struct(s["url"].alias("url"), s["nsamples"].alias("nsamples")),
    )
    return (
        shards.groupBy(*keys)
        .agg(entries.alias("shardlist"))
        .withColumn(
            "document",
            F.to_json(F.struct(F.lit(DESCRIPTOR_VERSION).alias(DESCRIPTOR_VERSION_FIELD), name.alias("name"), "shardlist")),
        )
        .drop("shardlist")
    )
