"""Image-caption parquet to verified tar shards, input by input, resumable through a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.annotations import normalise, prompt_texts
from ..functions.fixed_values import OPTIONAL_COLUMNS, REQUIRED_COLUMNS, SHARD_SIZE
from ..functions.image_header import image_header
from ..functions.names import row_key, shard_prefix
from ..functions.text import clean_caption, visible_text_prompt
from ..operators.index import MAX_BROADCAST_LINES
from ..operators.verify import describe_members, verify_shards
from ..session import exists, materialise
from ..sources import descriptors, files, ledger, tar

LEDGER = (
    "name string, status string, rows bigint, shards bigint, source_before string, source_after string, completed_at string"
)
SHARD_LIST = "name string, url string, nsamples bigint"


def fingerprints(spark: SparkSession, source: str, pattern: str) -> DataFrame:
    prints = files.fingerprint_files(spark, source, pattern)
    return materialise(
        prints.select("path", "name", F.concat_ws(":", F.col("size_bytes").cast("string"), "sha256").alias("fp")), "prints"
    )


def _stem(source_file: Column) -> Column:
    """Name of an input as its shards and keys begin with it."""
    return F.regexp_replace(source_file, r"\.parquet$", "")


def cut_shards(spark: SparkSession, paths: list[str], shard_size: int) -> DataFrame:
    """``stem, shards, cut``: how many shards an input has and the numbers of those whose rows lie in several row groups.

    Only footers are read.  Inputs of one stem have their shards in common, so all of these count as cut.
    """
    begun = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(
        "row_groups", begun,
        lambda b, n: F.struct((b["at"] + n).alias("at"), F.concat(b["starts"], F.array(b["at"])).alias("starts")),
    )["starts"]
    inside = F.filter(starts, lambda s: s % shard_size != 0)
    found = files.inventory(spark, paths, "*").select(
        _stem(F.col("name")).alias("stem"), "rows", F.array_distinct(F.transform(inside, lambda s: F.floor(s / shard_size))).alias("own")
    )
    stems = found.groupBy("stem").agg(
        F.count(F.lit(1)).alias("inputs"), F.ceil(F.max("rows") / shard_size).cast("bigint").alias("shards"), F.flatten(F.collect_list("own")).alias("own")
    )
    shared = F.when(F.col("shards") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).otherwise(F.col("own"))
    return materialise(stems.select("stem", "shards", F.when(F.col("inputs") > 1, shared).otherwise(F.col("own")).alias("cut")), "cut")


def shards_together(rows: DataFrame, listed: DataFrame, shard_size: int) -> DataFrame:
    """Rows with ``source_file, source_row`` so that every shard is in one partition, in row order.

    A row group is read by one task in row order, so shards inside a row group are together where they are read and
    only the rows of cut ones (``listed`` by :func:`cut_shards`) move.  They are source rows, not yet the longer records.
    """
    n_shards, n_cut = listed.agg(F.sum("shards"), F.sum(F.size("cut"))).first()
    if not n_cut:
        return rows
    keyed = rows.withColumn("stem", _stem(F.col("source_file"))).withColumn("number", F.expr(f"source_row div {shard_size}"))
    cut = F.broadcast(listed.select("stem", F.explode("cut").alias("number")))
    apart = n_cut < n_shards and n_cut <= MAX_BROADCAST_LINES
    moving = keyed.join(cut, ["stem", "number"], "left_semi") if apart else keyed
    moved = moving.repartition("stem", "number").sortWithinPartitions("stem", "number", "source_row").select(*rows.columns)
    if not apart:
        return moved
    return keyed.join(cut, ["stem", "number"], "left_anti").select(*rows.columns).unionByName(moved)


def sample_records(rows: DataFrame, decode: Callable[[Column], Column] | None = None) -> DataFrame:
    """Source rows with ``source_file, source_row`` to ``stem, source_row, key, payload, record``.

    Declared sizes must agree with the image header; a row that disagrees or cannot be read stops the job.
    ``decode`` takes the payload column and gives a text for a payload that a codec cannot read, else null.
    """
    sized = rows.withColumn("actual", image_header(F.col("image.bytes")))
    where = F.concat(F.col("source_file"), F.lit(" row "), F.col("source_row").cast("string"), F.lit(": "))

    def disagrees(side: str) -> Column:
        return F.coalesce(F.col(f"image_{side}") != F.col(f"actual.{side}"), F.lit(False))

    problem = (
        F.when(F.col("actual.error").isNotNull(), F.col("actual.error"))
        .when(disagrees("width"), "width disagrees with the image")
        .when(disagrees("height"), "height disagrees with the image")
    )
    if decode is not None:
        problem = F.coalesce(problem, decode(F.col("image.bytes")))
    sound = F.when(problem.isNull(), True).otherwise(F.raise_error(F.concat(where, problem)).cast("boolean"))
    clean = clean_caption(F.col("caption"))
    texts = sized.where(sound).withColumn("annotations", normalise(F.col("annotations")))
    texts = texts.withColumn("texts", prompt_texts(F.col("annotations"))).withColumn("original_caption", clean)
    wm_score = F.col("wm_score") if "wm_score" in rows.columns else F.lit(None).cast("double")
    record = {
        "annotations": F.col("annotations"),
        "height": F.col("actual.height"),
        "original_caption": F.col("original_caption"),
        "prompt": visible_text_prompt(F.col("original_caption"), F.col("texts")),
        "source_image_format": F.col("actual.format"),
        "source_img_name": F.col("img_name"),
        "source_parquet": F.col("source_file"),
        "source_path": F.col("image.path"),
        "source_row": F.col("source_row"),
        "texts": F.col("texts"),
        "width": F.col("actual.width"),
        "wm_score": wm_score,
    }
    text = F.to_json(F.struct(*[c.alias(n) for n, c in record.items()]), {"ignoreNullFields": "false"})
    stem = _stem(F.col("source_file"))
    return texts.select(
        stem.alias("stem"), "source_row", row_key(stem, F.col("source_row")).alias("key"),
        F.col("image.bytes").alias("payload"), F.encode(text, "UTF-8").alias("record"),
    )


def _latest(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """Newest version of a small versioned table and the number of the next one."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema), 0
    runs = spark.read.parquet(path)
    run = runs.agg(F.max("run")).first()[0]
    return runs.where(F.col("run") == run).drop("run"), run + 1


def convert(
    spark: SparkSession, source: str, output: str, pattern: str = "*.parquet", shard_size: int = SHARD_SIZE,
    decode: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Convert inputs that the ledger does not list as complete and return the ledger.

    A completed input that changed or whose shard file is gone stops the job before anything is written; an
    input that changes while it is read stops it before its shards are listed.  The ledger is written last,
    so what it calls complete is in the shard list and in the descriptor, and a run that broke off is redone.
    """
    before = fingerprints(spark, source, pattern)
    old, run = _latest(spark, f"{output}/ledger", LEDGER)
    old_shards, list_run = _latest(spark, f"{output}/shard-list", SHARD_LIST)
    todo = ledger.pending_inputs(before.select("name", "fp"), old, lost_shards(spark, output, old_shards))
    # The reader needs the paths of its input files; this is the file listing, not data.
    paths = [r["path"] for r in before.join(todo, "name", "left_semi").orderBy("name").select("path").collect()]
    if not paths:
        if not old.isEmpty() and not exists(spark, f"{output}/descriptor.json"):
            write_top_descriptor(spark, output)
        return old
    rows = spark.read.parquet(*paths)
    wanted = [c for c in REQUIRED_COLUMNS + OPTIONAL_COLUMNS if c in rows.columns]
    files.gate_columns(rows)
    rows = rows.select(
        *wanted, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row")
    )
    samples = sample_records(shards_together(rows, cut_shards(spark, paths, shard_size), shard_size), decode)
    written = tar.write_shards(
        samples, f"{output}/shards", "source_row", {"jpg": "payload", "json": "record"}, F.col("stem"), shard_size, together=True
    )
    shards = written.select(
        F.concat(shard_prefix(F.col("url")), F.lit(".parquet")).alias("name"),
        F.replace("url", F.lit(f"{output}/"), F.lit("")).alias("url"),
        "nsamples",
    )
    counted = rows.groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    after = fingerprints(spark, source, pattern)
    finished = F.date_format(F.now(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fresh = materialise(ledger.ledger_rows(counted, shards, before, after, finished), "ledger")
    broken = fresh.where("status <> 'complete'").select("name", "status").head()
    if broken:
        raise ValueError(f"{broken['name']}: {broken['status']} while it was read")
    kept = old_shards.join(shards.select("name").distinct(), "name", "left_anti")
    kept.unionByName(shards).write.parquet(f"{output}/shard-list/run={list_run}")
    write_top_descriptor(spark, output)
    ledger.upsert_ledger(old, fresh).write.parquet(f"{output}/ledger/run={run}")
    return _latest(spark, f"{output}/ledger", LEDGER)[0]


def lost_shards(spark: SparkSession, output: str, shards: DataFrame) -> DataFrame:
    """Recorded shards whose file is not in the output folder."""
    name = F.regexp_extract("url", r"([^/]*)$", 1).alias("file")
    if not exists(spark, f"{output}/shards"):
        return shards
    there = files.list_files(spark, f"{output}/shards", "*.tar").select(F.col("name").alias("file"))
    return shards.withColumn("file", name).join(there, "file", "left_anti").drop("file")


def write_top_descriptor(spark: SparkSession, output: str, name: str = "captions") -> None:
    """Descriptor over all recorded shards in url order; the shard list is small."""
    recorded, _ = _latest(spark, f"{output}/shard-list", SHARD_LIST)
    order = Window.partitionBy(F.lit(0)).orderBy("url")
    numbered = recorded.withColumn("ordinal", F.row_number().over(order) - 1)
    descriptors.write_descriptor(numbered, output, name)


def verify(spark: SparkSession, output: str) -> DataFrame:
    """Violations over the written archives against the recorded shard list; empty means verified."""
    recorded, _ = _latest(spark, f"{output}/shard-list", SHARD_LIST)
    members = tar.read_members(spark, f"{output}/shards")
    name = F.regexp_extract("shard", r"([^/]*)$", 1)
    described = describe_members(members).withColumn("shard", name)
    listed = recorded.select(F.regexp_extract("url", r"([^/]*)$", 1).alias("shard"), "nsamples")
    return verify_shards(described, listed)
