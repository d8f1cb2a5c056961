"""File scans: parquet directories, listings, fingerprints, sidecars, prompt files, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.fixed_values import OPTIONAL_COLUMNS, REQUIRED_COLUMNS
from ..functions.names import file_extension
from ..functions.text import squeeze, strip
from .sinks import filesystem_of


def list_files(spark: SparkSession, path: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """``path, name, size_bytes, mtime`` of the files of a table; contents are not read.

    ``path`` is a file, a folder at any depth, a glob over either, or a list of these; ``pattern`` holds for file names.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.option("pathGlobFilter", pattern).load(path)
    return found.select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
    )


def file_of_row() -> Column:
    """Path of the file that a row was read from, spelled as :func:`list_files` does."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def scan_directory(spark: SparkSession, path: str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Parquet files of a file, folder or glob, optionally the first ``max_files`` by name; no match is an error.

    A file cap is applied to the listing, so the other files are never opened.
    """
    listed = list_files(spark, path, pattern)
    if max_files is None:
        if listed.isEmpty():
            raise FileNotFoundError(f"No {pattern} files in {path}")
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(path)
    names = listed.orderBy("name", "path").limit(max_files).select("path").collect()
    if not names:
        raise FileNotFoundError(f"No {pattern} files in {path}")
    return spark.read.parquet(*[r["path"] for r in names])


def gate_columns(
    df: DataFrame, required: list[str] = REQUIRED_COLUMNS, optional: list[str] = OPTIONAL_COLUMNS
) -> DataFrame:
    """Required columns must exist, optional ones come along when present, all others are pruned."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    return df.select(*required, *[c for c in optional if c in df.columns])


def image_payload(df: DataFrame, image: str = "image") -> DataFrame:
    """``payload`` and ``payload_path`` out of the image struct; a null payload becomes a reject reason."""
    return df.withColumn("payload", F.col(f"{image}.bytes")).withColumn("payload_path", F.col(f"{image}.path")).withColumn(
        "reject", F.when(F.col(f"{image}.bytes").isNull(), F.lit("no image bytes"))
    ).drop(image)


def inventory(spark: SparkSession, path: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """Listing plus rows and rows per row group, read from the footers, one task per file."""

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            groups = []
            for uri in batch["path"]:
                filesystem, local = filesystem_of(uri)
                meta = pq.read_metadata(local, filesystem=filesystem)
                groups.append([meta.row_group(i).num_rows for i in range(meta.num_row_groups)])
            yield batch.assign(rows=[sum(g) for g in groups], row_groups=groups)

    listed = list_files(spark, path, pattern).repartition("path")
    schema = "path string, name string, size_bytes long, mtime timestamp, rows long, row_groups array<long>"
    return listed.mapInPandas(footers, schema)


def fingerprint_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size, sha256 and md5 of each file, hashed in 1 MiB blocks so that size does not matter."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sha, md, sizes = [], [], []
            for uri in batch["path"]:
                filesystem, local = filesystem_of(uri)
                a, b, size = hashlib.sha256(), hashlib.md5(), 0
                with filesystem.open_input_stream(local) as stream:
                    while block := stream.read(1 << 20):
                        a.update(block)
                        b.update(block)
                        size += len(block)
                sha.append(a.hexdigest())
                md.append(b.hexdigest())
                sizes.append(size)
            yield batch.assign(sha256=sha, md5=md, read_bytes=sizes)

    listed = list_files(spark, path, pattern).repartition("path")
    schema = "path string, name string, size_bytes long, mtime timestamp, sha256 string, md5 string, read_bytes long"
    return listed.mapInPandas(hashed, schema)


def changed_files(
    before: DataFrame, after: DataFrame, key: str = "name", facts: tuple[str, ...] = ("size_bytes", "sha256")
) -> DataFrame:
    """(key, before, after) of the files whose facts differ between two listings; null on the side that lacks the file."""
    b = before.select(key, F.struct(*facts).alias("before"))
    a = after.select(key, F.struct(*facts).alias("after"))
    return b.join(a, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def require_unchanged(before: DataFrame, after: DataFrame) -> None:
    """Stop where a file changed, came or went between two fingerprints."""
    found = changed_files(before, after).orderBy("name").head()
    if found:
        raise ValueError(f"{found['name']} changed while it was read")


def explode_sidecar(files: DataFrame, text: str, value_type: str = "string") -> DataFrame:
    """One line per (key, caption type) of JSON sidecars ``{key: {type: value}}``; a broken file is empty."""
    parsed = F.from_json(F.col(text), f"map<string,map<string,{value_type}>>")
    keys = files.select(*[c for c in files.columns if c != text], F.explode(parsed).alias("key", "__types"))
    return keys.select(*[c for c in keys.columns if c != "__types"], F.posexplode("__types").alias("ordinal", "caption_type", "value"))


def read_sidecars(spark: SparkSession, path: str, suffix: str, value_type: str = "string") -> DataFrame:
    """Sidecar files ``<shard><suffix>.json`` below ``path``; no file at all gives an empty table."""
    pattern = f"*{suffix}.json"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    shard = F.concat(F.left(name, F.length(name) - len(suffix) - 5), F.lit(".tar"))
    texts = files.select(shard.alias("shard"), F.decode("content", "UTF-8").alias("__text"))
    return explode_sidecar(texts, "__text", value_type)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The same rows; no row at all is an error."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def image_store(images: DataFrame, labels: DataFrame, extensions: list[str], key: str = "key") -> DataFrame:
    """Distinct keys with a supported extension and their label; ``\\`` and ``/`` are the same in label keys."""
    from ..operators.joins import strict_lookup

    keys = images.where(file_extension(F.col(key)).isin(extensions)).select(key).distinct()
    clean = labels.withColumn(key, F.replace(F.col(key), F.lit("\\"), F.lit("/")))
    return strict_lookup(keys, clean, key)


def folder_captions(names: DataFrame, texts: DataFrame, extensions: list[str], name: str = "name") -> DataFrame:
    """Caption of each listed image: first line of the text file that has its base name."""
    tail = "|".join(e.lstrip(".") for e in extensions)
    base = names.withColumn("base", F.regexp_replace(name, rf"(?i)\.({tail})$", ""))
    line = strip(F.element_at(F.split("text", "\n"), 1))
    return base.join(texts.select("base", line.alias("caption")), "base")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt lines of text files; a file set without any prompt is refused."""
    return require_rows(prompt_lines(spark.read.text(path).withColumnRenamed("value", "prompt"), "prompt"), "No prompts")


def prompt_lines(lines: DataFrame, text: str) -> DataFrame:
    """Normalised non-empty prompt lines."""
    return lines.withColumn(text, squeeze(F.col(text))).where(F.length(text) > 0)


def prompt_dictionary(docs: DataFrame, text: str) -> DataFrame:
    """Key and prompt out of JSON dictionaries ``{key: {prompt: ...}}``."""
    parsed = F.from_json(F.col(text), "map<string,struct<prompt:string>>")
    return docs.select(F.explode(parsed).alias("key", "v")).select("key", F.col("v.prompt").alias("prompt"))


MANIFEST = (
    "format_version int, source_sample_count long, exclude_indices array<string>, "
    "held_out_samples array<struct<source_index:long,key:string,shard:string,prompt:string>>, "
    "authored_validation_prompts array<string>"
)


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def holdout_values(manifest: DataFrame) -> DataFrame:
    """The raw index values of a manifest in list order, as text, so that rules can judge them."""
    return manifest.select(F.posexplode("exclude_indices").alias("ordinal", "value"))


#: Values of one line of a manifest in parts.
PART_VALUES = 1 << 16


def write_holdout_parts(
    listed: DataFrame, folder: str, ordinal: str, value: str, source_sample_count: int | None = None, part_values: int = PART_VALUES
) -> None:
    """Write a manifest of any length: lines of at most ``part_values`` values, each with the ordinal of its first.

    ``ordinal`` is dense from 0 (see ``operators.index.positions``).  Every part is put together by the task that
    its ordinals fall to; nothing sees the whole list.
    """
    part = F.expr(f"`{ordinal}` div {part_values}").cast("long")
    held = listed.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v")))).alias("l"))
    lines = held.select(
        F.lit(1).alias("format_version"), F.lit(source_sample_count).cast("long").alias("source_sample_count"),
        (F.col("part") * part_values).alias("first_ordinal"), F.transform("l", lambda x: x["v"]).alias("exclude_indices"),
    )
    lines.write.json(folder)


def read_holdout_parts(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value) of a manifest in parts, line by line in parallel; a part that is broken stops the job.

    Parts must follow each other without gap: a lost file would shift what the list means.
    """
    parts = spark.read.schema(f"{MANIFEST}, first_ordinal long").option("mode", "FAILFAST").json(path)
    sizes = parts.select("first_ordinal", F.size("exclude_indices").cast("long").alias("n"))
    total, last = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.col("first_ordinal") + F.col("n")), F.lit(0))).first()
    if total != last or not sizes.groupBy("first_ordinal").count().where("count > 1").isEmpty():
        raise ValueError(f"Manifest parts hold {total} values for {last} places")
    values = parts.select("first_ordinal", F.posexplode("exclude_indices").alias("pos", "value"))
    return values.select((F.col("first_ordinal") + F.col("pos")).alias("ordinal"), "value")


METRIC_LINE = "step long, name string, value double, n long"


def read_metric_lines(spark: SparkSession, path: str, schema: str = METRIC_LINE, strict: bool = True) -> DataFrame:
    """Metric records of JSON-lines files; a broken line stops the job, or is null in every field."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def stream_metric_lines(spark: SparkSession, path: str, schema: str = METRIC_LINE, files_per_batch: int = 1000) -> DataFrame:
    """The same files as a stream: lines appended as new files are read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).json(path)


def url_scheme(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme == "", F.lit("file")).otherwise(scheme)


def decode_members(members: DataFrame, on_pickle: str = "raise") -> DataFrame:
    """Typed columns for members ``name, content``: as_text, as_class, as_json, as_npy; gz is inflated first.

    Unknown extensions keep their raw content.  Pickles are never opened: the first stops the job, or with
    ``on_pickle="list"`` they lose their content and the column ``refused`` says so.  ``as_npy`` has the shape and
    the values in C order; an array of objects is a pickle as well and stops the job.
    """
    parts = F.split(F.col("name"), r"\.")
    last = F.element_at(parts, -1)
    inner = F.when(last == "gz", F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))).otherwise(last)
    packed = members.withColumn("kind", inner)
    refused = F.col("kind").isin("pickle", "pkl")
    if on_pickle == "list":
        packed = packed.withColumn("refused", refused)
        answer = F.lit(None).cast("binary")
    else:
        answer = F.raise_error(F.concat(F.lit("Pickle members are refused: "), F.col("name"))).cast("binary")
    # Inflating needs Python; plain members never take that path, and a refused one is not inflated.
    raw = F.when(last == "gz", inflate(F.when((last == "gz") & ~refused, F.col("content")))).otherwise(F.col("content"))
    plain = decode_plain(packed.withColumn("content", F.when(refused, answer).otherwise(raw)))
    return plain.withColumn("as_npy", npy_arrays(F.when(F.col("kind") == "npy", F.col("content"))))


def decode_plain(members: DataFrame, kind: str = "kind") -> DataFrame:
    """Decoding with built-ins only, for members that are not packed."""
    text = F.decode("content", "UTF-8")
    k = F.col(kind)
    return members.select(
        "*",
        F.when(k.isin("txt", "text"), text).alias("as_text"),
        F.when(k.isin("cls", "cls2"), F.trim(text).cast("int")).alias("as_class"),
        F.when(k == "json", F.try_parse_json(text)).alias("as_json"),
    )


@F.pandas_udf(T.BinaryType())
def inflate(content: pd.Series) -> pd.Series:
    import gzip

    return content.map(lambda c: None if c is None else gzip.decompress(bytes(c)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def npy_values(content: pd.Series) -> pd.Series:
    """Flattened values of npy payloads; object arrays are refused."""
    import io

    import numpy as np

    def load(c):
        return None if c is None else np.load(io.BytesIO(bytes(c)), allow_pickle=False).astype("float64").ravel()

    return content.map(load)


@F.pandas_udf(T.StructType().add("shape", T.ArrayType(T.IntegerType())).add("numbers", T.ArrayType(T.DoubleType())))
def npy_arrays(content: pd.Series) -> pd.DataFrame:
    """Shape and values of npy payloads; object arrays are refused."""
    import io

    import numpy as np

    found = [None if c is None else np.load(io.BytesIO(bytes(c)), allow_pickle=False) for c in content]
    return pd.DataFrame(
        {
            "shape": [None if a is None else list(a.shape) for a in found],
            "numbers": [None if a is None else a.astype("float64").ravel() for a in found],
        }
    )
