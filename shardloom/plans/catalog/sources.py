"""Registered queries: sources (S) and sinks (K)."""

from __future__ import annotations

import gzip
import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ...functions.fixed_values import ASPECT_RATIO_512
from ...functions.names import image_key, row_key
from ...operators import index as ix
from ...operators.buckets import with_bucket
from ...session import materialise, scratch_path
from ...sources import cache, descriptors, files, ledger, sinks, tar
from ...streaming import metrics as live
from .common import (
    LINEITEM_SQL,
    SHARDS_SQL,
    SIZED_SQL,
    bucketed_sql,
    indexed_lineitem,
    order_shards,
    query,
    sized_lineitem,
    squeeze_sql,
    strip_sql,
    table,
)


@query("s1_directory_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    return files.scan_directory(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")


@query("s2_schema_gate", "SELECT doc_id, text, lang, source FROM documents")
def _(spark, sf):
    return files.gate_columns(table(spark, sf, "documents"), ["doc_id", "text", "lang"], ["source", "wm_score"])


@query(
    "s3_image_payload",
    "SELECT page_id, url AS payload_path, md5(html) AS payload_md5, strlen(html)::BIGINT AS payload_bytes FROM pages",
)
def _(spark, sf):
    image = F.struct(F.encode("html", "UTF-8").alias("bytes"), F.col("url").alias("path"))
    rows = files.image_payload(table(spark, sf, "pages").select("page_id", image.alias("image"))).where("reject is null")
    return rows.select(
        "page_id", "payload_path", F.md5("payload").alias("payload_md5"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )


@query("s4_file_inventory")
def _(spark, sf):
    found = files.inventory(spark, f"{sf}/lineitem.parquet")
    return found.select("name", "size_bytes", "mtime", "rows", F.to_json("row_groups").alias("rows_per_group"))


@query("s4_inventory_rows", "SELECT count(*) AS rows FROM lineitem")
def _(spark, sf):
    found = files.inventory(spark, f"{sf}/lineitem.parquet")
    return found.select(F.explode("row_groups").alias("n")).agg(F.sum("n").alias("rows"))


@query(
    "s5_fingerprints",
    "SELECT page_id, sha256(html) AS sha256, md5(html) AS md5, strlen(html)::BIGINT AS size_bytes FROM pages",
)
def _(spark, sf):
    content = F.encode("html", "UTF-8")
    return table(spark, sf, "pages").select(
        "page_id", F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
    )


@query("s5_file_fingerprints")
def _(spark, sf):
    return files.fingerprint_files(spark, f"{sf}/lineitem.parquet", "*.parquet").drop("path")


def page_digest_files(spark, sf, folder, changed=False):
    """A text file per sixty-four pages; ``changed`` rewrites every fifth one and adds one that was not there."""
    html = F.concat("html", F.lit("!")) if changed else F.col("html")
    pages = table(spark, sf, "pages").select(F.expr("page_id div 64").alias("part"), "page_id", F.md5(html).alias("digest"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("page_id", "digest"))), lambda p: p["digest"])
    parts = pages.groupBy("part").agg(F.array_join(lines, "\n").alias("text"))
    if changed:
        parts = parts.where("part % 5 = 0").unionByName(spark.createDataFrame([(999_999, "new")], "part long, text string"))
    sinks.write_documents(parts.select(F.format_string(f"{folder}/part-%06d.txt", "part").alias("path"), "text")).count()


@query(
    "s5_changed_files",
    """WITH p AS (SELECT page_id // 64 AS part, string_agg(md5(html), chr(10) ORDER BY page_id) AS old, string_agg(md5(html || '!'), chr(10) ORDER BY page_id) AS new FROM pages GROUP BY ALL)
SELECT printf('part-%06d.txt', part) AS name, sha256(old) AS sha_before, sha256(new) AS sha_after FROM p WHERE part % 5 = 0
UNION ALL SELECT 'part-999999.txt', NULL, sha256('new')""",
)
def _(spark, sf):
    folder = scratch_path(spark, "files")
    page_digest_files(spark, sf, folder)
    before = materialise(files.fingerprint_files(spark, folder, "*.txt"), "prints")
    files.require_unchanged(before, files.fingerprint_files(spark, folder, "*.txt"))  # nothing changed so far
    page_digest_files(spark, sf, folder, changed=True)
    moved = files.changed_files(before, files.fingerprint_files(spark, folder, "*.txt"))
    return moved.select("name", F.col("before.sha256").alias("sha_before"), F.col("after.sha256").alias("sha_after"))


@query(
    "s6_descriptor_scan",
    f"SELECT url, nsamples, 'orders' AS dataset, NULL::DOUBLE AS weight FROM ({SHARDS_SQL})",
)
def _(spark, sf):
    folder = scratch_path(spark, "descriptor")
    descriptors.write_descriptor(order_shards(spark, sf), folder, "orders", part_size=50)
    lines = descriptors.read_descriptor(spark, f"{folder}/descriptor.json")
    return lines.select(F.replace("url", F.lit(folder + "/"), F.lit("")).alias("url"), "nsamples", "dataset", "weight")


@query(
    "s7_descriptor_merge",
    """WITH lines AS (SELECT o_orderpriority AS dir, count(*) AS n FROM orders GROUP BY ALL),
  scalars AS (SELECT substr(o_orderpriority, 1, 1)::INTEGER AS source_no, o_orderpriority AS dir FROM orders)
SELECT 'samples' AS kind, dir AS name, n::VARCHAR AS value FROM lines
UNION ALL SELECT 'field', 'base_path', arg_max('/data/' || dir, source_no) FROM scalars
UNION ALL SELECT 'field', 'name', arg_max(dir, source_no) FROM scalars""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    number = F.substring("o_orderpriority", 1, 1).cast("int").alias("source_no")
    shards = orders.groupBy(number, F.col("o_orderpriority").alias("dir"), F.expr("o_orderkey div 100").alias("shard"))
    lines = shards.agg(F.count(F.lit(1)).alias("nsamples"))
    heads = lines.select("source_no", "dir").distinct()
    scalars = heads.select("source_no", F.lit("name").alias("field"), F.col("dir").alias("value")).unionByName(
        heads.select("source_no", F.lit("base_path").alias("field"), F.concat(F.lit("/data/"), "dir").alias("value"))
    )
    return descriptors.merge(lines, scalars)


@query(
    "s7_merged_list",
    """WITH s AS (SELECT substr(o_orderpriority, 1, 1)::INTEGER AS source_no, o_orderpriority AS dir, o_orderkey // 100 AS pos, count(*) AS nsamples FROM orders GROUP BY ALL)
SELECT row_number() OVER (ORDER BY source_no, pos) - 1 AS ordinal, dir || '/' || printf('part-%05d.tar', pos) AS url, nsamples FROM s""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    number = F.substring("o_orderpriority", 1, 1).cast("int").alias("source_no")
    lines = orders.groupBy(number, F.col("o_orderpriority").alias("dir"), F.expr("o_orderkey div 100").alias("pos")).agg(
        F.count(F.lit(1)).alias("nsamples")
    )
    url = F.concat("dir", F.format_string("/part-%05d.tar", "pos"))
    return descriptors.merged_list(lines).select("ordinal", url.alias("url"), "nsamples")


def page_samples(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(
        "page_id",
        row_key(F.lit("page"), F.col("page_id")).alias("key"),
        F.encode("html", "UTF-8").alias("body"),
        F.encode(F.to_json(F.struct("page_id", "url")), "UTF-8").alias("record"),
    )


def page_shards(spark, sf, folder):
    return tar.write_shards(
        page_samples(spark, sf), folder, "page_id", {"html": "body", "json": "record"}, stem="pages", shard_size=64
    )


PAGE_RECORD = """'{"page_id":' || page_id || ',"url":"' || url || '"}'"""
PAGE_MEMBERS_SQL = f"""SELECT printf('pages-%05d.tar', page_id // 64) AS shard, page_id, 0 AS slot,
  printf('page-%09d.html', page_id) AS name, html AS body FROM pages
UNION ALL SELECT printf('pages-%05d.tar', page_id // 64), page_id, 1,
  printf('page-%09d.json', page_id), {PAGE_RECORD} FROM pages"""


def _base(column):
    return F.regexp_extract(column, r"([^/]*)$", 1)


@query(
    "s8_tar_members",
    f"SELECT shard, name, strlen(body)::BIGINT AS size, md5(body) AS content_md5 FROM ({PAGE_MEMBERS_SQL})",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    page_shards(spark, sf, folder)
    return tar.read_members(spark, folder).select(
        _base("shard").alias("shard"), "name", "size", F.md5("content").alias("content_md5")
    )


@query(
    "s9_tar_index",
    f"""WITH m AS (SELECT shard, page_id, slot, name, strlen(body)::BIGINT AS size FROM ({PAGE_MEMBERS_SQL}))
SELECT shard, name, size, (row_number() OVER w - 1)::INTEGER AS member_ordinal,
  (512 * row_number() OVER w + coalesce(sum((size + 511) // 512 * 512) OVER
    (PARTITION BY shard ORDER BY page_id, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
FROM m WINDOW w AS (PARTITION BY shard ORDER BY page_id, slot)""",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    page_shards(spark, sf, folder)
    index_path = scratch_path(spark, "tar-index")
    tar.member_index(spark, folder, index_path)
    return tar.member_index(spark, folder, index_path).withColumn("shard", _base("shard")).drop("header")


@query(
    "s10_sample_assembly",
    f"""WITH m AS (SELECT l_orderkey // 100 AS shard, l_orderkey AS key, l_linenumber AS ext,
  arg_max(l_partkey, idx) AS v, min(idx) AS first FROM ({LINEITEM_SQL}) GROUP BY ALL)
SELECT shard::VARCHAR AS shard, key::VARCHAR AS key, string_agg('.' || ext || '=' || v, ',' ORDER BY ext) AS members,
  min(first)::BIGINT AS first_ordinal FROM m GROUP BY shard, key""",
)
def _(spark, sf):
    rows = indexed_lineitem(spark, sf, ["l_orderkey", "l_linenumber", "l_partkey"])
    members = rows.select(
        F.expr("l_orderkey div 100").cast("string").alias("shard"),
        F.col("idx").alias("member_ordinal"),
        F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_partkey").cast("string").alias("content"),
    )
    samples = tar.assemble_samples(members)
    entries = F.transform(F.map_entries("members"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return samples.select("shard", "key", F.array_join(entries, ",").alias("members"), "first_ordinal")


@query(
    "s11_index_lookup",
    """SELECT b.item_id * 13 AS wanted, printf('docs-%05d.tar', d.doc_id // 100) AS url, d.doc_id % 100 AS inner_index,
  d.lang, d.n_chars FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 13""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    shards = docs.groupBy(F.expr("doc_id div 100").alias("ordinal")).agg(F.count(F.lit(1)).alias("nsamples"))
    ranges = ix.shard_ranges(shards).withColumn("url", F.format_string("docs-%05d.tar", F.col("ordinal")))
    wanted = table(spark, sf, "benchmark").select((F.col("item_id") * 13).alias("wanted"))
    found = ix.locate(wanted, "wanted", ranges).withColumn("inner_index", F.col("wanted") - F.col("start"))
    return found.join(docs, F.col("wanted") == F.col("doc_id")).select("wanted", "url", "inner_index", "lang", "n_chars")


@query(
    "s11_name_lookup",
    f"""SELECT shard, name, strlen(body)::BIGINT AS size FROM ({PAGE_MEMBERS_SQL}) WHERE slot = 1 AND page_id IN (SELECT item_id FROM benchmark)""",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    page_shards(spark, sf, folder)
    wanted = table(spark, sf, "benchmark").select(F.format_string("page-%09d.json", F.col("item_id")).alias("name"))
    found = tar.find_members(tar.member_index(spark, folder, scratch_path(spark, "tar-index")), wanted)
    return found.select(_base("shard").alias("shard"), "name", "size")


@query(
    "s11_payload_lookup",
    f"""SELECT shard, name, md5(body) AS content_md5 FROM ({PAGE_MEMBERS_SQL}) WHERE page_id IN (SELECT item_id * 7 FROM benchmark)""",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    page_shards(spark, sf, folder)
    name = F.format_string("page-%09d", F.col("item_id") * 7)
    names = F.explode(F.array(F.concat(name, F.lit(".html")), F.concat(name, F.lit(".json"))))
    wanted = table(spark, sf, "benchmark").select(names.alias("name"))
    lines = tar.find_members(tar.member_index(spark, folder, scratch_path(spark, "tar-index")), wanted)
    found = tar.fetch_members(lines.select("shard", "name", "offset", "size"))
    return found.select(_base("shard").alias("shard"), "name", F.md5("content").alias("content_md5"))


@query(
    "s9_block_scan",
    f"""WITH m AS (SELECT shard, name, md5(body) AS content_md5, (row_number() OVER (PARTITION BY shard ORDER BY page_id, slot) - 1)::INTEGER AS member_ordinal FROM ({PAGE_MEMBERS_SQL}))
SELECT * FROM m WHERE name LIKE '%.html' AND member_ordinal >= 20""",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    page_shards(spark, sf, folder)
    index = tar.member_index(spark, folder, scratch_path(spark, "tar-index"))
    blocks = tar.member_blocks(index, scratch_path(spark, "tar-blocks"), 64 << 10)
    found = tar.read_members(spark, folder, blocks=blocks).where("name LIKE '%.html' AND member_ordinal >= 20")
    return found.select(_base("shard").alias("shard"), "name", F.md5("content").alias("content_md5"), "member_ordinal")


@query(
    "k1_tar_sink",
    f"""SELECT printf('lang-%s.tar', lang) AS shard, printf('%09d.txt', doc_id) AS name, md5(text) AS content_md5,
  (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::INTEGER AS member_ordinal FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL""",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    docs = table(spark, sf, "documents").where("lang IS NOT NULL AND text IS NOT NULL")
    samples = docs.select(
        F.format_string("lang-%s.tar", "lang").alias("shard"), F.format_string("%09d", "doc_id").alias("key"),
        F.encode("text", "UTF-8").alias("txt"),
    )
    tar.register(spark)
    # A shard a language grows with the table: ranges of keys are written as parts of it.
    arranged = samples.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    write = arranged.write.format("tarshards").option("parts", "true")
    write.mode("append").save(folder)
    write.mode("overwrite").save(folder)  # the same shards once more, none beside them
    found = spark.read.format("tarshards").option("parts", "true").load(folder)
    return found.select(_base(tar.shard_of_part(F.col("shard"))).alias("shard"), "name", F.md5("content").alias("content_md5"), "member_ordinal")


@query(
    "s12_decode_members",
    """SELECT conv_id, turn, text AS as_text, turn::INTEGER AS as_class, role AS json_role FROM conversations""",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations")

    def member(kind, content):
        return F.struct(F.lit(kind).alias("kind"), F.encode(content, "UTF-8").alias("content"))

    record = F.to_json(F.struct("role", "turn"))
    packed = F.array(member("txt", F.col("text")), member("cls", F.col("turn").cast("string")), member("json", record))
    members = turns.select("conv_id", "turn", F.explode(packed).alias("m")).select("conv_id", "turn", "m.*")
    decoded = files.decode_plain(members)
    return decoded.groupBy("conv_id", "turn").agg(
        F.max("as_text").alias("as_text"), F.max("as_class").alias("as_class"),
        F.max(F.try_variant_get("as_json", "$.role", "string")).alias("json_role"),
    )


PAYLOADS = T.StructType([T.StructField(n, T.BinaryType()) for n in ("vector", "packed_vector", "text", "packed_text")])


@F.pandas_udf(PAYLOADS)
def packed_payloads(vectors: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """Members as other tools write them: npy arrays and texts, plain and gzipped."""
    arrays, plain = [], [t.encode() for t in texts]
    for v in vectors:
        buffer = io.BytesIO()
        np.save(buffer, np.asarray(v, dtype="float32").reshape(2, -1))
        arrays.append(buffer.getvalue())
    return pd.DataFrame({
        "vector": arrays, "packed_vector": [gzip.compress(a) for a in arrays], "text": plain,
        "packed_text": [gzip.compress(t) for t in plain],
    })


@query(
    "s12_decode_packed",
    """SELECT vec_id, kind, CASE kind WHEN 'npy' THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total,
  CASE kind WHEN 'npy' THEN '2x' || len(embedding) // 2 END AS shape, CASE WHEN kind = 'cls' THEN label END AS as_class,
  CASE kind WHEN 'txt' THEN label::VARCHAR WHEN 'json' THEN label::VARCHAR END AS text, kind = 'pkl' AS refused, packed
FROM embeddings, (VALUES ('npy'), ('cls'), ('txt'), ('json'), ('pkl')) k(kind), (VALUES (true), (false)) p(packed)""",
)
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", packed_payloads("embedding", F.col("label").cast("string")).alias("p")
    )
    kinds = [("npy", "vector"), *[(k, "text") for k in ("cls", "txt", "json", "pkl")]]
    named = [
        F.struct(F.lit(f"x.{k}{tail}").alias("name"), F.col(f"p.{pre}{c}").alias("content"))
        for k, c in kinds for pre, tail in (("", ""), ("packed_", ".gz"))
    ]
    members = rows.select("vec_id", F.explode(F.array(*named)).alias("m")).select("vec_id", "m.*")
    found = files.decode_members(members, on_pickle="list")
    total = F.aggregate("as_npy.numbers", F.lit(0.0), lambda a, v: a + v)
    return found.select(
        "vec_id", "kind", F.round(total, 4).alias("total"), F.array_join(F.col("as_npy.shape").cast("array<string>"), "x").alias("shape"),
        "as_class", F.coalesce("as_text", F.try_variant_get("as_json", "$", "string")).alias("text"), "refused",
        F.col("name").endswith(".gz").alias("packed"),
    )


@query(
    "s13_sidecar_scan",
    """SELECT d.doc_id, u.caption_type, CASE u.caption_type WHEN 'quality' THEN quality ELSE toxic END::VARCHAR AS value
FROM documents d LEFT JOIN labels l USING (doc_id)
LEFT JOIN (VALUES ('quality'), ('toxic')) u(caption_type) ON l.doc_id IS NOT NULL""",
)
def _(spark, sf):
    labels = table(spark, sf, "labels")
    scores = F.create_map(
        F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")
    )
    # One sidecar per shard of at most a hundred documents.
    sidecars = labels.groupBy(F.expr("doc_id div 100").alias("shard")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), scores)))).alias("text")
    )
    lines = files.explode_sidecar(sidecars, "text").select(F.col("key").cast("bigint").alias("doc_id"), "caption_type", "value")
    return table(spark, sf, "documents").select("doc_id").join(lines, "doc_id", "left")


EXTENSION_SQL = "CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.PNG' ELSE '.txt' END"


@query(
    "s14_image_store",
    f"""SELECT 'set/' || printf('%08d', page_id) || {EXTENSION_SQL} AS key, (d.n_chars % 1000)::INTEGER AS label
FROM pages JOIN documents d ON d.doc_id = page_id WHERE page_id % 3 < 2""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id")
    ext = F.when(F.col("page_id") % 3 == 0, ".png").when(F.col("page_id") % 3 == 1, ".PNG").otherwise(".txt")
    name = F.concat(F.format_string("%08d", F.col("page_id")), ext)
    images = pages.select(F.concat(F.lit("set/"), name).alias("key"))
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "page_id")
    labels = docs.select(F.concat(F.lit("set\\"), name).alias("key"), (F.col("n_chars") % 1000).cast("int").alias("label"))
    return files.image_store(images, labels, [".png"])


@query(
    "s15_folder_captions",
    f"SELECT doc_id, {strip_sql('string_split(text, chr(10))[1]')} AS caption FROM documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    base = F.format_string("doc-%09d", F.col("doc_id"))
    names = docs.select("doc_id", F.concat(base, F.when(F.col("doc_id") % 2 == 0, ".jpg").otherwise(".PNG")).alias("name"))
    texts = docs.select(base.alias("base"), "text")
    return files.folder_captions(names, texts, [".jpg", ".png"]).select("doc_id", "caption")


@query(
    "s16_prompt_lines",
    f"""SELECT item_id, line_no, line FROM (SELECT item_id, generate_subscripts(l, 1) - 1 AS line_no,
  {squeeze_sql('unnest(l)')} AS line FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark))
WHERE line <> ''""",
)
def _(spark, sf):
    lines = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return files.prompt_lines(lines.withColumn("line_no", F.col("line_no").cast("bigint")), "line")


@query("s17_prompt_dictionary", "SELECT printf('prompt_%04d', item_id) AS key, text AS prompt FROM benchmark")
def _(spark, sf):
    key = F.format_string("prompt_%04d", F.col("item_id"))
    entry = F.create_map(key, F.struct(F.col("text").alias("prompt")))
    return files.prompt_dictionary(table(spark, sf, "benchmark").select(F.to_json(entry).alias("doc")), "doc")


@query(
    "s18_manifest_scan",
    """SELECT item_id, u.ordinal::INTEGER AS ordinal, CASE u.ordinal WHEN 0 THEN item_id ELSE length(text) END::VARCHAR AS value
FROM benchmark, (VALUES (0), (1)) u(ordinal)""",
)
def _(spark, sf):
    document = F.to_json(
        F.struct(
            F.lit(1).alias("format_version"),
            F.lit(1000).alias("source_sample_count"),
            F.array(F.col("item_id"), F.length("text").cast("bigint")).alias("exclude_indices"),
        )
    )
    parsed = table(spark, sf, "benchmark").select("item_id", F.from_json(document, files.MANIFEST).alias("m"))
    return parsed.select("item_id", F.posexplode("m.exclude_indices").alias("ordinal", "value"))


@query(
    "s19_url_schemes",
    "SELECT split_part(url, ':', 1) AS scheme, count(*) AS urls FROM pages GROUP BY ALL",
)
def _(spark, sf):
    return table(spark, sf, "pages").groupBy(files.url_scheme(F.col("url")).alias("scheme")).agg(F.count(F.lit(1)).alias("urls"))


@query(
    "s20_metric_lines",
    "SELECT event_id, event_type AS name, value, json_extract_string(props, '$.k')::INTEGER AS k FROM events",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id", F.col("event_type").alias("name"), "value", F.from_json("props", "k int")["k"].alias("k")
    )


METRIC_FILES_SQL = """SELECT event_type AS name, count(*) AS "lines", round(sum(value), 4) AS total,
  sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS n FROM events GROUP BY event_type"""


def metric_folder(spark, sf):
    lines = table(spark, sf, "events").select(
        F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value", F.from_json("props", "k long")["k"].alias("n")
    )
    folder = scratch_path(spark, "metric-lines")
    sinks.append_json_lines(lines, folder)
    return folder


def _metric_totals(lines):
    return lines.groupBy("name").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("value"), 4).alias("total"), F.sum("n").alias("n")
    )


@query("s20_metric_line_files", METRIC_FILES_SQL)
def _(spark, sf):
    return _metric_totals(files.read_metric_lines(spark, metric_folder(spark, sf)))


@query("s20_metric_line_stream", METRIC_FILES_SQL)
def _(spark, sf):
    lines = files.stream_metric_lines(spark, metric_folder(spark, sf))
    return _metric_totals(live.run_append(lines, scratch_path(spark, "metric-rows"), scratch_path(spark, "state")))


@query(
    "s18_manifest_file",
    "SELECT row_number() OVER (ORDER BY item_id)::INTEGER - 1 AS ordinal, (item_id * 3)::VARCHAR AS value FROM benchmark",
)
def _(spark, sf):
    listed = ix.positions(table(spark, sf, "benchmark").select("item_id"), "item_id", name="ordinal")
    folder = scratch_path(spark, "manifest")
    files.write_holdout_parts(listed.withColumn("value", F.col("item_id") * 3), folder, "ordinal", "value", part_values=64)
    return files.read_holdout_parts(spark, folder).select(F.col("ordinal").cast("int").alias("ordinal"), "value")


@query(
    "s21_sample_info",
    """SELECT doc_id, printf('doc-%09d', doc_id) AS key, (n_chars % 900 + 1)::INTEGER AS height,
  (doc_id % 700 + 1)::INTEGER AS width, source AS version FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", row_key(F.lit("doc"), F.col("doc_id")).alias("key"),
        (F.col("n_chars") % 900 + 1).cast("int").alias("height"), (F.col("doc_id") % 700 + 1).cast("int").alias("width"),
        F.col("source").alias("version"),
    )


# ------------------------------------------------------------------- sinks


@query(
    "k1_tar_shards",
    "SELECT printf('pages-%05d.tar', page_id // 64) AS url, count(*) AS nsamples FROM pages GROUP BY ALL",
)
def _(spark, sf):
    written = page_shards(spark, sf, scratch_path(spark, "tars"))
    return written.select(_base("url").alias("url"), "nsamples")


@query(
    "k2_descriptor",
    f"""SELECT ordinal // 50 AS part, '{{"wids_version":1,"name":"orders","shardlist":[' ||
  string_agg('{{"url":"' || url || '","nsamples":' || nsamples || '}}', ',' ORDER BY ordinal) || ']}}' AS document
FROM ({SHARDS_SQL}) GROUP BY ALL""",
)
def _(spark, sf):
    parts = order_shards(spark, sf).withColumn("part", F.expr("ordinal div 50"))
    return descriptors.descriptor_json(parts, ["part"], F.lit("orders"))


@query(
    "k3_ledger",
    """SELECT o_orderpriority AS name, CASE WHEN o_orderpriority = '5-LOW' THEN 'changed' ELSE 'complete' END AS status,
  count(*) AS "rows", count(DISTINCT o_orderkey // 100) AS shards, md5(count(*)::VARCHAR) AS source_before,
  md5(count(*)::VARCHAR || CASE WHEN o_orderpriority = '5-LOW' THEN 'x' ELSE '' END) AS source_after,
  strftime(max(o_orderdate), '%Y-%m-%d') AS completed_at FROM orders GROUP BY o_orderpriority""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "name")
    per_input = orders.groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("at")
    )
    shards = orders.groupBy("name", F.expr("o_orderkey div 100").alias("url")).agg(F.count(F.lit(1)).alias("nsamples"))
    count = F.col("rows").cast("string")
    before = per_input.select("name", F.md5(count).alias("fp"))
    after = per_input.select("name", F.md5(F.concat(count, F.when(F.col("name") == "5-LOW", "x").otherwise(""))).alias("fp"))
    return ledger.ledger_rows(per_input, shards, before, after, F.col("at"))


@query(
    "k4_keyed_store",
    """SELECT substr(printf('%08d', page_id), 1, 5) AS prefix, count(*) AS images, sum(strlen(html))::BIGINT AS bytes
FROM pages GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "store")
    rows = table(spark, sf, "pages").select(image_key(F.col("page_id")).alias("key"), F.encode("html", "UTF-8").alias("png"))
    sinks.write_keyed_store(rows, path)
    stored = spark.read.schema("key string, png binary, prefix string").parquet(path)
    return stored.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("images"), F.sum(F.octet_length("png")).alias("bytes")
    )


@query(
    "k5_sorted_index",
    "SELECT substr(printf('%08d', doc_id), 1, 5) || '/img' || printf('%08d', doc_id) || '.png' AS key, quality AS label FROM labels",
)
def _(spark, sf):
    rows = table(spark, sf, "labels").select(image_key(F.col("doc_id")).alias("key"), F.col("quality").alias("label"))
    return sinks.write_sorted_index(rows, scratch_path(spark, "index"))


@query(
    "k6_label_upsert",
    """SELECT doc_id, arg_max(label, seq) AS label FROM (SELECT doc_id, quality AS label, -1 AS seq FROM labels
UNION ALL SELECT user_id, floor(value)::INTEGER, event_id FROM events) GROUP BY doc_id""",
)
def _(spark, sf):
    old = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), F.lit(-1).cast("bigint").alias("seq"))
    new = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.floor("value").cast("int").alias("label"), F.col("event_id").alias("seq")
    )
    return sinks.upsert(old, new, "doc_id", "label", "seq")


@query(
    "k7_insert_if_absent",
    """SELECT CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'existing' END AS outcome, count(*) AS "rows"
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""",
)
def _(spark, sf):
    marked = sinks.split_new(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    return marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "k7_append_absent",
    """SELECT doc_id, quality FROM labels
UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, sf):
    folder = scratch_path(spark, "label-store")
    table(spark, sf, "labels").select("doc_id", "quality").write.parquet(folder)
    incoming = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"))
    for _ in range(2):  # the second time everything is there
        stored = spark.read.parquet(folder)
        fresh = sinks.split_new(incoming, stored, "doc_id").where("outcome = 'new'").select("doc_id", "quality")
        fresh.write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


@query(
    "k8_append_lines",
    f"""SELECT {squeeze_sql('text')} AS line, (2 * count(*))::BIGINT AS times FROM benchmark GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "lines")
    rows = files.prompt_lines(table(spark, sf, "benchmark"), "text")
    sinks.append_lines(rows, path, "text", "item_id")
    sinks.append_lines(rows, path, "text", "item_id")
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("times"))


@query(
    "k9_json_lines",
    """SELECT '{"count":' || count(*) || ',"k_sum":' || sum(json_extract_string(props, '$.k')::BIGINT) || ',"name":"' ||
  event_type || '"}' AS value FROM events GROUP BY event_type""",
)
def _(spark, sf):
    path = scratch_path(spark, "stats")
    stats = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum")
    )
    sinks.append_json_lines(stats, path)
    return spark.read.text(path)


@query(
    "k10_class_outputs",
    "SELECT printf('class_%04d', label) AS class, printf('%05d', vec_id) AS name, vec_id FROM embeddings",
)
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    written = sinks.write_by_class(rows, scratch_path(spark, "classes"), "label", F.col("vec_id"))
    return written.select("class", "name", "vec_id")


@query(
    "k10_run_manifest",
    """SELECT count(*) AS images, count(DISTINCT label) AS classes, min(label) AS first_class, max(label) AS last_class
FROM embeddings""",
)
def _(spark, sf):
    return sinks.run_manifest(table(spark, sf, "embeddings").select("label"), "label")


@query(
    "k11_sample_archive",
    "SELECT vec_id, len(embedding)::INTEGER AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
)
def _(spark, sf):
    packed = sinks.write_archive(table(spark, sf, "embeddings").select("vec_id", "embedding"), scratch_path(spark, "archive"), 2)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return packed.select("vec_id", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


@query(
    "k12_incremental_cache",
    """SELECT event_id, user_id, CASE WHEN event_id % 5 = 2 THEN event_type || '!' ELSE event_type END AS kind FROM events WHERE event_id % 5 <> 4""",
)
def _(spark, sf):
    events, source, path = table(spark, sf, "events"), scratch_path(spark, "sources"), scratch_path(spark, "cache")

    def put(part, rows):
        rows.write.mode("overwrite").parquet(f"{source}/part={part}")

    def build(paths):
        rows = spark.read.option("basePath", source).parquet(*paths)
        return rows.select("event_id", "user_id", F.col("event_type").alias("kind"), files.file_of_row().alias("source"))

    def current(parts):
        listed = files.list_files(spark, source).where(F.regexp_extract("path", r"part=(\d)", 1).isin(parts))
        return cache.cached(spark, path, cache.stamped(listed), build)

    for part in range(5):
        put(part, events.where(F.col("event_id") % 5 == part).repartition(2))
    current(["0", "1", "2", "3", "4"])
    put(2, events.where("event_id % 5 = 2").withColumn("event_type", F.concat("event_type", F.lit("!"))))
    return current(["0", "1", "2", "3"]).drop("source")  # part 2 changed, part 4 is gone


@query(
    "k12_bucket_cache",
    f"""SELECT idx, height, width, ratio AS closest_ratio, printf('%09d', l_orderkey) AS key
FROM ({bucketed_sql(SIZED_SQL, ASPECT_RATIO_512)})""",
)
def _(spark, sf):
    def build():
        cached = with_bucket(sized_lineitem(spark, sf), "height", "width")
        return cached.select(
            "idx", "height", "width", F.col("ratio").alias("closest_ratio"),
            F.format_string("%09d", F.col("l_orderkey")).alias("key"),
        )

    path = scratch_path(spark, "buckets")
    sinks.cached_table(spark, path, build)
    return sinks.cached_table(spark, path, build)
