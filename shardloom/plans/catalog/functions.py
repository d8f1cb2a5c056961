"""Registered queries: scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import annotations as ann
from ...functions import geometry as geo
from ...functions import names as nm
from ...functions import text as tx
from ...functions import vectors as vec
from ...functions.fixed_values import ASPECT_RATIO_512, ASPECT_RATIO_1024_TEST, VISIBLE_TEXT_PATTERN
from ...operators.buckets import with_bucket, with_resize
from .common import (
    SIZED_SQL,
    annotated_turns,
    ANNOTATED_SQL,
    bucketed_sql,
    query,
    ratio_table_sql,
    sized_lineitem,
    squeeze_sql,
    strip_sql,
    table,
)


@query(
    "f1_sample_keys",
    """SELECT doc_id, substr(printf('%08d', doc_id * 1000003), 1, 5) || '/img' || printf('%08d', doc_id * 1000003) || '.png' AS image_key,
  source || '-' || printf('%09d', doc_id) AS row_key FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", nm.image_key(F.col("doc_id") * 1000003).alias("image_key"),
        nm.row_key(F.col("source"), F.col("doc_id")).alias("row_key"),
    )


@query(
    "f2_hash_names",
    """SELECT page_id, sha256(url) AS sha, substr(sha256(url), 1, 8) AS short8, substr(sha256(url), 1, 16) AS short16,
  substr(translate(to_base64(unhex(sha256(url))), '+/', '-_'), 1, 16) AS urlsafe FROM pages""",
)
def _(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", F.sha2(url, 256).alias("sha"), nm.short_hash(url, 8).alias("short8"),
        nm.short_hash(url, 16).alias("short16"), nm.urlsafe_hash(url).alias("urlsafe"),
    )


FILENAME_SQL = "regexp_replace({0}, '^[.]+|[.]+$', '', 'g')"


@query(
    "f3_clean_filename_ascii",
    f"""SELECT doc_id, CASE WHEN n = '' THEN 'untitled' ELSE n END AS name FROM (SELECT doc_id,
  substr(lower(regexp_replace(replace({FILENAME_SQL.replace('{0}', strip_sql("regexp_replace(text, '[^ -~]', '', 'g')"))}, '/', '_'), '_{{2,}}', '_', 'g')), 1, 200) AS n FROM documents)""",
)
def _(spark, sf):
    ascii_text = F.regexp_replace("text", "[^ -~]", "")
    return table(spark, sf, "documents").select("doc_id", nm.clean_filename(ascii_text, fold=False).alias("name"))


@query("f3_clean_filename")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nm.clean_filename(F.col("text")).alias("name"))


FLAGGED_SQL = """SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' --ar ' || (item_id % 7 + 1) || ':' || (item_id % 5 + 1)
  WHEN 1 THEN ' --aspect_ratio ' || (item_id % 5 + 1) || ':' || (item_id % 9 + 1) || ' --ar 1:1'
  WHEN 2 THEN ' --hw ' || (item_id * 10 + 8) || ':' || (item_id * 4 + 8) ELSE '' END AS prompt FROM benchmark"""


def flagged_prompts(spark, sf):
    i = F.col("item_id")

    def flag(name, a, b):
        return F.concat(F.lit(f" --{name} "), a.cast("string"), F.lit(":"), b.cast("string"))

    flags = (
        F.when(i % 4 == 0, flag("ar", i % 7 + 1, i % 5 + 1))
        .when(i % 4 == 1, F.concat(flag("aspect_ratio", i % 5 + 1, i % 9 + 1), F.lit(" --ar 1:1")))
        .when(i % 4 == 2, flag("hw", i * 10 + 8, i * 4 + 8))
        .otherwise("")
    )
    return table(spark, sf, "benchmark").select("item_id", F.concat("text", flags).alias("prompt"))


PROMPT_FLAGS_SQL = rf"""WITH p AS (SELECT item_id, prompt,
  string_split(string_split(string_split(prompt, '--aspect_ratio')[1], '--ar')[1], '--hw')[1] AS clean,
  regexp_extract(prompt, '--aspect_ratio\s+(\d+:\d+)', 1) AS a, regexp_extract(prompt, '--ar\s+(\d+:\d+)', 1) AS b,
  regexp_extract(prompt, '--hw\s+(\d+:\d+)', 1) AS c FROM ({FLAGGED_SQL})),
q AS (SELECT *, CASE WHEN a <> '' THEN split_part(a, ':', 1)::DOUBLE / split_part(a, ':', 2)::DOUBLE
  WHEN b <> '' THEN split_part(b, ':', 1)::DOUBLE / split_part(b, ':', 2)::DOUBLE ELSE 1.0 END AS ar FROM p),
n AS (SELECT item_id, arg_min({{'ratio': ratio, 'h': h, 'w': w}}, {{'d': abs(r - ar), 'o': ordinal}}) AS s
  FROM q, {ratio_table_sql(ASPECT_RATIO_1024_TEST)} GROUP BY item_id)
SELECT item_id, clean, ar, s.ratio AS ratio, s.h::INTEGER AS bucket_h, s.w::INTEGER AS bucket_w,
  CASE WHEN c <> '' THEN split_part(c, ':', 1)::DOUBLE ELSE s.h END::DOUBLE AS out_h,
  CASE WHEN c <> '' THEN split_part(c, ':', 2)::DOUBLE ELSE s.w END::DOUBLE AS out_w FROM q JOIN n USING (item_id)"""


@query("f4_prompt_flags", PROMPT_FLAGS_SQL)
def _(spark, sf):
    prompt = F.col("prompt")
    rows = flagged_prompts(spark, sf).select("item_id", "prompt", tx.prompt_ratio(prompt).alias("ar"))
    near = rows.withColumn("b", geo.nearest_bucket(F.col("ar"), ASPECT_RATIO_1024_TEST)).withColumn("hw", tx.flag_pair(prompt, "hw"))
    entry = geo.bucket_entry(F.col("b"), ASPECT_RATIO_1024_TEST)
    return near.select(
        "item_id", tx.before_flags(prompt).alias("clean"), "ar", *[c.alias(n) for n, c in entry.items()],
        F.coalesce(F.col("hw")[0], entry["bucket_h"].cast("double")).alias("out_h"),
        F.coalesce(F.col("hw")[1], entry["bucket_w"].cast("double")).alias("out_w"),
    )


TARGET_SQL = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Please RENDER the exact visible text "' || lang || '" and "' || source || '" clearly in the image. ' || text
  WHEN 1 THEN 'render  the exact visible text ' || lang || ' sign clearly in the image' ELSE text END AS prompt FROM documents"""


@query(
    "f5_target_text",
    rf"""WITH p AS (SELECT doc_id, prompt, regexp_extract(prompt, '{VISIBLE_TEXT_PATTERN}', 1) AS m FROM ({TARGET_SQL}))
SELECT doc_id, CASE WHEN m = '' THEN prompt WHEN len(regexp_extract_all(m, '"([^"]*)"', 1)) > 0
  THEN array_to_string(regexp_extract_all(m, '"([^"]*)"', 1), ' | ') ELSE {strip_sql('m')} END AS target FROM p""",
)
def _(spark, sf):
    d = F.col("doc_id")
    quoted = F.concat(
        F.lit('Please RENDER the exact visible text "'), F.col("lang"), F.lit('" and "'), F.col("source"),
        F.lit('" clearly in the image. '), F.col("text"),
    )
    bare = F.concat(F.lit("render  the exact visible text "), F.col("lang"), F.lit(" sign clearly in the image"))
    prompt = F.when(d % 3 == 0, quoted).when(d % 3 == 1, bare).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", prompt.alias("prompt")).select(
        "doc_id", tx.target_text(F.col("prompt")).alias("target")
    )


@query(
    "f6_url_dir_merge",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '([?#].*)$', 1) AS tail FROM pages)
SELECT page_id, root || regexp_replace(regexp_replace(path, '[^/]*$', ''), '(.)/+$', '\1') || tail AS dir,
  root || regexp_replace(path, '/+$', '') || '/shards/a.tar?v=1' AS merged,
  root || regexp_replace(regexp_replace(path, '/+$', ''), '/[^/]*$', '') || '/b.tar' AS sibling,
  root || '/abs/c.tar' AS absolute, 's3://bucket/d.tar' AS other FROM p""",
)
def _(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", nm.url_dir(url).alias("dir"),
        nm.url_merge(url, F.lit("shards/./x/../a.tar?v=1")).alias("merged"),
        nm.url_merge(url, F.lit("../b.tar")).alias("sibling"),
        nm.url_merge(url, F.lit("/abs/c.tar")).alias("absolute"),
        nm.url_merge(url, F.lit("s3://bucket/d.tar")).alias("other"),
    )


@query(
    "f7_split_names",
    r"""WITH p AS (SELECT page_id, 'set/v1.2/page-' || page_id || CASE page_id % 3 WHEN 0 THEN '.tar' WHEN 1 THEN '.html.gz' ELSE '' END AS name FROM pages)
SELECT page_id, regexp_replace(name, '\.(tar|gz)$', '') AS key, regexp_extract(name, '(\.(tar|gz))$', 1) AS ext, 'v1.2' AS parent,
  CASE page_id % 3 WHEN 1 THEN 'page-' || page_id || '.html.gz' ELSE 'page' END AS prefix FROM p""",
)
def _(spark, sf):
    i = F.col("page_id")
    tail = F.when(i % 3 == 0, ".tar").when(i % 3 == 1, ".html.gz").otherwise("")
    name = F.concat(F.lit("set/v1.2/page-"), i.cast("string"), tail)
    rows = table(spark, sf, "pages").select("page_id", name.alias("name"))
    key, ext = nm.split_name(F.col("name"))
    return rows.select(
        "page_id", key.alias("key"), ext.alias("ext"), nm.parent_dir(F.col("name")).alias("parent"),
        nm.shard_prefix(F.col("name")).alias("prefix"),
    )


@query(
    "f8_durations",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN -value ELSE value * 500 END AS s FROM events)
SELECT event_id, CASE WHEN s IS NULL OR s < 0 THEN '--:--:--' ELSE printf('%02d:%02d:%02d', floor(s)::BIGINT // 3600, floor(s)::BIGINT % 3600 // 60, floor(s)::BIGINT % 60) END AS eta FROM e""",
)
def _(spark, sf):
    kind = F.col("event_type")
    seconds = F.when(kind == "error", None).when(kind == "view", -F.col("value")).otherwise(F.col("value") * 500)
    return table(spark, sf, "events").select("event_id", nm.format_duration(seconds).alias("eta"))


@query(
    "f9_bucket_resize",
    f"""SELECT idx, rh AS resize_h, rw AS resize_w, round_even((rh - bucket_h) / 2, 0)::INTEGER AS crop_top,
  round_even((rw - bucket_w) / 2, 0)::INTEGER AS crop_left FROM (
SELECT *, CASE WHEN (height = bucket_h AND width = bucket_w) OR bucket_h / height > bucket_w / width THEN bucket_h
    ELSE trunc(height::DOUBLE * bucket_w / width)::INTEGER END AS rh,
  CASE WHEN (height = bucket_h AND width = bucket_w) THEN bucket_w WHEN bucket_h / height > bucket_w / width
    THEN trunc(width::DOUBLE * bucket_h / height)::INTEGER ELSE bucket_w END AS rw
FROM ({bucketed_sql(SIZED_SQL, ASPECT_RATIO_512)}))""",
)
def _(spark, sf):
    rows = with_resize(with_bucket(sized_lineitem(spark, sf), "height", "width"), "height", "width")
    return rows.select("idx", "resize_h", "resize_w", "crop_top", "crop_left")


@query(
    "f10_halve_scale_crop",
    f"""WITH RECURSIVE s AS (SELECT DISTINCT height * 37 AS h, width * 41 AS w FROM ({SIZED_SQL})),
r AS (SELECT h, w, h AS ch, w AS cw, 0 AS k FROM s UNION ALL
  SELECT h, w, ch // 2, cw // 2, k + 1 FROM r WHERE least(ch, cw) >= 512),
f AS (SELECT h, w, arg_max(ch, k) AS ch, arg_max(cw, k) AS cw, max(k)::INTEGER AS halvings FROM r GROUP BY h, w),
t AS (SELECT *, round_even(cw * (256::DOUBLE / least(ch, cw)), 0)::INTEGER AS scaled_w, round_even(ch * (256::DOUBLE / least(ch, cw)), 0)::INTEGER AS scaled_h FROM f)
SELECT idx, halvings, scaled_w, scaled_h, (scaled_w - 256) // 2 AS crop_x, (scaled_h - 256) // 2 AS crop_y
FROM ({SIZED_SQL}) l JOIN t ON t.h = l.height * 37 AND t.w = l.width * 41""",
)
def _(spark, sf):
    rows = sized_lineitem(spark, sf)
    parts = geo.halve_scale_crop(F.col("width") * 41, F.col("height") * 37, 256)
    return rows.select("idx", *[c.alias(n) for n, c in parts.items()])


@query(
    "f11_fit_envelope",
    f"""WITH s AS (SELECT idx, width * 41 AS w, height * 37 AS h FROM ({SIZED_SQL})),
t AS (SELECT *, least(1.0, 960::DOUBLE / w, 480::DOUBLE / h) AS scale FROM s)
SELECT idx, greatest(32, floor(w * scale / 32)::INTEGER * 32) AS fit_w, greatest(32, floor(h * scale / 32)::INTEGER * 32) AS fit_h FROM t""",
)
def _(spark, sf):
    w, h = geo.fit_envelope(F.col("width") * 41, F.col("height") * 37, 960, 480, 32)
    return sized_lineitem(spark, sf).select("idx", w.alias("fit_w"), h.alias("fit_h"))


@query(
    "f12_range_maps",
    """SELECT vec_id, array_to_string(list_transform(e, lambda x: trunc(least(greatest((x * 4 + 1) * 127.5::DOUBLE + 0.5, 0), 255))::INTEGER), ',') AS rounded,
  array_to_string(list_transform(e, lambda x: trunc((least(greatest(x * 4, -1), 1) + 1) * 127.5::DOUBLE + 0.5)::INTEGER), ',') AS clipped,
  array_to_string(list_transform(e, lambda x: trunc(least(greatest(x * 4 * 127.5::DOUBLE + 128, 0), 255))::INTEGER), ',') AS shifted,
  round(list_sum(list_transform(e, lambda x: (trunc(least(greatest((x * 4 + 1) * 127.5::DOUBLE + 0.5, 0), 255)) / 255 - 0.5) / 0.5)), 6) AS signed_sum
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("e"))
    pixels = vec.to_uint8_round(F.col("e"))
    signed = F.aggregate(vec.to_signed(pixels), F.lit(0.0), lambda acc, v: acc + v)

    def text(values):
        return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")

    return rows.select(
        "vec_id", text(pixels).alias("rounded"), text(vec.to_uint8_clip_first(F.col("e"))).alias("clipped"),
        text(vec.to_uint8_shift(F.col("e"))).alias("shifted"), F.round(signed, 6).alias("signed_sum"),
    )


@query(
    "f13_token_window",
    f"""WITH t AS (SELECT doc_id, list_filter(string_split({squeeze_sql('text')}, ' '), lambda w: w <> '') AS ids FROM documents),
p AS (SELECT doc_id, list_slice(list_concat(ids, list_transform(range(48), lambda i: '<pad>')), 1, 48) AS ids, least(len(ids), 48) AS n FROM t)
SELECT doc_id, array_to_string(list_concat(list_slice(ids, 1, 1), list_slice(ids, 18, 48)), ' ') AS tokens,
  (CASE WHEN n >= 1 THEN 1 ELSE 0 END + greatest(n - 17, 0))::BIGINT AS real_tokens FROM p""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("ids"))
    window, mask = tx.token_window(F.col("ids"), 18, 32, "<pad>")
    real = F.aggregate(mask, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return rows.select("doc_id", F.array_join(window, " ").alias("tokens"), real.alias("real_tokens"))


@query(
    "f14_feature_padding",
    """WITH e AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 1 + vec_id % 64) AS v FROM embeddings)
SELECT vec_id, 80 AS length, round(list_sum(v) + (80 - len(v)) * v[len(v)], 6) AS total, len(v)::BIGINT AS real_entries FROM e""",
)
def _(spark, sf):
    cut = F.slice("embedding", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform(cut, lambda x: x.cast("double")).alias("v"))
    padded, mask = vec.pad_last(F.col("v"), 80)
    total = F.aggregate(padded, F.lit(0.0), lambda acc, v: acc + v)
    real = F.aggregate(mask, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return rows.select("vec_id", F.size(padded).alias("length"), F.round(total, 6).alias("total"), real.alias("real_entries"))


@query(
    "f15_json_records",
    """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"user_id":' || user_id || '}' AS record,
  json_extract_string(props, '$.k')::BIGINT AS k FROM events""",
)
def _(spark, sf):
    from ...sources.sinks import stats_lines

    events = table(spark, sf, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    lines = stats_lines(events.select("user_id", "event_id", "k", "event_type"))
    back = F.from_json("line", "event_id bigint, k bigint")
    return lines.select(back["event_id"].alias("event_id"), F.col("line").alias("record"), back["k"].alias("k"))


NAMED_SQL = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'epoch_' || o_custkey % 50 || '_step_' || o_orderkey || '.pth'
  WHEN 1 THEN 'epoch=' || o_custkey % 50 || '-step=' || o_orderkey || '.ckpt' ELSE 'model-' || o_orderkey END AS name FROM orders"""


@query(
    "f16_name_fields",
    rf"""SELECT o_orderkey, coalesce(nullif(regexp_extract(name, 'epoch[_=](\d+)', 1), ''), 'unknown') AS epoch,
  coalesce(nullif(regexp_extract(name, 'step[_=](\d+)', 1), ''), 'unknown') AS step FROM ({NAMED_SQL})""",
)
def _(spark, sf):
    k, e = F.col("o_orderkey"), (F.col("o_custkey") % 50).cast("string")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("epoch_"), e, F.lit("_step_"), k.cast("string"), F.lit(".pth")))
        .when(k % 4 == 1, F.concat(F.lit("epoch="), e, F.lit("-step="), k.cast("string"), F.lit(".ckpt")))
        .otherwise(F.concat(F.lit("model-"), k.cast("string")))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", name.alias("name"))
    return rows.select(
        "o_orderkey", nm.name_field(F.col("name"), r"epoch[_=](\d+)").alias("epoch"),
        nm.name_field(F.col("name"), r"step[_=](\d+)").alias("step"),
    )


@query(
    "f17_timestamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS utc, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS tokyo FROM events""",
)
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", nm.iso_utc(ts).alias("utc"), nm.zone_time(ts, "Asia/Tokyo").alias("tokyo")
    )


@query(
    "f18_polygon_centre",
    f"""SELECT conv_id, turn, (a.i)::INTEGER AS pos, a.y::DOUBLE AS y, a.x::DOUBLE AS x
FROM (SELECT conv_id, turn, unnest(annotations) AS a FROM ({ANNOTATED_SQL}))""",
)
def _(spark, sf):
    rows = annotated_turns(spark, sf).select("conv_id", "turn", F.posexplode("annotations").alias("pos", "a"))
    y, x = ann.centre(F.col("a.polygon"))
    return rows.select("conv_id", "turn", "pos", y.cast("double").alias("y"), x.cast("double").alias("x"))


@query(
    "f19_norm_cosine",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm,
  round(list_cosine_similarity(e, list_reverse(e)), 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def _(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(vec.norm(e), 6).alias("norm"), F.round(vec.cosine(e, F.reverse(e)), 6).alias("cosine")
    )


@query("f20_output_names", "SELECT doc_id, substr(text, 1, 100) || '.jpg' AS name FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nm.output_name(F.col("text")).alias("name"))


@query(
    "f21_list_literal",
    """SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN lang || '|' || source ELSE lang END AS paths, CASE doc_id % 2 WHEN 0 THEN 2 ELSE 1 END::INTEGER AS n FROM documents""",
)
def _(spark, sf):
    literal = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), "lang", F.lit(" ,  "), "source", F.lit("]"))).otherwise(F.col("lang"))
    rows = table(spark, sf, "documents").select("doc_id", tx.list_literal(literal).alias("p"))
    return rows.select("doc_id", F.array_join("p", "|").alias("paths"), F.size("p").alias("n"))
