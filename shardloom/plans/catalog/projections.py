"""Registered queries: projections, filters, predicates (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import annotations as ann
from ...functions import text as tx
from ...functions.fixed_values import TEXT_TEMPLATE_HEAD, TEXT_TEMPLATE_TAIL
from ...functions.binding import with_value_where
from ...functions.image_header import image_header
from ...functions.hashing import uniform
from ...functions.names import file_extension
from ...operators import sampling
from ...operators.joins import caption_or_default
from ...operators.worklist import parse_class_counts
from ...session import scratch_path
from ...sources.tar import keep_sample_members, read_members
from .. import convert as conversion
from ..training_slice import prepare_samples
from .common import (
    ANNOTATED_SQL,
    annotated_turns,
    bucketed_sql,
    query,
    squeeze_sql,
    strip_sql,
    table,
    uniform_sql,
)
from ...functions.fixed_values import ASPECT_RATIO_512

CLEAN_SQL = squeeze_sql("replace(coalesce({0}, ''), '*', ' ')")
BLANK_FREE = r"regexp_matches({0}, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')"


def blank_free(x: str) -> str:
    return BLANK_FREE.replace("{0}", x)


def clean_sql(x: str) -> str:
    return squeeze_sql(f"replace(coalesce({x}, ''), '*', ' ')")


def prompt_sql(clean: str, texts: str) -> str:
    quoted = f"list_transform({texts}, lambda q: '\"' || q || '\"')"
    n = f"len({texts})"
    return f"""CASE WHEN {n} = 0 THEN {clean} ELSE rtrim({clean}, ' .') || ', with ' || CASE
  WHEN {n} = 1 THEN 'the visible word ' || ({quoted})[1]
  WHEN {n} = 2 THEN 'the visible words ' || ({quoted})[1] || ' and ' || ({quoted})[2]
  ELSE 'the visible words ' || array_to_string(list_slice({quoted}, 1, {n} - 1), ', ') || ', and ' || ({quoted})[{n}]
  END || ' clearly rendered in the image.' END"""


TEXTS_SQL = f"""list_transform(list_filter(annotations, lambda a: coalesce(a.valid, true) AND {blank_free('a.text')}),
  lambda a: {squeeze_sql('a.text')})"""

# Documents as images: the caption is the text, each line an annotation.
SLICE_SQL = f"""SELECT doc_id, clean, texts, (n_chars % 97 + 1)::INTEGER AS height, (doc_id % 89 + 1)::INTEGER AS width FROM (
  SELECT doc_id, n_chars, {clean_sql('text')} AS clean,
    list_filter(list_transform(string_split(text, chr(10)), lambda t, i: CASE WHEN (i - 1) % 3 <> 1 THEN {squeeze_sql('t')} END),
      lambda t: t IS NOT NULL AND t <> '') AS texts
  FROM documents) WHERE doc_id NOT IN (SELECT item_id * 3 FROM benchmark)"""


def slice_rows(spark, sf):
    docs = table(spark, sf, "documents")
    annotations = F.transform(
        F.split("text", "\n"),
        lambda t, i: F.struct(
            F.lit(None).cast("array<array<float>>").alias("polygon"), t.alias("text"), (i % 3 != 1).alias("valid"),
            F.lit(None).cast("double").alias("rec_score"),
        ),
    )
    return docs.select(
        "doc_id", F.col("text").alias("caption"), annotations.alias("annotations"),
        (F.col("n_chars") % 97 + 1).cast("int").alias("height"), (F.col("doc_id") % 89 + 1).cast("int").alias("width"),
    )


def slice_samples(spark, sf):
    held_out = table(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    return prepare_samples(slice_rows(spark, sf), held_out, "doc_id", shard_size=100)


@query(
    "flagship_training_slice",
    f"""SELECT doc_id // 100 AS shard_no, ratio, count(*) AS samples, sum(length({prompt_sql('clean', 'texts')}))::BIGINT AS prompt_chars
FROM ({bucketed_sql(SLICE_SQL, ASPECT_RATIO_512)}) GROUP BY ALL""",
)
def _(spark, sf):
    samples = slice_samples(spark, sf)
    return samples.groupBy("shard_no", "ratio").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.length("prompt")).alias("prompt_chars")
    )


@query(
    "flagship_prepared_samples",
    f"""SELECT doc_id, printf('captions-%09d', doc_id) AS key, doc_id // 100 AS shard_no, ratio, md5({prompt_sql('clean', 'texts')}) AS prompt_md5
FROM ({bucketed_sql(SLICE_SQL, ASPECT_RATIO_512)})""",
)
def _(spark, sf):
    return slice_samples(spark, sf).select("doc_id", "key", "shard_no", "ratio", F.md5("prompt").alias("prompt_md5"))


def staged_images(spark, sf):
    """Documents as image rows: a JPEG header of the right size as payload, lines as annotations."""
    rows = slice_rows(spark, sf)
    sizes = F.concat(F.lpad(F.hex("height"), 4, "0"), F.lpad(F.hex("width"), 4, "0"))
    payload = F.unhex(F.concat(F.lit("FFD8FFC0001108"), sizes, F.lit("03000000000000000000FFD9")))
    return rows.select(
        F.struct(payload.alias("bytes"), F.col("doc_id").cast("string").alias("path")).alias("image"), "caption",
        "annotations", F.col("width").alias("image_width"), F.col("height").alias("image_height"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("img_name"),
    )


@query(
    "flagship_conversion",
    """SELECT count(*) AS "rows", count(*) AS samples, true AS complete, 0::BIGINT AS violations, count(DISTINCT doc_id)::BIGINT AS prompts FROM documents""",
)
def _(spark, sf):
    source, output = scratch_path(spark, "images"), scratch_path(spark, "converted")
    staged_images(spark, sf).write.option("compression", "zstd").parquet(source)
    done = conversion.convert(spark, source, output, shard_size=500)
    members = read_members(spark, f"{output}/shards", extensions="json")
    prompt = F.get_json_object(F.decode("content", "UTF-8"), "$.prompt")
    shards = spark.read.parquet(f"{output}/shard-list").select(F.sum("nsamples")).scalar()
    found = conversion.verify(spark, output).select(F.count(F.lit(1))).scalar()
    return done.agg(
        F.sum("rows").alias("rows"), shards.alias("samples"), F.bool_and(F.col("status") == "complete").alias("complete"),
        found.alias("violations"), members.select(F.count(prompt)).scalar().alias("prompts"),
    )


@query("p1_caption_clean", f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_caption(F.col("text")).alias("clean"))


@query(
    "p2_visible_text_prompt",
    f"""SELECT conv_id, turn, {prompt_sql('clean', 'texts')} AS prompt, clean, array_to_string(texts, '|') AS texts FROM (
SELECT img.conv_id, img.turn, {clean_sql('d.text')} AS clean, {TEXTS_SQL} AS texts
FROM ({ANNOTATED_SQL}) img LEFT JOIN documents d ON d.doc_id = img.conv_id)""",
)
def _(spark, sf):
    turns = annotated_turns(spark, sf).drop("text")
    captions = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    joined = turns.join(captions, "conv_id", "left")
    texts = ann.prompt_texts(ann.normalise(F.col("annotations")))
    rows = joined.select("conv_id", "turn", tx.clean_caption(F.col("text")).alias("clean"), texts.alias("t"))
    return rows.select(
        "conv_id", "turn", tx.visible_text_prompt(F.col("clean"), F.col("t")).alias("prompt"), "clean",
        F.array_join("t", "|").alias("texts"),
    )


@query("p3_normalise_line", f"SELECT doc_id, {squeeze_sql('text')} AS line FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.squeeze(F.col("text")).alias("line"))


@query(
    "p4_annotation_normalise",
    f"""SELECT conv_id, turn, len(annotations)::INTEGER AS entries,
  len(list_filter(annotations, lambda a: isinf(a.y)))::INTEGER AS without_polygon FROM ({ANNOTATED_SQL})""",
)
def _(spark, sf):
    fixed = annotated_turns(spark, sf).withColumn("annotations", ann.normalise(F.col("annotations")))
    empty = F.filter("annotations", lambda a: F.size(a["polygon"]) == 0)
    return fixed.select(
        "conv_id", "turn", F.size("annotations").alias("entries"), F.size(empty).alias("without_polygon")
    )


@query(
    "p5_annotation_validity",
    f"""SELECT conv_id, turn, len(list_filter(annotations, lambda a: coalesce(a.valid, true)))::INTEGER AS for_prompt,
  len(list_filter(annotations, lambda a: coalesce(a.valid, false)))::INTEGER AS for_transcript FROM ({ANNOTATED_SQL})""",
)
def _(spark, sf):
    return annotated_turns(spark, sf).select(
        "conv_id", "turn",
        F.size(F.filter("annotations", lambda a: F.coalesce(a["valid"], F.lit(True)))).alias("for_prompt"),
        F.size(F.filter("annotations", ann.keep_valid)).alias("for_transcript"),
    )


@query(
    "p6_score_filter",
    f"""SELECT conv_id, turn, len(list_filter(annotations, lambda a: coalesce(a.rec_score, 1.0) >= 0.5 AND {blank_free('a.text')}))::INTEGER AS kept
FROM ({ANNOTATED_SQL})""",
)
def _(spark, sf):
    entries = ann.reading_entries(F.col("annotations"), ann.keep_all, 0.5)
    return annotated_turns(spark, sf).select("conv_id", "turn", F.size(entries).alias("kept"))


ENTRIES_SQL = f"""list_sort(list_transform(list_filter(annotations, lambda a: coalesce(a.valid, false)
  AND coalesce(a.rec_score, 1.0) >= 0.2 AND {blank_free('a.text')}), lambda a: {{'y': a.y, 'x': a.x, 'i': a.i, 't': {strip_sql('a.text')}}}))"""


@query(
    "p7_transcript",
    f"""SELECT conv_id, turn, CASE WHEN len(e) > 0 THEN array_to_string(list_transform(e, lambda s: s.t), chr(10))
  WHEN n > 0 THEN '' ELSE role END AS transcript
FROM (SELECT conv_id, turn, role, len(annotations) AS n, {ENTRIES_SQL} AS e FROM ({ANNOTATED_SQL}))""",
)
def _(spark, sf):
    turns = annotated_turns(spark, sf)
    line = ann.transcript(F.col("annotations"), F.array(F.col("role"), F.lit(" ")), ann.keep_valid, 0.2)
    return turns.select("conv_id", "turn", line.alias("transcript"))


@query(
    "p8_size_check",
    """SELECT p_partkey, p_size * 16 AS width, p_size * 12 AS height,
  CASE WHEN p_partkey % 11 = 0 THEN 'width disagrees' WHEN p_partkey % 13 = 0 THEN 'height disagrees' END AS reject FROM part""",
)
def _(spark, sf):
    parts = table(spark, sf, "part")
    w, h = F.col("p_size") * 16, F.col("p_size") * 12
    # The first bytes of a PNG: signature, header chunk, width, height.
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(h), 8, "0")))
    rows = parts.select(
        "p_partkey", image_header(png).alias("actual"),
        F.when(F.col("p_partkey") % 7 != 0, F.when(F.col("p_partkey") % 11 == 0, w + 1).otherwise(w)).alias("declared_w"),
        F.when(F.col("p_partkey") % 13 == 0, h + 1).otherwise(h).alias("declared_h"),
    ).withColumn("declared_w", F.when(F.col("p_partkey") % 11 == 0, F.col("actual.width") + 1).otherwise(F.col("declared_w")))
    reject = (
        F.when(F.col("actual.error").isNotNull(), F.col("actual.error"))
        .when(F.col("declared_w") != F.col("actual.width"), "width disagrees")
        .when(F.col("declared_h") != F.col("actual.height"), "height disagrees")
    )
    return rows.select(
        "p_partkey", F.col("actual.width").alias("width"), F.col("actual.height").alias("height"), reject.alias("reject")
    )


@query(
    "p9_reject_capture",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE trunc(value)::INTEGER END AS value,
  CASE WHEN event_type = 'error' THEN 'cannot decode' END AS error FROM events""",
)
def _(spark, sf):
    whole = F.col("value").cast("int").cast("string")
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), whole)).otherwise(whole)
    value = raw.try_cast("int")
    return table(spark, sf, "events").select(
        "event_id", value.alias("value"), F.when(value.isNull(), "cannot decode").alias("error")
    )


@query(
    "p10_extension_filter",
    r"""SELECT page_id, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
WHERE lower(regexp_extract(path, '(\.[^./]*)$', 1)) IN ('.html', '.htm')""",
)
def _(spark, sf):
    path = F.parse_url(F.col("url"), F.lit("PATH"))
    ext = file_extension(path)
    return table(spark, sf, "pages").select("page_id", ext.alias("ext")).where(F.col("ext").isin(".html", ".htm"))


@query(
    "p11_quality_version",
    """SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE CASE l.quality WHEN 1 THEN 'high_quality' WHEN 0 THEN 'low_quality' ELSE 'others' END = 'high_quality'""",
)
def _(spark, sf):
    version = F.when(F.col("quality") == 1, "high_quality").when(F.col("quality") == 0, "low_quality")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    versions = table(spark, sf, "labels").select("doc_id", version.alias("version"))
    joined = docs.join(versions, "doc_id", "left").withColumn("version", F.coalesce("version", F.lit("others")))
    return joined.where("version = 'high_quality'").select("doc_id", "lang")


SHORT_LINES_SQL = f"""list_filter(list_transform(string_split(text, chr(10)), lambda t: {squeeze_sql('t')}),
  lambda t: t <> '' AND length(t) < 40)"""


def short_lines(text):
    lines = F.transform(F.split(text, "\n"), tx.squeeze)
    return F.filter(lines, lambda t: (F.length(t) > 0) & (F.length(t) < 40))


@query(
    "p12_eligible_samples",
    f"""SELECT doc_id, array_to_string({SHORT_LINES_SQL}, ' ') AS visible_text FROM documents
WHERE {squeeze_sql('text')} <> '' AND array_to_string({SHORT_LINES_SQL}, ' ') <> ''""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").where(F.regexp_like("text", F.lit(f"[^{tx.SPACE[1:]}")))
    shown = F.array_join(short_lines("text"), " ")
    return with_value_where(docs, "visible_text", shown, lambda v: F.length(v) > 0).select("doc_id", "visible_text")


@query(
    "p13_class_requests",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'signup' THEN '0' || user_id WHEN 'view' THEN 'cat' ELSE (user_id * 7)::VARCHAR END AS raw_id,
  trunc(value)::BIGINT - 20 AS c FROM events),
j AS (SELECT *, CASE WHEN NOT regexp_matches(raw_id, '^(0|[1-9][0-9]*)$') THEN 'invalid class id' WHEN c <= 0 THEN 'invalid count'
  WHEN raw_id::BIGINT > 999 THEN 'class id out of range' END AS reject FROM r)
SELECT event_id, raw_id, CASE WHEN reject IS NULL THEN raw_id::BIGINT END AS class_id, CASE WHEN reject IS NULL THEN c END AS n, reject FROM j""",
)
def _(spark, sf):
    user = F.col("user_id")
    raw = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("0"), user.cast("string")))
        .when(F.col("event_type") == "view", "cat")
        .otherwise((user * 7).cast("string"))
    )
    text = F.to_json(F.create_map(raw, F.col("value").cast("bigint") - 20))
    requests = table(spark, sf, "events").select("event_id", text.alias("request"))
    return parse_class_counts(requests, "request", ["event_id"])


@query(
    "p14_label_dropout",
    f"""SELECT vec_id, CASE WHEN {uniform_sql(7, 'vec_id')} < 0.1 THEN 1000 ELSE label END::INTEGER AS label FROM embeddings""",
)
def _(spark, sf):
    label = sampling.drop_label(F.col("label"), 0.1, 1000, 7, F.col("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", label.alias("label"))


@query(
    "p15_supervision_pick",
    f"""SELECT vec_id, batch FROM (SELECT vec_id, vec_id // 50 AS batch,
  row_number() OVER (PARTITION BY vec_id // 50 ORDER BY {uniform_sql('9pick', 'vec_id')}, vec_id) AS r
FROM embeddings WHERE {uniform_sql('noise', 'vec_id')} <= 0.6 AND label <> 9 AND {uniform_sql(9, 'vec_id')} < 0.7) WHERE r <= 8""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.expr("vec_id div 50").alias("batch"))
    noise = uniform("noise", F.col("vec_id"))
    picked = sampling.select_supervised(vectors, "batch", "vec_id", noise, 0.6, F.col("label") == 9, 0.7, 8, 9)
    return picked.select("vec_id", "batch")


@query(
    "p16_token_length",
    f"""SELECT doc_id, n_tokens FROM (SELECT doc_id, (len(string_split({squeeze_sql('text')}, ' ')) + 2)::INTEGER AS n_tokens,
  {squeeze_sql('text')} AS line FROM documents) WHERE line <> '' AND n_tokens <= 256""",
)
def _(spark, sf):
    n = F.size(tx.tokens(F.col("text"))) + 2
    docs = with_value_where(table(spark, sf, "documents"), "n_tokens", n, lambda v: v.between(3, 256))
    return docs.select("doc_id", "n_tokens")


@query(
    "p17_caption_fallback",
    """SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN coalesce(CASE WHEN lang <> 'en' THEN lang END, '') ELSE text END AS caption FROM documents""",
)
def _(spark, sf):
    fields = F.create_map(F.lit("prompt"), F.col("text"), F.lit("short"), F.when(F.col("lang") != "en", F.col("lang")))
    kind = F.when(F.col("source").isin("src0", "src1", "src2"), "short").otherwise("missing")
    return table(spark, sf, "documents").select("doc_id", caption_or_default(fields, kind).alias("caption"))


@query(
    "p18_template_pairs",
    f"""SELECT doc_id, u.slot::INTEGER AS slot, CASE u.slot WHEN 0 THEN {squeeze_sql('text')}
  ELSE '{TEXT_TEMPLATE_HEAD.replace("'", "''")}' || {squeeze_sql('string_split(text, chr(10))[1]')} || '{TEXT_TEMPLATE_TAIL.replace("'", "''")}' END AS line
FROM documents, (VALUES (0), (1)) u(slot)""",
)
def _(spark, sf):
    text = F.col("text")
    pair = F.array(tx.squeeze(text), tx.template_prompt(tx.squeeze(F.element_at(F.split(text, "\n"), 1))))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(pair).alias("slot", "line"))


CHI = ["Enhance the prompt.", "Keep the meaning.", "User Prompt: "]


@query(
    "p19_system_prefix",
    "SELECT item_id, '" + "' || chr(10) || '".join(CHI) + "' || text AS prompt FROM benchmark",
)
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.with_prefix(F.col("text"), CHI).alias("prompt"))


@query(
    "p20_member_filter",
    """SELECT page_id, page_id::VARCHAR || '.html' AS name FROM pages""",
)
def _(spark, sf):
    number = F.col("page_id").cast("string")
    names = F.array(
        F.concat(number, F.lit(".html")), F.concat(F.lit("PaxHeader/"), number, F.lit(".html")),
        F.concat(F.lit("plain"), number), F.lit(""), F.lit("."),
    )
    members = table(spark, sf, "pages").select("page_id", F.explode(names).alias("name"))
    return keep_sample_members(members)
