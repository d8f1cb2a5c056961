"""Registered queries: incremental and stateful processing (X), extension points (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.fixed_values import ASPECT_RATIO_1024, ASPECT_RATIO_1024_TEST
from ...functions.names import image_key
from ...operators import extensions, metrics
from ...operators.index import positions
from ...session import scratch_path
from ...sources import tar
from ...streaming import batcher, incremental, multi_sink, watch
from ...streaming import metrics as live
from .. import registry
from .common import SIZED_SQL, bucketed_sql, query, sized_lineitem, squeeze_sql, table
from .functions import PROMPT_FLAGS_SQL, flagged_prompts
from .sources import PAGE_MEMBERS_SQL, _base, page_shards
from .summaries import METRICS_SQL, event_metrics


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return incremental.open_stream(spark, f"{sf}/events.parquet", "*.parquet", schema)


def convert_events(stream):
    """Events as conversion input: a broken payload is skipped but keeps its index."""
    good = stream.where(F.col("event_type") != "error")
    return good.select(
        image_key(F.col("event_id")).alias("key"), F.col("user_id").alias("label"), F.round("value", 2).alias("value")
    )


CONVERTED_SQL = """SELECT substr(printf('%08d', event_id), 1, 5) || '/img' || printf('%08d', event_id) || '.png' AS key, user_id AS label, round(value, 2) AS value FROM events WHERE event_type <> 'error'"""


@query("x1_resumable_conversion", CONVERTED_SQL)
def _(spark, sf):
    out, state = scratch_path(spark, "converted"), scratch_path(spark, "state")
    return incremental.convert(event_stream(spark, sf), out, state, {"resolution": 256}, convert_events)


def event_sinks():
    """Images stay as they came first, labels are replaced, broken payloads are listed with their reason."""
    key = image_key(F.expr("event_id div 3"))
    sound = F.col("event_type") != "error"
    return [
        multi_sink.Sink(
            "images", lambda e: e.where(sound).select(key.alias("key"), "event_id", F.round("value", 2).alias("payload")),
            ("key",), ("event_id",), "first",
        ),
        multi_sink.Sink(
            "labels", lambda e: e.where(sound).select(key.alias("key"), "event_id", F.col("user_id").alias("label")),
            ("key",), ("event_id",), "last",
        ),
        multi_sink.Sink("rejects", lambda e: e.where(~sound).select("event_id", F.concat(F.lit("broken payload of "), key).alias("reason"))),
    ]


EVENT_KEY_SQL = """substr(printf('%08d', event_id // 3), 1, 5) || '/img' || printf('%08d', event_id // 3) || '.png'"""


@query(
    "x1_stream_to_sinks",
    f"""WITH e AS (SELECT *, {EVENT_KEY_SQL} AS key FROM events)
SELECT 'image' AS kind, key, min(event_id) AS event_id, round(arg_min(value, event_id), 2)::VARCHAR AS value FROM e WHERE event_type <> 'error' GROUP BY key
UNION ALL SELECT 'label', key, max(event_id), arg_max(user_id, event_id)::VARCHAR FROM e WHERE event_type <> 'error' GROUP BY key
UNION ALL SELECT 'reject', NULL, event_id, 'broken payload of ' || key FROM e WHERE event_type = 'error'""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    folder, out, state = (scratch_path(spark, n) for n in ("events", "sinks", "state"))
    events.repartitionByRange(4, "event_id").write.parquet(folder)
    stream = incremental.open_stream(spark, folder, "*.parquet", events.schema, files_per_batch=2)
    found = multi_sink.convert(stream, out, state, {"resolution": 256}, event_sinks())
    label = found["labels"].select(F.lit("label").alias("kind"), "key", "event_id", F.col("label").cast("string").alias("value"))
    image = found["images"].select(F.lit("image").alias("kind"), "key", "event_id", F.col("payload").cast("string").alias("value"))
    reject = found["rejects"].select(F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("key"), "event_id", F.col("reason").alias("value"))
    return image.unionByName(label).unionByName(reject)


@query("x2_incremental_skip", f"SELECT label, count(*) AS samples FROM ({CONVERTED_SQL}) GROUP BY label")
def _(spark, sf):
    out, state = scratch_path(spark, "converted"), scratch_path(spark, "state")
    config = {"resolution": 256}
    incremental.convert(event_stream(spark, sf), out, state, config, convert_events, (f"{sf}/events.parquet", "*.parquet"))
    # The second run finds every input in the checkpoint and adds nothing.
    again = incremental.convert(event_stream(spark, sf), out, state, config, convert_events, (f"{sf}/events.parquet", "*.parquet"))
    return again.groupBy("label").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "x3_stateful_batches",
    """SELECT rank, bucket, pos // 8 AS batch_no, min(event_id) AS first_index, max(event_id) AS last_index, string_agg(event_id, ',' ORDER BY event_id) AS members, count(*) = 8 AS "full" FROM (
SELECT event_id // 2500 AS rank, event_type AS bucket, event_id, row_number() OVER w - 1 AS pos
FROM events WINDOW w AS (PARTITION BY event_id // 2500, event_type ORDER BY event_id)) GROUP BY rank, bucket, pos // 8""",
)
def _(spark, sf):
    stream = event_stream(spark, sf).select(
        F.expr("event_id div 2500").alias("rank"), F.col("event_type").alias("bucket"), F.col("event_id").alias("idx")
    )
    batches = batcher.batch_stream(stream, 8)
    done = batcher.run(batches, scratch_path(spark, "batches"), scratch_path(spark, "state"))
    return done.select("rank", "bucket", "batch_no", "first_index", "last_index", "members", "full")


@query(
    "x4_step_windows",
    f"""SELECT name, CASE WHEN event_id <= 1 THEN 0 ELSE ceil(event_id / 500.0)::BIGINT END::BIGINT AS interval, round(sum(value * n) / sum(n), 6) AS average, count(*) AS n FROM ({METRICS_SQL}) GROUP BY ALL""",
)
def _(spark, sf):
    windows = metrics.step_windows(event_metrics(spark, sf), ["name"], "event_id", "value", "n", 500)
    return windows.withColumn("average", F.round("average", 6))


@query(
    "x4_stream_windows",
    f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, name, round(sum(value * n) / sum(n), 6) AS average, count(*) AS n
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM ({METRICS_SQL})) GROUP BY w, name""",
)
def _(spark, sf):
    stream = event_stream(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value",
        F.from_json("props", "k bigint")["k"].alias("n"),
    )
    result = live.windowed_average(stream, "ts", ["name"], "value", "n", "6 hours")
    # The change log also holds the windows that the watermark has not closed yet.
    keys = ["window_start", "window_end", "name"]
    done = live.run_updates(result, keys, scratch_path(spark, "windows"), scratch_path(spark, "state"))
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return done.select(start.alias("window_start"), "name", F.round("average", 6).alias("average"), "n")


@query(
    "x5_idempotent_insert",
    "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
)
def _(spark, sf):
    stream = event_stream(spark, sf).select("user_id", "event_type", "event_id")
    return incremental.insert_absent(
        stream, scratch_path(spark, "inserted"), scratch_path(spark, "state"), ["user_id", "event_type"], "event_id"
    )


@query(
    "x6_worker_progress",
    """SELECT user_id, sum(CASE WHEN kind = 'progress' THEN k ELSE 0 END)::BIGINT AS completed, count(*) FILTER (kind = 'ready') AS ready, count(*) FILTER (kind = 'done') AS done,
  count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'click') AS unknown, arg_max(kind, event_id) AS last_event
FROM (SELECT user_id, event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE event_type WHEN 'signup' THEN 'ready' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'done' ELSE event_type END AS kind FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    kind = F.col("event_type")
    named = F.when(kind == "signup", "ready").when(kind == "view", "progress").when(kind == "purchase", "done").otherwise(kind)
    stream = event_stream(spark, sf).select(
        "user_id", "event_id", named.alias("kind"), F.from_json("props", "k bigint")["k"].alias("k")
    )
    progress = live.worker_progress(stream, "user_id", "kind", "k", "event_id")
    return live.run_updates(progress, ["user_id"], scratch_path(spark, "progress"), scratch_path(spark, "state"))


@query(
    "x6_run_totals",
    "SELECT sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS completed, 0::BIGINT AS errors, 0::BIGINT AS unknown FROM events WHERE event_type = 'view'",
)
def _(spark, sf):
    amount = F.from_json("props", "k bigint")["k"]
    total = table(spark, sf, "events").where("event_type = 'view'").agg(F.sum(amount)).first()[0]
    stream = event_stream(spark, sf).where("event_type = 'view'").select(
        "user_id", "event_id", F.lit("progress").alias("kind"), amount.alias("k")
    )
    progress = live.worker_progress(stream, "user_id", "kind", "k", "event_id")
    done = live.run_updates(progress, ["user_id"], scratch_path(spark, "progress"), scratch_path(spark, "state"))
    return live.require_success(done, total)


@query(
    "x6_worker_failures",
    """WITH e AS (SELECT user_id, event_id, ts, json_extract_string(props, '$.k')::BIGINT AS k,
  CASE event_type WHEN 'signup' THEN 'ready' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'done' ELSE event_type END AS kind FROM events),
g AS (SELECT *, lead(ts) OVER w AS next_ts, (lag(ts) OVER w IS NULL OR lag(kind) OVER w = 'done' OR kind = 'ready' OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000)::INTEGER AS starts
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
r AS (SELECT *, sum(CASE WHEN kind = 'progress' THEN k ELSE 0 END) OVER v AS completed, max(CASE WHEN kind = 'ready' THEN k END) OVER v AS total
  FROM s WINDOW v AS (PARTITION BY user_id, session ORDER BY ts, event_id)),
f AS (SELECT user_id, 'error' AS failure, event_id, 'error event ' || event_id AS detail FROM r WHERE kind = 'error'
  UNION ALL SELECT user_id, 'unknown event', event_id, 'unknown event ' || kind FROM r WHERE kind NOT IN ('ready', 'progress', 'done', 'error')
  UNION ALL SELECT user_id, 'missing total', event_id, 'completed ' || completed::BIGINT || ' of ' || coalesce(total::VARCHAR, 'no total') FROM r WHERE kind = 'done' AND completed IS DISTINCT FROM total
  UNION ALL SELECT user_id, 'silent', event_id, 'silent after ' || kind FROM r WHERE kind <> 'done' AND
    coalesce(epoch_us(next_ts) - epoch_us(ts) > 172800000000, epoch_us(ts) + 172800000000 <= (SELECT max(epoch_us(ts)) - 7200000000 FROM events)))
SELECT user_id::VARCHAR AS worker, failure, event_id, detail FROM f""",
)
def _(spark, sf):
    kind = F.col("event_type")
    named = F.when(kind == "signup", "ready").when(kind == "view", "progress").when(kind == "purchase", "done").otherwise(kind)
    stream = event_stream(spark, sf).select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), named.alias("kind"), F.from_json("props", "k bigint")["k"].alias("k")
    )
    found = watch.detect_failures(
        stream, "user_id", "ts", "kind", "k", "event_id", "2 days", scratch_path(spark, "failures"), scratch_path(spark, "state")
    )
    return found.drop("at")


@query(
    "x7_nan_alerts",
    "SELECT user_id, count(*) AS nans FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 20",
)
def _(spark, sf):
    loss = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    stream = event_stream(spark, sf).select("user_id", loss.alias("loss"))
    counts = live.nan_counts(stream, "user_id", "loss")
    return live.alerts(live.run_updates(counts, ["user_id"], scratch_path(spark, "nans"), scratch_path(spark, "state")))


# ------------------------------------------------------------ extension points


@query("v1_dataset_registry", "SELECT doc_id AS key, text AS caption FROM documents")
def _(spark, sf):
    config = {"type": "parquet_captions", "path": f"{sf}/documents.parquet", "key": "doc_id", "caption": "text", "min_chars": 0}
    return registry.DATASETS.build(config, {"spark": spark, "min_chars": 200})  # the config wins over the defaults


@query(
    "v2_sample_transforms",
    f"SELECT doc_id, '<' || {squeeze_sql('text')} || '>' AS text FROM documents WHERE lang = 'en'",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    marked = F.concat(F.lit("<"), "text", F.lit(">"))
    return registry.apply_transforms(
        docs, ["squeeze_text", lambda df: df.where("lang = 'en'"), lambda df: df.select("doc_id", marked.alias("text"))]
    )


@query(
    "v3_named_transform",
    f"SELECT ratio, count(*) AS samples, min(bucket_h)::INTEGER AS bucket_h FROM ({bucketed_sql(SIZED_SQL, ASPECT_RATIO_1024)}) GROUP BY ratio",
)
def _(spark, sf):
    transform = registry.TRANSFORMS.get("default_train")(ratio_table="ASPECT_RATIO_1024")
    rows = sized_lineitem(spark, sf).transform(transform)
    return rows.groupBy("ratio").agg(F.count(F.lit(1)).alias("samples"), F.min("bucket_h").alias("bucket_h"))


@query(
    "v4_reader_options",
    f"SELECT shard, name, strlen(body)::BIGINT AS size FROM ({PAGE_MEMBERS_SQL}) WHERE slot = 1",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    page_shards(spark, sf, folder)
    found = tar.read_members(spark, folder, content=False).where("name LIKE '%.json'")  # the source answers the filter
    return found.select(_base("shard").alias("shard"), "name", "size")


@query(
    "v5_tar_table_function",
    f"SELECT shard, name, strlen(body)::BIGINT AS size, md5(body) AS content_md5 FROM ({PAGE_MEMBERS_SQL})",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    page_shards(spark, sf, folder)
    tar.register_functions(spark)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder)
    archives.select(_base("path").alias("shard"), "content").createOrReplaceTempView("shardloom_archives")
    return spark.sql(
        "SELECT shard, name, size, md5(m.content) AS content_md5 FROM shardloom_archives a, LATERAL tar_unpack(a.content) m"
    )


@query(
    "v5_tar_ranges_function",
    f"""WITH m AS (SELECT shard, page_id, slot, name, strlen(body)::BIGINT AS size, md5(body) AS content_md5 FROM ({PAGE_MEMBERS_SQL}))
SELECT shard, (512 * row_number() OVER w + coalesce(sum((size + 511) // 512 * 512) OVER
    (PARTITION BY shard ORDER BY page_id, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT // 16384 AS part, name, content_md5
FROM m WINDOW w AS (PARTITION BY shard ORDER BY page_id, slot)""",
)
def _(spark, sf):
    folder = scratch_path(spark, "tars")
    page_shards(spark, sf, folder)
    tar.register_functions(spark)
    index = tar.member_index(spark, folder, scratch_path(spark, "tar-index"))
    index.withColumn("part", F.expr("offset div 16384")).createOrReplaceTempView("shardloom_index")
    found = spark.sql("SELECT * FROM tar_members(TABLE(shardloom_index) PARTITION BY (shard, part) ORDER BY offset)")
    return found.select(_base("shard").alias("shard"), "part", "name", F.md5("content").alias("content_md5"))


@query("v6_prompt_flag_function", PROMPT_FLAGS_SQL)
def _(spark, sf):
    extensions.register_prompt_flags(spark, ASPECT_RATIO_1024_TEST)
    flagged_prompts(spark, sf).createOrReplaceTempView("shardloom_prompts")
    return spark.sql(
        "SELECT item_id, f.* FROM (SELECT item_id, prompt_flags(prompt) AS f FROM shardloom_prompts)"
    )


@query(
    "v7_aggregate_functions",
    f"SELECT name, round(sum(value * n) / sum(n), 6) AS average FROM ({METRICS_SQL}) GROUP BY name",
)
def _(spark, sf):
    rows = event_metrics(spark, sf)
    return rows.groupBy("name").agg(F.round(extensions.weighted_mean(F.col("value"), F.col("n")), 6).alias("average"))


@query(
    "v7_centroid_function",
    """SELECT label, round(avg(v) FILTER (d = 1), 6) AS first, round(avg(v) FILTER (d = 64), 6) AS last FROM (
SELECT label, unnest(embedding::DOUBLE[]) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label""",
)
def _(spark, sf):
    centre = table(spark, sf, "embeddings").groupBy("label").agg(extensions.cosine_centroid(F.col("embedding"), 64).alias("c"))
    return centre.select("label", F.round(F.col("c")[0], 6).alias("first"), F.round(F.col("c")[63], 6).alias("last"))


@query(
    "v7_moving_average_function",
    """WITH RECURSIVE p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
e AS (SELECT user_id, r, value AS ema FROM p WHERE r = 1
  UNION ALL SELECT p.user_id, p.r, e.ema * 0.9::DOUBLE + p.value * 0.1::DOUBLE FROM e JOIN p ON p.user_id = e.user_id AND p.r = e.r + 1)
SELECT user_id, round(arg_max(ema, r), 6) AS ema FROM e GROUP BY user_id""",
)
def _(spark, sf):
    rows = positions(table(spark, sf, "events").select("user_id", "event_id", "value"), "event_id", ("user_id",), "r", "n")
    average = extensions.ema_at(F.col("value"), F.col("r"), F.col("n"), 0.9)
    return rows.groupBy("user_id").agg(F.round(average, 6).alias("ema"))
