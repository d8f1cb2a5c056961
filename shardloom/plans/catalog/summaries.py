"""Registered queries: aggregations (A) and verification (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.fixed_values import (
    ASPECT_RATIO_512,
    BUCKET_CACHE_ITEM_BYTES,
    BUCKET_CACHE_THRESHOLD_BYTES,
    CONTRASTIVE_TEMPERATURE,
)
from ...functions.image_header import image_header
from ...functions.names import image_key
from ...operators import buckets, metrics, routing, sampling, splits, verify
from ...sources import ledger
from .common import (
    SCORES_SQL,
    SHARDS_SQL,
    SIZED_SQL,
    bucketed_sql,
    caption_scores,
    order_shards,
    query,
    sized_lineitem,
    table,
)
from .joins import priority_inputs, recorded_ledger
from .positions import (
    CLASS_SQL, MANY_SQL, PLACED_SQL, PROTO_SQL, ROUTED_MANY_SQL, ROUTED_SQL, class_counts, many_prototypes, prototypes,
    routed_in_blocks, routed_vectors,
)
from .projections import slice_samples, SLICE_SQL


@query(
    "a1_shard_totals",
    """SELECT count(*) AS files, sum(n)::BIGINT AS samples, sum(coalesce(bytes, 0))::BIGINT AS bytes FROM (
SELECT l_suppkey, count(*) AS n, CASE WHEN l_suppkey % 5 <> 0 THEN sum(trunc(l_extendedprice)::BIGINT)::BIGINT END AS bytes FROM lineitem GROUP BY l_suppkey)""",
)
def _(spark, sf):
    size = F.when(F.col("l_suppkey") % 5 != 0, F.sum(F.col("l_extendedprice").cast("bigint")))
    shards = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("nsamples"), size.alias("filesize"))
    return metrics.shard_totals(shards)


@query("a2_samples_per_directory", "SELECT source AS dir, count(*) AS samples FROM documents GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("dir")).agg(F.count(F.lit(1)).alias("samples"))


@query(
    "a3_samples_per_shard",
    """SELECT shard, found, declared, found = declared AS matches FROM (SELECT l_orderkey // 100 AS shard, count(DISTINCT l_orderkey) AS found FROM lineitem GROUP BY ALL)
JOIN (SELECT o_orderkey // 100 AS shard, count(*) AS declared FROM orders GROUP BY ALL) USING (shard)""",
)
def _(spark, sf):
    members = table(spark, sf, "lineitem").select(F.expr("l_orderkey div 100").alias("shard"), F.col("l_orderkey").alias("key"))
    found = members.groupBy("shard").agg(F.count_distinct("key").alias("found"))
    declared = order_shards(spark, sf).select(F.col("ordinal").alias("shard"), F.col("nsamples").alias("declared"))
    return found.join(declared, "shard").select("shard", "found", "declared", (F.col("found") == F.col("declared")).alias("matches"))


@query(
    "a4_rows_declared",
    """SELECT o_orderpriority AS name, count(*) AS declared, count(*) FILTER (o_orderstatus <> 'P' OR o_orderpriority <> '2-HIGH') AS "rows",
  count(*) = count(*) FILTER (o_orderstatus <> 'P' OR o_orderpriority <> '2-HIGH') AS matches FROM orders GROUP BY o_orderpriority""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "name")
    declared = orders.groupBy("name").agg(F.count(F.lit(1)).alias("declared"))
    read = orders.where("o_orderstatus <> 'P' OR name <> '2-HIGH'").groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    return ledger.rows_declared(read, declared)


@query(
    "a5_outcome_counters",
    """SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS new, count(*) FILTER (event_type IN ('view', 'click')) AS existing,
  count(*) FILTER (event_type = 'error') AS skipped FROM events GROUP BY user_id""",
)
def _(spark, sf):
    outcome = (
        F.when(F.col("event_type") == "error", "skipped").when(F.col("event_type").isin("view", "click"), "existing").otherwise("new")
    )
    return metrics.outcome_counters(table(spark, sf, "events").select("user_id", outcome.alias("outcome")), ["user_id"], "outcome")


@query(
    "a6_best_caption",
    f"SELECT doc_id, arg_max(caption_type, {{'s': score, 'o': -ordinal}}) AS caption_type, max(score) AS score FROM ({SCORES_SQL}) GROUP BY doc_id",
)
def _(spark, sf):
    return sampling.best_caption(caption_scores(spark, sf), ["doc_id"])


def event_metrics(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("name"), "value",
        F.from_json("props", "k bigint")["k"].alias("n"), "ts",
    )


METRICS_SQL = """SELECT user_id AS run, event_id, event_type AS name, value, json_extract_string(props, '$.k')::BIGINT AS n, ts FROM events"""


@query(
    "a7_weighted_average",
    f"""SELECT run, name, round(sum(value * n) / sum(n), 6) AS average FROM (SELECT *, row_number() OVER (PARTITION BY run, name ORDER BY event_id DESC) AS r FROM ({METRICS_SQL})) WHERE r <= 5 GROUP BY run, name""",
)
def _(spark, sf):
    averages = metrics.weighted_average(event_metrics(spark, sf), ["run", "name"], "event_id", "value", "n", 5)
    return averages.withColumn("average", F.round("average", 6))


@query("a7_weighted_average_all", f"SELECT name, round(sum(value * n) / sum(n), 6) AS average FROM ({METRICS_SQL}) GROUP BY name")
def _(spark, sf):
    averages = metrics.weighted_average(event_metrics(spark, sf), ["name"], "event_id", "value", "n")
    return averages.withColumn("average", F.round("average", 6))


STATS_SQL = f"""SELECT name, max(c) AS count, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median, sum(value) AS total
FROM (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY event_id DESC) AS r, (SELECT count(*) FROM ({METRICS_SQL}) x WHERE x.name = m.name) AS c FROM ({METRICS_SQL}) m WHERE event_id >= 50) WHERE r <= 100 GROUP BY name"""


def event_stats(spark, sf):
    return metrics.rolling_stats(event_metrics(spark, sf), ["name"], "event_id", "value", 100, 50)


@query(
    "a8_rolling_stats",
    f"SELECT name, count, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(median, 6) AS median, round(total, 6) AS total FROM ({STATS_SQL})",
)
def _(spark, sf):
    stats = event_stats(spark, sf)
    return stats.select(
        "name", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", "max",
        *[F.round(c, 6).alias(c) for c in ("median", "total")],
    )


@query(
    "a9_timer_shares",
    f"""SELECT name, round(mean * 1000, 4) AS mean_ms, round(std * 1000, 4) AS std_ms, round(mean / (SELECT mean FROM ({STATS_SQL}) WHERE name = 'view') * 100, 6) AS percent,
  round(1 / mean, 6) AS per_sec, round(8 / mean, 6) AS global_per_sec FROM ({STATS_SQL}) ORDER BY mean_ms DESC""",
)
def _(spark, sf):
    report = metrics.timer_report(event_stats(spark, sf), "view", 8)
    return report.select(
        "name", F.round("mean_ms", 4).alias("mean_ms"), F.round("std_ms", 4).alias("std_ms"),
        *[F.round(c, 6).alias(c) for c in ("percent", "per_sec", "global_per_sec")],
    ).orderBy(F.desc("mean_ms"))


@query(
    "a10_worker_reduce",
    f"SELECT event_id // 20 AS step, round(avg(value), 6) AS loss, sum(n)::BIGINT AS samples FROM ({METRICS_SQL}) GROUP BY ALL",
)
def _(spark, sf):
    rows = event_metrics(spark, sf).withColumn("step", F.expr("event_id div 20"))
    return metrics.reduce_over_workers(rows, "step", "value", "n").withColumn("loss", F.round("loss", 6))


@query(
    "a11_progress",
    """WITH p AS (SELECT user_id, count(*) AS done, epoch(max(ts)) - epoch(min(ts)) AS elapsed FROM events GROUP BY user_id),
t AS (SELECT *, done / elapsed AS rate, (1000 - done) / (done / elapsed) AS eta FROM p)
SELECT user_id, done, round(done * 100.0::DOUBLE / 1000, 6) AS percent, round(rate, 9) AS rate,
  CASE WHEN eta < 0 THEN '--:--:--' ELSE printf('%02d:%02d:%02d', floor(eta)::BIGINT // 3600, floor(eta)::BIGINT % 3600 // 60, floor(eta)::BIGINT % 60) END AS eta FROM t""",
)
def _(spark, sf):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("done"), (F.max(ts) - F.min(ts)).alias("elapsed")
    )
    p = metrics.progress(F.col("done"), F.lit(1000), F.col("elapsed"))
    return per_user.select(
        "user_id", "done", F.round(p["percent"], 6).alias("percent"), F.round(p["rate"], 9).alias("rate"), p["eta"].alias("eta")
    )


@query(
    "a12_bucket_histogram",
    f"SELECT ratio, count(*) AS samples FROM ({bucketed_sql(SIZED_SQL, ASPECT_RATIO_512)}) GROUP BY ratio HAVING count(*) >= 100",
)
def _(spark, sf):
    return buckets.histogram(buckets.with_bucket(sized_lineitem(spark, sf), "height", "width"), least=100)


@query(
    "a13_prototype_usage",
    f"""SELECT p.proto, count(r.vec_id) AS vectors, round(avg(r.weight), 6) AS mean_weight, count(r.vec_id) > 0 AS active
FROM (SELECT DISTINCT label::BIGINT AS proto FROM embeddings) p LEFT JOIN (SELECT * FROM ({ROUTED_SQL}) WHERE routed) r USING (proto) GROUP BY p.proto""",
)
def _(spark, sf):
    protos = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("proto")).distinct()
    used = routing.usage(routed_vectors(spark, sf), protos)
    return used.withColumn("mean_weight", F.round("mean_weight", 6))


CENTROID_SQL = f"""SELECT proto, list(m ORDER BY d) AS centroid FROM (SELECT proto, d, avg(v) AS m FROM (
  SELECT r.proto, unnest(e.embedding::DOUBLE[]) AS v, generate_subscripts(e.embedding, 1) AS d
  FROM ({ROUTED_SQL}) r JOIN embeddings e USING (vec_id) WHERE r.routed) GROUP BY proto, d) GROUP BY proto"""


@query(
    "a14_centroids",
    f"SELECT proto, unnest(generate_series(0, 63))::INTEGER AS dim, round(unnest(centroid), 6) AS value FROM ({CENTROID_SQL})",
)
def _(spark, sf):
    centres = routing.centroids(routed_vectors(spark, sf), 64)
    return centres.select("proto", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "a15_contrastive_score",
    f"""WITH c AS ({CENTROID_SQL}), p AS ({PROTO_SQL}),
l AS (SELECT p.proto AS i, c.proto AS j, list_cosine_similarity(p.vec, c.centroid) / {CONTRASTIVE_TEMPERATURE}::DOUBLE AS z FROM p, c WHERE p.proto IN (SELECT proto FROM c)),
t AS (SELECT i, ln(sum(exp(z))) - max(z) FILTER (i = j) AS loss FROM l GROUP BY i)
SELECT count(*) AS active, round(avg(loss), 6) AS score FROM t""",
)
def _(spark, sf):
    centres = routing.centroids(routed_vectors(spark, sf), 64)
    return routing.contrastive_score(centres, prototypes(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "a13_blocked_usage",
    f"""SELECT p.proto, count(r.vec_id) AS vectors, round(avg(r.weight), 6) AS mean_weight, count(r.vec_id) > 0 AS active
FROM ({MANY_SQL}) p LEFT JOIN ({ROUTED_MANY_SQL}) r USING (proto) GROUP BY p.proto""",
)
def _(spark, sf):
    used = routing.usage(routed_in_blocks(spark, sf), many_prototypes(spark, sf))
    return used.withColumn("mean_weight", F.round("mean_weight", 6))


CENTROID_MANY_SQL = f"""SELECT proto, list(m ORDER BY d) AS centroid FROM (SELECT proto, d, avg(v) AS m FROM (
  SELECT r.proto, unnest(e.embedding::DOUBLE[]) AS v, generate_subscripts(e.embedding, 1) AS d
  FROM ({ROUTED_MANY_SQL}) r JOIN embeddings e USING (vec_id)) GROUP BY proto, d) GROUP BY proto"""


@query(
    "a14_blocked_centroids",
    f"SELECT proto, unnest(generate_series(0, 63))::INTEGER AS dim, round(unnest(centroid), 6) AS value FROM ({CENTROID_MANY_SQL})",
)
def _(spark, sf):
    centres = routing.centroids(routed_in_blocks(spark, sf), 64)
    return centres.select("proto", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "a15_blocked_score",
    f"""WITH c AS ({CENTROID_MANY_SQL}), p AS ({MANY_SQL}),
l AS (SELECT p.proto AS i, c.proto AS j, list_cosine_similarity(p.vec, c.centroid) / {CONTRASTIVE_TEMPERATURE}::DOUBLE AS z FROM p, c WHERE p.proto IN (SELECT proto FROM c)),
t AS (SELECT i, ln(sum(exp(z))) - max(z) FILTER (i = j) AS loss FROM l GROUP BY i)
SELECT count(*) AS active, round(avg(loss), 6) AS score FROM t""",
)
def _(spark, sf):
    centres = routing.centroids(routed_in_blocks(spark, sf), 64)
    score = routing.contrastive_score(centres, many_prototypes(spark, sf), in_blocks=True)
    return score.withColumn("score", F.round("score", 6))


@query(
    "a16_moving_average",
    """WITH RECURSIVE p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
e AS (SELECT user_id, r, value AS ema FROM p WHERE r = 1
  UNION ALL SELECT p.user_id, p.r, e.ema * 0.9::DOUBLE + p.value * 0.1::DOUBLE FROM e JOIN p ON p.user_id = e.user_id AND p.r = e.r + 1)
SELECT user_id, round(arg_max(ema, r), 6) AS ema, max(r) AS n FROM e GROUP BY user_id""",
)
def _(spark, sf):
    averaged = metrics.moving_average(table(spark, sf, "events"), "user_id", "event_id", "value", 0.9, block_rows=1 << 12)
    return averaged.withColumn("ema", F.round("ema", 6))


@query(
    "a17_nan_guard",
    "SELECT user_id, count(*) FILTER (event_type = 'error') AS nans, count(*) FILTER (event_type = 'error') > 20 AS failed FROM events GROUP BY user_id",
)
def _(spark, sf):
    loss = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return metrics.nan_runs(table(spark, sf, "events").select("user_id", loss.alias("loss")), "user_id", "loss")


@query(
    "a18_collate",
    f"""SELECT p.rank, p.ratio, p.batch_no, string_agg(p.idx, ',' ORDER BY p.idx) AS members, string_agg(s.height || 'x' || s.width, ',' ORDER BY p.idx) AS sizes,
  max(p.idx) AS emit_at, bool_and(is_full) AS complete FROM ({PLACED_SQL}) p JOIN ({SIZED_SQL}) s USING (idx) GROUP BY p.rank, p.ratio, p.batch_no""",
)
def _(spark, sf):
    rows = buckets.with_bucket(sized_lineitem(spark, sf), "height", "width").withColumn("rank", F.col("idx") % 4)
    batched = buckets.same_bucket_batches(rows, "idx", 16, drop_last=False, block_rows=1 << 14)
    packed = buckets.collate(batched, "idx", ["height", "width"])
    size = F.zip_with("height", "width", lambda h, w: F.concat_ws("x", h.cast("string"), w.cast("string")))
    return packed.select(
        "rank", "ratio", "batch_no", F.array_join(F.col("idx").cast("array<string>"), ",").alias("members"),
        F.array_join(size, ",").alias("sizes"), "emit_at", F.col("full").alias("complete"),
    )


@query(
    "a18_micro_batches",
    """WITH o AS (SELECT l_orderkey, l_orderkey % 4 AS rank, (row_number() OVER (PARTITION BY l_orderkey % 4 ORDER BY l_orderkey) - 1) // 16 AS batch_no FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
l AS (SELECT *, row_number() OVER (PARTITION BY rank, batch_no ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag) AS nr FROM o JOIN lineitem USING (l_orderkey) WHERE l_returnflag <> 'N')
SELECT rank, batch_no, coalesce(n, 0)::INTEGER AS samples, emit_at, coalesce(parts, '') AS parts, coalesce(flags, '') AS flags, coalesce(total, 0.0) AS total
FROM (SELECT rank, batch_no, max(l_orderkey) AS emit_at FROM o GROUP BY ALL) LEFT JOIN (SELECT rank, batch_no, count(*) AS n, string_agg(l_partkey, ',' ORDER BY nr) AS parts, string_agg(l_returnflag, ',' ORDER BY nr) AS flags, sum(l_quantity) AS total
  FROM l GROUP BY ALL) USING (rank, batch_no)""",
)
def _(spark, sf):
    # An order is a micro-batch of its lines; one without a line that counts is empty.
    line = F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("x"),
        F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")).alias("metadata"),
    )
    kept = F.collect_list(F.when(F.col("l_returnflag") != "N", line))
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(kept).alias("micro"))
    placed = orders.withColumn("rank", F.col("l_orderkey") % 4).withColumn("ratio", F.lit("all"))
    batched = buckets.same_bucket_batches(placed, "l_orderkey", 16, drop_last=False)
    packed = buckets.collate_micro(batched, "l_orderkey", "micro")
    return packed.select(
        "rank", "batch_no", "samples", "emit_at", F.array_join(F.col("x").cast("array<string>"), ",").alias("parts"),
        F.array_join("metadata.flag", ",").alias("flags"), F.aggregate("metadata.quantity", F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


@query("a19_distinct_keys", "SELECT DISTINCT source || '/' || lang AS key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("key")).distinct()


@query(
    "a20_run_summary",
    f"""SELECT count(*) AS samples, count(DISTINCT ratio) AS buckets, count(*) * {BUCKET_CACHE_ITEM_BYTES} AS cache_bytes,
  CASE WHEN count(*) * {BUCKET_CACHE_ITEM_BYTES} > {BUCKET_CACHE_THRESHOLD_BYTES} THEN 'file' ELSE 'memory' END AS cache_kind FROM ({bucketed_sql(SLICE_SQL, ASPECT_RATIO_512)})""",
)
def _(spark, sf):
    return metrics.run_summary(slice_samples(spark, sf), "ratio")


# ------------------------------------------------------------ verification


def record_text():
    prompt = F.concat(F.col("lang"), F.lit(" "), F.col("source"))
    shown = F.when(F.col("doc_id") % 9 == 4, F.lit("elsewhere")).otherwise(F.col("source"))
    return F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 10 != 7, prompt).alias("prompt"), F.lit("").alias("original_caption"), F.array(shown).alias("texts"),
            F.array().cast("array<string>").alias("annotations"), F.col("n_chars").alias("height"), F.lit(5).alias("width"),
            F.lit("documents").alias("source_parquet"), F.col("doc_id").alias("source_row"),
        )
    )


@query(
    "q1_verify_shards",
    """WITH d AS (SELECT *, doc_id // 100 AS shard FROM documents),
m AS (SELECT shard, doc_id AS key, 'missing prompt' AS rule FROM d WHERE doc_id % 10 = 7
  UNION ALL SELECT shard, doc_id, 'text not in prompt' FROM d WHERE doc_id % 9 = 4 OR doc_id % 10 = 7
  UNION ALL SELECT shard, doc_id, 'unexpected member' FROM d WHERE doc_id % 50 = 3
  UNION ALL SELECT shard, doc_id, 'incomplete pair' FROM d WHERE doc_id % 20 = 5
  UNION ALL SELECT shard, doc_id, 'sizes differ' FROM d WHERE doc_id % 17 = 2 AND doc_id % 20 <> 5
  UNION ALL SELECT shard, NULL, 'wrong count' FROM d WHERE shard % 4 = 1 GROUP BY shard)
SELECT shard, key::VARCHAR AS key, rule FROM m""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("shard", F.expr("doc_id div 100"))
    d = F.col("doc_id")

    def member(kind, present, record, width):
        return F.when(
            present,
            F.struct(F.lit(kind).alias("ext"), record.alias("record"), width.cast("bigint").alias("width"), F.col("n_chars").alias("height")),
        )

    nothing = F.lit(None).cast("string")
    members = docs.select(
        "shard", d.cast("string").alias("key"),
        F.explode(
            F.array_compact(
                F.array(
                    member("jpg", d % 20 != 5, nothing, F.lit(5) + F.when(d % 17 == 2, 1).otherwise(0)),
                    member("json", F.lit(True), record_text(), F.lit(5)),
                    member("exe", d % 50 == 3, nothing, F.lit(5)),
                )
            )
        ).alias("m"),
    ).select("shard", "key", "m.*")
    shards = docs.groupBy("shard").agg(
        (F.count(F.lit(1)) + F.max(F.when(F.col("shard") % 4 == 1, 1).otherwise(0))).alias("nsamples")
    )
    return verify.verify_shards(members, shards)


@query(
    "q2_verify_output",
    f"""SELECT count(*) AS shards, sum(nsamples)::BIGINT AS samples, (SELECT count(*) FROM orders WHERE o_orderpriority > '3')::BIGINT AS expected,
  count(*) FILTER (ordinal % 10 = 3) * 2 AS list_differences, 4::BIGINT AS inputs_not_done, false AS verified FROM ({SHARDS_SQL})""",
)
def _(spark, sf):
    shards = order_shards(spark, sf)
    recorded = shards.withColumn("nsamples", F.col("nsamples") + F.when(F.col("ordinal") % 10 == 3, 1).otherwise(0))
    current = priority_inputs(spark, sf).select("name", "fp")
    return ledger.output_report(shards, recorded_ledger(spark, sf), recorded, current)


@query(
    "q3_verify_store",
    """SELECT count(*) AS images, (SELECT count(*) FROM labels)::BIGINT AS labels, (SELECT count(*) FROM documents)::BIGINT AS indexed,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)) AS index_without_image,
  count(*) FILTER (page_id NOT IN (SELECT doc_id FROM labels)) AS image_without_label, count(*) FILTER (page_id % 13 = 6)::BIGINT AS not_square FROM pages""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages")
    side = F.lit(256)
    images = pages.select(
        image_key(F.col("page_id")).alias("key"), side.alias("width"), (side + (F.col("page_id") % 13 == 6).cast("int")).alias("height")
    )
    labels = table(spark, sf, "labels").select(image_key(F.col("doc_id")).alias("key"))
    index = table(spark, sf, "documents").select(image_key(F.col("doc_id")).alias("key"))
    return verify.verify_store(images, labels, index)


def part_image(kind, width, height):
    """Headers of images as their formats write them: RGB, grey and palette PNG, JPEG behind a long comment, WebP."""

    def number(value, digits, little=False):
        text = F.lpad(F.hex(value), digits, "0")
        swapped = F.concat(*[F.substring(text, digits - 1 - 2 * i, 2) for i in range(digits // 2)])
        return swapped if little else text

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(width, 8), number(height, 8))
    comment = F.concat(F.lit("FFFE7000"), F.repeat(F.lit("20"), 0x6FFE))  # longer than the prefix that is read first
    frame = F.concat(number(height, 4), number(width, 4))
    return F.unhex(
        F.when(kind == 0, F.concat(png, F.lit("0802000000")))
        .when(kind == 1, F.concat(png, F.lit("0800000000")))
        .when(kind == 2, F.concat(png, F.lit("0803000000")))
        .when(kind == 3, F.concat(F.lit("FFD8"), comment, F.lit("FFC0001108"), frame, F.lit("03")))
        .when(kind == 4, F.concat(F.lit("FFD8FFC2000B08"), frame, F.lit("01")))
        .when(kind == 5, F.concat(F.lit("5249464600000000574542505650382000000000" "000000" "9D012A"), number(width, 4, True), number(height, 4, True)))
        .otherwise(F.lit("00"))
    )


@query(
    "q3_rgb_store",
    """WITH p AS (SELECT p_partkey, p_partkey % 7 AS kind, p_partkey % 7 <> 6 AND p_partkey % 5 <> 0 AS square FROM part)
SELECT count(*) AS images, count(*) AS labels, count(*) AS indexed, 0::BIGINT AS index_without_image, 0::BIGINT AS image_without_label,
  count(*) FILTER (NOT square) AS not_square, count(*) FILTER (kind NOT IN (0, 3, 5)) AS not_rgb FROM p""",
)
def _(spark, sf):
    number = F.col("p_partkey")
    width, height = F.lit(256), F.when(number % 5 == 0, 255).otherwise(256)
    stored = table(spark, sf, "part").select(
        image_key(number).alias("key"), part_image(number % 7, width, height).alias("payload")
    )
    keys = stored.select("key")
    return verify.verify_store(verify.describe_images(stored), keys, keys)


@query(
    "p8_image_headers",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 < 6 THEN p_size * 16 END::INTEGER AS width, CASE WHEN p_partkey % 7 < 6 THEN p_size * 12 END::INTEGER AS height,
  ['PNG', 'PNG', 'PNG', 'JPEG', 'JPEG', 'WebP', NULL][p_partkey % 7 + 1] AS format, ['RGB', 'L', 'P', 'RGB', 'L', 'RGB', NULL][p_partkey % 7 + 1] AS mode,
  CASE WHEN p_partkey % 7 = 6 THEN 'unreadable image header' END AS error FROM part""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", part_image(F.col("p_partkey") % 7, F.col("p_size") * 16, F.col("p_size") * 12).alias("payload")
    )
    return parts.select("p_partkey", image_header(F.col("payload")).alias("h")).select("p_partkey", "h.*")


@query(
    "q4_holdout_rules",
    """WITH v AS (SELECT CASE event_type WHEN 'error' THEN 'true' WHEN 'view' THEN (user_id - 20)::VARCHAR ELSE (event_id * 3 % 20011)::VARCHAR END AS value FROM events),
n AS (SELECT value, CASE WHEN value <> 'true' THEN value::BIGINT END AS n FROM v)
SELECT value, 'not an integer' AS rule FROM n WHERE n IS NULL UNION ALL SELECT value, 'out of range' FROM n WHERE n < 0 OR n >= 100
UNION ALL SELECT value, 'duplicate' FROM n WHERE n IS NOT NULL GROUP BY value HAVING count(*) > 1""",
)
def _(spark, sf):
    kind = F.col("event_type")
    value = (
        F.when(kind == "error", "true").when(kind == "view", (F.col("user_id") - 20).cast("string"))
        .otherwise((F.col("event_id") * 3 % 20011).cast("string"))
    )
    return verify.holdout_violations(table(spark, sf, "events").select(value.alias("value")), "value", 100)


@query(
    "q5_loader_smoke",
    f"""SELECT ratio, count(*) AS samples, count(*) FILTER (clean = '' AND len(texts) = 0) AS empty_prompts, min(bucket_h)::INTEGER AS bucket_h, min(bucket_w)::INTEGER AS bucket_w
FROM ({bucketed_sql(SLICE_SQL, ASPECT_RATIO_512)}) GROUP BY ratio""",
)
def _(spark, sf):
    samples = slice_samples(spark, sf)
    blank = F.col("prompt").isNull() | (F.col("prompt") == "")
    return samples.groupBy("ratio").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(blank).alias("empty_prompts"),
        F.min("bucket_h").alias("bucket_h"), F.min("bucket_w").alias("bucket_w"),
    )


@query(
    "q6_worklist_complete",
    f"SELECT class_id, n AS requested, n AS generated, 0::BIGINT AS repeated, true AS complete FROM ({CLASS_SQL})",
)
def _(spark, sf):
    counts = class_counts(spark, sf)
    return verify.worklist_report(splits.round_robin_tasks(counts, 7), counts)
