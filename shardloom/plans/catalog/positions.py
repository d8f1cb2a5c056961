"""Registered queries: window-style positions and splits (W), sorts and top-k (T), draws (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.annotations import keep_all, reading_entries
from ...functions.binding import with_value_where
from ...functions.fixed_values import ASPECT_RATIO_512, SEED_CLASS_STRIDE, SEED_EPOCH_STRIDE
from ...functions.hashing import stable_seed
from ...functions.names import row_key, shard_name, shard_prefix, parent_dir
from ...operators import buckets, metrics, retention, routing, sampling, splits
from ...operators import index as ix
from .common import (
    ANNOTATED_SQL,
    LINEITEM_SQL,
    SCORES_SQL,
    SHARDS_SQL,
    SIZED_SQL,
    annotated_turns,
    bucketed_sql,
    caption_scores,
    indexed_lineitem,
    order_shards,
    query,
    sized_lineitem,
    table,
    uniform_sql,
)
from .projections import SHORT_LINES_SQL, blank_free, short_lines


@query(
    "w1_row_keys",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS source_row, 'documents-' || printf('%09d', row_number() OVER (ORDER BY doc_id) - 1) AS key FROM documents",
)
def _(spark, sf):
    rows = ix.with_row_index(spark, f"{sf}/documents.parquet", ["doc_id"])
    stem = F.regexp_replace("source_file", r"\.parquet$", "")
    return rows.select("doc_id", "source_row", row_key(stem, F.col("source_row")).alias("key"))


@query(
    "w2_global_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS global_index FROM orders",
)
def _(spark, sf):
    return ix.with_global_index(spark, f"{sf}/orders.parquet", ["o_orderkey"]).select("o_orderkey", "global_index")


@query(
    "w3_shard_sizes",
    f"SELECT printf('train-%05d.tar', idx // 1000) AS url, count(*) AS nsamples FROM ({LINEITEM_SQL}) GROUP BY ALL",
)
def _(spark, sf):
    rows = indexed_lineitem(spark, sf, [])
    sizes = rows.groupBy(F.expr("idx div 1000").alias("no")).agg(F.count(F.lit(1)).alias("nsamples"))
    return sizes.select(shard_name(F.lit("train"), F.col("no")).alias("url"), "nsamples")


@query(
    "w4_prefix_groups",
    f"""WITH s AS (SELECT ordinal, nsamples, 'set' || (ordinal // 7) % 3 AS prefix FROM ({SHARDS_SQL})),
r AS (SELECT *, (sum(nsamples) OVER (ORDER BY ordinal) - nsamples)::BIGINT AS start, sum(CASE WHEN p IS DISTINCT FROM prefix THEN 1 ELSE 0 END) OVER (ORDER BY ordinal) - 1 AS group_no
  FROM (SELECT *, lag(prefix) OVER (ORDER BY ordinal) AS p FROM s))
SELECT ordinal, prefix, group_no::BIGINT AS group_no, start, (min(start) OVER (PARTITION BY group_no))::BIGINT AS group_start FROM r""",
)
def _(spark, sf):
    name = F.concat(F.lit("a/set"), (F.expr("ordinal div 7") % 3).cast("string"))
    shards = order_shards(spark, sf).withColumn("url", shard_name(name, F.col("ordinal")))
    grouped = ix.shard_groups(shards.withColumn("prefix", shard_prefix(F.col("url"))))
    return grouped.select("ordinal", "prefix", F.col("group_no").cast("bigint").alias("group_no"), "start", "group_start")


RANKED_SQL = f"SELECT idx % 4 AS rank, * FROM ({bucketed_sql(SIZED_SQL, ASPECT_RATIO_512)})"
PLACED_SQL = f"""SELECT rank, ratio, idx, pos // 16 AS batch_no, (pos // 16 + 1) * 16 <= n AS is_full FROM (
  SELECT rank, ratio, idx, row_number() OVER (PARTITION BY rank, ratio ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY rank, ratio) AS n FROM ({RANKED_SQL}))"""


def placed_rows(spark, sf, drop_last):
    rows = buckets.with_bucket(sized_lineitem(spark, sf), "height", "width").withColumn("rank", F.col("idx") % 4)
    return buckets.same_bucket_batches(
        rows.select("rank", "ratio", "idx"), "idx", 16, drop_last=drop_last, block_rows=1 << 14
    )


@query("w5_same_bucket_batches", f"SELECT rank, ratio, idx, batch_no FROM ({PLACED_SQL}) WHERE is_full")
def _(spark, sf):
    return placed_rows(spark, sf, True).select("rank", "ratio", "idx", "batch_no")


@query(
    "w6_audit_records",
    """SELECT rank, event_id, record_no, name, k FROM (SELECT user_id % 8 AS rank, event_id, event_type AS name, json_extract_string(props, '$.k')::INTEGER AS k,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id)::INTEGER AS record_no FROM events) WHERE record_no <= 30""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 8).alias("rank"), "event_id", F.col("event_type").alias("name"), F.from_json("props", "k int")["k"].alias("k")
    )
    return metrics.audit_records(events, "rank", "event_id")


CHECKPOINTS_SQL = """SELECT o_orderkey, o_orderdate AS mtime, o_orderkey % 11 = 0 AS is_link, 'epoch_' || o_custkey % 50 || '_step_' || o_orderkey // 2 ||
  CASE o_orderkey % 5 WHEN 0 THEN '_recovery.pth' WHEN 4 THEN '.pth' ELSE '_recovery' END AS name FROM orders"""


def checkpoint_files(spark, sf):
    k = F.col("o_orderkey")
    tail = F.when(k % 5 == 0, "_recovery.pth").when(k % 5 == 4, ".pth").otherwise("_recovery")
    name = F.concat(
        F.lit("epoch_"), (F.col("o_custkey") % 50).cast("string"), F.lit("_step_"), F.expr("o_orderkey div 2").cast("string"), tail
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("mtime"), (k % 11 == 0).alias("is_link"), name.alias("name")
    )


@query(
    "w7_retention",
    rf"""WITH c AS (SELECT name, regexp_extract(name, '^epoch_(\d+)_step_(\d+)_recovery(\.pth)?$', 2)::BIGINT AS step,
  regexp_extract(name, '^epoch_(\d+)_step', 1)::BIGINT AS epoch FROM ({CHECKPOINTS_SQL}) WHERE NOT is_link AND regexp_matches(name, '^epoch_(\d+)_step_(\d+)_recovery(\.pth)?$'))
SELECT name, step, epoch FROM (SELECT *, dense_rank() OVER (ORDER BY step DESC, epoch DESC) AS r FROM c) WHERE r > 5""",
)
def _(spark, sf):
    return retention.prunable(checkpoint_files(spark, sf), 5)


@query(
    "w8_latest_checkpoint",
    r"""WITH f AS (SELECT 'runs/epoch=' || o_custkey % 50 || '-step=' || o_orderkey * 7 % 1009 * 100000 + o_orderkey || '.ckpt' AS path FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 'runs/last-' || o_orderkey || '.ckpt' FROM orders WHERE o_orderstatus = 'P')
SELECT arg_max(path, step) AS path, max(step) AS step FROM (SELECT path, nullif(regexp_extract(path, 'epoch=\d+-step=(\d+)', 1), '')::BIGINT AS step FROM f)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    step = (k * 7 % 1009 * 100000 + k).cast("string")
    named = F.concat(F.lit("runs/epoch="), (F.col("o_custkey") % 50).cast("string"), F.lit("-step="), step, F.lit(".ckpt"))
    path = F.when(F.col("o_orderstatus") != "P", named).otherwise(F.concat(F.lit("runs/last-"), k.cast("string"), F.lit(".ckpt")))
    return retention.latest(table(spark, sf, "orders").select(path.alias("path"), F.col("o_orderdate").alias("mtime")))


CLASS_SQL = "SELECT c_nationkey AS class_id, count(*) AS n FROM customer GROUP BY ALL"


def class_counts(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "w9_round_robin_tasks",
    f"""WITH t AS (SELECT class_id, unnest(range(n)) AS image_index FROM ({CLASS_SQL}))
SELECT ((row_number() OVER (ORDER BY class_id, image_index) - 1) % 7)::INTEGER AS worker, class_id, image_index FROM t""",
)
def _(spark, sf):
    return splits.round_robin_tasks(class_counts(spark, sf), 7)


@query(
    "w10_dense_renumber",
    """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_index FROM documents WHERE doc_id NOT IN (SELECT item_id * 5 FROM benchmark)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    excluded = table(spark, sf, "benchmark").select((F.col("item_id") * 5).alias("doc_id"))
    return ix.dense_renumber(docs, "doc_id", excluded, docs.count())


N_SQL = "(SELECT count(*) FROM lineitem)"


@query(
    "w11_ranged_split",
    f"""SELECT idx, idx // c AS rank, idx % c AS rank_pos FROM ({LINEITEM_SQL}), (SELECT {N_SQL} // 7 AS c) WHERE idx < c * 7 AND idx % c >= 100""",
)
def _(spark, sf):
    rows = indexed_lineitem(spark, sf, [])
    return splits.ranged(rows, "idx", ix.total_rows(rows), 7, resume_at=100)


@query(
    "w12_chunked_split",
    f"SELECT idx, idx // c AS rank, idx % c AS rank_pos FROM ({LINEITEM_SQL}), (SELECT ({N_SQL} + 6) // 7 AS c)",
)
def _(spark, sf):
    rows = indexed_lineitem(spark, sf, [])
    return splits.chunked(rows, "idx", ix.total_rows(rows), 7)


PADDED_SQL = """WITH n AS (SELECT count(*) AS n, (count(*) + 6) // 7 AS c FROM documents),
p AS (SELECT doc_id, doc_id AS pos, c FROM documents, n UNION ALL SELECT doc_id, doc_id + n, c FROM documents, n WHERE doc_id + n < c * 7)"""


@query("w13_local_split", f"{PADDED_SQL} SELECT doc_id, pos, pos // c AS rank FROM p")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return splits.local(docs, "doc_id", ix.total_rows(docs), 7)


@query("w14_strided_split", f"{PADDED_SQL} SELECT doc_id, pos, pos % 7 AS rank FROM p")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return splits.strided(docs, "doc_id", ix.total_rows(docs), 7)


@query(
    "w15_balanced_mix",
    f"""WITH s AS (SELECT 'data/set' || ordinal % 3 || '/part-' || ordinal || '.tar' AS url, 'set' || ordinal % 3 AS part FROM ({SHARDS_SQL})),
d AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {uniform_sql(3, 'url')}, url) - 1 AS pos FROM s),
b AS (SELECT url, part, pos % 4 AS bucket, pos // 4 AS round FROM d)
SELECT url, bucket, round, row_number() OVER (ORDER BY bucket, round, {uniform_sql(3, 'part', 'bucket', 'round')}, part) - 1 AS place FROM b""",
)
def _(spark, sf):
    from pyspark.sql import Window

    o = F.col("ordinal")
    url = F.concat(F.lit("data/set"), (o % 3).cast("string"), F.lit("/part-"), o.cast("string"), F.lit(".tar"))
    shards = order_shards(spark, sf).select(url.alias("url")).withColumn("part", parent_dir(F.col("url")))
    mixed = splits.balanced_mix(shards, 4, 3, "part")
    # The shard list is small: one line per shard.
    line = Window.partitionBy(F.lit(0)).orderBy("bucket", "round", "turn", "part")
    return mixed.select("url", "bucket", "round", (F.row_number().over(line) - 1).cast("bigint").alias("place"))


# ------------------------------------------------------------ sorts and top-k


@query(
    "t1_reading_order",
    f"""SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_filter(annotations, lambda a: {blank_free('a.text')}), lambda a: {{'y': a.y, 'x': a.x, 'i': a.i}})), lambda s: s.i), ',') AS reading_order FROM ({ANNOTATED_SQL})""",
)
def _(spark, sf):
    entries = reading_entries(F.col("annotations"), keep_all, -1.0)
    order = F.array_join(F.transform(entries, lambda e: e["ordinal"].cast("string")), ",")
    return annotated_turns(spark, sf).select("conv_id", "turn", order.alias("reading_order"))


@query("t2_global_sort", "SELECT doc_id, source || '/' || printf('%09d', doc_id) AS key FROM documents ORDER BY key")
def _(spark, sf):
    key = F.concat("source", F.lit("/"), F.format_string("%09d", F.col("doc_id")))
    return table(spark, sf, "documents").select("doc_id", key.alias("key")).orderBy("key")


@query("t3_prefix_limit", "SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT count(*) * 2 // 3 FROM orders)")
def _(spark, sf):
    return ix.first_rows(spark, f"{sf}/orders.parquet", 2 / 3, ["o_orderkey"]).select("o_orderkey")


@query("t4_slice", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 20 OFFSET 10")
def _(spark, sf):
    rows = ix.with_global_index(spark, f"{sf}/benchmark.parquet", ["item_id", "text"])
    return rows.where((F.col("global_index") < 35) & F.col("global_index").between(10, 29)).select("item_id", "text")


PROTO_SQL = """SELECT label AS proto, arg_min(embedding, vec_id)::DOUBLE[] AS vec FROM embeddings WHERE label < 9 GROUP BY label"""
COSINES_SQL = f"""SELECT e.vec_id, p.proto, e.label, list_cosine_similarity(e.embedding::DOUBLE[], p.vec) AS c FROM embeddings e, ({PROTO_SQL}) p"""
ROUTED_SQL = f"""SELECT vec_id, CASE WHEN any_value(label) = 9 THEN 9 ELSE arg_max(proto, {{'c': c, 'o': -proto}}) END::BIGINT AS proto,
  CASE WHEN any_value(label) = 9 THEN 1.0 ELSE max(c) END::DOUBLE AS weight, any_value(label) <> 9 AS routed FROM ({COSINES_SQL}) GROUP BY vec_id"""


def prototypes(spark, sf):
    rows = table(spark, sf, "embeddings").where("label < 9")
    return rows.groupBy(F.col("label").cast("bigint").alias("proto")).agg(F.min_by("embedding", "vec_id").alias("vec"))


def routed_vectors(spark, sf, **how):
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    return routing.assign(vectors, prototypes(spark, sf), "vec_id", null_row=F.col("label") == 9, null_proto=9, **how)


@query("t5_top1_cosine", f"SELECT vec_id, proto, round(weight, 6) AS weight, routed FROM ({ROUTED_SQL})")
def _(spark, sf):
    return routed_vectors(spark, sf).select("vec_id", "proto", F.round("weight", 6).alias("weight"), "routed")


# A prototype per hundred vectors, so that the list grows with the table and is kept in blocks.
MANY_SQL = """SELECT vec_id AS proto, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 100 = 0"""
ROUTED_MANY_SQL = f"""SELECT vec_id, arg_max(proto, {{'c': c, 'o': -proto}}) AS proto, max(c) AS weight FROM (
  SELECT e.vec_id, p.proto, list_cosine_similarity(e.embedding::DOUBLE[], p.vec) AS c FROM embeddings e, ({MANY_SQL}) p) GROUP BY vec_id"""


def many_prototypes(spark, sf):
    rows = table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("proto"), F.col("embedding").alias("vec"))


def routed_in_blocks(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return routing.assign(vectors, many_prototypes(spark, sf), "vec_id", in_blocks=True)


@query("t5_blocked_top1", f"SELECT vec_id, proto, round(weight, 6) AS weight, true AS routed FROM ({ROUTED_MANY_SQL})")
def _(spark, sf):
    return routed_in_blocks(spark, sf).select("vec_id", "proto", F.round("weight", 6).alias("weight"), "routed")


@query(
    "t6_chunks",
    "SELECT doc_id // 32 AS chunk, string_agg(doc_id || lang, ',' ORDER BY doc_id) AS items FROM documents GROUP BY ALL",
)
def _(spark, sf):
    rows = ix.chunks(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 32, ["lang"])
    text = F.transform("items", lambda i: F.concat(i["doc_id"].cast("string"), i["lang"]))
    return rows.select("chunk", F.array_join(text, ",").alias("items"))


# ------------------------------------------------------------ sampling and shuffles

CHOICE_SQL = f"""WITH s AS (SELECT *, ordinal AS o, pow(score, 1 / 0.5::DOUBLE) AS w FROM ({SCORES_SQL}) WHERE caption_type <> 'absent'),
k AS (SELECT *, ln(1 - {uniform_sql(11, 'doc_id', 'ordinal')}) / w AS race FROM s WHERE score >= 0.5),
d AS (SELECT doc_id, arg_max(caption_type, race) AS t FROM k GROUP BY doc_id),
f AS (SELECT doc_id, caption_type AS t, arg_min(score, o) AS first_score FROM k GROUP BY ALL),
b AS (SELECT doc_id, arg_max(caption_type, {{'s': score, 'o': -o}}) AS t, max(score) AS score FROM s GROUP BY doc_id)
SELECT b.doc_id, coalesce(d.t, b.t) AS caption_type, coalesce(f.first_score, b.score) AS score
FROM b LEFT JOIN d USING (doc_id) LEFT JOIN f ON f.doc_id = d.doc_id AND f.t = d.t"""


@query("r1_weighted_caption", CHOICE_SQL)
def _(spark, sf):
    scores = caption_scores(spark, sf).where("caption_type <> 'absent'")
    return sampling.weighted_caption(scores, ["doc_id"], 0.5, 0.5, 11)


@query(
    "r2_sample_rows",
    f"""SELECT doc_id, array_to_string({SHORT_LINES_SQL}, ' ') AS visible_text FROM documents
WHERE doc_id NOT IN (SELECT item_id * 5 FROM benchmark) AND array_to_string({SHORT_LINES_SQL}, ' ') <> ''
ORDER BY {uniform_sql(20, 'doc_id')}, doc_id LIMIT 10""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    excluded = table(spark, sf, "benchmark").select((F.col("item_id") * 5).alias("doc_id"))
    kept = docs.join(excluded, "doc_id", "left_anti")
    shown = F.array_join(short_lines("text"), " ")
    eligible = with_value_where(kept, "visible_text", shown, lambda v: v != "").drop("text")
    return sampling.sample_rows(eligible, "doc_id", 10, 20)


S1 = 17 + SEED_EPOCH_STRIDE


@query(
    "r3_shard_shuffle",
    f"""SELECT idx, idx // 1000 AS shard, {uniform_sql(S1, "'shard'", 'idx // 1000')} AS shard_order, {uniform_sql(S1, "'row'", 'idx')} AS row_order FROM ({LINEITEM_SQL})""",
)
def _(spark, sf):
    rows = indexed_lineitem(spark, sf, []).withColumn("shard", F.expr("idx div 1000"))
    return sampling.in_shuffled_order(sampling.shard_shuffle(rows, "shard", "idx", 17, 1), "shard", "idx")


@query(
    "r4_chunk_shuffle",
    f"""SELECT idx, (idx - 500) // 2000 AS chunk, ((idx - 500) // 2000)::DOUBLE AS shard_order, {uniform_sql(17, "'row'", 'idx')} AS row_order
FROM ({LINEITEM_SQL}) WHERE idx >= 500 AND idx < {N_SQL} - 500""",
)
def _(spark, sf):
    rows = indexed_lineitem(spark, sf, [])
    return sampling.chunk_shuffle(rows, "idx", 500, ix.total_rows(rows) - 500, 2000, 17, 0)


@query(
    "r5_permutation",
    f"SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql(8, 'doc_id')}, doc_id) - 1 AS position FROM documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return sampling.permutation(docs, "doc_id", docs.count(), 5, 3)


@query(
    "r6_repeat",
    "SELECT n_nationkey, repeat_no FROM nation, (SELECT unnest(range(2000)) AS repeat_no)",
)
def _(spark, sf):
    return sampling.repeat_rows(table(spark, sf, "nation").select("n_nationkey"), 2000)


@query(
    "r7_stable_seeds",
    f"SELECT c_custkey, (42 + c_nationkey::BIGINT * {SEED_CLASS_STRIDE} + c_custkey)::BIGINT AS seed FROM customer",
)
def _(spark, sf):
    seed = stable_seed(42, F.col("c_nationkey"), F.col("c_custkey"), SEED_CLASS_STRIDE)
    return table(spark, sf, "customer").select("c_custkey", seed.alias("seed"))


NORMAL_SQL = f"sqrt(-2 * ln(1 - {uniform_sql('5a', 'vec_id')})) * cos(6.283185307179586::DOUBLE * {uniform_sql('5b', 'vec_id')})"


@query(
    "r8_noise_levels",
    f"""WITH t AS (SELECT vec_id, {uniform_sql(5, 'vec_id')} AS u, 1 / (1 + exp(-({NORMAL_SQL}))) AS l, atan(exp({NORMAL_SQL}) / 0.5::DOUBLE) AS g FROM embeddings),
m AS (SELECT *, 1 - u - 1.29::DOUBLE * (pow(cos(pi() * u / 2), 2) - 1 + u) AS m FROM t)
SELECT vec_id, round(u, 6) AS uniform, round(l, 6) AS logit_normal, round(m, 6) AS mode, round(g, 6) AS trigflow,
  round(l / (l + (1 - l) * 4), 6) AS shifted, floor(u * 1000)::INTEGER AS step FROM m""",
)
def _(spark, sf):
    key = F.col("vec_id")
    levels = {s: sampling.noise_level(s, 5, key) for s in ("uniform", "logit_normal", "mode", "logit_normal_trigflow")}
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(levels["uniform"], 6).alias("uniform"),
        F.round(levels["logit_normal"], 6).alias("logit_normal"),
        F.round(levels["mode"], 6).alias("mode"),
        F.round(levels["logit_normal_trigflow"], 6).alias("trigflow"),
        F.round(sampling.shift_level(levels["logit_normal"], 4.0), 6).alias("shifted"),
        sampling.noise_step(levels["uniform"], 1000).alias("step"),
    )
