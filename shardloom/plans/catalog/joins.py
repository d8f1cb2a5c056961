"""Registered queries: joins (J) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.fixed_values import ASPECT_RATIO_512
from ...functions.names import output_name, image_key
from ...operators import buckets, joins, sets
from ...operators import index as ix
from ...session import materialise
from ...sources import ledger
from ..training_batches import training_batches
from .common import (
    LINEITEM_SQL,
    SCORES_SQL,
    SHARDS_SQL,
    SIZED_SQL,
    bucketed_sql,
    caption_scores,
    indexed_lineitem,
    order_shards,
    query,
    sized_lineitem,
    table,
    uniform_sql,
)

CAPTIONS_SQL = """SELECT doc_id, 0 AS suffix_ordinal, 'short' AS caption_type, 'q' || quality AS text FROM labels
UNION ALL SELECT doc_id, 1, 'short', 'Q' || quality || toxic FROM labels WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 1, 'long', 't' || toxic FROM labels"""


def sidecar_captions(spark, sf):
    labels = table(spark, sf, "labels")
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")

    def line(ordinal, kind, text):
        return F.struct(F.lit(ordinal).alias("suffix_ordinal"), F.lit(kind).alias("caption_type"), text.alias("text"))

    lines = F.array(
        line(0, "short", F.concat(F.lit("q"), q)),
        F.when(F.col("doc_id") % 2 == 0, line(1, "short", F.concat(F.lit("Q"), q, t))),
        line(1, "long", F.concat(F.lit("t"), t)),
    )
    return labels.select("doc_id", F.explode(F.array_compact(lines)).alias("l")).select("doc_id", "l.*")


def sample_fields(spark, sf):
    fields = F.create_map(F.lit("prompt"), F.col("lang"), F.lit("short"), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", fields.alias("fields"))


@query(
    "j1_caption_overlay",
    f"""WITH c AS (SELECT doc_id, caption_type, arg_max(text, suffix_ordinal) AS text FROM ({CAPTIONS_SQL}) GROUP BY ALL),
f AS (SELECT doc_id, 'prompt' AS k, lang AS v FROM documents UNION ALL SELECT doc_id, 'short', source FROM documents),
m AS (SELECT coalesce(f.doc_id, c.doc_id) AS doc_id, coalesce(k, caption_type) AS k, coalesce(text, v) AS v
  FROM f FULL JOIN (SELECT c.* FROM c JOIN documents USING (doc_id)) c ON f.doc_id = c.doc_id AND k = caption_type)
SELECT doc_id, string_agg(k || '=' || v, ',' ORDER BY k) AS fields FROM m GROUP BY doc_id""",
)
def _(spark, sf):
    merged = joins.overlay_captions(sample_fields(spark, sf), sidecar_captions(spark, sf), ["doc_id"])
    entries = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select("doc_id", F.array_join(entries, ",").alias("fields"))


@query(
    "j2_score_join",
    f"SELECT s.doc_id, ordinal, caption_type, score FROM ({SCORES_SQL}) s JOIN documents USING (doc_id) WHERE caption_type IN ('prompt', 'short')",
)
def _(spark, sf):
    found = joins.scores_of_present_types(sample_fields(spark, sf), caption_scores(spark, sf), ["doc_id"])
    return found.select("doc_id", "ordinal", "caption_type", "score")


@query(
    "j3_strict_lookup",
    "SELECT l.doc_id, d.lang AS label FROM labels l JOIN documents d USING (doc_id)",
)
def _(spark, sf):
    keys = table(spark, sf, "labels").select("doc_id")
    labels = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return joins.strict_lookup(keys, labels, "doc_id").select("doc_id", "label")


@query(
    "j3_missing_labels",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(spark, sf):
    return joins.missing_labels(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


def uneven_shards(spark, sf):
    """Shard list over all lineitem rows with very uneven sizes: lines per supplier."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ordinal")).agg(F.count(F.lit(1)).alias("nsamples"))
    return lines.withColumn("url", F.format_string("supp-%05d.tar", F.col("ordinal")))


UNEVEN_SQL = """SELECT ordinal, url, nsamples, (sum(nsamples) OVER (ORDER BY ordinal) - nsamples)::BIGINT AS start,
  (sum(nsamples) OVER (ORDER BY ordinal))::BIGINT AS stop
FROM (SELECT l_suppkey AS ordinal, printf('supp-%05d.tar', l_suppkey) AS url, count(*) AS nsamples FROM lineitem GROUP BY ALL)"""


@query(
    "j4_shard_range_join",
    f"""SELECT l.idx, s.url, l.idx - s.start AS inner_index FROM ({LINEITEM_SQL}) l
ASOF JOIN ({UNEVEN_SQL}) s ON l.idx >= s.start""",
)
def _(spark, sf):
    rows = indexed_lineitem(spark, sf, [])
    found = ix.locate(rows, "idx", ix.shard_ranges(uneven_shards(spark, sf)))
    return found.select("idx", "url", (F.col("idx") - F.col("start")).alias("inner_index"))


@query(
    "j5_nearest_bucket",
    f"SELECT idx, ratio, bucket_h, bucket_w FROM ({bucketed_sql(SIZED_SQL, ASPECT_RATIO_512)})",
)
def _(spark, sf):
    return buckets.with_bucket(sized_lineitem(spark, sf), "height", "width").select("idx", "ratio", "bucket_h", "bucket_w")


def held_out(spark, sf):
    return table(spark, sf, "benchmark").select((F.col("item_id") * 5).alias("doc_id"))


@query(
    "j6_holdout_exclusion",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT item_id * 5 FROM benchmark)",
)
def _(spark, sf):
    return joins.exclude_holdout(table(spark, sf, "documents").select("doc_id", "lang"), held_out(spark, sf), "doc_id")


@query(
    "j7_pair_completeness",
    """WITH m AS (SELECT l_orderkey // 100 AS shard, l_orderkey AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'jpg' ELSE 'json' END AS ext,
  trunc(l_quantity)::INTEGER // 10 AS width, 5 AS height FROM lineitem),
k AS (SELECT shard, key, count(*) FILTER (ext = 'jpg') AS i, count(*) FILTER (ext = 'json') AS j, count(DISTINCT width) AS sizes FROM m GROUP BY ALL),
f AS (SELECT shard, count(*) AS found, count(*) FILTER (i = 0 OR j = 0) AS unpaired, count(*) FILTER (sizes > 1) AS size_conflicts FROM k GROUP BY ALL),
s AS (SELECT o_orderkey // 100 AS shard, count(*) AS n FROM orders GROUP BY ALL)
SELECT shard, coalesce(n, 0) AS declared, coalesce(found, 0) AS found, coalesce(unpaired, 0) AS unpaired,
  coalesce(size_conflicts, 0) AS size_conflicts, (n IS NOT DISTINCT FROM found) AS count_ok FROM s FULL JOIN f USING (shard)""",
)
def _(spark, sf):
    members = table(spark, sf, "lineitem").select(
        F.expr("l_orderkey div 100").alias("shard"), F.col("l_orderkey").alias("key"),
        F.when(F.col("l_linenumber") % 2 == 0, "jpg").otherwise("json").alias("ext"),
        F.expr("int(l_quantity) div 10").alias("width"), F.lit(5).alias("height"),
    )
    shards = order_shards(spark, sf).select(F.col("ordinal").alias("shard"), "nsamples")
    return joins.pair_report(members, shards)


LEDGER_SQL = """SELECT o_orderpriority AS name, count(*) AS n, md5(count(*)::VARCHAR) AS fp FROM orders GROUP BY ALL"""


def priority_inputs(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("fp", F.md5(F.col("rows").cast("string")))


def recorded_ledger(spark, sf):
    """A ledger in which some inputs are open, changed, or without shards."""
    first = F.substring("name", 1, 1)
    return priority_inputs(spark, sf).where(first != "1").select(
        "name", F.when(first == "2", "open").otherwise("complete").alias("status"), "rows",
        F.when(first == "4", 0).otherwise(3).cast("bigint").alias("shards"),
        F.when(first == "5", "other").otherwise(F.col("fp")).alias("source_before"), F.col("fp").alias("source_after"),
        F.lit("2024-01-01").alias("completed_at"),
    )


@query(
    "j8_ledger_reconciliation",
    f"""SELECT 'fingerprint' AS kind, name FROM ({LEDGER_SQL}) WHERE name LIKE '5%'
UNION ALL SELECT 'shard list', url FROM ({SHARDS_SQL}) WHERE ordinal % 10 = 3""",
)
def _(spark, sf):
    before = priority_inputs(spark, sf).select("name", "fp")
    after = before.withColumn("fp", F.when(F.col("name").startswith("5"), "other").otherwise(F.col("fp")))
    shards = order_shards(spark, sf)
    recorded = shards.withColumn("nsamples", F.col("nsamples") + F.when(F.col("ordinal") % 10 == 3, 1).otherwise(0))
    return ledger.reconcile(before, after, shards, recorded).distinct()


@query(
    "j9_condition_seeds",
    """SELECT n_nationkey AS condition, s.seed_no, n_nationkey::BIGINT * (SELECT ceil(count(*) / 25.0)::BIGINT FROM part) + s.seed_no AS row_no
FROM nation, (SELECT unnest(range((SELECT ceil(count(*) / 25.0)::BIGINT FROM part))) AS seed_no) s""",
)
def _(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("condition"))
    limit = ix.total_rows(table(spark, sf, "part"))
    made = joins.condition_seeds(nations, "condition", F.ceil(limit / ix.total_rows(nations)))
    return made.select("condition", "seed_no", "row_no")


@query(
    "j10_cyclic_zip",
    """SELECT d.doc_id, n.n_name AS label FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25""",
)
def _(spark, sf):
    tiles = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"))
    labels = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("pos"), F.col("n_name").alias("label"))
    # Documents come in any number: the last round of labels may be cut short.
    zipped = joins.cyclic_zip(tiles, labels, ix.total_rows(tiles), ix.total_rows(labels), whole_rounds=False)
    return zipped.select(F.col("pos").alias("doc_id"), "label")


@query(
    "j11_pending_outputs",
    """WITH w AS (SELECT doc_id, substr(text, 1, 100) || '.jpg' AS name FROM documents)
SELECT doc_id, name FROM w WHERE name NOT IN (SELECT name FROM w WHERE doc_id IN (SELECT doc_id FROM labels))""",
)
def _(spark, sf):
    work = table(spark, sf, "documents").select("doc_id", output_name(F.col("text")).alias("name"))
    done = work.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return joins.pending(work, done, "name").select("doc_id", "name")


@query(
    "j12_input_state",
    f"""SELECT name, CASE substr(name, 1, 1) WHEN '1' THEN 'todo' WHEN '2' THEN 'todo' WHEN '3' THEN 'done' WHEN '4' THEN 'no shards'
  ELSE 'fingerprint changed' END AS state FROM ({LEDGER_SQL})""",
)
def _(spark, sf):
    return ledger.input_state(priority_inputs(spark, sf).select("name", "fp"), recorded_ledger(spark, sf))


@query(
    "j13_order_audit",
    f"""SELECT count(*) AS checked, count(*) FILTER (doc_id % 7 = 3) AS mismatches FROM documents
WHERE doc_id = 0 OR {uniform_sql('audit', 'doc_id')} < 0.25""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    real = docs.withColumn("key", image_key(F.col("doc_id")))
    cache = docs.withColumn("key", image_key(F.col("doc_id") + F.when(F.col("doc_id") % 7 == 3, 1).otherwise(0)))
    return joins.order_audit(cache, real, "doc_id", 0.25, "audit")


@query(
    "j14_substitutes",
    f"""WITH b AS (SELECT idx, ratio, height = 7 AS bad FROM ({bucketed_sql(SIZED_SQL, ASPECT_RATIO_512)})),
g AS (SELECT ratio, idx AS replacement, row_number() OVER (PARTITION BY ratio ORDER BY idx) - 1 AS k FROM b WHERE NOT bad),
n AS (SELECT ratio, count(*) AS n FROM g GROUP BY ratio),
w AS (SELECT idx, b.ratio, floor({uniform_sql('again', 'idx')} * n)::BIGINT AS k FROM b LEFT JOIN n USING (ratio) WHERE bad),
x AS (SELECT idx, (SELECT min(i) FROM unnest(range(idx + 1, idx + 11)) t(i) WHERE i IN (SELECT replacement FROM g)) AS next_index FROM w)
SELECT w.idx, w.ratio, g.replacement, x.next_index FROM w LEFT JOIN g ON g.ratio = w.ratio AND g.k = w.k JOIN x ON x.idx = w.idx""",
)
def _(spark, sf):
    bucketed = buckets.with_bucket(sized_lineitem(spark, sf), "height", "width")
    rows = materialise(bucketed.select("idx", "ratio", (F.col("height") == 7).alias("bad")), "bucketed")
    drawn = buckets.substitutes(rows, "idx", F.col("bad"), "again", block_rows=1 << 14)
    return drawn.join(buckets.next_good(rows, "idx", F.col("bad"), dense=True), "idx").select("idx", "ratio", "replacement", "next_index")


# ------------------------------------------------------------ set operations


@query(
    "u1_append_lists",
    "SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM benchmark",
)
def _(spark, sf):
    prompts = table(spark, sf, "benchmark").select("text")
    return sets.append_all(table(spark, sf, "documents").select("text"), prompts, prompts)


@query(
    "u2_key_relation",
    """SELECT coalesce(d.k, b.k) AS doc_id, CASE WHEN d.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT doc_id AS k FROM documents) d FULL JOIN (SELECT DISTINCT item_id * 60 AS k FROM benchmark) b ON d.k = b.k""",
)
def _(spark, sf):
    right = table(spark, sf, "benchmark").select((F.col("item_id") * 60).alias("doc_id"))
    return sets.key_relation(table(spark, sf, "documents").select("doc_id"), right, "doc_id")


@query(
    "u3_interval_intersection",
    f"""SELECT ordinal, greatest(start, 1000)::BIGINT AS start, least(stop, 5000)::BIGINT AS stop FROM ({UNEVEN_SQL})
WHERE greatest(start, 1000) < least(stop, 5000)""",
)
def _(spark, sf):
    ranges = sets.lengths_to_ranges(uneven_shards(spark, sf), "ordinal", "nsamples")
    return sets.intersect_range(ranges, 1000, 5000).select("ordinal", "start", "stop")


@query(
    "u4_multiset_equality",
    f"""WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT c_custkey FROM customer)
SELECT k, coalesce(x, 0)::BIGINT AS left_n, coalesce(y, 0)::BIGINT AS right_n FROM (SELECT k, count(*) AS x FROM a GROUP BY k) FULL JOIN (SELECT k, count(*) AS y FROM b GROUP BY k) USING (k)
WHERE coalesce(x, 0) <> coalesce(y, 0)""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    left = orders.select(F.col("o_custkey").alias("k"))
    right = orders.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("k")).unionByName(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    )
    return sets.multiset_difference(left, right)


@query(
    "u5_new_lines_only",
    "SELECT text FROM documents WHERE text NOT IN (SELECT text FROM benchmark) AND text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 0)",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    low = docs.join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id").select("text")
    existing = sets.append_all(table(spark, sf, "benchmark").select("text"), low)
    return sets.refuse_existing(docs.select("text"), existing, "text", strict=False)


# ------------------------------------------------------------ shards to training batches

SIZED_DOCS_SQL = """SELECT doc_id, lang, source, (n_chars % 900 + 1)::INTEGER AS height, (doc_id % 700 + 1)::INTEGER AS width FROM documents"""


@query(
    "flagship_training_batches",
    f"""WITH c AS (SELECT doc_id, caption_type, arg_max(text, suffix_ordinal) AS text FROM ({CAPTIONS_SQL}) GROUP BY ALL),
f AS (SELECT doc_id, 'prompt' AS k, lang AS v FROM documents UNION ALL SELECT doc_id, 'short', source FROM documents),
m AS (SELECT coalesce(f.doc_id, c.doc_id) AS doc_id, coalesce(k, caption_type) AS k, coalesce(text, v) AS v
  FROM f FULL JOIN (SELECT c.* FROM c JOIN documents USING (doc_id)) c ON f.doc_id = c.doc_id AND k = caption_type),
s AS (SELECT sc.*, ordinal AS o, pow(score, 1 / 0.5::DOUBLE) AS w FROM ({SCORES_SQL}) sc JOIN m ON m.doc_id = sc.doc_id AND m.k = sc.caption_type),
r AS (SELECT *, ln(1 - {uniform_sql(23, 'doc_id', 'ordinal')}) / w AS race FROM s WHERE score >= 0.5),
d AS (SELECT doc_id, arg_max(caption_type, race) AS t FROM r GROUP BY doc_id),
b AS (SELECT doc_id, arg_max(caption_type, {{'s': score, 'o': -o}}) AS t FROM s GROUP BY doc_id),
n AS (SELECT count(*) // 5 AS size FROM documents),
z AS (SELECT x.doc_id, x.ratio, x.doc_id // n.size AS rank, coalesce(d.t, b.t, 'prompt') AS t, x.lang || chr(10) || x.source AS transcript
  FROM ({bucketed_sql(SIZED_DOCS_SQL, ASPECT_RATIO_512)}) x LEFT JOIN d USING (doc_id) LEFT JOIN b USING (doc_id), n WHERE x.doc_id < n.size * 5),
p AS (SELECT z.*, coalesce(m.v, q.v) AS caption, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY rank, ratio) AS total
  FROM z LEFT JOIN m ON m.doc_id = z.doc_id AND m.k = z.t LEFT JOIN m q ON q.doc_id = z.doc_id AND q.k = 'prompt'
  WINDOW w AS (PARTITION BY rank, ratio ORDER BY z.doc_id))
SELECT rank, ratio, pos // 8 AS batch_no, bool_and((pos // 8 + 1) * 8 <= total) AS "full", max(doc_id) AS emit_at,
  string_agg(doc_id, ',' ORDER BY doc_id) AS members, string_agg(t || ':' || caption, '|' ORDER BY doc_id) AS captions,
  md5(string_agg(transcript, '|' ORDER BY doc_id)) AS transcripts_md5
FROM p GROUP BY rank, ratio, pos // 8""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    samples = docs.select(
        "doc_id", F.create_map(F.lit("prompt"), F.col("lang"), F.lit("short"), F.col("source")).alias("fields"),
        F.lit(None).cast("array<struct<polygon:array<array<float>>,text:string,valid:boolean,rec_score:double>>").alias("annotations"),
        F.array("lang", "source").alias("texts"), (F.col("n_chars") % 900 + 1).cast("int").alias("height"),
        (F.col("doc_id") % 700 + 1).cast("int").alias("width"),
    )
    batches = training_batches(
        samples, sidecar_captions(spark, sf), caption_scores(spark, sf), "doc_id", 5, 8, 23, block_rows=1 << 12
    )
    named = F.zip_with("caption_type", "caption", lambda t, c: F.concat_ws(":", t, c))
    return batches.select(
        "rank", "ratio", "batch_no", "full", "emit_at", F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("members"),
        F.array_join(named, "|").alias("captions"), F.md5(F.array_join("transcript", "|")).alias("transcripts_md5"),
    )
