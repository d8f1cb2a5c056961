"""Shared pieces of the registered queries: table access, demo inputs, SQL fragments of the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...operators.index import with_global_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the statement it is checked against."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- SQL fragments

SPACE_SQL = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE_SQL}+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def uniform_sql(seed, *keys: str) -> str:
    text = ", ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def ratio_table_sql(rows) -> str:
    values = ", ".join(f"({i}, '{r}', {r}::DOUBLE, {h}, {w})" for i, (r, h, w) in enumerate(rows))
    return f"(VALUES {values}) AS ratios(ordinal, ratio, r, h, w)"


# ---------------------------------------------------------------- demo inputs

LINEITEM_SQL = "SELECT *, row_number() OVER () - 1 AS idx FROM lineitem"


def indexed_lineitem(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """lineitem with its global row index ``idx`` over all its files: the big sample index of the demos."""
    return with_global_index(spark, f"{sf}/lineitem.parquet", columns, "idx").drop("source_file", "source_row")


def sized_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as samples with a height and a width."""
    rows = indexed_lineitem(spark, sf, ["l_orderkey", "l_partkey", "l_quantity"])
    return rows.select(
        "idx", "l_orderkey", F.col("l_quantity").cast("int").alias("height"),
        (F.col("l_partkey") % 50 + 1).cast("int").alias("width"),
    )


SIZED_SQL = f"""SELECT idx, l_orderkey, trunc(l_quantity)::INTEGER AS height, (l_partkey % 50 + 1)::INTEGER AS width
FROM ({LINEITEM_SQL})"""


def bucketed_sql(sized: str, rows) -> str:
    """Nearest bucket by a real cross product with the ratio table: independent of the literal-array form."""
    return f"""SELECT s.*, b.ratio, b.bh AS bucket_h, b.bw AS bucket_w, b.ordinal AS bucket_no
FROM ({sized}) s JOIN (
  SELECT height, width, arg_min(ratio, {{'d': abs(r - height / width), 'o': ordinal}}) AS ratio,
         arg_min(h, {{'d': abs(r - height / width), 'o': ordinal}}) AS bh,
         arg_min(w, {{'d': abs(r - height / width), 'o': ordinal}}) AS bw,
         arg_min(ordinal, {{'d': abs(r - height / width), 'o': ordinal}}) AS ordinal
  FROM (SELECT DISTINCT height, width FROM ({sized})), {ratio_table_sql(rows)}
  GROUP BY height, width) b USING (height, width)"""


def annotated_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as images: each line of the text is an annotation with a box, validity and score."""
    turns = table(spark, sf, "conversations")

    def annotation(t: Column, i: Column) -> Column:
        x = (F.length(t) % 7) * 1.5
        y = (i * 37 % 11) * 2.25
        box = F.array(F.array(x, y), F.array(x + 10, y), F.array(x + 10, y + 4), F.array(x, y + 4))
        return F.struct(
            F.when(i % 6 != 5, box).cast("array<array<float>>").alias("polygon"),
            t.alias("text"),
            F.when(i % 4 != 3, (F.col("role") == "user") | (i % 3 != 0)).alias("valid"),
            F.when(i % 5 != 4, (F.length(t) % 100) / 100.0).alias("rec_score"),
        )

    lines = F.transform(F.split("text", "\n"), annotation)
    none = F.slice(lines, 1, 0)
    return turns.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("turn") % 5 == 4, none).otherwise(lines).alias("annotations"),
    )


ANNOTATED_SQL = """SELECT conv_id, turn, role, text,
  CASE WHEN turn % 5 = 4 THEN [] ELSE list_transform(string_split(text, chr(10)), lambda t, i: {
    'i': i - 1, 'text': t,
    'y': CASE WHEN (i - 1) % 6 = 5 THEN 'Infinity'::FLOAT ELSE (((i - 1) * 37 % 11) * 2.25 + 2)::FLOAT END,
    'x': CASE WHEN (i - 1) % 6 = 5 THEN 'Infinity'::FLOAT ELSE ((length(t) % 7) * 1.5 + 5)::FLOAT END,
    'valid': CASE WHEN (i - 1) % 4 = 3 THEN NULL ELSE (role = 'user' OR (i - 1) % 3 <> 0) END,
    'rec_score': CASE WHEN (i - 1) % 5 = 4 THEN NULL ELSE ((length(t) % 100) / 100.0)::DOUBLE END}) END AS annotations
FROM conversations"""


def caption_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecar scores of caption types per labelled document; two suffix files, one type listed twice."""
    labels = table(spark, sf, "labels")
    q, t, d = F.col("quality"), F.col("toxic"), F.col("doc_id")

    def line(ordinal: int, kind: str, score: Column) -> Column:
        return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("caption_type"), score.cast("double").alias("score"))

    lines = F.array(
        line(0, "prompt", (d * 37 % 101) / 100.0),
        line(1, "short", (d * 53 % 89 + q) / 100.0),
        line(2, "long", (d * 71 % 97 + t) / 100.0),
        line(3, "short", (d * 29 % 83) / 100.0),
        line(4, "absent", (d * 0 + 99) / 100.0),
    )
    return labels.select("doc_id", F.explode(lines).alias("l")).select("doc_id", "l.*")


SCORES_SQL = """SELECT doc_id, unnest(generate_series(0, 4))::INTEGER AS ordinal,
  unnest(['prompt', 'short', 'long', 'short', 'absent']) AS caption_type,
  unnest([(doc_id * 37 % 101) / 100.0::DOUBLE, (doc_id * 53 % 89 + quality) / 100.0::DOUBLE,
          (doc_id * 71 % 97 + toxic) / 100.0::DOUBLE, (doc_id * 29 % 83) / 100.0::DOUBLE, 99 / 100.0::DOUBLE]) AS score
FROM labels"""


def order_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shard list of the demos: one shard per hundred order keys, sizes as found."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    counted = orders.groupBy(F.expr("o_orderkey div 100").alias("ordinal")).agg(F.count(F.lit(1)).alias("nsamples"))
    return counted.select(
        "ordinal",
        F.format_string("shards/part-%05d.tar", F.col("ordinal")).alias("url"),
        "nsamples",
    )


SHARDS_SQL = """SELECT o_orderkey // 100 AS ordinal, printf('shards/part-%05d.tar', o_orderkey // 100) AS url,
  count(*) AS nsamples FROM orders GROUP BY ALL"""
