"""Literal cases: known inputs with known results."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardloom.functions import annotations as ann
from shardloom.functions import geometry as geo
from shardloom.functions import names as nm
from shardloom.functions import text as tx
from shardloom.functions.fixed_values import ASPECT_RATIO_512, ASPECT_RATIO_1024
from shardloom.functions.image_header import image_size
from shardloom.operators import routing, splits, verify
from shardloom.operators.worklist import parse_class_counts


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(columns_schema(columns))) if columns else spark.range(1)
    return row.select(expression.alias("r")).first()["r"]


def columns_schema(columns):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", type(None): "string"}
    return [f"{n} {kinds[type(v)]}" for n, v in columns.items()]


def box(top, left, bottom, right):
    return [[left, top], [right, top], [right, bottom], [left, bottom]]


OCR = [
    [box(254, 276, 283, 748), ["FOCUSING ON EGRETS", 0.9679]],
    [box(197, 356, 226, 658), ["KEEP CALM BY", 0.9662]],
    [box(0, 0, 1, 1), ["LOW CONFIDENCE", 0.5]],
]


def test_transcript_reads_top_to_bottom_and_drops_low_scores(spark):
    entries = ann.from_positional(F.col("p"))
    line = ann.transcript(entries, F.array().cast("array<string>"), ann.keep_valid, 0.95)
    assert one(spark, line, p=json.dumps(OCR)) == "KEEP CALM BY\nFOCUSING ON EGRETS"


def test_rejected_labels_do_not_come_back_as_plain_texts(spark):
    entries = ann.from_positional(F.col("p"))
    line = ann.transcript(entries, F.array(F.lit("LOW CONFIDENCE")), ann.keep_valid, 0.95)
    assert one(spark, line, p=json.dumps(OCR[2:])) == ""
    assert one(spark, line, p="[]") == "LOW CONFIDENCE"


def test_equal_score_is_kept_and_missing_score_counts_as_one(spark):
    doc = json.dumps([{"text": "a", "rec_score": 0.5}, {"text": "b"}, {"text": "c", "rec_score": 0.49}])
    line = ann.transcript(ann.from_json_text(F.col("p")), F.array().cast("array<string>"), ann.keep_flag, 0.5, "|")
    assert one(spark, line, p=doc) == "a|b"


def test_valid_has_two_readings(spark):
    doc = json.dumps(
        [{"text": "null", "valid": None}, {"text": "absent"}, {"text": "no", "valid": False}, {"text": "yes", "valid": True}]
    )
    entries = ann.from_json_text(F.col("p"))
    assert one(spark, F.array_join(ann.prompt_texts(entries), "|"), p=doc) == "null|absent|yes"
    line = ann.transcript(entries, F.array().cast("array<string>"), ann.keep_flag, 0.0, "|")
    assert one(spark, line, p=doc) == "absent|yes"


def test_bad_polygons_come_last_and_ties_keep_their_order(spark):
    doc = json.dumps(
        [{"text": "no box"}, {"text": "odd", "polygon": [[1.0, 2.0], [3.0]]}, {"text": "empty", "polygon": []},
         {"text": "first", "polygon": box(1, 5, 3, 9)}, {"text": "second", "polygon": box(1, 5, 3, 9)},
         {"text": "left", "polygon": box(1, 0, 3, 4)}]
    )
    line = ann.transcript(ann.from_json_text(F.col("p")), F.array().cast("array<string>"), ann.keep_flag, 0.0, "|")
    assert one(spark, line, p=doc) == "left|first|second|no box|odd|empty"


@pytest.mark.parametrize(
    "texts, expected",
    [
        ([], "A red sign."),
        (["GO"], 'A red sign, with the visible word "GO" clearly rendered in the image.'),
        (["GO", "ON"], 'A red sign, with the visible words "GO" and "ON" clearly rendered in the image.'),
        (["A", "B", "C"], 'A red sign, with the visible words "A", "B", and "C" clearly rendered in the image.'),
        (["A", "B", "C", "D"], 'A red sign, with the visible words "A", "B", "C", and "D" clearly rendered in the image.'),
    ],
)
def test_prompt_conjunctions(spark, texts, expected):
    column = F.array(*[F.lit(t) for t in texts]).cast("array<string>")
    clean = tx.clean_caption(F.col("c"))
    assert one(spark, tx.visible_text_prompt(clean, column), c="  A   red * sign. ") == expected


def test_empty_captions(spark):
    assert one(spark, tx.clean_caption(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.clean_caption(F.col("c")), c=" * ") == ""
    prompt = tx.visible_text_prompt(tx.clean_caption(F.col("c")), F.array(F.lit("GO")))
    assert one(spark, prompt, c="*") == ', with the visible word "GO" clearly rendered in the image.'


def test_space_normalisation_equals_python(spark):
    raw = " a\x1c b 　c\x85\td​e "
    assert one(spark, tx.squeeze(F.col("t")), t=raw) == " ".join(raw.split())
    assert one(spark, tx.strip(F.col("t")), t=raw) == raw.strip()


def class_lines(spark, text):
    rows = spark.createDataFrame([(1, text)], "id int, request string")
    return parse_class_counts(rows, "request", ["id"]).orderBy("class_id").collect()


def test_class_counts(spark):
    found = class_lines(spark, '{"207": 2, "0": 4}')
    assert [(r.class_id, r.n, r.reject) for r in found] == [(0, 4, None), (207, 2, None)]


@pytest.mark.parametrize("text", ['{}', '{"1000": 1}', '{"0": 0}', '{"cat": 1}', '{"1": true}', '{"1": 1.5}', '{"01": 1}', '{"-0": 1}', "[1]", "nope"])
def test_class_counts_rejected(spark, text):
    assert all(r.reject is not None for r in class_lines(spark, text))


def test_tasks_are_dealt_once_each(spark):
    counts = spark.createDataFrame([(7, 3), (0, 4)], "class_id int, n bigint")
    tasks = splits.round_robin_tasks(counts, 3).collect()
    pairs = [(t.class_id, t.image_index) for t in tasks]
    assert sorted(pairs) == [(0, i) for i in range(4)] + [(7, i) for i in range(3)]
    by_worker = {w: sum(t.worker == w for t in tasks) for w in range(3)}
    assert sorted(by_worker.values()) == [2, 2, 3]
    assert all(r.complete for r in verify.worklist_report(splits.round_robin_tasks(counts, 3), counts).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, vec array<float>")


def prototypes(spark, rows):
    return spark.createDataFrame(rows, "proto bigint, vec array<float>")


@pytest.mark.parametrize("shipped", [4096, 1])
def test_routing_picks_the_aligned_prototype(spark, shipped):
    protos = prototypes(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    given = vectors(spark, [(0, 3, [2.0, 0.0]), (1, 3, [0.0, 0.5]), (2, 1000, [1.0, 0.0])])
    routed = routing.assign(given, protos, "vec_id", "vec", F.col("label") == 1000, 2, max_shipped=shipped)
    got = {r.vec_id: (r.proto, round(r.weight, 6), r.routed) for r in routed.collect()}
    assert got == {0: (0, 1.0, True), 1: (1, 1.0, True), 2: (2, 1.0, False)}


def test_one_active_prototype_scores_zero(spark):
    protos = prototypes(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    routed = routing.assign(vectors(spark, [(0, 0, [1.0, 0.1]), (1, 0, [1.0, 0.2])]), protos, "vec_id")
    score = routing.contrastive_score(routing.centroids(routed, 2), protos).first()
    assert (score["active"], score["score"]) == (1, 0.0)


@pytest.mark.parametrize("table", [ASPECT_RATIO_512, ASPECT_RATIO_1024])
def test_nearest_bucket_equals_brute_force(spark, table):
    values = [float(r) for r, _, _ in table]
    points = [v for a, b in zip(values, values[1:]) for v in (a, (a + b) / 2, (a + b) / 2 + 1e-12, (a + b) / 2 - 1e-12)]
    points += [h / w for h in range(1, 80) for w in range(1, 80)] + [1e-9, 1e9, values[-1]]
    rows = spark.createDataFrame([(p,) for p in points], "ratio double")
    got = rows.select("ratio", geo.nearest_bucket(F.col("ratio"), table).alias("n")).collect()
    for r in got:
        distance = [abs(v - r.ratio) for v in values]
        assert r.n == distance.index(min(distance)), r


def test_names(spark):
    assert one(spark, nm.image_key(F.lit(1234567890))) == "12345/img1234567890.png"
    assert one(spark, nm.format_duration(F.lit(360061.9))) == "100:01:01"
    assert one(spark, nm.format_duration(F.lit(None).cast("double"))) == "--:--:--"
    assert one(spark, nm.clean_filename(F.col("t")), t=" ..Café//ﬁx.. ") == "cafe_fix"
    assert one(spark, nm.clean_filename(F.col("t")), t="中") == "untitled"
    assert one(spark, nm.url_merge(F.lit("http://h/a/b;p?q"), F.lit("../c.tar#f"))) == "http://h/a/c.tar#f"
    assert one(spark, nm.url_dir(F.lit("s3://b/x/y.json"))) == "s3://b/x"
    assert one(spark, nm.url_merge(F.lit("file:///a/b"), F.lit("c.tar"))) == "file:///a/b/c.tar"


def test_jpeg_header_size():
    frame = bytes.fromhex("ffd8ffe000104a46494600010100000100010000ffc0001108012c01900301220002110103110 1".replace(" ", ""))
    assert image_size(frame) == (400, 300)
    assert image_size(b"not an image") is None


def test_holdout_rules(spark):
    listed = spark.createDataFrame([("1",), ("1",), ("true",), ("1.5",), ("-1",), ("10",), ("9",)], "value string")
    found = {(r["value"], r["rule"]) for r in verify.holdout_violations(listed, "value", 10).collect()}
    assert found == {
        ("1", "duplicate"), ("true", "not an integer"), ("1.5", "not an integer"), ("-1", "out of range"), ("10", "out of range"),
    }


def test_raise_error_surfaces(spark):
    from shardloom.operators.joins import strict_lookup
    from shardloom.operators.sampling import sample_rows

    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    labels = spark.createDataFrame([("a", 1)], "key string, label int")
    with pytest.raises(PySparkException, match="No label for b"):
        strict_lookup(keys, labels, "key").collect()
    for rows in (keys, keys.where("false")):
        with pytest.raises(PySparkException, match="Not enough"):
            sample_rows(rows, "key", 3, 1).collect()


def test_routing_does_not_depend_on_the_chunks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    points = rng.integers(-2, 3, (40, 3)).astype(float)
    points[7], points[12] = points[3], points[3]
    protos = prototypes(spark, [(i, p.tolist()) for i, p in enumerate(points)])
    rows = [(i // 2, 0, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(400)] + [(900, 0, None), (901, 1000, None)]
    given = vectors(spark, rows)
    got = [
        sorted(map(tuple, routing.assign(given, protos, "vec_id", "vec", F.col("label") == 1000, 99, max_shipped=n).drop("vec").collect()), key=str)
        for n in (4096, 7, 1)
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert {r[0]: r[2:] for r in got[0] if r[0] >= 900} == {900: (None, None, False), 901: (99, 1.0, False)}
    assert all(r[2] not in (7, 12) for r in got[0])


def test_exclusions_out_of_range_stop_the_renumbering(spark):
    from shardloom.operators import index as ix

    rows = spark.range(20).withColumnRenamed("id", "i")
    bad = spark.createDataFrame([(3,), (25,)], "i bigint")
    with pytest.raises(ValueError, match="out of range: 25"):
        ix.dense_renumber(rows, "i", bad, 20)
