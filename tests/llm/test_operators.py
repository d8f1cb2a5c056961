"""The corpus operators beside brute force on small, awkward inputs."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shardloom.llm import (
    ann, byte_bpe, components, language, licences, packing, sharding, simhash, substring_dedup, token_counts,
    vector_dedup, vectors as vectors_of, words as words_of,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS, PATTERN = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN


@pytest.fixture(scope="module", autouse=True)
def scratch(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def documents(spark, texts, ids=None):
    """Rows with the clashing columns an operator must not trip over."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, None, None, "x", 1) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS + ", block string, score int")


AWKWARD = [None, "", " \n\t ", "a", "x" * 700, "word " * 300, "line\nline\n\n  two", "日本語 テキスト 😀", "don't  stop\u0085now", "a", "<|endoftext|> <s> ▁"]


def test_all_operators_take_empty_tables(spark):
    docs = documents(spark, ["a"]).limit(0)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert sharding.assign_shards(docs.select("doc_id"), "doc_id", 4).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).count() == 0
    assert token_counts.count_tokens(docs, vocabularies.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack(docs, vocabularies.path("byte_bpe_50k.json")).count() == 0
    assert language.identify(docs, language.fit(docs, F.lit(True))).count() == 0
    assert licences.scan(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0
    assert substring_dedup.dedup(docs).count() == 0
    assert ann.search(vectors, F.col("vec_id") % 20 == 0).count() == 0
    assert vector_dedup.near_duplicates(vectors).count() == 0


# ---------------------------------------------------------------- 1 substring dedup


def brute_windows(rows, size=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = defaultdict(lambda: None)
    for i, w in words:
        for at in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[at : at + size])
            least[key] = i if least[key] is None else min(least[key], i)
    out = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - size + 1) if i is not None else ():
            if least[tuple(w[at : at + size])] < i:
                gone |= set(range(at, at + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def test_substring_dedup_against_brute_force(spark):
    rnd = random.Random(5)
    passage = [f"p{k}" for k in range(70)]
    texts, ids = list(AWKWARD), list(range(len(AWKWARD)))
    for n in range(160):
        alphabet = ["a", "b"] if n % 3 == 0 else [f"w{k}" for k in range(40 if n % 3 == 1 else 4)]
        words = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 90))]
        if n % 4 == 0:
            at, cut = rnd.randint(0, len(words)), rnd.randint(0, 50)
            words[at:at] = passage[cut : cut + rnd.randint(5, 60)]
        if n % 7 == 0:
            words += ["same"] * rnd.randint(10, 40)
        texts.append(rnd.choice([" ", "\n", "\t "]).join(words))
        ids.append(n + 100)
    texts += [texts[20], texts[30], texts[40], texts[40]]
    ids += [900, ids[30], None, None]
    got = substring_dedup.dedup(documents(spark, texts, ids), block_bytes=5000, bucket_bytes=3000)
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=str)
    assert rows == brute_windows(list(zip(ids, texts)))


def thue_morse(n, zero, one):
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


def test_words_and_stretches_in_thue_morse_order_are_told_apart(spark):
    word, other = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    unique = [f"u{i}" for i in range(9 * 1024)]
    texts = [" ".join([*unique[:6], word, *unique[6:12]]), " ".join([*unique[:6], other, *unique[6:12]])]
    for marks in (("yes", "no"), ("no", "yes")):
        order = thue_morse(1024, *marks)
        texts.append(" ".join(w for i in range(1024) for w in [*(f"v{9 * i + k}" for k in range(9)), order[i]]))
    texts += [" ".join(thue_morse(1024, "x", "y")), " ".join(thue_morse(1024, "y", "x"))]
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(documents(spark, texts)).collect()]
    assert sorted(rows, key=str) == brute_windows(list(enumerate(texts)))
    assert {i: n for i, _, n, _ in rows if i < 4} == dict.fromkeys(range(4), 0)


def test_arithmetic_of_stretch_names():
    rnd = random.Random(7)
    p = words_of.PRIME
    a, b = ([rnd.choice([0, 1, p - 1, p - 2, rnd.randrange(p)]) for _ in range(3000)] for _ in range(2))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert words_of.times(x, y).tolist() == [i * j % p for i, j in zip(a, b)]
    sums = [0]
    for i in a:
        sums.append((sums[-1] + i) % p)
    assert words_of.running_sums(x).tolist() == sums
    assert words_of.powers(12345678901234567, 70).tolist() == [pow(12345678901234567, i, p) for i in range(70)]
    full = np.array([0, p, p + 1, 2**64 - 1, 2**63], np.uint64)
    assert words_of.reduced(full).tolist() == [int(v) % p for v in full]


def test_words_have_one_name_each():
    rnd = random.Random(12)
    bytes_of = lambda n: bytes(rnd.choice(b"ab\x00\xc3z") for _ in range(n))
    found = list({bytes_of(rnd.randint(1, 20)) for _ in range(6000)} | {b"a" * n for n in range(1, 40)} | {b"a" + b"\x00" * n for n in range(18)})
    data = np.frombuffer(b" ".join(found), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    words = words_of.Words(data, ends - [len(w) for w in found], ends, np.array([0, len(found)]))
    high, low = words_of.names128(words)
    assert len(set(zip(high.tolist(), low.tolist()))) == len(found) == len(set(high.tolist())) == len(set(low.tolist()))
    # the same words elsewhere, without anything behind them
    for i in rnd.sample(range(len(found)), 200):
        own = words_of.Words(np.frombuffer(found[i], np.uint8), np.array([0]), np.array([len(found[i])]), np.array([0, 1]))
        assert [int(x[0]) for x in words_of.names128(own)] == [int(high[i]), int(low[i])]
        if len(found[i]) > 16:
            assert int(high[i]) << 64 | int(low[i]) == xxhash.xxh3_128_intdigest(found[i])
    none = words_of.split(pa.array(["", None]))
    assert [len(x) for x in words_of.names128(none)] == [0, 0]


def test_rows_of_one_id_are_one_document_in_many_blocks(spark):
    texts = [" ".join(f"x{(17 * n + k) % 90}" for k in range(40)) for n in range(120)]
    ids = [5] * 100 + list(range(20))
    got = substring_dedup.dedup(documents(spark, texts, ids), block_bytes=400, bucket_bytes=400).collect()
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str)
    assert rows == brute_windows(list(zip(ids, texts)))


def test_recompression_names_equal_substrings_alike():
    rnd = random.Random(2)
    shared = [f"s{k}" for k in range(60)]
    texts = [" ".join([f"u{rnd.random()}" for _ in range(30)] + shared + [f"v{rnd.random()}" for _ in range(30)]) for _ in range(2)]
    table = pa.table({"doc_id": pa.array([1, 2]), "__text_hash": pa.array([0, 1]), "__text": pa.array(texts), "block": pa.array([0, 0])})
    block = substring_dedup.Block(table, 13)
    kept, _, _, _ = block.analyse()
    for s in kept:
        spans = [{(a - f - 30, b - f - 30, n) for a, b, lo, hi, n, d in zip(*map(np.ndarray.tolist, (s.start, s.end, s.low, s.high, s.name, s.doc))) if d == k and lo - f >= 30 and hi - f <= 90} for k, f in ((0, 0), (1, 120))]
        assert spans[0] and spans[0] == spans[1]


# ---------------------------------------------------------------- 2 sharding


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20_000)
    before = sharding.jump_hash(keys, 1)
    assert not before.any()
    for shards in range(2, 60):
        after = sharding.jump_hash(keys, shards)
        moved = after != before
        assert (after[moved] == shards - 1).all()
        assert abs(moved.mean() - 1 / shards) < 0.02
        before = after


def test_slots_are_gapless(spark):
    ids = [None, None, 5, 5, *range(10, 400)]
    rows = spark.createDataFrame([(i, "s") for i in ids], "doc_id long, slot string")
    got = sharding.assign_shards(rows, "doc_id", 7).toPandas()
    assert len(got) == len(ids)
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


# ---------------------------------------------------------------- 3 nearest neighbours


def test_multi_index_recall_and_scores(spark):
    points = np.random.default_rng(1).standard_normal((3000, 24)).astype(np.float32)
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    rows += [(20, None, 1), (40, [0.0] * 24, 1), (60, [float("nan")] * 24, 1), (80, [None] * 24, 1), (100, [1.0] * 5, 1), (None, points[0].tolist(), 1)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), F.col("vec_id") % 20 == 0).toPandas()
    exact = points.astype(float)
    hits = 0
    for query, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        score = exact @ exact[query]
        score[query] = -np.inf
        assert own["rank"].tolist() == list(range(1, 21)) and query not in set(own.vec_id)
        assert np.allclose(own.score, score[own.vec_id], rtol=1e-12)
        assert (np.diff(own.score) <= 0).all()
        hits += len(set(own.vec_id) & set(np.argsort(-score, kind="stable")[:20]))
    assert got.query_id.nunique() == 150 and hits / (20 * 150) >= 0.9


def test_multi_index_with_few_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, visit_share=1.0)
    assert [(r["rank"], r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.5)]


# ---------------------------------------------------------------- 4 language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    got = language.identify(docs.where(held), language.fit(docs, ~held)).toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_a_language_of_long_texts_only_is_learned(spark):
    english = [f"the quick brown fox number {i} jumps over that lazy dog and would have been there" for i in range(50)]
    dutch = [f"de snelle bruine vos {i} springt over die luie hond en zou daar zijn geweest " * 400 for i in range(50)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "en") for t in english), *((t, "nl") for t in dutch)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = language.fit(docs, F.lit(True))
    assert {x for x, _ in fitted} == {"en", "nl"}
    assert all(r.lang == r.lang_pred for r in language.identify(docs, fitted).collect())


def test_fitting_holds_no_more_than_its_sample(spark):
    # one id ten thousand times, one text ten thousand times
    rows = [(7, f"words of text {i}", "en") for i in range(10_000)] + [(i, "the same words again", "en") for i in range(10_000)]
    rows += [(7, f"woorden van tekst {i}", "nl") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = dict(language.fit(docs, F.lit(True), sample_docs=20))
    assert list(fitted) == ["en", "nl"]
    assert len(fitted["en"].split(b"words")) <= 21 and len(fitted["nl"].split(b"woorden")) == 21
    assert fitted == dict(language.fit(docs.repartition(7), F.lit(True), sample_docs=20))


def test_language_awkward_texts(spark):
    found = language.identify(documents(spark, [*AWKWARD, "123 !!"]), [("xx", b"a word line"), ("yy", b"other things")])
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "lang_pred", "score"]
    rows = {r.doc_id: r for r in found.collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, len(AWKWARD)))
    assert rows[3].lang_pred == rows[9].lang_pred != "und"
    assert language.accepted(found).count() <= len(AWKWARD) - 3
    assert language.classify("abc", (("xx", b"abc"),)) == ("xx", 1.0) and language.classify("abc", ()) == ("und", 0.0)


# ---------------------------------------------------------------- 5 SimHash


def brute_simhash(text, shingle=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, near):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near(i, j) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_against_brute_force(spark):
    rnd = random.Random(4)
    texts = list(AWKWARD)
    for n in range(60):
        words = [f"W{rnd.randint(0, 500)}é" for _ in range(rnd.randint(1, 120))]
        texts.append(" ".join(words))
        if n % 2:
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = "changed"
            texts.append("\n".join(words).lower())
    prints = [brute_simhash(t) for t in texts]
    label = brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i].fingerprint & (1 << 64) - 1 for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == label
    # a row without id takes part; repeated rows are repeated
    again = simhash.near_duplicates(documents(spark, ["one", "one", "two"], [None, 7, 7])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in again) == [("7", 7), ("7", 7), ("None", 7)]


@pytest.mark.parametrize("limit", [0, 2, 9])
def test_gray_index_finds_all_pairs(limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for _ in range(3)])
    values = np.unique(np.concatenate([base, near, near ^ np.uint64(1 << 9)]))
    entries = values[np.argsort(simhash.gray_rank(values))]
    q, e, d = simhash.block_links(entries, values, limit, leaf=8, fan_out=4)
    distance = np.bitwise_count(values[:, None] ^ entries[None, :])
    expected = np.argwhere(distance <= limit)
    assert sorted(zip(q.tolist(), e.tolist())) == sorted(map(tuple, expected.tolist()))
    assert (d == distance[q, e]).all()
    tree = simhash.levels(entries, entries, 4)
    q, node = simhash.walk(values, tree, 4, limit)
    assert sorted(zip(q.tolist(), node.tolist())) == sorted(map(tuple, expected.tolist()))


def test_gray_key_orders_like_the_code(spark):
    values = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 200)
    rows = spark.createDataFrame([(int(v),) for v in values], "v long").withColumn("k", simhash.gray_key(F.col("v"))).orderBy("k").collect()
    order = np.argsort(simhash.gray_rank(values.view(np.uint64)))
    assert [r.v for r in rows] == values[order].tolist()


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(6)
    texts, ids = [], []
    for n in range(40):
        words = [f"w{rnd.randint(0, 4000)}" for _ in range(220)]
        edited = list(words)
        edited[rnd.randrange(220)] = "edit"
        texts += [" ".join(words), " ".join(words).upper(), " ".join(edited), " ".join(words)]
        ids += [None if n % 5 == 0 else rnd.randint(0, 30) for _ in range(3)] + [None]
    texts += [None, "", " ", "x y", "x y", "x y"]
    ids += [501, 500, None, 502, 502, None]
    prints = [brute_simhash(t) for t in texts]
    label = brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    order = [(i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, texts)]
    expected = [min((order[i], ids[i], texts[i]) for i in range(len(texts)) if label[i] == own)[1:] for own in set(label)]
    docs = documents(spark, texts, ids).withColumn("__id", F.lit("mine")).withColumn("fingerprint", F.create_map(F.lit(1), "doc_id"))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(expected, key=str)
    assert all(r["__id"] == "mine" and r.fingerprint == {1: r.doc_id} for r in rows)
    assert len({label[texts.index(r.text)] for r in rows}) == len(rows) == len(set(label)) < len(texts)


# ---------------------------------------------------------------- 6 packing


def test_text_encoder_gives_the_ids_of_the_library():
    encoder, rnd = packing.TextEncoder(vocabularies.path("byte_bpe_50k.json"), max_known=20), random.Random(3)
    letters = [*"abcXYZ019'.,-sdt \n\t\r\x0b\x1c\x85\xa0", *map(chr, range(0xC0, 0x250)), *"日本語テキスト😀🏽ﬁعربيक्षिǅɐʼ\u3000\u200b\u2028"]
    texts = ["".join(rnd.choice(letters if rnd.random() < 0.5 else "ab c\n") for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    texts += [*filter(None, AWKWARD), "ends <|endoftext|> here", "日本語 words between 日本語 and\nlines ẞ", " ", "\n\n", "a  b", "日 本", " 日"]
    for text in texts:
        assert encoder.encode(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text


def test_best_fit_takes_the_tightest_window():
    lengths = np.random.default_rng(2).integers(1, 65, 500)
    number, offset = packing.best_fit_decreasing(lengths, 64)
    left, expected = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in left if c[0] >= lengths[i]]
        if fits:
            best = min(fits, key=lambda c: c[0])
            expected[i] = 64 - best[0]
            best[0] -= lengths[i]
        else:
            left.append([64 - lengths[i]])
            expected[i] = 0
    assert number.max() + 1 == len(left) and [expected[i] for i in range(500)] == offset.tolist()


def test_packing_places_every_token_once(spark):
    texts = [*AWKWARD, "long text " * 900, "x y z " * 341]
    got = packing.pack(documents(spark, texts), vocabularies.path("byte_bpe_50k.json"), window=256).toPandas()
    library = packing.encoder(vocabularies.path("byte_bpe_50k.json")).library
    for doc, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        assert b"".join(own.ids) == np.array(ids, "<u4").tobytes() and (own.doc_tokens == len(ids)).all()
        assert (own.length.iloc[:-1] == 256).all()
    assert got.doc_id.nunique() == len(texts)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 256 and (own.offset == own.length.cumsum() - own.length).all()


def test_packing_deals_pieces_not_documents(spark):
    # one document of many pieces and an id that repeats: several groups of even size
    rows = [(1, i * 8, 8, 100_000) for i in range(20_000)] + [(2, 0, 3, 3)] * 5_000 + [(None, 0, 1, 1)] * 100
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, doc_tokens long").repartition(4)
    got = packing.place(pieces, window=16, group_rows=4096).withColumn("group_no", F.expr("sequence_id >> 32"))
    sizes = [r["count"] for r in got.groupBy("group_no").count().collect()]
    assert len(sizes) == 7 and sum(sizes) == 25_100 and max(sizes) < 4300
    table = got.toPandas()
    assert table.groupby("sequence_id").length.sum().max() <= 16
    for _, own in table.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all()


def test_a_very_long_document_has_all_its_windows(spark):
    text = "".join(f"w{i} " for i in range(700_000))  # some three million tokens
    found = packing.token_pieces(documents(spark, [text, "b"]), vocabularies.path("byte_bpe_50k.json"))
    got = found.select("doc_id", "start", "length", "doc_tokens", (F.octet_length("ids") / 4).cast("long").alias("n")).toPandas()
    own = got[got.doc_id == 0].sort_values("start")
    assert len(own) > 700 and (own.start == 2048 * np.arange(len(own))).all() and (own.n == own.length).all()
    assert own.length.sum() == own.doc_tokens.iloc[0] and (own.length.iloc[:-1] == 2048).all()


# ---------------------------------------------------------------- 7 vectors


def test_vector_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 16))
    group = base[0] + 0.05 * rng.standard_normal((700, 16))  # larger than a window and a block
    pairs = base[1:60] + 0.1 * rng.standard_normal((59, 16))
    points = np.concatenate([base, group, pairs, 3 * base[70:75], base[80:90]]).astype(np.float32)
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("inf")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [1.0], 0), (None, points[0].tolist(), 0)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int"), block_rows=128).collect()
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], n).min(1))
        if (least == label).all():
            break
        label = least
    by_id = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    assert [by_id[i].n_links for i in range(n)] == near.sum(1).tolist()
    assert [by_id[i].component_id for i in range(n)] == label.tolist()
    assert all(by_id[i].kept == (label[i] == i) for i in range(n))
    assert all((by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True) for i in range(n, n + 5))
    assert by_id[None].n_links == 0


def test_vectors_of_a_rarer_dimension_take_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(30)] + [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [-2.0, 1.0]), (103, [2.0]), (104, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(vectors).collect()}
    assert len(got) == len(rows) and got[100] == (1, 100, True) and got[101] == (1, 100, False)
    assert got[102] == (0, 102, True) and got[103] == (0, 103, True) and got[104] == (0, 104, True)
    found = [(r.query_id, r.rank, r.vec_id) for r in ann.search(vectors, F.col("vec_id").isin(0, 101, 103)).collect()]
    assert [(r, v) for q, r, v in sorted(found) if q == 101] == [(1, 100), (2, 102)]
    assert not [v for q, _, v in found if q == 103] and {v for q, _, v in found if q == 0} < set(range(30))


@pytest.mark.parametrize("window", [512, 16])
def test_vector_pairs_inside_a_dense_group(spark, window):
    """Vectors at a pairwise cosine of 0.8 with planted pairs at 0.91 among them."""
    rng, n = np.random.default_rng(4), 6000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    off = lambda x, *axes: unit(x - sum((x * a).sum(-1, keepdims=True) * a for a in axes))
    own = off(rng.standard_normal((n, 64)), centre)
    moved = 0.56 * own[:300] + np.sqrt(1 - 0.56**2) * off(rng.standard_normal((300, 64)), centre, own[:300])
    group, partner = (np.sqrt(0.8) * centre + np.sqrt(0.2) * x for x in (own, unit(moved)))
    points = np.concatenate([group, partner])
    near = points @ points.T >= 0.9
    np.fill_diagonal(near, False)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), run_rows=64, window=window).collect()}
    assert near.sum() >= 600 and sum(r.n_links for r in got.values()) == near.sum()


def test_sorted_windows_and_the_runs_they_leave():
    rng = np.random.default_rng(6)
    run = np.sort(rng.integers(0, 12, 400))
    run[100:180] = run[100]
    run.sort()
    number, ids, window = np.zeros(400, int), rng.permutation(400), 20
    for step in (400, 37, 1):
        runs, lines = vector_dedup.LongRuns(window), []
        for at in range(0, 400, step):
            lines += runs.take(number[at : at + step], run[at : at + step], ids[at : at + step])
        lines += runs.finish()
        got = sorted((r, i) for (_, r), own in lines for i in own.tolist())
        whole = {r for r in set(run.tolist()) if (run == r).sum() > window + 1} | {run[0], run[-1]}
        assert got == sorted((r, i) for r, i in zip(run.tolist(), ids.tolist()) if r in whole)
    points = rng.standard_normal((40, 3))
    i, j = vector_dedup.window_links(np.arange(40), points, 20, 0.8)
    linked = {(a, b) for a in range(20) for b in range(a + 1, min(40, a + 21)) if vectors_of.near(points[[a]], points[[b]], 0.8)[0, 0]}
    expected, got = [brute_components(40, lambda a, b: (a, b) in edges or (b, a) in edges) for edges in (linked, set(zip(i.tolist(), j.tolist())))]
    assert got == expected and len(i) == 40 - len(set(expected))
    i, j = vector_dedup.window_links(np.full(40, 7), points, 20, -1.0)
    assert len(i) == 0


def test_cosines_at_the_threshold_do_not_depend_on_the_block():
    rng = np.random.default_rng(7)
    points = rng.integers(-3, 4, (300, 16)).astype(float)
    points = points[(points != 0).any(1)]
    exact = [[int(a @ b) for b in points] for a in points]
    # cosine >= 0.5 in whole numbers: dot > 0 and 4 dot^2 >= |a|^2 |b|^2
    expected = np.array([[d > 0 and 4 * d * d > exact[i][i] * exact[j][j] for j, d in enumerate(own)] for i, own in enumerate(exact)])
    border = np.array([[d > 0 and 4 * d * d == exact[i][i] * exact[j][j] for j, d in enumerate(own)] for i, own in enumerate(exact)])
    whole = vectors_of.near(points, points, 0.5)
    assert (whole == expected)[~border].all() and border.any()
    for at in range(0, len(points), 7):
        assert (vectors_of.near(points[at : at + 7], points, 0.5) == whole[at : at + 7]).all()
    big = vectors_of.points_of(pa.array([np.array([1e300, -1e300]).tobytes(), np.array([1e-300, -1e-300]).tobytes()]), 2, np.float64)
    assert vectors_of.near(big, big, 0.999).all()


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (None, 3), (7, 6)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {i: 0 for i in range(301)} | {k: 1000 for k in range(1000, 1400)}


# ---------------------------------------------------------------- 8 token counts


def test_transducer_and_its_maps_equal_the_library():
    import functools

    import sentencepiece

    model = vocabularies.path("piece_bpe_32k.model")
    machine, library, rnd = token_counts.Transducer(model, max_states=3000), sentencepiece.SentencePieceProcessor(model_file=model), random.Random(3)
    pieces = ["a", "b", "the", " ", "  ", "\n", "é", "ing", "日", "😀", "▁", "1", "<s>", "<0x41>", "\u0001", " of", "\t", "ﬁ", " "]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30)))
        expected = len(library.encode(text))
        assert machine.count(text) == expected, text
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 5)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        maps = [token_counts.chunk_map((" " if n == 0 else "") + p, machine) for n, p in enumerate(parts)]
        for fold in (
            functools.reduce(lambda a, b: token_counts.compose(a, b, machine), maps),
            functools.reduce(lambda a, b: token_counts.compose(b, a, machine), maps[::-1]),
        ):
            assert not text or machine.run(fold.head) + fold.inner + machine.run(fold.tail) == expected, parts


def test_token_counts_of_chunked_texts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))
    texts = [*AWKWARD, "some words here\n" * 50]
    rows = documents(spark, [*texts, texts[4], texts[4]], [*range(len(texts)), 4, None])
    got = token_counts.count_tokens(rows, vocabularies.path("piece_bpe_32k.model"), chunk_chars=50).collect()
    expected = [(str(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t in [*enumerate(texts), (4, texts[4]), (None, texts[4])]]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(expected)


# ---------------------------------------------------------------- 9 licences


def test_licence_scan(spark):
    line = "Released under the MIT License."
    grant = licences.NOTICES[7][1]
    edited = grant.replace("free of charge", "without any charge").replace("\"Software\"", "Software")
    texts = [None, "", "é " * 5 + line + " more", line + "\nfiller words between the two lines here\n" + line.upper(), edited, "released under the sun", "x " * 5000 + line, grant[:60]]
    rows = documents(spark, [*texts, line], [*range(len(texts)), None])
    got = [r for r in licences.scan(rows).collect()]
    assert sorted((str(r.doc_id), r.licence) for r in got) == sorted([("2", "MIT"), ("3", "MIT"), ("3", "MIT"), ("4", "MIT"), ("6", "MIT"), ("None", "MIT")])
    for r in got:
        text = (texts[r.doc_id] if r.doc_id is not None else line).encode()[r.start_byte : r.end_byte].decode()
        if r.doc_id != 4:
            assert text.lower() == line.lower().rstrip(".") and r.coverage == 1.0
        else:
            assert text.startswith("Permission is") and 0.8 <= r.coverage < 1


def test_licence_lines_in_a_row(spark):
    lines = [licences.NOTICES[i][1] for i in (6, 2, 0)]
    edited = licences.NOTICES[7][1].replace("free of charge", "without any charge")
    texts = [" ".join([line] * n) for line in lines for n in (1, 2, 3, 40)] + [f"{edited}\n{licences.NOTICES[7][1]}\n{edited}"]
    got = licences.scan(documents(spark, texts)).orderBy("doc_id", "start_word").collect()
    counts = defaultdict(int)
    for r in got:
        counts[r.doc_id] += 1
    assert [counts[i] for i in range(len(texts))] == [1, 2, 3, 40] * 3 + [3]
    assert all(a.doc_id != b.doc_id or a.end_word <= b.start_word for a, b in zip(got, got[1:]))


def licences_in(spark, texts):
    out = defaultdict(list)
    for r in licences.scan(documents(spark, texts)).orderBy("doc_id", "start_word").collect():
        out[r.doc_id].append(r.licence)
    return [out[i] for i in range(len(texts))]


def test_licence_families_and_versions(spark):
    by_name = defaultdict(list)
    for name, text in licences.NOTICES:
        by_name[name].append(text)
    bsd2, bsd3, mit = by_name["BSD-2-Clause"][0], by_name["BSD-3-Clause"][0], max(by_name["MIT"], key=len)
    cases = {
        "// SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: MPL-2.0": ["MPL-2.0"], "SPDX-License-Identifier: LGPL-2.1-or-later": ["LGPL-2.1-or-later"],
        "SPDX-License-Identifier: EUPL-1.2": [], "SPDX-License-Identifier: AGPL-1.0-only": [], "Text under CC BY-SA 4.0, see below": ["CC-BY-SA-4.0"],
        "licensed under CC BY-XX 4.0": [], "Released under the XYZ License.": [], by_name["LGPL-2.1"][0]: ["LGPL-2.1"], by_name["GPL-2.0"][1]: ["GPL-2.0"],
        by_name["GPL-2.0"][0]: ["GPL-2.0"], by_name["AGPL-3.0"][1]: ["AGPL-3.0"], by_name["MPL-2.0"][0]: ["MPL-2.0"], bsd2: ["BSD-2-Clause"], bsd3: ["BSD-3-Clause"],
        "Copyright 2020 Nobody\n\n" + mit: ["MIT"], by_name["ISC"][0]: ["ISC"], by_name["Unlicense"][0]: ["Unlicense"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 International License.": ["CC-BY-NC-SA-3.0"],
        f"{mit}\n---\n{bsd3}\n---\nReleased under the MIT License.": ["MIT", "BSD-3-Clause", "MIT"], bsd3.replace("copyright holder nor", "University of Nowhere nor"): ["BSD-3-Clause"],
    }
    assert licences_in(spark, list(cases)) == list(cases.values())


def test_every_template_is_found_as_itself(spark):
    notices = licences.all_notices()
    got = licences_in(spark, [f"before these words {text} come others" for _, text in notices])
    assert got == [[name] for name, _ in notices]


def test_many_licence_lines_take_linear_time():
    index, times_taken = licences.Index(licences.all_notices(), 3, 4), []
    for n in (2000, 8000):
        text = pa.array(["\n".join(["Released under the MIT License."] * n)])
        words, name = licences.words_of(text)
        value, place = licences.winnow(name, np.zeros(len(name), np.int64), 3, 4)
        hit = np.isin(value, index.known)
        start = time.process_time()
        found = licences.matches(index, name, list(zip(value[hit].tolist(), place[hit].tolist())), 8, 0.8)
        times_taken.append(time.process_time() - start)
        assert len(found) == n
    assert times_taken[1] < 8 * times_taken[0] + 0.2


def brute_alignment(template, text):
    """Best local alignment over the whole table: matches score 1, mismatches and gaps cost 1; (score, matches)."""
    row, best = [(0, 0)] * (len(text) + 1), (0, 0)
    for a in template:
        new = [(0, 0)]
        for j, b in enumerate(text):
            s, m = row[j]
            cells = [(s + 1, m + 1) if a == b else (s - 1, m), (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1]), (0, 0)]
            new.append(max(cells) if max(cells)[0] > 0 else (0, 0))
        best, row = max([best, *new]), new
    return best


def test_banded_alignment_against_the_whole_table():
    rnd = random.Random(21)
    for _ in range(150):
        template = [rnd.randint(0, 30) for _ in range(rnd.randint(13, 40))]
        copy = list(template)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.randint(0, 1)] = [rnd.randint(100, 120)] * rnd.randint(0, 2)
        lead = [rnd.randint(200, 300) for _ in range(rnd.randint(0, 20))]
        text = [*lead, *copy, *(rnd.randint(200, 300) for _ in range(10))]
        m = licences.align(np.array(template, np.uint64), np.array(text, np.uint64), len(lead), 8)
        assert m.matched == brute_alignment(template, text)[1] or m.matched >= 0.9 * brute_alignment(template, text)[1]
        assert m.matched <= len(set(range(m.start, m.end)))


# ---------------------------------------------------------------- 10 byte-level BPE


def test_chunked_encoding_is_that_of_the_library(spark):
    rnd = random.Random(1)
    texts = [*AWKWARD, "".join(rnd.choice("ab \n'1.,é ") for _ in range(1500)), "y" * 90 + " " * 90 + "z"]
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[5])]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN, chunk_chars=64, overlap=16), RANKS, PATTERN).collect()
    library = byte_bpe.encoding(RANKS, PATTERN)
    expected = [(str(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows]
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == sorted(expected)
