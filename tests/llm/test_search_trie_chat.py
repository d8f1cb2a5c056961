"""Lexical search, the prefix trie and chat formatting beside brute force on small, awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import chat_format, lexical_search, prefix_trie

DOCS = "doc_id long, text string, score string, term int, n string, pass_no int"
TURNS = "conv_id long, turn long, role string, text string, depth int, name string, pos string, t int, letter string"


@pytest.fixture(scope="module", autouse=True)
def scratch(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], DOCS).repartition(3)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "item_id long, text string, rank int")


# ---------------------------------------------------------------- 11 ranked lexical search


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, asked, k=10):
    held = [(i, c, sum(c.values())) for i, c in ((i, Counter(terms(t))) for i, t in docs) if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in set(asked):
        scores = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = 0
            for w, r in Counter(terms(text)).items():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += r * weight * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_search_against_brute_force(spark):
    rnd = random.Random(4)
    words = [f"W{i}" if i % 3 else f"é{i}ß" for i in range(60)]
    draw = lambda n: " ".join(rnd.choice(words[: rnd.choice([4, 20, 60])]) for _ in range(n))
    rows = [(i, draw(rnd.randint(0, 40))) for i in range(300)]
    rows += [(None, "w1 w2 W4"), (None, None), (7, "w1 w1,w1;é3ß"), (7, "w1 w1,w1;é3ß"), (400, ""), (401, "...\x7f"), (402, "w5 " * 4000)]
    rows += [(500 + i, "same words in every copy") for i in range(40)]  # more ties than are asked for
    asked = [(i, draw(12)) for i in range(30)]
    asked += [(90, None), (91, ""), (92, "absent words only zzz"), (93, "w1"), (93, "w1"), (93, "w2 w2 w2"), (None, "w5"), (94, "same copy"), (95, "É3SS W1")]
    got = lexical_search.search(documents(spark, rows), items(spark, asked))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, [a for a in asked if a[1] is not None])


def test_search_in_small_slices_blocks_and_passes(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{int(rnd.expovariate(0.1))}" for _ in range(rnd.randint(1, 60)))) for i in range(200)]
    asked = [(i, " ".join(f"w{int(rnd.expovariate(0.05))}" for _ in range(9))) for i in range(25)]
    monkeypatch.setattr(lexical_search, "MAX_QUERY_BYTES", 800)
    got = lexical_search.search(documents(spark, rows), items(spark, asked), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, asked, 3)


def test_search_takes_empty_tables(spark):
    some, none = documents(spark, [(1, "a b")]), documents(spark, [(1, "a b")]).limit(0)
    assert lexical_search.search(none, items(spark, [(1, "a")])).count() == 0
    assert lexical_search.search(some, items(spark, [(1, "a")]).limit(0)).count() == 0
    assert lexical_search.search(documents(spark, [(1, None), (2, " ")]), items(spark, [(1, "a")])).count() == 0


def test_terms_do_not_depend_on_the_slices(monkeypatch):
    texts = ["", "a", "Wort für Wort, " * 9, None, "x" * 50, "Ünïcode-Text　日本 語", " ", "end"]
    monkeypatch.setattr(lexical_search, "_SLICE", 16)
    for column in (pa.array(texts), pa.array(["drop", *texts])[1:]):
        found = [[] for _ in texts]
        for rows, words in lexical_search.terms_of(column):
            for row, word in zip(rows.tolist(), words.to_pylist()):
                found[row].append(word.decode())
        assert found == [terms(t) for t in texts]


def test_limited_accumulators_lose_nothing_and_leave_work_out():
    rnd = np.random.default_rng(6)
    n = rnd.integers(5, 50, 4000)
    # one rare term, one that every document holds
    has = [np.sort(rnd.choice(30, 2 if i % 200 == 0 else 1, replace=False)) if i % 200 == 0 else np.array([29]) for i in range(4000)]
    ends = np.cumsum([0, *map(len, has)])
    found = np.concatenate(has)
    block = lexical_search.Block(np.arange(4000), n, ends, found, np.ones(len(found), np.int64), 4000, int(n.sum()))
    plan = [(t, 5000) for t in range(29)] + [(29, 10)]
    kept, scores = block.rank(plan, 10, 0)
    assert not block.score.any()
    full = np.zeros(4000, np.int64)
    for t, g in plan:
        if t in block.place:
            p = block.place[t]
            own = slice(block.first[p], block.stop[p])
            full[block.doc[own]] += g * block.worth[own]
    best = np.sort(full)[-10:]
    assert (np.sort(scores)[-10:] == best).all() and (full[kept] == scores).all()
    # with a bar above what the common term can reach alone, its documents get no accumulator
    kept, _ = block.rank(plan[-1:], 10, int(best[0]))
    assert len(kept) == 0


# ---------------------------------------------------------------- 12 prefix trie


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        digest = hashlib.sha256(f"{len(r.encode())}:{r}{len(x.encode())}:{x}".encode()).digest()
        if c is not None:
            conv[c].append(((t is not None, t or 0), digest, r, x))
    conv = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}
    rebuilt = {}
    for c, v in conv.items():
        h, source = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        rebuilt[c] = tuple(conv.get(source, [])[:h] + v[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = sorted(c for c in members[p] if len(rebuilt[c]) == len(p))
        told = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(kids[p]), leaves[p], saved[p], len(ends), told))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], TURNS).repartition(4)


def test_trie_against_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for c in [*range(-12, 40), 5001, 5003]:  # 5000 is absent
        turns = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None])) for t in range(rnd.randint(1, 12))]
        rows += turns
    rows += [(60, t, "user", f"t{t % 2}") for t in range(150)] + [(62, t, "user", f"t{t % 2}") for t in range(149)]
    rows += [(70, None, "user", "late"), (70, 0, "user", "x"), (70, 0, "user", "x"), (70, 0, "user", "y"), (70, None, None, None)]
    rows += [(None, 0, "user", "nobody's"), (80, 3, "a", "bc"), (85, 3, "ab", "c")]
    got = prefix_trie.prefix_trie(conversations(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_one_turnless_conversation_and_of_none(spark):
    shy = next(c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    rows = [(shy, 0, "user", "forgotten")]  # its source is absent and its only turn is among the first eight
    got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(shy, 0, None, 1, 0, 1, 0, 1, hashlib.sha256(str(shy).encode()).hexdigest())]
    assert prefix_trie.prefix_trie(conversations(spark, rows).limit(0)).count() == 0


def test_a_node_where_very_many_conversations_end(spark):
    rows = [(5 * c, 0, "user", "hello") for c in range(3000)]  # each its own source, all the same
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = sorted(map(tuple, prefix_trie.prefix_trie(conversations(spark, rows)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_trie(rows) and len(got) == 2


def test_turns_are_numbered_across_range_partitions(spark):
    rows = [(1, t, "user", f"x{t}") for t in range(3000)] + [(1, 7, "user", "x7")] * 400 + [(2, 5, "user", "z")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        numbered = prefix_trie.numbered_turns(conversations(spark, rows))
        got = numbered.where("conv_id = 1").agg(F.count("pos"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
        assert tuple(got) == (3400, 3400, 0, 3399)
        seven = numbered.groupBy("conv_id", "digest").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
        assert [(r.lo, r.hi) for r in seven.where("n > 1").collect()] == [(7, 407)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


# ---------------------------------------------------------------- 13 chat formatting

ODD = [
    "", None, "plain", "</turn>", r"<\/turn>", r"<\\/turn> </turn></turn>", "### User: hi", r"#\## User: hi", "##### Assistant:x",
    "\n### System: no", "### =role%3A: x", "### Other: stays", "\\", "a\n\n### User:", "<", "#", "é 😀 ### User: 日本", "</tur", "n>", "\x00 $0 $1 \\1",
]


def unmasked(text, mask):
    at, out = 0, []
    for skip, length, loss in mask:
        out.append((text[at + skip : at + skip + length], loss))
        at += skip + length
    return out


def test_chat_texts_come_back(spark):
    rnd = random.Random(3)
    roles = ["user", "assistant", "system", "tool: x\n", "", None, "Assistant", "=", "###"]
    rows = [(c, t, rnd.choice(roles), rnd.choice(ODD)) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(100, None, "user", "first"), (100, 0, "assistant", "b"), (100, 0, "assistant", "a"), (100, 0, "assistant", "a"), (None, 0, "user", "x")]
    rows += [(101, t, "assistant", "long " * 2000) for t in range(40)]
    formatted = chat_format.format_conversations(conversations(spark, rows))
    texts = {r.conv_id: r for r in formatted.collect()}
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    expected = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            expected[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(back) == set(texts) == set(expected)
    for c, turns in expected.items():
        got = [(t.role, t.text) for t in back[c].turns]
        assert sorted(got) == sorted(t[2:] for t in turns)
        if c < 100:
            assert got == [t[2:] for t in sorted(turns, key=lambda t: t[:2])]
        learned = [x for r, x in got if r == "assistant"]
        assert back[c].learned == learned
        spans = unmasked(texts[c].formatted, texts[c].mask)
        assert [s for s, loss in spans if loss] == [s for (r, _), (s, _) in zip(got, spans) if r == "assistant"]
        assert texts[c].formatted.endswith(spans[-1][0] + chat_format.END)
    assert [(t.role, t.text) for t in back[100].turns] == [("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]


def test_chat_template(spark):
    rows = [(1, 0, "user", "one"), (1, 1, "user", "two"), (1, 2, "assistant", "### User: three</turn>"), (1, 3, "critic", "four")]
    got = chat_format.format_conversations(conversations(spark, rows)).first()
    assert got.formatted == "### User: one</turn>two</turn>\n### Assistant: #\\## User: three<\\/turn></turn>\n### =critic: four</turn>"
    assert [tuple(m) for m in got.mask] == [(10, 3, False), (7, 3, False), (23, 24, True), (21, 4, False)]


def test_chat_runs_no_python(spark):
    formatted = chat_format.format_conversations(conversations(spark, [(1, 0, "user", "x")]))
    plan = chat_format.read_back(formatted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert chat_format.format_conversations(conversations(spark, []).limit(0)).count() == 0
