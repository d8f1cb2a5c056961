"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    ann, byte_bpe, chat_format, language, lexical_search, licences, packing, prefix_trie, sharding, simhash,
    substring_dedup, token_counts, vector_dedup,
)
from .registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]


@query("op2_jump_shards")
def op2_jump_shards(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.assign_shards(rows, "doc_id", 40, ("text_crc32", "size"))


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf, "documents"), ranks, pattern)
    decoded = byte_bpe.decode(encoded, ranks, pattern)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_token_counts")
def op8_token_counts(spark, sf):
    docs = table(spark, sf, "documents")
    counts = token_counts.count_tokens(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf):
    docs = table(spark, sf, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.place(digests)


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query("op4_language_id")
def op4_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    dictionaries = language.fit(docs, ~_held_out())
    found = language.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


@query("op3_multi_index_search")
def op3_multi_index_search(spark, sf):
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_sorted_projections")
def op7_sorted_projections(spark, sf):
    return vector_dedup.near_duplicates(table(spark, sf, "embeddings"))


@query("op5_gray_simhash")
def op5_gray_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


_WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op1_recompression",
    f"""WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, {_WORDS_SQL} AS words FROM documents),
windows AS (
  SELECT nr, doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS content
  FROM (SELECT nr, doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM docs WHERE doc_id IS NOT NULL)),
repeats AS (SELECT nr, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY content) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT nr, unnest(range(pos, pos + 13)) AS pos FROM repeats),
placed AS (SELECT nr, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs),
kept AS (SELECT nr, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (nr, pos) GROUP BY nr)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (nr)""",
)
def op1_recompression(spark, sf):
    found = substring_dedup.dedup(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_license_scan")
def op9_license_scan(spark, sf):
    return licences.scan(table(spark, sf, "documents"))


_TERMS_SQL = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


@query(
    "op11_ranked_lexical",
    f"""WITH d AS (SELECT row_number() OVER () AS nr, doc_id, terms FROM (SELECT doc_id, {_TERMS_SQL} AS terms FROM documents) WHERE len(terms) > 0),
p AS (SELECT nr, term, count(*) AS tf FROM (SELECT nr, unnest(terms) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest(terms) AS term FROM (SELECT item_id, {_TERMS_SQL} AS terms FROM benchmark)) GROUP BY ALL),
m AS (SELECT nr, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, s),
scored AS (SELECT item_id, doc_id, nr, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (nr) GROUP BY ALL)
SELECT item_id, row_number() OVER o::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10""",
)
def op11_ranked_lexical(spark, sf):
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op12_prefix_trie",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': sha256(strlen(role) || ':' || role || strlen(text) || ':' || text), 'b': strlen(text)} ORDER BY turn NULLS FIRST) AS turns FROM t GROUP BY conv_id),
bits AS (SELECT range AS b, range AS c, 0 AS step FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT conv_id, conv_id::VARCHAR AS s, 0 AS i, 4294967295 AS c FROM own
  UNION ALL SELECT conv_id, s, i + 1, xor(crc.c // 256, bits.c) FROM crc JOIN bits ON step = 8 AND b = xor(crc.c, ascii(s[i + 1])::BIGINT) & 255 WHERE i < len(s)),
heads AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE i = len(s)),
rebuilt AS (SELECT conv_id, list_concat(coalesce(source.turns, [])[1:h], own.turns[h + 1:]) AS turns
  FROM own JOIN heads USING (conv_id) LEFT JOIN (SELECT conv_id AS source_id, turns FROM own) source ON source_id = conv_id - conv_id % 5),
p AS (SELECT conv_id, d, len(turns) = d AS ends, coalesce(turns[d].b, 0) AS b, array_to_string(list_transform(turns[1:d], lambda x: x.k), ',') AS prefix
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b,
  count(*) FILTER (ends) AS n_ends, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, prefix),
up AS (SELECT n.d, n.prefix, n.conv_id, m.prefix AS parent, m.conv_id AS parent_conv_id
  FROM nodes n JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1 JOIN nodes m ON m.d = q.d AND m.prefix = q.prefix),
kids AS (SELECT d - 1 AS d, parent AS prefix, count(*) AS n_children FROM up GROUP BY ALL),
own_totals AS (SELECT n.d, n.conv_id, (n_children IS NULL)::BIGINT AS leaf, (n_convs - 1) * b AS saved FROM nodes n LEFT JOIN kids USING (d, prefix)),
totals AS (SELECT p.d, p.prefix, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM own_totals o JOIN p ON p.conv_id = o.conv_id AND p.d <= o.d GROUP BY ALL)
SELECT n.conv_id, d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n_ends, ends_sha256
FROM nodes n JOIN totals USING (d, prefix) LEFT JOIN up USING (d, prefix) LEFT JOIN kids USING (d, prefix)""",
)
def op12_prefix_trie(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


_CHAT_PROBE = r"\### Assistant: </turn> ok"
_MARKS_SQL = r"""len(regexp_extract_all(text, '<\\*/turn>|#\\*## (System|User|Assistant|=[-.*_+%A-Za-z0-9]*):'))"""


@query(
    "op13_chat_format",
    f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-7, 0, 'user', '{_CHAT_PROBE}'), (-7, 1, 'assistant', '{_CHAT_PROBE}')),
l AS (SELECT *, coalesce(role <> lag(role) OVER o, true) AS head, lag(role) OVER o IS NOT NULL AS later FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + {_MARKS_SQL} + 7 + CASE WHEN head THEN 6 + later::INTEGER + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(url_encode(role)) END ELSE 0 END)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id""",
)
def op13_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", _CHAT_PROBE), (-7, 1, "assistant", _CHAT_PROBE)], turns.schema)
    formatted = chat_format.format_conversations(turns.unionByName(probe))
    sizes = F.char_length("formatted").cast("long").alias("formatted_chars")
    back = chat_format.read_back(formatted.withColumn("formatted_chars", sizes), carry=("formatted_chars",))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
