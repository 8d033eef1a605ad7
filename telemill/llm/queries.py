"""The registered queries of this package: every operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import (ann, chat, chunk_codec, conversation_trie, filter_audit, html_extract, minhash, packing, quality,
                          suffix_dedup, token_counts, token_files, toxicity)
from telemill.llm.runtime import table
from telemill.session import scratch_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_dedup.removal_digests(docs, suffix_dedup.repeated_ranges(docs, 50))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 80)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                     "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.chat_digests(chat.format_conversations(turns))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), 0)
    return token_files.read_token_files(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 1, 2048)


def op7_chunk_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.codec_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_chain(docs, table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("letter")


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(conversation_trie.rebuild(table(spark, sf_dir, "conversations"), 100, 6))


QUERIES = {name: query for name, query in globals().items() if name.startswith("op")}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
u AS (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS pos FROM d WHERE length(h) >= 100),
w AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 100)) AS k FROM u),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, pos, first FROM w JOIN f ON f.k = w.k),
c AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM g WHERE first < doc_id),
i AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM c),
s AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 50 AS b FROM i GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM s),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM s GROUP BY doc_id),
l AS (SELECT k.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept
      FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id""",
    "op2_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1),
    lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op3_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [words]
    ELSE list_transform(range(1, len(words) - 2), lambda i: words[i:i + 3]) END) AS shingle FROM w),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY shingles) AS class_id
  FROM (SELECT doc_id, list_sort(list(array_to_string(shingle, ' '))) AS shingles FROM s GROUP BY doc_id)),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY ALL),
link AS (SELECT a, b FROM b JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b
  WHERE 100 * n_both >= 80 * (ka.n + kb.n - n_both)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(component, doc_id)) AS component_id,
  doc_id <= coalesce(component, doc_id) AS kept, coalesce(class_id, doc_id) AS class_id
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN least ON least.a = doc_id""",
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS goes_on,
    length(regexp_replace(role, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
    length(regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  (sum(text_chars) + sum(CASE WHEN goes_on THEN 8 ELSE 24 + role_chars END))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id""",
    "op11_filter_audit": r"""
WITH RECURSIVE lab AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (SELECT w.doc_id, part, good, toxic, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
o AS (SELECT '' AS filter_order, 0 AS applied UNION ALL
  SELECT filter_order || letter, applied | bit FROM o JOIN (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)
    ON applied & bit = 0),
s AS (SELECT w.filter_order, length(p.filter_order) AS step, p.applied, p.applied - b.applied AS bit, b.applied AS before
  FROM o w JOIN o p ON starts_with(w.filter_order, p.filter_order)
  JOIN o b ON starts_with(p.filter_order, b.filter_order) AND length(b.filter_order) = length(p.filter_order) - 1
  WHERE length(w.filter_order) = 5),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n_good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM s CROSS JOIN c GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
    "op12_html_extract": r"""
WITH b AS (SELECT page_id, url, list_filter(list_transform(
    regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:h1|p)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
      '&quot;?', '"', 'g'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))),
    lambda x: x <> '') AS blocks FROM pages),
t AS (SELECT page_id, url, regexp_replace(array_to_string(blocks, chr(10) || chr(10)), '&amp($|\n)', '&\1', 'g') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t""",
    "op13_conversation_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS size, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.size, 0)) AS lead FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT t.conv_id, pos - h + lead AS depth, role, text FROM t JOIN k ON k.conv_id = t.conv_id WHERE pos > h
  UNION ALL SELECT k.conv_id, pos, role, text FROM t JOIN k ON k.base = t.conv_id WHERE pos <= lead),
p AS (SELECT conv_id, depth, length(text) AS chars, string_agg(sha256(role || chr(10) || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix
  FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
e AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id),
n AS (SELECT depth, prefix, min(p.conv_id) AS node, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (last = depth), '')) AS ends_sha256
  FROM p JOIN e ON e.conv_id = p.conv_id GROUP BY depth, prefix),
a AS (SELECT p.conv_id, p.depth, node FROM p JOIN n ON n.depth = p.depth AND n.prefix = p.prefix),
v AS (SELECT n.*, a.node AS above FROM n LEFT JOIN a ON a.conv_id = n.node AND a.depth = n.depth - 1),
f AS (SELECT v.*, count(w.node) AS n_children FROM v LEFT JOIN v w ON w.above = v.node AND w.depth = v.depth + 1 GROUP BY ALL),
s AS (SELECT a.node, a.depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM f JOIN a ON a.conv_id = f.node AND a.depth <= f.depth GROUP BY a.node, a.depth)
SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.above AS parent_conv_id, f.n_convs, f.n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM f JOIN s ON s.node = f.node AND s.depth = f.depth""",
}
