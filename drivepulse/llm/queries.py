"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from drivepulse.llm import (
    byte_bpe, chat_format, decontaminate, language_id, ngram_join, prefix_trie, secret_scan, source_mix, suffix_dedup, token_files, top_k, toxicity, whitening)
from drivepulse.llm.common import held_out, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_files")
def op1(spark, sf):
    return token_files.round_trip(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_byte_bpe")
def op9(spark, sf):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


@query("op5_secret_scan")
def op5(spark, sf):
    return secret_scan.report(table(spark, sf, "documents"))


# Words, windows and hits of op8 in SQL.
OP8_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8 = f"""WITH dw AS (SELECT doc_id, {OP8_WORDS} AS w FROM documents),
bw AS (SELECT row_number() OVER () AS b, item_id, {OP8_WORDS} AS w FROM benchmark),
win AS (SELECT b, i AS j, item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
        FROM bw, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
spots AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
          FROM dw, sizes, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
occ AS (SELECT doc_id, i, spots.k, item_id, b, j FROM spots JOIN win USING (s, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + k)) AS t(p) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM occ GROUP BY 1),
chained AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, b, i - j ORDER BY i) AS chain FROM occ),
matches AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + max(k) AS n FROM chained GROUP BY doc_id, b, i - j, chain),
longest AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n, 0) AS BIGINT) AS longest, CAST(start - 1 AS BIGINT) AS longest_at
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN longest USING (doc_id)"""


@query("op8_decontaminate", OP8)
def op8(spark, sf):
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_language_id")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    return language_id.label(docs, language_id.fit(docs), spans=False).select("doc_id", held_out(), "lang_pred", "score")


@query("op7_toxicity")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(), "score", "predicted")


# The formatted windows of op3 in SQL; the escape sign is written as chr(92).
def _sql_escape(x, pairs):
    for old, new in pairs:
        old, new = ("'" + s.replace("\\", "'||chr(92)||'").replace("\n", "'||chr(10)||'") + "'" for s in (old, new))
        x = f"replace({x}, {old}, {new})"
    return x


OP3 = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, {chat_format.MARKS} + len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS n,
    length({_sql_escape(_sql_escape('role', chat_format.ESCAPE), [(chr(10), chr(92) + 'n')])}) + length({_sql_escape('text', chat_format.ESCAPE)})
      + {len(chat_format.OPEN) + len(chat_format.CLOSE) + 1} AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns),
placed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) AS after,
    min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id) AS sys FROM sized),
system AS (SELECT conv_id, n AS sys_n, chars AS sys_chars FROM placed WHERE pos = sys AND 2 * n <= {chat_format.BUDGET - chat_format.HISTORY}),
celled AS (
  SELECT placed.*, sys_chars,
    (after - 1) // greatest(1, ({chat_format.BUDGET - chat_format.HISTORY} - coalesce(sys_n, 0)) // 2) AS w
  FROM placed LEFT JOIN system USING (conv_id)),
cells AS (SELECT conv_id, w, max(after) AS closes, lead(w) OVER (PARTITION BY conv_id ORDER BY w) AS ahead FROM celled GROUP BY 1, 2),
uses AS (
  SELECT conv_id, w, pos, chars, sys, sys_chars FROM celled
  UNION ALL SELECT conv_id, ahead, pos, chars, sys, sys_chars FROM celled JOIN cells USING (conv_id, w)
  WHERE ahead IS NOT NULL AND closes - after + n <= {chat_format.HISTORY}),
windows AS (
  SELECT conv_id, w, sum(chars) + CASE WHEN any_value(sys) IS NOT NULL AND NOT bool_or(pos = sys) THEN coalesce(any_value(sys_chars), 0) ELSE 0 END AS chars
  FROM uses GROUP BY 1, 2),
totals AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM windows GROUP BY 1),
read AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS lines,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM sized GROUP BY 1)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM read JOIN totals USING (conv_id)"""


@query("op3_chat_windows", OP3)
def op3(spark, sf):
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digests(chat_format.format_windows(turns))


OP6 = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10"""


@query("op6_top_k", OP6)
def op6(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return top_k.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query("op10_suffix_dedup")
def op10(spark, sf):
    return suffix_dedup.report(table(spark, sf, "documents"))


OP2 = r"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS t FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS u(i) WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) LEFT JOIN c USING (doc_id)"""


@query("op2_ngram_join", OP2)
def op2(spark, sf):
    return ngram_join.report(table(spark, sf, "documents"))


@query("op11_whitening")
def op11(spark, sf):
    found = whitening.report(table(spark, sf, "embeddings"))
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error")


@query("op12_source_mix")
def op12(spark, sf):
    return source_mix.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


# CRC-32 of an id's digits, bit by bit.
OP13_CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda crc, d:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, d)), 4294967295), 4294967295)"""
OP13 = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS own
  FROM t GROUP BY 1),
h AS (SELECT conv_id, own, {OP13_CRC} % 4 AS h FROM o),
c AS (
  SELECT h.conv_id, list_concat(coalesce(b.own, [])[:h.h], h.own[h.h + 1:]) AS turns
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, turns[:d] AS p, CAST(d AS BIGINT) AS depth, d = len(turns) AS ends FROM c, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT p[:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE
    (n_convs - 1) * len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) END AS own_saved FROM n LEFT JOIN k USING (p, depth)),
s AS (
  SELECT p[:d] AS p, CAST(d AS BIGINT) AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved_tokens
  FROM v, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1, 2)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (p, depth) LEFT JOIN n up ON v.depth > 0 AND up.depth = v.depth - 1 AND up.p = v.p[:v.depth - 1]"""


@query("op13_prefix_trie", OP13)
def op13(spark, sf):
    return prefix_trie.report(table(spark, sf, "conversations"))
