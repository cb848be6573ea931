"""Queries over the document tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bm25, bpe, chat, jaccard_join, katz, langid, line_dedup, packing, phrases, quality, sharding, suffix_dedup,
               vector_codes)

PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.every_twentieth(_documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(spark, _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).select(PACKED)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_report(_documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(spark, _documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_documents(spark, sf_dir))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.chat_report(conversations.unionByName(chat.probe(conversations)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_bm25_search, op2_suffix_array_dedup, op3_byte_bpe, op4_quality_rules, op5_best_fit_packing, op6_ngram_jaccard_join, op7_language_id, op8_katz_scores,
    op9_hilbert_shards, op10_line_dedup, op11_phrase_collocations, op12_vector_codes, op13_chat_format)}

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, no, ls[no] AS line, {_WORDS.format('ls[no]')} AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS no FROM docs)),
worded AS (SELECT * FROM lines WHERE len(w) > 0),
firsts AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS f, any_value(w) AS w FROM worded GROUP BY line),
long AS (SELECT line, f, w, len(w) AS n FROM firsts WHERE len(w) >= {line_dedup.NEAR_WORDS}),
cut AS (SELECT line, f, n, i, list_concat(w[1:i - 1], w[i + 1:]) AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)),
mask AS (SELECT n, i, rest, min(f) AS m FROM cut GROUP BY ALL),
near AS (
  SELECT c.line FROM cut c JOIN mask m ON m.n = c.n AND m.i = c.i AND m.rest = c.rest WHERE m.m < c.f
  UNION SELECT c.line FROM cut c JOIN long l ON l.w = c.rest WHERE l.f < c.f
  UNION SELECT l.line FROM cut c JOIN long l ON l.w = c.rest WHERE c.f < l.f),
judged AS (
  SELECT l.doc_id, l.no, l.line, len(l.w) > 0 AS worded,
    coalesce(len(l.w) > 0 AND struct_pack(d := l.doc_id, n := l.no) > f.f, false) AS exact,
    coalesce(len(l.w) > 0 AND n.line IS NOT NULL, false) AS near
  FROM lines l LEFT JOIN firsts f ON len(l.w) > 0 AND f.line = l.line LEFT JOIN near n ON len(l.w) > 0 AND n.line = l.line)
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (exact) AS n_exact,
  count(*) FILTER (near AND NOT exact) AS n_near,
  md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT exact AND NOT near), '')) AS kept_md5
FROM judged GROUP BY doc_id"""

ORACLE = {"op10_line_dedup": _LINE_DEDUP}

# Links of the join: shares of common windows of five words; classes by the least reachable id.
_JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
texts AS (SELECT w, min(doc_id) AS t, count(*) AS copies FROM docs WHERE len(w) > 0 GROUP BY w),
grams AS (SELECT DISTINCT t, w[i:i + least(5, len(w)) - 1] AS g
  FROM (SELECT t, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM texts)),
sizes AS (SELECT t, count(*) AS n FROM grams GROUP BY t),
common AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.t <> b.t GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.t = c.a JOIN sizes y ON y.t = c.b WHERE 5 * c.n >= 4 * (x.n + y.n - c.n)),
reach AS (SELECT t AS a, t AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS t, min(b) AS class_id FROM reach GROUP BY a),
linked AS (SELECT l.a AS t, sum(x.copies) AS n FROM links l JOIN texts x ON x.t = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id,
  CAST(coalesce(l.n, 0) + coalesce(x.copies - 1, 0) AS BIGINT) AS n_links
FROM docs d LEFT JOIN texts x ON x.w = d.w LEFT JOIN classes c ON c.t = x.t LEFT JOIN linked l ON l.t = x.t"""

ORACLE["op6_ngram_jaccard_join"] = _JACCARD

# All phrases of up to five words, counted; every cut of the candidates; the contiguous parts of longer candidates.
ORACLE["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + m - 1] AS p, m FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM starts)),
counts AS (SELECT lang, p, m, count(*) AS f FROM grams GROUP BY lang, p, m),
candidates AS (SELECT lang, p, m, f AS a FROM counts WHERE m > 1 AND f >= 100),
cuts AS (SELECT c.*, k, p[1:k] AS lp, p[k + 1:] AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c),
scored AS (
  SELECT c.lang, c.p, c.m, c.a, c.k, x.f AS l, y.f AS r, s.n,
    CAST((CAST(1000 AS HUGEINT) * c.a * s.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN sizes s ON s.lang = c.lang JOIN counts x ON x.lang = c.lang AND x.p = c.lp
  JOIN counts y ON y.lang = c.lang AND y.p = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
parts AS (
  SELECT lang, a, p[i:i + j - 1] AS part
  FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM candidates WHERE m > 2))),
inner_ AS (SELECT DISTINCT c.lang, c.p FROM candidates c JOIN parts q ON q.lang = c.lang AND q.part = c.p WHERE 100 * q.a >= 100 * c.a),
ranked AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score
  FROM best b LEFT JOIN inner_ d ON d.lang = b.lang AND d.p = b.p WHERE d.p IS NULL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000"""

_ASSIGN = """
a{i} AS (
  SELECT row, p, min_by(e, far * 64 + e) AS e, min(far) AS far
  FROM (SELECT x.row, x.p, y.e, list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
        FROM parts x JOIN books{i} y ON y.p = x.p)
  GROUP BY row, p),"""
_UPDATE = """
mean{i} AS (
  SELECT p, e, list(m ORDER BY d) AS v
  FROM (SELECT a.p, a.e, d, CAST(floor(sum(x.v[d]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
        FROM a{i} a JOIN parts x ON x.row = a.row AND x.p = a.p, range(1, 1 + (SELECT max(len(v)) FROM parts)) t(d) GROUP BY a.p, a.e, d)
  GROUP BY p, e),
books{j} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM books{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e),"""

ORACLE["op12_vector_codes"] = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT row, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM kept, range(16) t(p)),
books0 AS (SELECT p, row AS e, v FROM parts WHERE row < 64),
{_ASSIGN.format(i=0)}{_UPDATE.format(i=0, j=1)}{_ASSIGN.format(i=1)}{_UPDATE.format(i=1, j=2)}{_ASSIGN.format(i=2)}
codes AS (SELECT row, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY row),
sha AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS h FROM (
  SELECT p, e, array_to_string(list_transform(v, lambda y: CAST(y AS VARCHAR)), ',') AS x FROM books2))
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, sha.h AS codebooks_sha256
FROM kept k JOIN codes c ON c.row = k.row, sha"""

_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"
_SAID = "<|im_end|><|im_start|>assistant ok"

ORACLE["op13_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
marked AS (SELECT *, {_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} AS shown_role,
  {_ESCAPED.format('text')} AS shown FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, shown)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, shown) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(shown_role) + 1 + length(shown) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS expanded_tokens
FROM marked GROUP BY conv_id"""
