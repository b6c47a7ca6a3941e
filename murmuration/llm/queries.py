"""The registered query of each operator over its whole table, and its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import chat_format, collocations, exact_dedup, html_extract, language_model, mixing, pieces, quality_rules, sharding, simhash, token_files, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("bucket")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"),
        quality_rules.passes().alias("kept"),
        "n_lines",
        "n_capitals",
        "failed",
    )


_SPACE = r"[\x20\x09-\x0D]+"

OP8_MEASURES_SQL = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
g AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
s AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS cover
  FROM h WHERE n > 1
),
c AS (SELECT doc_id, sum(cover) AS n_repeat_words FROM s GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)
),
l AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 5 * n_capitals > 4 * word_chars THEN 64 ELSE 0 END) AS BIGINT) AS failed
  FROM m
)
"""

OP8_SQL = f"""
WITH {OP8_MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, n_lines, n_capitals, failed
FROM l
"""

def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS place
  FROM documents
),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS weight FROM p),
v AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS BIGINT) AS capped,
         sum(weight) OVER (ORDER BY source_size / weight, rank
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w
),
f AS (SELECT *, (total - capped) / open_weight AS lvl FROM v),
l AS (
  SELECT arg_min(lvl, ROW(source_size / weight, rank)) AS water FROM f WHERE lvl * weight <= source_size * 3
),
t AS (SELECT source, rank, source_size, total, least(water * weight, source_size * 3.0::DOUBLE) AS target FROM f, l),
s AS (
  SELECT d.*, rank, source_size, target, total,
         CAST(sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
e AS (
  SELECT s.*, epoch, CAST(epoch * source_size + served AS BIGINT) / target AS finish
  FROM s, (SELECT unnest(range(3)) AS epoch) WHERE size > 0
),
q AS (
  SELECT doc_id, size, total,
         sum(size) OVER (ORDER BY finish, rank, place, doc_id, epoch, size ROWS UNBOUNDED PRECEDING) AS mixed
  FROM e WHERE finish < 2
),
k AS (SELECT doc_id, sum(size) AS taken FROM q WHERE mixed <= total GROUP BY doc_id)
SELECT s.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM s LEFT JOIN k ON s.doc_id = k.doc_id
"""


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_tokens(manifest)


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(_table(spark, sf_dir, "documents"), path, round_trip=True)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 7 == 2


def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"), held_out())


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.perspectives(_table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations
),
members AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
r AS (
  SELECT s.conv_id, perspective, turn, speaker, content,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN members m ON s.conv_id IS NOT DISTINCT FROM m.conv_id
),
h AS (
  SELECT *, '<|im_start|>' || role
    || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(speaker, '\s+', '_', 'g') ELSE '' END || chr(10) AS head
  FROM r
),
g AS (
  SELECT *, CASE WHEN role <> 'system' THEN speaker END AS name, head || content || '<|im_end|>' || chr(10) AS segment
  FROM h
),
p AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS stop
  FROM g
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, name NULLS FIRST, segment
               ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn, role, name, segment, role = 'assistant' AS masked,
       stop - length(segment) AS start, stop,
       stop - length(segment) + length(head) AS content_start,
       stop - length(segment) + length(head) + length(content) + 10 AS content_stop
FROM p
"""


def op11_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= toxicity.PREDICT_FROM).cast("int")
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"), "n_sentences", "worst_start", "worst_stop", "worst_score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP13_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (
  SELECT lang, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))
),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS parts FROM f WHERE m > 1),
k AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(parts, 1, k), ' ') AS head,
         array_to_string(list_slice(parts, k + 1, m), ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
),
s AS (
  SELECT k.lang, k.phrase, k.k, k.a, x.a AS l, y.a AS r, n,
         CAST((1000::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.tail JOIN n ON n.lang = k.lang
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, a, parts, size, unnest(range(1, m - size + 2)) AS i
  FROM (SELECT *, unnest(range(2, m)) AS size FROM c)
),
d AS (SELECT lang, array_to_string(list_slice(parts, i, i + size - 1), ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""


QUERIES = {
    "op1_byte_shards": op1_byte_shards,
    "op2_token_files": op2_token_files,
    "op3_source_mix": op3_source_mix,
    "op4_main_text": op4_main_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_perspectives": op6_chat_perspectives,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_quality_rules": op8_quality_rules,
    "op9_pitman_yor_scores": op9_pitman_yor_scores,
    "op10_simhash_groups": op10_simhash_groups,
    "op11_toxic_sentences": op11_toxic_sentences,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op3_source_mix": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_chat_perspectives": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op13_collocations": OP13_SQL,
}
