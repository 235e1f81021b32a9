"""The queries of the operators over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, langid, mixing, negatives, pii, quality, quotes, simhash, suffixes, tokens, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return tokens.token_counts(table(spark, sf_dir, "documents"), str(path))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    counts = [F.col(c) for c in quality.COLUMNS[:5]]
    return judged.select("doc_id", *counts, "base_failed", "kept", *quality.COLUMNS[5:])


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mixture(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_mixing"] = (
    mixing.SQL.format(documents="documents")
    + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixture"
)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


@query
def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


ORACLES["op6_warc_index"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
firsts AS (SELECT payload, max(page_id) AS first FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload)
SELECT page_id, payload_bytes, sha1(p.payload) AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.payload = f.payload
"""


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.chat_format(table(spark, sf_dir, "conversations"))


ORACLES["op5_quotation_linking"] = r"""
WITH messages AS (
  SELECT row_number() OVER () AS message_no, conv_id, turn, coalesce(role, 'unknown') AS role,
    string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
numbered AS (
  SELECT message_no, conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM messages),
marked AS (
  SELECT *, CASE WHEN regexp_matches(line, '^[ \t]{0,3}>')
    THEN len(regexp_replace(regexp_extract(line, '^[ \t>]*>'), '[^>]', '', 'g')) ELSE 0 END AS depth FROM numbered),
bodies AS (
  SELECT *, CASE WHEN depth > 0 THEN regexp_replace(line, '^[ \t>]*>[ \t]?', '') ELSE line END AS body FROM marked),
worded AS (
  SELECT *, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM bodies),
cut AS (
  SELECT *, coalesce(depth <> lag(depth) OVER w OR (words = '') <> (lag(words) OVER w = ''), true) AS opens
  FROM worded WINDOW w AS (PARTITION BY message_no ORDER BY k)),
runs AS (SELECT *, sum(opens::INT) OVER (PARTITION BY message_no ORDER BY k) AS run FROM cut),
passages AS (
  SELECT message_no, conv_id, turn, depth, string_agg(words, ' ' ORDER BY k) AS words
  FROM runs WHERE words <> '' GROUP BY message_no, conv_id, turn, run, depth),
quotes AS (
  SELECT q.message_no, q.conv_id, q.turn, q.depth, (
    SELECT max(p.turn) FROM passages p
    WHERE p.depth = 0 AND p.conv_id = q.conv_id AND p.words = q.words AND p.turn < q.turn) AS original_turn
  FROM passages q WHERE q.depth > 0),
linked AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(original_turn) AS n_linked,
    max(original_turn) FILTER (depth = 1) AS quoted
  FROM quotes GROUP BY conv_id, turn),
turns AS (
  SELECT *, row_number() OVER w AS position, lag(turn) OVER w AS before
  FROM (SELECT DISTINCT conv_id, turn FROM messages) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
unquoted AS (
  SELECT message_no, regexp_replace(trim(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (depth = 0), ''),
    ' ' || chr(9) || chr(10) || chr(13)), '\n{3,}', chr(10) || chr(10), 'g') AS message
  FROM runs GROUP BY message_no)
SELECT m.conv_id, m.turn, t.position, m.role, coalesce(l.quoted, t.before) AS reply_to,
  coalesce(l.n_quotes, 0) AS n_quotes, coalesce(l.n_linked, 0) AS n_linked, u.message,
  '<|' || m.role || '|>' || chr(10) || u.message || chr(10) || '<|end|>' || chr(10) AS formatted
FROM messages m JOIN unquoted u ON u.message_no = m.message_no
  JOIN turns t ON t.conv_id = m.conv_id AND t.turn = m.turn
  LEFT JOIN linked l ON l.conv_id = m.conv_id AND l.turn = m.turn
"""


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrase_collocations"] = collocations.SQL


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    embeddings = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return negatives.hard_negatives(embeddings, F.col("id") % 100 == 0)


ORACLES["op11_hard_negatives"] = negatives.SQL


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = toxicity.toxicity(documents, toxicity.fit(documents, labels, learn_from=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", *toxicity.KINDS)
