"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwatch.llm.best_fit_packing import pack_documents
from netwatch.llm.byte_bpe import encoding_digests
from netwatch.llm.chat_format import conversation_digests, format_conversations
from netwatch.llm.common import read_table
from netwatch.llm.decontaminate import contaminated_pairs
from netwatch.llm.hard_negatives import hard_negatives
from netwatch.llm.html_extract import extract_pages
from netwatch.llm.near_dedup import near_duplicates
from netwatch.llm.periodic_runs import run_digests
from netwatch.llm.quality_rules import MEASURES, SIGNALS, quality_verdicts
from netwatch.llm.secret_scan import secret_report
from netwatch.llm.token_counts import count_flat_tokens, write_flat_tokens
from netwatch.llm.token_files import token_file_checks, write_token_files
from netwatch.llm.url_filter import url_verdicts
from netwatch.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, then the rule signals."""
    verdicts = quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", *MEASURES, "base_failed", "kept", *SIGNALS)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_no, doc_no, start, n_tokens, ended of the documents in flat files written from the table."""
    folder = f"{shared_folder(spark)}/flat-{uuid.uuid4().hex}"
    write_flat_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return count_flat_tokens(spark, folder)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    return secret_report(read_table(spark, sf_dir, "documents"))


#: Fixed rules of the query: verdict, host, path prefix.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score."""
    return url_verdicts(read_table(spark, sf_dir, "pages"), URL_RULES)


@query
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item it holds: doc_id, item_id, n_covered, n_item_words, n_changed."""
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), any_case=True)


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoding_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all read back from the files."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_file_checks(spark, folder)


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    return run_digests(read_table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr(
        "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return hard_negatives(rows, F.expr("vec_id % 50 = 0"))


#: A conversation whose texts are control strings, formatted beside the table.
CONTROL_TURNS = "VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM ({CONTROL_TURNS}) AS t(conv_id, turn, role, text)")
    return conversation_digests(format_conversations(rows.union(extra)))


SQL["op9_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), written AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g') AS r,
         regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g') AS t
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>[INST]' || r || '[/INST]' || t || '</s>'))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


SQL["op6_near_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split
), each_one AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM each_one x JOIN each_one y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM sets UNION SELECT b, root FROM reach JOIN both_ways ON a = doc_id
), roots AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)
"""


SQL["op13_hard_negatives"] = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
