"""The registered query of every operator in this subpackage, and SQL where SQL can state its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import alignment, bpe, conversations, decontaminate, language, lines, mixing, passages, quality, sharding, simhash, tokens, toxicity
from .storage import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(job):
        QUERIES[name] = job
        if sql is not None:
            ORACLE[name] = sql
        return job
    return register


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The file of one of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as it lies in its folder."""
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


QUALITY_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, list_extract(w, p) || ' ' || list_extract(w, p + 1) || ' ' || list_extract(w, p + 2) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM words)
), covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows), (SELECT unnest([0, 1, 2]) AS k)
  WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT doc_id, source AS host, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), hosts AS (
  SELECT host, count(*) AS n, [count_if(n_words < 50), count_if(100 * n_repeat_words > 50 * n_words),
    count_if(10 * n_symbols > word_chars), count_if(10 * n_dup_lines > n_words)] AS failures
  FROM measured WHERE host IS NOT NULL GROUP BY host
), rates AS (SELECT host, n, unnest(failures) AS k, unnest([1, 2, 3, 4]) AS rule FROM hosts
), sums AS (
  SELECT rule, sum(k) / sum(n) AS m, count(*) - 1 AS free, sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS room,
    sum(k::DOUBLE * k / n) - sum(k) * (sum(k) / sum(n)) AS s FROM rates GROUP BY rule
), prior AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND room >= 1e-9 THEN (s / (m * (1 - m)) - free) / room ELSE 0 END AS alike FROM sums
), shrunk AS (
  SELECT host, round(CASE WHEN alike >= 1e-9 THEN (k + m * greatest(1 / alike - 1, 2)) / (n + greatest(1 / alike - 1, 2))
    ELSE m END, 6) AS rate FROM rates JOIN prior USING (rule)
), verdicts AS (SELECT host, max(rate) > 0.75 AS host_failed FROM shrunk GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(host_failed, false) AS host_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(host_failed, false) AS kept
FROM measured LEFT JOIN verdicts USING (host)
"""


@query("op2_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents"))


@query("op3_simhash_near_duplicates")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.grouped(table(spark, sf_dir, "documents"))


@query("op10_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids lie in the packed files, with their checksum."""
    docs = table(spark, sf_dir, "documents")
    return tokens.read_tokens(tokens.write_tokens(docs, shared_folder(spark, "tokens"), vocabulary()))


MIXING_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, coalesce(sum(strlen(text)), 0)::BIGINT AS size FROM documents GROUP BY source
), weighed AS (SELECT source, size, sqrt(size) AS weight FROM sizes
), total AS (SELECT sum(size)::DOUBLE AS size, sum(weight::DECIMAL(30,6))::DOUBLE AS weight FROM weighed
), rates AS (
  SELECT w.source, CASE WHEN w.size = 0 THEN 1.0 ELSE round(w.weight * t.size / t.weight / w.size, 9) END::DOUBLE AS rate
  FROM weighed w, total t
), steps(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
), drawn AS (
  SELECT doc_id, source, strlen(text) AS n_bytes,
    ('0x' || substr(md5('17.count|' || coalesce(doc_id::VARCHAR, '') || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.source, n_bytes, any_value(rate) AS rate, count(*) FILTER (c <= u) AS copies
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.doc_id, d.source, n_bytes
), copied AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
SELECT doc_id, source, n_bytes, rate, copies, copy,
  ('0x' || substr(md5('17.order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key
FROM copied
"""


@query("op6_mix_sources", MIXING_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix, in shuffled order."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "record.doc_id", "record.source", F.octet_length("record.text").cast("long").alias("n_bytes"),
        "rate", "copies", "copy", "shuffle_key")


@query("op4_decontaminate")
def decontaminate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document holds, verbatim or with other parameters."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identified(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

SHARDS, SHARD_SEED = 24, 11


@query("op1_shard_documents")
def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies in 24 shuffled shards, and where it would lie in 25."""
    docs = table(spark, sf_dir, "documents")
    shards = sharding.write_shards(docs, shared_folder(spark, "shards"), SHARDS, SHARD_SEED)
    text = F.col("record.text")
    return sharding.slots(
        shards, F.col("record.doc_id"), sharding.size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        sharding.shard_of(F.col("record.doc_id"), SHARDS + 1, SHARD_SEED).alias("grown_shard"))


@query("op8_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which occurrence of every line, or of lines much like it, stays."""
    return lines.decided(table(spark, sf_dir, "documents"))


@query("op9_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that different documents share, and documents that are copies."""
    return passages.repeated(table(spark, sf_dir, "documents"))


@query("op13_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    import public_tokenizers
    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encoded(table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe.decoded(ids, ranks, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of every damaged conversation."""
    given = table(spark, sf_dir, "conversations")
    turns = conversations.damaged(given)
    planned = stored(conversations.plans(turns), "plans")
    digests = conversations.digests(conversations.repaired(turns, planned))
    found = (given.select(F.col("conv_id").alias("id")).distinct()
             .join(planned, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
             .join(digests, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        F.col("id").alias("conv_id"), *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(conversations.EMPTY_SHA256)).alias("repaired_sha256"))


@query("op11_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies meet in every document, with the corpus's counts of their links."""
    a, b = vocabulary(), vocabulary("piece_bpe_32k.model")
    found = alignment.scored(alignment.chunks(table(spark, sf_dir, "documents"), a, b), a, b)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
