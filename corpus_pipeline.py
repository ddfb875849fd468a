"""From raw documents to a training mix: the stages of the pipeline, each of which hands documents to the next.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes every stage's result as Parquet
below the folder that ``spark.checkpoint.dir`` names and reads it as the next stage's documents.  All stages but the last
return the columns of ``docs``, whatever they are.

Defined cases: rows are decided on one by one, also those without doc_id or with a doc_id that others have;
an empty table passes through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_audit.llm import decontaminate, mixing, quality, simhash, tokens
from corpus_audit.llm.queries import table, vocabulary
from corpus_audit.llm.storage import shared_folder, stored

#: Candidates differ in at most seven bits of one of two fingerprints of word pairs; links need 0.8 of the five-word shingles.
CANDIDATE_WORDS, DIFFERING_BITS, SHINGLE_WORDS, SIMILARITY = 2, 7, 5, 0.8


def _columns(docs: DataFrame, of: str) -> list[Column]:
    """All columns of ``docs``, kept in the struct column ``of``."""
    return [F.col(f"{of}.`{name}`").alias(name) for name in docs.columns]


def _record(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{name}`") for name in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules for documents and hosts."""
    rows = docs.select(_record(docs).alias("record"), "text", "source")
    judged = quality.judged(rows, keep=("record",))
    return judged.filter("kept").select(*_columns(docs, "record"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the first by doc_id; null comes last.

    Texts that have no word share a fingerprint and are one group like any other.
    """
    return simhash.kept(docs, words_each=CANDIDATE_WORDS, max_bits=DIFFERING_BITS, verify_words=SHINGLE_WORDS,
                        similarity=SIMILARITY)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whatever other rows with their doc_id hold."""
    rows = stored(docs.select(_record(docs).alias("record"), F.monotonically_increasing_id().alias("row")), "rows")
    leaks = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), text="record.text", doc_id="row")
    leaked = stored(leaks.select(F.col("doc_id").alias("row")).distinct(), "leaked")
    return rows.join(leaked, "row", "left_anti").select(*_columns(docs, "record"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix, in shuffled order."""
    return mixing.mixed(docs).select(*_columns(docs, "record"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every document's ids lie in the packed files, with their checksum."""
    return tokens.read_tokens(tokens.write_tokens(docs, shared_folder(spark, "tokens"), vocabulary()))


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token ids", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


#: SQL has no SimHash, template windows or subword vocabulary; the tests compare the stages with brute force.
ORACLE_SQL = None
