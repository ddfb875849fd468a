"""Which files a job looks at: whole corpus, changed files, uncommitted files, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

OWN_FOLDER = r"(^|/)\.corpus-audit/"
GENERATED = (r"\.generated\.", r"\.min\.js$", r"(^|/)node_modules/", r"(^|/)vendor/", r"(^|/)fixtures/")


def scan_corpus(spark: SparkSession, folder: str, pattern: str = "*", max_bytes: int = 64 << 20) -> DataFrame:
    """Every file below a folder of raw text files as (path, text, mtime, reason).

    A file that is no UTF-8 text or larger than ``max_bytes`` has a null text and says why in ``reason``; the content of
    large files is not loaded.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", pattern).load(folder))
    small = raw.filter(F.col("length") <= max_bytes).select(
        "path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("mtime"))
    large = raw.filter(F.col("length") > max_bytes).select(
        "path", F.lit(None).cast("string").alias("text"), F.col("modificationTime").alias("mtime"), F.lit("too large").alias("reason"))
    return small.withColumn("reason", F.when(F.col("text").isNull(), "no UTF-8 text")).unionByName(large)


def scan_table(spark: SparkSession, path: str, **renames: str) -> DataFrame:
    """A corpus that is already a Parquet table; ``renames`` maps its columns to ours."""
    table = spark.read.parquet(path)
    return table.withColumnsRenamed({old: new for new, old in renames.items()}) if renames else table


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _hashes(files: DataFrame) -> DataFrame:
    # Only the hash travels through the shuffle, never the text.
    return files.select("path", content_hash(F.col("text")).alias("hash"))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, status): A, M or D between two versions of a corpus."""
    b, h = _hashes(base).alias("b"), _hashes(head).alias("h")
    joined = b.join(h, F.col("b.path") == F.col("h.path"), "full_outer")
    status = (F.when(F.col("b.path").isNull(), "A").when(F.col("h.path").isNull(), "D")
              .when(F.col("b.hash") != F.col("h.hash"), "M"))
    return (joined.select(F.coalesce("h.path", "b.path").alias("path"), status.alias("status"))
            .filter("status is not null"))


def uncommitted(head: DataFrame, work: DataFrame) -> DataFrame:
    """Full files of the working copy that are modified or untracked."""
    touched = changed_files(head, work).filter("status in ('A', 'M')")
    return work.join(touched, "path")


def exclude(files: DataFrame, patterns: tuple[str, ...] = GENERATED) -> DataFrame:
    """Drop the tool's own folder, always, and whatever matches ``patterns``."""
    return files.filter(~F.col("path").rlike("|".join((OWN_FOLDER, *patterns))))


def snapshot_as_of(versions: DataFrame, ref) -> DataFrame:
    """Newest version of every path not later than ``ref``; deleted paths are absent.

    Only version numbers are aggregated; the text is fetched by a semi join on the winners.
    """
    newest = (versions.filter(F.col("ref") <= F.lit(ref)).groupBy("path").agg(F.max("ref").alias("ref")))
    current = versions.join(newest, ["path", "ref"], "left_semi")
    return current.filter(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in versions.columns else current


def diff_refs(versions: DataFrame, base_ref, head_ref) -> DataFrame:
    """(path, status) between two refs of a versions table."""
    return changed_files(snapshot_as_of(versions, base_ref), snapshot_as_of(versions, head_ref))


def changed_lines(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, changed): added plus deleted lines per file, lines taken as a multiset."""
    touched = changed_files(base, head).select("path")
    def signed(files: DataFrame, sign: int) -> DataFrame:
        own = files.select("path", "text").join(touched, "path", "left_semi")
        lines = own.select("path", F.explode(tx.lines_of(F.col("text"))).alias("line"))
        return lines.groupBy("path", "line").agg((F.count(F.lit(1)) * sign).alias("n"))
    both = signed(base, -1).unionByName(signed(head, 1))
    return (both.groupBy("path", "line").agg(F.abs(F.sum("n")).alias("n"))
            .groupBy("path").agg(F.sum("n").alias("changed")))


def changed_kloc(base: DataFrame, head: DataFrame, floor: float = 0.1) -> DataFrame:
    """One row: changed lines in total and as KLOC, floored."""
    total = changed_lines(base, head).agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))
    return total.withColumn("kloc", F.greatest(F.col("changed") / 1000.0, F.lit(floor)))


def retain_runs(runs: DataFrame, n: int = 100, per: list[str] | None = None) -> DataFrame:
    """Newest ``n`` runs, over all or per key."""
    order = [F.col("at").desc(), F.col("run_id").desc()]
    if not per:
        return runs.orderBy(*order).limit(n)
    # The rank limit is applied before the shuffle too, so a hot key ships n rows per task.
    ranked = runs.withColumn("_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def converge(runs: DataFrame, pr_map: DataFrame) -> DataFrame:
    """One timeline key per change: the pull request of a branch, else the branch itself."""
    mapping = pr_map.groupBy("branch").agg(F.min("pr_id").alias("pr_id"))
    return (runs.join(mapping, "branch", "left")
            .withColumn("timeline", F.coalesce(F.concat(F.lit("pr/"), F.col("pr_id").cast("string")),
                                               F.concat(F.lit("branch/"), F.col("branch")))))
