"""Cleanliness jobs: copies, dead code, complexity, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions import text as tx
from ..session import cut_lineage
from ..sources.scopes import content_hash
from . import rules


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(hash, canonical, copies): groups of identical files."""
    return (files.select("path", content_hash(F.col("text")).alias("hash"))
            .groupBy("hash").agg(F.min("path").alias("canonical"), F.count(F.lit(1)).alias("copies"))
            .filter("copies > 1"))


def redundant_files(files: DataFrame) -> DataFrame:
    """(path, canonical): every copy next to the file that should stay."""
    hashed = files.select("path", content_hash(F.col("text")).alias("hash"))
    groups = exact_duplicates(files).select("hash", "canonical")
    return hashed.join(groups, "hash").filter("path <> canonical").select("path", "canonical")


def _normalized(files: DataFrame) -> DataFrame:
    """Non-blank lines, squeezed, with the numbers they had."""
    lines = tx.numbered(F.transform(tx.lines_of(F.col("text")), tx.squeeze))
    return files.select("path", F.filter(lines, lambda x: x.line != "").alias("lines"))


def windows(files: DataFrame, k: int) -> DataFrame:
    """(path, idx, line_start, line_end, hash): every run of k normalized lines."""
    w = _normalized(files).filter(F.size("lines") >= k)
    spans = F.transform(F.sequence(F.lit(1), F.size("lines") - (k - 1)), lambda i: F.struct(
        i.alias("idx"), F.element_at("lines", i).line_no.alias("line_start"),
        F.element_at("lines", i + (k - 1)).line_no.alias("line_end"),
        F.md5(F.concat_ws("\n", F.transform(F.slice("lines", i, k), lambda x: x.line))).alias("hash")))
    return w.select("path", F.explode(spans).alias("s")).select("path", "s.*")


def repeated_blocks(files: DataFrame, k: int) -> DataFrame:
    """(hash, occurrences, files): runs of k lines that occur more than once."""
    per_file = windows(files, k).groupBy("hash", "path").agg(F.count(F.lit(1)).alias("n"))
    return (per_file.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files"))
            .filter("occurrences > 1"))


def block_duplicates(files: DataFrame, k: int) -> DataFrame:
    """(path, line_start, line_end): maximal ranges made of repeated k-line runs.

    Pairs of places are never listed, so a block that sits in a third of all files costs one row per
    place.  The window covers the lines of one file, which arrived as one cell.
    """
    places = windows(files, k).join(repeated_blocks(files, k).select("hash"), "hash", "left_semi")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("path").orderBy("idx"))
    return (places.withColumn("island", island).groupBy("path", "island")
            .agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")).drop("island"))


def repeated_lines(files: DataFrame, min_count: int) -> DataFrame:
    """(line, occurrences, files) of lines seen at least ``min_count`` times."""
    lines = files.select("path", F.explode(tx.lines_of(F.col("text"))).alias("line"))
    per_file = lines.groupBy("line", "path").agg(F.count(F.lit(1)).alias("n"))
    return (per_file.groupBy("line").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files"))
            .filter(F.col("occurrences") >= min_count))


# Import statements and the names they bind.
IMPORT_LINE = r"^[ \t]*(import[ \t]|from[ \t].*[ \t]import[ \t])"
DEFAULT_NAME = r"^[ \t]*import[ \t]+(?:type[ \t]+)?([A-Za-z_$][A-Za-z0-9_$]*)"
STAR_NAME = r"\*[ \t]+as[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)"
BRACED = r"\{([^}]*)\}"


def bound_names(line: Column) -> Column:
    """Names an import line brings into scope."""
    braced = F.split(F.regexp_extract(line, BRACED, 1), ",", -1)
    inner = F.transform(braced, lambda n: F.trim(F.regexp_replace(n, r"^.*[ \t]as[ \t]", "")))
    names = F.concat(F.array(F.regexp_extract(line, DEFAULT_NAME, 1), F.regexp_extract(line, STAR_NAME, 1)), inner)
    return F.filter(names, lambda n: n != "")


def unused_imports(files: DataFrame, run_id: str | None = None) -> DataFrame:
    """Imported names that occur nowhere else in their file; JSX uses ``React`` without naming it."""
    code = files.filter(F.col("text").rlike("(?m)" + IMPORT_LINE)).select(
        "path", F.transform(tx.lines_of(F.col("text")), tx.strip_comment).alias("lines"))
    is_import = lambda line: line.rlike(IMPORT_LINE)
    body = F.array_join(F.filter("lines", lambda line: ~is_import(line)), "\n")
    used = F.array_distinct(F.split(body, r"[^A-Za-z0-9_$]+", -1))
    imports = F.filter(tx.numbered(F.col("lines")), lambda x: is_import(x.line))
    named = F.flatten(F.transform(imports, lambda x: F.transform(
        bound_names(x.line), lambda n: F.struct(x.line_no.alias("line_start"), n.alias("symbol")))))
    unused = F.filter(named, lambda x: ~F.array_contains(F.col("used"), x.symbol)
                      & ~((x.symbol == "React") & F.col("path").rlike(r"\.(tsx|jsx)$")))
    hits = (code.withColumn("used", used).select("path", F.explode(unused).alias("u"))
            .select("path", "u.line_start", "u.symbol"))
    return rules.as_findings(hits, run_id=run_id, rule_id="DUP-07", axiom=3, severity="warning",
                             message="imported but never used")


EXPORT = r"(?m)^[ \t]*export[ \t]+(?:default[ \t]+)?(?:async[ \t]+)?(?:const|let|var|function|class|interface|type|enum)[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)"


def exports(files: DataFrame) -> DataFrame:
    """(path, symbol) that files export."""
    return files.select("path", F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(EXPORT), F.lit(1)))).alias("symbol"))


def unused_exports(exported: DataFrame, imported: DataFrame) -> DataFrame:
    """Exports (path, symbol) that no resolved import (dst, symbol) asks for."""
    wanted = imported.select(F.col("dst").alias("path"), "symbol").distinct()
    return exported.join(wanted, ["path", "symbol"], "left_anti")


BRANCH = r"\b(if|for|while|case|catch|elif|except)\b|&&|\|\|"


def complexity(files: DataFrame) -> DataFrame:
    """(path, zone, lines, complexity): one plus the number of branches."""
    others = [c for c in ("zone",) if c in files.columns]
    return files.select("path", *others, F.size(tx.lines_of(F.col("text"))).alias("lines"),
                        (F.regexp_count("text", F.lit(BRANCH)) + 1).alias("complexity"))


def zone_quantile(measures: DataFrame, value: str, q: float, out: str, zone: str = "zone") -> DataFrame:
    """Exact quantile of an integer measure per zone.

    Equal values are counted first, so a zone's state is its distinct values and not its files.
    """
    histogram = measures.groupBy(zone, value).agg(F.count(F.lit(1)).alias("_n"))
    return histogram.groupBy(zone).agg(F.percentile(value, F.lit(q), F.col("_n")).alias(out))


def complexity_hotspots(files: DataFrame, threshold: int, q: float = 0.9) -> DataFrame:
    """Files above a fixed threshold or above their zone's ``q`` quantile; a file without a zone only has the threshold."""
    measured = complexity(files)
    bars = zone_quantile(measured, "complexity", q, "zone_bar")
    return (measured.join(bars, "zone", "left")
            .filter((F.col("complexity") > threshold) | (F.col("complexity") > F.col("zone_bar"))))


LOGIC = r"\b(if|for|while|switch|function|def|class|return)\b"


def module_stem(path: Column) -> Column:
    """Path without root folder, extension and test marks: equal for a module and its test."""
    bare = F.regexp_replace(path, r"^(src|lib|app|tests?|__tests__)/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(\.(test|spec))?\.[A-Za-z]+$", ""), r"(^|/)test_", "$1")


def untested_modules(modules: DataFrame, tests: DataFrame) -> DataFrame:
    """Modules with logic that no test file matches by name."""
    stems = tests.select(module_stem(F.col("path")).alias("stem")).distinct()
    return (modules.filter(F.col("text").rlike(LOGIC)).select("path", module_stem(F.col("path")).alias("stem"))
            .join(stems, "stem", "left_anti").select("path"))


ASSERTION = r"\b(expect|assert[A-Za-z]*)[ \t]*\("
TRIVIAL = r"expect\((true|1)\)\.toBe\((true|1)\)|assert[ \t]+True\b|assertTrue\(True\)"
CASE = r"\b(it|test)\(|def test_"


def assertion_quality(tests: DataFrame, min_density: float = 1.0) -> DataFrame:
    """Assertions per test case, and how many of them are trivial; weak files are marked."""
    counted = tests.select(
        "path", F.regexp_count("text", F.lit(CASE)).alias("cases"),
        F.regexp_count("text", F.lit(ASSERTION)).alias("assertions"),
        F.regexp_count("text", F.lit(TRIVIAL)).alias("trivial"))
    real = F.col("assertions") - F.col("trivial")
    density = F.round(real / F.greatest("cases", F.lit(1)), 6)
    return counted.withColumn("density", density).withColumn("weak", F.col("density") < min_density)


def percent_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, percent rank over all rows) of an integer measure, from counts per distinct value."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(1))
    below = ordered.with_running_sum(counts, ["_all"], [value], F.floor(F.col(value) / 4096), F.col("_n"), "_upto")
    total = counts.groupBy("_all").agg(F.sum("_n").alias("_total"))
    rank = (F.col("_upto") - F.col("_n")) / F.nullif(F.col("_total") - 1, F.lit(0))
    return below.join(total, "_all").select(value, F.coalesce(rank, F.lit(0.0)).alias(out))


def priority_sample(files: DataFrame, churn: DataFrame, coverage: DataFrame, n: int) -> DataFrame:
    """Top ``n`` files by complexity, change count and missing criteria coverage.

    ``churn(path, changes)`` and ``coverage(path, covered)`` may lack files; the three percent ranks
    count alike.
    """
    joined = cut_lineage(complexity(files.select("path", "text")).drop("lines")
                         .join(churn.select("path", "changes"), "path", "left")
                         .join(coverage.select("path", "covered"), "path", "left")
                         .fillna({"changes": 0, "covered": 0}))
    ranked = joined
    for value in ("complexity", "changes", "covered"):
        ranked = ranked.join(percent_ranks(joined, value, f"{value}_rank"), value)
    blend = F.round((F.col("complexity_rank") + F.col("changes_rank") + (1 - F.col("covered_rank"))) / 3, 6)
    return (ranked.select("path", "complexity", "changes", "covered", blend.alias("priority"))
            .orderBy(F.col("priority").desc(), "path").limit(n))
