"""Acceptance criteria: ``acs(spec_id, ac_id, text, test_refs, critical)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, rules

QUANTIFIED = (r"(?i)([0-9]+(\.[0-9]+)?[ ]*(ms|s|sec|seconds?|minutes?|%|percent|kb|mb|gb|items?|rows?|requests?|users?)([^a-z]|$)"
              r"|(<=|>=|<|>|=|at most|at least|exactly|less than|more than|within|returns?)[ ]+[0-9]+)")
VAGUE = r"(?i)\b(fast|quick|quickly|slow|easy|well|good|nice|intuitive|user-friendly|robust|scalable|efficient|soon|appropriate|reasonable|simple)\b"


def validate_acs(acs: DataFrame) -> DataFrame:
    """Add ``passed`` and ``reason``: a criterion must state something measurable."""
    text = F.trim(F.coalesce("text", F.lit("")))
    vague = F.lower(F.regexp_extract(text, VAGUE, 1))
    reason = (F.when(text == "", "empty").when(text.rlike(QUANTIFIED), "quantified")
              .when(vague != "", F.concat(F.lit("vague: "), vague)).otherwise("no measurable bound"))
    return acs.withColumn("reason", reason).withColumn("passed", F.col("reason") == "quantified")


def spec_gate(ac_verdicts: DataFrame) -> DataFrame:
    """(spec_id, criteria, failures, passed): a spec passes when all its criteria do."""
    return ac_verdicts.groupBy("spec_id").agg(F.count(F.lit(1)).alias("criteria"), F.count_if(~F.col("passed")).alias("failures"),
                                              F.bool_and("passed").alias("passed"))


def missing_fields(fields: DataFrame, required: list[str]) -> DataFrame:
    """(spec_id, missing, error): required fields that a spec lacks, from rows (spec_id, field)."""
    wanted = fields.select("spec_id").distinct().select("spec_id", F.explode(F.array(*[F.lit(f) for f in required])).alias("field"))
    absent = wanted.join(fields.select("spec_id", "field").distinct(), ["spec_id", "field"], "left_anti")
    return absent.select("spec_id", F.col("field").alias("missing"), F.concat(F.lit("missing_field:"), "field").alias("error"))


def bind(acs: DataFrame, symbols: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(spec_id, ac_id, symbol, path): identifiers of a criterion found in the change or what it refers to.

    ``symbols(path, symbol)``, ``changed(module)``; references are followed ``depth`` imports deep.
    """
    uses = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    scope = graph.blast_radius(uses, changed, depth).select(F.col("module").alias("path"))
    known = symbols.join(scope, "path", "left_semi").select("path", "symbol").distinct()
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    return acs.select("spec_id", "ac_id", F.explode(tokens).alias("symbol")).join(known, "symbol").select("spec_id", "ac_id", "symbol", "path")


def unbound(acs: DataFrame, bindings: DataFrame, run_id: str | None = None) -> DataFrame:
    """Criteria no symbol was found for, as findings."""
    loose = acs.join(bindings.select("spec_id", "ac_id").distinct(), ["spec_id", "ac_id"], "left_anti")
    rows = loose.select(F.concat(F.lit("spec/"), F.col("spec_id").cast("string")).alias("path"), F.col("ac_id").cast("string").alias("symbol"),
                        F.lit(1).alias("line_start"))
    return rules.as_findings(rows, run_id=run_id, rule_id="SPC-05", axiom=2, severity="warning", message="criterion bound to no symbol", source="graph")


def ac_coverage(acs: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row: share of criteria bound, with a test, and critical ones bound."""
    bound = bindings.select("spec_id", "ac_id").distinct().withColumn("_bound", F.lit(1.0))
    joined = acs.join(bound, ["spec_id", "ac_id"], "left").fillna(0.0, ["_bound"])
    tested = (F.size("test_refs") > 0).cast("double")
    return joined.agg(F.count(F.lit(1)).alias("criteria"), F.round(F.avg("_bound"), 6).alias("bound_share"), F.round(F.avg(tested), 6).alias("tested_share"),
                      F.round(F.avg(F.when(F.col("critical"), F.col("_bound"))), 6).alias("critical_bound_share"))


def spec_tier(specs: DataFrame, explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """One row: degradation tier 1 to 4 and what it means; present also without any spec.

    ``specs(passed)`` are gated specs; the binding tables may be empty.
    """
    counts = (specs.agg(F.count_if(F.col("passed")).alias("validated"), F.lit(1).alias("_one"))
              .join(explicit.agg(F.count(F.lit(1)).alias("explicit"), F.lit(1).alias("_one")), "_one")
              .join(inferred.agg(F.count(F.lit(1)).alias("inferred"), F.lit(1).alias("_one")), "_one").drop("_one"))
    tier = (F.when(F.col("validated") == 0, 4).when(F.col("explicit") > 0, 1).when(F.col("inferred") > 0, 2).otherwise(3))
    meaning = F.when(tier == 1, "full").when(tier == 4, "none").otherwise("partial")
    return counts.withColumn("tier", tier).withColumn("coverage", meaning)


def spec_drift(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """(spec_id, symbol, drift): missing from the code, or extra in it."""
    a = declared.select("spec_id", "symbol").distinct().withColumn("_a", F.lit(True))
    b = derived.select("spec_id", "symbol").distinct().withColumn("_b", F.lit(True))
    joined = a.join(b, ["spec_id", "symbol"], "full_outer").filter("_a is null or _b is null")
    return joined.select("spec_id", "symbol", F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("drift"))
