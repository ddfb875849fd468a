"""Findings algebra: collect, identify, merge, gate, compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import AXES, FINDING, OWASP, REQUIRED_FINDING_FIELDS, SEVERITY_RANK
from ..session import cut_lineage
from ..sources.scopes import content_hash
from . import intervals
from .rules import severity_level


def severity_rank(severity: Column) -> Column:
    pairs = [item for level, rank in SEVERITY_RANK.items() for item in (F.lit(level), F.lit(rank))]
    return F.element_at(F.create_map(*pairs), severity)


def _severity_name(rank: Column) -> Column:
    pairs = [item for level, n in SEVERITY_RANK.items() for item in (F.lit(n), F.lit(level))]
    return F.element_at(F.create_map(*pairs), rank)


def axis_table(df: DataFrame) -> DataFrame:
    """The axes as a table, for reports that must show absent axes too."""
    return df.sparkSession.createDataFrame(list(AXES.items()), "axiom int, axis string")


def collect_findings(*tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, rejects): all detectors' output in the canonical record.

    Rows without a required field, or with an unknown severity or axis, are rejected and not lost.
    """
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    for field in FINDING.fields:
        if field.name not in union.columns:
            union = union.withColumn(field.name, F.lit(None).cast(field.dataType))
    valid = F.col("severity").isin(*SEVERITY_RANK) & F.col("axiom").isin(*AXES)
    for name in REQUIRED_FINDING_FIELDS:
        valid &= F.col(name).isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    ordered_columns = union.select(*FINDING.fieldNames(), *[c for c in union.columns if c not in FINDING.fieldNames()])
    return ordered_columns.filter(valid), ordered_columns.filter(~valid)


def attach_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``context``: the squeezed text of the finding's first line.

    One row per file with its wanted line numbers meets the text, so the text moves once.
    """
    wanted = findings.select("path").distinct()
    lines = files.join(wanted, "path", "left_semi").select("path", F.posexplode(tx.lines_of(F.col("text"))).alias("pos", "line"))
    context = lines.select("path", (F.col("pos") + 1).alias("line_start"), tx.squeeze(F.col("line")).alias("context"))
    return findings.join(context, ["path", "line_start"], "left")


def with_finding_id(findings: DataFrame) -> DataFrame:
    """Set ``finding_id`` from axis, rule, file and symbol or ``context``; line numbers never enter.

    Equal contexts are numbered in file order.  The window spans the equal lines of one file, which
    arrived as one cell.
    """
    anchor = F.coalesce("symbol", "context", F.lit(""))
    window = Window.partitionBy("run_id", "path", "axiom", "rule_id", "_anchor").orderBy("line_start", "line_end")
    numbered = findings.withColumn("_anchor", anchor).withColumn("_ordinal", F.row_number().over(window))
    identity = F.concat_ws("|", F.col("axiom").cast("string"), "rule_id", "path", "_anchor", F.col("_ordinal").cast("string"))
    return numbered.withColumn("finding_id", F.sha2(identity, 256)).drop("_anchor", "_ordinal")


def merge_groups(findings: DataFrame) -> DataFrame:
    """``findings`` with ``group``: ranges of one run, file and axis that overlap by more than half, transitively."""
    # Findings are small next to the corpus they were scanned from: scan once, then group.
    run = F.coalesce("run_id", F.lit("")) if "run_id" in findings.columns else F.lit("")
    findings = cut_lineage(findings.withColumn("_run", run))
    groups = intervals.overlap_groups(findings, ["_run", "path", "axiom"])
    return findings.join(groups, ["_run", "path", "axiom", "line_start", "line_end"])


GROUP = ["_run", "path", "axiom", "group"]


def merge_overlaps(findings: DataFrame) -> DataFrame:
    """One row per overlap group.

    The row is the group's first finding (by line, rule, id), with all its columns, and with the group's extent, strongest
    severity, all sources and the number of merged findings.  :func:`merged_messages` holds every message.
    """
    grouped = merge_groups(findings)
    own = [name for name in findings.columns if name not in ("line_start", "line_end", "severity", "source")]
    first = F.min_by(F.struct(*own), F.struct("line_start", "rule_id", "finding_id"))
    # Sources are words for kinds of detectors: few, whatever the number of findings.
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_set("source"))))
    merged = grouped.groupBy(*GROUP).agg(
        first.alias("first"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.max(severity_rank(F.col("severity"))).alias("rank"), sources.alias("source"), F.count(F.lit(1)).alias("merged"))
    rest = merged.select("first.*", "line_start", "line_end", _severity_name(F.col("rank")).alias("severity"), "source", "merged")
    return rest.select(*findings.columns, "merged")


def merged_messages(findings: DataFrame) -> DataFrame:
    """(path, axiom, line_start, line_end, message): every distinct message of every merged row."""
    grouped = merge_groups(findings)
    extent = grouped.groupBy(*GROUP).agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    messages = grouped.select(*GROUP, "message").distinct()
    return messages.join(extent, GROUP).drop("group", "_run")


def ordered(findings: DataFrame) -> DataFrame:
    """Total order: file, line, axis, rule, id."""
    return findings.orderBy("path", "line_start", "axiom", "rule_id", "finding_id")


def normalize_severity(findings: DataFrame) -> DataFrame:
    """Severity words of either scale as error / warning / info; unknown words become null."""
    return findings.withColumn("severity", severity_level(F.col("severity")))


def owasp_rollup(findings: DataFrame) -> DataFrame:
    """(owasp, title, findings, files, errors) for all ten categories, also at zero."""
    categories = findings.sparkSession.createDataFrame(list(OWASP.items()), "owasp string, title string")
    counts = findings.groupBy("owasp").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files"),
        F.count_if(F.col("severity") == "error").alias("errors"))
    return categories.join(counts, "owasp", "left").fillna(0, ["findings", "files", "errors"])


# Enforcement of axes that the configuration does not name.
DEFAULT_LEVEL = {1: "advisory", 2: "advisory", 3: "advisory", 4: "advisory", 5: "blocking", 6: "advisory"}


def levels(config: DataFrame) -> DataFrame:
    """(axiom, axis, level): configured level of every axis, else its default.

    ``config(axiom, level)`` says blocking, advisory or off.
    """
    defaults = config.sparkSession.createDataFrame(
        [(n, AXES[n], level) for n, level in DEFAULT_LEVEL.items()], "axiom int, axis string, default_level string")
    return (defaults.join(config.select("axiom", "level"), "axiom", "left")
            .select("axiom", "axis", F.coalesce("level", "default_level").alias("level")))


def enforce(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Findings with ``enforced_as``; findings of axes that are off are dropped."""
    active = levels(config).filter("level <> 'off'").select("axiom", F.col("level").alias("enforced_as"))
    return findings.drop("enforced_as").join(active, "axiom")


def axis_counts(findings: DataFrame) -> DataFrame:
    """(axiom, error, warning, info)."""
    return findings.groupBy("axiom").agg(*[
        F.count_if(F.col("severity") == level).alias(level) for level in ("error", "warning", "info")])


def threshold_gate(counts: DataFrame, previous: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per axis: does the count stay within ``max_count`` and its rise within ``max_delta``?

    ``counts`` and ``previous`` are (axiom, n); ``thresholds`` is (axiom, max_count, max_delta).
    """
    joined = (thresholds.join(counts.select("axiom", "n"), "axiom", "left")
              .join(previous.select("axiom", F.col("n").alias("before")), "axiom", "left")
              .fillna(0, ["n", "before"]).withColumn("delta", F.col("n") - F.col("before")))
    return joined.withColumn("passed", (F.col("n") <= F.col("max_count")) & (F.col("delta") <= F.col("max_delta")))


def gate(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Per axis: blocked when a blocking axis holds an error that is deterministic or promoted.

    ``promoted`` is an optional column of ``findings``; inferred findings otherwise only advise.
    """
    promoted = F.col("promoted") if "promoted" in findings.columns else F.lit(False)
    counts = findings.groupBy("axiom").agg(
        F.count_if((F.col("severity") == "error") & ((F.col("tier") == "deterministic") | promoted)).alias("hard_errors"),
        F.count(F.lit(1)).alias("findings"))
    return (levels(config).join(counts, "axiom", "left").fillna(0, ["hard_errors", "findings"])
            .withColumn("blocked", (F.col("level") == "blocking") & (F.col("hard_errors") > 0)))


def gate_verdict(gated: DataFrame) -> DataFrame:
    """One row: fail when any axis is blocked."""
    return gated.agg(F.when(F.bool_or("blocked"), "fail").otherwise("pass").alias("verdict"),
                     F.count_if(F.col("blocked")).alias("blocked_axes"))


def verdicts(findings: DataFrame, status: DataFrame, min_coverage: float = 1.0) -> DataFrame:
    """(axiom, axis, verdict, reason): pass, fail, inconclusive or skipped.

    A pass needs a status row (axiom, ran, coverage, reason) saying the axis ran over enough; silence is
    inconclusive.
    """
    errors = findings.filter("severity = 'error'").groupBy("axiom").agg(F.count(F.lit(1)).alias("errors"))
    joined = axis_table(findings).join(status.select("axiom", "ran", "coverage", "reason"), "axiom", "left").join(errors, "axiom", "left")
    has_errors = F.coalesce(F.col("errors"), F.lit(0)) > 0
    verdict = (F.when(F.col("ran").isNull(), "inconclusive").when(~F.col("ran"), "skipped")
               .when(has_errors, "fail").when(F.coalesce("coverage", F.lit(0.0)) < min_coverage, "inconclusive").otherwise("pass"))
    reason = (F.when(F.col("ran").isNull(), "no status").when(~F.col("ran"), F.coalesce("reason", F.lit("off")))
              .when(has_errors, "errors found").when(F.coalesce("coverage", F.lit(0.0)) < min_coverage, F.coalesce("reason", F.lit("partial coverage")))
              .otherwise("clean"))
    return joined.select("axiom", "axis", verdict.alias("verdict"), reason.alias("reason"))


def run_report(status: DataFrame) -> DataFrame:
    """(axiom, axis, ran, tier, why): what ran, what did not, and why."""
    joined = axis_table(status).join(status.select("axiom", "ran", "tier", "reason"), "axiom", "left")
    return joined.select("axiom", "axis", F.coalesce("ran", F.lit(False)).alias("ran"), F.coalesce("tier", F.lit("none")).alias("tier"),
                         F.coalesce("reason", F.when(F.col("ran"), "ran").otherwise("not configured")).alias("why"))


def diff_runs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(finding_id, state): new, persisting or fixed."""
    before = previous.select("finding_id").distinct().withColumn("was", F.lit(True))
    after = current.select("finding_id").distinct().withColumn("now", F.lit(True))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "fixed").otherwise("persisting")
    return before.join(after, "finding_id", "full_outer").select("finding_id", state.alias("state"))


def latest_dispositions(dispositions: DataFrame) -> DataFrame:
    """(finding_id, value, at): the latest disposition of each finding; history stays as it is."""
    return (dispositions.groupBy("finding_id").agg(F.max(F.struct("at", "run_id", "value")).alias("d"))
            .select("finding_id", "d.value", "d.at"))


def actionable_rate(findings: DataFrame, dispositions: DataFrame, runs: DataFrame, first: int = 25,
                    bar: float = 0.7) -> DataFrame:
    """One row: share of actionable error findings in the ``first`` runs, against the bar."""
    early = runs.orderBy("at", "run_id").limit(first).select("run_id")
    judged = (findings.filter("severity = 'error'").join(early, "run_id", "left_semi")
              .join(dispositions.select("finding_id", "value"), "finding_id"))
    rate = F.round(F.avg((F.col("value") == "actionable").cast("double")), 6)
    return judged.agg(F.count(F.lit(1)).alias("judged"), rate.alias("rate")).withColumn("passed", F.coalesce(F.col("rate") >= bar, F.lit(False)))


def noise_rate(findings: DataFrame, dispositions: DataFrame, per: list[str] = (), limit: float = 0.3) -> DataFrame:
    """Share of error and warning findings judged not actionable; noisy at or above the limit."""
    judged = findings.filter("severity in ('error', 'warning')").join(dispositions.select("finding_id", "value"), "finding_id")
    rate = F.round(F.avg((F.col("value") == "not-actionable").cast("double")), 6)
    return (judged.groupBy(*per).agg(F.count(F.lit(1)).alias("judged"), rate.alias("noise"))
            .withColumn("noisy", F.col("noise") >= limit))


def noise_trend(noise_by_detector: DataFrame) -> DataFrame:
    """(step, noise, rose): noise after each added detector; input has one row per detector."""
    window = Window.orderBy("step")
    previous = F.lag("noise").over(window)
    return noise_by_detector.select("step", "noise", F.coalesce(F.col("noise") > previous, F.lit(False)).alias("rose"))


def matched(found: Column, labels: Column, tolerance: int) -> Column:
    """Size of a maximum matching of two arrays of distinct lines, a finding and a label at most ``tolerance`` apart.

    One sweep over both in order.  Those that wait are all of one kind; one of the other kind takes the earliest that is
    near enough.  Windows are all equally wide, so the earliest is never a worse choice than a later one.
    """
    lines = lambda column, kind: F.transform(column, lambda line: F.struct(line.alias("line"), F.lit(kind).alias("kind")))
    state = F.expr("named_struct('kind', 0, 'waiting', cast(array() as array<int>), 'pairs', cast(0 as bigint))")

    def see(seen: Column, item: Column) -> Column:
        near = F.filter(seen.waiting, lambda line: line >= item.line - tolerance)
        met = (seen.kind != item.kind) & (F.size(near) > 0)
        queue = F.when(met, F.slice(near, 2, F.greatest(F.size(near), F.lit(1)))).when(
            seen.kind == item.kind, F.concat(near, F.array(item.line))).otherwise(F.array(item.line))
        return F.struct(F.when(met, seen.kind).otherwise(item.kind).alias("kind"), queue.alias("waiting"),
                        (seen.pairs + F.when(met, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("pairs"))

    both = F.array_sort(F.concat(lines(found, 1), lines(labels, 2)))
    return F.aggregate(both, state, see, lambda seen: seen.pairs)


def score_oracle(found: DataFrame, expected: DataFrame, tolerance: int = 1, by: list[str] = ("rule_id",)) -> DataFrame:
    """True and false positives, misses, precision and recall against labelled rows, one to one.

    Rows are (path, rule_id, line_start).  A finding meets one label of the same file and rule at most ``tolerance`` lines
    away, and a label one finding; as many pairs are formed as possible.  The lines of one file and rule are one row.
    """
    sides = [rows.select("path", "rule_id", F.col("line_start").cast("int").alias("line"), F.lit(kind).alias("kind")).distinct()
             for rows, kind in ((found, 1), (expected, 2))]
    lines = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("line")))
    spots = sides[0].unionByName(sides[1]).groupBy("path", "rule_id").agg(lines(1).alias("found"), lines(2).alias("labels"))
    by = list(by)
    counts = spots.select(*by, matched(F.col("found"), F.col("labels"), tolerance).alias("tp"),
                          F.size("found").alias("found"), F.size("labels").alias("labels"))
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "found", "labels")])
    return sums.select(*by, "tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("labels") - F.col("tp")).alias("fn"),
                       F.round(F.col("tp") / F.nullif("found", F.lit(0)), 6).alias("precision"),
                       F.round(F.col("tp") / F.nullif("labels", F.lit(0)), 6).alias("recall"))


def same_findings(a: DataFrame, b: DataFrame, columns: list[str] = ("finding_id", "severity", "line_start", "line_end")) -> DataFrame:
    """One row: are the two runs equal as multisets, and how many rows differ each way?

    One signed count per distinct row decides both directions in a single shuffle.
    """
    columns = list(columns)
    signed = (a.select(*columns).withColumn("_sign", F.lit(1))
              .unionByName(b.select(*columns).withColumn("_sign", F.lit(-1))))
    balance = signed.groupBy(*columns).agg(F.sum("_sign").alias("_n"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("only_a"),
        F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("only_b")
    ).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def same_verdict_class(a: DataFrame, b: DataFrame) -> DataFrame:
    """Like :func:`same_findings` on axis, severity and id only: prose and places may differ."""
    return same_findings(a, b, ["axiom", "severity", "finding_id"])


def path_signature(pack) -> Column:
    """Which path rules of a pack hold for a file, and its language if a rule asks for one.

    Two files of equal content have equal findings only if they also agree in this.
    """
    patterns = sorted({rule.path_regex for rule in pack if rule.path_regex})
    bits = [F.col("path").rlike(pattern).cast("int").cast("string") for pattern in patterns]
    lang = [F.coalesce(F.col("lang"), F.lit(""))] if any(rule.lang for rule in pack) else []
    return F.concat_ws("", F.lit(""), *bits, *lang)


def _cache_keys(files: DataFrame, pack) -> DataFrame:
    return files.select("path", content_hash(F.col("text")).alias("content_hash"), path_signature(pack).alias("signature"))


def reuse_findings(files: DataFrame, cache: DataFrame, ruleset: str, scan, pack=()) -> DataFrame:
    """Findings of a corpus where files already scanned under ``ruleset`` are not scanned again.

    ``cache`` holds (content_hash, signature, ruleset, and the finding columns but path); a scanned file without findings
    has one row with a null rule.  ``pack`` are the rules that ``scan`` runs: their path conditions make the signature.
    Only paths and hashes meet the cache; texts of files to scan are picked by path.
    """
    keys = ["content_hash", "signature"]
    keyed = cut_lineage(_cache_keys(files, pack))
    known = cache.filter(F.col("ruleset") == ruleset)
    old = keyed.join(known.select(*keys).distinct(), keys, "left_semi").select("path")
    fresh = scan(files.join(old, "path", "left_anti"))
    stored = known.filter("rule_id is not null").join(keyed, keys).drop(*keys, "ruleset")
    return (fresh.withColumn("reused", F.lit(False))
            .unionByName(stored.withColumn("reused", F.lit(True)), allowMissingColumns=True))


def cache_entries(files: DataFrame, findings: DataFrame, ruleset: str, pack=()) -> DataFrame:
    """Rows to store for :func:`reuse_findings` after a scan, one set per distinct content and signature."""
    first = _cache_keys(files, pack).groupBy("content_hash", "signature").agg(F.min("path").alias("path"))
    return first.join(findings, "path", "left").drop("path").withColumn("ruleset", F.lit(ruleset))


def dashboard(findings: DataFrame, previous: DataFrame, ran: DataFrame) -> DataFrame:
    """(axiom, axis, state, error, warning, info, total, delta): one row per axis, absent ones declared.

    ``ran(axiom)`` lists the axes that ran.
    """
    now = axis_counts(findings).withColumn("total", F.col("error") + F.col("warning") + F.col("info"))
    before = previous.groupBy("axiom").agg(F.count(F.lit(1)).alias("before"))
    joined = (axis_table(findings).join(ran.select("axiom").distinct().withColumn("ran", F.lit(True)), "axiom", "left")
              .join(now, "axiom", "left").join(before, "axiom", "left")
              .fillna(0, ["error", "warning", "info", "total", "before"]))
    return joined.select("axiom", "axis", F.when(F.col("ran"), "ran").otherwise("absent").alias("state"),
                         "error", "warning", "info", "total", (F.col("total") - F.col("before")).alias("delta"))


def latest_summary(summaries: DataFrame, key: str = "change") -> DataFrame:
    """One summary per change request: the newest run's."""
    others = [c for c in summaries.columns if c != key]
    order = F.struct("at", "run_id")
    return (summaries.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("s")).select(key, "s.*"))


def merge_inferred(deterministic: DataFrame, inferred: DataFrame) -> DataFrame:
    """Both kinds of findings, inferred ones only where no deterministic one covers the same place.

    A deterministic finding is always kept as it is; an inferred finding in its overlap group only adds
    its source and a mark.
    """
    both = deterministic.withColumn("_own", F.lit(True)).unionByName(
        inferred.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    grouped = merge_groups(both)
    covered = (grouped.groupBy(*GROUP)
               .agg(F.bool_or("_own").alias("_covered"), F.bool_or(~F.col("_own")).alias("confirmed")))
    joined = grouped.join(covered, GROUP)
    kept = joined.filter(F.col("_own") | ~F.col("_covered"))
    return (kept.withColumn("confirmed", F.col("confirmed") & F.col("_own")).drop("_own", "_covered", "group", "_run"))


def lost_deterministic(merged: DataFrame, deterministic: DataFrame) -> DataFrame:
    """Guard for merges: deterministic findings that are missing afterwards; must be empty."""
    return deterministic.join(merged.select("finding_id").distinct(), "finding_id", "left_anti")


