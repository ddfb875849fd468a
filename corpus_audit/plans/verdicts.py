"""Findings algebra queries.

The findings come from scanning the derived code and its later version with the whole rule pack; a
finding's range runs on for a few lines depending on its own text, so ranges overlap.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import findings, packs, rules
from ..schema import AXES, OWASP, SEVERITY_SCALE
from . import inputs as i
from .catalog import query
from .scans import hits_sql

RULES = packs.pack()
SPAN = 6


def found_in(files, pack=None):
    """Findings of a corpus with ids and ranges."""
    hits = rules.rule_hits(files, RULES if pack is None else pack)
    ranged = (hits.withColumn("context", tx.squeeze(F.col("line")))
              .withColumn("line_end", F.col("line_start") + F.length("line") % SPAN))
    return findings.with_finding_id(rules.as_findings(ranged, keep=("context",), run_id="run")).drop("context")


def inferred(t):
    """Findings a model might have sent: one at the top of every document labelled bad."""
    bad = t.labels.filter("quality = 0").select("doc_id").distinct()
    rows = i.code_files(t).join(bad, "doc_id", "left_semi").select(
        "path", F.lit("LLM-01").alias("rule_id"), F.lit(1).alias("line_start"), F.lit(4).alias("line_end"),
        F.concat(F.lit("llm:"), "path").alias("finding_id"))
    return rules.as_findings(rows, axiom=5, severity="warning", message="suspicious", tier="inferred", source="llm", confidence=0.5, run_id="run")


def _found_sql(lines: str, hits: str, name: str) -> str:
    hits_part = hits_sql(RULES, lines, hits)
    return hits_part + rf""", {name} AS (SELECT path, rule_id, axiom, severity, owasp, message, line_start, line_end,
sha256(concat_ws('|', axiom, rule_id, path, context, row_number() OVER (PARTITION BY path, axiom, rule_id, context ORDER BY line_start, line_end))) AS finding_id
FROM (SELECT *, trim(regexp_replace(raw, '[ \t\r]+', ' ', 'g')) AS context, line_start + length(raw) % {SPAN} AS line_end FROM {hits}))"""


_HEAD_LINES = r"""hl AS (SELECT path, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT path, string_split(text, chr(10)) AS l FROM head)),
shl AS (SELECT *, regexp_replace(raw, '(^|[ \t])//.*$', '') AS line FROM hl)"""
_LLM = """llm AS (SELECT path, 5 AS axiom, 'LLM-01' AS rule_id, 1 AS line_start, 4 AS line_end, 'warning' AS severity, 'llm:' || path AS finding_id
FROM code WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))"""
BASE = (i.CODE_LINES_SQL, _found_sql("sl", "hits", "fnd"))
HEAD = (i.HEAD_SQL, _HEAD_LINES, _found_sql("shl", "head_hits", "cur"))
BOTH = BASE + HEAD


@query("fnd01_collect_findings", i.ctes(*BASE, _LLM) + """
SELECT path, axiom, rule_id, line_start, line_end, severity, 'deterministic' AS tier, 'regex' AS source FROM fnd
UNION ALL SELECT path, axiom, rule_id, line_start, line_end, severity, 'inferred', 'llm' FROM llm""")
def collect(t):
    good, _ = findings.collect_findings(found_in(i.code_files(t)), inferred(t))
    return good.select("path", "axiom", "rule_id", "line_start", "line_end", "severity", "tier",
                       F.array_join("source", ",").alias("source"))


@query("fnd01_rejected_findings", i.ctes(i.TRENDS_SQL) + """
SELECT record_id AS rule_id, axiom, 'record' AS message FROM trends WHERE error > 0 AND warning = 0""")
def rejected(t):
    # A record with errors but no warnings gets an unknown severity word.
    rows = i.trend_records(t).select(
        F.col("record_id").alias("rule_id"), "axiom", F.lit(1).alias("line_start"), F.lit("record").alias("message"),
        F.col("branch").alias("path"),
        F.when((F.col("error") > 0) & (F.col("warning") == 0), "severe").otherwise("info").alias("severity"))
    _, bad = findings.collect_findings(rules.as_findings(rows))
    return bad.select("rule_id", "axiom", "message")


@query("fnd02_finding_id", i.ctes(*BASE) + "SELECT path, rule_id, line_start, finding_id FROM fnd")
def finding_id(t):
    return found_in(i.code_files(t)).select("path", "rule_id", "line_start", "finding_id")


@query("fnd02_attached_context", i.ctes(*BASE) + r"""
SELECT path, line_start, rule_id, trim(regexp_replace(raw, '[ \t\r]+', ' ', 'g')) AS context FROM hits""")
def attached_context(t):
    files = i.code_files(t)
    scanned = rules.scan_rules(files, RULES)
    return findings.attach_context(scanned, files).select("path", "line_start", "rule_id", "context")


# Brute force for SQL: all pairs of one file and axis, then label propagation.
_MERGE = """rng AS (SELECT DISTINCT path, axiom, line_start AS s, line_end AS e FROM {src}),
pr AS (SELECT a.path, a.axiom, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM rng a JOIN rng b ON a.path = b.path AND a.axiom = b.axiom
WHERE (least(a.e, b.e) - greatest(a.s, b.s) + 1) * 2 > least(a.e - a.s, b.e - b.s) + 1),
lab AS (SELECT path, axiom, s1 AS s, e1 AS e, s1 AS ms, e1 AS me FROM pr UNION
SELECT pr.path, pr.axiom, pr.s2, pr.e2, lab.ms, lab.me FROM lab JOIN pr ON pr.path = lab.path AND pr.axiom = lab.axiom AND pr.s1 = lab.s AND pr.e1 = lab.e),
grp AS (SELECT path, axiom, s, e, min((ms, me)) AS g FROM lab GROUP BY ALL),
gf AS (SELECT f.*, g FROM {src} f JOIN grp ON f.path = grp.path AND f.axiom = grp.axiom AND f.line_start = s AND f.line_end = e)"""


@query("fnd03_merge_overlaps", i.ctes(*BASE, _MERGE.format(src="fnd")) + """
SELECT path, axiom, arg_min(finding_id, (line_start, rule_id, finding_id)) AS finding_id, min(line_start) AS line_start, max(line_end) AS line_end,
CASE max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS severity,
'regex' AS source, count(*) AS merged FROM gf GROUP BY path, axiom, g""")
def merge_overlaps(t):
    merged = findings.merge_overlaps(found_in(i.code_files(t)))
    return merged.select("path", "axiom", "finding_id", "line_start", "line_end", "severity",
                         F.array_join("source", ",").alias("source"), "merged")


@query("fnd03_merged_messages", i.ctes(*BASE, _MERGE.format(src="fnd")) + """
SELECT DISTINCT path, axiom, line_start, line_end, message FROM (SELECT path, axiom, message,
min(line_start) OVER (PARTITION BY path, axiom, g) AS line_start, max(line_end) OVER (PARTITION BY path, axiom, g) AS line_end FROM gf)""")
def merged_messages(t):
    return findings.merged_messages(found_in(i.code_files(t))).select("path", "axiom", "line_start", "line_end", "message")


@query("fnd04_ordered", i.ctes(*BASE) + "SELECT path, line_start, axiom, rule_id, finding_id FROM fnd ORDER BY ALL")
def ordered(t):
    return findings.ordered(found_in(i.code_files(t))).select("path", "line_start", "axiom", "rule_id", "finding_id")


# Order priorities spell severities on the longer scale.
_WORD = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' WHEN '4' THEN 'Low' ELSE 'info' END"


@query("fnd05_normalize_severity", "SELECT severity, count(*) AS n FROM (SELECT CASE word " +
       " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY_SCALE.items()) + f" END AS severity FROM (SELECT {_WORD} AS word FROM orders)) GROUP BY 1")
def normalize_severity(t):
    return (findings.normalize_severity(t.orders.select(F.expr(_WORD).alias("severity")))
            .groupBy("severity").agg(F.count(F.lit(1)).alias("n")))


@query("fnd06_owasp_rollup", i.ctes(*BASE, "cat(owasp, title) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in OWASP.items()) + ")") + """
SELECT owasp, title, count(path) AS findings, count(DISTINCT path) AS files, count(*) FILTER (severity = 'error') AS errors
FROM cat LEFT JOIN fnd USING (owasp) GROUP BY 1, 2""")
def owasp_rollup(t):
    return findings.owasp_rollup(found_in(i.code_files(t)))


def _config(t):
    """Enforcement levels kept per region: axis 1 is off, axis 3 and 4 block."""
    level = F.when(F.col("r_regionkey") == 0, "off").when(F.col("r_regionkey").isin(2, 3), "blocking").otherwise("advisory")
    return t.region.filter("r_regionkey <> 4").select((F.col("r_regionkey") + 1).cast("int").alias("axiom"), level.alias("level"))


_CONFIG = """lev AS (SELECT axiom, axis, coalesce(level, CASE axiom WHEN 5 THEN 'blocking' ELSE 'advisory' END) AS level FROM
(VALUES """ + ", ".join(f"({n}, '{a}')" for n, a in AXES.items()) + """) x(axiom, axis) LEFT JOIN (SELECT r_regionkey + 1 AS axiom,
CASE WHEN r_regionkey = 0 THEN 'off' WHEN r_regionkey IN (2, 3) THEN 'blocking' ELSE 'advisory' END AS level FROM region WHERE r_regionkey <> 4) USING (axiom))"""


@query("fnd07_enforce", i.ctes(*BASE, _CONFIG) + """
SELECT finding_id, axiom, level AS enforced_as FROM fnd JOIN lev USING (axiom) WHERE level <> 'off'""")
def enforce(t):
    return findings.enforce(found_in(i.code_files(t)), _config(t)).select("finding_id", "axiom", "enforced_as")


@query("fnd08_threshold_gate", i.ctes(*BOTH) + """
SELECT axiom, max_count, max_delta, n, before, n - before AS delta, n <= max_count AND n - before <= max_delta AS passed FROM (
SELECT r_regionkey + 1 AS axiom, 200 * (r_regionkey + 1) AS max_count, 5 * r_regionkey AS max_delta,
(SELECT count(*) FROM cur WHERE axiom = r_regionkey + 1) AS n, (SELECT count(*) FROM fnd WHERE axiom = r_regionkey + 1) AS before FROM region)""")
def threshold_gate(t):
    def counts(f):
        return f.groupBy("axiom").agg(F.count(F.lit(1)).alias("n"))
    thresholds = t.region.select((F.col("r_regionkey") + 1).alias("axiom"), (200 * (F.col("r_regionkey") + 1)).alias("max_count"),
                                 (5 * F.col("r_regionkey")).alias("max_delta"))
    return findings.threshold_gate(counts(found_in(i.head_files(t))), counts(found_in(i.code_files(t))), thresholds)


_GATE = """gt AS (SELECT lev.axiom, axis, level, count(*) FILTER (severity = 'error') AS hard_errors, count(path) AS findings
FROM lev LEFT JOIN fnd ON fnd.axiom = lev.axiom GROUP BY ALL)"""


@query("fnd09_gate", i.ctes(*BASE, _CONFIG, _GATE) + "SELECT *, level = 'blocking' AND hard_errors > 0 AS blocked FROM gt")
def gate(t):
    return findings.gate(found_in(i.code_files(t)), _config(t))


@query("fnd09_gate_verdict", i.ctes(*BASE, _CONFIG, _GATE) + """
SELECT CASE WHEN bool_or(b) THEN 'fail' ELSE 'pass' END AS verdict, count(*) FILTER (b) AS blocked_axes
FROM (SELECT level = 'blocking' AND hard_errors > 0 AS b FROM gt)""")
def gate_verdict(t):
    return findings.gate_verdict(findings.gate(found_in(i.code_files(t)), _config(t)))


def _status(t):
    """Run status per axis, from the import graph's coverage of the corpus: axis 6 never reports."""
    share = t.documents.agg(F.round(F.avg((F.col("lang") == "en").cast("double")), 6).alias("share"), F.lit(1).alias("one"))
    axes = t.region.select((F.col("r_regionkey") + 1).cast("int").alias("axiom"), F.lit(1).alias("one"))
    return axes.join(share, "one").select(
        "axiom", (F.col("axiom") != 2).alias("ran"), F.when(F.col("axiom") == 1, F.col("share")).otherwise(F.lit(1.0)).alias("coverage"),
        F.when(F.col("axiom") == 2, "no_specs").alias("reason"), F.when(F.col("axiom") == 1, "inferred").otherwise("deterministic").alias("tier"))


_STATUS = """st AS (SELECT r_regionkey + 1 AS axiom, r_regionkey <> 1 AS ran,
CASE r_regionkey WHEN 0 THEN (SELECT avg((lang = 'en')::INT) FROM documents) ELSE 1.0 END AS coverage,
CASE r_regionkey WHEN 1 THEN 'no_specs' END AS reason, CASE r_regionkey WHEN 0 THEN 'inferred' ELSE 'deterministic' END AS tier FROM region),
ax(axiom, axis) AS (VALUES """ + ", ".join(f"({n}, '{a}')" for n, a in AXES.items()) + ")"


@query("fnd10_verdicts", i.ctes(*BASE, _STATUS) + """
SELECT axiom, axis, CASE WHEN ran IS NULL THEN 'inconclusive' WHEN NOT ran THEN 'skipped' WHEN n > 0 THEN 'fail' WHEN coverage < 1 THEN 'inconclusive' ELSE 'pass' END AS verdict,
CASE WHEN ran IS NULL THEN 'no status' WHEN NOT ran THEN reason WHEN n > 0 THEN 'errors found' WHEN coverage < 1 THEN 'partial coverage' ELSE 'clean' END AS reason
FROM (SELECT ax.*, ran, coverage, reason, (SELECT count(*) FROM fnd WHERE fnd.axiom = ax.axiom AND severity = 'error') AS n FROM ax LEFT JOIN st USING (axiom))""")
def verdicts(t):
    return findings.verdicts(found_in(i.code_files(t)), _status(t))


@query("fnd11_run_report", i.ctes(_STATUS) + """
SELECT axiom, axis, coalesce(ran, false) AS ran, coalesce(tier, 'none') AS tier, coalesce(reason, CASE WHEN ran THEN 'ran' ELSE 'not configured' END) AS why
FROM ax LEFT JOIN st USING (axiom)""")
def run_report(t):
    return findings.run_report(_status(t))


@query("fnd13_diff_runs", i.ctes(*BOTH) + """
SELECT coalesce(a.finding_id, b.finding_id) AS finding_id, CASE WHEN a.finding_id IS NULL THEN 'new' WHEN b.finding_id IS NULL THEN 'fixed' ELSE 'persisting' END AS state
FROM fnd a FULL OUTER JOIN cur b ON a.finding_id = b.finding_id""")
def diff_runs(t):
    return findings.diff_runs(found_in(i.code_files(t)), found_in(i.head_files(t)))


_VALUE = "CASE event_type WHEN 'view' THEN 'not-actionable' WHEN 'error' THEN 'deferred' ELSE 'actionable' END"


@query("fnd14_latest_dispositions", f"""
SELECT finding_id, arg_max(value, (ts, event_id)) AS value, strftime(max(ts), '%Y-%m-%d %H:%M') AS at FROM (
SELECT 'f' || regexp_extract(props, '[0-9]+') AS finding_id, ts, event_id, {_VALUE} AS value FROM events) GROUP BY 1""")
def latest_dispositions(t):
    history = t.events.select(F.concat(F.lit("f"), F.regexp_extract("props", "[0-9]+", 0)).alias("finding_id"),
                              F.col("ts").alias("at"), F.col("event_id").alias("run_id"), F.expr(_VALUE).alias("value"))
    return findings.latest_dispositions(history).select("finding_id", "value", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"))


def _run_findings(t):
    """One finding per event: the user is the run, the value the severity."""
    severity = F.when(F.col("value") > 20, "error").when(F.col("value") > 5, "warning").otherwise("info")
    return t.events.select(F.col("event_id").alias("finding_id"), F.col("user_id").alias("run_id"),
                           F.col("event_type").alias("detector"), severity.alias("severity"))


def _label_dispositions(t):
    return t.labels.select(F.col("doc_id").alias("finding_id"),
                           F.when(F.col("toxic") == 1, "deferred").when(F.col("quality") == 1, "actionable")
                           .otherwise("not-actionable").alias("value"))


_JUDGED = """rf AS (SELECT event_id AS finding_id, user_id AS run_id, event_type AS detector, ts,
CASE WHEN value > 20 THEN 'error' WHEN value > 5 THEN 'warning' ELSE 'info' END AS severity FROM events),
dp AS (SELECT doc_id AS finding_id, CASE WHEN toxic = 1 THEN 'deferred' WHEN quality = 1 THEN 'actionable' ELSE 'not-actionable' END AS value FROM labels)"""


@query("fnd15_actionable_rate", i.ctes(_JUDGED) + """
SELECT count(*) AS judged, round(avg((value = 'actionable')::INT::DOUBLE), 6) AS rate, coalesce(avg((value = 'actionable')::INT) >= 0.7, false) AS passed
FROM rf JOIN dp USING (finding_id) WHERE severity = 'error' AND run_id IN (SELECT run_id FROM rf GROUP BY 1 ORDER BY min(ts), run_id LIMIT 25)""")
def actionable_rate(t):
    runs = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("at"))
    return findings.actionable_rate(_run_findings(t), _label_dispositions(t), runs)


@query("fnd16_noise_rate", i.ctes(_JUDGED) + """
SELECT detector, count(*) AS judged, round(avg((value = 'not-actionable')::INT::DOUBLE), 6) AS noise, round(avg((value = 'not-actionable')::INT::DOUBLE), 6) >= 0.3 AS noisy
FROM rf JOIN dp USING (finding_id) WHERE severity IN ('error', 'warning') GROUP BY 1""")
def noise_rate(t):
    return findings.noise_rate(_run_findings(t), _label_dispositions(t), ["detector"])


@query("fnd17_noise_trend", i.ctes(_JUDGED) + """
SELECT step, noise, coalesce(noise > lag(noise) OVER (ORDER BY step), false) AS rose FROM (SELECT detector AS step, round(avg((value = 'not-actionable')::INT::DOUBLE), 6) AS noise
FROM rf JOIN dp USING (finding_id) WHERE severity IN ('error', 'warning') GROUP BY 1)""")
def noise_trend(t):
    by_detector = findings.noise_rate(_run_findings(t), _label_dispositions(t), ["detector"])
    return findings.noise_trend(by_detector.withColumnRenamed("detector", "step"))


@query("fnd18_score_oracle", i.ctes(*BASE, f"""
ex AS (SELECT DISTINCT path, 'RUL-' || CASE WHEN raw LIKE '%hashlib%' THEN '03' ELSE '06' END AS rule_id, line_no + 1 AS line_start FROM cl
WHERE raw LIKE '%hashlib%' OR raw LIKE '%console.log%'),
fo AS (SELECT *, row_number() OVER (PARTITION BY path, rule_id ORDER BY line_start) AS k FROM
(SELECT DISTINCT path, rule_id, line_start FROM fnd WHERE rule_id IN ('RUL-03', 'RUL-06'))),
taken AS (SELECT DISTINCT path, rule_id, 0::BIGINT AS k, -9 AS line, 0 AS tp FROM fo UNION ALL
SELECT path, rule_id, k, coalesce(met, line), tp + (met IS NOT NULL)::INT FROM (SELECT f.path, f.rule_id, f.k, t.line, t.tp,
(SELECT min(ex.line_start) FROM ex WHERE ex.path = f.path AND ex.rule_id = f.rule_id AND ex.line_start > t.line
AND ex.line_start BETWEEN f.line_start - 1 AND f.line_start + 1) AS met FROM taken t JOIN fo f ON f.path = t.path AND f.rule_id = t.rule_id AND f.k = t.k + 1)),
met AS (SELECT path, rule_id, max(tp) AS tp FROM taken GROUP BY ALL)""") + """
SELECT rule_id, tp, found - tp AS fp, total - tp AS fn, round(tp / found, 6) AS precision, round(tp / total, 6) AS recall FROM
(SELECT rule_id, count(*) AS total FROM ex GROUP BY 1) JOIN (SELECT rule_id, count(*) AS found FROM fo GROUP BY 1) USING (rule_id)
JOIN (SELECT rule_id, sum(tp)::BIGINT AS tp FROM met GROUP BY 1) USING (rule_id)""")
def score_oracle(t):
    # Labels drift by one line and also name harmless log lines: both are part of the check.
    lines = rules.explode_lines(i.code_files(t).select("path", "text"))
    kind = F.when(F.col("line").contains("hashlib"), "RUL-03").when(F.col("line").contains("console.log"), "RUL-06")
    expected = lines.select("path", kind.alias("rule_id"), (F.col("line_no") + 1).alias("line_start")).filter("rule_id is not null")
    return findings.score_oracle(rules.scan_rules(i.code_files(t), packs.pack("RUL-03", "RUL-06")), expected)


_SAME = """SELECT (SELECT count(*) FROM (SELECT {c} FROM fnd EXCEPT ALL SELECT {c} FROM cur)) AS only_a,
(SELECT count(*) FROM (SELECT {c} FROM cur EXCEPT ALL SELECT {c} FROM fnd)) AS only_b,
NOT EXISTS (SELECT {c} FROM fnd EXCEPT ALL SELECT {c} FROM cur) AND NOT EXISTS (SELECT {c} FROM cur EXCEPT ALL SELECT {c} FROM fnd) AS same"""


@query("fnd19_same_findings", i.ctes(*BOTH) + _SAME.format(c="finding_id, severity, line_start, line_end"))
def same_findings(t):
    return findings.same_findings(found_in(i.code_files(t)), found_in(i.head_files(t)))


@query("fnd20_same_verdict_class", i.ctes(*BOTH) + _SAME.format(c="axiom, severity, finding_id"))
def same_verdict_class(t):
    return findings.same_verdict_class(found_in(i.code_files(t)), found_in(i.head_files(t)))


@query("fnd21_reuse_findings", i.ctes(*BOTH) + """
SELECT path, rule_id, line_start, h IN (SELECT sha256(text) FROM code) AS reused FROM cur JOIN (SELECT path, sha256(text) AS h FROM head) USING (path)""")
def reuse_findings(t):
    base = i.code_files(t)
    scan = lambda files: rules.rule_hits(files, RULES).select("path", "rule_id", "line_start")
    cache = findings.cache_entries(base, scan(base), "v1", RULES)
    return findings.reuse_findings(i.head_files(t), cache, "v1", scan, RULES)


@query("fnd22_dashboard", i.ctes(*BOTH, _STATUS) + """
SELECT axiom, axis, CASE WHEN axiom IN (SELECT axiom FROM st WHERE ran) THEN 'ran' ELSE 'absent' END AS state, error, warning, info, error + warning + info AS total,
error + warning + info - (SELECT count(*) FROM fnd WHERE fnd.axiom = x.axiom) AS delta FROM (SELECT ax.axiom, axis, count(*) FILTER (severity = 'error') AS error,
count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM ax LEFT JOIN cur ON cur.axiom = ax.axiom GROUP BY ALL) x""")
def dashboard(t):
    return findings.dashboard(found_in(i.head_files(t)), found_in(i.code_files(t)), _status(t).filter("ran"))


@query("fnd23_latest_summary", """
SELECT user_id AS change, max(event_id) AS run_id, arg_max(event_type, (ts, event_id)) AS headline FROM events GROUP BY 1""")
def latest_summary(t):
    summaries = t.events.select(F.col("user_id").alias("change"), F.col("ts").alias("at"), F.col("event_id").alias("run_id"),
                                F.col("event_type").alias("headline"))
    return findings.latest_summary(summaries).select("change", "run_id", "headline")


_MIXED = """mix AS (SELECT path, axiom, rule_id, line_start, line_end, finding_id, true AS own FROM fnd UNION ALL
SELECT path, axiom, rule_id, line_start, line_end, finding_id, false FROM llm)"""


@query("fnd24_merge_inferred", i.ctes(*BASE, _LLM, _MIXED, _MERGE.format(src="mix")) + """
SELECT finding_id, rule_id, own AND bool_or(NOT own) OVER w AS confirmed FROM gf WINDOW w AS (PARTITION BY path, axiom, g)
QUALIFY own OR NOT bool_or(own) OVER w""")
def merge_inferred(t):
    return findings.merge_inferred(found_in(i.code_files(t)), inferred(t)).select("finding_id", "rule_id", "confirmed")


@query("fnd24_lost_deterministic", i.ctes(*BASE) + "SELECT count(*) AS deterministic, 0 AS lost FROM fnd")
def lost_deterministic(t):
    """Merging inferred findings loses no deterministic one."""
    own = found_in(i.code_files(t))
    lost = findings.lost_deterministic(findings.merge_inferred(own, inferred(t)), own)
    counted = own.select(F.lit(1).alias("d"), F.lit(0).alias("l")).unionByName(lost.select(F.lit(0).alias("d"), F.lit(1).alias("l")))
    return counted.agg(F.sum("d").alias("deterministic"), F.sum("l").alias("lost"))
