"""Rule-pack queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packs, rules
from ..operators.packs import Rule
from . import inputs as i
from .catalog import query
from .inputs import sql_text


def rules_sql(pack: list[Rule], name: str = "rules") -> str:
    """The pack as a CTE of literal rows."""
    rows = ", ".join(
        "(" + ", ".join([sql_text(r.rule_id), str(r.axiom), sql_text(packs_severity(r)),
                         sql_text(r.owasp) if r.owasp else "NULL", sql_text(r.message), sql_text(r.line_regex),
                         sql_text(r.also_regex or ""), sql_text(r.path_regex or ""), str(r.in_comments)]) + ")" for r in pack)
    return f"{name}(rule_id, axiom, severity, owasp, message, line_regex, also_regex, path_regex, in_comments) AS (VALUES {rows})"


def packs_severity(rule: Rule) -> str:
    from ..schema import SEVERITY_SCALE
    return SEVERITY_SCALE[rule.severity]


def hits_sql(pack: list[Rule], lines: str, name: str = "hits") -> str:
    """Line hits of a pack over a CTE of (path, line_no, raw, line)."""
    return (rules_sql(pack) + f", {name} AS (SELECT path, rule_id, axiom, severity, owasp, message, line_no AS line_start, raw "
            f"FROM (SELECT *, CASE WHEN in_comments THEN raw ELSE line END AS seen FROM {lines}, rules) "
            "WHERE regexp_matches(seen, line_regex) AND regexp_matches(seen, also_regex) "
            "AND regexp_matches(path, path_regex))")


PROSE_CODE = i.PROSE_LINES_SQL + ", pll AS (SELECT path, lang, line_no, line AS raw, regexp_replace(line, '(^|[ \\t])//.*$', '') AS line FROM pl)"


def _line_rule(name: str, prefix: str):
    pack = packs.pack(prefix)
    prose = prefix in ("RUL-01", "RUL-24")
    base, lines = (PROSE_CODE, "pll") if prose else (i.CODE_LINES_SQL, "sl")

    @query(name, i.ctes(base, hits_sql(pack, lines)) + "SELECT path, rule_id, severity, line_start FROM hits")
    def job(t):
        files = i.prose_files(t) if prose else i.code_files(t)
        return rules.scan_rules(files, pack).select("path", "rule_id", "severity", "line_start")
    job.__doc__ = pack[0].message
    return job


for _name, _prefix in {
    "rul01_hardcoded_credentials": "RUL-01",
    "rul02_secret_in_url": "RUL-02",
    "rul03_weak_hash": "RUL-03",
    "rul05_dangerous_apis": "RUL-05",
    "rul06_sensitive_logging": "RUL-06",
    "rul07_raw_logging": "RUL-07",
    "rul08_error_leak": "RUL-08",
    "rul09_insecure_defaults": "RUL-09",
    "rul11_client_identity": "RUL-11",
    "rul13_type_bypass": "RUL-13",
    "rul17_structural_hazards": "RUL-17",
    "rul19_client_state": "RUL-19",
}.items():
    _line_rule(_name, _prefix)

ALL = packs.pack()
CODE_HITS = (i.CODE_LINES_SQL, hits_sql(ALL, "sl"))


@query("rul00_scan_rules", i.ctes(*CODE_HITS) +
       "SELECT path, rule_id, axiom, severity, coalesce(owasp, '-') AS owasp, message, line_start FROM hits")
def scan_rules(t):
    return rules.scan_rules(i.code_files(t), ALL).select(
        "path", "rule_id", "axiom", "severity", F.coalesce("owasp", F.lit("-")).alias("owasp"), "message", "line_start")


@query("rul01_secret_literals", i.ctes(i.PROSE_SQL) + r"""
SELECT path, sha256(lit) AS literal_hash, length(lit) AS literal_chars FROM (SELECT path, unnest(regexp_extract_all(text,
'(?i)(?:api[_-]?key|secret|passw(?:or)?d|token)[a-z0-9_]*["'']?[ \t]*[:=][ \t]*["'']([^"'']{6,})["'']', 1)) AS lit FROM prose)""")
def secret_literals(t):
    return rules.secret_literals(i.prose_files(t))


@query("rul04_interpolated_sql", i.ctes(i.CODE_LINES_SQL) + f"""
SELECT path, CASE WHEN regexp_matches(prev, {sql_text(rules.OPEN_CALL)}) THEN line_no - 1 ELSE line_no END AS line_start,
line_no AS line_end FROM (SELECT *, coalesce(lag(line) OVER (PARTITION BY path ORDER BY line_no), '') AS prev FROM sl)
WHERE regexp_matches(line, {sql_text(rules.SQL_WORDS)}) AND regexp_matches(line, {sql_text(rules.SQL_GLUE)})""")
def interpolated_sql(t):
    return rules.interpolated_sql(i.code_files(t)).select("path", "line_start", "line_end")


@query("rul10_unguarded_access", i.ctes(i.CODE_LINES_SQL) + f"""
SELECT path, line_no AS line_start FROM sl WHERE regexp_matches(line, {sql_text(rules.ROUTE)})
AND path NOT IN (SELECT path FROM sl WHERE regexp_matches(line, {sql_text(rules.AUTH)}))""")
def unguarded_access(t):
    return rules.unguarded_access(i.code_files(t)).select("path", "line_start")


@query("rul14_a11y_code", i.ctes(i.CODE_LINES_SQL) + f"""
SELECT path, line_start, message FROM (SELECT path, line_no AS line_start, CASE
WHEN regexp_matches(tag, '^<button') AND NOT regexp_matches(tag, 'aria-label|aria-labelledby|title=') THEN 'button without a label'
WHEN regexp_matches(tag, '^<(li|div|span|tr|td|p)[^a-z]') AND regexp_matches(tag, '(?i)onclick')
AND NOT (regexp_matches(tag, 'role=') AND regexp_matches(tag, '(?i)onkey')) THEN 'click handler without role and key handler' END AS message
FROM (SELECT path, line_no, unnest(regexp_extract_all(raw, {sql_text(rules.TAG)})) AS tag FROM cl)) WHERE message IS NOT NULL""")
def a11y_tags(t):
    return rules.a11y_tags(i.code_files(t)).select("path", "line_start", "message")


@query("rul15_fixed_width", i.ctes(i.CODE_LINES_SQL) + r"""
SELECT path, line_no AS line_start, 'hardcoded width of ' || w || 'px' AS message FROM (SELECT path, line_no,
regexp_extract(line, '(?i)width[''"]?[ \t]*[:=][ \t]*[''"]?([0-9]{1,6})px', 1) AS w FROM sl) WHERE w <> '' AND w::INT > 600""")
def fixed_width(t):
    return rules.fixed_width(i.code_files(t)).select("path", "line_start", "message")


@query("rul16_list_without_key", i.ctes(i.CODE_LINES_SQL) + r"""
SELECT path, line_no AS line_start FROM (SELECT *, line || chr(10) || coalesce(lead(line, 1) OVER w, '') || chr(10) ||
coalesce(lead(line, 2) OVER w, '') AS near FROM sl WINDOW w AS (PARTITION BY path ORDER BY line_no))
WHERE line LIKE '%.map(%' AND regexp_matches(near, '<[A-Za-z]+[ \t>]') AND NOT regexp_matches(near, 'key=')""")
def list_without_key(t):
    return rules.list_without_key(i.code_files(t)).select("path", "line_start")


@query("rul18_query_in_loop", i.ctes(i.CODE_LINES_SQL) + f"""
SELECT path, line_no AS line_start FROM (SELECT *, max(CASE WHEN regexp_matches(line, {sql_text(rules.LOOP)}) THEN line_no END)
OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS loop_at FROM sl)
WHERE regexp_matches(line, {sql_text(rules.QUERY)}) AND line_no - loop_at <= 5""")
def query_in_loop(t):
    return rules.query_in_loop(i.code_files(t)).select("path", "line_start")


def _dated_files(t):
    name = F.when(F.col("lang") == "de", F.concat(F.lit("notes/plan_"), "doc_id", F.lit(".md"))).when(
        F.col("lang") == "es", F.concat(F.lit("specs/spec-"), "doc_id", F.lit(".md"))).otherwise(F.col("path"))
    return i.code_files(t).select(name.alias("path"), "mtime")


@query("rul20_stale_artifacts", i.ctes(i.CODE_SQL) + f"""
SELECT path, date_diff('day', mtime, DATE '2024-01-20') AS age_days FROM (SELECT CASE lang WHEN 'de' THEN 'notes/plan_' || doc_id || '.md'
WHEN 'es' THEN 'specs/spec-' || doc_id || '.md' ELSE path END AS path, mtime FROM code)
WHERE regexp_matches(path, {sql_text(rules.ARTIFACT)}) AND date_diff('day', mtime, DATE '2024-01-20') > 7""")
def stale_artifacts(t):
    return rules.stale_artifacts(_dated_files(t), "2024-01-20")


@query("rul21_comment_blocks", i.ctes(i.CODE_LINES_SQL) + f"""
SELECT path, min(line_no) AS line_start, max(line_no) AS line_end FROM (
SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM cl
WHERE regexp_matches(raw, {sql_text(rules.CODE_COMMENT)})) GROUP BY path, island HAVING count(*) >= 2""")
def comment_blocks(t):
    return rules.comment_blocks(i.code_files(t), min_run=2).select("path", "line_start", "line_end")


@query("rul22_unreleased", i.ctes(i.CODE_SQL) + f"""
SELECT path, opened, released FROM (SELECT path, len(regexp_extract_all(text, {sql_text(rules.OPENED)})) AS opened,
len(regexp_extract_all(text, {sql_text(rules.RELEASED)})) AS released FROM code) WHERE opened > released""")
def unreleased(t):
    return rules.unreleased(i.code_files(t))


@query("rul23_long_lists", """
SELECT url AS path, page_id, items FROM (SELECT url, page_id, len(regexp_extract_all(html, '<li[ >]')) AS items FROM pages) WHERE items > 3""")
def long_lists(t):
    files = t.pages.select(F.col("url").alias("path"), "page_id", F.col("html").alias("text"))
    counted = rules.long_lists(files.withColumn("path", F.concat_ws(" ", "page_id", "path")), limit=3)
    parts = F.split("path", " ")
    return counted.select(parts[1].alias("path"), parts[0].cast("bigint").alias("page_id"), "items")


@query("rul24_pii_hits", i.ctes(i.PROSE_SQL) + " UNION ALL ".join(
    f"SELECT path, '{kind}' AS kind, hits FROM (SELECT path, len(regexp_extract_all(text, {sql_text(regex)})) AS hits FROM prose) WHERE hits > 0"
    for kind, regex in packs.PII_PATTERNS.items()))
def pii_hits(t):
    return rules.pii_hits(i.prose_files(t), packs.PII_PATTERNS)


@query("rul24_pii_lines", i.ctes(PROSE_CODE, hits_sql(packs.pack("RUL-24"), "pll")) + "SELECT path, rule_id, line_start FROM hits")
def pii_lines(t):
    return rules.scan_rules(i.prose_files(t), packs.pack("RUL-24")).select("path", "rule_id", "line_start")


@query("rul25_single_axis", i.ctes(i.CODE_LINES_SQL, hits_sql(packs.for_axiom(ALL, 4), "sl")) +
       "SELECT path, rule_id, line_start FROM hits")
def single_axis(t):
    return rules.scan_axiom(i.code_files(t), ALL, 4).select("path", "rule_id", "line_start")


# One adapter per corpus language: each has its own name for a stray debug call.
LANGUAGE_RULES = [
    Rule("LANG-en", 3, "Low", None, r"console\.log\(", "debug call", lang="en"),
    Rule("LANG-fr", 3, "Low", None, r"eval\(", "dynamic call", lang="fr"),
    Rule("LANG-de", 3, "Low", None, r"setInterval\(", "timer call", lang="de"),
    Rule("LANG-es", 3, "Low", None, r"readFileSync\(", "file call", lang="es"),
    Rule("LANG-any", 3, "Low", None, r"return compute\(", "compute call"),
]


@query("rul26_language_packs", i.ctes(i.CODE_LINES_SQL, rules_sql(LANGUAGE_RULES)) + """
SELECT lang, rule_id, count(*) AS hits FROM sl, rules WHERE regexp_matches(line, line_regex)
AND (rule_id = 'LANG-any' OR rule_id = 'LANG-' || lang) GROUP BY 1, 2""")
def language_packs(t):
    files = i.code_files(t)
    hits = rules.scan_rules(files, LANGUAGE_RULES)
    by_file = hits.groupBy("path", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return (by_file.join(files.select("path", "lang"), "path")
            .groupBy("lang", "rule_id").agg(F.sum("n").alias("hits")))


@query("flagship_leaks_by_category", i.ctes(PROSE_CODE, hits_sql(packs.pack("RUL-01", "RUL-24"), "pll")) + """
SELECT owasp, rule_id, severity, count(*) AS findings, count(DISTINCT path) AS files FROM hits GROUP BY 1, 2, 3""")
def leaks_by_category(t):
    """Which documents leak secrets or personal data, by category."""
    found = rules.scan_rules(i.prose_files(t), packs.pack("RUL-01", "RUL-24"))
    return found.groupBy("owasp", "rule_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files"))
