"""Rule scans: predicates over the lines of a corpus.

Input is ``files(path, text[, lang, ...])`` with one row per file.  Every scan here is a narrow
transformation of that row, so a scan costs one read of the corpus and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import FINDING, SEVERITY_SCALE
from .packs import Rule


def severity_level(column: Column) -> Column:
    """Any published severity word as error / warning / info."""
    pairs = [item for key, level in SEVERITY_SCALE.items() for item in (F.lit(key), F.lit(level))]
    return F.element_at(F.create_map(*pairs), column)


def as_findings(df: DataFrame, keep: tuple[str, ...] = (), **fixed) -> DataFrame:
    """Fill ``df`` up to the canonical finding record.

    ``fixed`` gives constant fields, ``keep`` further columns of ``df`` to carry along.
    """
    defaults = {"tier": "deterministic", "confidence": 1.0}
    columns = []
    for field in FINDING.fields:
        if field.name in df.columns:
            column = F.col(field.name)
        elif field.name == "source":
            column = F.array(F.lit(fixed.get("source", "regex")))
        elif field.name == "line_end" and "line_start" in df.columns:
            column = F.col("line_start")
        else:
            column = F.lit(fixed.get(field.name, defaults.get(field.name)))
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns, *keep)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    others = [c for c in files.columns if c != "text"]
    return (files.select(*others, F.posexplode(tx.lines_of(F.col("text"))).alias("pos", "line"))
            .select(*others, (F.col("pos") + 1).alias("line_no"), "line"))


# Rules tested in one array expression.
RULE_GROUP = 64


def _holds_any(low: Column, literals) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(literal) for literal in sorted(literals)])


def _applies(rule: Rule, line: Column, code: Column, low: Column, has_lang: bool) -> Column:
    code = line if rule.in_comments else code
    condition = code.rlike(rule.line_regex)
    if rule.needs:
        condition = _holds_any(low, rule.needs) & condition
    if rule.also_regex:
        condition &= code.rlike(rule.also_regex)
    if rule.path_regex:
        condition &= F.col("path").rlike(rule.path_regex)
    if rule.lang and has_lang:
        condition &= F.col("lang") == rule.lang
    return condition


def _may_hit(rules: list[Rule]) -> Column | None:
    """Cheap test of the whole text, possible when every rule names literals it needs."""
    if not all(r.needs for r in rules):
        return None
    return _holds_any(F.lower("text"), {literal for r in rules for literal in r.needs})


def rule_hits(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, rule_id, ..., line_start, line) for every rule and line that match.

    The pack becomes one projection over the lines: the corpus is read once however many rules run.  Rules are tested in
    groups of ``RULE_GROUP``, each an array of its own, and the arrays are joined before the explode.
    """
    if not rules:
        return files.sparkSession.createDataFrame(
            [], "path string, rule_id string, axiom int, severity string, owasp string, message string, "
                "line_start int, line string")
    likely = _may_hit(rules)
    if likely is not None:
        files = files.filter(likely)
    has_lang = "lang" in files.columns
    keep = ["path", "text"] + (["lang"] if has_lang else [])
    lines = (explode_lines(files.select(*keep)).withColumn("code", tx.strip_comment(F.col("line")))
             .withColumn("low", F.lower("line")))
    tests = [F.when(_applies(r, F.col("line"), F.col("code"), F.col("low"), has_lang), F.lit(i + 1)) for i, r in enumerate(rules)]
    groups = [F.array_compact(F.array(*tests[at:at + RULE_GROUP])) for at in range(0, len(tests), RULE_GROUP)]
    found = F.concat(*groups) if len(groups) > 1 else groups[0]
    meta = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.axiom).alias("axiom"),
                              F.lit(r.severity).alias("severity"), F.lit(r.owasp).cast("string").alias("owasp"),
                              F.lit(r.message).alias("message")) for r in rules])
    return (lines.select("path", F.col("line_no").alias("line_start"), "line", F.explode(found).alias("hit"))
            .withColumn("rule", F.element_at(meta, F.col("hit")))
            .select("path", "rule.rule_id", "rule.axiom", severity_level(F.col("rule.severity")).alias("severity"),
                    "rule.owasp", "rule.message", "line_start", "line"))


def scan_rules(files: DataFrame, rules: list[Rule], run_id: str | None = None) -> DataFrame:
    """Findings of a rule pack over a corpus."""
    return as_findings(rule_hits(files, rules), run_id=run_id)


def scan_axiom(files: DataFrame, rules: list[Rule], axiom: int, run_id: str | None = None) -> DataFrame:
    """Findings of one axis: the other axes' rules are not even compiled."""
    return scan_rules(files, [r for r in rules if r.axiom == axiom], run_id)


def _ranges(files: DataFrame, ranges: Column) -> DataFrame:
    """Explode an array of (line_start, line_end)."""
    return (files.select("path", F.explode(ranges).alias("r"))
            .select("path", F.col("r.line_start").cast("int").alias("line_start"),
                    F.col("r.line_end").cast("int").alias("line_end")))


def _code_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.transform(tx.lines_of(F.col("text")), tx.strip_comment).alias("lines"))


SQL_WORDS = r"(?i)(select[ \t].*[ \t]from|insert[ \t]+into|update[ \t].*[ \t]set|delete[ \t]+from)[ \t]"
SQL_GLUE = r"(\$\{|[\"'][ \t]*\+|\+[ \t]*[\"']|[\"'][ \t]*%[ \t]|\.format\(|f[\"'])"
OPEN_CALL = r"\([ \t]*$"


def interpolated_sql(files: DataFrame, run_id: str | None = None) -> DataFrame:
    """SQL text glued together from variables; a call opened on the line above belongs to it."""
    code = _code_lines(files.filter(F.col("text").rlike(SQL_WORDS)))
    def hit(line, i):
        opened = (i > 0) & F.element_at(F.col("lines"), F.greatest(i, F.lit(1))).rlike(OPEN_CALL)
        bad = line.rlike(SQL_WORDS) & line.rlike(SQL_GLUE)
        return F.when(bad, F.struct(F.when(opened, i).otherwise(i + 1).alias("line_start"),
                                    (i + 1).alias("line_end")))
    hits = _ranges(code, F.filter(F.transform("lines", hit), lambda h: h.isNotNull()))
    return as_findings(hits, run_id=run_id, rule_id="RUL-04", axiom=5, severity="error", owasp="A05",
                       message="SQL built from variables")


ROUTE = r"(router|app|server)\.(get|post|put|patch|delete)\(|req\.(query|params)\.[A-Za-z]*[iI]d"
AUTH = r"(?i)(requireAuth|isAuthenticated|authorize|checkOwner|hasRole|@login_required|verifyToken)"


def unguarded_access(files: DataFrame, route_re: str = ROUTE, auth_re: str = AUTH,
                     run_id: str | None = None) -> DataFrame:
    """Data access points of files that hold no sign of an authorisation check."""
    suspects = files.filter(F.col("text").rlike(route_re))
    code = _code_lines(suspects).filter(~F.exists("lines", lambda line: line.rlike(auth_re)))
    points = tx.positions(F.col("lines"), lambda line: line.rlike(route_re))
    hits = code.select("path", F.explode(points).alias("line_start"))
    return as_findings(hits, run_id=run_id, rule_id="RUL-10", axiom=5, severity="error", owasp="A01",
                       message="data access without an ownership check")


def undeclared_imports(packages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Imports (path, package) of packages that the manifest (package) does not declare."""
    return packages.join(manifest.select("package").distinct(), "package", "left_anti")


TAG = r"<(?:button|a|li|div|span|tr|td|p)(?:=>|[^>a-zA-Z])(?:=>|[^>])*>"


def a11y_tags(files: DataFrame, run_id: str | None = None) -> DataFrame:
    """Unlabelled buttons, and click handlers on elements without role or key handler."""
    lines = explode_lines(files.select("path", "text").filter(F.col("text").rlike("<(button|[a-z]+ [^>]*on[cC]lick)")))
    tags = lines.select("path", F.col("line_no").alias("line_start"),
                        F.explode(F.regexp_extract_all("line", F.lit(TAG), F.lit(0))).alias("tag"))
    unlabelled = F.col("tag").rlike("^<button") & ~F.col("tag").rlike("aria-label|aria-labelledby|title=")
    clickable = (F.col("tag").rlike("^<(li|div|span|tr|td|p)[^a-z]") & F.col("tag").rlike("(?i)onclick")
                 & ~(F.col("tag").rlike("role=") & F.col("tag").rlike("(?i)onkey")))
    kinds = F.when(unlabelled, "button without a label").when(clickable, "click handler without role and key handler")
    hits = tags.withColumn("message", kinds).filter("message is not null")
    return as_findings(hits, run_id=run_id, rule_id="RUL-14", axiom=3, severity="warning")


def fixed_width(files: DataFrame, max_px: int = 600, run_id: str | None = None) -> DataFrame:
    """Hardcoded widths above ``max_px``."""
    pattern = r"(?i)width['\"]?[ \t]*[:=][ \t]*['\"]?([0-9]{1,6})px"
    lines = explode_lines(files.select("path", "text").filter(F.col("text").rlike(pattern)))
    width = F.regexp_extract(tx.strip_comment(F.col("line")), pattern, 1)
    hits = (lines.withColumn("width", F.when(width != "", width.cast("int"))).filter(F.col("width") > max_px)
            .withColumn("line_start", F.col("line_no"))
            .withColumn("message", F.concat(F.lit("hardcoded width of "), F.col("width"), F.lit("px"))))
    return as_findings(hits, run_id=run_id, rule_id="RUL-15", axiom=3, severity="warning")


def list_without_key(files: DataFrame, ahead: int = 2, run_id: str | None = None) -> DataFrame:
    """``.map(`` that renders an element within ``ahead`` lines and sets no key there."""
    code = _code_lines(files.filter(F.col("text").contains(".map(")))
    def hit(line, i):
        near = F.array_join(F.slice(F.col("lines"), i + 1, ahead + 1), "\n")
        bad = line.contains(".map(") & near.rlike(r"<[A-Za-z]+[ \t>]") & ~near.rlike(r"key=")
        return F.when(bad, F.struct((i + 1).alias("line_start"), (i + 1).alias("line_end")))
    hits = _ranges(code, F.filter(F.transform("lines", hit), lambda h: h.isNotNull()))
    return as_findings(hits, run_id=run_id, rule_id="RUL-16", axiom=3, severity="warning",
                       message="list rendered without a key")


LOOP = r"(^|[^A-Za-z0-9_])(for|while)[ \t]*\(|\.forEach\("
QUERY = r"\.(query|findOne|findMany|find|execute|fetch)\("


def query_in_loop(files: DataFrame, k: int = 5, run_id: str | None = None) -> DataFrame:
    """Query calls within ``k`` lines after a loop header."""
    code = _code_lines(files.filter(F.col("text").rlike(QUERY)))
    def hit(line, i):
        above = F.slice(F.col("lines"), F.greatest(i - k + 1, F.lit(1)), F.least(i, F.lit(k)))
        bad = line.rlike(QUERY) & F.exists(above, lambda x: x.rlike(LOOP))
        return F.when(bad, F.struct((i + 1).alias("line_start"), (i + 1).alias("line_end")))
    hits = _ranges(code, F.filter(F.transform("lines", hit), lambda h: h.isNotNull()))
    return as_findings(hits, run_id=run_id, rule_id="RUL-18", axiom=4, severity="warning",
                       message="query inside a loop")


ARTIFACT = r"(?i)(^|/)(plan|spec|memory|prompt|superpowers)[a-z0-9_-]*\.(md|txt)$|(^|/)superpowers/"


def stale_artifacts(files: DataFrame, as_of: str, days: int = 7, name_re: str = ARTIFACT) -> DataFrame:
    """Left-over working files of assistants, strictly older than ``days``."""
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("mtime").cast("date"))
    return files.filter(F.col("path").rlike(name_re) & (age > days)).select("path", age.alias("age_days"))


CODE_COMMENT = r"^[ \t]*(//|#).*([;{}()=]|return)"


def comment_blocks(files: DataFrame, min_run: int = 3, run_id: str | None = None) -> DataFrame:
    """Runs of comment lines that look like code."""
    code = (files.filter(F.col("text").rlike("//|#"))
            .select("path", tx.lines_of(F.col("text")).alias("lines")))
    hits = _ranges(code, tx.runs_of(F.col("lines"), lambda line: line.rlike(CODE_COMMENT), min_run))
    return as_findings(hits, run_id=run_id, rule_id="RUL-21", axiom=3, severity="info",
                       message="commented-out code")


OPENED = r"(setInterval|addEventListener|\.subscribe)\("
RELEASED = r"(clearInterval|removeEventListener|\.unsubscribe)\("


def unreleased(files: DataFrame, open_re: str = OPENED, close_re: str = RELEASED) -> DataFrame:
    """Files that open more subscriptions or timers than they release."""
    counts = files.filter(F.col("text").rlike(open_re)).select(
        "path", F.regexp_count("text", F.lit(open_re)).alias("opened"),
        F.regexp_count("text", F.lit(close_re)).alias("released"))
    return counts.filter("opened > released")


def long_lists(files: DataFrame, item_re: str = r"<li[ >]", limit: int = 50) -> DataFrame:
    """Files that render more than ``limit`` list items without paging."""
    counted = files.select("path", F.regexp_count("text", F.lit(item_re)).alias("items"))
    return counted.filter(F.col("items") > limit)


def pii_hits(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, kind, hits): how much personal data of each kind a file holds."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_count("text", F.lit(regex)).alias("hits"))
                      for kind, regex in patterns.items()])
    return (files.select("path", F.explode(kinds).alias("k")).select("path", "k.kind", "k.hits")
            .filter("hits > 0"))


def secret_literals(files: DataFrame) -> DataFrame:
    """The quoted literals behind hardcoded credentials, hashed so that reports never repeat them."""
    pattern = r"""(?i)(?:api[_-]?key|secret|passw(?:or)?d|token)[a-z0-9_]*["']?[ \t]*[:=][ \t]*["']([^"']{6,})["']"""
    found = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("literal"))
    return found.select("path", F.sha2("literal", 256).alias("literal_hash"), F.length("literal").alias("literal_chars"))
