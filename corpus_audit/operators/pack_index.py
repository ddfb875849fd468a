"""Rule packs as tables: an index of literal grams decides which lines meet which rules.

A rule of a pack table needs one of its literals in a line: those it names, or else the longest that its pattern cannot do
without.  Every literal is indexed under one gram of ``GRAM`` characters, the one that fewest literals of the pack hold (a
shorter literal under itself).  Lines are joined with the index on the grams they hold, and a pattern runs only for a line
and a rule that met and whose literal is there.  The pack is never collected; it may hold any number of rules.

Rules without any literal have to see every line.  They are compiled like built-in rules, ``BROAD`` at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from . import rules
from .packs import Rule

GRAM = 3
BROAD = 64
# An index up to this size goes to every task; a larger one is joined by shuffling the grams of the lines.
BROADCAST_GRAMS = 500_000
COLUMNS = {"rule_id": "string", "axiom": "int", "severity": "string", "owasp": "string", "line_regex": "string", "message": "string",
           "path_regex": "string", "lang": "string", "also_regex": "string", "needs": "array<string>", "in_comments": "boolean"}
HIT = ("path", "rule_id", "axiom", "severity", "owasp", "message", "line_start", "line")


def required_literal(pattern: Column) -> Column:
    """The longest literal in lower case that any match of a pattern contains; null if none of two characters is certain.

    Escapes, classes, groups, and what a quantifier may drop are cut out.  Groups nested more than three deep and
    alternatives outside groups leave nothing certain.
    """
    rest = F.regexp_replace(pattern, r"(?s)\\.", "\n")
    rest = F.regexp_replace(rest, r"\[[^\]]*\]", "\n")
    for _ in range(3):
        rest = F.regexp_replace(rest, r"\([^()]*\)", "\n")
    uncertain = rest.rlike(r"[()|\[\]]")
    rest = F.regexp_replace(rest, r"(?s).(\?|\*|\{[^}]*\})[?+]?", "\n")
    parts = F.split(F.lower(F.regexp_replace(rest, r"[+^$.{}]", "\n")), "\n", -1)
    longest = F.aggregate(parts, F.lit(""), lambda best, part: F.when(F.length(part) > F.length(best), part).otherwise(best))
    return F.when(~uncertain & (F.length(longest) >= 2), longest)


def normalized(pack: DataFrame) -> DataFrame:
    """The pack with all of ``COLUMNS``; ``needs`` is null for rules that have to see every line."""
    columns = [(F.col(name) if name in pack.columns else F.lit(None)).cast(kind).alias(name) for name, kind in COLUMNS.items()]
    rows = pack.select(*columns).withColumn("in_comments", F.coalesce("in_comments", F.lit(False)))
    named = F.array_distinct(F.filter(F.transform("needs", lambda literal: F.lower(literal)), lambda literal: literal != ""))
    derived = required_literal(F.col("line_regex"))
    return rows.withColumn("needs", F.when(F.size(named) > 0, named).when(derived.isNotNull(), F.array(derived)))


def grams(value: Column, size: int) -> Column:
    """All runs of ``size`` characters, in order."""
    return F.regexp_extract_all(value, F.lit(f"(?s)(?=({'.' * size}))"), F.lit(1))


def literal_index(pack: DataFrame) -> DataFrame:
    """(gram, literal, rule): every literal of a normalized pack under its rarest gram."""
    literals = (pack.filter("needs is not null").select(F.struct(*COLUMNS).alias("rule"))
                .select("rule", F.explode("rule.needs").alias("literal")))
    held = F.when(F.length("literal") < GRAM, F.array("literal")).otherwise(grams(F.col("literal"), GRAM))
    of_literal = literals.select("literal").distinct().select("literal", F.explode(F.array_distinct(held)).alias("gram"))
    shared = of_literal.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = of_literal.join(shared, "gram").groupBy("literal").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return literals.join(chosen, "literal").select("gram", "literal", "rule")


def _holds(has_lang: bool) -> Column:
    """Whether the rule of a pair holds for its line; the cheap conditions come first.

    A pair counts at the first place of the gram and under the first literal of the rule that the line holds, so it is found
    once.
    """
    rule = F.col("rule")
    code = F.when(rule.in_comments, F.col("line")).otherwise(F.col("code"))
    first = F.element_at(F.filter(rule.needs, lambda literal: F.contains(F.col("low"), literal)), 1)
    unless_null = lambda given, condition: given.isNull() | condition
    conditions = [F.contains(F.col("low"), F.col("literal")), first == F.col("literal"), unless_null(rule.path_regex, F.rlike("path", rule.path_regex)),
                  F.rlike(code, rule.line_regex), unless_null(rule.also_regex, F.rlike(code, rule.also_regex))]
    if has_lang:
        conditions.insert(1, unless_null(rule.lang, F.col("lang") == rule.lang))
    return reduce(lambda a, b: a & b, conditions)


def _indexed_hits(files: DataFrame, index: DataFrame) -> DataFrame:
    has_lang = "lang" in files.columns
    keep = ["path", "text"] + (["lang"] if has_lang else [])
    lines = (rules.explode_lines(files.select(*keep)).withColumn("code", tx.strip_comment(F.col("line")))
             .withColumn("low", F.lower("line")))
    counts = index.groupBy(F.length("gram").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return _no_hits(files)
    held = F.concat(*[F.array_distinct(grams(F.col("low"), row["size"])) for row in counts])
    met = lines.select("*", F.explode(held).alias("gram"))
    small = sum(row["n"] for row in counts) <= BROADCAST_GRAMS
    pairs = met.join(F.broadcast(index) if small else index, "gram").filter(_holds(has_lang))
    return pairs.select("path", "rule.rule_id", "rule.axiom", rules.severity_level(F.col("rule.severity")).alias("severity"),
                        "rule.owasp", "rule.message", F.col("line_no").alias("line_start"), "line")


def _no_hits(files: DataFrame) -> DataFrame:
    return rules.rule_hits(files, [])


def _broad_hits(files: DataFrame, broad: DataFrame) -> DataFrame:
    """Hits of rules without a literal, some of them at a time."""
    numbered = cut_lineage(broad.withColumn("_turn", F.xxhash64(*[F.col(name) for name in COLUMNS if name != "needs"])))
    found, group = _no_hits(files), []
    for row in numbered.orderBy("_turn").toLocalIterator():
        group.append(Rule(**{name: row[name] for name in COLUMNS if name not in ("needs",)}))
        if len(group) == BROAD:
            found, group = found.unionByName(rules.rule_hits(files, group)), []
    return found.unionByName(rules.rule_hits(files, group)) if group else found


def pack_hits(files: DataFrame, pack: DataFrame) -> DataFrame:
    """Like :func:`rules.rule_hits` for a pack that is a table; rules whose pattern is null find nothing."""
    known = cut_lineage(normalized(pack).filter("line_regex is not null"))
    index = cut_lineage(literal_index(known))
    indexed = _indexed_hits(files, index)
    broad = known.filter("needs is null").drop("needs")
    found = indexed if broad.isEmpty() else indexed.unionByName(_broad_hits(files, broad))
    return found.select(*HIT)


def scan_pack(files: DataFrame, pack: DataFrame, run_id: str | None = None) -> DataFrame:
    """Findings of a pack table over a corpus."""
    return rules.as_findings(pack_hits(files, pack), run_id=run_id)
