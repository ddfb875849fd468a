"""Conventions: mining, evidence, life cycle, conformance checks.

A ledger row carries ``convention_id, kind, sub_category, family, pattern, status, replaces,
override_cleanliness``.  Observations are rows (zone, pattern, entity, conforms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import rules
from .duplicates import complexity, zone_quantile
from .pointers import chain_ends


def pattern_observations(files: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Observations of (eligible, conforming) regex pairs over files; a file not eligible says nothing."""
    rows = F.array(*[F.struct(F.lit(name).alias("pattern"), F.col("text").rlike(eligible).alias("eligible"),
                              F.col("text").rlike(conforming).alias("conforms")) for name, (eligible, conforming) in patterns.items()])
    return (files.select("path", "zone", F.explode(rows).alias("o")).filter("o.eligible")
            .select("zone", "o.pattern", F.col("path").alias("entity"), "o.conforms"))


def incidence(observations: DataFrame, by: list[str] = ("zone", "pattern")) -> DataFrame:
    """(zone, pattern, eligible, incidence): share of eligible entities that conform."""
    return observations.groupBy(*by).agg(F.count(F.lit(1)).alias("eligible"),
                                         F.round(F.avg(F.col("conforms").cast("double")), 6).alias("incidence"))


def incidence_trend(observations: DataFrame, at: str, as_of: str, months: int = 6, tolerance: float = 0.005) -> DataFrame:
    """(pattern, months, slope, trend) from monthly incidence over the last ``months`` months."""
    month = F.date_trunc("month", F.col(at))
    number = (F.year(month) * 12 + F.month(month)).cast("int")
    end = F.lit(as_of).cast("date")
    inside = number.between(F.year(end) * 12 + F.month(end) - (months - 1), F.year(end) * 12 + F.month(end))
    monthly = (observations.withColumn("month", number).filter(inside)
               .groupBy("pattern", "month").agg(F.avg(F.col("conforms").cast("double")).alias("incidence")))
    slopes = monthly.groupBy("pattern").agg(F.count(F.lit(1)).alias("months"),
                                            F.round(F.regr_slope("incidence", F.col("month").cast("double")), 6).alias("slope"))
    trend = (F.when(F.col("slope") > tolerance, "rising").when(F.col("slope") < -tolerance, "falling").otherwise("flat"))
    return slopes.withColumn("trend", trend)


def lifespan(observations: DataFrame, at: str, as_of: str, min_months: float = 3.0) -> DataFrame:
    """(pattern, lifespan_months, recency_months, established); a month counts 30 days."""
    first, last = F.min(F.col(at).cast("date")), F.max(F.col(at).cast("date"))
    spans = observations.groupBy("pattern").agg(first.alias("first"), last.alias("last"))
    life = F.round(F.date_diff("last", "first") / 30.0, 6)
    recency = F.round(F.date_diff(F.lit(as_of).cast("date"), F.col("last")) / 30.0, 6)
    return spans.select("pattern", life.alias("lifespan_months"), recency.alias("recency_months"), (life >= min_months).alias("established"))


def mine(entities: DataFrame, min_support: int, min_share: float) -> DataFrame:
    """(zone, pattern, support, share): patterns frequent in their zone.

    ``entities`` are rows (zone, entity, pattern), one per pattern an entity shows.
    """
    totals = entities.groupBy("zone").agg(F.countDistinct("entity").alias("entities"))
    support = entities.select("zone", "entity", "pattern").distinct().groupBy("zone", "pattern").agg(F.count(F.lit(1)).alias("support"))
    return (support.filter(F.col("support") >= min_support).join(totals, "zone")
            .withColumn("share", F.round(F.col("support") / F.col("entities"), 6))
            .filter(F.col("share") >= min_share).drop("entities"))


def evidence_bar(candidates: DataFrame, min_incidence: float, min_authors: int = 2, min_days: int = 90) -> DataFrame:
    """Latent candidates that may be proposed."""
    strong = ((F.col("incidence") >= min_incidence) & (F.col("author_spread") >= min_authors) & (F.col("lifespan_days") >= min_days))
    return candidates.filter(strong).withColumn("status", F.lit("proposed"))


def drop_rejected(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """A pattern once rejected is never proposed again."""
    rejected = ledger.filter("status = 'rejected'").select("sub_category", "pattern").distinct()
    return candidates.join(rejected, ["sub_category", "pattern"], "left_anti")


def damped(candidates: DataFrame, rejections: DataFrame, base: float, cap: float = 0.95) -> DataFrame:
    """Add ``needed``: the prevalence bar, doubled for every rejection in the family, and ``passes``."""
    needed = F.least(base * F.pow(F.lit(2.0), F.coalesce("rejections", F.lit(0))), F.lit(cap))
    return (candidates.join(rejections.select("family", "rejections"), "family", "left")
            .withColumn("needed", F.round(needed, 6)).withColumn("passes", F.col("incidence") >= F.col("needed")).drop("rejections"))


def quadrants(candidates: DataFrame, high: float, low_intent: float) -> DataFrame:
    """Place candidates by prevalence and intent; prevalent without intent is a question for a human."""
    often, meant = F.col("incidence") >= high, F.col("intent") >= low_intent
    name = (F.when(often & meant, "convention").when(often, "ambiguous").when(meant, "aspiration").otherwise("noise"))
    return candidates.withColumn("quadrant", name)


def human_evidence(evidence: DataFrame, bots: DataFrame) -> DataFrame:
    """Evidence of human authors only."""
    return evidence.join(bots.select("author").distinct(), "author", "left_anti")


def intent_score(evidence: DataFrame, per_item: float = 0.1, per_kind: float = 0.3) -> DataFrame:
    """(convention_id, items, kinds, intent, level) from how much and how varied the evidence is."""
    counts = evidence.groupBy("convention_id").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("type").alias("kinds"))
    score = F.round(F.least(F.lit(1.0), F.col("items") * per_item + F.col("kinds") * per_kind), 6)
    level = F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
    return counts.withColumn("intent", score).withColumn("level", level)


def contradictions(evidence: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(convention_id, stance, id, at, resolution): both sides of contradictory evidence, one row per item.

    Sides are listed below each other and not paired, so many items against many stay linear.  A
    resolution (convention_id, stance) marks who won.
    """
    sides = evidence.groupBy("convention_id").agg(F.countDistinct("stance").alias("n")).filter("n > 1").select("convention_id")
    settled = resolutions.select("convention_id", F.col("stance").alias("won"))
    outcome = (F.when(F.col("won").isNull(), "open").when(F.col("won") == F.col("stance"), "upheld").otherwise("overruled"))
    return (evidence.join(sides, "convention_id", "left_semi").join(settled, "convention_id", "left")
            .select("convention_id", "stance", "id", "at", outcome.alias("resolution")))


def curate(ledger: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ledger after human decisions (convention_id, decision, at, by).

    Accepted proposals become confirmed, rejected ones rejected with one more rejection; everything
    else stays.  The latest decision per id counts, so applying a batch twice changes nothing more.
    """
    final = (decisions.groupBy("convention_id").agg(F.max(F.struct("at", "decision", "by")).alias("d"))
             .select("convention_id", "d.decision", F.col("d.at").alias("decided_at"), F.col("d.by").alias("decided_by")))
    known = ledger.select("convention_id")
    lane = (ledger.select("convention_id", "status", "rejections")
            .unionByName(proposals.join(known, "convention_id", "left_anti").select("convention_id", F.lit("proposed").alias("status"), F.lit(0).alias("rejections"))))
    joined = lane.join(final, "convention_id", "left")
    open_lane = F.col("status") == "proposed"
    status = (F.when(open_lane & (F.col("decision") == "accept"), "confirmed").when(open_lane & (F.col("decision") == "reject"), "rejected")
              .otherwise(F.col("status")))
    rejections = F.col("rejections") + F.when(open_lane & (F.col("decision") == "reject"), 1).otherwise(0)
    touched = open_lane & F.col("decision").isin("accept", "reject")
    return joined.select("convention_id", status.alias("status"), rejections.alias("rejections"),
                         F.when(touched, F.col("decided_at")).alias("decided_at"), F.when(touched, F.col("decided_by")).alias("decided_by"))


def decay(ledger: DataFrame, current: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Confirmed entries whose incidence fell below ``ratio`` of that at confirmation become waning."""
    faded = (F.col("status") == "confirmed") & (F.coalesce("incidence", F.lit(0.0)) < ratio * F.col("confirmed_incidence"))
    return (ledger.join(current.select("convention_id", "incidence"), "convention_id", "left")
            .withColumn("status", F.when(faded, "waning").otherwise(F.col("status"))).drop("incidence"))


def supersede(ledger: DataFrame) -> DataFrame:
    """(convention_id, status, superseded_by, newest).

    A confirmed entry supersedes what it ``replaces``; ``newest`` follows the chain to its end.
    """
    links = (ledger.filter("status = 'confirmed' and replaces is not null").groupBy("replaces")
             .agg(F.max("convention_id").alias("superseded_by")).withColumnRenamed("replaces", "old"))
    ends = (chain_ends(links.select(F.col("old").alias("key"), F.col("superseded_by").alias("next"))).filter("not ring")
            .select(F.col("key").alias("old"), F.col("end").alias("newest")))
    joined = (ledger.join(links, ledger.convention_id == links.old, "left").drop("old")
              .join(ends, ledger.convention_id == ends.old, "left").drop("old"))
    return joined.select("convention_id", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")).alias("status"),
                         "superseded_by", F.coalesce("newest", "convention_id").alias("newest"))


# Legal moves between states and who may make them.
TRANSITIONS = [
    ("latent", "proposed", "human"),
    ("proposed", "confirmed", "human"),
    ("proposed", "rejected", "human"),
    ("confirmed", "waning", "auto"),
    ("confirmed", "waning", "human"),
    ("confirmed", "superseded", "human"),
    ("waning", "confirmed", "human"),
    ("waning", "superseded", "human"),
    ("waning", "rejected", "human"),
]


def illegal_transitions(before: DataFrame, after: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(convention_id, from, to, actor) moves that the transition table does not allow.

    ``after`` carries ``actor`` (human or auto).
    """
    if allowed is None:
        allowed = before.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string, actor string")
    moves = (before.select("convention_id", F.col("status").alias("from_status"))
             .join(after.select("convention_id", F.col("status").alias("to_status"), "actor"), "convention_id")
             .filter("from_status <> to_status"))
    return moves.join(allowed, ["from_status", "to_status", "actor"], "left_anti")


def digest(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(convention_id, items, id, type, snippet): pending proposals with their evidence, one row per item."""
    counts = evidence.groupBy("convention_id").agg(F.count(F.lit(1)).alias("items"))
    return (proposals.select("convention_id").join(counts, "convention_id", "left").fillna(0, ["items"])
            .join(evidence.select("convention_id", "id", "type", "snippet"), "convention_id", "left"))


def nudge(proposals: DataFrame, last_curated: str, as_of: str, pending_bar: int = 10, days_bar: int = 30) -> DataFrame:
    """One row: is it time to curate?"""
    days = F.date_diff(F.lit(as_of).cast("date"), F.lit(last_curated).cast("date"))
    return (proposals.agg(F.count(F.lit(1)).alias("pending")).withColumn("days", days)
            .withColumn("nudge", (F.col("pending") >= pending_bar) | (F.col("days") >= days_bar)))


def enforceable(ledger: DataFrame, toggles: DataFrame) -> DataFrame:
    """(convention_id, enforced_as): confirmed entries of enabled sub-categories, waning ones as advice.

    ``toggles(sub_category, level)`` says blocking, advisory or off.
    """
    active = ledger.filter("status in ('confirmed', 'waning')").join(toggles, "sub_category", "left")
    level = F.coalesce("level", F.lit("advisory"))
    return (active.filter(level != "off").select("convention_id", "sub_category", "status",
            F.when(F.col("status") == "waning", "advisory").otherwise(level).alias("enforced_as")))


def check_naming(entities: DataFrame, naming: DataFrame) -> DataFrame:
    """(entity, kind, expected): names that do not fit the shape the ledger asks of their kind.

    ``naming(kind, shape)`` holds one regular expression per kind.  It is configuration and comes to the driver, so that every
    pattern is compiled once and not for every row.
    """
    expected = None
    for row in naming.select("kind", "shape").distinct().collect():
        broken = (F.col("kind") == row["kind"]) & ~F.col("name").rlike(row["shape"])
        expected = F.when(broken, F.lit(row["shape"])) if expected is None else expected.when(broken, F.lit(row["shape"]))
    expected = F.lit(None).cast("string") if expected is None else expected
    return entities.select("entity", "kind", expected.alias("expected")).filter("expected is not null")


def check_import_source(edges: DataFrame, banned: DataFrame) -> DataFrame:
    """(src, spec, use_instead, convention_id) for imports of a banned source."""
    return edges.join(banned.select(F.col("source").alias("spec"), "use_instead", "convention_id"), "spec").select(
        "src", "spec", "use_instead", "convention_id")


def check_registry(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, line_start, primitive, component): raw primitives where a house component exists.

    ``registry(primitive, component)`` is configuration: its primitives become a literal, and only tokens among them leave
    their line.
    """
    names = [row["primitive"] for row in registry.select("primitive").distinct().orderBy("primitive").collect()]
    lines = rules.explode_lines(files.select("path", "text"))
    tokens = F.regexp_extract_all(tx.strip_comment(F.col("line")), F.lit(r"</?[A-Za-z]+|[A-Za-z_.]+\("), F.lit(0))
    tokens = F.array_intersect(tokens, F.array(*map(F.lit, names)).cast("array<string>"))
    used = lines.select("path", F.col("line_no").alias("line_start"), F.explode(tokens).alias("primitive"))
    return used.join(registry.select("primitive", "component"), "primitive")


def placement_leak(fan_in: DataFrame, files: DataFrame, vocabulary: DataFrame, q: float = 0.9) -> DataFrame:
    """(module, fan_in, terms): widely used modules that speak domain language.

    ``vocabulary(term)`` is configuration; its terms are counted in the file's own row, so no text moves.  The quantile comes
    from counts per distinct fan-in and is one number.
    """
    histogram = fan_in.groupBy("fan_in").agg(F.count(F.lit(1)).alias("n"))
    bar = histogram.agg(F.percentile("fan_in", F.lit(q), F.col("n")).alias("bar")).first()["bar"]
    words = [row["term"] for row in vocabulary.select("term").distinct().orderBy("term").collect()]
    found = F.size(F.array_intersect(tx.words(F.col("text")), F.array(*map(F.lit, words)).cast("array<string>")))
    terms = files.select("path", found.cast("bigint").alias("terms")).filter("terms > 0")
    wide = fan_in.filter(F.col("fan_in") >= F.lit(bar)).select("module", "fan_in")
    return wide.join(terms, wide.module == terms.path).select("module", "fan_in", "terms")


def placement_layer(files: DataFrame, assigned: DataFrame, factor: float = 2.0, role: str = "thin") -> DataFrame:
    """(path, zone, complexity, zone_median): complex files in a zone that should hold none."""
    measured = complexity(files.select("path", "text")).join(assigned.filter(F.col("role") == role).select("path", "zone"), "path")
    medians = zone_quantile(measured, "complexity", 0.5, "zone_median")
    return (measured.join(medians, "zone").filter(F.col("complexity") > factor * F.col("zone_median"))
            .select("path", "zone", "complexity", "zone_median"))


def deviations(entities: DataFrame, changed: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(path, zone, shape, usual, share, message): changed files that differ from their zone's usual shape.

    ``entities(path, zone, shape)``; the usual shape is the most frequent one, ties go to the smaller.
    """
    counts = entities.groupBy("zone", "shape").agg(F.count(F.lit(1)).alias("n"))
    usual = (counts.groupBy("zone").agg(F.min_by(F.struct("shape", "n"), F.struct((-F.col("n")).alias("n"), "shape")).alias("u"), F.sum("n").alias("total"))
             .select("zone", F.col("u.shape").alias("usual"), F.round(F.col("u.n") / F.col("total"), 6).alias("share"))
             .filter(F.col("share") >= min_share))
    message = F.concat(F.lit("differs from the usual "), "usual", F.lit(" ("), F.round(F.col("share") * 100).cast("int").cast("string"), F.lit("% of zone)"))
    return (entities.join(changed.select("path").distinct(), "path", "left_semi").join(usual, "zone")
            .filter("shape <> usual").withColumn("message", message))


def anti_spread(matches: DataFrame, changed: DataFrame) -> DataFrame:
    """Matches (path, convention_id) of quarantined patterns: new ones are flagged, old ones are known debt."""
    fresh = changed.select("path").distinct().withColumn("_new", F.lit(True))
    return (matches.join(fresh, "path", "left")
            .withColumn("verdict", F.when(F.col("_new"), "flagged").otherwise("known debt")).drop("_new"))


def cite(findings: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Findings with a live conforming entity as exemplar, or the reason why there is none.

    ``exemplars(convention_id, entity, rank, status)``: the best ranked one that is still alive.
    """
    alive = (exemplars.filter("status in ('derived', 'confirmed')").groupBy("convention_id")
             .agg(F.min(F.struct("rank", "entity")).alias("e")).select("convention_id", F.concat(F.lit("corpus://"), "e.entity").alias("exemplar")))
    known = exemplars.select("convention_id").distinct().withColumn("_known", F.lit(True))
    return (findings.drop("exemplar").join(alive, "convention_id", "left").join(known, "convention_id", "left")
            .withColumn("dropped_reason", F.when(F.col("exemplar").isNotNull(), F.lit(None)).when(F.col("_known"), "exemplar gone").otherwise("no exemplar"))
            .drop("_known"))


def arbitrate(findings: DataFrame, ledger: DataFrame, conforming: DataFrame) -> DataFrame:
    """Settle axis 3 against axis 6 by each convention's flag; ``arbitration`` says what happened.

    With the flag set the convention wins: cleanliness findings on files that conform to it are
    suppressed.  Without it cleanliness wins: the convention's own findings are suppressed.  Findings on
    known instances of an anti-convention are downgraded to info.  ``conforming(path, convention_id)``.
    """
    flags = ledger.select("convention_id", "override_cleanliness", "kind")
    marks = (conforming.join(flags, "convention_id").groupBy("path").agg(
        F.bool_or(F.col("override_cleanliness") & (F.col("kind") == "convention")).alias("_intended"),
        F.bool_or(F.col("kind") == "anti-convention").alias("_debt")))
    own = flags.select("convention_id", F.col("override_cleanliness").alias("_flag"))
    joined = findings.join(marks, "path", "left").join(own, "convention_id", "left")
    is_clean, is_own = F.col("axiom") == 3, F.col("axiom") == 6
    action = (F.when(is_clean & F.coalesce("_intended", F.lit(False)), "suppressed")
              .when(is_clean & F.coalesce("_debt", F.lit(False)), "known debt")
              .when(is_own & ~F.coalesce("_flag", F.lit(True)), "suppressed").otherwise("kept"))
    settled = joined.withColumn("arbitration", action)
    return (settled.withColumn("severity", F.when(F.col("arbitration") == "known debt", "info").otherwise(F.col("severity")))
            .drop("_intended", "_debt", "_flag"))


def ledger_health(ledger: DataFrame, current: DataFrame) -> DataFrame:
    """(status, entries, summary): entries per status and how their incidence moved since confirmation."""
    joined = ledger.join(current.select("convention_id", "incidence"), "convention_id", "left")
    change = F.avg(F.col("incidence") - F.col("confirmed_incidence"))
    counts = joined.groupBy("status").agg(F.count(F.lit(1)).alias("entries"), F.round(change, 4).alias("change"))
    word = F.when(F.col("change") > 0.01, "up").when(F.col("change") < -0.01, "down").otherwise("steady")
    return counts.select("status", "entries", F.format_string("%d entries, incidence %s", "entries", word).alias("summary"),
                         F.coalesce("change", F.lit(0.0)).alias("change"))


def conformance_tier(corpus_map: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: T1 with map and ledger, T2 with a map only, T3 without a map."""
    entities = corpus_map.agg(F.count(F.lit(1)).alias("entities"), F.lit(1).alias("_one"))
    entries = ledger.agg(F.count(F.lit(1)).alias("entries"), F.lit(1).alias("_one"))
    tier = (F.when(F.col("entities") == 0, "T3 skipped: no map").when(F.col("entries") == 0, "T2 structural only").otherwise("T1 full"))
    return entities.join(entries, "_one").select("entities", "entries", tier.alias("tier"))
