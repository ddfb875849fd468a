"""Scores and trends over runs."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..session import cut_lineage


class Formula(NamedTuple):
    """Weights of one score version."""
    version: str
    error: float
    warning: float
    info: float


# Weights and floor of the first score formula.
SCORE_V1 = Formula("v1", 10.0, 3.0, 1.0)
KLOC_FLOOR = 0.1


def score_of(formula: Formula) -> Column:
    weighted = F.col("error") * formula.error + F.col("warning") * formula.warning + F.col("info") * formula.info
    return F.greatest(F.lit(0.0), 100.0 - weighted / F.greatest(F.col("kloc").cast("double"), F.lit(KLOC_FLOOR)))


def density(findings: DataFrame, kloc: DataFrame) -> DataFrame:
    """(axiom, error, warning, info, kloc and the counts per KLOC); ``kloc`` is one row."""
    counts = findings.groupBy("axiom").agg(*[
        F.count_if(F.col("severity") == level).alias(level) for level in ("error", "warning", "info")])
    one = F.lit(1).alias("_one")
    joined = counts.select("*", one).join(kloc.select("kloc", one), "_one").drop("_one")
    rates = {f"{level}_rate": F.round(F.col(level) / F.col("kloc"), 6) for level in ("error", "warning", "info")}
    return joined.withColumns(rates)


def score(counts: DataFrame, formula: Formula = SCORE_V1) -> DataFrame:
    """Add the score and the formula version it was computed with."""
    return counts.withColumn("score", F.round(score_of(formula), 6)).withColumn("formula", F.lit(formula.version))


def rescore(history: DataFrame, formulas: list[Formula]) -> DataFrame:
    """Every trend record under every formula; the formulas fan out inside each row."""
    scored = F.array(*[F.struct(F.lit(f.version).alias("formula"), F.round(score_of(f), 6).alias("score")) for f in formulas])
    return history.withColumn("_s", F.explode(scored)).select(*history.columns, "_s.formula", "_s.score")


def dedupe_history(trends: DataFrame) -> DataFrame:
    """One row per record id: the smallest of its copies, so a replay always keeps the same one."""
    others = [c for c in trends.columns if c != "record_id"]
    return (trends.groupBy("record_id").agg(F.min(F.struct(*others)).alias("r"))
            .select("record_id", "r.*").select(*trends.columns))


def chains(commits: DataFrame) -> DataFrame:
    """(sha, head, dist): the unbranched stretch of every commit, named by its oldest one, and the steps down to it.

    A commit continues the stretch of its parent if it is that parent's only child and has no other parent.  Found by
    pointer doubling, so the rounds follow the logarithm of the longest stretch.
    """
    parents = commits.filter("parent_sha is not null")
    only_parent = parents.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("parent_sha").alias("head")).filter("n = 1").select("sha", "head")
    only_child = parents.groupBy("parent_sha").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("parent_sha").alias("head"))
    inner = only_parent.join(only_child, "head").select("sha", "head")
    nodes = commits.select("sha").union(parents.select(F.col("parent_sha").alias("sha"))).distinct()
    pointers = cut_lineage(nodes.join(inner, "sha", "left").select(
        "sha", F.coalesce("head", "sha").alias("head"), F.when(F.col("head").isNull(), 0).otherwise(1).cast("bigint").alias("dist")))
    while True:
        further = pointers.select(F.col("sha").alias("head"), F.col("head").alias("head2"), F.col("dist").alias("dist2"))
        stepped = cut_lineage(pointers.join(further, "head").select(
            "sha", F.col("head2").alias("head"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("dist2") > 0).alias("moved")))
        pointers = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            return pointers


def ancestry_rank(commits: DataFrame) -> DataFrame:
    """(sha, generation): longest path from a root commit; wall clock plays no part.

    ``commits(sha, parent_sha)`` has one row per parent.  Unbranched stretches are shortened first, so the rounds follow the
    merges on a path and not the number of commits.  A stretch is ranked once, in the round in which the last of its parents
    is, and only stretches ranked in the round before make offers.
    """
    commits = cut_lineage(commits.select("sha", "parent_sha").distinct())
    parents = commits.filter("parent_sha is not null")
    pointers = chains(commits)
    heads = pointers.filter("sha = head").select("head")
    steps = cut_lineage(
        parents.join(heads, F.col("sha") == F.col("head"), "left_semi")
        .join(pointers.select(F.col("sha").alias("parent_sha"), F.col("head").alias("above"), "dist"), "parent_sha")
        .groupBy(F.col("sha").alias("head"), "above").agg((F.max("dist") + 1).alias("weight")))
    needs = steps.groupBy("head").agg(F.count(F.lit(1)).alias("need"))
    steps = cut_lineage(steps.join(needs, "head"))
    frontier = cut_lineage(heads.join(steps, "head", "left_anti").withColumn("generation", F.lit(0).cast("bigint")))
    ranked, waiting = [frontier], None
    while size := frontier.count():
        offers = (steps.join(_small(frontier.withColumnRenamed("head", "above"), size), "above")
                  .select("head", "need", F.lit(1).cast("bigint").alias("got"), (F.col("generation") + F.col("weight")).alias("generation")))
        offers = offers if waiting is None else offers.unionByName(waiting)
        met = cut_lineage(offers.groupBy("head", "need").agg(F.sum("got").alias("got"), F.max("generation").alias("generation")))
        frontier, waiting = met.filter("got = need").select("head", "generation"), met.filter("got < need")
        ranked = _few([*ranked, frontier])
    ranks = reduce(DataFrame.unionByName, ranked)
    return pointers.join(ranks, "head").select("sha", (F.col("generation") + F.col("dist")).alias("generation"))


# Rows of one round that every task may hold, and tables of rounds that one plan may read.
SMALL, FEW = 100_000, 16


def _small(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` for a join: with a broadcast hint if they are few."""
    return F.broadcast(rows) if size <= SMALL else rows


def _few(rounds: list[DataFrame]) -> list[DataFrame]:
    """The same rows in fewer tables, so that plans do not grow with the rounds."""
    return rounds if len(rounds) < FEW else [cut_lineage(reduce(DataFrame.unionByName, rounds))]


def deltas(scored: DataFrame, ranks: DataFrame) -> DataFrame:
    """Add ``previous`` and ``delta``: score against the previous run of the same branch, scope and axis.

    Order is commit generation, then record id.  Generations cut long branches into pieces.  A record whose commit is not
    ranked has no place in that order: it stays, without generation, previous and delta, and ``reason`` says why.
    """
    joined = scored.join(ranks, scored.commit_sha == ranks.sha, "left").drop("sha")
    placed, lost = joined.filter("generation is not null"), joined.filter("generation is null")
    chained = ordered.with_previous(placed, ["branch", "scope", "axiom"], ["generation", "record_id"],
                                    F.floor(F.col("generation") / 64), ["score"])
    known = (chained.withColumn("delta", F.round(F.col("score") - F.col("prev_score"), 6))
             .withColumnRenamed("prev_score", "previous").withColumn("reason", F.lit(None).cast("string")))
    return known.unionByName(lost.withColumn("reason", F.lit("unknown commit")), allowMissingColumns=True)


# Places of a stretch that are merged in one piece.
STRETCH = 1 << 16


def _last_known(asks: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``asks`` with ``met``: the ``run`` of ``known`` at the greatest place up to ``place`` within ``keys``, null if none.

    An as-of merge in pieces of ``STRETCH`` places; a piece takes over the last run of those below it.
    """
    piece = F.floor(F.col("place") / STRETCH)
    asks, known = asks.withColumn("_piece", piece), known.withColumn("_piece", piece)
    ends = known.groupBy(*keys, "_piece").agg(F.max_by("run", "place").alias("_end"))
    pieces = ends.unionByName(asks.select(*keys, "_piece").distinct(), allowMissingColumns=True).groupBy(*keys, "_piece").agg(F.first("_end", ignorenulls=True).alias("_end"))
    below = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*keys, "_piece", F.last("_end", ignorenulls=True).over(below).alias("_carried"))
    both = known.select(*keys, "_piece", "place", "run").withColumn("_ask", F.lit(0)).unionByName(
        asks.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_piece").orderBy("place", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumn("_inside", F.last("run", ignorenulls=True).over(inside)).filter("_ask = 1")
    return (merged.join(carried, [*keys, "_piece"]).withColumn("met", F.coalesce("_inside", "_carried"))
            .drop("_piece", "_ask", "_inside", "_carried", "run"))


def ancestor_baseline(first_runs: DataFrame, scored: DataFrame, commits: DataFrame) -> DataFrame:
    """(record_id, distance, baseline): nearest ancestor commit with a run of the same scope and axis.

    For runs without an earlier run on their branch.  Commits lie on unbranched stretches; the nearest run on a stretch is
    found by one merge in the order of places.  Who finds none goes on at the parents of the stretch's oldest commit, so the
    rounds follow the stretches on a path, not its commits.  Of equally near runs that of the greatest commit counts.
    """
    commits = cut_lineage(commits.select("sha", "parent_sha").distinct())
    places = chains(commits)
    keys = ["head", "scope", "axiom"]
    known = cut_lineage(
        scored.groupBy("commit_sha", "scope", "axiom").agg(F.max_by("score", "record_id").alias("baseline"))
        .join(places, F.col("commit_sha") == F.col("sha"))
        .select(*keys, F.col("dist").alias("place"), F.struct(F.col("dist").alias("place"), "sha", "baseline").alias("run")))
    steps = cut_lineage(commits.filter("parent_sha is not null")
                        .join(places.filter("sha = head").select("sha"), "sha", "left_semi")
                        .join(places.select(F.col("sha").alias("parent_sha"), F.col("head").alias("above"), "dist"), "parent_sha")
                        .select(F.col("sha").alias("head"), "above", "dist"))
    # ``steps`` counts from the record's commit to the commit at ``place``; the commit itself is not asked.
    asks = (first_runs.join(places, F.col("commit_sha") == F.col("sha"))
            .select("record_id", *keys, (F.col("dist") - 1).alias("place"), F.lit(1).cast("bigint").alias("steps")))
    asks = cut_lineage(asks.withColumn("nearest", F.lit(None).cast("bigint")))
    found = []
    while (size := asks.count()) or not found:
        # Of the runs only those on stretches that are asked take part.
        asked = known if size > SMALL else known.join(F.broadcast(asks.select(*keys).distinct()), keys, "left_semi")
        answers = cut_lineage(_last_known(asks, asked, keys))
        met = answers.filter("met is not null").select(
            "record_id", (F.col("steps") + F.col("place") - F.col("met.place")).alias("distance"), "met.sha", "met.baseline")
        found = _few([*found, met])
        onward = (answers.filter("met is null").join(steps.withColumnRenamed("dist", "_dist"), "head")
                  .select("record_id", F.col("above").alias("head"), "scope", "axiom", F.col("_dist").alias("place"),
                          (F.col("steps") + F.col("place") + 1).alias("steps"), "nearest")
                  .groupBy("record_id", *keys, "place").agg(F.min("steps").alias("steps"), F.min("nearest").alias("nearest")))
        now = met.groupBy("record_id").agg(F.min("distance").alias("distance"))
        asks = cut_lineage(onward.join(now, "record_id", "left").withColumn("nearest", F.least("nearest", "distance")).drop("distance")
                           .filter("nearest is null or steps <= nearest"))
    best = (reduce(DataFrame.unionByName, found).groupBy("record_id")
            .agg(F.max(F.struct((-F.col("distance")).alias("near"), "sha", "baseline")).alias("b")))
    return best.select("record_id", (-F.col("b.near")).alias("distance"), F.col("b.baseline").alias("baseline"))


def trend_label(delta: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Add improving / stable / regressing; a first run is ``new``."""
    label = (F.when(F.col("delta").isNull(), "new").when(F.col("delta") > tolerance, "improving")
             .when(F.col("delta") < -tolerance, "regressing").otherwise("stable"))
    return delta.withColumn("trend", label)


def period_change(trends: DataFrame, at: str, period: str = "14 days") -> DataFrame:
    """(axiom, period_start, findings, change): findings per period and their relative change."""
    counts = (trends.groupBy("axiom", F.window(F.col(at), period).alias("w"))
              .agg(F.sum(F.col("error") + F.col("warning") + F.col("info")).alias("findings")))
    # One row per axis and period is left: a plain window will do.
    before = F.lag("findings").over(Window.partitionBy("axiom").orderBy("period_start"))
    return (counts.select("axiom", F.col("w.start").alias("period_start"), "findings")
            .withColumn("change", F.round((F.col("findings") - before) / F.nullif(before, F.lit(0)), 6)))


def axis_correlation(trends: DataFrame, at: str) -> DataFrame:
    """(axis_a, axis_b, days, correlation) of the day-to-day movements of two axes."""
    daily = trends.groupBy("axiom", F.to_date(at).alias("day")).agg(F.sum(F.col("error") + F.col("warning") + F.col("info")).alias("n"))
    # Days and axes are few; the movement of an axis needs its day before.
    moves = cut_lineage(daily.withColumn("move", F.col("n") - F.lag("n").over(Window.partitionBy("axiom").orderBy("day")))
                        .filter("move is not null").select("axiom", "day", "move"))
    other = moves.select(F.col("axiom").alias("axis_b"), "day", F.col("move").alias("move_b"))
    both = moves.select(F.col("axiom").alias("axis_a"), "day", F.col("move").alias("move_a")).join(other, "day").filter("axis_a < axis_b")
    return both.groupBy("axis_a", "axis_b").agg(F.count(F.lit(1)).alias("days"), F.round(F.corr("move_a", "move_b"), 6).alias("correlation"))


def totals(findings: DataFrame) -> DataFrame:
    """Findings per (zone, axis), per zone and in all; ``level`` tells which."""
    return (findings.rollup("zone", "axiom").agg(F.count(F.lit(1)).alias("findings"), F.grouping_id().alias("gid"))
            .select(F.when(F.col("gid") == 0, "zone+axis").when(F.col("gid") == 1, "zone").otherwise("all").alias("level"),
                    F.coalesce("zone", F.lit("*")).alias("zone"), F.coalesce(F.col("axiom").cast("string"), F.lit("*")).alias("axiom"), "findings"))


def validate_history(trends: DataFrame, min_version: int = 1) -> DataFrame:
    """One row: broken records by kind, and whether the history must be left aside (cold start)."""
    negative = (F.col("error") < 0) | (F.col("warning") < 0) | (F.col("info") < 0)
    counts = trends.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("record_id").isNull() | F.col("commit_sha").isNull()).alias("no_key"),
        F.count_if(F.coalesce(negative, F.lit(True))).alias("bad_counts"),
        F.count_if(F.coalesce(F.col("kloc") <= 0, F.lit(True))).alias("bad_kloc"),
        F.count_if(F.coalesce(F.col("schema_version") < min_version, F.lit(True))).alias("old_version"))
    broken = F.col("no_key") + F.col("bad_counts") + F.col("bad_kloc") + F.col("old_version")
    return counts.withColumn("cold_start", (F.col("records") == 0) | (broken > 0))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(agent, run_id, units, cost, unpriced) from ``usage(agent, run_id, units)`` and ``prices(agent, price)``.

    Usage of an agent without a price has no cost and is marked.
    """
    sums = usage.groupBy("agent", "run_id").agg(F.sum("units").alias("units"))
    cost = F.round(F.col("units") * F.col("price"), 4)
    return sums.join(prices, "agent", "left").select("agent", "run_id", "units", cost.alias("cost"), F.col("price").isNull().alias("unpriced"))


def cost_trend(usage: DataFrame, prices: DataFrame, at: str) -> DataFrame:
    """(agent, month, units, cost, cost_to_date, unpriced): one row per agent and month is left for the window."""
    monthly = usage.groupBy("agent", F.date_trunc("month", F.col(at)).cast("date").alias("month")).agg(F.sum("units").alias("units"))
    priced = monthly.join(prices, "agent", "left").withColumn("cost", F.col("units") * F.col("price"))
    running = F.sum("cost").over(Window.partitionBy("agent").orderBy("month"))
    return priced.select("agent", "month", "units", F.round("cost", 4).alias("cost"),
                         F.round(running, 4).alias("cost_to_date"), F.col("price").isNull().alias("unpriced"))


def gaming_guard(totals_by_period: DataFrame, thresholds: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(period, findings, fell, credited): a fall counts only when the bar did not move.

    Inputs have one row per period: (period, findings), (period, threshold), (period, confirmed).  A period that one of
    them lacks stays; what is not known there credits nothing.  The one window spans the periods, which are few.
    """
    joined = totals_by_period.join(thresholds, "period", "full").join(confirmed, "period", "full")
    window = Window.orderBy("period")
    fell = F.col("findings") < F.lag("findings").over(window)
    steady = (F.col("threshold") == F.lag("threshold").over(window)) & (F.col("confirmed") >= F.lag("confirmed").over(window))
    return joined.select("period", "findings", F.coalesce(fell, F.lit(False)).alias("fell"),
                         F.coalesce(fell & steady, F.lit(False)).alias("credited"))


def time_to_first_value(installs: DataFrame, dispositions: DataFrame, limit_minutes: float = 15.0) -> DataFrame:
    """(subject, minutes, passed): install to the first finding judged actionable after it."""
    installed = installs.groupBy("subject").agg(F.min("at").alias("installed"))
    useful = dispositions.filter("value = 'actionable'").select("subject", F.col("at").alias("judged"))
    first = (installed.join(useful, "subject").filter("judged >= installed").groupBy("subject")
             .agg(F.min(F.timestamp_diff("SECOND", F.col("installed"), F.col("judged"))).alias("seconds")))
    minutes = F.round(F.col("seconds") / 60.0, 6)
    return first.select("subject", minutes.alias("minutes"), (minutes <= limit_minutes).alias("passed"))


class Bar(NamedTuple):
    metric: str
    comparison: str
    bar: float


# The milestone bars.
MILESTONES = [
    Bar("actionable_rate", ">=", 0.7),
    Bar("noise_rate", "<", 0.3),
    Bar("human_issue_recall", ">=", 0.7),
    Bar("miner_acceptance", ">=", 0.6),
    Bar("first_finding_minutes", "<=", 15.0),
]


def milestone_gates(metrics: DataFrame, bars: list[Bar] = MILESTONES) -> DataFrame:
    """(metric, value, comparison, bar, passed) from ``metrics(metric, value)``; an absent metric fails."""
    table = metrics.sparkSession.createDataFrame([tuple(b) for b in bars], "metric string, comparison string, bar double")
    holds = (F.when(F.col("comparison") == ">=", F.col("value") >= F.col("bar")).when(F.col("comparison") == "<=", F.col("value") <= F.col("bar"))
             .when(F.col("comparison") == "<", F.col("value") < F.col("bar")).otherwise(F.col("value") > F.col("bar")))
    return table.join(metrics, "metric", "left").withColumn("passed", F.coalesce(holds, F.lit(False)))


def score_series(scored: DataFrame) -> DataFrame:
    """One row per run and axis, in a fixed order, for a trend view."""
    return scored.select("branch", "axiom", "run_id", "record_id", "score").orderBy("branch", "axiom", "run_id", "record_id")


def moving_scores(scored: DataFrame, k: int, keys: list[str] = ("axiom",), order: list[str] = ("run_id", "record_id"),
                  bucket: Column | None = None) -> DataFrame:
    """Add the mean over the last ``k`` + 1 scores and the mean so far, per axis.

    Ranks, running sums and windows work on pieces of an axis, which may hold a large share of all rows.
    Sums are decimal, so the pieces add up to the same value however they are cut.
    """
    keys, order = list(keys), list(order)
    exact = F.col("score").cast("decimal(18,6)")
    given = scored.columns
    if bucket is None:
        # Pieces are the partitions of a range partitioning: alike in size and in order for ids of any type.
        scored, bucket = scored.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), F.col("_piece")
    ranked = ordered.with_rank(cut_lineage(scored), keys, order, bucket, "_rank").select(*given, "_rank")
    moving = ordered.over_last_rows(ranked, keys, "_rank", k, {"_near": F.sum(exact)})
    running = ordered.with_running_sum(moving, keys, ["_rank"], F.floor(F.col("_rank") / 65536), exact, "_sum")
    mean = lambda total, n: F.round(total.cast("double") / n, 6)
    return (running.withColumn("moving", mean(F.col("_near"), F.least(F.col("_rank"), F.lit(k + 1))))
            .withColumn("mean_so_far", mean(F.col("_sum"), F.col("_rank"))).drop("_rank", "_sum", "_near"))
