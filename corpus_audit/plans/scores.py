"""Score and trend queries; one trend record per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trends
from ..operators.trends import Formula
from ..sources import scopes
from . import inputs as i
from .catalog import query
from .verdicts import BOTH, found_in

_SCORED = i.TRENDS_SQL + """, scored AS (SELECT *, round(greatest(0.0, 100.0 - (error * 10.0 + warning * 3.0 + info * 1.0) / greatest(kloc, 0.1)), 6) AS score FROM trends)"""


def scored(t):
    return trends.score(i.trend_records(t))


_KLOC = """kl AS (SELECT greatest(sum(n) / 1000.0, 0.1)::DOUBLE AS kloc FROM (SELECT path, line, abs(sum(s)) AS n FROM (
SELECT path, unnest(string_split(text, chr(10))) AS line, -1 AS s FROM code UNION ALL SELECT path, unnest(string_split(text, chr(10))), 1 FROM head) GROUP BY path, line)),
dn AS (SELECT axiom, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM cur GROUP BY 1)"""


def _density(t):
    base, head = i.code_files(t), i.head_files(t)
    return trends.density(found_in(head), scopes.changed_kloc(base, head))


@query("trd01_density", i.ctes(*BOTH, _KLOC) + """
SELECT axiom, error, warning, info, kloc, round(error / kloc, 6) AS error_rate, round(warning / kloc, 6) AS warning_rate, round(info / kloc, 6) AS info_rate FROM dn, kl""")
def density(t):
    return _density(t)


@query("trd02_score", i.ctes(*BOTH, _KLOC) + """
SELECT axiom, round(greatest(0.0, 100.0 - (error * 10.0 + warning * 3.0 + info * 1.0) / greatest(kloc, 0.1)), 6) AS score, 'v1' AS formula FROM dn, kl""")
def score(t):
    return trends.score(_density(t)).select("axiom", "score", "formula")


@query("trd02_score_records", i.ctes(_SCORED) + "SELECT record_id, axiom, score FROM scored")
def score_records(t):
    return scored(t).select("record_id", "axiom", "score")


@query("trd03_rescore", i.ctes(i.TRENDS_SQL) + """
SELECT record_id, formula, round(greatest(0.0, 100.0 - (error * we + warning * ww + info * wi) / greatest(kloc, 0.1)), 6) AS score
FROM trends, (VALUES ('v1', 10.0, 3.0, 1.0), ('v2', 20.0, 2.0, 0.5)) f(formula, we, ww, wi)""")
def rescore(t):
    return trends.rescore(i.trend_records(t), [trends.SCORE_V1, Formula("v2", 20.0, 2.0, 0.5)]).select("record_id", "formula", "score")


@query("trd04_dedupe_history", i.ctes(i.TRENDS_SQL) + """
SELECT record_id, r.error, r.warning, r.info FROM (SELECT 'k' || commit_sha % 2000 AS record_id, min({'error': error, 'warning': warning, 'info': info}) AS r FROM trends GROUP BY 1)""")
def dedupe_history(t):
    # Record ids are shortened so that many records carry the same one.
    records = i.trend_records(t).select(F.concat(F.lit("k"), F.col("commit_sha") % 2000).alias("record_id"), "error", "warning", "info")
    return trends.dedupe_history(records)


_RANK = i.COMMITS_SQL + """, gen AS (SELECT sha, 0 AS g FROM commits WHERE parent_sha IS NULL UNION SELECT c.sha, g + 1 FROM gen JOIN commits c ON c.parent_sha = gen.sha),
rk AS (SELECT sha, max(g) AS generation FROM gen GROUP BY 1)"""


@query("trd05_ancestry_rank", i.ctes(_RANK) + "SELECT sha, generation FROM rk")
def ancestry_rank(t):
    return trends.ancestry_rank(i.commits(t))


_DELTA = """dl AS (SELECT record_id, branch, scope, axiom, commit_sha, score, CASE WHEN generation IS NOT NULL THEN lag(score) OVER (PARTITION BY branch, scope, axiom, generation IS NULL ORDER BY generation, record_id) END AS previous,
CASE WHEN generation IS NULL THEN 'unknown commit' ELSE '-' END AS reason FROM scored LEFT JOIN rk ON sha = commit_sha)"""


@query("trd06_deltas", i.ctes(_SCORED, _RANK, _DELTA) + """
SELECT record_id, coalesce(previous, -1) AS previous, coalesce(round(score - previous, 6), 0) AS delta, reason FROM dl""")
def deltas(t):
    moved = trends.deltas(scored(t), trends.ancestry_rank(i.commits(t)))
    return moved.select("record_id", F.coalesce("previous", F.lit(-1.0)).alias("previous"), F.coalesce("delta", F.lit(0.0)).alias("delta"),
                        F.coalesce("reason", F.lit("-")).alias("reason"))


_CLIMB = """climb AS (SELECT record_id, scope, axiom, parent_sha AS at_sha, 1 AS distance FROM dl JOIN commits ON sha = commit_sha WHERE previous IS NULL AND parent_sha IS NOT NULL
UNION SELECT record_id, scope, axiom, parent_sha, distance + 1 FROM climb JOIN commits ON sha = at_sha WHERE parent_sha IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM trends k WHERE k.commit_sha = at_sha AND k.scope = climb.scope AND k.axiom = climb.axiom)),
near AS (SELECT c.record_id, distance, at_sha, s.score FROM climb c JOIN scored s ON s.commit_sha = at_sha AND s.scope = c.scope AND s.axiom = c.axiom)"""


@query("trd06_ancestor_baseline", i.ctes(_SCORED, _RANK, _DELTA, _CLIMB) + """
SELECT record_id, min(distance) AS distance, arg_min(score, (distance, -at_sha)) AS baseline FROM near GROUP BY 1""")
def ancestor_baseline(t):
    records = scored(t)
    first = trends.deltas(records, trends.ancestry_rank(i.commits(t))).filter("previous is null")
    return trends.ancestor_baseline(first, records, i.commits(t))


@query("trd07_trend_label", i.ctes(_SCORED, _RANK, _DELTA) + """
SELECT axiom, CASE WHEN previous IS NULL THEN 'new' WHEN round(score - previous, 6) > 1 THEN 'improving' WHEN round(score - previous, 6) < -1 THEN 'regressing' ELSE 'stable' END AS trend,
count(*) AS records FROM dl GROUP BY 1, 2""")
def trend_label(t):
    labelled = trends.trend_label(trends.deltas(scored(t), trends.ancestry_rank(i.commits(t))))
    return labelled.groupBy("axiom", "trend").agg(F.count(F.lit(1)).alias("records"))


@query("trd08_period_change", i.ctes(i.TRENDS_SQL) + """
SELECT axiom, strftime(p, '%Y-%m-%d') AS period_start, findings, coalesce(round((findings - lag(findings) OVER w) / lag(findings) OVER w, 6), 0) AS change FROM (
SELECT axiom, time_bucket(INTERVAL 14 DAY, recorded_at, TIMESTAMP '1970-01-01') AS p, sum(error + warning + info)::BIGINT AS findings FROM trends GROUP BY 1, 2)
WINDOW w AS (PARTITION BY axiom ORDER BY p)""")
def period_change(t):
    changed = trends.period_change(i.trend_records(t), "recorded_at")
    return changed.select("axiom", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "findings",
                          F.coalesce("change", F.lit(0.0)).alias("change"))


@query("trd09_axis_correlation", i.ctes(i.TRENDS_SQL) + """,
mv AS (SELECT axiom, day, n - lag(n) OVER (PARTITION BY axiom ORDER BY day) AS move FROM (SELECT axiom, recorded_at::DATE AS day, sum(error + warning + info)::BIGINT AS n FROM trends GROUP BY 1, 2))
SELECT a.axiom AS axis_a, b.axiom AS axis_b, count(*) AS days, round(corr(a.move, b.move), 6) AS correlation FROM mv a JOIN mv b ON a.day = b.day AND a.axiom < b.axiom
WHERE a.move IS NOT NULL AND b.move IS NOT NULL GROUP BY 1, 2""")
def axis_correlation(t):
    return trends.axis_correlation(i.trend_records(t), "recorded_at")


@query("trd10_totals", i.ctes(*BOTH) + """
SELECT CASE grouping_id(zone, axiom) WHEN 0 THEN 'zone+axis' WHEN 1 THEN 'zone' ELSE 'all' END AS level, coalesce(zone, '*') AS zone, coalesce(axiom::VARCHAR, '*') AS axiom,
count(*) AS findings FROM (SELECT regexp_extract(path, '^src/([^/]+)/', 1) AS zone, axiom FROM fnd) GROUP BY ROLLUP (zone, axiom)""")
def totals(t):
    zoned = found_in(i.code_files(t)).withColumn("zone", F.regexp_extract("path", "^src/([^/]+)/", 1))
    return trends.totals(zoned)


@query("trd11_validate_history", i.ctes(i.TRENDS_SQL) + """
SELECT count(*) AS records, 0 AS no_key, 0 AS bad_counts, count(*) FILTER (kloc <= 0) AS bad_kloc, count(*) FILTER (axiom < 2) AS old_version,
count(*) = 0 OR count(*) FILTER (kloc <= 0) + count(*) FILTER (axiom < 2) > 0 AS cold_start FROM trends""")
def validate_history(t):
    return trends.validate_history(i.trend_records(t).withColumn("schema_version", F.col("axiom")), min_version=2)


def _usage(t):
    """Model usage: suppliers are agents, orders are runs, quantities are units."""
    usage = t.lineitem.select(F.col("l_suppkey").alias("agent"), F.col("l_orderkey").alias("run_id"), F.col("l_quantity").cast("decimal(12,2)").alias("units"),
                              F.col("l_shipdate").alias("at"))
    # One agent in seven is not on the price list.
    prices = t.supplier.filter("s_suppkey % 7 <> 3").select(F.col("s_suppkey").alias("agent"), F.abs("s_acctbal").cast("decimal(12,2)").alias("price"))
    return usage, prices


@query("trd12_usage_cost", """
SELECT l_suppkey AS agent, l_orderkey AS run_id, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS units, coalesce((sum(l_quantity::DECIMAL(12,2)) * (abs(any_value(s_acctbal))::DECIMAL(12,2)))::DOUBLE, -1) AS cost,
any_value(s_acctbal) IS NULL AS unpriced FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 7 <> 3 GROUP BY 1, 2""")
def usage_cost(t):
    return trends.usage_cost(*_usage(t)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in ("units", "cost")})


@query("trd12_cost_trend", """
SELECT agent, strftime(month, '%Y-%m') AS month, units::DOUBLE AS units, coalesce(cost::DOUBLE, -1) AS cost, coalesce((sum(cost) OVER (PARTITION BY agent ORDER BY month))::DOUBLE, -1) AS cost_to_date, cost IS NULL AS unpriced FROM (
SELECT l_suppkey AS agent, date_trunc('month', l_shipdate) AS month, sum(l_quantity::DECIMAL(12,2)) AS units, sum(l_quantity::DECIMAL(12,2)) * (abs(any_value(s_acctbal))::DECIMAL(12,2)) AS cost
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 7 <> 3 GROUP BY 1, 2)""")
def cost_trend(t):
    trend = trends.cost_trend(*_usage(t), "at").withColumn("month", F.date_format("month", "yyyy-MM"))
    return trend.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in ("units", "cost", "cost_to_date")})


@query("trd13_gaming_guard", """
SELECT period, findings, coalesce(findings < lag(findings) OVER w, false) AS fell,
coalesce(findings < lag(findings) OVER w AND threshold = lag(threshold) OVER w AND confirmed >= lag(confirmed) OVER w, false) AS credited FROM (
SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) FILTER (event_type = 'error') AS findings, max(regexp_extract(props, '[0-9]+')::INT) // 2 AS threshold,
count(*) FILTER (event_type = 'purchase') AS confirmed FROM events GROUP BY 1) WINDOW w AS (ORDER BY period)""")
def gaming_guard(t):
    daily = t.events.withColumn("period", F.date_format("ts", "yyyy-MM-dd")).groupBy("period")
    found = daily.agg(F.count_if(F.col("event_type") == "error").alias("findings"))
    bar = daily.agg(F.floor(F.max(F.regexp_extract("props", "[0-9]+", 0).cast("int")) / 2).alias("threshold"))
    confirmed = daily.agg(F.count_if(F.col("event_type") == "purchase").alias("confirmed"))
    return trends.gaming_guard(found, bar, confirmed)


@query("trd14_time_to_first_value", """
WITH i AS (SELECT user_id AS subject, min(ts) AS installed FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT subject, round(s / 60.0, 6) AS minutes, round(s / 60.0, 6) <= 15 AS passed FROM (
SELECT subject, min(epoch_us(ts) - epoch_us(installed)) // 1000000 AS s FROM i JOIN events ON user_id = subject AND event_type = 'purchase' AND ts >= installed GROUP BY 1)""")
def time_to_first_value(t):
    installs = t.events.filter("event_type = 'signup'").select(F.col("user_id").alias("subject"), F.col("ts").alias("at"))
    judged = t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("subject"), F.col("ts").alias("at"), F.lit("actionable").alias("value"))
    return trends.time_to_first_value(installs, judged)


@query("trd15_milestone_gates", """
WITH m AS (SELECT 'actionable_rate' AS metric, round(avg(quality), 6) AS value FROM labels UNION ALL SELECT 'noise_rate', round(1 - avg(quality), 6) FROM labels
UNION ALL SELECT 'human_issue_recall', round(avg((role = 'user')::INT), 6) FROM conversations)
SELECT metric, comparison, bar, coalesce(value, -1) AS value, coalesce(CASE comparison WHEN '>=' THEN value >= bar WHEN '<=' THEN value <= bar ELSE value < bar END, false) AS passed
FROM (VALUES ('actionable_rate', '>=', 0.7), ('noise_rate', '<', 0.3), ('human_issue_recall', '>=', 0.7), ('miner_acceptance', '>=', 0.6), ('first_finding_minutes', '<=', 15.0)) b(metric, comparison, bar)
LEFT JOIN m USING (metric)""")
def milestone_gates(t):
    good = t.labels.agg(F.avg("quality").alias("g"))
    metrics = (good.select(F.lit("actionable_rate").alias("metric"), F.round("g", 6).alias("value"))
               .unionByName(good.select(F.lit("noise_rate").alias("metric"), F.round(1 - F.col("g"), 6).alias("value")))
               .unionByName(t.conversations.agg(F.lit("human_issue_recall").alias("metric"),
                                                F.round(F.avg((F.col("role") == "user").cast("double")), 6).alias("value"))))
    return trends.milestone_gates(metrics).withColumn("value", F.coalesce("value", F.lit(-1.0)))


@query("trd16_score_series", i.ctes(_SCORED) + "SELECT branch, axiom, run_id, record_id, score FROM scored ORDER BY ALL")
def score_series(t):
    return trends.score_series(scored(t))


@query("trd17_moving_scores", i.ctes(_SCORED) + """
SELECT record_id, round((sum(x) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))::DOUBLE / least(row_number() OVER w, 5), 6) AS moving,
round((sum(x) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE / row_number() OVER w, 6) AS mean_so_far FROM (SELECT *, score::DECIMAL(18,6) AS x FROM scored)
WINDOW w AS (PARTITION BY axiom ORDER BY run_id, record_id)""")
def moving_scores(t):
    return trends.moving_scores(scored(t), 4).select("record_id", "moving", "mean_so_far")
