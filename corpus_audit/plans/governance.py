"""Convention queries.

The ledger is derived from ``part`` (one entry each), its current incidence from ``lineitem``, the
evidence trail from ``conversations`` and observations from ``orders`` and the derived source files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conventions, duplicates, graph
from . import inputs as i
from .catalog import query
from .graphs import GRAPH, module_edges, zoned

from .maps import _BAD, changed_paths

_STATUS = "CASE p_size % 5 WHEN 0 THEN 'proposed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'waning' WHEN 3 THEN 'superseded' ELSE 'rejected' END"
_LEDGER_COLUMNS = f"""'c' || p_partkey AS convention_id, CASE WHEN p_size > 45 THEN 'anti-convention' ELSE 'convention' END AS kind, p_type AS sub_category,
p_brand AS family, p_name AS pattern, {_STATUS} AS status, CASE WHEN p_size < 30 AND p_partkey > 0 THEN 'c' || (p_partkey - 1) END AS replaces,
p_size % 2 = 0 AS override_cleanliness, p_size / 60.0 AS confirmed_incidence, p_size % 4 AS rejections"""
LEDGER = f"ledger AS (SELECT {_LEDGER_COLUMNS} FROM part)"
CURRENT = "cur AS (SELECT 'c' || l_partkey AS convention_id, avg((l_returnflag = 'A')::INT::DOUBLE) AS incidence FROM lineitem GROUP BY 1)"
EVIDENCE = """ev AS (SELECT conv_id || '-' || turn AS id, 'c' || conv_id AS convention_id, CASE turn % 3 WHEN 0 THEN 'pr-comment' WHEN 1 THEN 'adr' ELSE 'elicitation' END AS type,
role AS author, turn AS at_turn, CASE length(text) % 2 WHEN 0 THEN 'for' ELSE 'against' END AS stance, length(text) AS snippet FROM conversations)"""


def ledger(t):
    # In Spark 60.0 is a decimal, which would cut the quotient to six digits; an entry at just half its incidence would then fade.
    return t.part.selectExpr(*[column.replace("60.0", "60.0D") for column in i.split_ctes(_LEDGER_COLUMNS)])


def current(t):
    return t.lineitem.groupBy(F.concat(F.lit("c"), "l_partkey").alias("convention_id")).agg(
        F.avg((F.col("l_returnflag") == "A").cast("double")).alias("incidence"))


def evidence(t):
    kind = F.when(F.col("turn") % 3 == 0, "pr-comment").when(F.col("turn") % 3 == 1, "adr").otherwise("elicitation")
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("c"), "conv_id").alias("convention_id"), kind.alias("type"),
        F.col("role").alias("author"), F.col("turn").alias("at"),
        F.when(F.length("text") % 2 == 0, "for").otherwise("against").alias("stance"), F.length("text").alias("snippet"))


def bots(t):
    return t.conversations.filter("role <> 'user'").select(F.col("role").alias("author"))


def order_observations(t):
    return t.orders.select(F.lit("all").alias("zone"), F.col("o_orderpriority").alias("pattern"), F.col("o_orderkey").alias("entity"),
                           (F.col("o_orderstatus") == "F").alias("conforms"), F.col("o_orderdate").alias("at"))


# Name, who is eligible, who conforms.
PATTERNS = {
    "house-button": (r"<button|import \{ Button \}", r"import \{ Button \}"),
    "guarded-route": (r"router\.get", r"requireAuth"),
    "released-timer": (r"setInterval", r"clearInterval"),
}
_OBS = "obs AS (" + " UNION ALL ".join(
    f"SELECT zone, '{name}' AS pattern, path AS entity, regexp_matches(text, '{conforming}') AS conforms FROM code WHERE regexp_matches(text, '{eligible}')"
    for name, (eligible, conforming) in PATTERNS.items()) + ")"


@query("cnv01_incidence", i.ctes(i.CODE_SQL, _OBS) + "SELECT zone, pattern, count(*) AS eligible, round(avg(conforms::INT::DOUBLE), 6) AS incidence FROM obs GROUP BY 1, 2")
def incidence(t):
    return conventions.incidence(conventions.pattern_observations(i.code_files(t), PATTERNS))


@query("cnv02_incidence_trend", """
SELECT pattern, months, slope, CASE WHEN slope > 0.005 THEN 'rising' WHEN slope < -0.005 THEN 'falling' ELSE 'flat' END AS trend FROM (
SELECT pattern, count(*) AS months, round(regr_slope(incidence, m::DOUBLE), 6) AS slope FROM (SELECT o_orderpriority AS pattern, year(o_orderdate) * 12 + month(o_orderdate) AS m,
avg((o_orderstatus = 'F')::INT::DOUBLE) AS incidence FROM orders WHERE year(o_orderdate) * 12 + month(o_orderdate) BETWEEN 2001 * 12 + 7 - 5 AND 2001 * 12 + 7 GROUP BY 1, 2) GROUP BY 1)""")
def incidence_trend(t):
    return conventions.incidence_trend(order_observations(t), "at", "2001-07-31")


@query("cnv03_lifespan", """
SELECT o_orderpriority AS pattern, round(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) / 30.0, 6) AS lifespan_months,
round(date_diff('day', max(o_orderdate)::DATE, DATE '2001-12-31') / 30.0, 6) AS recency_months, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) >= 90 AS established
FROM orders GROUP BY 1""")
def lifespan(t):
    return conventions.lifespan(order_observations(t), "at", "2001-12-31")


_SHOWN = r"""shown AS (SELECT lang AS zone, path AS entity, 'head:' || line AS pattern FROM pl WHERE line_no = 1 UNION ALL
SELECT lang, path, 'line:' || line FROM pl WHERE regexp_matches(line, '(?i)licen[sc]e') UNION ALL SELECT lang, path, 'tail:' || arg_max(line, line_no) FROM pl GROUP BY 1, 2)"""


def shown_patterns(t):
    """Header line, footer line and licence lines a document shows."""
    from ..functions import text as tx
    lines = tx.lines_of(F.col("text"))
    licence = F.transform(F.filter(lines, lambda x: x.rlike("(?i)licen[sc]e")), lambda x: F.concat(F.lit("line:"), x))
    patterns = F.concat(F.array(F.concat(F.lit("head:"), lines[0]), F.concat(F.lit("tail:"), F.element_at(lines, -1))), licence)
    return i.prose_files(t).select(F.col("lang").alias("zone"), F.col("path").alias("entity"), F.explode(patterns).alias("pattern"))


@query("cnv04_mine", i.ctes(i.PROSE_LINES_SQL, _SHOWN) + """
SELECT zone, pattern, support, round(support / n, 6) AS share FROM (SELECT zone, pattern, count(DISTINCT entity) AS support FROM shown GROUP BY 1, 2)
JOIN (SELECT zone, count(DISTINCT entity) AS n FROM shown GROUP BY 1) USING (zone) WHERE support >= 3 AND round(support / n, 6) >= 0.005""")
def mine(t):
    return conventions.mine(shown_patterns(t), 3, 0.005)


_CAND = """cand AS (SELECT 'c' || p.p_partkey AS convention_id, p_type AS sub_category, p_brand AS family, p_name AS pattern, incidence, author_spread, lifespan_days FROM part p JOIN
(SELECT l_partkey, round(avg((l_returnflag = 'A')::INT::DOUBLE), 6) AS incidence, count(DISTINCT l_suppkey) AS author_spread,
date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE) AS lifespan_days FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey)"""


def candidates(t):
    """Candidates: parts as patterns, line items as their uses, suppliers as authors."""
    uses = t.lineitem.groupBy("l_partkey").agg(
        F.round(F.avg((F.col("l_returnflag") == "A").cast("double")), 6).alias("incidence"), F.countDistinct("l_suppkey").alias("author_spread"),
        F.date_diff(F.max("l_shipdate").cast("date"), F.min("l_shipdate").cast("date")).alias("lifespan_days"))
    return t.part.join(uses, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("c"), "p_partkey").alias("convention_id"), F.col("p_type").alias("sub_category"), F.col("p_brand").alias("family"),
        F.col("p_name").alias("pattern"), "incidence", "author_spread", "lifespan_days")


@query("cnv05_evidence_bar", i.ctes(_CAND) + """
SELECT convention_id, incidence, author_spread, lifespan_days, 'proposed' AS status FROM cand WHERE incidence >= 0.35 AND author_spread >= 2 AND lifespan_days >= 90""")
def evidence_bar(t):
    return conventions.evidence_bar(candidates(t), 0.35).select("convention_id", "incidence", "author_spread", "lifespan_days", "status")


@query("cnv06_drop_rejected", i.ctes(_CAND, LEDGER) + """
SELECT convention_id, sub_category, pattern FROM cand WHERE (sub_category, pattern) NOT IN (SELECT sub_category, pattern FROM ledger WHERE status = 'rejected')""")
def drop_rejected(t):
    return conventions.drop_rejected(candidates(t), ledger(t)).select("convention_id", "sub_category", "pattern")


@query("cnv07_damped", i.ctes(_CAND, LEDGER) + """
SELECT convention_id, needed, incidence >= needed AS passes FROM (SELECT convention_id, incidence, round(least(0.1 * pow(2, coalesce(n, 0)), 0.95), 6) AS needed FROM cand
LEFT JOIN (SELECT family, max(rejections) AS n FROM ledger WHERE status = 'rejected' GROUP BY 1) USING (family))""")
def damped(t):
    rejected = ledger(t).filter("status = 'rejected'").groupBy("family").agg(F.max("rejections").alias("rejections"))
    return conventions.damped(candidates(t), rejected, 0.1).select("convention_id", "needed", "passes")


_INTENT = """intent AS (SELECT convention_id, items, kinds, round(least(1.0, items * 0.1 + kinds * 0.3), 6) AS intent FROM (
SELECT convention_id, count(*) AS items, count(DISTINCT type) AS kinds FROM ev WHERE author = 'user' GROUP BY 1))"""


@query("cnv08_quadrants", i.ctes(_CAND, EVIDENCE, _INTENT) + """
SELECT convention_id, CASE WHEN incidence >= 0.35 AND intent >= 0.5 THEN 'convention' WHEN incidence >= 0.35 THEN 'ambiguous' WHEN intent >= 0.5 THEN 'aspiration' ELSE 'noise' END AS quadrant
FROM (SELECT convention_id, incidence, coalesce(intent, 0) AS intent FROM cand LEFT JOIN intent USING (convention_id))""")
def quadrants(t):
    intent = conventions.intent_score(conventions.human_evidence(evidence(t), bots(t))).select("convention_id", "intent")
    scored = candidates(t).join(intent, "convention_id", "left").fillna(0.0, ["intent"])
    return conventions.quadrants(scored, 0.35, 0.5).select("convention_id", "quadrant")


@query("cnv09_human_evidence", i.ctes(EVIDENCE) + "SELECT id, convention_id, type FROM ev WHERE author = 'user'")
def human_evidence(t):
    return conventions.human_evidence(evidence(t), bots(t)).select("id", "convention_id", "type")


@query("cnv10_intent_score", i.ctes(EVIDENCE, _INTENT) + "SELECT *, CASE WHEN intent >= 0.8 THEN 'high' WHEN intent >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM intent")
def intent_score(t):
    return conventions.intent_score(conventions.human_evidence(evidence(t), bots(t)))


@query("cnv11_contradictions", i.ctes(EVIDENCE) + """
SELECT convention_id, stance, id, CASE WHEN won IS NULL THEN 'open' WHEN won = stance THEN 'upheld' ELSE 'overruled' END AS resolution FROM ev
LEFT JOIN (SELECT convention_id, max(stance) AS won FROM ev WHERE author = 'system' GROUP BY 1) USING (convention_id)
WHERE convention_id IN (SELECT convention_id FROM ev GROUP BY 1 HAVING count(DISTINCT stance) > 1)""")
def contradictions(t):
    rulings = evidence(t).filter("author = 'system'").groupBy("convention_id").agg(F.max("stance").alias("stance"))
    return conventions.contradictions(evidence(t), rulings).select("convention_id", "stance", "id", "resolution")


_DECISIONS = """dec AS (SELECT convention_id, arg_max(decision, event_id) AS decision, max(event_id) AS at_id FROM (
SELECT 'c' || (event_id // 4) AS convention_id, event_id, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' ELSE 'defer' END AS decision FROM events) GROUP BY 1)"""


def decisions(t):
    word = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").otherwise("defer")
    return t.events.select(F.concat(F.lit("c"), F.floor(F.col("event_id") / 4).cast("string")).alias("convention_id"), word.alias("decision"),
                           F.col("event_id").alias("at"), F.concat(F.lit("u"), "user_id").alias("by"))


@query("cnv12_curate", i.ctes(LEDGER, _DECISIONS) + """
SELECT convention_id, CASE WHEN status = 'proposed' AND decision = 'accept' THEN 'confirmed' WHEN status = 'proposed' AND decision = 'reject' THEN 'rejected' ELSE status END AS status,
rejections + (status = 'proposed' AND coalesce(decision, '') = 'reject')::INT AS rejections, CASE WHEN status = 'proposed' AND decision IN ('accept', 'reject') THEN at_id ELSE -1 END AS decided_at
FROM ledger LEFT JOIN dec USING (convention_id)""")
def curate(t):
    own = ledger(t)
    return conventions.curate(own, own.filter("status = 'proposed'"), decisions(t)).select(
        "convention_id", "status", "rejections", F.coalesce("decided_at", F.lit(-1)).alias("decided_at"))


@query("cnv13_decay", i.ctes(LEDGER, CURRENT) + """
SELECT convention_id, CASE WHEN status = 'confirmed' AND coalesce(incidence, 0) < 0.5 * confirmed_incidence THEN 'waning' ELSE status END AS status FROM ledger LEFT JOIN cur USING (convention_id)""")
def decay(t):
    return conventions.decay(ledger(t), current(t)).select("convention_id", "status")


_CHAIN = """lk AS (SELECT replaces AS old, max(convention_id) AS newer FROM ledger WHERE status = 'confirmed' AND replaces IS NOT NULL GROUP BY 1),
ch AS (SELECT old, newer AS top, 1 AS d FROM lk UNION ALL SELECT ch.old, lk.newer, d + 1 FROM ch JOIN lk ON lk.old = ch.top)"""


@query("cnv14_supersede", i.ctes(LEDGER, _CHAIN) + """
SELECT convention_id, CASE WHEN lk.newer IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(lk.newer, '-') AS superseded_by, coalesce(newest, convention_id) AS newest
FROM ledger LEFT JOIN lk ON lk.old = convention_id LEFT JOIN (SELECT old, arg_max(top, d) AS newest FROM ch GROUP BY 1) n ON n.old = convention_id""")
def supersede(t):
    return conventions.supersede(ledger(t)).withColumn("superseded_by", F.coalesce("superseded_by", F.lit("-")))


_MOVES = "(VALUES " + ", ".join(str(m) for m in conventions.TRANSITIONS) + ")"


@query("cnv15_illegal_transitions", i.ctes(LEDGER) + f"""
SELECT convention_id, from_status, to_status, actor FROM (SELECT convention_id, status AS from_status,
CASE rejections WHEN 0 THEN 'waning' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'rejected' ELSE status END AS to_status, CASE WHEN override_cleanliness THEN 'human' ELSE 'auto' END AS actor FROM ledger)
WHERE from_status <> to_status AND (from_status, to_status, actor) NOT IN (SELECT * FROM {_MOVES} m)""")
def illegal_transitions(t):
    before = ledger(t)
    moved = (F.when(F.col("rejections") == 0, "waning").when(F.col("rejections") == 1, "confirmed").when(F.col("rejections") == 2, "rejected")
             .otherwise(F.col("status")))
    after = before.select("convention_id", moved.alias("status"), F.when(F.col("override_cleanliness"), "human").otherwise("auto").alias("actor"))
    return conventions.illegal_transitions(before, after)


@query("cnv16_digest", i.ctes(LEDGER, EVIDENCE) + """
SELECT convention_id, count(id) OVER (PARTITION BY convention_id) AS items, coalesce(id, '-') AS id, coalesce(type, '-') AS type FROM (SELECT convention_id FROM ledger WHERE status = 'proposed') LEFT JOIN ev USING (convention_id)""")
def digest(t):
    listed = conventions.digest(ledger(t).filter("status = 'proposed'"), evidence(t))
    return listed.select("convention_id", "items", F.coalesce("id", F.lit("-")).alias("id"), F.coalesce("type", F.lit("-")).alias("type"))


@query("cnv16_nudge", i.ctes(LEDGER) + "SELECT count(*) AS pending, 27 AS days, count(*) >= 10 AS nudge FROM ledger WHERE status = 'proposed'")
def nudge(t):
    return conventions.nudge(ledger(t).filter("status = 'proposed'"), "2024-01-01", "2024-01-28")


_TOGGLES = "tg AS (SELECT DISTINCT p_type AS sub_category, CASE p_type WHEN 'ECONOMY' THEN 'blocking' WHEN 'SMALL' THEN 'off' ELSE 'advisory' END AS level FROM part)"


@query("cnv17_enforceable", i.ctes(LEDGER, _TOGGLES) + """
SELECT convention_id, CASE WHEN status = 'waning' THEN 'advisory' ELSE level END AS enforced_as FROM ledger JOIN tg USING (sub_category) WHERE status IN ('confirmed', 'waning') AND level <> 'off'""")
def enforceable(t):
    level = F.when(F.col("p_type") == "ECONOMY", "blocking").when(F.col("p_type") == "SMALL", "off").otherwise("advisory")
    toggles = t.part.select(F.col("p_type").alias("sub_category"), level.alias("level")).distinct()
    return conventions.enforceable(ledger(t), toggles).select("convention_id", "enforced_as")


_NAMING = "nm(kind, shape) AS (VALUES ('tsx', '^[A-Z][A-Za-z0-9]*$'), ('ts', '^[a-z]+_[0-9]+$'), ('js', '^doc_[1-9][0-9]{0,1}$'))"


@query("cnv18_check_naming", i.ctes(i.CODE_SQL, _NAMING) + r"""
SELECT path AS entity, kind, shape AS expected FROM (SELECT path, regexp_extract(path, '\.([a-z]+)$', 1) AS kind, regexp_extract(path, '([^/]+)\.[a-z]+$', 1) AS name FROM code)
JOIN nm USING (kind) WHERE NOT regexp_matches(name, shape)""")
def check_naming(t):
    naming = t.spark.createDataFrame([("tsx", "^[A-Z][A-Za-z0-9]*$"), ("ts", "^[a-z]+_[0-9]+$"), ("js", "^doc_[1-9][0-9]{0,1}$")], "kind string, shape string")
    entities = i.code_files(t).select(F.col("path").alias("entity"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"),
                                      F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).alias("name"))
    return conventions.check_naming(entities, naming)


@query("cnv19_check_import_source", i.ctes(*GRAPH) + """
SELECT src, spec, CASE spec WHEN 'axios' THEN '@house/http' ELSE '@house/view' END AS use_instead FROM edges WHERE spec IN ('axios', 'react')""")
def check_import_source(t):
    banned = t.spark.createDataFrame([("axios", "@house/http", "c1"), ("react", "@house/view", "c2")], "source string, use_instead string, convention_id string")
    return conventions.check_import_source(graph.extract_edges(i.code_files(t)), banned).select("src", "spec", "use_instead")


@query("cnv20_check_registry", i.ctes(i.CODE_LINES_SQL) + r"""
SELECT DISTINCT path, line_no AS line_start, tok AS primitive, CASE tok WHEN '<button' THEN 'Button' WHEN '<td' THEN 'Cell' ELSE 'useTimer' END AS component FROM (
SELECT path, line_no, unnest(regexp_extract_all(line, '</?[A-Za-z]+|[A-Za-z_.]+\(')) AS tok FROM sl) WHERE tok IN ('<button', '<td', 'setInterval(')""")
def check_registry(t):
    registry = t.spark.createDataFrame([("<button", "Button"), ("<td", "Cell"), ("setInterval(", "useTimer")], "primitive string, component string")
    return conventions.check_registry(i.code_files(t), registry)


@query("cnv21_placement_leak", i.ctes(*GRAPH) + r"""
SELECT module, fan_in, count(DISTINCT w) AS terms FROM (SELECT path AS module, fan_in, unnest(regexp_split_to_array(lower(text), '[^\p{L}0-9]+')) AS w FROM code JOIN (
SELECT * FROM (SELECT module, fi AS fan_in, quantile_cont(fi, 0.9) OVER () AS bar FROM (SELECT module, sum(a)::BIGINT AS fi FROM (SELECT dst AS module, 1 AS a FROM e UNION ALL SELECT src, 0 FROM e) GROUP BY 1)) WHERE fan_in >= bar) ON path = module)
WHERE w IN ('tenantid', 'user', 'admin', 'legacy', 'md5') GROUP BY 1, 2""")
def placement_leak(t):
    vocabulary = t.spark.createDataFrame([(w,) for w in ("tenantid", "user", "admin", "legacy", "md5")], "term string")
    fan_in = graph.fan_in_out(module_edges(t)[0]).select("module", "fan_in")
    return conventions.placement_leak(fan_in, i.code_files(t), vocabulary)


@query("cnv22_placement_layer", i.ctes(*GRAPH) + rf"""
SELECT path, zone, complexity, zone_median FROM (SELECT *, quantile_cont(complexity, 0.5) OVER (PARTITION BY zone) AS zone_median FROM (
SELECT path, zn.zone, len(regexp_extract_all(text, '{duplicates.BRANCH}')) + 1 AS complexity FROM code JOIN zn USING (path) WHERE role = 'thin')) WHERE complexity > 2 * zone_median""")
def placement_layer(t):
    return conventions.placement_layer(i.code_files(t), zoned(t))


@query("cnv23_deviations", i.ctes(i.CODE_SQL, _BAD) + r"""
, sh AS (SELECT path, zone, regexp_extract(path, '\.([a-z]+)$', 1) AS shape FROM code),
us AS (SELECT zone, arg_min(shape, (-n, shape)) AS usual, round(max(n) / sum(n), 6) AS share FROM (SELECT zone, shape, count(*) AS n FROM sh GROUP BY 1, 2) GROUP BY 1)
SELECT path, zone, shape, usual, share FROM sh JOIN us USING (zone) WHERE shape <> usual AND share >= 0.5 AND path IN (SELECT path FROM bad)""")
def deviations(t):
    entities = i.code_files(t).select("path", "zone", F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("shape"))
    return conventions.deviations(entities, changed_paths(t)).select("path", "zone", "shape", "usual", "share")


@query("cnv24_anti_spread", i.ctes(i.CODE_SQL, _BAD) + """
SELECT path, CASE WHEN path IN (SELECT path FROM bad) THEN 'flagged' ELSE 'known debt' END AS verdict FROM code WHERE text LIKE '%eval(%'""")
def anti_spread(t):
    matches = i.code_files(t).filter(F.col("text").contains("eval(")).select("path", F.lit("c1").alias("convention_id"))
    return conventions.anti_spread(matches, changed_paths(t)).select("path", "verdict")


_EXEMPLARS = """exm AS (SELECT 'c' || (event_id // 8) AS convention_id, entity, event_id AS rank, CASE kind WHEN 'error' THEN 'orphaned' WHEN 'view' THEN 'orphaned' ELSE 'derived' END AS status FROM history)"""


@query("cnv25_cite", i.ctes(LEDGER, i.HISTORY_SQL, _EXEMPLARS) + """
SELECT convention_id, coalesce(exemplar, '-') AS exemplar, CASE WHEN exemplar IS NOT NULL THEN '-' WHEN convention_id IN (SELECT convention_id FROM exm) THEN 'exemplar gone' ELSE 'no exemplar' END AS dropped_reason
FROM ledger LEFT JOIN (SELECT convention_id, 'corpus://' || arg_min(entity, rank) AS exemplar FROM exm WHERE status = 'derived' GROUP BY 1) USING (convention_id)""")
def cite(t):
    h = i.history(t)
    exemplars = h.select(F.concat(F.lit("c"), F.floor(F.col("event_id") / 8).cast("string")).alias("convention_id"), "entity", F.col("event_id").alias("rank"),
                         F.when(F.col("kind").isin("error", "view"), "orphaned").otherwise("derived").alias("status"))
    cited = conventions.cite(ledger(t).select("convention_id"), exemplars)
    return cited.select("convention_id", F.coalesce("exemplar", F.lit("-")).alias("exemplar"), F.coalesce("dropped_reason", F.lit("-")).alias("dropped_reason"))


_ARB = """fd AS (SELECT 'f' || doc_id AS finding_id, path, CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 6 ELSE 5 END AS axiom, 'warning' AS severity, CASE lang WHEN 'de' THEN 'c' || doc_id END AS convention_id FROM code),
cf AS (SELECT path, 'c' || (doc_id // 2) AS convention_id FROM code),
mk AS (SELECT path, bool_or(override_cleanliness AND kind = 'convention') AS intended, bool_or(kind = 'anti-convention') AS debt FROM cf JOIN ledger USING (convention_id) GROUP BY 1)"""


@query("cnv26_arbitrate", i.ctes(i.CODE_SQL, LEDGER, _ARB) + """
SELECT finding_id, CASE WHEN axiom = 3 AND coalesce(intended, false) THEN 'suppressed' WHEN axiom = 3 AND coalesce(debt, false) THEN 'known debt'
WHEN axiom = 6 AND NOT coalesce(l.override_cleanliness, true) THEN 'suppressed' ELSE 'kept' END AS arbitration,
CASE WHEN axiom = 3 AND NOT coalesce(intended, false) AND coalesce(debt, false) THEN 'info' ELSE severity END AS severity
FROM fd LEFT JOIN mk USING (path) LEFT JOIN ledger l ON l.convention_id = fd.convention_id""")
def arbitrate(t):
    files = i.code_files(t)
    axiom = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "de", 6).otherwise(5)
    own = F.when(F.col("lang") == "de", F.concat(F.lit("c"), "doc_id"))
    found = files.select(F.concat(F.lit("f"), "doc_id").alias("finding_id"), "path", axiom.alias("axiom"), F.lit("warning").alias("severity"), own.alias("convention_id"))
    conforming = files.select("path", F.concat(F.lit("c"), F.floor(F.col("doc_id") / 2).cast("string")).alias("convention_id"))
    return conventions.arbitrate(found, ledger(t), conforming).select("finding_id", "arbitration", "severity")


@query("cnv27_ledger_health", i.ctes(LEDGER, CURRENT) + """
SELECT status, entries, entries || ' entries, incidence ' || CASE WHEN change > 0.01 THEN 'up' WHEN change < -0.01 THEN 'down' ELSE 'steady' END AS summary, change FROM (
SELECT status, count(*) AS entries, round(avg(incidence - confirmed_incidence), 4) AS change FROM ledger LEFT JOIN cur USING (convention_id) GROUP BY 1)""")
def ledger_health(t):
    return conventions.ledger_health(ledger(t), current(t))


@query("cnv28_conformance_tier", "SELECT (SELECT count(*) FROM documents) AS entities, count(*) AS entries, 'T1 full' AS tier FROM part")
def conformance_tier(t):
    entities = i.code_files(t).select(F.col("path").alias("entity"))
    return conventions.conformance_tier(entities, ledger(t))
