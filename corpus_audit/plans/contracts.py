"""Specification, configuration, user-defined and streaming queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import config_documents, detectors, duplicates, layered, pack_index, packs, rules, specs, table_detectors
from ..streaming import jobs, live
from . import inputs as i
from .catalog import query
from .graphs import GRAPH, module_edges
from .inputs import sql_text
from .maps import _BAD, changed_paths
from .scans import PROSE_CODE, hits_sql
from .verdicts import BASE, found_in

# Every conversation is a spec and every turn a criterion, worded by its role and length.
ACS = """acs AS (SELECT conv_id AS spec_id, turn AS ac_id, CASE role WHEN 'user' THEN 'value' || (length(text) % 400) || ' is returned within ' || length(text) || ' ms'
WHEN 'assistant' THEN 'pick' || (length(text) % 400) || ' should be fast and work well' ELSE 'value' || (length(text) % 400) || ' exists' END AS text,
turn % 2 = 0 AS tested, turn = 0 AS critical FROM conversations)"""


def acs(t):
    n = F.length("text")
    name = (n % 400).cast("string")
    text = (F.when(F.col("role") == "user", F.concat(F.lit("value"), name, F.lit(" is returned within "), n, F.lit(" ms")))
            .when(F.col("role") == "assistant", F.concat(F.lit("pick"), name, F.lit(" should be fast and work well")))
            .otherwise(F.concat(F.lit("value"), name, F.lit(" exists"))))
    refs = F.when(F.col("turn") % 2 == 0, F.array(F.lit("tests/a"))).otherwise(F.expr("cast(array() as array<string>)"))
    return t.conversations.select(F.col("conv_id").alias("spec_id"), F.col("turn").alias("ac_id"), text.alias("text"),
                                  refs.alias("test_refs"), (F.col("turn") == 0).alias("critical"))


_VALID = f"""va AS (SELECT *, reason = 'quantified' AS passed FROM (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(text, {sql_text(specs.QUANTIFIED)}) THEN 'quantified'
WHEN regexp_matches(text, {sql_text(specs.VAGUE)}) THEN 'vague: ' || lower(regexp_extract(text, {sql_text(specs.VAGUE)}, 1)) ELSE 'no measurable bound' END AS reason FROM acs))"""
_BIND = r"""scope AS (SELECT path AS module, 0 AS d FROM bad UNION SELECT e.dst, d + 1 FROM scope JOIN e ON e.src = module WHERE d < 2),
ex AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, 'export (?:const|function) ([A-Za-z0-9_]+)', 1)) AS symbol FROM code WHERE path IN (SELECT module FROM scope)),
bd AS (SELECT DISTINCT spec_id, ac_id, symbol, path FROM (SELECT spec_id, ac_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS symbol FROM acs) JOIN ex USING (symbol))"""
BIND = (*GRAPH, _BAD, ACS, _BIND)


def bindings(t):
    changed = changed_paths(t).withColumnRenamed("path", "module")
    return specs.bind(acs(t), duplicates.exports(i.code_files(t)), module_edges(t)[0], changed, 2)


@query("spc01_validate_acs", i.ctes(ACS, _VALID) + "SELECT spec_id, ac_id, passed, reason FROM va")
def validate_acs(t):
    return specs.validate_acs(acs(t)).select("spec_id", "ac_id", "passed", "reason")


@query("spc02_spec_gate", i.ctes(ACS, _VALID) + """
SELECT spec_id, count(*) AS criteria, count(*) FILTER (NOT passed) AS failures, bool_and(passed) AS passed FROM va GROUP BY 1""")
def spec_gate(t):
    return specs.spec_gate(specs.validate_acs(acs(t)))


@query("spc03_missing_fields", """
SELECT spec_id, missing, 'missing_field:' || missing AS error FROM (SELECT DISTINCT conv_id AS spec_id FROM conversations), (VALUES ('system'), ('user'), ('assistant')) r(missing)
WHERE (spec_id, missing) NOT IN (SELECT conv_id, role FROM conversations)""")
def missing_fields(t):
    fields = t.conversations.select(F.col("conv_id").alias("spec_id"), F.col("role").alias("field"))
    return specs.missing_fields(fields, ["system", "user", "assistant"])


@query("spc04_bind", i.ctes(*BIND) + "SELECT * FROM bd")
def bind(t):
    return bindings(t)


@query("spc05_unbound", i.ctes(*BIND) + """
SELECT 'spec/' || spec_id AS path, ac_id::VARCHAR AS symbol, 2 AS axiom FROM acs WHERE (spec_id, ac_id) NOT IN (SELECT spec_id, ac_id FROM bd)""")
def unbound(t):
    return specs.unbound(acs(t), bindings(t)).select("path", "symbol", "axiom")


@query("spc06_ac_coverage", i.ctes(*BIND) + """
SELECT count(*) AS criteria, round(avg(b), 6) AS bound_share, round(avg(tested::INT::DOUBLE), 6) AS tested_share, round(avg(CASE WHEN critical THEN b END), 6) AS critical_bound_share
FROM (SELECT *, ((spec_id, ac_id) IN (SELECT spec_id, ac_id FROM bd))::INT::DOUBLE AS b FROM acs)""")
def ac_coverage(t):
    return specs.ac_coverage(acs(t), bindings(t))


@query("spc07_spec_tier", i.ctes(*BIND, _VALID) + """
SELECT validated, 0 AS explicit, inferred, CASE WHEN validated = 0 THEN 4 WHEN inferred > 0 THEN 2 ELSE 3 END AS tier, CASE WHEN validated = 0 THEN 'none' ELSE 'partial' END AS coverage
FROM (SELECT (SELECT count(*) FROM (SELECT 1 FROM va GROUP BY spec_id HAVING bool_and(passed))) AS validated, (SELECT count(*) FROM bd) AS inferred)""")
def spec_tier(t):
    gated = specs.spec_gate(specs.validate_acs(acs(t)))
    inferred = bindings(t)
    return specs.spec_tier(gated, inferred.filter(F.lit(False)), inferred)


@query("spc08_spec_drift", """
WITH a AS (SELECT DISTINCT user_id AS spec_id, event_type || '-' || (regexp_extract(props, '[0-9]+')::INT % 10) AS symbol FROM events WHERE ts < TIMESTAMP '2024-01-16'),
b AS (SELECT DISTINCT user_id AS spec_id, event_type || '-' || (regexp_extract(props, '[0-9]+')::INT % 10) AS symbol FROM events WHERE ts >= TIMESTAMP '2024-01-16')
SELECT spec_id, symbol, CASE WHEN b_in IS NULL THEN 'missing' ELSE 'extra' END AS drift FROM (SELECT *, true AS a_in FROM a) FULL OUTER JOIN (SELECT *, true AS b_in FROM b) USING (spec_id, symbol)
WHERE a_in IS NULL OR b_in IS NULL""")
def spec_drift(t):
    number = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10
    rows = t.events.select(F.col("user_id").alias("spec_id"), F.concat_ws("-", "event_type", number.cast("string")).alias("symbol"), "ts")
    return specs.spec_drift(rows.filter("ts < timestamp_ntz'2024-01-16'"), rows.filter("ts >= timestamp_ntz'2024-01-16'"))


# Brands are projects, sizes are layers, types are keys.
CFG = "cfg AS (SELECT p_brand AS project, p_size * 1000000 + p_partkey AS layer, lower(p_type) || '.' || replace(p_name, ' ', '.') AS path, p_retailprice::DECIMAL(12,2)::VARCHAR AS value FROM part)"


def config(t):
    return t.part.select(F.col("p_brand").alias("project"), (F.col("p_size") * 1000000 + F.col("p_partkey")).alias("layer"),
                         F.concat(F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("."))).alias("path"),
                         F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("value"))


RESOLVED = CFG + ", rs AS (SELECT project, path, arg_max(value, layer) AS value, max(layer) AS layer FROM cfg GROUP BY 1, 2)"


@query("cfg01_resolve", i.ctes(RESOLVED) + "SELECT * FROM rs")
def resolve(t):
    return layered.resolve(config(t))


# Items with p_size up to 25 are the base, the others the override; one type lacks codes, another has neither.
_ITEMS = """it AS (SELECT p_brand AS project, p_type AS path, p_partkey AS idx, CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN p_name END AS code,
CASE WHEN p_type <> 'SMALL' THEN 'i' || (p_size % 7) END AS id, 'part ' || p_partkey AS item, p_size > 25 AS over FROM part),
ky AS (SELECT *, CASE WHEN path = 'SMALL' THEN NULL WHEN path = 'ECONOMY' THEN id ELSE code END AS k FROM it),
nw AS (SELECT project, path, k, min(idx) AS first, arg_max(item, idx) AS item FROM ky WHERE over AND k IS NOT NULL GROUP BY 1, 2, 3),
ls AS (SELECT project, path, k, max(idx) AS last FROM ky WHERE NOT over AND k IS NOT NULL GROUP BY 1, 2, 3),
mg AS (SELECT project, path, over::INT AS side, idx, item FROM ky WHERE k IS NULL
UNION ALL SELECT b.project, b.path, 0, b.idx, CASE WHEN nw.item IS NOT NULL AND b.idx = ls.last THEN nw.item ELSE b.item END FROM ky b LEFT JOIN nw ON nw.project = b.project AND nw.path = b.path AND nw.k = b.k
LEFT JOIN ls ON ls.project = b.project AND ls.path = b.path AND ls.k = b.k WHERE NOT b.over AND b.k IS NOT NULL
UNION ALL SELECT project, path, 1, first, item FROM nw WHERE (project, path, k) NOT IN (SELECT project, path, k FROM ls))"""


@query("cfg02_merge_keyed_arrays", i.ctes(_ITEMS) + "SELECT project, path, row_number() OVER (PARTITION BY project, path ORDER BY side, idx) - 1 AS idx, item FROM mg")
def merge_keyed_arrays(t):
    kind = F.col("p_type")
    items = t.part.select(F.col("p_brand").alias("project"), kind.alias("path"), F.col("p_partkey").alias("idx"),
                          F.when(~kind.isin("ECONOMY", "SMALL"), F.col("p_name")).alias("code"),
                          F.when(kind != "SMALL", F.concat(F.lit("i"), F.col("p_size") % 7)).alias("id"),
                          F.concat(F.lit("part "), "p_partkey").alias("item"), (F.col("p_size") > 25).alias("over"))
    merged = layered.merge_keyed_arrays(items.filter("not over").drop("over"), items.filter("over").drop("over"))
    return merged.select("project", "path", "idx", "item")


@query("cfg03_extract", i.ctes(RESOLVED) + "SELECT project, path, value FROM rs WHERE path = 'economy.red.bolt' OR path LIKE 'economy.red.bolt.%' OR path LIKE 'small.%' OR path = 'small'")
def extract(t):
    return layered.extract(layered.resolve(config(t)), ["economy.red.bolt", "small", "absent.key"]).select("project", "path", "value")


# Every part is the document of one layer; four parts are a project.  One setting is a scalar, a table or absent.
_DOCS = """pl AS (SELECT 'app-' || (p_partkey // 4) AS project, p_partkey % 4 AS layer, p_size % 3 AS shape, p_size % 4 AS k, p_size, p_type, p_retailprice::DECIMAL(12,2) AS price FROM part),
ag AS (SELECT project, layer, unnest([0, 1]) AS place, unnest(['a' || (p_size % 3), 'b' || (p_size % 2)]) AS code FROM pl),
tp AS (SELECT project, max(layer) AS layer, arg_max(shape, layer) AS shape FROM pl WHERE shape < 2 GROUP BY 1),
sc AS (SELECT project, max(layer) AS until FROM pl WHERE shape = 0 GROUP BY 1),
rd AS (SELECT project, 'name' AS path, '"' || arg_max(p_type, layer) || '"' AS value, max(layer) AS layer FROM pl GROUP BY 1
UNION ALL SELECT project, 'limits.by.k' || k, arg_max(price, layer)::VARCHAR, max(layer) FROM pl GROUP BY project, k
UNION ALL SELECT project, 'mode', '"' || p_type || '"', layer FROM pl JOIN tp USING (project, layer) WHERE tp.shape = 0
UNION ALL SELECT project, 'mode.k' || k, arg_max(p_size, pl.layer)::VARCHAR, max(pl.layer) FROM pl JOIN tp USING (project) LEFT JOIN sc USING (project) WHERE tp.shape = 1 AND pl.shape = 1 AND pl.layer > coalesce(until, -1) GROUP BY project, k
UNION ALL SELECT project, 'tags', '[' || string_agg('"' || p_type || '",' || p_size, ',' ORDER BY layer) || ']', max(layer) FROM pl GROUP BY 1
UNION ALL SELECT project, 'agents', '[' || string_agg('{"code":"' || code || '","layer":' || latest || '}', ',' ORDER BY first_place) || ']', max(latest)
FROM (SELECT project, code, max(layer) AS latest, min(layer * 2 + place) AS first_place FROM ag GROUP BY 1, 2) GROUP BY 1)"""


def config_layers(t):
    """(project, layer, document) with nested tables, keyed and plain arrays."""
    quoted = F.concat(F.lit('"'), "p_type", F.lit('"'))
    shape, k, size = F.col("p_size") % 3, F.concat(F.lit('"k'), F.col("p_size") % 4, F.lit('"')), F.col("p_size").cast("string")
    layer = (F.col("p_partkey") % 4).cast("string")
    mode = (F.when(shape == 0, F.concat(F.lit(',"mode":'), quoted)).when(shape == 1, F.concat(F.lit(',"mode":{'), k, F.lit(":"), size, F.lit("}")))
            .otherwise(""))
    agents = [F.concat(F.lit(f'{{"code":"{name}'), (F.col("p_size") % n).cast("string"), F.lit('","layer":'), layer, F.lit("}"))
              for name, n in (("a", 3), ("b", 2))]
    document = F.concat(F.lit('{"name":'), quoted, F.lit(',"limits":{"by":{'), k, F.lit(":"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
                        F.lit("}}"), mode, F.lit(',"tags":['), quoted, F.lit(","), size, F.lit('],"agents":['), agents[0], F.lit(","), agents[1], F.lit("]}"))
    return t.part.select(F.concat(F.lit("app-"), F.floor(F.col("p_partkey") / 4)).alias("project"),
                         (F.col("p_partkey") % 4).alias("layer"), document.alias("document"))


# Prices are compared as numbers, since a JSON number has no trailing zeros.
_NUMBERS = "CASE WHEN path LIKE 'limits.%' THEN round(value::DOUBLE, 2)::VARCHAR ELSE value END AS value"


@query("cfg01_resolve_documents", i.ctes(_DOCS) + f"SELECT project, path, {_NUMBERS}, layer FROM rd")
def resolve_documents(t):
    found = config_documents.resolve(config_layers(t))
    number = F.round(F.col("value").try_cast("double"), 2).cast("string")
    return found.select("project", "path", F.when(F.col("path").startswith("limits."), number).otherwise(F.col("value")).alias("value"), "layer")


@query("cfg03_extract_documents", i.ctes(_DOCS) + "SELECT project, path, value, layer FROM rd WHERE path LIKE 'mode%' OR path = 'agents'")
def extract_documents(t):
    found = layered.extract(config_documents.resolve(config_layers(t)), ["mode", "agents", "absent.key"])
    return found.select("project", "path", "value", "layer")


DEFAULTS = {"economy.red.bolt": "900.00", "small.blue.ring": "901.10", "absent.key": "1"}


@query("cfg04_deviations", i.ctes(RESOLVED, "df(path, default_value) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in DEFAULTS.items()) + ")") + """
SELECT project, path, coalesce(value, '-') AS value, coalesce(default_value, '-') AS default_value, CASE WHEN default_value IS NULL THEN 'unknown key' WHEN value IS NULL THEN 'unset' ELSE 'changed' END AS kind
FROM rs FULL OUTER JOIN (SELECT * FROM (SELECT DISTINCT project FROM rs), df) USING (project, path) WHERE value IS DISTINCT FROM default_value""")
def deviations(t):
    found = layered.deviations_from_default(layered.resolve(config(t)), DEFAULTS)
    return found.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("value", "default_value")})


@query("cfg05_config_errors", i.ctes(RESOLVED) + """
SELECT project, path, value, CASE WHEN path LIKE 'small%' THEN 'not one of the allowed values' ELSE 'out of range' END AS error FROM rs
WHERE (path LIKE 'small%' AND value NOT IN ('900.00', '1000.00')) OR (path NOT LIKE 'small%' AND (value::DOUBLE < 950 OR value::DOUBLE > 1050))""")
def config_errors(t):
    paths = config(t).select("path").distinct()
    small = F.col("path").startswith("small")
    constraints = paths.select("path", F.when(small, F.array(F.lit("900.00"), F.lit("1000.00"))).alias("allowed"),
                               F.when(~small, 950.0).alias("low"), F.when(~small, 1050.0).alias("high"))
    return layered.config_errors(layered.resolve(config(t)), constraints)


@query("udf01_registered_detectors", i.ctes(i.CODE_LINES_SQL, hits_sql(packs.pack("RUL-03", "RUL-19"), "sl")) +
       "SELECT path, rule_id, line_start, CASE rule_id WHEN 'RUL-03' THEN 'weak-hash' ELSE 'client-state' END AS detector FROM hits")
def registered_detectors(t):
    registry = detectors.Registry()
    registry.register(lambda change, context: rules.scan_rules(change, packs.pack("RUL-03")), "weak-hash")
    registry.register(lambda change, context: rules.scan_rules(change, packs.pack("RUL-19")), "client-state")
    return registry.run(i.code_files(t)).select("path", "rule_id", "line_start", "detector")


def _long_functions(path, text):
    """Spans from an exported function to the next closing brace line."""
    start = None
    for number, line in enumerate(text.split("\n"), 1):
        if line.startswith("export function"):
            start = number
        elif line == "}" and start is not None:
            yield "FN-span", start, number, "function span"
            start = None


@query("udf02_per_file_detector", i.ctes(i.CODE_LINES_SQL) + """
SELECT path, line_start, line_no AS line_end FROM (SELECT path, line_no, raw, max(CASE WHEN starts_with(raw, 'export function') THEN line_no END) OVER w AS line_start,
max(CASE WHEN raw = '}' THEN line_no END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM cl WINDOW w AS (PARTITION BY path ORDER BY line_no))
WHERE raw = '}' AND line_start IS NOT NULL AND coalesce(closed, 0) < line_start""")
def per_file_detector(t):
    return detectors.per_file(i.code_files(t), _long_functions, axiom=3).select("path", "line_start", "line_end")


def _spans_unless_weak(path, text):
    """Function spans; files that name a weak hash are refused."""
    if "md5(" in text:
        raise ValueError("weak hash")
    for _, start, end, message in _long_functions(path, text):
        yield "FN-span", start, end, message, end - start + 1


@query("udf02_table_function", i.ctes(i.CODE_LINES_SQL) + """
SELECT path, line_start, line_no AS line_end, line_no - line_start + 1 AS size, 'none' AS degraded FROM (SELECT path, line_no, raw, max(CASE WHEN starts_with(raw, 'export function') THEN line_no END) OVER w AS line_start,
max(CASE WHEN raw = '}' THEN line_no END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed, max(contains(raw, 'md5(')) OVER (PARTITION BY path) AS weak FROM cl WINDOW w AS (PARTITION BY path ORDER BY line_no))
WHERE raw = '}' AND line_start IS NOT NULL AND coalesce(closed, 0) < line_start AND NOT weak UNION ALL SELECT DISTINCT path, -1, -1, -1, 'ValueError: weak hash' FROM cl WHERE contains(raw, 'md5(')""")
def table_function(t):
    found = table_detectors.per_file(i.code_files(t), _spans_unless_weak, "size int")
    return found.select("path", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("line_start", "line_end", "size")],
                        F.coalesce("degraded", F.lit("none")).alias("degraded"))


class _Returns:
    """Changes by whoever made the change before."""

    def __init__(self):
        self.author, self.at = None, 0

    def row(self, row):
        self.at += 1
        if row["author"] == self.author:
            yield "HIS-again", self.at - 1, self.at, row["author"], row["event_id"]
        self.author = row["author"]

    def end(self):
        yield "HIS-changes", 1, self.at, None, None


@query("udf02_partitioned_table", i.ctes(i.HISTORY_SQL) + """
SELECT zone, 'HIS-again' AS rule_id, place - 1 AS line_start, place AS line_end, event_id FROM (SELECT *, row_number() OVER w AS place, lag(author) OVER w AS before FROM history WINDOW w AS (PARTITION BY zone ORDER BY changed_at, event_id))
WHERE author = before UNION ALL SELECT zone, 'HIS-changes', 1, count(*), -1 FROM history GROUP BY 1""")
def partitioned_table(t):
    history = i.history(t).select("zone", "author", "changed_at", F.col("event_id").cast("bigint").alias("event_id"))
    found = table_detectors.per_group(history, _Returns, "zone", ["changed_at", "event_id"], "event_id bigint")
    return found.select("zone", "rule_id", "line_start", "line_end", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


@query("udf03_load_pack", i.ctes(i.CODE_LINES_SQL) + """
SELECT path, 'NAT-' || n_nationkey AS rule_id, line_no AS line_start FROM sl JOIN nation ON regexp_matches(line, 'src' || n_nationkey || '/doc_')""")
def load_pack(t):
    table = t.nation.select(F.concat(F.lit("NAT-"), "n_nationkey").alias("rule_id"), F.lit(1).alias("axiom"), F.lit("Low").alias("severity"),
                            F.concat(F.lit("src"), "n_nationkey", F.lit("/doc_")).alias("line_regex"), F.col("n_name").alias("message"))
    return rules.scan_rules(i.code_files(t), packs.load_pack(table)).select("path", "rule_id", "line_start")


# Rules that name a literal, rules whose pattern holds one, and rules that have to see every line.
_PACK = r"""pk AS (SELECT 'SUP-' || s_suppkey AS rule_id, 'doc_' || s_suppkey || '([^0-9]|$)' AS regex, NULL AS path_regex FROM supplier UNION ALL
SELECT 'NAT-' || n_nationkey, '(value|shared)' || n_nationkey || '[^0-9]', '[.](ts|tsx)$' FROM nation UNION ALL
SELECT 'REG-' || r_regionkey, '[{(]' || r_regionkey || '[)}]', NULL FROM region)"""


@query("udf03_scan_pack", i.ctes(i.CODE_LINES_SQL, _PACK) + """
SELECT path, rule_id, line_no AS line_start FROM sl JOIN pk ON regexp_matches(line, regex) WHERE path_regex IS NULL OR regexp_matches(path, path_regex)""")
def scan_pack(t):
    rule = lambda key, kind, regex, path=None: F.struct(
        F.concat(F.lit(f"{kind}-"), key).alias("rule_id"), F.lit(1).alias("axiom"), F.lit("Low").alias("severity"),
        regex.alias("line_regex"), F.lit(path).cast("string").alias("path_regex"))
    suppliers = t.supplier.select(rule("s_suppkey", "SUP", F.concat(F.lit("doc_"), "s_suppkey", F.lit("([^0-9]|$)"))).alias("r"))
    nations = t.nation.select(rule("n_nationkey", "NAT", F.concat(F.lit("(value|shared)"), "n_nationkey", F.lit("[^0-9]")), "[.](ts|tsx)$").alias("r"))
    regions = t.region.select(rule("r_regionkey", "REG", F.concat(F.lit("[{(]"), "r_regionkey", F.lit("[)}]"))).alias("r"))
    pack = suppliers.unionByName(nations).unionByName(regions).select("r.*")
    return pack_index.scan_pack(i.code_files(t), pack).select("path", "rule_id", "line_start")


@query("udf04_custom_score", i.ctes(*BASE) + """
SELECT axiom, round(sum(sqrt(n) * CASE severity WHEN 'error' THEN 3 ELSE 1 END), 6) AS score FROM (SELECT axiom, rule_id, severity, count(*) AS n FROM fnd GROUP BY ALL) GROUP BY 1""")
def custom_score(t):
    def score(counts):
        return (counts["n"] ** 0.5 * counts["severity"].map(lambda s: 3 if s == "error" else 1)).sum()
    scored = detectors.custom_score(found_in(i.code_files(t)), score)
    return scored.withColumn("score", F.round("score", 6))


def _run(t, name):
    return jobs.work_folder(t.spark, name), jobs.work_folder(t.spark, name + "-progress")


@query("str01_stream_scan", i.ctes(PROSE_CODE, hits_sql(packs.pack("RUL-01", "RUL-24"), "pll")) + "SELECT path, rule_id, line_start FROM hits")
def stream_scan(t):
    out, progress = _run(t, "scan")
    arriving = jobs.stream_table(t.spark, t.sf_dir, "documents.parquet").select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id").alias("path"), "text")
    jobs.stream_scan(arriving, packs.pack("RUL-01", "RUL-24"), out, progress)
    return jobs.read_batches(t.spark, out).select("path", "rule_id", "line_start")


def _events(t):
    return jobs.stream_table(t.spark, t.sf_dir, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


@query("str02_stream_ingest", "SELECT DISTINCT 'u' || user_id || '-' || event_type || '-' || props AS record_id FROM events")
def stream_ingest(t):
    # A record is sent again whenever user, kind and payload repeat.
    out, progress = _run(t, "ingest")
    records = _events(t).select(F.concat_ws("-", F.concat(F.lit("u"), "user_id"), "event_type", "props").alias("record_id"), "at")
    jobs.stream_ingest(records, "at", "40 days", out, progress)
    return jobs.read_batches(t.spark, out).select("record_id")


_AXIS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in i.EVENT_AXES.items()) + " ELSE 6 END"


@query("str03_stream_counts_tumbling", f"""
SELECT {_AXIS} AS axiom, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, count(*) AS findings FROM events GROUP BY 1, 2""")
def stream_counts_tumbling(t):
    out, progress = _run(t, "counts")
    jobs.stream_counts(_events(t).select(F.expr(_AXIS).alias("axiom"), "at"), "at", "1 day", "1 day", None, out, progress)
    last = jobs.latest_rows(jobs.read_batches(t.spark, out), ["axiom", "window_start"])
    return last.select("axiom", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "findings")


@query("str03_stream_counts_sliding", f"""
SELECT {_AXIS} AS axiom, strftime(time_bucket(INTERVAL 1 DAY, ts) - back * INTERVAL 1 DAY, '%Y-%m-%d') AS window_start, count(*) AS findings
FROM events, (VALUES (0), (1)) b(back) GROUP BY 1, 2""")
def stream_counts_sliding(t):
    out, progress = _run(t, "sliding")
    jobs.stream_counts(_events(t).select(F.expr(_AXIS).alias("axiom"), "at"), "at", "1 day", "2 days", "1 day", out, progress)
    last = jobs.latest_rows(jobs.read_batches(t.spark, out), ["axiom", "window_start"])
    return last.select("axiom", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "findings")


@query("str04_stream_sessions", """
SELECT author, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS runs FROM (
SELECT *, sum(fresh) OVER (PARTITION BY author ORDER BY ts, event_id) AS session FROM (SELECT 'u' || user_id AS author, ts, event_id,
CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY author, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(t):
    """Sessions that are closed: those still open at the end of the data are not written yet."""
    out, progress = _run(t, "sessions")
    jobs.stream_sessions(_events(t).select(F.concat(F.lit("u"), "user_id").alias("author"), "at"), "at", "6 hours", "1 hour", out, progress)
    return jobs.read_batches(t.spark, out).select("author", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "runs")


@query("str05_stream_dual", f"""
SELECT {_AXIS} AS axiom, CASE WHEN value > 20 THEN 'error' ELSE 'info' END AS severity, count(*) AS findings FROM events GROUP BY 1, 2""")
def stream_dual(t):
    summary, progress = _run(t, "summary")
    rows = jobs.work_folder(t.spark, "rows")
    found = _events(t).select("event_id", F.expr(_AXIS).alias("axiom"), F.when(F.col("value") > 20, "error").otherwise("info").alias("severity"))
    jobs.stream_dual(found, summary, rows, progress)
    return jobs.read_batches(t.spark, summary).groupBy("axiom", "severity").agg(F.sum("findings").alias("findings"))


@query("str06_stream_state", """
SELECT 'f' || regexp_extract(props, '[0-9]+') AS finding_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def stream_state(t):
    out, progress = _run(t, "state")
    updates = _events(t).select(F.concat(F.lit("f"), F.regexp_extract("props", "[0-9]+", 0)).alias("finding_id"), "at", "event_id", F.col("event_type").alias("state"))
    jobs.stream_state(updates, out, progress)
    return jobs.current_state(t.spark, out).select("finding_id", "state", "event_id")


@query("str06_live_findings", """
SELECT finding_id, CASE WHEN state IN ('error', 'signup') AND seen + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN 'expired' ELSE state END AS state,
event_id, updates, reopened FROM (SELECT 'f' || user_id || '-' || regexp_extract(props, '[0-9]+') AS finding_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS seen,
arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS updates, greatest(count(*) FILTER (event_type IN ('error', 'signup')) - 1, 0) AS reopened FROM events GROUP BY 1)""")
def live_findings(t):
    """Findings whose last state is open expire six hours after it."""
    out, progress = _run(t, "live")
    key = F.concat(F.lit("f"), "user_id", F.lit("-"), F.regexp_extract("props", "[0-9]+", 0))
    updates = _events(t).select(key.alias("finding_id"), "at", "event_id", F.col("event_type").alias("state"))
    live.live_findings(updates, out, progress, ("error", "signup"), timedelta(hours=6), "1 hour")
    return live.live_table(t.spark, out).select("finding_id", "state", "event_id", "updates", "reopened")


@query("src09_write_findings", i.ctes(*BASE) + "SELECT path, rule_id, line_start, 'all' AS scope, 'run-2' AS run_id FROM fnd")
def write_findings(t):
    """Writing a run twice leaves one copy of it."""
    from ..sources import storage
    folder = jobs.work_folder(t.spark, "artifact")
    found = found_in(i.code_files(t)).withColumn("scope", F.lit("all"))
    storage.write_findings(found.withColumn("run_id", F.lit("run-2")), folder)
    storage.write_findings(found.withColumn("run_id", F.lit("run-2")), folder)
    return t.spark.read.parquet(folder).select("path", "rule_id", "line_start", "scope", "run_id")


@query("src10_append_history", i.ctes(i.TRENDS_SQL) + "SELECT record_id, axiom, error FROM trends")
def append_history(t):
    """History written in two appends and read back without copies."""
    from ..operators import trends
    from ..sources import storage
    folder = jobs.work_folder(t.spark, "history")
    records = i.trend_records(t).select("record_id", "axiom", "error")
    storage.append_history(records, folder)
    storage.append_history(records.filter("axiom < 3"), folder)
    return trends.dedupe_history(t.spark.read.parquet(folder))
