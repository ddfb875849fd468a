"""Queries over scopes and stored records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rules
from ..sources import scopes, storage
from . import inputs as i
from .catalog import query


@query("src01_scan_corpus", """
SELECT 'docs/' || source || '/' || doc_id AS path, lang, length(text) AS chars, sha256(text) AS hash FROM documents""")
def scan_corpus(t):
    files = scopes.scan_table(t.spark, f"{t.sf_dir}/documents.parquet")
    return files.select(F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id").alias("path"), "lang",
                        F.length("text").alias("chars"), scopes.content_hash(F.col("text")).alias("hash"))


_CHANGED = """chg AS (SELECT coalesce(h.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'A'
WHEN h.path IS NULL THEN 'D' WHEN sha256(b.text) <> sha256(h.text) THEN 'M' END AS status
FROM code b FULL OUTER JOIN head h ON b.path = h.path)"""


@query("src02_changed_files", i.ctes(i.HEAD_SQL, _CHANGED) + "SELECT * FROM chg WHERE status IS NOT NULL")
def changed_files(t):
    return scopes.changed_files(i.code_files(t), i.head_files(t))


@query("src03_uncommitted", i.ctes(i.HEAD_SQL, _CHANGED) + """
SELECT path, status, length(text) AS chars FROM head JOIN chg USING (path) WHERE status IN ('A', 'M')""")
def uncommitted(t):
    return (scopes.uncommitted(i.code_files(t), i.head_files(t))
            .select("path", "status", F.length("text").alias("chars")))


# Pages carry a query string or anchor in their address: treat some addresses as generated copies.
PAGE_NOISE = (r"[?&]utm_source=", r"//spam-", r"#top$")


@query("src04_exclude", r"""
SELECT url AS path, length(html) AS chars FROM pages
WHERE NOT regexp_matches(url, '(^|/)\.corpus-audit/|[?&]utm_source=|//spam-|#top$')""")
def exclude(t):
    files = t.pages.select(F.col("url").alias("path"), F.length("html").alias("chars"))
    return scopes.exclude(files, PAGE_NOISE)


def _versions(t):
    return i.history(t).groupBy("entity", "changed_at").agg(F.max("kind").alias("kind"), F.max("value").alias("value")).select(
        F.col("entity").alias("path"), F.col("changed_at").alias("ref"),
        F.concat_ws(":", "kind", F.col("value").cast("decimal(12,2)").cast("string")).alias("text"),
        (F.col("kind") == "error").alias("deleted"))


_VERSIONS = """versions AS (SELECT entity AS path, changed_at AS ref, max(kind) || ':' || max(value)::DECIMAL(12,2)::VARCHAR AS text,
max(kind) = 'error' AS deleted FROM history GROUP BY entity, changed_at),
base AS (SELECT path, text FROM versions WHERE (path, ref) IN (SELECT path, max(ref) FROM versions
WHERE ref <= TIMESTAMP '2024-01-15' GROUP BY path) AND NOT deleted),
tip AS (SELECT path, text FROM versions WHERE (path, ref) IN (SELECT path, max(ref) FROM versions
WHERE ref <= TIMESTAMP '2024-01-28' GROUP BY path) AND NOT deleted)"""


@query("src05_diff_refs", i.ctes(i.HISTORY_SQL, _VERSIONS) + """
SELECT * FROM (SELECT coalesce(h.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN h.path IS NULL THEN 'D'
WHEN b.text <> h.text THEN 'M' END AS status FROM base b FULL OUTER JOIN tip h ON b.path = h.path) WHERE status IS NOT NULL""")
def diff_refs(t):
    return scopes.diff_refs(_versions(t), _at("2024-01-15"), _at("2024-01-28"))


def _at(day):
    return F.lit(day).cast("timestamp_ntz")


@query("src06_snapshot_as_of", i.ctes(i.HISTORY_SQL, _VERSIONS) + "SELECT path, text FROM base")
def snapshot_as_of(t):
    return scopes.snapshot_as_of(_versions(t), _at("2024-01-15")).select("path", "text")


@query("src07_explode_lines", i.ctes(i.PROSE_LINES_SQL) + "SELECT path, line_no, line FROM pl")
def explode_lines(t):
    return rules.explode_lines(i.prose_files(t).select("path", "text"))


_KLOC = """d AS (SELECT path, line, abs(sum(s)) AS n FROM (
SELECT path, unnest(string_split(text, chr(10))) AS line, -1 AS s FROM code UNION ALL
SELECT path, unnest(string_split(text, chr(10))), 1 FROM head) GROUP BY path, line)"""


@query("src08_changed_lines", i.ctes(i.HEAD_SQL, _KLOC) +
       "SELECT path, sum(n)::BIGINT AS changed FROM d GROUP BY path HAVING sum(n) > 0")
def changed_lines(t):
    return scopes.changed_lines(i.code_files(t), i.head_files(t)).filter("changed > 0")


@query("src08_changed_kloc", i.ctes(i.HEAD_SQL, _KLOC) +
       "SELECT sum(n)::BIGINT AS changed, greatest(sum(n) / 1000.0, 0.1)::DOUBLE AS kloc FROM d")
def changed_kloc(t):
    return scopes.changed_kloc(i.code_files(t), i.head_files(t))


_TREND_JSON = T.StructType([T.StructField("id", T.LongType()), T.StructField("axis", T.StringType()),
                            T.StructField("k", T.IntegerType())])
# Every record is written as JSON; records with an odd k lose their closing brace, as a torn write would.
_JSON = """'{"id":' || event_id || ',"axis":"' || event_type || '","k":' || k || CASE WHEN k % 2 = 1 THEN '' ELSE '}' END"""


def _json_lines(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return t.events.select(F.concat(F.lit('{"id":'), "event_id", F.lit(',"axis":"'), "event_type", F.lit('","k":'), k,
                                    F.when(k % 2 == 1, "").otherwise("}")).alias("value"))


@query("src11_read_history", r"""
WITH j AS (SELECT """ + _JSON + """ AS value FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events))
SELECT regexp_extract(value, '"id":([0-9]+)', 1)::BIGINT AS id, regexp_extract(value, '"axis":"([a-z]+)"', 1) AS axis,
regexp_extract(value, '"k":([0-9]+)', 1)::INT AS k FROM j WHERE value LIKE '%}'""")
def read_history(t):
    return storage.read_history(_json_lines(t), _TREND_JSON, ("id",))[0]


@query("src11_torn_count", r"""
WITH j AS (SELECT """ + _JSON + """ AS value FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events))
SELECT count(*) AS torn FROM j WHERE value NOT LIKE '%}'""")
def torn_count(t):
    return storage.read_history(_json_lines(t), _TREND_JSON, ("id",))[1]


_STEPS = {2: lambda df: df.withColumn("info", F.lit(0).cast("bigint")),
          3: lambda df: df.withColumn("kloc", F.lit(0.1))}


@query("src12_upcast", i.ctes(i.TRENDS_SQL) + """
SELECT record_id, 4 AS schema_version, error, CASE WHEN axiom < 3 THEN 0 ELSE info END AS info,
CASE WHEN axiom < 4 THEN 0.1 ELSE kloc END AS kloc FROM trends WHERE axiom BETWEEN 2 AND 4""")
def upcast(t):
    stored = i.trend_records(t).withColumn("schema_version", F.col("axiom"))
    # The axis number stands in for the schema version a record was written with.
    good, _ = storage.upcast(stored.select("record_id", "schema_version", "error", "info", "kloc"),
                             _STEPS, current=4, minimum=2)
    return good


@query("src12_upcast_rejects", i.ctes(i.TRENDS_SQL) +
       "SELECT record_id, axiom AS schema_version FROM trends WHERE axiom NOT BETWEEN 2 AND 4")
def upcast_rejects(t):
    stored = i.trend_records(t).withColumn("schema_version", F.col("axiom"))
    _, rejects = storage.upcast(stored, _STEPS, current=4, minimum=2)
    return rejects.select("record_id", "schema_version")


@query("src13_retain_runs", "SELECT event_id AS run_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def retain_runs(t):
    runs = t.events.select(F.col("event_id").alias("run_id"), F.col("ts").alias("at"))
    return scopes.retain_runs(runs, 100).select("run_id")


@query("src13_retain_runs_per_branch", """
SELECT branch, run_id FROM (SELECT user_id AS branch, event_id AS run_id,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10""")
def retain_runs_per_branch(t):
    runs = t.events.select(F.col("user_id").alias("branch"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"))
    return scopes.retain_runs(runs, 10, ["branch"]).select("branch", "run_id")


@query("src14_converge", """
WITH pr AS (SELECT user_id AS branch, min(event_id) AS pr_id FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id AS run_id, coalesce('pr/' || pr_id, 'branch/' || branch) AS timeline
FROM (SELECT event_id, user_id AS branch FROM events) LEFT JOIN pr USING (branch)""")
def converge(t):
    runs = t.events.select(F.col("event_id").alias("run_id"), F.col("user_id").cast("string").alias("branch"))
    opened = t.events.filter("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("branch"), F.col("event_id").alias("pr_id"))
    return scopes.converge(runs, opened).select("run_id", "timeline")
