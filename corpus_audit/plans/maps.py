"""Corpus map queries over the derived source files and the change history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus_map, graph, refresh, sketches
from . import inputs as i
from .catalog import query
from .graphs import ALIASES, GRAPH, module_edges, zoned

_NAMED = r"hs AS (SELECT c.path AS entity, h.author, h.kind, changed_at, event_id, h.zone FROM history h JOIN code c ON regexp_replace(c.path, '\.[a-z]+$', '') = h.entity)"
_MAP = r"""fi AS (SELECT dst AS path, count(*) AS fan_in FROM e GROUP BY 1), au AS (SELECT entity, count(DISTINCT author) AS authors FROM hs GROUP BY 1),
map AS (SELECT c.path AS entity, regexp_extract(c.path, '\.([A-Za-z]+)$', 1) AS kind, coalesce(zn.zone, 'none') AS zone, coalesce(fan_in, 0) AS fan_in,
coalesce(authors, 0) AS authors, sha256(c.text) AS hash, 'derived' AS status FROM code c LEFT JOIN zn ON zn.path = c.path LEFT JOIN fi ON fi.path = c.path LEFT JOIN au ON au.entity = c.path)"""
MAP = (*GRAPH, i.HISTORY_SQL, _NAMED, _MAP)


def named_history(t):
    """History whose entities are the files of the corpus."""
    stems = i.code_files(t).select("path", F.regexp_replace("path", r"\.[a-z]+$", "").alias("entity"))
    return i.history(t).join(stems, "entity").select(F.col("path").alias("entity"), "author", "kind", "changed_at", "event_id", "zone")


def build(t, files=None):
    return corpus_map.build_map(i.code_files(t) if files is None else files, module_edges(t)[0], named_history(t), zoned(t))


def _derive(t):
    def derive(files):
        return files.select(F.col("path").alias("entity"), F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("kind"),
                            F.sha2("text", 256).alias("hash"))
    return derive


def changed_paths(t):
    bad = t.labels.filter("quality = 0").select("doc_id").distinct()
    return i.code_files(t).join(bad, "doc_id", "left_semi").select("path")


_BAD = "bad AS (SELECT path FROM code WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))"


@query("map01_build_map", i.ctes(*MAP) + "SELECT * FROM map")
def build_map(t):
    return build(t)


@query("map01_authors", i.ctes(*MAP) + "SELECT DISTINCT entity, author FROM hs")
def map_authors(t):
    return corpus_map.authors(named_history(t))


@query("map02_refresh_map", i.ctes(i.HEAD_SQL) + r"""
SELECT h.path AS entity, regexp_extract(h.path, '\.([A-Za-z]+)$', 1) AS kind, c.path IS NULL AS refreshed FROM head h LEFT JOIN code c ON c.path = h.path AND c.text = h.text""")
def refresh_map(t):
    derive = _derive(t)
    return corpus_map.refresh_map(derive(i.code_files(t)), i.head_files(t), derive).select("entity", "kind", "refreshed")


# The map of the later version as if it were the only one: its files are ``code`` here, and errors have left the history.
_LATER = (i.HEAD_SQL.replace("code AS (", "base AS (").replace("FROM code LEFT JOIN", "FROM base LEFT JOIN")
          + ", code AS (SELECT *, NULL AS doc_id FROM head)",)
_LATER_HISTORY = i.HISTORY_SQL.replace("FROM events", "FROM events WHERE event_type <> 'error'")


@query("map02_incremental_map", i.ctes(*_LATER, *GRAPH, _LATER_HISTORY, _NAMED, _MAP) + "SELECT * FROM map")
def incremental_map(t):
    """The map of the first version, without purchases in its history, brought up to the later one."""
    history = named_history(t).select("entity", "author", "kind")
    before = refresh.build_state(i.code_files(t).select("path", "text"), history.filter("kind <> 'purchase'"), i.zone_registry(t), ALIASES)
    gained = history.filter("kind = 'purchase'").select("entity", "author", F.lit(1).alias("sign"))
    lost = history.filter("kind = 'error'").select("entity", "author", F.lit(-1).alias("sign"))
    return refresh.refresh(before, i.head_files(t).select("path", "text"), gained.unionByName(lost), i.zone_registry(t), ALIASES).map


@query("map03_map_status", i.ctes(i.HEAD_SQL) + r"""
SELECT coalesce(h.path, c.path) AS entity, CASE WHEN coalesce(h.path, c.path) LIKE 'src/src0/%' THEN 'excluded' WHEN h.path IS NULL THEN 'orphaned' WHEN c.path IS NULL THEN 'derived'
WHEN c.text <> h.text THEN 'stale' WHEN c.lang = 'de' THEN 'confirmed' ELSE 'derived' END AS status FROM code c FULL OUTER JOIN head h ON c.path = h.path""")
def map_status(t):
    files = i.code_files(t)
    old = files.select(F.col("path").alias("entity"), F.sha2("text", 256).alias("hash"),
                       F.when(F.col("lang") == "de", "confirmed").otherwise("derived").alias("status"))
    return corpus_map.map_status(old, i.head_files(t), F.col("entity").startswith("src/src0/"))


@query("map04_overlay_human", i.ctes(*MAP) + """
SELECT entity, coalesce(h.zone, map.zone) AS zone, coalesce(purpose, '-') AS purpose, fan_in FROM map LEFT JOIN
(SELECT path AS entity, 'zone of ' || zone AS zone, 'reviewed ' || lang AS purpose FROM code WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) h USING (entity)""")
def overlay_human(t):
    good = t.labels.filter("quality = 1").select("doc_id").distinct()
    human = i.code_files(t).join(good, "doc_id", "left_semi").select(
        F.col("path").alias("entity"), F.concat(F.lit("zone of "), "zone").alias("zone"), F.concat(F.lit("reviewed "), "lang").alias("purpose"))
    laid = corpus_map.overlay_human(build(t), human)
    return laid.select("entity", "zone", F.coalesce("purpose", F.lit("-")).alias("purpose"), "fan_in")


@query("map05_affected_conventions", i.ctes(*MAP, _BAD) + "SELECT DISTINCT author AS convention_id FROM hs WHERE entity IN (SELECT path FROM bad)")
def affected_conventions(t):
    # An author's changes are the evidence of that author's convention.
    evidence = named_history(t).select(F.col("author").alias("convention_id"), "entity")
    return corpus_map.affected_conventions(evidence, changed_paths(t).withColumnRenamed("path", "entity"))


@query("map06_merged_only", i.ctes(i.CODE_SQL, _BAD) + "SELECT path, lang FROM code WHERE path NOT IN (SELECT path FROM bad)")
def merged_only(t):
    return corpus_map.merged_only(i.code_files(t), changed_paths(t)).select("path", "lang")


@query("map07_freshness", i.ctes(i.HISTORY_SQL) + """
SELECT zone, commits_behind, days_behind, CASE WHEN commits_behind = 0 THEN 'fresh' WHEN days_behind > 14 THEN 'inconclusive: stale_corpus' ELSE 'stale' END AS state,
CASE WHEN commits_behind = 0 THEN 'none' WHEN days_behind >= 10 THEN 'update' ELSE 'defer' END AS action FROM (
SELECT zone, count(*) FILTER (changed_at > seen_at) AS commits_behind, date_diff('day', any_value(seen_at)::DATE, DATE '2024-01-31') AS days_behind
FROM history JOIN (SELECT zone, min(changed_at) FILTER (value > 90) AS seen_at FROM history GROUP BY 1) USING (zone) WHERE seen_at IS NOT NULL GROUP BY 1)""")
def freshness(t):
    # A zone was last mapped when its first large change was seen.
    h = i.history(t)
    seen = h.filter("value > 90").groupBy("zone").agg(F.min("changed_at").alias("seen_at"))
    return corpus_map.freshness(seen, h.select("zone", F.col("changed_at").alias("at")), "2024-01-31", policy="update_after:10")


@query("map09_author_spread", i.ctes(i.HISTORY_SQL) + """
SELECT zone, count(DISTINCT author) AS authors FROM history WHERE author NOT IN (SELECT author FROM history WHERE value > 200) GROUP BY 1""")
def author_spread(t):
    h = i.history(t)
    return corpus_map.author_spread(h, h.filter("value > 200").select("author"))


@query("map09_author_sketches", i.ctes(i.HISTORY_SQL) + "SELECT zone, count(DISTINCT author) AS authors, true AS within FROM history GROUP BY 1")
def author_sketches(t):
    """The spread from kept and refreshed sketches, held against the exact one: at most 2 % off."""
    h = i.history(t)
    kept = sketches.author_sketches(h.filter("changed_at < timestamp_ntz'2024-01-16'"), period="week")
    spread = sketches.author_spread(sketches.refreshed_authors(kept, h.filter("changed_at >= timestamp_ntz'2024-01-14'"), "week"))
    exact = h.groupBy("zone").agg(F.countDistinct("author").alias("authors"))
    near = F.abs(F.col("estimate") - F.col("authors")) <= 0.02 * F.col("authors")
    return exact.join(spread.withColumnRenamed("authors", "estimate"), "zone").select("zone", "authors", near.alias("within"))


@query("map10_hot_zones", i.ctes(i.HISTORY_SQL) + "SELECT zone, count(*) AS changes FROM history GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def hot_zones(t):
    return corpus_map.hot_zones(i.history(t))


_ADJ = """adj AS (SELECT DISTINCT a.zone AS src_zone, b.zone AS dst_zone FROM e JOIN code a ON a.path = src JOIN code b ON b.path = dst),
touched AS (SELECT DISTINCT zone FROM code JOIN bad USING (path) WHERE lang = 'es')"""


def _adjacency(t):
    own = i.code_files(t).select("path", "zone")
    return graph.zone_adjacency(module_edges(t)[0], own)


@query("map11_lazy_zones", i.ctes(*GRAPH, _BAD, _ADJ) + """
SELECT DISTINCT zone FROM code WHERE zone IN (SELECT zone FROM touched) OR zone IN (SELECT dst_zone FROM adj WHERE src_zone IN (SELECT zone FROM touched))
OR zone IN (SELECT src_zone FROM adj WHERE dst_zone IN (SELECT zone FROM touched))""")
def lazy_zones(t):
    files = i.code_files(t)
    touched = files.filter("lang = 'es'").join(changed_paths(t), "path", "left_semi").select("zone")
    return corpus_map.zones_to_mine("lazy", files, touched, _adjacency(t), corpus_map.hot_zones(i.history(t)))


@query("map11_hot_seed_zones", i.ctes(i.HISTORY_SQL, i.CODE_SQL) + """
SELECT DISTINCT zone FROM code WHERE zone IN (SELECT zone FROM history GROUP BY 1 ORDER BY count(*) DESC, zone LIMIT 10)""")
def hot_seed_zones(t):
    files = i.code_files(t)
    return corpus_map.zones_to_mine("hot-seed", files, files, _adjacency(t), corpus_map.hot_zones(i.history(t)))
