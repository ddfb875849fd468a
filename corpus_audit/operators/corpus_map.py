"""The corpus map: one row per entity, refreshed by content hash, and what depends on its freshness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scopes import content_hash
from . import graph


def authors(history: DataFrame) -> DataFrame:
    """(entity, author): the long form of an entity's authors, which may be many."""
    return history.select("entity", "author").distinct()


def build_map(files: DataFrame, edges: DataFrame, history: DataFrame, assigned: DataFrame) -> DataFrame:
    """(entity, kind, zone, fan_in, authors, hash, status) per file.

    ``authors`` is a count; :func:`authors` lists them.
    """
    fan_in = graph.fan_in_out(edges).select(F.col("module").alias("path"), "fan_in")
    spread = authors(history).groupBy(F.col("entity").alias("path")).agg(F.count(F.lit(1)).alias("authors"))
    base = files.select("path", F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("kind"), content_hash(F.col("text")).alias("hash"))
    return (base.join(assigned.select("path", "zone"), "path", "left").join(fan_in, "path", "left").join(spread, "path", "left")
            .fillna(0, ["fan_in", "authors"])
            .select(F.col("path").alias("entity"), "kind", F.coalesce("zone", F.lit("none")).alias("zone"), "fan_in", "authors", "hash",
                    F.lit("derived").alias("status")))


def refresh_map(old: DataFrame, files: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Map of the current files where only new and changed ones are derived again.

    ``derive`` gets the changed files and returns map rows; ``refreshed`` marks them.  Counts of unchanged entities stay as
    they were; :func:`refresh.refresh` moves them too.
    """
    hashes = files.select(F.col("path").alias("entity"), content_hash(F.col("text")).alias("hash"))
    kept = old.join(hashes, ["entity", "hash"], "left_semi").withColumn("refreshed", F.lit(False))
    known = old.select(F.col("entity").alias("path"), "hash")
    touched = (files.withColumn("hash", content_hash(F.col("text"))).join(known, ["path", "hash"], "left_anti").drop("hash"))
    return kept.unionByName(derive(touched).withColumn("refreshed", F.lit(True)), allowMissingColumns=True)


def map_status(old: DataFrame, files: DataFrame, excluded: Column) -> DataFrame:
    """(entity, status): derived, stale, orphaned, excluded; ``confirmed`` survives while the file is unchanged.

    ``excluded`` is a condition on ``entity``.
    """
    now = files.select(F.col("path").alias("entity"), content_hash(F.col("text")).alias("now_hash"))
    joined = old.select("entity", "hash", "status").join(now, "entity", "full_outer")
    status = (F.when(excluded, "excluded").when(F.col("now_hash").isNull(), "orphaned").when(F.col("hash").isNull(), "derived")
              .when(F.col("hash") != F.col("now_hash"), "stale").otherwise(F.col("status")))
    return joined.select("entity", status.alias("status"))


def overlay_human(derived: DataFrame, human: DataFrame) -> DataFrame:
    """Mechanical fields follow the code, ``purpose`` and ``zone`` follow the human layer where it speaks."""
    layer = human.select("entity", F.col("purpose").alias("_purpose"), F.col("zone").alias("_zone"))
    purpose = F.coalesce("_purpose", "purpose") if "purpose" in derived.columns else F.col("_purpose")
    return (derived.join(layer, "entity", "left").withColumn("purpose", purpose)
            .withColumn("zone", F.coalesce("_zone", "zone")).drop("_purpose", "_zone"))


def affected_conventions(evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """(convention_id) whose evidence (convention_id, entity) meets a changed entity."""
    return evidence.join(changed.select("entity").distinct(), "entity", "left_semi").select("convention_id").distinct()


def merged_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files a map may learn from: whatever is under review is left out."""
    return files.join(changed.select("path").distinct(), "path", "left_anti")


def freshness(watermarks: DataFrame, commits: DataFrame, as_of: str, ceiling_days: int = 14,
              policy: str = "defer") -> DataFrame:
    """(zone, commits_behind, days_behind, state, action) per zone.

    ``watermarks(zone, seen_at)`` say up to when a zone was mapped, ``commits(zone, at)`` what happened.
    ``policy`` is defer, update or update_after:<days>.
    """
    behind = (commits.join(watermarks.select("zone", "seen_at"), "zone").filter(F.col("at") > F.col("seen_at"))
              .groupBy("zone").agg(F.count(F.lit(1)).alias("commits_behind")))
    days = F.date_diff(F.lit(as_of).cast("date"), F.col("seen_at").cast("date"))
    joined = (watermarks.select("zone", days.alias("days_behind")).join(behind, "zone", "left").fillna(0, ["commits_behind"]))
    state = (F.when(F.col("commits_behind") == 0, "fresh").when(F.col("days_behind") > ceiling_days, "inconclusive: stale_corpus")
             .otherwise("stale"))
    if policy.startswith("update_after:"):
        due = F.col("days_behind") >= int(policy.split(":", 1)[1])
    else:
        due = F.lit(policy == "update")
    action = F.when(F.col("commits_behind") == 0, "none").when(due, "update").otherwise("defer")
    return joined.select("zone", "commits_behind", "days_behind", state.alias("state"), action.alias("action"))


def author_spread(history: DataFrame, ignore: DataFrame, by: str = "zone") -> DataFrame:
    """(zone, authors) without the ignored (author) accounts."""
    return (history.join(ignore.select("author").distinct(), "author", "left_anti")
            .groupBy(by).agg(F.countDistinct("author").alias("authors")))


def hot_zones(history: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` zones by number of changes."""
    return (history.groupBy("zone").agg(F.count(F.lit(1)).alias("changes"))
            .orderBy(F.col("changes").desc(), "zone").limit(n))


def zones_to_mine(strategy: str, zones: DataFrame, touched: DataFrame, adjacency: DataFrame, hot: DataFrame) -> DataFrame:
    """(zone): all of them, the hot ones, or the touched ones with their neighbours."""
    every = zones.select("zone").distinct()
    if strategy == "eager":
        return every
    if strategy == "hot-seed":
        return every.join(hot.select("zone"), "zone", "left_semi")
    if strategy != "lazy":
        raise ValueError(f"unknown strategy {strategy}")
    start = touched.select("zone").distinct()
    forward = adjacency.join(start, adjacency.src_zone == start.zone, "left_semi").select(F.col("dst_zone").alias("zone"))
    backward = adjacency.join(start, adjacency.dst_zone == start.zone, "left_semi").select(F.col("src_zone").alias("zone"))
    return every.join(start.union(forward).union(backward).distinct(), "zone", "left_semi")
