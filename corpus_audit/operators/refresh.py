"""Incremental refresh of the corpus map: signed rows of edges and history move the counts of all entities they concern.

A map is kept together with what its counts were made of: the import statements of every file, the edges they resolve to,
and how often each author changed each entity.  A refresh parses only files that are new or changed.  A statement of an
unchanged file is resolved again if one of the paths it may mean has come or gone.  Edges of the files concerned are
rows with +1 after and -1 before; their sums move ``fan_in`` of whatever they point to, changed or not.  Changes of the
history are rows with a sign, and an author counts for an entity while the sum of those rows is positive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.scopes import content_hash
from . import corpus_map, graph


class MapState(NamedTuple):
    """A map (see :func:`corpus_map.build_map`) and its ingredients."""

    map: DataFrame
    statements: DataFrame  # src, spec, kind
    edges: DataFrame  # src, dst; distinct
    changes: DataFrame  # entity, author, n


def _hashed(files: DataFrame) -> DataFrame:
    """``files`` with ``hash``, which a listing may bring along so that no text is read for it."""
    return files if "hash" in files.columns else files.withColumn("hash", content_hash(F.col("text")))


def _edges(statements: DataFrame, paths: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    return graph.resolve_edges(statements, paths, aliases)[0].select("src", "dst").distinct()


def build_state(files: DataFrame, history: DataFrame, zones: DataFrame, aliases: list[tuple[str, str]] = ()) -> MapState:
    """State of a whole corpus: ``files(path, text)``, ``history(entity, author)``, ``zones(prefix, zone, role)``."""
    statements = cut_lineage(graph.extract_edges(files))
    edges = cut_lineage(_edges(statements, files.select("path"), aliases))
    changes = cut_lineage(history.groupBy("entity", "author").agg(F.count(F.lit(1)).alias("n")))
    assigned = graph.assign_zone(files.select("path"), zones)
    built = corpus_map.build_map(files.select("path", "text"), edges, changes, assigned)
    return MapState(cut_lineage(built), statements, edges, changes)


def _compared(state: MapState, files: DataFrame) -> DataFrame:
    """(path, hash, change) of all files before and now; change is added, removed, changed or same."""
    before = state.map.select(F.col("entity").alias("path"), F.col("hash").alias("_before"))
    now = _hashed(files).select("path", "hash")
    change = (F.when(F.col("_before").isNull(), "added").when(F.col("hash").isNull(), "removed")
              .when(F.col("hash") != F.col("_before"), "changed").otherwise("same"))
    return cut_lineage(before.join(now, "path", "full_outer").select("path", "hash", change.alias("change")))


def _signed(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sign) of rows that came (+1) or went (-1); what is on both sides cancels out."""
    both = after.withColumn("sign", F.lit(1)).unionByName(before.withColumn("sign", F.lit(-1)))
    return both.groupBy(*keys).agg(F.sum("sign").alias("sign")).filter("sign <> 0")


def refresh(state: MapState, files: DataFrame, changes: DataFrame, zones: DataFrame,
            aliases: list[tuple[str, str]] = ()) -> MapState:
    """The state of the corpus as it is now.

    ``files(path, text[, hash])`` are all files; texts are parsed where the hash is new, so with ``hash`` given those of
    unchanged files may be null.  ``changes(entity, author, sign)`` are rows that the history gained (+1) or lost (-1).
    ``zones`` are assigned by path to all entities.  A status other than ``derived`` stays while a file is unchanged.
    """
    compared = _compared(state, files)
    present = compared.filter("change <> 'removed'")
    touched = compared.filter("change <> 'same'").select(F.col("path").alias("src"))
    to_parse = compared.filter("change in ('added', 'changed')").select("path")
    fresh = cut_lineage(graph.extract_edges(files.join(to_parse, "path", "left_semi")))

    kept = state.statements.join(touched, "src", "left_anti")
    moved_paths = compared.filter("change in ('added', 'removed')").select("path")
    concerned = cut_lineage(_edges(kept, moved_paths, aliases).select("src").distinct())
    again = fresh.unionByName(kept.join(concerned, "src", "left_semi"))
    sources = touched.unionByName(concerned)
    moves = cut_lineage(_signed(_edges(again, present, aliases), state.edges.join(sources, "src", "left_semi"), ["src", "dst"]))
    edges = (state.edges.join(moves.filter("sign < 0"), ["src", "dst"], "left_anti")
             .unionByName(moves.filter("sign > 0").select("src", "dst")))
    fan_in = moves.groupBy(F.col("dst").alias("entity")).agg(F.sum("sign").alias("_fan_in"))

    news = changes.groupBy("entity", "author").agg(F.sum("sign").alias("_sign"))
    old_counts = state.changes.join(news.select("entity", "author"), ["entity", "author"], "left_semi")
    counted = cut_lineage(news.join(old_counts, ["entity", "author"], "left").select(
        "entity", "author", F.coalesce("n", F.lit(0)).alias("_n"), (F.coalesce("n", F.lit(0)) + F.col("_sign")).alias("n")))
    authors = (state.changes.join(counted.select("entity", "author"), ["entity", "author"], "left_anti")
               .unionByName(counted.filter("n > 0").select("entity", "author", "n")))
    present_after, present_before = (F.col("n") > 0).cast("int"), (F.col("_n") > 0).cast("int")
    spread = counted.groupBy("entity").agg(F.sum(present_after - present_before).alias("_authors"))

    # A file may have a history from before it came into the map.
    added = present.filter("change = 'added'").select(F.col("path").alias("entity"))
    earlier = state.changes.join(added, "entity", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("_earlier"))
    old = state.map.select("entity", "fan_in", "authors", "status")
    assigned = graph.assign_zone(present.select("path"), zones).select(F.col("path").alias("entity"), "zone")
    number = lambda name: F.coalesce(F.col(name), F.lit(0))
    rows = present.withColumnRenamed("path", "entity")
    for table in (old, fan_in, spread, earlier, assigned):
        rows = rows.join(table, "entity", "left")
    now = rows.select(
        "entity", F.regexp_extract("entity", r"\.([A-Za-z]+)$", 1).alias("kind"), F.coalesce("zone", F.lit("none")).alias("zone"),
        (number("fan_in") + number("_fan_in")).alias("fan_in"),
        (F.coalesce("authors", "_earlier", F.lit(0)) + number("_authors")).alias("authors"), "hash",
        F.when(F.col("change") == "same", F.col("status")).otherwise("derived").alias("status"))
    return MapState(cut_lineage(now), cut_lineage(kept.unionByName(fresh)), cut_lineage(edges), cut_lineage(authors))
