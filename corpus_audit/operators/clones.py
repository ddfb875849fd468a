"""Clone classes: the longest runs of lines that occur more than once, each with its class.

A run is measured in windows of ``k`` lines, so m windows are m + k - 1 lines.  From every place, the longest repeated run is
searched by halving steps: places that share a run form a group, and within it those whose next ``step`` windows are
equal too form a longer group.  Whoever has no partner for the longer run stays behind, together with one stand-in for each
longer group, which carries that group's number of places and its first place.  A group thus always stands for all
places of its run, its rows grow with the places and not with pairs of them, and the rounds with the logarithm of the longest run.
Codes of 1, 2, 4, ... windows come from prefix doubling within the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .duplicates import repeated_blocks, windows

GROUP = ["root", "chain", "m"]
PLACE = ["path", "idx", "last"]


def _places(files: DataFrame, k: int) -> DataFrame:
    """(path, idx, line_start, line_end, hash, last): starts of repeated windows; ``last`` ends their unbroken series."""
    places = windows(files, k).join(repeated_blocks(files, k).select("hash"), "hash", "left_semi")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("path").orderBy("idx"))
    places = places.withColumn("island", island)
    return cut_lineage(places.withColumn("last", F.max("idx").over(Window.partitionBy("path", "island"))).drop("island"))


def _codes(places: DataFrame, steps: int) -> DataFrame:
    """(path, idx, c0, c1, ...): codes of the next 1, 2, 4, ... windows, null where the series ends before."""
    series = Window.partitionBy("path", "last").orderBy("idx")
    codes = places.select("path", "last", "idx", F.xxhash64("hash").alias("c0"))
    for step in range(1, steps):
        ahead = F.lead(f"c{step - 1}", 1 << (step - 1)).over(series)
        codes = codes.withColumn(f"c{step}", F.when(ahead.isNotNull(), F.xxhash64(f"c{step - 1}", ahead)))
    return cut_lineage(codes.drop("last"))


def _lengthened(state: DataFrame, codes: DataFrame, step: int) -> DataFrame:
    """``state`` after the test whether runs go on alike for 2 ** ``step`` windows."""
    size = 1 << step
    fits = F.col("idx") + F.col("m") + (size - 1) <= F.col("last")
    ahead = codes.select("path", F.col("idx").alias("at"), F.col(f"c{step}").alias("code")).filter("code IS NOT NULL")
    tested = state.filter(fits).withColumn("at", F.col("idx") + F.col("m")).join(ahead, ["path", "at"]).drop("at")
    longer = (tested.groupBy(*GROUP, "code").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"),
                                                 F.min(F.struct(*PLACE)).alias("first")).filter("n > 1"))
    longer = cut_lineage(longer)
    met = F.col("n").isNotNull()
    moved = tested.join(longer.select(*GROUP, "code", "n"), [*GROUP, "code"], "left").select(
        "root", F.when(met, F.xxhash64("chain", "code")).otherwise(F.col("chain")).alias("chain"),
        F.when(met, F.col("m") + size).otherwise(F.col("m")).alias("m"), *PLACE, "own", "weight")
    # A stand-in is of use only to a group in which somebody is left.
    sizes = state.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
    left = longer.join(sizes, GROUP).filter("size > n").select(
        *GROUP, *[f"first.{name}" for name in PLACE], F.lit(False).alias("own"), "weight")
    return cut_lineage(state.filter(~fits).unionByName(moved).unionByName(left))


def clone_classes(files: DataFrame, k: int) -> DataFrame:
    """(path, line_start, line_end, lines, copies, origin_path, origin_line) of every longest repeated run.

    A row is a place whose run of ``lines`` >= ``k`` normalized lines occurs elsewhere, occurs nowhere else with one more line at its
    end, and is not the rest of the run that starts one line before.  ``copies`` counts all places of the run, also those inside
    longer ones, and may count places that overlap.  The first of them by path and line is the origin; origin and
    ``lines`` name the class.  Null texts and files of fewer than ``k`` lines have no row.
    """
    places = _places(files, k)
    longest = places.agg(F.max(F.col("last") - F.col("idx"))).first()[0] or 0
    steps = longest.bit_length()
    state = places.select(F.col("hash").alias("root"), F.lit(0).cast("long").alias("chain"), F.lit(1).alias("m"), *PLACE,
                          F.lit(True).alias("own"), F.lit(1).cast("long").alias("weight"))
    if steps:
        codes = _codes(places, steps)
        for step in reversed(range(steps)):
            state = _lengthened(state, codes, step)
    classes = state.groupBy(*GROUP).agg(F.sum("weight").alias("copies"), F.min(F.struct("path", "idx")).alias("origin"))
    found = state.filter("own").select(*GROUP, *PLACE)
    before = Window.partitionBy("path", "last").orderBy("idx")
    found = (found.withColumn("rest", F.coalesce(F.lag("m").over(before) == F.col("m") + 1, F.lit(False)))
             .filter("NOT rest").join(classes, GROUP))
    starts = places.select("path", "idx", "line_start")
    ends = places.select("path", F.col("idx").alias("end_idx"), "line_end")
    origins = places.select(F.struct("path", "idx").alias("origin"), F.col("line_start").alias("origin_line"))
    return (found.withColumn("end_idx", F.col("idx") + F.col("m") - 1).join(starts, ["path", "idx"]).join(ends, ["path", "end_idx"])
            .join(origins, "origin")
            .select("path", "line_start", "line_end", (F.col("m") + (k - 1)).cast("long").alias("lines"), "copies",
                    F.col("origin.path").alias("origin_path"), "origin_line"))
