"""Overlapping line ranges, joined without listing pairs.

Two ranges belong together when they share more than half of the shorter one.  That is the same as: the
longer one covers the middle of the shorter one.  So every range only has to find, among the ranges that
cover its middle, the longest one centred at or after it and the longest one centred at or before it; all
others that cover the middle also cover, or are covered by, one of these two.  At most two links per
distinct range are enough for the transitive closure.

Covering is looked up by an equi join: half of each range is cut into aligned power-of-two cells, the
longest range per cell is kept, and a middle looks up the one cell it lies in per cell size.

That search is kept for long islands.  Ranges that do not touch through others lie on different islands, so an island of
one range is a group, and one of up to ``ISLAND`` ranges is grouped where it lies, by the same rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .components import components

ISLAND = 1024


def _cells(low: Column, high: Column, levels: int) -> Column:
    """Aligned cells (level, cell) that make up low..high."""
    start = F.struct(low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"),
                     F.expr("cast(array() as array<struct<level:int,cell:bigint>>)").alias("cells"))
    def step(acc, level):
        lo, hi = acc.lo, acc.hi
        def cell(value):
            return F.array(F.struct(level.alias("level"), value.alias("cell")))
        open_range = lo <= hi
        odd = open_range & (lo % 2 == 1)
        after = F.when(odd, lo + 1).otherwise(lo)
        even = open_range & (after <= hi) & (hi % 2 == 0)
        before = F.when(even, hi - 1).otherwise(hi)
        nothing = F.expr("cast(array() as array<struct<level:int,cell:bigint>>)")
        cells = F.concat(acc.cells, F.when(odd, cell(lo)).otherwise(nothing), F.when(even, cell(hi)).otherwise(nothing))
        # A used-up range is parked at (1, 0), which stays empty on every further level.
        done = after > before
        return F.struct(F.when(done, F.lit(1)).otherwise(F.shiftright(after, 1)).cast("bigint").alias("lo"),
                        F.when(done, F.lit(0)).otherwise(F.shiftright(before, 1)).cast("bigint").alias("hi"),
                        cells.alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc.cells)


def overlap_links(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) links between the ``id`` of distinct ranges (keys, line_start, line_end, id)."""
    widest = ranges.agg(F.max(F.col("line_end") - F.col("line_start"))).first()[0]
    levels = max(1, (2 * int(widest or 0) + 1).bit_length())
    low, middle, high = F.col("line_start") * 2, F.col("line_start") + F.col("line_end"), F.col("line_end") * 2
    size = (F.col("line_end") - F.col("line_start")).cast("bigint")
    halves = ranges.select(*keys, "id", size.alias("size"), F.explode(F.array(
        F.struct(F.lit("after").alias("side"), low.alias("lo"), middle.alias("hi")),
        F.struct(F.lit("before").alias("side"), middle.alias("lo"), high.alias("hi")))).alias("h"))
    cells = halves.select(*keys, "id", "size", "h.side", F.explode(_cells(F.col("h.lo"), F.col("h.hi"), levels)).alias("c"))
    place = [*keys, "side", "level", "cell"]
    longest = (cells.select(*keys, "side", "c.level", "c.cell", F.struct("size", "id").alias("range"))
               .groupBy(*place).agg(F.max("range").alias("best")))
    lookups = ranges.select(*keys, "id", F.explode(F.array(F.lit("after"), F.lit("before"))).alias("side"),
                            middle.cast("bigint").alias("middle"))
    lookups = lookups.select(*keys, "id", "side", "middle",
                             F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    lookups = lookups.withColumn("cell", F.expr("shiftright(middle, level)")).drop("middle")
    return (lookups.join(longest, place).groupBy("id", "side").agg(F.max("best").alias("best"))
            .filter(F.col("id") != F.col("best.id")).select(F.col("id").alias("a"), F.col("best.id").alias("b")))


def _leaders(low: np.ndarray, high: np.ndarray) -> list[int]:
    """For every range the place of the first one of its group, in the order given."""
    shared = np.minimum(high[:, None], high[None, :]) - np.maximum(low[:, None], low[None, :]) + 1
    linked = shared * 2 > np.minimum((high - low)[:, None], (high - low)[None, :]) + 1
    leaders = np.full(len(low), -1)
    for first in range(len(low)):
        waiting = [first] if leaders[first] < 0 else []
        while waiting:
            fresh = np.flatnonzero(linked[waiting.pop()] & (leaders < 0))
            leaders[fresh] = first
            waiting += fresh.tolist()
        leaders[first] = first if leaders[first] < 0 else leaders[first]
    return leaders.tolist()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _led(low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([_leaders(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(low, high)])


def overlap_groups(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_start, line_end, group) for distinct ranges; linked ranges share a group."""
    bounds = [*keys, "line_start", "line_end"]
    before = Window.partitionBy(*keys).orderBy("line_start", "line_end")
    reach = F.max("line_end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("line_start") <= F.col("_reach"), 0).otherwise(1)
    distinct = (ranges.select(*bounds).distinct().withColumn("id", F.concat_ws("\u0001", *bounds)).withColumn("_reach", reach)
                .withColumn("_island", F.sum(opens).over(before.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach"))
    distinct = cut_lineage(distinct.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_island"))))
    lone = distinct.filter("_n = 1").select(*bounds, F.col("id").alias("group"))
    few = (distinct.filter(f"_n between 2 and {ISLAND}").groupBy(*keys, "_island")
           .agg(F.sort_array(F.collect_list(F.struct("id", "line_start", "line_end"))).alias("r"))
           .select(*keys, "r", _led(F.col("r.line_start"), F.col("r.line_end")).alias("led")))
    placed = F.transform("r", lambda x, at: F.struct(x.line_start.alias("line_start"), x.line_end.alias("line_end"),
                                                     F.get("r", F.get("led", at)).id.alias("group")))
    few = few.select(*keys, F.explode(placed).alias("p")).select(*keys, "p.*")
    found = lone.unionByName(few)
    many = distinct.filter(f"_n > {ISLAND}").drop("_n", "_island")
    if many.isEmpty():
        return found
    grouped = components(overlap_links(many, keys))
    return found.unionByName(many.join(grouped, F.col("id") == F.col("node"), "left")
                             .select(*bounds, F.coalesce("component", "id").alias("group")))
