"""Exact similarity join of sets: every pair at or above a Jaccard threshold stays connected.

The members of all sets are put into one order, rare ones first.  Two sets of ``n`` members that reach the threshold share
one of their first ``n - ceil(threshold * n) + 1``, so only those are posted under their member (prefix filter).  A
meeting counts if the sizes allow the threshold (length filter) and so do the places in the order (position filter).  The
order is that of exact counts: any order gives the same links, but with counts that grow coarse on large inputs frequent
members would be posted, and their meetings grow with the square.  Members of one set only are counted, not carried.

Members that at most ``CROWD`` sets post are joined with themselves.  Of the others, neighbours are verified first, which
connects groups of near copies in a linear number of comparisons.  What is then left are meetings of sets that are not
connected yet.  They are listed in blocks of ``BLOCK`` sets, the largest connected group of a member against the rest and the
rest against itself, so no task sees more than two blocks and no pair within a group is listed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..session import cut_lineage
from .components import components

CROWD, BLOCK = 32, 512
BROADCAST_IDS = 1_000_000
# Scores are compared after rounding to six digits.
ROUNDING = 1e-6
POSTED = "id string, root string, token bigint, size int, place int"


def jaccard(a: Column, b: Column) -> Column:
    return _jaccard(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def _jaccard(shared: Column, a_size: Column, b_size: Column) -> Column:
    return F.round(shared / (a_size + b_size - shared), 6)


def scores(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, score) of pairs (a, b) of sets (id, members); with a column ``size``, ``members`` may lack those of no other set."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if asked.count() <= BROADCAST_IDS:
        sets = sets.join(F.broadcast(asked), "id", "left_semi")
    size = F.col("size") if "size" in sets.columns else F.size("members")
    side = lambda name: sets.select(F.col("id").alias(name), F.col("members").alias(f"_{name}"), size.alias(f"_{name}_size"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.select("a", "b", _jaccard(shared, F.col("_a_size"), F.col("_b_size")).alias("score"))


def ordered_sets(sets: DataFrame) -> DataFrame:
    """(id, size, members): the members that other sets have too, rarest first; ``size`` counts all members.

    One shuffle of the members counts them, and only shared ones go back to their sets.  A member has a row for each of its
    sets in one task, a set being there once.
    """
    rows = sets.select("id", F.size("members").alias("size"), F.explode("members").alias("token"))
    shared = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("n > 1")
    order = F.sort_array(F.collect_list(F.struct("n", "token")))
    return shared.groupBy("id", "size").agg(order.alias("order")).select("id", "size", F.col("order.token").alias("members"))


def postings(ordered_members: DataFrame, reach: float) -> DataFrame:
    """(id, token, size, place): those of the first members of every set in the common order that others have.

    Members that no other set has come first in that order, but nobody meets there.
    """
    alone = F.col("size") - F.size("members")
    first = F.col("size") - F.ceil(F.lit(reach) * F.col("size")).cast("int") + 1
    some = F.slice("members", F.lit(1), F.greatest(F.lit(0), first - alone))
    return (ordered_members.select("id", "size", alone.alias("alone"), F.posexplode(some).alias("at", "token"))
            .select("id", "size", (F.col("alone") + F.col("at")).alias("place"), "token"))


def _may_reach(a_size, a_place, b_size, b_place, reach: float, least, most):
    """Length and position filter, for columns and for arrays."""
    rest = 1 + least(a_size - a_place, b_size - b_place) - 1
    return (least(a_size, b_size) >= reach * most(a_size, b_size)) & (rest + ROUNDING >= reach / (1 + reach) * (a_size + b_size))


def _meetings(a: str, b: str, reach: float) -> Column:
    col = F.col
    return _may_reach(col(f"{a}size"), col(f"{a}place"), col(f"{b}size"), col(f"{b}place"), reach, F.least, F.greatest)


def _lone_pairs(posted: DataFrame, reach: float) -> DataFrame:
    """Meetings under members that few sets post."""
    a, b = posted.alias("a"), posted.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & _meetings("a.", "b.", reach))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _neighbours(posted: DataFrame, reach: float, order: list[str], bucket: Column) -> DataFrame:
    """Meetings of sets that follow each other under a member."""
    rows = ordered.with_previous(posted, ["token"], order, bucket, ["id", "size", "place"])
    met = rows.filter("prev_id is not null").filter(_meetings("", "prev_", reach))
    return met.select(F.least("id", "prev_id").alias("a"), F.greatest("id", "prev_id").alias("b")).distinct()


def _rooted(posted: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with ``root``, under members whose sets are not all connected."""
    roots = components(links)
    rows = (posted.join(roots.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("root", F.coalesce("component", "id")).drop("component"))
    open_ = rows.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("token")
    return cut_lineage(rows.join(open_, "token", "left_semi"))


def _open_pairs(posted: DataFrame, reach: float) -> DataFrame:
    """Meetings of sets with different roots, block against block."""
    groups = posted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("in_main"),
                                        F.sum("n").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK).cast("int"), F.lit(1))
    rows = (posted.join(sizes, "token").withColumn("inside", F.col("root") == F.col("main"))
            .withColumns({"mains": blocks(F.col("in_main")), "others": blocks(F.col("all") - F.col("in_main")), "turn": F.xxhash64("id")}))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    home = F.pmod("turn", F.when(F.col("inside"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    # A cell is (block of the main group or -1, block of the others); others also meet each other in cells (-1 - i, j).
    cells = F.when(F.col("inside"), F.transform(every(F.col("others")), lambda j: F.struct(F.col("home").alias("i"), j.alias("j")))).otherwise(
        F.concat(F.transform(every(F.col("mains")), lambda i: F.struct(i.alias("i"), F.col("home").alias("j"))),
                 F.transform(every(F.col("others")), lambda j: F.struct(
                     (-1 - F.least("home", j)).alias("i"), F.greatest("home", j).alias("j")))))
    spread = (rows.withColumn("home", home).withColumn("cell", F.explode(cells))
              .select("token", "cell.i", "cell.j", "inside", "id", "root", "size", "place"))

    def compare(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        if key[1] >= 0:
            left, right = members[members["inside"]], members[~members["inside"]]
        else:
            left = right = members
        found = []
        # A member is copied into a cell once, so blocks are as large as their hash makes them; rows go in slices.
        for start in range(0, len(left), BLOCK):
            part = left.iloc[start:start + BLOCK]
            a = [part[name].to_numpy()[:, None] for name in ("size", "place", "id", "root")]
            b = [right[name].to_numpy()[None, :] for name in ("size", "place", "id", "root")]
            met = _may_reach(a[0], a[1], b[0], b[1], reach, np.minimum, np.maximum) & (a[3] != b[3])
            x, y = np.nonzero(met)
            found.append(pd.DataFrame({"a": a[2][x, 0], "b": b[2][0, y]}))
        pairs = pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype=str)
        swap = pairs["a"] > pairs["b"]
        pairs.loc[swap, ["a", "b"]] = pairs.loc[swap, ["b", "a"]].to_numpy()
        return pairs.drop_duplicates()

    return spread.groupBy("token", "i", "j").applyInPandas(compare, "a string, b string").distinct()


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): verified pairs of sets (id, members); sets that reach the threshold are connected by them.

    ``members`` are distinct longs, ``id`` is a string.  Within crowded groups not every pair is listed, but none of
    them is left unconnected.  Empty sets are like none.
    """
    return links(cut_lineage(ordered_sets(sets)), threshold)


def links(sets: DataFrame, threshold: float) -> DataFrame:
    """The links of ``similar_sets`` from stored ``ordered_sets``."""
    reach = threshold - ROUNDING
    posted = cut_lineage(postings(sets, reach))
    numbers = cut_lineage(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    verified = lambda pairs: cut_lineage(scores(cut_lineage(pairs), sets).filter(F.col("score") >= threshold))
    lone = _lone_pairs(posted.join(numbers.filter(F.col("n") <= CROWD).select("token"), "token"), reach)
    crowded = numbers.filter(F.col("n") > CROWD).select("token")
    if crowded.isEmpty():
        return verified(lone)
    rest = cut_lineage(posted.join(crowded, "token", "left_semi").withColumn("turn", F.xxhash64("id")))
    # Near copies that follow each other by hash, then, of those still apart, by size.
    found = verified(lone.unionByName(_neighbours(rest, reach, ["turn", "id"], F.shiftright("turn", 57))))
    rest = _rooted(rest, found)
    found = found.unionByName(verified(_neighbours(rest, reach, ["size", "turn", "id"], F.col("size"))))
    rest = _rooted(rest.drop("root"), found)
    return cut_lineage(found.unionByName(verified(_open_pairs(rest, reach))).distinct())
