"""Near duplicates by an exact join of shingle sets; semantic duplicates by products of blocks of vectors.

``leader_links`` serves members in buckets of any kind.  Every bucket has one leader, its smallest member; all others are
verified against it and leave the bucket when they match.  Whoever does not match stays, and the rest elects a new leader,
until every bucket is empty.  So each member is either a leader or carries a verified link.  The first round compares a
member once; later rounds, when the copies are gone, settle 2, 4, 8 and then 16 leaders of a bucket at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from . import setjoin
from .components import components

MAX_LEADERS_PER_ROUND = 16


def _leading(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """(bucket, pos) of the candidates that lead: those that match no leading candidate before them.

    A bucket's list holds at most ``MAX_LEADERS_PER_ROUND`` candidates.
    """
    own = candidates.select("bucket", F.col("leader").alias("id"), F.col("pos").alias("own"))
    before = hits.join(own, ["bucket", "id"]).groupBy("bucket", "own").agg(F.collect_set("pos").alias("matched"))
    rows = candidates.select("bucket", F.col("pos").alias("own")).join(before, ["bucket", "own"], "left")
    listed = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct(
        F.col("own").alias("pos"), F.coalesce("matched", F.expr("cast(array() as array<int>)")).alias("matched")))).alias("c"))
    leads = F.aggregate("c", F.expr("cast(array() as array<int>)"), lambda acc, c: F.when(
        F.arrays_overlap(acc, c.matched), acc).otherwise(F.concat(acc, F.array(c.pos))))
    return listed.select("bucket", F.explode(leads).alias("pos"))


def leader_links(members: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Verified (id, leader, score) links of a table (bucket, id).

    ``score`` adds a ``score`` column to distinct (id, leader) rows.  Each member links to the first
    leader it matches, leaders being elected in id order.
    """
    members = members.select("bucket", "id").distinct()
    # A member that is alone in its bucket has nobody to meet there.
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    remaining = cut_lineage(members.join(crowded, "bucket", "left_semi"))
    links, width = [], 1
    while True:
        # The rank limit works before the shuffle too: a hot bucket ships a few rows per task.
        position = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        candidates = (remaining.withColumn("pos", position).filter(F.col("pos") <= width)
                      .select("bucket", F.col("id").alias("leader"), "pos"))
        pairs = cut_lineage(remaining.join(candidates, "bucket").filter("id > leader"))
        if pairs.isEmpty():
            break
        matched = score(pairs.select("id", "leader").distinct()).filter(F.col("score") >= threshold).select("id", "leader", "score")
        hits = cut_lineage(pairs.join(matched, ["id", "leader"]))
        own = pairs.select("bucket", "leader", "pos").distinct()
        leading = own.join(_leading(own, hits), ["bucket", "pos"]) if width > 1 else own
        chosen = (hits.join(leading.select("bucket", "pos"), ["bucket", "pos"]).groupBy("bucket", "id")
                  .agg(F.min(F.struct("pos", "leader", "score")).alias("first")))
        links.append(chosen.select("id", "first.leader", "first.score").distinct())
        settled = chosen.select("bucket", "id").unionByName(leading.select("bucket", F.col("leader").alias("id")))
        remaining = cut_lineage(pairs.select("bucket", "id").distinct().join(settled, ["bucket", "id"], "left_anti"))
        width = min(2 * width, MAX_LEADERS_PER_ROUND)
    if not links:
        return remaining.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, links).distinct()


def shingle_hashes(text: Column, size: int = 3) -> Column:
    """Distinct hashes of word shingles, without putting them together; a shorter text is one shingle."""
    def build(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))),
                                            lambda i: F.xxhash64(*[F.get(w, i + at) for at in range(size)])))
    return tx.let(tx.words(text), build)


def near_duplicates(files: DataFrame, threshold: float = 0.7, size: int = 3) -> DataFrame:
    """(path, leader, score): files that chains of similar files connect, and the Jaccard similarity with the group's first.

    Files are similar if their sets of ``size``-word shingles reach ``threshold``; ``leader`` is the smallest path of the group,
    and ``score`` may be below the threshold for files that others connect with it.  No pair that reaches the threshold is
    lost.  Files with the same word sequence enter as one.  Files without words are like none.
    """
    no_words = F.col("sequence") == F.md5(F.lit(""))
    every = cut_lineage(files.select("path", F.md5(F.concat_ws(" ", tx.words(F.col("text")))).alias("sequence")).filter("path is not null"))
    keyed = every.filter(~no_words)
    copies = cut_lineage(keyed.join(keyed.groupBy("sequence").agg(F.min("path").alias("first")), "sequence").select("path", "first"))
    # The few that go are named, not the many that stay, so that texts need no shuffle.
    dropped = copies.filter("path <> first").select("path").unionByName(every.filter(no_words).select("path"))
    if dropped.count() <= setjoin.BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    sets = (files.filter("path is not null").join(dropped, "path", "left_anti")
            .select(F.col("path").alias("id"), shingle_hashes(F.col("text"), size).alias("members")))
    sets = cut_lineage(setjoin.ordered_sets(sets))
    groups = cut_lineage(components(setjoin.links(sets, threshold)))
    others = cut_lineage(groups.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    scored = setjoin.scores(others, sets).select(F.col("b").alias("first"), F.col("a").alias("leader"), "score")
    return (copies.join(scored, "first", "left").select(
        "path", F.coalesce("leader", "first").alias("leader"), F.coalesce("score", F.lit(1.0)).alias("score")).filter("path <> leader"))


# Rows of the Walsh matrix that serve as hyperplanes; row 0 is left out, its side is the sign of the sum.
PLANES = 63


def sign_bits(vector: Column) -> Column:
    """The sides of all hyperplanes as the bits of one long."""
    def side(row: Column) -> Column:
        signed = F.transform(vector, lambda v, j: v.cast("double") * (1 - 2 * (F.bit_count(row.bitwiseAND(j)) % 2)))
        total = F.aggregate(signed, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(total >= 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    sides = F.transform(F.sequence(F.lit(1), F.lit(PLANES)), side)
    weights = F.array(*[F.lit(1 << at).cast("bigint") for at in range(PLANES)])
    return F.aggregate(F.zip_with(sides, weights, lambda s, w: s * w), F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def bands_for(threshold: float, bits: int, recall: float) -> int:
    """How many buckets of ``bits`` sides a vector needs, so that a pair at ``threshold`` shares one with chance ``recall``."""
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def band_masks(bands: int, bits: int) -> list[int]:
    """The sides each band looks at: different rows within a band, other strides from band to band."""
    strides = [n for n in range(1, PLANES) if math.gcd(n, PLANES) == 1]
    return [sum(1 << ((band * 5 + k * strides[band % len(strides)]) % PLANES) for k in range(bits)) for band in range(bands)]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, null if one has no length."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                           lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


# Vectors of a block, and of the slice of a block that is multiplied at once.
BLOCK, SLICE = 8192, 1024
# Products of single precision that are this close to the threshold are decided in double precision.
MARGIN = 1e-4


def _unit(vectors: DataFrame) -> DataFrame:
    """(id, dims, unit): vectors of length one as the bytes of their floats; vectors without a direction are left out."""
    @F.pandas_udf("binary")
    def unit(values: pd.Series) -> pd.Series:
        def of(v):
            v = np.array(v, dtype=np.float64)
            length = np.linalg.norm(v / max(np.abs(v).max(initial=0.0), 1e-300)) * np.abs(v).max(initial=0.0)
            return (v / length).astype("<f4").tobytes() if np.isfinite(length) and length > 0 else None
        return pd.Series([None if v is None else of(v) for v in values], dtype=object)
    return (vectors.select("id", F.size("embedding").alias("dims"), unit(F.col("embedding")).alias("unit")).filter("unit is not null"))


def _products(left: pd.DataFrame, right: pd.DataFrame, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both blocks and products of the pairs from ``least`` on, a slice of the left block at a time."""
    stacked = lambda rows: np.frombuffer(b"".join(rows["unit"]), "<f4").reshape(len(rows), -1)
    b = stacked(right).T
    for start in range(0, len(left), SLICE):
        products = stacked(left.iloc[start:start + SLICE]) @ b
        x, y = np.nonzero(products >= least)
        yield x + start, y, products[x, y]


def _first_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, leader, score) of all pairs that reach the threshold and whose leader has no such pair with a smaller id.

    Also a row (id, null, null) for members that have such pairs, but with other members only.  All blocks meet all blocks, in
    tasks of two blocks.  A vector that meets a smaller id in its own block leads none, so a large group of near copies makes
    rows for few leaders a block.
    """
    units = _unit(vectors)
    units = cut_lineage(units)
    blocks = max(1, math.ceil(units.count() / BLOCK))
    units = units.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    kind = vectors.schema["id"].dataType.simpleString()

    def follow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, found = rows["id"].to_numpy(), np.zeros(len(rows), bool)
        for x, y, _ in _products(rows, rows, threshold + MARGIN):
            found[x[ids[x] > ids[y]]] = True
        return rows.assign(follows=found)

    marked = cut_lineage(units.groupBy("dims", "block").applyInPandas(
        follow, f"id {kind}, dims int, unit binary, block int, follows boolean"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda other: F.struct(
        F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    spread = marked.withColumn("cell", F.explode(cells)).select("dims", "cell.i", "cell.j", "block", "id", "unit", "follows")

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["block"] == key[1]], rows[rows["block"] == key[2]]
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        a_follows, b_follows = left["follows"].to_numpy(bool), right["follows"].to_numpy(bool)
        members, leaders, sure = [a[:0]], [a[:0]], [a[:0]]
        for x, y, product in _products(left, right, threshold - MARGIN):
            for own, other, smaller in ((a[x], b[y], b_follows[y]), (b[y], a[x], a_follows[x])):
                later = own > other
                certain = product > threshold + MARGIN
                asked = later & ~(smaller & certain)
                members.append(own[asked])
                leaders.append(other[asked])
                sure.append(np.unique(own[later & smaller & certain]))
        sure = np.unique(np.concatenate(sure))
        pairs = pd.DataFrame({"id": np.concatenate(members), "leader": np.concatenate(leaders)}).drop_duplicates()
        return pd.concat([pairs.assign(known=False), pd.DataFrame({"id": sure, "leader": sure, "known": True})])

    met = cut_lineage(spread.groupBy("dims", "i", "j").applyInPandas(meet, f"id {kind}, leader {kind}, known boolean"))
    of = lambda side, name: vectors.select(F.col("id").alias(side), F.col("embedding").alias(name))
    asked = met.filter("not known").select("id", "leader").join(of("id", "e1"), "id").join(of("leader", "e2"), "leader")
    hits = cut_lineage(asked.select("id", "leader", F.round(cosine(F.col("e1"), F.col("e2")), 6).alias("score"))
                       .filter(F.col("score") >= threshold))
    members = cut_lineage(hits.select("id").unionByName(met.filter("known").select("id")).distinct())
    links = hits.join(members.select(F.col("id").alias("leader")), "leader", "left_anti").select("id", "leader", "score")
    return links.unionByName(members.join(links, "id", "left_anti"), allowMissingColumns=True)


def semantic_duplicates(vectors: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, leader, score): vectors whose cosine with a leader reaches the threshold, with every leader they reach.

    A leader is a vector without such a link to a smaller id; of vectors that reach members only, the first ones lead again, until
    every vector leads or is linked.  Equal vectors are joined to the smallest id first and have its links.  All pairs of
    different vectors are compared, so none is missed and further vectors change nothing between those that come before them.
    A vector without length has no direction and links only to its copies.
    """
    keyed = vectors.select("vec_id", F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>"))).alias("key"))
    first = keyed.groupBy("key").agg(F.min("vec_id").alias("first"))
    copies = cut_lineage(keyed.join(first, "key").filter("vec_id <> first").select("vec_id", "first"))
    rest = cut_lineage(vectors.join(first.select(F.col("first").alias("vec_id")), "vec_id", "left_semi")
                       .select(F.col("vec_id").alias("id"), "embedding"))
    found = []
    while True:
        links = cut_lineage(_first_links(rest, threshold))
        found.append(links.filter("leader is not null"))
        left = links.filter("leader is null").select("id")
        if left.isEmpty():
            break
        rest = cut_lineage(rest.join(left, "id", "left_semi"))
    links = reduce(DataFrame.unionByName, found)
    of_first = links.select(F.col("id").alias("first"), "leader", "score")
    again = copies.join(of_first, "first", "left").select(
        "vec_id", F.coalesce("leader", "first").alias("leader"), F.coalesce("score", F.lit(1.0)).alias("score"))
    return links.withColumnRenamed("id", "vec_id").unionByName(again)
