"""SimHash near duplicates, found by a grid join over segment bit counts.

A fingerprint is cut into 32 segments of two bits, and each segment is mapped to its number of set bits.  The Manhattan
distance of these vectors never exceeds the Hamming distance of the fingerprints, so it is a lower bound.  Two
fingerprints at most three bits apart are at most one bit apart in one of their halves (at most seven: in one of their
quarters), and there their vectors are equal or differ by one in one segment.  Each fingerprint therefore lies in the grid
cell of each part and also shows itself in the cells one step above; whoever meets in a cell is within the bound and is
then verified exactly.  Wider limits mean smaller parts and fuller cells: seven bits suit tens of millions of texts.

Equal fingerprints are one node.  A crowded cell is cut into blocks of about ``BLOCK`` nodes, blocks meet in tasks of
their own, and every meeting returns a spanning forest of its links, so the links of a dense group grow with its
members and none of its connections is lost.

Defined cases: a null or empty text has no shingle and the fingerprint zero, which links like any other; repeated rows
share their fingerprint; a null doc_id keeps its row and never names a component unless it has only such rows; an
empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .storage import stored

MAX_BITS = 3
SEGMENTS = 32
BLOCK = 1024
# Blocks whose members carry their shingles.
OPEN_BLOCK = 256
BROADCAST_ROWS, BROADCAST_CELLS = 1_000_000, 100_000
PAIR_MASK = 0x55555555
STEPS = 1 << 16
LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def shingle_hashes(text: str | None, words_each: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    if len(words) < words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[at:] for at in range(words_each))))
    return np.fromiter((xxhash.xxh64_intdigest(shingle, 42) for shingle in shingles), dtype="<u8")


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 where it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, words_each)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), STEPS):
        part = hashes[at:at + STEPS]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(text: Column, words_each: int = 3) -> Column:
    """The fingerprint as a signed long."""
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words_each) for t in texts], dtype=np.uint64).view(np.int64))
    return of(text)


def _parts(max_bits: int) -> list[tuple[int, int]]:
    """(first segment, segments) of the parts, one of which holds at most one of ``max_bits`` differing bits."""
    n = max(2, max_bits // 2 + 1)
    bounds = [SEGMENTS * part // n for part in range(n + 1)]
    return [(low, high - low) for low, high in zip(bounds, bounds[1:])]


def _cells(node: Column, max_bits: int) -> Column:
    """The own cell of each part (``own``) and the cells one step above it."""
    found = []
    for part, (first, segments) in enumerate(_parts(max_bits)):
        bits = F.shiftrightunsigned(node, 2 * first).bitwiseAND(F.lit((1 << (2 * segments)) - 1))
        counts = bits.bitwiseAND(F.lit(PAIR_MASK)) + F.shiftright(bits, 1).bitwiseAND(F.lit(PAIR_MASK))
        place = F.lit(part << 34)
        found.append(F.array(F.struct((counts + place).alias("cell"), F.lit(True).alias("own"))))
        above = [F.when(F.shiftright(counts, 2 * at).bitwiseAND(F.lit(3)) < 2, F.struct(
            (counts + place + F.lit(1 << (2 * at))).alias("cell"), F.lit(False).alias("own"))) for at in range(segments)]
        found.append(F.array_compact(F.array(*above)))
    return F.concat(*found)


def _forest(own: np.ndarray, members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``own`` and ``members``."""
    if len(own) * len(members) <= 16:
        return [(int(a), int(b)) for a in own for b in members
                if a != b and int(np.bitwise_count(np.uint64(a ^ b))) <= max_bits]
    linked = np.bitwise_count(own[:, None] ^ members[None, :]) <= max_bits
    links, seen_own, seen_members = [], np.zeros(len(own), bool), np.zeros(len(members), bool)
    for first in range(len(own)):
        if seen_own[first]:
            continue
        seen_own[first] = True
        waiting = [(True, first)]
        while waiting:
            is_own, at = waiting.pop()
            if is_own:
                fresh = np.flatnonzero(linked[at] & ~seen_members)
                seen_members[fresh] = True
                links += [(int(own[at]), int(members[other])) for other in fresh]
            else:
                fresh = np.flatnonzero(linked[:, at] & ~seen_own)
                seen_own[fresh] = True
                links += [(int(own[other]), int(members[at])) for other in fresh]
            waiting += [(not is_own, int(other)) for other in fresh]
    return [(a, b) for a, b in links if a != b]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _verified(own: Column, members: Column, max_bits: int) -> Column:
    @F.pandas_udf(LINKS)
    def of(owners: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([[(_signed(a), _signed(b)) for a, b in _forest(
            np.asarray(x, np.int64).view(np.uint64), np.asarray(y, np.int64).view(np.uint64), max_bits)]
            for x, y in zip(owners, others)])
    return of(own, members)


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): a forest that connects all distinct fingerprints ``node`` with links of at most ``max_bits`` bits."""
    entries = nodes.select("node", F.explode(_cells(F.col("node"), max_bits)).alias("c")).select("node", "c.cell", "c.own")
    crowds = stored(entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"))
                    .filter("n_own > 0 AND n > 1").select("cell", F.ceil(F.col("n") / BLOCK).alias("blocks")), "crowds")
    # Spark takes the entries for no more than the nodes they were exploded from, and would broadcast them.
    crowds = F.broadcast(crowds) if crowds.count() <= BROADCAST_CELLS else crowds.hint("merge")
    blocks = (entries.join(crowds, "cell")
              .groupBy("cell", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
              .agg(F.collect_list(F.when(F.col("own"), F.col("node"))).alias("owners"),
                   F.collect_list("node").alias("members")))
    blocks = stored(blocks, "cells")
    meetings = (blocks.filter(F.size("owners") > 0).select("cell", "owners")
                .join(blocks.select("cell", "members"), "cell"))
    return meetings.select(F.explode(_verified(F.col("owners"), F.col("members"), max_bits)).alias("l")).select("l.a", "l.b")


def _rooted(marked: DataFrame, max_bits: int) -> DataFrame:
    """(node, first_doc, root) of all distinct fingerprints; the root names the connected group."""
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("first_doc")), "nodes")
    roots = components(links(nodes, max_bits)).withColumnRenamed("component", "root")
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_each: int = 3,
            max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is named by its smallest doc_id."""
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words_each).alias("node")),
                    "fingerprints")
    named = _rooted(marked, max_bits)
    names = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = named.join(names, "root").select("node", "component_id")
    return (marked.join(named, "node")
            .select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"))


def fingerprint_pair(text: str | None, words_each: int) -> tuple[int, int]:
    """Two independent 64-bit fingerprints, from the halves of every shingle's XXH128 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = zip(*(words[at:] for at in range(words_each))) if len(words) >= words_each else [words] if words else []
    counts, total = np.zeros(128, dtype=np.int64), 0
    for part in batched(map(b" ".join, shingles), STEPS):
        digests = np.frombuffer(b"".join(xxhash.xxh128_digest(shingle, 42) for shingle in part), np.uint8).reshape(-1, 16)
        counts += np.unpackbits(digests, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(digests)
    low, high = np.packbits(counts * 2 > total, bitorder="little").view("<i8")
    return int(low), int(high)


def fingerprint_pairs(text: Column, words_each: int) -> Column:
    @F.pandas_udf("f0 long, f1 long")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fingerprint_pair(t, words_each) for t in texts], columns=["f0", "f1"], dtype="int64")
    return of(text)


def shingle_sets(text: Column, words_each: int) -> Column:
    """The distinct shingle hashes of every text."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words_each)).view(np.int64) for t in texts])
    return of(text)


def _near_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): nodes that one of their two fingerprints puts within ``max_bits``, as a forest for each of the two.

    Nodes that share a fingerprint hang onto the smallest of them, which meets the others for them.
    """
    found = []
    for name in ("f0", "f1"):
        shared = stored(nodes.groupBy(name).agg(F.min("node").alias("head")), "shared")
        found.append(nodes.join(shared, name).filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")))
        near = links(shared.select(F.col(name).alias("node")), max_bits)
        found.append(near.join(shared.select(F.col(name).alias("a"), F.col("head").alias("ha")), "a")
                     .join(shared.select(F.col(name).alias("b"), F.col("head").alias("hb")), "b").select("ha", "hb"))
    pairs = reduce(DataFrame.union, found)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _forest_across(left: pd.DataFrame, right: pd.DataFrame | None, max_bits: int, similarity: float) -> list[tuple[int, int]]:
    """A forest of the links between rows (node, f0, f1, root, grams) of different roots; without ``right`` among ``left`` themselves.

    A link needs one of the fingerprints within ``max_bits`` and sets that are similar enough.  Roots that a link connects are one from then on.
    """
    rows = left if right is None else pd.concat([left, right], ignore_index=True)
    nodes, (_, roots) = rows["node"].to_numpy(), np.unique(rows["root"].to_numpy(), return_inverse=True)
    f0, f1 = (rows[name].to_numpy(np.int64).view(np.uint64) for name in ("f0", "f1"))
    sets = [np.asarray(grams, np.int64) for grams in rows["grams"]]
    sizes = np.array([len(grams) for grams in sets])
    ends = np.cumsum(sizes)
    distinct, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    marked, links = np.zeros(len(distinct), bool), []
    for at in range(len(left)):
        first = at + 1 if right is None else len(left)
        near = (np.bitwise_count(f0[first:] ^ f0[at]) <= max_bits) | (np.bitwise_count(f1[first:] ^ f1[at]) <= max_bits)
        others = first + np.flatnonzero(near & (roots[first:] != roots[at]))
        if not len(others):
            continue
        own = tokens[ends[at] - sizes[at]:ends[at]]
        marked[own] = True
        for other in others:
            if roots[other] == roots[at]:
                continue
            shared = np.count_nonzero(marked[tokens[ends[other] - sizes[other]:ends[other]]])
            either = sizes[at] + sizes[other] - shared
            if either == 0 or shared >= similarity * either:
                links.append((int(nodes[at]), int(nodes[other])))
                roots[roots == roots[other]] = roots[at]
        marked[own] = False
    return links


def _open_links(nodes: DataFrame, pairs: DataFrame, linked: DataFrame, sets: DataFrame, max_bits: int, similarity: float) -> DataFrame:
    """(a, b): a forest of what the forest ``pairs`` left out, links within ``max_bits`` that ``linked`` does not connect.

    Only groups of the forest that verification took apart have such links.  The largest part of a group meets the rest, and the rest
    itself, in blocks that verify their own pairs and return a forest, so no pair is a row.
    """
    groups = components(pairs).withColumnRenamed("component", "group")
    roots = components(linked).withColumnRenamed("component", "root")
    parts = stored(groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "parts")
    sizes = (parts.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("group")
             .agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("all"))
             .filter("in_main < all"))
    blocks = lambda n: F.ceil(n / OPEN_BLOCK).cast("int")
    rows = (parts.join(sizes, "group").withColumn("inside", F.col("root") == F.col("main"))
            .withColumns({"mains": blocks(F.col("in_main")), "others": blocks(F.col("all") - F.col("in_main"))}))
    home = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # A cell is (block of the main part, block of the others); others also meet each other in cells (-1 - i, j).
    cells = F.when(F.col("inside"), F.transform(every(F.col("others")), lambda j: F.struct(F.col("home").alias("i"), j.alias("j")))).otherwise(
        F.concat(F.transform(every(F.col("mains")), lambda i: F.struct(i.alias("i"), F.col("home").alias("j"))),
                 F.transform(every(F.col("others")), lambda j: F.struct((-1 - F.least("home", j)).alias("i"), F.greatest("home", j).alias("j")))))
    spread = (rows.withColumn("home", home).withColumn("cell", F.explode(cells)).join(nodes.select("node", "f0", "f1"), "node").join(sets, "node")
              .select("group", "cell.i", "cell.j", "inside", "home", "node", "f0", "f1", "root", "grams"))

    def compare(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        if key[1] < 0 and -1 - key[1] == key[2]:
            left, right = members, None
        else:
            side = members["inside"] if key[1] >= 0 else members["home"] == key[2]
            left, right = members[side], members[~side]
        found = _forest_across(left.reset_index(drop=True), right, max_bits, similarity) if len(members) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return spread.groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those ``pairs`` whose shingle sets have at least this Jaccard similarity; two empty sets are alike."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("grams").alias(f"grams_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("n", F.size(F.array_intersect("grams_a", "grams_b")))
    either = F.size("grams_a") + F.size("grams_b") - F.col("n")
    return both.filter((either == 0) | (F.col("n") >= similarity * either)).select("a", "b")


def kept(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_each: int = 2, max_bits: int = 7,
         verify_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of every group, the first by doc_id (null last), with all its columns.

    Candidates are texts of which one of two fingerprints of ``words_each``-word shingles differs in at most ``max_bits`` bits; they are
    linked if the sets of their ``verify_words``-word shingles are similar enough.  A forest of the candidates is verified first, then
    all candidates that this leaves apart, so no link is lost.  Texts equal in all 128 bits count as copies.
    """
    record = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    marked = docs.select(record.alias("record"), F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                         fingerprint_pairs(F.col(text), words_each).alias("f"))
    marked = stored(marked.select("record", "doc_id", "row", "f.f0", "f.f1", F.xxhash64("f.f0", "f.f1").alias("node")), "fingerprints")
    # Rows are counted in by fingerprint before groups come in, so that a large group of copies is one row from then on.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row"))
    firsts = stored(marked.groupBy("node", "f0", "f1").agg(F.min(place).alias("first")), "nodes")
    pairs = stored(_near_links(firsts, max_bits), "candidates")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = firsts.join(asked, "node", "left_semi").select("node", F.col("first.row").alias("row"))
    texts = marked.select("row", F.col(f"record.`{text}`").alias("text")).join(asked, "row")
    sets = stored(texts.select("node", shingle_sets(F.col("text"), verify_words).alias("grams")), "shingles")
    linked = stored(_similar(pairs, sets, similarity), "similar")
    again = stored(_open_links(firsts, pairs, linked, sets, max_bits, similarity), "open-links")
    roots = components(linked.union(again)).withColumnRenamed("component", "root")
    firsts = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = firsts.groupBy("root").agg(F.min("first").alias("head"))
    heads = firsts.join(heads, "root").select("node", F.col("head.row").alias("head"))
    dropped = stored(marked.select("node", "row").join(heads, "node").filter("row <> head").select("row"), "near-copies")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return marked.join(dropped, "row", "left_anti").select(*[F.col(f"record.`{name}`").alias(name) for name in docs.columns])
