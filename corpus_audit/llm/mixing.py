"""Mixing sources to target weights by Poisson replication.

A source with weight w of the target mix and s of the corpus' bytes gets the mean repetition rate w / s (times
``budget``, the size of the mix in units of the corpus).  The number of copies of a document is Poisson with that mean:
a uniform number drawn from a seeded hash of its doc_id is looked up in the source's cumulative distribution.  Rates
above ``CHUNK`` are sums of several such draws.  All copies are then put in one global random order: the order key is a
seeded hash of (doc_id, copy), partitions are ranges of that key and are sorted by it.

Defined cases: a null source is a source of its own; a null or empty text has no bytes but takes part with its source's
rate; a source without any byte has rate 1; rows that share a doc_id share their number of copies within a source; a
null doc_id hashes like an empty one; an empty table gives an empty result.  The documents' columns come back as the
struct ``record``, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

CHUNK = 500.0
DRAW_BITS = 52
BROADCAST_SOURCES = 10_000
PARTITION_BYTES = 128 << 20


def draw(*parts: Column | str) -> Column:
    """A whole number below 2**52 from the MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def _sizes(docs: DataFrame, source: str, text: str) -> DataFrame:
    return docs.groupBy(F.col(source).alias("source")).agg(
        F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0)).alias("size"))


def rates(docs: DataFrame, targets: DataFrame | None = None, budget: float = 1.0, source: str = "source",
          text: str = "text") -> DataFrame:
    """(source, size, rate) of every source of ``docs``.

    ``targets`` has (source, weight); a source it does not name has weight 0.  Without targets a source weighs the
    square root of its size, which lifts small sources without making them equal to large ones.
    """
    sizes = stored(_sizes(docs, source, text), "source-sizes")
    if targets is None:
        weighed = sizes.withColumn("weight", F.sqrt("size"))
    else:
        wanted = targets.groupBy(F.col("source").alias("name")).agg(F.sum("weight").alias("weight"))
        weighed = (sizes.join(wanted, F.col("source").eqNullSafe(F.col("name")), "left")
                   .select("source", "size", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")))
    # Sums of decimals do not depend on the order of the rows.
    total = weighed.agg(F.sum("size").alias("size"),
                        F.sum(F.col("weight").cast("decimal(30,6)")).cast("double").alias("weight")).first()
    scale = budget * float(total["size"] or 0)
    rate = F.col("weight") * F.lit(scale) / F.nullif(F.lit(total["weight"] or 0.0), F.lit(0.0)) / F.col("size")
    return weighed.select("source", "size", F.when(F.col("size") == 0, 1.0).otherwise(
        F.coalesce(F.round(rate, 9), F.lit(0.0))).alias("rate"))


def _distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... far enough into the tail for a double."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.exp(-mean)
    steps = F.aggregate(
        F.sequence(F.lit(1), last), F.struct(start.alias("p"), start.alias("c"), F.array(start).alias("all")),
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), (acc["c"] + acc["p"] * mean / k).alias("c"),
                                F.concat(acc["all"], F.array(acc["c"] + acc["p"] * mean / k)).alias("all")))
    return steps["all"]


def mixed(docs: DataFrame, targets: DataFrame | None = None, budget: float = 1.0, seed: int = 17,
          source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(record, rate, copies, copy, shuffle_key), one row per copy, in global random order."""
    plan = rates(docs, targets, budget, source, text)
    chunks = F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int")
    plan = stored(plan.withColumn("chunks", chunks).withColumn("table", _distribution(F.col("rate") / F.col("chunks"))), "rates")
    known = plan.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("rate")).alias("bytes")).first()
    plan = plan.withColumnRenamed("source", "plan_source").drop("size")
    if known["n"] <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    uniform = lambda k: draw(F.lit(f"{seed}.count"), F.col("doc_key"), k.cast("string")) / F.lit(2.0 ** DRAW_BITS)
    copies = F.aggregate(F.sequence(F.lit(1), F.col("chunks")), F.lit(0).cast("long"), lambda n, k: n + F.size(
        F.filter("table", lambda c: c <= uniform(k))).cast("long"))
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("record"),
                       F.col(source).alias("doc_source"), F.col(doc_id).cast("string").alias("doc_key"))
    copied = (rows.join(plan, F.col("doc_source").eqNullSafe(F.col("plan_source")))
              .withColumn("copies", copies).filter("copies > 0")
              .select("record", "doc_key", "rate", "copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
              .withColumn("shuffle_key", draw(F.lit(f"{seed}.order"), "doc_key", "copy")))
    session = docs.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), int((known["bytes"] or 0) // PARTITION_BYTES) + 1)
    place = (F.col("shuffle_key") / F.lit(2.0 ** DRAW_BITS) * parts).cast("int")
    return (copied.withColumn("place", place).repartitionById(parts, F.col("place"))
            .sortWithinPartitions("shuffle_key", "doc_key", "copy").drop("place", "doc_key"))
