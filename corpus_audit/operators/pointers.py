"""Following pointers to their end in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def chain_ends(links: DataFrame) -> DataFrame:
    """(key, end, steps, ring) of a table (key, next) with one row per key.

    Each round doubles how far every pointer looks ahead.  A key in a ring, or leading into one, has no
    end; it is marked and keeps some member of the ring.
    """
    links = cut_lineage(links.select("key", F.col("next").alias("end"), F.lit(1).cast("bigint").alias("steps")))
    # Enough doublings to pass every key, and one more in which only rings still move.
    rounds = links.count().bit_length() + 1
    result = links.withColumn("ring", F.lit(True))
    for _ in range(rounds):
        ahead = links.select(F.col("key").alias("end"), F.col("end").alias("end2"), F.col("steps").alias("steps2"))
        result = cut_lineage(links.join(ahead, "end", "left").select(
            "key", F.coalesce("end2", "end").alias("end"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
            F.col("end2").isNotNull().alias("ring")))
        links = result.drop("ring")
        if result.filter("ring").isEmpty():
            break
    return result
