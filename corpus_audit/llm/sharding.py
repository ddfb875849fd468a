"""Shards in random order by a two-pass external shuffle, with DataFrame operations only.

The shard of a row follows from its key and the number of shards alone (highest seeded hash of key and shard wins), so
one more shard takes rows only into itself.  The first pass scatters the rows of every shard uniformly over buckets of
about ``bucket_bytes`` by a seeded hash of key and place in the input, so that a key that many rows share does not fill
one bucket.  The second pass takes each bucket into memory, puts it in random order with Spark's seeded Fisher-Yates
``shuffle``, and writes it as a file of its shard.  A row's slot is its place in its bucket plus the sizes of the buckets
before it.

``bucket_bytes`` is the unit of memory (a task holds a few times as much) and of files: 32 MB suits small executors,
512 MB those with 4 GB or more for each core.

Defined cases: a null key is a key like any other; a null text has no bytes and the checksum of an empty one; rows that
share a key share a shard, repeated rows get slots of their own; an empty table gives an empty dataset.  The input's
columns are kept in the struct ``record``, so they may have any name.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_BYTES = 8
BUCKET_BYTES = 32 << 20


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """The shard whose hash with the key is highest."""
    bids = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(shard)).alias("bid"), F.lit(shard).alias("shard")) for shard in range(n_shards)]
    return F.greatest(*bids)["shard"] if n_shards > 1 else F.lit(0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 11, key: str = "doc_id", text: str = "text",
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows as ``path/shard=.../`` files; returns (shard, bucket, place, record) as read back."""
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("record"),
                       F.col(key).alias("key"), size_of(F.col(text)).alias("size"))
    rows = rows.withColumn("shard", shard_of(F.col("key"), n_shards, seed))
    held = {row["shard"]: row["bytes"] for row in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    buckets = [max(1, ceil(held.get(shard, 0) / bucket_bytes)) for shard in range(n_shards)]
    first = [sum(buckets[:shard]) for shard in range(n_shards)]
    of_shard = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)
    scattered = (rows.withColumn("turn", F.xxhash64(F.lit(seed), "key", F.monotonically_increasing_id()))
                 .withColumn("bucket", (of_shard(first) + F.pmod(F.col("turn"), of_shard(buckets))).cast("int"))
                 .select("shard", "bucket", "turn", "record")
                 .repartitionById(sum(buckets), F.col("bucket")).sortWithinPartitions("bucket", "turn"))
    shuffled = (scattered.groupBy("bucket").agg(F.first("shard").alias("shard"), F.collect_list("record").alias("records"))
                .select("shard", "bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "record")))
    shuffled.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    schema = shuffled.select("bucket", "place", "record", "shard").schema
    return docs.sparkSession.read.schema(schema).parquet(path)


def slots(shards: DataFrame, *columns: Column) -> DataFrame:
    """(``columns``, shard, slot) of the rows of written shards; slots count from 0 in every shard."""
    sizes = shards.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    narrow = shards.select(F.struct(*columns).alias("own"), "shard", "bucket", "place")
    return narrow.join(starts, ["shard", "bucket"]).select("own.*", "shard", (F.col("start") + F.col("place")).alias("slot"))
