"""Live state of findings kept by the stream itself, with expiry.

The stream's state holds per finding its last update, how many updates it had and how often it entered an open state, in an
aggregation on the RocksDB store; a batch reports the findings it moved.  Every reported row says when the finding expires,
``expiry`` after its last update if it is then still open, and how far it moves the watermark.  :func:`live_table` closes what
the watermark has passed, so a finding is closed without any further update and without work per finding and batch.

Updates of one finding count in the order of (at, event_id), also within a batch and across batches; those that are older than
what is known are counted but change nothing, however late they come.  Rows without a finding or a time are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIVE = ["finding_id", "state", "at", "event_id", "updates", "reopened"]
EXPIRED = "expired"


def live_findings(updates: DataFrame, out: str, checkpoint: str, open_states: tuple[str, ...] = ("open",),
                  expiry: timedelta = timedelta(days=30), watermark: str = "1 day",
                  run: Callable[..., StreamingQuery] = jobs.write_batches) -> StreamingQuery:
    """Run a stream of updates (finding_id, at, event_id, state) over what is there; :func:`live_table` reads the result.

    A restart from ``checkpoint`` goes on where the last run ended, with its state.
    """
    spark = updates.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        opened = F.col("state").isin(*open_states)
        known = (updates.filter("finding_id is not null and at is not null and state is not null").groupBy("finding_id")
                 .agg(F.max(F.struct("at", "event_id", "state")).alias("last"), F.count(F.lit(1)).alias("updates"),
                      F.count_if(opened).alias("opened"))
                 .select("finding_id", "last.*", "updates", F.greatest(F.col("opened") - 1, F.lit(0)).alias("reopened")))
        states = known.select(*LIVE, F.when(opened, F.col("at") + F.lit(expiry)).alias("expires"),
                              (F.col("at") - F.expr(f"INTERVAL '{watermark}'")).alias("watermark"))
        return run(states, out, checkpoint, mode="update")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def live_table(spark: SparkSession, out: str) -> DataFrame:
    """(finding_id, state, at, event_id, updates, reopened): the last row of every finding.

    Open findings that expire before the greatest watermark of all rows are closed.
    """
    rows = jobs.read_batches(spark, out)
    others = [name for name in (*LIVE, "expires") if name != "finding_id"]
    last = rows.groupBy("finding_id").agg(F.max_by(F.struct(*others), "batch").alias("r")).select("finding_id", "r.*")
    closed = F.coalesce(F.col("expires") < F.col("reached"), F.lit(False))
    return (last.crossJoin(F.broadcast(rows.agg(F.max("watermark").alias("reached"))))
            .withColumn("state", F.when(closed, F.lit(EXPIRED)).otherwise(F.col("state"))).select(*LIVE))
