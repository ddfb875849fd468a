"""Structured Streaming jobs.

Sinks write one folder per micro-batch and overwrite it on a retry, so a batch that runs twice leaves
one copy.  ``available_now`` drives a stream over what is there and stops.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import rules
from ..operators.packs import Rule


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names; a temporary one only in local mode."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="corpus-audit-stream-")
    return os.path.join(shared, f"{name}-{uuid.uuid4().hex}")


def stream_table(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder; the schema is that of the files already there.

    What matches ``pattern`` may be a file or a folder of part files.
    """
    # As a glob, so that Spark does not take a single file for the base folder of a table.
    path = f"{folder}/{{{pattern}}}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run the stream over what is available; every micro-batch becomes ``out/batch=<id>``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(sink).start())
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(out)


def latest_rows(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key, for streams that write in update mode."""
    others = [c for c in batches.columns if c not in (*keys, "batch")]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


class _LateRows(StreamingQueryListener):
    """Sums the rows dropped by the watermark over all batches, however many there are."""

    def __init__(self) -> None:
        self.late, self.ended = 0, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.late += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def stream_scan(files: DataFrame, pack: list[Rule], out: str, checkpoint: str) -> StreamingQuery:
    """Scan newly arriving files; the same rule scan as in batch, without state."""
    return write_batches(rules.scan_rules(files, pack), out, checkpoint)


def stream_ingest(records: DataFrame, at: str, watermark: str, out: str, checkpoint: str) -> tuple[StreamingQuery, int]:
    """Keep each record id once within the watermark; returns how many rows came too late."""
    unique = records.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["record_id"])
    counter = _LateRows()
    records.sparkSession.streams.addListener(counter)
    try:
        query = write_batches(unique, out, checkpoint)
        counter.ended.wait(60)
    finally:
        records.sparkSession.streams.removeListener(counter)
    return query, counter.late


def stream_counts(findings: DataFrame, at: str, watermark: str, window: str, slide: str | None, out: str,
                  checkpoint: str) -> StreamingQuery:
    """Findings per axis and tumbling or sliding window, as updates."""
    frame = F.window(F.col(at), window, slide) if slide else F.window(F.col(at), window)
    counts = (findings.withWatermark(at, watermark).groupBy("axiom", frame.alias("w")).agg(F.count(F.lit(1)).alias("findings"))
              .select("axiom", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "findings"))
    return write_batches(counts, out, checkpoint, mode="update")


def stream_sessions(runs: DataFrame, at: str, gap: str, watermark: str, out: str, checkpoint: str) -> StreamingQuery:
    """Bursts of runs of one author; a session is written once the watermark has passed its end."""
    sessions = (runs.withWatermark(at, watermark).groupBy("author", F.session_window(F.col(at), gap).alias("s"))
                .agg(F.count(F.lit(1)).alias("runs"))
                .select("author", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "runs"))
    return write_batches(sessions, out, checkpoint)


def stream_dual(findings: DataFrame, summary_out: str, rows_out: str, checkpoint: str) -> StreamingQuery:
    """One pass, two outputs: all rows, and a summary per axis and severity of the batch."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows_out}/batch={batch_id}")
        # The rows just written are the source of the summary, so the batch is computed once.
        written = batch.sparkSession.read.parquet(f"{rows_out}/batch={batch_id}")
        (written.groupBy("axiom", "severity").agg(F.count(F.lit(1)).alias("findings"))
         .write.mode("overwrite").parquet(f"{summary_out}/batch={batch_id}"))
    query = (findings.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start())
    query.awaitTermination()
    return query


def stream_state(updates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Log of the latest state per finding and batch; :func:`current_state` reads the live table.

    A batch only appends its own changes, so its cost follows the batch and not the table.
    """
    def newest(batch: DataFrame) -> DataFrame:
        return batch.groupBy("finding_id").agg(F.max(F.struct("at", "event_id", "state")).alias("s")).select("finding_id", "s.*")
    return write_batches(updates, out, checkpoint, transform=newest)


def current_state(spark: SparkSession, out: str) -> DataFrame:
    log = read_batches(spark, out)
    return log.groupBy("finding_id").agg(F.max(F.struct("at", "event_id", "state")).alias("s")).select("finding_id", "s.state", "s.at", "s.event_id")
