"""Persisted records: artifacts, append-only history, read repair and schema steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_findings(findings: DataFrame, folder: str, scope: str | None = None, run_id: str | None = None) -> None:
    """Review artifact per scope and run; writing a run again replaces just that run.

    With ``scope`` and ``run_id`` exactly that run is written, also if it found nothing: an empty partition then takes the
    place of what an earlier attempt left there.
    """
    if scope is None or run_id is None:
        (findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("scope", "run_id").parquet(folder))
        return
    own = findings.filter((F.col("scope") == scope) & (F.col("run_id") == run_id)).drop("scope", "run_id")
    own.write.mode("overwrite").parquet(f"{folder}/scope={scope}/run_id={run_id}")


def append_history(records: DataFrame, folder: str) -> None:
    records.write.mode("append").parquet(folder)


def read_history(lines: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Parse JSON lines (column ``value``) into (good records, torn count).

    A record is torn when it does not parse or lacks a required field.
    """
    parsed = lines.select("value", F.from_json(
        "value", T.StructType([*schema.fields, T.StructField("_torn", T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    torn = F.col("r").isNull() | F.col("r._torn").isNotNull()
    for name in required:
        torn |= F.col(f"r.{name}").isNull()
    marked = parsed.withColumn("torn", torn)
    good = marked.filter(~F.col("torn")).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    bad = marked.agg(F.coalesce(F.sum(F.col("torn").cast("long")), F.lit(0)).alias("torn"))
    return good, bad


def read_history_folder(spark: SparkSession, folder: str, schema: T.StructType,
                        required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    return read_history(spark.read.text(folder), schema, required)


Step = Callable[[DataFrame], DataFrame]


def upcast(records: DataFrame, steps: dict[int, Step], current: int, minimum: int = 1) -> tuple[DataFrame, DataFrame]:
    """Raise records of older schema versions to ``current``.

    ``steps[v]`` turns version v records into version v + 1.  Records below ``minimum`` or above
    ``current`` form the reject set.
    """
    version = F.col("schema_version")
    usable = version.between(minimum, current)
    raised = None
    for v in range(minimum, current + 1):
        own = records.filter(version == v)
        raised = own if raised is None else raised.unionByName(own, allowMissingColumns=True)
        if v < current:
            raised = steps[v](raised).withColumn("schema_version", F.lit(v + 1))
    return raised, records.filter(~F.coalesce(usable, F.lit(False)))
