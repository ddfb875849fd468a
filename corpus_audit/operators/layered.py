"""Layered configuration of many projects as long tables (project, layer, path, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import with_rank


def resolve(config: DataFrame) -> DataFrame:
    """(project, path, value, layer): the highest layer that sets a path wins."""
    best = config.groupBy("project", "path").agg(F.max(F.struct("layer", "value")).alias("b"))
    return best.select("project", "path", "b.value", "b.layer")


def merge_keyed_arrays(base: DataFrame, override: DataFrame) -> DataFrame:
    """Merge arrays of tables given as item rows (project, path, idx, code, id, item).

    When every item of both sides has a ``code`` (else: an ``id``), an override item replaces the whole
    base item of the same key in place and new keys are appended; otherwise all items are appended.
    Equal keys within the override collapse to their first place and last content; of equal keys within
    the base only the last is replaceable.  ``idx`` of the result counts from 0.
    """
    where = ["project", "path"]
    both = base.withColumn("_side", F.lit(0)).unionByName(override.withColumn("_side", F.lit(1)))
    mode = both.groupBy(*where).agg(
        F.when(F.bool_and(F.col("code").isNotNull()), "code").when(F.bool_and(F.col("id").isNotNull()), "id").otherwise("append").alias("_mode"))
    keyed = both.join(mode, where).withColumn("_key", F.when(F.col("_mode") == "code", F.col("code")).when(F.col("_mode") == "id", F.col("id")))
    plain = keyed.filter("_mode = 'append'").select(*where, "_side", F.col("idx").alias("_at"), "code", "id", "item")
    own = keyed.filter("_mode <> 'append'")
    by_key = [*where, "_key"]
    content = F.struct("code", "id", "item")
    new = (own.filter("_side = 1").groupBy(*by_key).agg(F.min("idx").alias("_first"), F.max_by(content, "idx").alias("_new")))
    old = own.filter("_side = 0")
    last = old.groupBy(*by_key).agg(F.max("idx").alias("_last"))
    changes = last.join(new, by_key).select(*by_key, F.col("_last").alias("idx"), "_new")
    kept = (old.join(changes, [*by_key, "idx"], "left").withColumn("_c", F.coalesce("_new", content))
            .select(*where, F.lit(0).alias("_side"), F.col("idx").alias("_at"), "_c.code", "_c.id", "_c.item"))
    added = (new.join(last, by_key, "left_anti")
             .select(*where, F.lit(1).alias("_side"), F.col("_first").alias("_at"), "_new.code", "_new.id", "_new.item"))
    merged = plain.unionByName(kept).unionByName(added)
    ranked = with_rank(merged, where, ["_side", "_at"], F.struct("_side", F.floor(F.col("_at") / 4096)), "_rank")
    return ranked.select(*where, (F.col("_rank") - 1).alias("idx"), "code", "id", "item")


def extract(config: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the asked dotted keys and everything below them; absent keys give no row."""
    wanted = F.lit(False)
    for key in keys:
        wanted |= (F.col("path") == key) | F.col("path").startswith(key + ".")
    return config.filter(wanted)


def deviations_from_default(config: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(project, path, value, default_value, kind) where a project differs from the defaults.

    The defaults are the tool's own fixed keys; each project gets them from a literal array.
    """
    pairs = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(value).alias("default_value")) for path, value in defaults.items()])
    expected = (config.select("project").distinct().select("project", F.explode(pairs).alias("d"))
                .select("project", "d.path", "d.default_value", F.lit(True).alias("_d")))
    joined = config.select("project", "path", "value").withColumn("_c", F.lit(True)).join(expected, ["project", "path"], "full_outer")
    kind = (F.when(F.col("_d").isNull(), "unknown key").when(F.col("_c").isNull(), "unset")
            .when(~F.col("value").eqNullSafe(F.col("default_value")), "changed"))
    return joined.withColumn("kind", kind).filter("kind is not null").select("project", "path", "value", "default_value", "kind")


def config_errors(config: DataFrame, constraints: DataFrame) -> DataFrame:
    """(project, path, value, error) for values outside ``constraints(path, allowed, low, high)``."""
    joined = config.join(constraints, "path")
    number = F.expr("try_cast(value as double)")
    error = (F.when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value")), "not one of the allowed values")
             .when(F.col("low").isNotNull() & number.isNull(), "not a number")
             .when((number < F.col("low")) | (number > F.col("high")), "out of range"))
    return joined.withColumn("error", error).filter("error is not null").select("project", "path", "value", "error")
