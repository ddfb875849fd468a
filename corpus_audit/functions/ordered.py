"""Ordered computations that survive a key holding a third of all rows.

A plain window puts a whole key into one task.  Here the caller names a ``bucket``: an expression
that grows with the order, so a key splits into many (key, bucket) pieces.  Each piece is windowed on
its own, and what crosses a piece border travels through a summary with one row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pieces(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_bucket")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.col("l._bucket") == F.col("r._bucket")
    for key in keys:
        condition &= F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return condition


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
                  columns: list[str]) -> DataFrame:
    """Add ``prev_<column>``: the value on the row before, in ``order`` within ``keys``."""
    bucketed = df.withColumn("_bucket", bucket)
    last = (bucketed.groupBy(*keys, "_bucket")
            .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
            .withColumn("_carry", F.lag("_last").over(_pieces(keys)))
            .select(*keys, "_bucket", "_carry"))
    window = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    inner = bucketed.withColumn("_inner", F.lag(F.struct(*columns)).over(window))
    joined = inner.alias("l").join(last.alias("r"), _same(inner, last, keys), "left")
    previous = F.coalesce(F.col("l._inner"), F.col("r._carry"))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns],
                         *[previous[c].alias(f"prev_{c}") for c in columns])


def with_rank(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """Add the 1-based position of each row in ``order`` within ``keys``."""
    bucketed = df.withColumn("_bucket", bucket)
    sizes = (bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_before", F.sum("_n").over(
                 _pieces(keys).rowsBetween(Window.unboundedPreceding, -1)))
             .select(*keys, "_bucket", "_before"))
    window = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    inner = bucketed.withColumn("_inner", F.row_number().over(window))
    joined = inner.alias("l").join(sizes.alias("r"), _same(inner, sizes, keys), "left")
    rank = F.col("l._inner") + F.coalesce(F.col("r._before"), F.lit(0))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], rank.cast("bigint").alias(out))


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column,
                     out: str) -> DataFrame:
    """Add the running sum of ``value`` in ``order`` within ``keys``."""
    bucketed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = (bucketed.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_n"))
            .withColumn("_before", F.sum("_n").over(
                _pieces(keys).rowsBetween(Window.unboundedPreceding, -1)))
            .select(*keys, "_bucket", "_before"))
    window = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = bucketed.withColumn("_inner", F.sum("_value").over(window))
    joined = inner.alias("l").join(sums.alias("r"), _same(inner, sums, keys), "left")
    total = F.col("l._inner") + F.coalesce(F.col("r._before"), F.lit(0))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], total.alias(out))


def over_last_rows(df: DataFrame, keys: list[str], rank: str, k: int, aggregates: dict[str, Column],
                   block: int = 65536) -> DataFrame:
    """Aggregates over each row and the ``k`` rows before it, for rows ranked within ``keys``.

    Blocks of consecutive ranks are windowed apart; the last ``k`` rows of a block are copied into the
    next one as context and dropped again after the window.
    """
    block = max(block, 2 * k + 1)
    home = F.floor((F.col(rank) - 1) / block)
    is_tail = (F.col(rank) - 1) % block >= block - k
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(is_tail, F.array(home, home + 1)).otherwise(F.array(home))))
    window = Window.partitionBy(*keys, "_block").orderBy(rank).rowsBetween(-k, 0)
    for name, column in aggregates.items():
        spread = spread.withColumn(name, column.over(window))
    return spread.filter(F.col("_block") == F.col("_home")).drop("_home", "_block")
