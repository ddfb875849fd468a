"""Distinct counts and quantiles that merge: sketches kept per period, so a refresh reads new rows alone.

Author sketches (HyperLogLog) are kept per entity and period.  Taking rows in twice changes nothing, so a replayed batch
does no harm.  With ``LG_K`` the standard error is about 0.6 %; a period holds at most 32 KB per entity, and few bytes while
it has few authors.  Accounts cannot be taken out again: leave those to be ignored out of the history, or use the exact
``corpus_map.author_spread``.

Measure sketches (KLL) are kept per group and run.  They do count rows that come twice, so a run that is measured again
replaces its own sketches.  With ``RANK_K`` the rank of a quantile is off by about 0.5 %; a sketch holds a few thousand
numbers, however many files it speaks for.

Both are built below the shuffle, so a group that holds a third of all rows arrives as one sketch per task.

Defined cases: null keys and periods are groups of their own; null authors and values are not counted, and a group without
any value has no measure sketch; an empty table gives an empty result, and nothing lies above the quantile of no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 15
RANK_K = 600


def author_sketches(history: DataFrame, by: str = "zone", period: str = "month") -> DataFrame:
    """(by, period, authors): one sketch of the authors of each entity and period of ``history(by, author, changed_at)``."""
    return history.groupBy(by, F.date_trunc(period, "changed_at").alias("period")).agg(F.hll_sketch_agg("author", LG_K).alias("authors"))


def refreshed_authors(kept: DataFrame, history: DataFrame, period: str = "month") -> DataFrame:
    """``kept`` with the changes of ``history``, which holds the new ones; rows seen before may be among them."""
    by, *_ = kept.columns
    both = kept.unionByName(author_sketches(history, by, period))
    return both.groupBy(by, "period").agg(F.hll_union_agg("authors").alias("authors"))


def author_spread(sketches: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """(by, authors) over the periods that start in [since, until); without bounds over all."""
    by, *_ = sketches.columns
    for bound, inside in ((since, lambda at: F.col("period") >= at), (until, lambda at: F.col("period") < at)):
        if bound is not None:
            sketches = sketches.filter(inside(F.lit(bound).cast(sketches.schema["period"].dataType)))
    return sketches.groupBy(by).agg(F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("authors"))


def measure_sketches(measures: DataFrame, value: str, run_id, by: str = "zone") -> DataFrame:
    """(by, run_id, measure): one sketch of the integer ``value`` for each group, as measured by a run."""
    run = run_id if not isinstance(run_id, str) else F.lit(run_id)
    known = measures.filter(F.col(value).isNotNull()).select(by, run.alias("run_id"), F.col(value).cast("bigint").alias("value"))
    return known.groupBy(by, "run_id").agg(F.kll_sketch_agg_bigint("value", RANK_K).alias("measure"))


def replaced_runs(kept: DataFrame, new: DataFrame) -> DataFrame:
    """``kept`` with the runs of ``new`` in place of what it held of them."""
    runs = new.select(F.col("run_id").alias("new_run")).distinct()
    return kept.join(runs, F.col("run_id").eqNullSafe(F.col("new_run")), "left_anti").unionByName(new)


def quantiles(sketches: DataFrame, q: float, out: str = "bar") -> DataFrame:
    """(by, n, out): the quantile of each group over all runs that are given, and how many values it speaks for."""
    by, *_ = sketches.columns
    merged = sketches.groupBy(by).agg(F.kll_merge_agg_bigint("measure").alias("m"))
    return merged.select(by, F.kll_sketch_get_n_bigint("m").alias("n"), F.kll_sketch_get_quantile_bigint("m", F.lit(q)).alias(out))


def outliers(measures: DataFrame, value: str, sketches: DataFrame, q: float = 0.9, out: str = "bar") -> DataFrame:
    """Rows above the quantile of their group, with that quantile."""
    by, *_ = sketches.columns
    return measures.join(quantiles(sketches, q, out).drop("n"), by).filter(F.col(value) > F.col(out))


def from_quantile_on(measures: DataFrame, value: str, sketches: DataFrame, q: float = 0.9) -> DataFrame:
    """Rows at or above the quantile over all groups and runs; it reaches the rows as a subquery, not by way of the driver."""
    whole = sketches.groupBy(F.lit(0).alias("all")).agg(F.kll_merge_agg_bigint("measure").alias("m"))
    bar = whole.select(F.kll_sketch_get_quantile_bigint("m", F.lit(q))).scalar()
    return measures.filter(F.col(value) >= bar)
