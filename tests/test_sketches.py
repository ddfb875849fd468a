"""Sketches against exact counts and ranks, refreshed and replayed."""

import datetime

from pyspark.sql import functions as F

from corpus_audit.operators import corpus_map, sketches

HISTORY = "zone string, author string, changed_at timestamp_ntz"


def history(spark, n=60_000):
    """Three zones, one with a third of all rows and 20,000 authors, over some months."""
    zone = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('z', id % 7) END")
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id % 150)")
    return spark.range(n).select(zone.alias("zone"), F.expr("concat('u', id)").alias("author"), at.alias("changed_at"))


def test_authors_within_two_percent_after_refresh_and_replay(spark):
    rows = history(spark)
    none = spark.createDataFrame([], HISTORY)
    kept = sketches.author_sketches(rows.filter("changed_at < timestamp_ntz'2024-03-10'"))
    new = sketches.refreshed_authors(kept, rows.filter("changed_at >= timestamp_ntz'2024-03-01'"))
    exact = {row["zone"]: row["authors"] for row in corpus_map.author_spread(rows, none).collect()}
    found = {row["zone"]: row["authors"] for row in sketches.author_spread(new).collect()}
    assert exact["hot"] == 20_000 and None in exact and found.keys() == exact.keys()
    assert all(abs(found[zone] - n) <= 0.02 * n for zone, n in exact.items())
    again = sketches.author_spread(sketches.refreshed_authors(new, rows)).collect()
    assert {row["zone"]: row["authors"] for row in again} == found
    part = {row["zone"]: row["authors"] for row in sketches.author_spread(new, "2024-02-01", "2024-04-01").collect()}
    inside = rows.filter("changed_at >= timestamp_ntz'2024-02-01' AND changed_at < timestamp_ntz'2024-04-01'")
    assert all(abs(part[row["zone"]] - row["authors"]) <= 0.02 * row["authors"] for row in corpus_map.author_spread(inside, none).collect())


def test_authors_of_few_rows_are_exact(spark):
    at = datetime.datetime(2024, 1, 5)
    rows = spark.createDataFrame([("a", "x", at), ("a", "x", at), ("a", "y", None), ("b", None, at), (None, "x", at)], HISTORY)
    found = sketches.author_spread(sketches.author_sketches(rows)).collect()
    assert {row["zone"]: row["authors"] for row in found} == {"a": 2, "b": 0, None: 1}
    assert sketches.author_spread(sketches.author_sketches(rows.limit(0))).collect() == []


def test_quantiles_within_one_percent_of_the_rank(spark):
    runs = spark.range(90_000).select(
        F.expr("if(id % 3 = 0, 'hot', concat('z', id % 5))").alias("zone"), F.expr("concat('run-', id % 4)").alias("run_id"),
        F.expr("pmod(xxhash64(id), 100000)").alias("value"))
    kept = sketches.measure_sketches(runs, "value", F.col("run_id"))
    stale = sketches.measure_sketches(runs.withColumn("value", F.lit(5)).filter("run_id = 'run-2'"), "value", "run-2")
    kept = sketches.replaced_runs(kept.filter("run_id <> 'run-2'").unionByName(stale), kept.filter("run_id = 'run-2'"))
    for q in (0.1, 0.5, 0.9):
        bars = sketches.quantiles(kept, q)
        ranks = runs.join(bars, "zone").groupBy("zone").agg(F.avg((F.col("value") <= F.col("bar")).cast("double")).alias("rank"),
                                                            F.count(F.lit(1)).alias("rows"), F.first("n").alias("n")).collect()
        assert len(ranks) == 6 and all(abs(row["rank"] - q) <= 0.01 and row["n"] == row["rows"] for row in ranks)
    share = sketches.from_quantile_on(runs, "value", kept, 0.9).count() / 90_000
    assert abs(share - 0.1) <= 0.01
    above = sketches.outliers(runs, "value", kept, 0.9).groupBy("zone").count().collect()
    assert abs(sum(row["count"] for row in above) / 90_000 - 0.1) <= 0.01


def test_measures_without_values(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", None), (None, 4), ("a", 9), ("a", 9)], "zone string, value int")
    kept = sketches.measure_sketches(rows, "value", "r")
    assert {row["zone"]: (row["n"], row["bar"]) for row in sketches.quantiles(kept, 0.9).collect()} == {"a": (3, 9), None: (1, 4)}
    nothing = sketches.measure_sketches(rows.limit(0), "value", "r")
    assert sketches.quantiles(nothing, 0.5).collect() == []
    assert sketches.from_quantile_on(rows, "value", nothing).collect() == []
