"""Live findings against a plain replay, with a restart in mid-stream."""

from datetime import datetime, timedelta

from corpus_audit.streaming import jobs, live

START = datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    data = [(finding, START + timedelta(days=day), event, state) for event, (finding, day, state) in rows]
    spark.createDataFrame(data, "finding_id string, at timestamp, event_id long, state string").coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def rows_of(spark, out):
    return {row["finding_id"]: (row["state"], (row["at"] - START).days, row["updates"], row["reopened"]) for row in live.live_table(spark, out).collect()}


def test_states_expire_and_survive_a_restart(spark, tmp_path):
    events = list(enumerate([("a", 0, "open"), ("b", 0, "open"), ("c", 1, "open"), ("a", 2, "fixed"), ("d", 3, "open"), ("b", 10, "open"),
                             ("a", 12, "open"), (None, 12, "open"), ("c", 11, "fixed")]))
    later = list(enumerate([("z", 36, "open"), ("z", 37, "fixed")], 100))
    last = list(enumerate([("e", 60, "open"), ("d", 60, "open")], 200))
    incoming = str(tmp_path / "in")
    out, progress = jobs.work_folder(spark, "live"), jobs.work_folder(spark, "live-progress")
    for name, rows in (("one", events), ("two", later), ("three", last)):
        write(spark, incoming, name, rows)
        stream = jobs.stream_table(spark, f"{incoming}/*.parquet", "*.parquet")
        live.live_findings(stream, out, progress)
        if name == "one":
            assert rows_of(spark, out) == {"a": ("open", 12, 3, 1), "b": ("open", 10, 2, 1), "c": ("fixed", 11, 2, 0), "d": ("open", 3, 1, 0)}
        if name == "two":
            # The watermark is at day 36: what was last open on day 3 has expired, what is fixed has not.
            found = rows_of(spark, out)
            assert found["d"][0] == live.EXPIRED and found["c"][0] == "fixed" and found["a"][0] == "open"
    found = rows_of(spark, out)
    assert found["a"][0] == found["b"][0] == live.EXPIRED
    assert found["d"] == ("open", 60, 2, 1) and found["e"] == ("open", 60, 1, 0) and found["z"][0] == "fixed"


def test_tables_may_be_files_or_folders(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in/parts.parquet"))
    spark.range(5, 8).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "in/single.parquet")
    for pattern, ids in (("parts.parquet", range(5)), ("single.parquet", range(5, 8)), ("*.parquet", range(8))):
        out, progress = jobs.work_folder(spark, "copied"), jobs.work_folder(spark, "copied-progress")
        jobs.write_batches(jobs.stream_table(spark, str(tmp_path / "in"), pattern), out, progress)
        assert sorted(row["id"] for row in jobs.read_batches(spark, out).collect()) == list(ids)


def test_no_python_per_finding_and_late_updates_count(spark, tmp_path):
    incoming, out, progress = str(tmp_path / "in"), jobs.work_folder(spark, "late"), jobs.work_folder(spark, "late-progress")
    plans = []

    def run(states, *args, **kwargs):
        plans.append(states._jdf.queryExecution().analyzed().toString())
        return jobs.write_batches(states, *args, **kwargs)
    for name, rows in (("one", [(1, ("a", 40, "fixed")), (2, ("b", 3, "open"))]), ("two", [(3, ("a", 5, "open"))])):
        write(spark, incoming, name, rows)
        live.live_findings(jobs.stream_table(spark, f"{incoming}/*.parquet", "*.parquet"), out, progress, run=run)
    assert rows_of(spark, out) == {"a": ("fixed", 40, 2, 0), "b": (live.EXPIRED, 3, 1, 0)}
    assert not any(word in plan for plan in plans for word in ("Pandas", "Python"))
