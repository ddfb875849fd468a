"""Stored records, scopes, detectors, life cycle and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_audit.operators import conventions, corpus_map, detectors, packs, rules, specs, trends
from corpus_audit.sources import scopes, storage
from corpus_audit.streaming import jobs


def test_scopes_differ(spark):
    schema = "path string, text string"
    main = spark.createDataFrame([("a", "1"), ("gone", "x")], schema)
    head = spark.createDataFrame([("a", "2"), ("b", "new")], schema)
    work = spark.createDataFrame([("a", "2"), ("b", "edited"), ("c", "untracked")], schema)
    assert {(r.path, r.status) for r in scopes.changed_files(main, head).collect()} == {("a", "M"), ("b", "A"), ("gone", "D")}
    assert {(r.path, r.status) for r in scopes.uncommitted(head, work).select("path", "status").collect()} == {("b", "M"), ("c", "A")}


def test_own_folder_is_always_excluded(spark):
    files = spark.createDataFrame([(".corpus-audit/x",), ("src/a.generated.ts",), ("src/a.ts",)], "path string")
    assert [r.path for r in scopes.exclude(files, ()).filter("path like 'src%'").collect()] == ["src/a.generated.ts", "src/a.ts"]
    assert [r.path for r in scopes.exclude(files).collect()] == ["src/a.ts"]


def test_raw_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.ts").write_text("één\n")
    (tmp_path / "b.md").write_text("b")
    got = scopes.scan_corpus(spark, str(tmp_path), "*.ts").collect()
    assert [r.text for r in got] == ["één\n"]


def test_kloc_floor_and_multiset(spark):
    base = spark.createDataFrame([("a", "x\nx\ny")], "path string, text string")
    head = spark.createDataFrame([("a", "x\ny\nz")], "path string, text string")
    row = scopes.changed_kloc(base, head).first()
    assert (row.changed, row.kloc) == (2, 0.1)
    assert scopes.changed_kloc(base, base).first().changed == 0


def test_torn_lines(spark):
    schema = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("n", T.LongType())])
    lines = spark.createDataFrame([('{"record_id":"a","n":1}',), ('{"record_id":"b","n',), ('{"n":3}',), ("",)], "value string")
    good, torn = storage.read_history(lines, schema, ("record_id",))
    assert [r.record_id for r in good.collect()] == ["a"]
    assert torn.first().torn == 3


def test_rerun_replaces_its_partition_only(spark, tmp_path):
    def run(run_id, n):
        return spark.range(n).select(F.col("id").alias("x"), F.lit("all").alias("scope"), F.lit(run_id).alias("run_id"))
    folder = str(tmp_path / "artifact")
    storage.write_findings(run("r1", 3), folder)
    storage.write_findings(run("r2", 5), folder)
    storage.write_findings(run("r1", 4), folder)
    assert {r.run_id: r["count"] for r in spark.read.parquet(folder).groupBy("run_id").count().collect()} == {"r1": 4, "r2": 5}


def test_upcast_rejects(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 9), ("e", None)], "record_id string, schema_version int")
    steps = {2: lambda df: df.withColumn("kloc", F.lit(0.1))}
    good, bad = storage.upcast(rows.withColumn("kloc", F.lit(None).cast("double")), steps, current=3, minimum=2)
    assert {(r.record_id, r.schema_version) for r in good.collect()} == {("b", 3), ("c", 3)}
    assert {r.record_id for r in bad.collect()} == {"a", "d", "e"}


def test_replayed_history_is_a_no_op(spark):
    one = spark.createDataFrame([("r1", 1), ("r2", 2)], "record_id string, error int")
    assert sorted(map(tuple, trends.dedupe_history(one.union(one)).collect())) == [("r1", 1), ("r2", 2)]


def test_score_floor(spark):
    row = spark.createDataFrame([(20, 0, 0, 0.0), (0, 0, 0, 1.0)], "error int, warning int, info int, kloc double")
    assert [r.score for r in trends.score(row).collect()] == [0.0, 100.0]


def test_registry(spark):
    files = spark.createDataFrame([("src/a.ts", "eval(x)")], "path string, text string")
    registry = detectors.Registry()
    registry.register(lambda change, context: rules.scan_rules(change, packs.pack("RUL-05")), "eval")
    with pytest.raises(ValueError):
        registry.register(lambda change, context: change, "eval")
    assert [r.detector for r in registry.run(files).collect()] == ["eval"]
    with pytest.warns(UserWarning):
        registry.register(lambda change, context: change, "broken", replaces="eval")
    with pytest.raises(TypeError):
        registry.run(files)


def test_pack_round_trip(spark):
    table = packs.rule_table(spark, packs.pack())
    assert sorted(packs.load_pack(table)) == sorted(packs.pack())


def test_transitions(spark):
    before = spark.createDataFrame([("a", "confirmed"), ("b", "proposed"), ("c", "rejected")], "convention_id string, status string")
    after = spark.createDataFrame([("a", "waning", "auto"), ("b", "confirmed", "auto"), ("c", "proposed", "human")],
                                  "convention_id string, status string, actor string")
    assert {r.convention_id for r in conventions.illegal_transitions(before, after).collect()} == {"b", "c"}


def test_curating_twice_changes_nothing_more(spark):
    ledger = spark.createDataFrame([("a", "proposed", 0), ("b", "proposed", 1), ("c", "confirmed", 0)], "convention_id string, status string, rejections int")
    decisions = spark.createDataFrame([("a", "reject", 1, "u"), ("a", "accept", 2, "u"), ("b", "reject", 1, "u"), ("c", "reject", 1, "u")],
                                      "convention_id string, decision string, at int, by string")
    once = conventions.curate(ledger, ledger.limit(0), decisions)
    twice = conventions.curate(once, ledger.limit(0), decisions)
    want = {"a": ("confirmed", 0), "b": ("rejected", 2), "c": ("confirmed", 0)}
    for state in (once, twice):
        assert {r.convention_id: (r.status, r.rejections) for r in state.collect()} == want


def test_long_supersession_chain(spark):
    rows = [(f"c{n:02d}", "confirmed", f"c{n - 1:02d}" if n else None) for n in range(17)]
    ledger = spark.createDataFrame(rows, "convention_id string, status string, replaces string")
    got = {r.convention_id: r.newest for r in conventions.supersede(ledger).collect()}
    assert set(got.values()) == {"c16"}


def test_tiers_are_never_absent(spark):
    none = spark.createDataFrame([], "passed boolean")
    empty = spark.createDataFrame([], "x int")
    assert specs.spec_tier(none, empty, empty).first().tier == 4
    assert conventions.conformance_tier(empty, empty).first().tier == "T3 skipped: no map"


def test_criteria(spark):
    acs = spark.createDataFrame([(1, 1, "answers within 200 ms"), (1, 2, "is fast"), (1, 3, "exists"), (1, 4, "")], "spec_id int, ac_id int, text string")
    assert [r.reason for r in specs.validate_acs(acs).orderBy("ac_id").collect()] == ["quantified", "vague: fast", "no measurable bound", "empty"]


def test_freshness_ceiling_is_strict(spark):
    marks = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-01")], "zone string, seen_at string")
    commits = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-01-05")], "zone string, at string")
    got = {r.zone: r.state for r in corpus_map.freshness(marks, commits, "2024-01-16").collect()}
    assert got == {"a": "inconclusive: stale_corpus", "b": "stale", "c": "fresh"}


def test_stream_ingest_counts_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    def arrive(rows):
        (spark.createDataFrame(rows, "record_id string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder))
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    def run():
        return jobs.stream_ingest(jobs.stream_table(spark, folder, "*.parquet"), "at", "1 hour", out, progress)[1]
    arrive([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:01:00"), ("b", "2024-01-01 12:00:00")])
    first = run()
    arrive([("late", "2024-01-01 08:00:00"), ("b", "2024-01-01 12:01:00"), ("c", "2024-01-01 12:30:00")])
    second = run()
    assert sorted(r.record_id for r in jobs.read_batches(spark, out).collect()) == ["a", "b", "c"]
    assert (first, second) == (0, 1)


def test_entry_at_half_its_incidence_does_not_fade(spark, tmp_path):
    from corpus_audit.plans import governance
    from corpus_audit.plans.catalog import Tables
    spark.sql("select 7L as p_partkey, 't' as p_type, 'b' as p_brand, 'n' as p_name, 16 as p_size").write.parquet(str(tmp_path / "part.parquet"))
    # 16 of 60 at confirmation, 4 of 30 now.
    spark.range(30).selectExpr("7L as l_partkey", "if(id < 4, 'A', 'N') as l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [row["status"] for row in governance.decay(Tables(spark, str(tmp_path))).collect()] == ["confirmed"]
