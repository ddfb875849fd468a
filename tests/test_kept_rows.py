"""Rows that have no partner stay, with a reason, and answers do not depend on the size of a table."""

import datetime

from pyspark.sql import functions as F

from corpus_audit.operators import duplicates, findings, packs, rules, similarity, trends
from corpus_audit.sources import scopes, storage

SCORED = "record_id string, branch string, scope string, axiom int, commit_sha string, score double"


def test_file_without_a_zone_still_has_the_threshold(spark):
    files = spark.createDataFrame([("a.ts", "if (a) {}\n" * 30, None), ("b.ts", "x", "z")], "path string, text string, zone string")
    assert [r.path for r in duplicates.complexity_hotspots(files, 12).collect()] == ["a.ts"]


def test_record_of_an_unknown_commit_has_a_reason(spark):
    scored = spark.createDataFrame([("r1", "main", "all", 1, "c1", 90.0), ("r2", "main", "all", 1, "c2", 80.0),
                                    ("r3", "main", "all", 1, "lost", 70.0)], SCORED)
    ranks = spark.createDataFrame([("c1", 0), ("c2", 1)], "sha string, generation long")
    got = {r.record_id: (r.previous, r.delta, r.reason) for r in trends.deltas(scored, ranks).collect()}
    assert got == {"r1": (None, None, None), "r2": (90.0, -10.0, None), "r3": (None, None, "unknown commit")}


def test_usage_without_a_price_is_marked(spark):
    usage = spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], "agent string, run_id int, units int").withColumn("at", F.lit(datetime.date(2024, 1, 5)))
    prices = spark.createDataFrame([("a", 1.5)], "agent string, price double")
    assert {(r.agent, r.cost, r.unpriced) for r in trends.usage_cost(usage, prices).collect()} == {("a", 3.0, False), ("b", None, True)}
    assert {(r.agent, r.cost, r.unpriced) for r in trends.cost_trend(usage, prices, "at").collect()} == {("a", 3.0, False), ("b", None, True)}


def test_period_that_one_series_lacks_stays(spark):
    found = spark.createDataFrame([("p1", 5), ("p2", 3)], "period string, findings int")
    bars = spark.createDataFrame([("p1", 1)], "period string, threshold int")
    confirmed = spark.createDataFrame([("p2", 1), ("p3", 1)], "period string, confirmed int")
    got = sorted((r.period, r.fell, r.credited) for r in trends.gaming_guard(found, bars, confirmed).collect())
    assert got == [("p1", False, False), ("p2", True, False), ("p3", False, False)]


def finding(spark, *rows):
    columns = "path string, axiom int, rule_id string, line_start int, line_end int, severity string, run_id string, finding_id string, source array<string>, owasp string"
    return rules.as_findings(spark.createDataFrame(list(rows), columns))


def test_merge_keeps_runs_apart_and_every_source_and_column(spark):
    rows = finding(spark, ("a", 5, "R1", 1, 4, "info", "run1", "f1", ["ast"], "A01"), ("a", 5, "R2", 2, 4, "error", "run1", "f2", ["regex"], "A02"),
                   ("a", 5, "R1", 1, 4, "info", "run2", "f3", ["regex"], "A01"))
    merged = findings.merge_overlaps(rows)
    assert set(rows.columns) < set(merged.columns)
    got = sorted((r.run_id, r.finding_id, r.severity, r.source, r.merged, r.owasp, r.tier) for r in merged.collect())
    assert got == [("run1", "f1", "error", ["ast", "regex"], 2, "A01", "deterministic"), ("run2", "f3", "info", ["regex"], 1, "A01", "deterministic")]


def test_findings_are_not_reused_where_other_path_rules_hold(spark):
    pack = packs.pack("RUL-07")
    scan = lambda files: rules.rule_hits(files, pack).select("path", "rule_id", "line_start")
    schema = "path string, text string"
    base = spark.createDataFrame([("a.tsx", "console.log('x')")], schema)
    cache = findings.cache_entries(base, scan(base), "v1", pack)
    head = spark.createDataFrame([("b.ts", "console.log('x')"), ("c.tsx", "console.log('x')")], schema)
    got = {(r.path, r.rule_id, r.reused) for r in findings.reuse_findings(head, cache, "v1", scan, pack).collect()}
    assert got == {("b.ts", "RUL-07-server", False), ("c.tsx", "RUL-07-ui", True)}


def test_clean_rerun_leaves_no_old_findings(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("s", "r", "f1"), ("s", "q", "f2")], "scope string, run_id string, finding_id string")
    storage.write_findings(rows, folder)
    storage.write_findings(rows.limit(0), folder, "s", "r")
    assert [r.finding_id for r in spark.read.schema(rows.schema).parquet(folder).collect()] == ["f2"]


def test_scan_survives_files_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\xff\xfe")
    (tmp_path / "c.txt").write_text("long " * 100)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.reason) for r in scopes.scan_corpus(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"a.txt": ("héllo", None), "b.png": (None, "no UTF-8 text"), "c.txt": (None, "too large")}


def vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = F.transform("embedding", lambda x, j: F.when(j < 3, x / 3).otherwise(x))
    return table, table.filter("vec_id % 5 = 0").select((F.col("vec_id") + 10000).alias("vec_id"), near.alias("embedding"))


def test_links_do_not_depend_on_the_other_vectors(spark):
    table, near = vectors(spark)
    few = table.filter("vec_id % 5 = 0").unionByName(near)
    small = {tuple(r) for r in similarity.semantic_duplicates(few, 0.8).collect()}
    large = {tuple(r) for r in similarity.semantic_duplicates(table.unionByName(near), 0.8).collect()}
    assert small and small <= large


def test_recall_against_all_pairs(spark):
    import numpy as np
    table, near = vectors(spark)
    rows = table.unionByName(near)
    got = {(r.vec_id, r.leader) for r in similarity.semantic_duplicates(rows, 0.8).collect()}
    data = rows.toPandas()
    unit = np.stack([v / np.linalg.norm(v) for v in map(np.asarray, data["embedding"])])
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.8, 1))
    ids = data["vec_id"].to_numpy()
    pairs = {(max(ids[a], ids[b]), min(ids[a], ids[b])) for a, b in zip(i, j)}
    assert len(got & pairs) >= 0.99 * len(pairs) > 0


def test_a_vector_without_length_links_to_its_copies_only(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] + [0.0] * 63)]
    got = similarity.semantic_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.8).collect()
    assert [(r.vec_id, r.leader) for r in got] == [(2, 1)]


def test_bands_follow_from_threshold_bits_and_recall():
    assert similarity.bands_for(0.8, 8, 0.995) == 31
    assert similarity.bands_for(0.9, 8, 0.995) < 31 < similarity.bands_for(0.8, 12, 0.995)
    masks = similarity.band_masks(31, 8)
    assert len(set(masks)) == 31 and all(mask.bit_count() == 8 for mask in masks)


def test_late_rows_are_counted_by_a_listener(spark, tmp_path):
    from corpus_audit.streaming import jobs
    rows = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("a", datetime.datetime(2024, 1, 1))], "record_id string, at timestamp")
    rows.write.parquet(str(tmp_path / "in/x.parquet"))
    stream = jobs.stream_table(spark, str(tmp_path / "in/x.parquet"), "*.parquet")
    query, late = jobs.stream_ingest(stream, "at", "1 day", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert late == 0 and jobs.read_batches(spark, str(tmp_path / "out")).count() == 1


def test_every_pair_with_a_leader_is_found(spark, monkeypatch):
    """Vectors at all distances around the threshold, in many blocks; a group of near copies; a chain and copies."""
    import numpy as np
    monkeypatch.setattr(similarity, "BLOCK", 64)
    monkeypatch.setattr(similarity, "SLICE", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16))
    near = base + rng.normal(size=base.shape) * rng.uniform(0.2, 0.9, size=(120, 1))
    group = base[:1] + 0.05 * rng.normal(size=(150, 16))
    turned = np.zeros((4, 16))
    turned[:, 14], turned[:, 15] = np.cos(np.arange(4) * 0.6) * 100, np.sin(np.arange(4) * 0.6) * 100
    data = np.concatenate([base, near, group, turned, group[-3:], near[:5]])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hit = np.tril(np.round(unit @ unit.T, 6) >= 0.8, -1)
    leads = np.zeros(len(data), bool)
    for n in range(len(data)):
        leads[n] = not (hit[n] & leads).any()
    rows = [(n, v.tolist()) for n, v in enumerate(data)]
    got = similarity.semantic_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 0.8).collect()
    first = ~hit.any(axis=1)
    whole = {(int(x), int(y)) for x, y in zip(*np.nonzero(hit)) if first[y]}
    assert whole <= {(r.vec_id, r.leader) for r in got}
    assert all(leads[r.leader] and hit[r.vec_id, r.leader] for r in got)
    assert {r.vec_id for r in got} == {n for n in range(len(data)) if not leads[n]} and len(got) == len({(r.vec_id, r.leader) for r in got})
