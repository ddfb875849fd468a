"""Every operator on the awkward rows and on empty tables."""

import corpus_pipeline
from cases import LONG, PROSE, documents, empty

from corpus_audit.llm import decontaminate, language, lines, mixing, passages, quality, sharding, simhash, tokens, toxicity
from corpus_audit.llm.queries import vocabulary

BENCHMARK = [(1, PROSE), (2, None), (3, ""), (4, "two words")]


def benchmark(spark, rows=BENCHMARK):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows=((1, 1), (2, 0), (3, None), (None, 1), (8, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


def test_quality(spark):
    rows = quality.judged(documents(spark)).collect()
    assert len(rows) == 12
    by = {row["doc_id"]: row for row in rows}
    assert by[1]["kept"] and by[1]["n_words"] == len(PROSE.split())
    assert by[5]["n_words"] == len(LONG.split()) == by[5]["n_repeat_words"] and not by[5]["kept"]
    assert by[4]["n_words"] == 0 and by[4]["base_failed"] and not by[4]["host_failed"]
    assert quality.judged(empty(spark)).collect() == []


def test_simhash(spark):
    rows = simhash.grouped(documents(spark)).collect()
    assert len(rows) == 12
    groups = {row["doc_id"]: (row["fingerprint"], row["component_id"]) for row in rows}
    assert groups[1] == groups[2] and groups[1][1] == 1
    assert groups[3] == groups[4] == groups[6] == ("0" * 16, 3)
    assert simhash.grouped(empty(spark)).collect() == []
    kept = simhash.kept(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = [row["doc_id"] for row in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids
    assert simhash.kept(empty(spark)).collect() == []


def test_decontaminate(spark):
    found = {(row["doc_id"], row["item_id"]) for row in decontaminate.leaks(documents(spark), benchmark(spark)).collect()}
    assert found == {(1, 1), (2, 1), (8, 1)}
    assert decontaminate.leaks(empty(spark), benchmark(spark)).collect() == []
    assert decontaminate.leaks(documents(spark), benchmark(spark, [])).collect() == []


def test_language(spark):
    rows = language.identified(documents(spark)).collect()
    assert len(rows) == 12
    assert {row["lang_pred"] for row in rows if row["doc_id"] in (3, 4, 6)} == {"und"}
    assert all(0 <= row["score"] <= 1 for row in rows)
    assert language.identified(empty(spark)).collect() == []


def test_signs_beyond_the_basic_plane_are_no_letters(spark):
    rows = [(1, PROSE, "en", "a"), (2, "😀😀 🎉", "en", "a"), (3, "𝒜𝒷", "en", "a"), (4, "\uffff 123", "en", "a"), (6, PROSE, "en", "b")]
    found = {row["doc_id"]: (row["lang_pred"], row["score"]) for row in language.identified(documents(spark, rows)).collect()}
    assert found[2] == found[4] == ("und", 0.0) and found[3][0] == "en"


def test_mixing(spark):
    found = mixing.mixed(documents(spark))
    rows = found.collect()
    assert all(row["copy"] <= row["copies"] for row in rows)
    assert [row["shuffle_key"] for row in rows] == sorted(row["shuffle_key"] for row in rows)
    assert mixing.mixed(empty(spark)).collect() == []


def test_toxicity(spark):
    rows = toxicity.scored(documents(spark), labels(spark)).collect()
    assert len(rows) == 12 and all(0 <= row["score"] <= 1 for row in rows)
    assert toxicity.scored(empty(spark), labels(spark)).collect() == []
    assert {row["score"] for row in toxicity.scored(documents(spark), labels(spark, [])).collect()} == {0.0}


def test_lines(spark):
    rows = lines.decided(documents(spark)).collect()
    kept = [(row["doc_id"], row["line_no"]) for row in rows if row["kept"]]
    assert (1, 0) in kept and (2, 0) not in kept
    assert not any(row["doc_id"] in (3, 4, 6) for row in rows)
    assert lines.decided(empty(spark)).collect() == []
    unique = documents(spark, [(1, PROSE + "\n\nother words", "en", "a"), (2, "x y\n" + PROSE, "en", "a"), (3, None, "en", "a")])
    cleaned = {row["doc_id"]: row["text"] for row in lines.cleaned(unique, lines.decided(unique)).collect()}
    assert cleaned == {1: PROSE + "\n\nother words", 2: "x y", 3: None}


def test_passages(spark):
    rows = passages.repeated(documents(spark)).collect()
    assert {(row["doc_id"], row["match_doc_id"], row["kind"]) for row in rows if row["kind"] == "copy"} == {(2, 1, "copy")}
    assert {frozenset((row["doc_id"], row["match_doc_id"])) for row in rows if row["kind"] == "passage"} == {frozenset((1, 8))}
    assert passages.repeated(empty(spark)).collect() == []


def test_tokens(spark, tmp_path):
    rows = tokens.read_tokens(tokens.write_tokens(documents(spark), str(tmp_path / "a"), vocabulary())).collect()
    assert len(rows) == 12
    by_start = sorted(rows, key=lambda row: row["start"])
    assert [row["doc_id"] for row in by_start][:2] == [None, None]
    assert by_start[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by_start, by_start[1:]))
    assert {row["n_tokens"] for row in rows if row["doc_id"] in (3, 4)} == {1}
    assert tokens.read_tokens(tokens.write_tokens(empty(spark), str(tmp_path / "b"), vocabulary())).collect() == []


def test_sharding(spark, tmp_path):
    from pyspark.sql import functions as F
    found = sharding.slots(sharding.write_shards(documents(spark), str(tmp_path / "a"), 3, bucket_bytes=200), F.col("record.doc_id"))
    rows = found.collect()
    assert len(rows) == 12
    for shard in {row["shard"] for row in rows}:
        slots = sorted(row["slot"] for row in rows if row["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.write_shards(empty(spark), str(tmp_path / "b"), 3).collect() == []


def test_pipeline_stages(spark, tmp_path):
    (tmp_path / "data").mkdir()
    benchmark(spark).write.parquet(str(tmp_path / "data/benchmark.parquet"))
    for start in (documents(spark), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path / "data"))
            assert after.columns == start.columns, name
            docs = after
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / "data")).collect()
