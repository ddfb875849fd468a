"""A pack scanned as a table finds what the same pack finds as code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpus_audit.operators import pack_index, packs, rules
from corpus_audit.plans import inputs
from corpus_audit.plans.catalog import Tables


def rows_of(hits):
    return sorted(map(tuple, hits.select(*pack_index.HIT).collect()), key=str)


@pytest.mark.parametrize("most", [500_000, 0])
def test_built_in_rules(spark, monkeypatch, most):
    monkeypatch.setattr(pack_index, "BROADCAST_GRAMS", most)
    tables = Tables(spark, "/root/testdata/sf0.001")
    files = inputs.code_files(tables).select("path", "text").unionByName(inputs.prose_files(tables).select("path", "text"))
    assert rows_of(pack_index.pack_hits(files, packs.rule_table(spark, packs.pack()))) == rows_of(rules.rule_hits(files, packs.pack()))


PATTERNS = {
    r"(?i)Secret[0-9]+": "secret", r"foo\.bar\(x": "foo", r"a?bc+de*f": "bc", r"(one|two)three": "three", r"one|two": None, r"[a-z]+": None,
    r"x{2}yz{1,3}w": "y", r"\d+\s": None, r"((a(b)))tail": "tail", r"((((d))))tail": None, r"ab?": None, "^start$": "start", "": None,
    "héllo wörld": "héllo wörld", r"[(]open": "open", r"f(?:x|y)*gh": "gh",
}


def test_required_literals(spark):
    found = spark.createDataFrame([(pattern,) for pattern in PATTERNS], "p string").select("p", pack_index.required_literal(F.col("p")).alias("l")).collect()
    expected = {pattern: literal if literal and len(literal) > 1 else None for pattern, literal in PATTERNS.items()}
    assert {row["p"]: row["l"] for row in found} == expected


def test_random_packs(spark):
    rng = random.Random(5)
    words = ["log", "the key", "tok", "io", "é", "naïve", "((", "x", "aaa", "Über"]
    texts = ["\n".join(" ".join(rng.choices(words + ["zzz", "// note", "aaaa"], k=rng.randint(0, 6))) for _ in range(5)) for _ in range(40)]
    files = spark.createDataFrame([(f"d/{n}.{rng.choice(['ts', 'py'])}", text, rng.choice(["en", "de"])) for n, text in enumerate(texts)], "path string, text string, lang string")
    pack = []
    for n in range(90):
        literals = rng.sample(words, rng.randint(1, 3))
        regex = "|".join(map(re.escape, literals)) if rng.random() < 0.5 else re.escape(literals[0]) + rng.choice(["", " +[a-z]+", ".*"])
        needs = tuple(word.lower() for word in literals) if rng.random() < 0.5 else ()
        pack.append(packs.Rule(f"R{n}", rng.randint(1, 6), rng.choice(["High", "Low"]), None, f"(?iu){regex}", "m",
                               path_regex=rng.choice([None, r"\.ts$"]), lang=rng.choice([None, "en"]), also_regex=rng.choice([None, "a"]),
                               needs=needs, in_comments=rng.random() < 0.5))
    assert rows_of(pack_index.pack_hits(files, packs.rule_table(spark, pack))) == rows_of(rules.rule_hits(files, pack))


def test_awkward_packs(spark):
    files = spark.createDataFrame([("a", "one two\n\nthree"), ("b", None), ("c", "")], "path string, text string")
    schema = "rule_id string, axiom int, severity string, line_regex string, message string"
    assert pack_index.pack_hits(files, spark.createDataFrame([], schema)).collect() == []
    pack = spark.createDataFrame([("A", 1, "Low", "two", "m"), ("B", 1, "Low", None, "m"), ("C", 1, None, "^$", None), ("A", 1, "Low", "two", "m")], schema)
    found = sorted((row["rule_id"], row["path"], row["line_start"]) for row in pack_index.pack_hits(files, pack).collect())
    assert found == [("A", "a", 1), ("A", "a", 1), ("C", "a", 2), ("C", "c", 1)]


def test_large_packs_are_not_compiled(spark):
    table = spark.range(packs.MOST_COMPILED + 1).select(
        F.concat(F.lit("R"), "id").alias("rule_id"), F.lit(1).alias("axiom"), F.lit("Low").alias("severity"), F.lit("x").alias("line_regex"), F.lit("m").alias("message"))
    with pytest.raises(ValueError):
        packs.load_pack(table)
    files = spark.createDataFrame([("a", "x")], "path string, text string")
    assert pack_index.pack_hits(files, table.withColumn("line_regex", F.concat(F.lit("q"), "rule_id"))).count() == 0
