"""The pipeline's near-dedup by the similarity of five-word shingles, and host rates of small and large hosts."""

import random

import pandas as pd
import pytest

from corpus_audit.llm import quality, simhash


def similarity(a, b):
    x, y = ({tuple(words[at:at + 5]) for at in range(len(words) - 4)} for words in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("low,share", [(0.8, 0.85), (0.85, 0.9), (0.9, 0.97)])
def test_near_copies_by_similarity(spark, low, share):
    draw = random.Random(int(low * 100))
    vocabulary = [f"w{n}" for n in range(4000)]
    docs, clean = [], []
    while len(docs) < 400:
        words = draw.choices(vocabulary, k=draw.randrange(80, 500))
        copy = list(words)
        while similarity(words, copy) >= low + 0.03:
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        if similarity(words, copy) >= low:
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(copy))]
    for number in range(1000, 1200, 2):
        words = draw.choices(vocabulary, k=200)
        copy = list(words)
        while similarity(words, copy) >= 0.75:
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        clean += [(number, " ".join(words)), (number + 1, " ".join(copy))]
    rows = simhash.kept(spark.createDataFrame(docs + clean, "doc_id long, text string")).collect()
    left = {row["doc_id"] for row in rows}
    assert {doc for doc, _ in clean} <= left and all(doc in left for doc in range(0, len(docs), 2))
    found = sum(doc not in left for doc in range(1, len(docs), 2)) / (len(docs) / 2)
    print("similarity", low, "found", found)
    assert found >= share


def test_groups_larger_than_a_block_leave_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    draw = random.Random(9)
    base = [f"v{n}" for n in draw.choices(range(3000), k=300)]
    docs = []
    for doc in range(60):
        words = list(base)
        words[draw.randrange(300)] = f"own{doc}"
        docs.append((doc, " ".join(words)))
    rows = simhash.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [row["doc_id"] for row in rows] == [0]


def test_candidates_beside_the_forest_are_verified(spark, monkeypatch):
    """All texts share one fingerprint and hang on one of them, which is like none; the two that are alike still meet."""
    F = simhash.F
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda text, words: F.struct(F.lit(0).cast("long").alias("f0"), F.xxhash64(text).alias("f1")))
    draw = random.Random(4)
    docs = [(doc, " ".join(f"v{n}" for n in draw.choices(range(3000), k=200))) for doc in range(24)]
    docs += [(100 + doc, text.replace(" ", " new ", 1)) for doc, text in docs[:3]]
    for block in (1024, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        rows = simhash.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sorted(row["doc_id"] for row in rows) == list(range(24))


def test_open_candidates_are_no_rows(spark, monkeypatch):
    """Texts that share a fingerprint but are like none are compared inside blocks; only a forest of pairs becomes rows."""
    F, asked, similar = simhash.F, [], simhash._similar

    def counted(pairs, *others):
        asked.append(pairs.count())
        return similar(pairs, *others)

    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda text, words: F.struct(F.lit(0).cast("long").alias("f0"), F.xxhash64(text).alias("f1")))
    monkeypatch.setattr(simhash, "_similar", counted)
    draw = random.Random(5)
    docs = [(doc, " ".join(f"v{n}" for n in draw.choices(range(3000), k=200))) for doc in range(60)]
    docs += [(100 + doc, text.replace(" ", f" new{doc} ", 1)) for doc, text in docs[:20]] + [(200, docs[0][1].replace(" ", " newer ", 1))]
    for block in (256, 7):
        asked.clear()
        monkeypatch.setattr(simhash, "OPEN_BLOCK", block, raising=False)
        rows = simhash.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sorted(row["doc_id"] for row in rows) == list(range(60))
        assert sum(asked) < len(docs)


def hosts(spark, rows):
    """rows: (host, documents, short ones)."""
    long = " ".join(f"word{n}" for n in range(60))
    data = [(f"{host}", "too short" if n < short else long) for host, docs, short in rows for n in range(docs)]
    docs = spark.createDataFrame(pd.DataFrame(data, columns=["source", "text"])).withColumn("doc_id", simhash.F.lit(1))
    return quality.judged(docs, keep=("source",)).select("source", "base_failed", "host_failed", "kept").collect()


def test_hosts_of_one_document_stay_near_the_common_rate(spark):
    draw = random.Random(5)
    rows = [(f"one{n}", 1, int(draw.random() < draw.betavariate(2, 8))) for n in range(270)]
    rows += [(f"many{n}", 40, sum(draw.random() < 0.2 for _ in range(40))) for n in range(30)]
    judged = hosts(spark, rows)
    assert not any(row["host_failed"] for row in judged) and any(row["base_failed"] for row in judged)
    assert all(row["kept"] != row["base_failed"] for row in judged)


def test_a_large_bad_host_takes_its_documents_along(spark):
    rows = [(f"h{n}", 30, n % 4) for n in range(20)] + [("bad", 100, 95), ("lone", 1, 1)]
    judged = hosts(spark, rows)
    assert {row["source"] for row in judged if row["host_failed"]} == {"bad"}
    assert sum(not row["base_failed"] and not row["kept"] for row in judged) == 5


def test_prior_by_moments():
    """Over many draws the share of variance between hosts is that of beta(2, 8), whatever the number of small hosts."""
    draw, sizes, alike = random.Random(3), [1] * 900 + [50] * 100, []
    for _ in range(60):
        failed = []
        for size in sizes:
            rate = draw.betavariate(2, 8)
            failed.append(sum(draw.random() < rate for _ in range(size)))
        mean, weight = quality.prior(len(sizes), sum(sizes), sum(n * n for n in sizes), sum(failed), sum(k * k / n for k, n in zip(failed, sizes)))
        assert mean == pytest.approx(0.2, abs=0.06)
        alike.append(1 / (weight + 1))
    assert sum(alike) / len(alike) == pytest.approx(1 / 11, rel=0.1)
    assert quality.prior(0, None, None, None, None) == (0.0, None) and quality.prior(3, 3, 3.0, 1, 1.0)[1] is None
