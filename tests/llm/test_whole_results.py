"""Results that an operator owes whole, on cases where a shortcut loses some."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cases import PROSE, documents
from corpus_audit.llm import decontaminate, passages


@pytest.mark.parametrize("between", [250, 600, 1500])
def test_a_later_passage_is_found_behind_a_long_one(spark, between):
    draw = random.Random(between)
    words = [f"q{number}" for number in range(100000)]
    own = lambda n: draw.choices(words, k=n)
    first, second = own(1200), own(120)
    docs = [(doc, " ".join(own(40) + first + own(between) + second + own(50))) for doc in (1, 2)]
    rows = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(row["equal_words"] for row in rows) == [120, 1200]


def test_chains_take_the_best_predecessor_within_the_gap():
    draw = np.random.default_rng(4)
    for _ in range(60):
        n = int(draw.integers(1, 60))
        a, b = draw.integers(0, 1500, n), draw.integers(0, 1500, n)
        b = np.where(draw.random(n) < 0.7, a + draw.integers(-3, 4, n), b)
        a, b = np.unique(np.stack([a, b]), axis=1)
        score = np.zeros(len(a))
        for now in np.lexsort((b, a)):
            score[now] = passages.SEED + max([0.0] + [
                score[at] - passages.GAP_COST * (a[now] - a[at] + b[now] - b[at]) / 2 for at in range(len(a))
                if 0 < a[now] - a[at] <= passages.MAX_GAP and 0 < b[now] - b[at] <= passages.MAX_GAP])
        path = passages.chain(a, b)[0]
        gained = passages.SEED * len(path) - passages.GAP_COST * (a[path[-1]] - a[path[0]] + b[path[-1]] - b[path[0]]) / 2
        assert gained == pytest.approx(score.max())


ITEMS = {
    1: "Compute 12 + 7 * 3 - 4 for 5 m and 6 kg",
    2: "Who wrote Hamlet?",
    3: "水的沸点是多少度",
    4: "น้ำเดือดที่กี่องศา",
    5: " ".join(f"{a} + {a + 1} = {2 * a + 1}" for a in range(10, 30)),
    6: "甲車出發，乙車等候，丙車回家，丁車停下，戊車跟隨，己車先行",
    7: "Anna paid 3 kg, 4 m, 5 s, 6 kg for the red boat and for the blue cart of Peter",
    8: "Yes",
}


def test_short_items_and_items_of_placeholders_are_found_verbatim(spark):
    around = {3: "大家都知道{}請回答", 4: "คำถาม{}ครับ", 6: "問題如下{}然後呢"}
    docs = [(item, around.get(item, "Some people ask: {} And nobody knows.").format(text)) for item, text in ITEMS.items()]
    docs += [(11, "Compute 12 - 7 + 3 * 4 for 5 m and 6 kg"), (12, "Who wrote this? Hamlet did."), (13, "水的沸點"),
             (14, ITEMS[5].replace("20 + 21", "20 + 22")), (None, "who wrote   hamlet"), (15, "Yes, yes and yes")]
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")).collect()
    found = {(row["doc_id"], row["item_id"]) for row in rows}
    assert found - {(11, 1)} == {(item, item) for item in range(1, 8)} | {(None, 2)}
    assert len(found) == len(rows)


def test_only_comparable_windows_count_as_an_items_windows(spark):
    item = "take 1 2 3 4 5 6 7 8 9 and then add them up one by one"
    docs = [(1, f"Now {item} again")]
    row, = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    tokens = decontaminate.template_tokens(item)
    comparable = sum(sum(decontaminate.canonical(token) != token for token in tokens[at:at + 5]) <= 3 for at in range(len(tokens) - 4))
    assert row["n_windows"] == comparable < len(tokens) - 4 and row["coverage"] == 1.0


def test_texts_under_one_id_are_compared_one_by_one(spark):
    item = "A farmer named Alice sold 12 apples to her friend and then gave 7 pears to the old man at the market before noon"
    other = item.replace("12", "40").replace("7", "9")
    docs, items = "doc_id long, text string, content long, shift int", "item_id long, text string, content long, item_slots string"
    rows = [(1, item, 5, 5), (1, other, 6, 6), (1, None, 5, 5), (None, other, 5, 5), (None, item, None, None), (2, other, 5, 5)]
    asked = [(9, item, 5, "x"), (9, "What else stands under this number? It is something different, of course, and longer by far", 5, "x")]
    found = decontaminate.leaks(spark.createDataFrame(rows, docs), spark.createDataFrame(asked, items)).collect()
    assert {(row["doc_id"], row["item_id"]): row["verbatim"] for row in found} == {(1, 9): True, (None, 9): True, (2, 9): False}
    assert len(found) == 3 and all(row["coverage"] == 1.0 for row in found)


def test_clean_rows_stay_whatever_rows_share_their_id(spark, tmp_path):
    spark.createDataFrame([(1, PROSE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    half = len(PROSE.split()) // 2
    docs = documents(spark, [(1, f"so {PROSE}", "en", "a"), (1, "clean under the same id", "en", "a"), (None, PROSE, None, "b"),
                             (None, "clean and without an id", None, "b"), (None, None, None, None), (2, "clean", "en", "c"),
                             (3, " ".join(PROSE.split()[:7]), "en", "c"), (3, " ".join(PROSE.split()[half:half + 7]), "en", "c")])
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((row["doc_id"] or 0, row["text"] or "") for row in kept.collect()) == sorted(
        (row["doc_id"] or 0, row["text"] or "") for row in docs.collect() if PROSE not in (row["text"] or ""))
