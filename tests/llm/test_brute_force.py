"""Operators against brute force, exact round trips and held-out labels."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import PROSE
from corpus_audit.llm import decontaminate, lines, mixing, passages, sharding, simhash, tokens, toxicity
from corpus_audit.llm.queries import ORACLE, QUERIES, vocabulary
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_with_sql(spark, con, name):
    ok, text, _ = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE[name])
    assert ok, text


def find(parents, node):
    while parents[node] != node:
        parents[node] = parents[parents[node]]
        node = parents[node]
    return node


def grouped(nodes, linked):
    parents = {node: node for node in nodes}
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parents[find(parents, b)] = find(parents, a)
    return {node: find(parents, node) for node in nodes}


def slow_fingerprint(text, words_each=3):
    words = [word for word in (text or "").translate({n: n + 32 for n in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if word]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < words_each else [
        " ".join(words[at:at + words_each]) for at in range(len(words) - words_each + 1)]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near_texts(n=400, seed=3):
    """Texts in families, with single words changed."""
    draw = random.Random(seed)
    words = [f"w{number}" for number in range(500)]
    texts = []
    while len(texts) < n:
        base = draw.choices(words, k=draw.choice([2, 30, 300, 900]))
        for _ in range(draw.choice([1, 3, 40])):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    return list(enumerate(texts[:n]))


@pytest.mark.parametrize("max_bits", [3, 5, 7])
def test_simhash_groups(spark, monkeypatch, max_bits):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {row["doc_id"]: row for row in simhash.grouped(docs, max_bits=max_bits).collect()}
    prints = {doc: slow_fingerprint(text) for doc, text in rows}
    assert {doc: int(row["fingerprint"], 16) for doc, row in found.items()} == prints
    roots = grouped([doc for doc, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= max_bits)
    firsts = {}
    for doc in sorted(roots):
        firsts.setdefault(roots[doc], doc)
    assert {doc: row["component_id"] for doc, row in found.items()} == {doc: firsts[root] for doc, root in roots.items()}
    assert len(set(roots.values())) < len(set(prints.values()))


def words_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_line_groups(spark):
    draw = random.Random(5)
    texts = [text for _, text in near_texts(150, 7) if len(text.split()) < 400]
    text_rows = [(doc, "\n".join(draw.sample(texts, 3) + ["", "Same  LINE!"])) for doc in range(60)]
    rows = lines.decided(spark.createDataFrame(text_rows, "doc_id long, text string")).collect()
    held = {(doc, at): " ".join(line.lower().replace("!", "").split())
            for doc, text in text_rows for at, line in enumerate(text.split("\n")) if line}
    kinds = sorted(set(held.values()))

    def zeroed(line):
        return "".join("0" if sign.isdigit() else sign for sign in line).split()

    def mark(line):
        hashes = [xxhash.xxh64_intdigest(word, 42) for word in zeroed(line)]
        return sum(1 << bit for bit in range(63) if sum(h >> bit & 1 for h in hashes) > len(hashes) // 2)

    marks = {line: mark(line) for line in kinds}

    def linked(a, b):
        x, y = zeroed(a), zeroed(b)
        return (marks[a] ^ marks[b]).bit_count() <= 3 and words_apart(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)

    roots = grouped(kinds, linked)
    heads = {}
    for place in sorted(held):
        heads.setdefault(roots[held[place]], place)
    assert {(row["doc_id"], row["line_no"]): (row["group_doc"], row["group_line"]) for row in rows} == {
        place: heads[roots[line]] for place, line in held.items()}
    assert all(row["kept"] == ((row["doc_id"], row["line_no"]) == (row["group_doc"], row["group_line"])) for row in rows)


def test_lines_of_one_word_make_no_row_for_a_pair(spark, monkeypatch):
    draw = random.Random(3)
    others = ["".join(draw.choices("bcdfghjklm", k=9)) for _ in range(400)]
    kinds = [" ".join(["la"] * 7 + others[3 * at:3 * at + 3]) for at in range(120)]
    kinds += [" ".join(["la"] * 7 + [others[3 * at], others[3 * at + 1], others[-1 - at]]) for at in range(10)]
    counts, keep = [], lines.stored

    def counted(df, label):
        kept = keep(df, label)
        counts.append(kept.count())
        return kept

    monkeypatch.setattr(lines, "stored", counted)
    rows = lines.decided(spark.createDataFrame(list(enumerate(kinds)), "doc_id long, text string")).collect()
    codes = {line: [xxhash.xxh64_intdigest(word, 42) >> 40 & (lines.CODES - 1) for word in line.split()] for line in kinds}
    roots = grouped(kinds, lambda a, b: words_apart(codes[a], codes[b]) <= 2)
    assert 100 < len(set(roots.values())) <= 120
    heads = {}
    for doc, line in enumerate(kinds):
        heads.setdefault(roots[line], doc)
    assert {row["doc_id"]: row["group_doc"] for row in rows} == {doc: heads[roots[line]] for doc, line in enumerate(kinds)}
    assert max(counts) <= 3 * len(kinds)


def test_long_lines_count_in_wider_lanes(spark):
    words = [f"v{number % 977}x" for number in range(1300)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = lines.occurrences(df).first()
    hashes = [xxhash.xxh64_intdigest("".join("0" if c.isdigit() else c for c in word), 42) for word in words]
    assert row["fingerprint"] == sum(1 << bit for bit in range(63) if sum(h >> bit & 1 for h in hashes) > len(hashes) // 2)


def test_leaks_are_found_with_other_parameters_only_if_they_agree(spark):
    item = ("If a train leaves Boston at 40 km/h and Anna drives from Paris with 60 km/h for 3 hours, how far are they "
            "apart and when does Anna meet the train of Boston?")
    other = item.replace("Boston", "Chicago").replace("Anna", "Peter").replace("40", "55").replace("60", "70")
    clash = other.replace("does Peter", "does Susan")
    docs = [(1, f"Some words. {item} More words."), (2, f"Some words. {other} More words."), (3, f"Some words. {clash} More."),
            (4, PROSE), (5, "trains leave at 40 km/h and for 3 hours")]
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {(row["doc_id"], row["verbatim"]) for row in rows} == {(1, True), (2, False)}


def test_leaks_against_brute_force(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    items = spark.read.parquet(f"{LARGER}/benchmark.parquet")
    plain = lambda text: " ".join((text or "").lower().split())
    texts = {row["doc_id"]: plain(row["text"]) for row in docs.collect()}
    wanted = {(doc, row["item_id"]) for row in items.collect() for doc, text in texts.items() if plain(row["text"]) in text}
    assert {(row["doc_id"], row["item_id"]) for row in decontaminate.leaks(docs, items).collect()} == wanted and wanted


def test_large_benchmarks_are_joined_alike(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "benchmark"))
    small = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == small


def test_language_on_held_out_documents(spark):
    found = QUERIES["op5_language_id"](spark, LARGER)
    truth = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0) for row in rows)
    held = [row for row in rows if row["held_out"]]
    assert sum(row["lang_pred"] == row["lang"] for row in held) / len(held) > 0.97


def test_toxicity_on_held_out_documents_and_by_join(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{name}.parquet") for name in ("documents", "labels"))
    scores = {row["doc_id"]: row for row in toxicity.scored(docs, labels).collect()}
    joined = {row["doc_id"]: row["score"] for row in toxicity.scored(docs, labels, broadcast_entries=0).collect()}
    assert joined.keys() == scores.keys()
    assert all(abs(joined[doc] - row["score"]) < 1e-6 for doc, row in scores.items())
    held = [(scores[row["doc_id"]], row["toxic"]) for row in labels.collect() if scores[row["doc_id"]]["held_out"]]
    assert all(row["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1) for doc, row in scores.items())
    toxic = [row["score"] for row, label in held if label]
    clean = [row["score"] for row, label in held if not label]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8
    assert sum(row["predicted"] for row, label in held if not label) <= 0.05 * len(clean)


def test_expression_counts_are_kept_by_class_whatever_their_size(spark):
    texts = spark.createDataFrame([("one two one", 1), ("one two", 0), ("one two", 0), ("", 0), (None, 1)], "text string, toxic int")
    key = {pair: int(toxicity.bigrams(toxicity.word_ids(pair))[1]) for pair in ("one two", "two one")}
    found = {row["key"] & (2 ** 64 - 1): (row["n0"], row["n1"]) for row in toxicity._pair_counts(texts).collect()}
    assert found[key["one two"]] == (2, 1) and found[key["two one"]] == (0, 1)
    large = spark.createDataFrame([(7, 5_000_000_000, 3), (2 ** 32 + 7, 1, 6_000_000_000)], "key long, n0 long, n1 long")
    words = toxicity._split(large.coalesce(1)).filter("types IS NOT NULL").collect()
    assert [(row["key"], row["n0"], row["n1"], row["types0"], row["types1"]) for row in words] == [(7, 5_000_000_001, 6_000_000_003, 2, 2)]


def test_poisson_copies_have_the_target_mean(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "if(id % 4 = 0, 'a', 'b') AS source")
    targets = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    rows = mixing.mixed(docs, targets).groupBy("record.source").agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("rate")).collect()
    got = {row["source"]: (row["n"], row["rate"]) for row in rows}
    assert got["a"][1] == pytest.approx(3.0) and got["b"][1] == pytest.approx(1 / 3)
    assert abs(got["a"][0] - 3000) < 5 * 3000 ** 0.5 and abs(got["b"][0] - 1000) < 5 * 1000 ** 0.5


def test_high_rates_are_sums_of_draws(spark):
    docs = spark.createDataFrame([(1, "xx", "a"), (2, "x" * 4000, "b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    n = mixing.mixed(docs, targets).filter("record.source = 'a'").count()
    assert abs(n - 1000.5) < 6 * 1000.5 ** 0.5


def test_passages_exact_and_fuzzy(spark):
    draw = random.Random(11)
    words = [f"q{number}" for number in range(5000)]
    own = lambda n: draw.choices(words, k=n)
    shared, edited = own(70), None
    edited = [word if at % 12 else "changed" for at, word in enumerate(own(150))]
    variant = list(edited)
    variant[40:41] = ["one", "more"]
    del variant[100]
    docs = [(1, own(200) + shared + own(30)), (2, own(20) + shared + own(99)), (3, own(400)), (4, own(90) + edited + own(10)),
            (5, own(15) + variant + own(77)), (6, own(60)), (7, own(30) + shared[:30] + own(30))]
    rows = passages.repeated(spark.createDataFrame([(doc, " ".join(text)) for doc, text in docs], "doc_id long, text string")).collect()
    found = {frozenset((row["doc_id"], row["match_doc_id"])): row for row in rows}
    assert set(found) == {frozenset((1, 2)), frozenset((4, 5))}
    exact = found[frozenset((1, 2))]
    assert {exact["a_start"], exact["b_start"]} == {200, 20} and exact["a_end"] - exact["a_start"] == 70 == exact["equal_words"]
    fuzzy = found[frozenset((4, 5))]
    assert {fuzzy["a_start"], fuzzy["b_start"]} == {90, 15} and fuzzy["a_end"] - fuzzy["a_start"] >= 148


def test_passages_of_pieces_that_others_hold(spark):
    """Two texts share 80 words but for two, and other texts hold each third of them as well."""
    draw, place = random.Random(12), passages.F.xxhash64
    words = [f"q{number}" for number in range(5000)]
    own = lambda n: draw.choices(words, k=n)
    thirds = [own(26) for _ in range(3)]
    pair = [own(60) + thirds[0] + own(1) + thirds[1] + own(1) + thirds[2] + own(60) for _ in range(2)]
    texts = [" ".join(text) for text in pair + [own(60) + third + own(60) for third in thirds for _ in range(40)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "place long, text string").withColumn("class", place("text"))
    order = {row["place"]: row["class"] for row in frame.collect()}
    # Of the others, as many stay as are needed before the first and between the two.
    low, high = sorted((order[0], order[1]))
    kept = [0, 1]
    for third in range(3):
        of_third = range(2 + 40 * third, 42 + 40 * third)
        kept += [at for at in of_third if order[at] < low][:1] + [at for at in of_third if low < order[at] < high][:14]
    rows = passages.repeated(frame.filter(passages.F.col("place").isin(kept)), doc_id="place").collect()
    assert (0, 1) in {tuple(sorted((row["doc_id"], row["match_doc_id"]))) for row in rows}
    assert {row["group"] for row in rows if row["doc_id"] in (0, 1)} == {0}


def test_frequent_seeds_are_dealt_once(spark, monkeypatch):
    taken, previous = [], passages._with_previous
    monkeypatch.setattr(passages, "_with_previous", lambda live: taken.append(live) or previous(live))
    words, n = [f"q{number}" for number in range(60)], passages.CROWD + 8
    docs = [(doc, " ".join(words + [f"r{doc}x{number}" for number in range(60)])) for doc in range(n)]
    rows = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {row["doc_id"] for row in rows} | {row["match_doc_id"] for row in rows} == set(range(n)) and {row["group"] for row in rows} == {0}
    frequent, = taken
    assert "Join" not in frequent._jdf.queryExecution().optimizedPlan().toString()
    assert {row["n"] for row in frequent.groupBy("seed").agg(F.count_distinct("class").alias("n")).collect()} == {n}


def test_chains_are_collinear_and_best():
    draw = np.random.default_rng(2)
    for _ in range(30):
        n = int(draw.integers(1, 25))
        a, b = draw.integers(0, 60, n), draw.integers(0, 60, n)
        score = np.zeros(n)
        for now in np.lexsort((b, a)):
            score[now] = passages.SEED + max([0.0] + [
                score[at] - passages.GAP_COST * (a[now] - a[at] + b[now] - b[at]) / 2
                for at in range(n) if a[at] < a[now] and b[at] < b[now]])
        best = passages.chain(a, b)
        assert sorted(at for path in best for at in path) == list(range(n))
        assert all(a[x] < a[y] and b[x] < b[y] for path in best for x, y in zip(path, path[1:]))
        path = best[0]
        gained = passages.SEED * len(path) - passages.GAP_COST * (a[path[-1]] - a[path[0]] + b[path[-1]] - b[path[0]]) / 2
        assert gained == pytest.approx(score.max())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2 ** 32 - 1), min_size=1, max_size=200), st.data())
def test_packed_ids_come_back_from_any_place(bits, numbers, data):
    ids = (np.array(numbers, dtype=np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    start = data.draw(st.integers(0, len(ids) - 1))
    payload = tokens.pack(ids, bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    assert (tokens.unpack(payload, bits, start, len(ids) - start) == ids[start:]).all()


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer
    plain, mine = Tokenizer.from_file(vocabulary()), tokens.Encoder(vocabulary())
    draw = random.Random(1)
    for _ in range(20000):
        text = "".join(draw.choice("ab é1.'\n\n   \ts\xa0lÉß日$!_²½ǅ") for _ in range(draw.randint(0, 14)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    for _ in range(3000):
        text = "".join(draw.choice(["<|endoftext|>", "<|endoftext", "|>", "a", " ", "\n", "the"]) for _ in range(draw.randint(1, 9)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert np.frombuffer(mine.encode("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]


def test_token_files_hold_every_document_in_order(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocabulary())
    docs = sorted(map(tuple, spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()))
    found = {row["doc_id"]: row for row in QUERIES["op10_token_ids"](spark, FOLDER).collect()}
    start = 0
    for doc, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        own = found[doc]
        assert (own["start"], own["n_tokens"], own["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shards_follow_the_key_law(spark):
    rows = QUERIES["op1_shard_documents"](spark, LARGER).collect()
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        data = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"], row["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert row["grown_shard"] in (row["shard"], 24) and 0 <= row["shard"] < 24
    for shard in range(24):
        slots = sorted((row["slot"], row["doc_id"]) for row in rows if row["shard"] == shard)
        assert [slot for slot, _ in slots] == list(range(len(slots)))
        assert [doc for _, doc in slots] != sorted(doc for _, doc in slots)


def test_a_repeated_key_is_spread_over_buckets(spark, tmp_path):
    docs = spark.range(3000).selectExpr("1L AS doc_id", "'some text' AS text")
    sizes = sharding.write_shards(docs, str(tmp_path / "s"), 4, bucket_bytes=5000).groupBy("bucket").count().collect()
    assert sum(row["count"] for row in sizes) == 3000 and max(row["count"] for row in sizes) < 600
