"""A map refreshed step by step equals the map built anew."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_audit.operators import refresh

ZONES = [("src", "ROOT", "generic"), ("src/a", "A", "domain"), ("src/b", "B", "thin")]
NAMES = [f"src/{folder}/m{n}" for folder in "ab" for n in range(6)]


def text_of(rng):
    lines = [f"import {{ x }} from '@/{rng.choice(NAMES)[4:]}';" for _ in range(rng.randrange(4))]
    return "\n".join(lines + [f"import y from './m{rng.randrange(7)}';", f"const z = {rng.randrange(3)};"])


def corpus(rng):
    return {name + rng.choice([".ts", ".ts", "/index.ts"]): text_of(rng) for name in rng.sample(NAMES, 9)}


def edited(rng, files):
    after = dict(files)
    for path in rng.sample(sorted(after), 2):
        del after[path]
    for path in rng.sample(sorted(after), 2):
        after[path] = text_of(rng)
    return after | {path: text for path, text in list(corpus(rng).items())[:3] if path not in after}


def file_table(spark, files, parsed=None):
    """Files with hashes; only those in ``parsed`` have their text."""
    rows = [(path, text) for path, text in files.items()]
    hashed = spark.createDataFrame(rows, "path string, text string").withColumn("hash", F.sha2("text", 256))
    if parsed is None:
        return hashed
    return hashed.withColumn("text", F.when(F.col("path").isin(sorted(parsed)), F.col("text")))


def rows_of(state):
    return {row["entity"]: tuple(row) for row in state.map.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_refresh_equals_build(spark, seed):
    rng = random.Random(seed)
    zones = spark.createDataFrame(ZONES, "prefix string, zone string, role string")
    files = corpus(rng)
    history = [(rng.choice(NAMES) + ".ts", rng.choice("xyz")) for _ in range(30)]
    table = lambda rows: spark.createDataFrame(rows, "entity string, author string")
    state = refresh.build_state(file_table(spark, files), table(history), zones, [("@/", "src/")])
    for _ in range(3):
        after = edited(rng, files)
        lost = rng.sample(history, 6)
        gained = [(rng.choice(NAMES) + ".ts", rng.choice("xyzw")) for _ in range(6)]
        for row in lost:
            history.remove(row)
        history += gained
        changes = spark.createDataFrame([(*row, -1) for row in lost] + [(*row, 1) for row in gained], "entity string, author string, sign int")
        touched = {path for path, text in after.items() if files.get(path) != text}
        state = refresh.refresh(state, file_table(spark, after, touched), changes, zones, [("@/", "src/")])
        anew = refresh.build_state(file_table(spark, after), table(history), zones, [("@/", "src/")])
        assert rows_of(state) == rows_of(anew)
        assert sorted(map(tuple, state.edges.collect())) == sorted(map(tuple, anew.edges.collect()))
        files = after


def test_counts_of_unchanged_files_move(spark):
    zones = spark.createDataFrame(ZONES, "prefix string, zone string, role string")
    files = {"src/a/one.ts": "import { x } from './two';", "src/a/two.ts": "export const x = 1;", "src/b/three.ts": "import { x } from '@/a/four';"}
    history = spark.createDataFrame([("src/a/two.ts", "ann"), ("src/a/two.ts", "ann")], "entity string, author string")
    state = refresh.build_state(file_table(spark, files), history, zones, [("@/", "src/")])
    assert rows_of(state)["src/a/two.ts"][3:5] == (1, 1)
    after = {"src/a/one.ts": "nothing", "src/a/two.ts": files["src/a/two.ts"], "src/b/three.ts": files["src/b/three.ts"], "src/a/four.ts": "export const x = 2;"}
    changes = spark.createDataFrame([("src/a/two.ts", "ben", 1), ("src/a/two.ts", "ann", -1)], "entity string, author string, sign int")
    now = rows_of(refresh.refresh(state, file_table(spark, after, {"src/a/one.ts", "src/a/four.ts"}), changes, zones, [("@/", "src/")]))
    # Nobody imports two any more, and one change of ann is left; three has not changed, but its import now leads to four.
    assert now["src/a/two.ts"][3:5] == (0, 2)
    assert now["src/a/four.ts"][3:5] == (1, 0)


def test_nothing_changed_and_everything_gone(spark):
    zones = spark.createDataFrame(ZONES, "prefix string, zone string, role string")
    files = {"src/a/one.ts": "import { x } from './two';", "src/a/two.ts": ""}
    none = spark.createDataFrame([], "entity string, author string, sign int")
    state = refresh.build_state(file_table(spark, files), none.select("entity", "author"), zones)
    assert rows_of(refresh.refresh(state, file_table(spark, files, set()), none, zones)) == rows_of(state)
    gone = refresh.refresh(state, file_table(spark, files).limit(0), none, zones)
    assert rows_of(gone) == {} and gone.edges.count() == 0 and gone.statements.count() == 0
