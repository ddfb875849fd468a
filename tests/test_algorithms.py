"""Distributed algorithms against brute force on small random inputs."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpus_audit.functions import ordered
from corpus_audit.operators import components, findings, graph, intervals, layered, pointers, setjoin, similarity, trends


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}
    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + n, 101 + n) for n in range(40)]
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == union_find(nodes, [p for p in pairs if p[0] != p[1]])


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_overlap_groups(spark, seed):
    rng = random.Random(seed)
    rows = set()
    for _ in range(70):
        start = rng.randrange(1, 60)
        rows.add(("f", 3, start, start + rng.choice([0, 0, 1, 2, 3, 5, 8, 20, 40])))
    rows = sorted(rows)
    def linked(x, y):
        shared = min(x[3], y[3]) - max(x[2], y[2]) + 1
        return shared * 2 > min(x[3] - x[2], y[3] - y[2]) + 1
    expected = union_find(rows, [(x, y) for x, y in combinations(rows, 2) if linked(x, y)])
    df = spark.createDataFrame(rows, "path string, axiom int, line_start int, line_end int")
    got = intervals.overlap_groups(df, ["path", "axiom"]).collect()
    groups, wanted = defaultdict(set), defaultdict(set)
    for r in got:
        groups[r.group].add((r.path, r.axiom, r.line_start, r.line_end))
    for row, root in expected.items():
        wanted[root].add(row)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_overlap_needs_more_than_half(spark):
    rows = [("f", 3, 1, 4, "a"), ("f", 3, 3, 6, "b"), ("g", 3, 1, 4, "c"), ("g", 3, 2, 5, "d"), ("g", 5, 2, 5, "e"),
            ("h", 3, 1, 4, "x"), ("h", 3, 2, 6, "y"), ("h", 3, 5, 6, "z")]
    df = spark.createDataFrame(rows, "path string, axiom int, line_start int, line_end int, finding_id string")
    full = df.select("*", F.lit("R").alias("rule_id"), F.lit("warning").alias("severity"), F.array(F.lit("regex")).alias("source"), F.lit("m").alias("message"))
    merged = {r.finding_id: r.merged for r in findings.merge_overlaps(full).collect()}
    # Half is not enough (a, b); chains merge (x, y, z); another axis stays apart (e).
    assert merged == {"a": 1, "b": 1, "c": 2, "e": 1, "x": 3}


def test_ordered_helpers(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), n, rng.randrange(10)) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    w = Window.partitionBy("k").orderBy("n")
    plain = (df.withColumn("p", F.lag("v").over(w)).withColumn("r", F.row_number().over(w)).withColumn("s", F.sum("v").over(w))
             .withColumn("m", F.sum("v").over(w.rowsBetween(-3, 0))))
    expected = sorted((r.k, r.n, r.p, r.r, r.s, r.m) for r in plain.fillna(-1).collect())
    bucket = F.floor(F.col("n") / 7)
    got = ordered.with_previous(df, ["k"], ["n"], bucket, ["v"])
    got = ordered.with_rank(got, ["k"], ["n"], bucket, "r")
    got = ordered.with_running_sum(got, ["k"], ["n"], bucket, F.col("v"), "s")
    got = ordered.over_last_rows(got, ["k"], "r", 3, {"m": F.sum("v")}, block=8)
    assert sorted((r.k, r.n, r.prev_v, r.r, r.s, r.m) for r in got.fillna(-1).collect()) == expected


def test_short_islands_need_no_rounds(spark, monkeypatch):
    """Ranges that touch few others are grouped in one pass, as by the rounds that long islands take."""
    draw = random.Random(8)
    rows = [(f"f{draw.randrange(4)}", start, start + draw.choice([0, 0, 1, 3, 9])) for start in draw.choices(range(150), k=120)]
    df = spark.createDataFrame(rows, "path string, line_start int, line_end int")

    def groups():
        found = {}
        for row in intervals.overlap_groups(df, ["path"]).collect():
            found.setdefault(row["group"], set()).add((row["path"], row["line_start"], row["line_end"]))
        assert sum(map(len, found.values())) == len(set(rows))
        return {frozenset(members) for members in found.values()}

    rounds = []
    monkeypatch.setattr(intervals, "components", lambda links: rounds.append(1) or components.components(links))
    short = groups()
    assert not rounds
    monkeypatch.setattr(intervals, "ISLAND", 1)
    assert groups() == short and rounds


@pytest.mark.parametrize("seed", [7, 8])
def test_cycles(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(38)}
    reach = {a: {b for x, b in edges if x == a} for a in range(30)}
    for _ in range(30):
        for a in reach:
            for b in list(reach[a]):
                reach[a] |= reach[b]
    expected = {a: min([b for b in reach[a] if a in reach[b]]) for a in reach if a in reach[a]}
    df = spark.createDataFrame(sorted(edges), "src int, dst int")
    assert {r.module: r.component for r in graph.cycles(df).collect()} == expected


@pytest.mark.parametrize("seed", [0, 1])
def test_cycles_behind_stretches(spark, seed):
    """Sparse graphs whose edges were drawn out into stretches, with bare rings, handles and dead ends."""
    rng = random.Random(seed)
    edges, fresh = set(), iter(range(100, 10000))
    for _ in range(14):
        a, b = rng.randrange(10), rng.randrange(10)
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            inner = next(fresh)
            edges.add((a, inner))
            a = inner
        edges.add((a, b))
    ring = [next(fresh) for _ in range(7)]
    edges |= set(zip(ring, ring[1:] + ring[:1])) | {(next(fresh), 3), (4, next(fresh))}
    out, into = defaultdict(set), defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)
    def reached(start, step):
        seen, todo = set(), list(step[start])
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo += step[node]
        return seen
    both = {node: reached(node, out) & reached(node, into) for node in list(out)}
    expected = {node: min(group) for node, group in both.items() if node in group}
    df = spark.createDataFrame(sorted(edges), "src int, dst int")
    assert {r.module: r.component for r in graph.cycles(df).collect()} == expected


def test_long_ring_takes_few_rounds(spark, monkeypatch):
    n, cuts = 20_000, []
    def counted(df):
        cuts.append(1)
        return cut(df)
    cut = graph.cut_lineage
    for module in (graph, components, pointers):
        monkeypatch.setattr(module, "cut_lineage", counted)
    ids = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    line = spark.range(n, 2 * n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    handle = spark.createDataFrame([(5, 3 * n), (3 * n, 5)], "src long, dst long")
    rows = graph.cycles(ids.union(line).union(handle)).groupBy("component").count().collect()
    assert [tuple(row) for row in rows] == [(0, n + 1)]
    assert len(cuts) < 100


def test_blast_radius(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c")], "src string, dst string")
    got = graph.blast_radius(edges, spark.createDataFrame([("d",)], "module string"), 2).collect()
    assert {r.module: r.distance for r in got} == {"d": 0, "c": 1, "b": 2, "x": 2}


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/lib/index.ts", "src/lib/b.ts", "ui/kit/c.tsx")], "path string")
    edges = spark.createDataFrame([("src/a.ts", s, "import") for s in ("./lib", "./lib/b", "../ui/kit/c", "@/lib/b", "@/ui/c", "react", "./gone")],
                                  "src string, spec string, kind string")
    _, status = graph.resolve_edges(edges, files, [("@/", "src/"), ("@/ui/", "ui/kit/")])
    got = {r.spec: r.dst or r.reason for r in status.collect()}
    assert got == {"./lib": "src/lib/index.ts", "./lib/b": "src/lib/b.ts", "../ui/kit/c": "ui/kit/c.tsx", "@/lib/b": "src/lib/b.ts",
                   "@/ui/c": "ui/kit/c.tsx", "react": "external", "./gone": "no such file"}


def test_barrels(spark):
    edges = spark.createDataFrame([("m", "b1", "x"), ("m", "b1", "y"), ("m", "r1", "x")], "src string, dst string, symbol string")
    reexports = spark.createDataFrame([("b1", "x", "b2"), ("b2", "x", "b3"), ("b3", "x", "def"), ("r1", "x", "r2"), ("r2", "x", "r1")],
                                      "barrel string, symbol string, target string")
    got = sorted((r.dst, r.symbol) for r in graph.flatten_barrels(edges, reexports).collect())
    assert got == [("b1", "y"), ("def", "x"), ("r1", "x")]
    assert {r.barrel for r in graph.barrel_rings(reexports).collect()} == {"r1", "r2"}


def test_chain_ends(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(50)], "key int, next int")
    got = {r.key: (r.end, r.steps, r.ring) for r in pointers.chain_ends(links).collect()}
    assert got == {n: (50, 50 - n, False) for n in range(50)}


def test_ancestry_with_chains_and_merges(spark):
    parents = [(0, None), (100, None)] + [(n, n - 1) for n in range(1, 20)] + [(101, 100), (20, 19), (20, 101), (21, 20), (102, 101)]
    rank = {0: 0, 100: 0}
    for n in range(1, 20):
        rank[n] = n
    rank.update({101: 1, 102: 2, 20: 20, 21: 21})
    df = spark.createDataFrame(parents, "sha int, parent_sha int")
    assert {r.sha: r.generation for r in trends.ancestry_rank(df).collect()} == rank


@pytest.mark.parametrize("seed", [21, 22])
def test_nearest_ancestor_run(spark, monkeypatch, seed):
    monkeypatch.setattr(trends, "STRETCH", 3)
    rng = random.Random(seed)
    parents = {n: sorted({n - 1} | ({rng.randrange(n)} if rng.random() < 0.15 else set())) for n in range(1, 60)}
    runs = [(f"r{n}", f"c{rng.randrange(60):02d}", rng.choice("ab"), rng.randrange(2), float(n)) for n in range(60)]
    known = {}
    for record, commit, scope, axiom, score in runs:
        known.setdefault((commit, scope, axiom), []).append((record, score))
    expected = {}
    for record, commit, scope, axiom, _ in runs:
        level, distance = {int(commit[1:])}, 0
        while level:
            level, distance = {up for n in level for up in parents.get(n, [])}, distance + 1
            hits = [f"c{n:02d}" for n in level if (f"c{n:02d}", scope, axiom) in known]
            if hits:
                expected[record] = (distance, max(known[max(hits), scope, axiom])[1])
                break
    commits = [("c00", None)] + [(f"c{n:02d}", f"c{up:02d}") for n, ups in parents.items() for up in ups]
    scored = spark.createDataFrame(runs, "record_id string, commit_sha string, scope string, axiom int, score double")
    got = trends.ancestor_baseline(scored, scored, spark.createDataFrame(commits, "sha string, parent_sha string")).collect()
    assert {r.record_id: (r.distance, r.baseline) for r in got} == expected


def test_old_run_on_a_long_line(spark):
    line = spark.range(100_000).selectExpr("id AS sha", "nullif(id - 1, -1) AS parent_sha")
    rounds, cut = [], trends.cut_lineage
    trends.cut_lineage = lambda df: rounds.append(1) or cut(df)
    try:
        runs = spark.createDataFrame([("new", 99_999, "all", 1, 7.0), ("old", 12, "all", 1, 5.0)], "record_id string, commit_sha long, scope string, axiom int, score double")
        got = trends.ancestor_baseline(runs.filter("record_id = 'new'"), runs, line).collect()
    finally:
        trends.cut_lineage = cut
    assert [tuple(r) for r in got] == [("new", 99_987, 5.0)] and len(rounds) < 30


def test_moving_scores_of_string_ids(spark):
    rows = [(f"run-{n:03d}", f"rec-{n}", 1, float(n % 7)) for n in range(100)]
    df = spark.createDataFrame(rows, "run_id string, record_id string, axiom int, score double")
    got = {r.run_id: (r.moving, r.mean_so_far) for r in trends.moving_scores(df, 2).collect()}
    scores = [row[3] for row in rows]
    assert got == {row[0]: (round(sum(scores[max(0, n - 2):n + 1]) / min(n + 1, 3), 6), round(sum(scores[:n + 1]) / (n + 1), 6)) for n, row in enumerate(rows)}


@pytest.mark.parametrize("seed", [9, 10])
def test_leader_links(spark, seed):
    rng = random.Random(seed)
    place = {n: rng.randrange(40) for n in range(60)}
    buckets = {b: sorted(rng.sample(range(60), 25)) for b in "abc"}
    expected = set()
    for members in buckets.values():
        rest = members
        while rest:
            leader, others = rest[0], rest[1:]
            close = [m for m in others if abs(place[m] - place[leader]) <= 2]
            expected |= {(m, leader) for m in close}
            rest = [m for m in others if m not in close]
    spots = spark.createDataFrame(list(place.items()), "id int, x int")
    def score(pairs):
        both = pairs.join(spots, "id").join(spots.select(F.col("id").alias("leader"), F.col("x").alias("y")), "leader")
        return both.select("id", "leader", (1.0 - F.abs(F.col("x") - F.col("y")) / 10).alias("score"))
    members = spark.createDataFrame([(b, m) for b, ms in buckets.items() for m in ms], "bucket string, id int")
    got = {(r.id, r.leader) for r in similarity.leader_links(members, score, 0.75).collect()}
    assert got == expected


def test_near_duplicates_of_many_copies(spark):
    base = " ".join(f"w{n}" for n in range(60))
    rows = [(f"copy{n:02d}", base) for n in range(20)] + [("near", base + " tail"), ("other", " ".join(f"z{n}" for n in range(60))), ("empty", "")]
    got = {r.path: (r.leader, r.score) for r in similarity.near_duplicates(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {**{f"copy{n:02d}": ("copy00", 1.0) for n in range(1, 20)}, "near": ("copy00", round(58 / 59, 6))}


def drifting_families(count, seed):
    """Sets of which each differs from the one before it by a few members, in families of up to sixty."""
    rng, sets = random.Random(seed), []
    while len(sets) < count:
        members = [rng.getrandbits(40) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.choice([1, 2, 3, 60])):
            sets.append(sorted(set(members)))
            members = list(members)
            for _ in range(rng.randint(0, max(1, len(members) // 8))):
                members[rng.randrange(len(members))] = rng.getrandbits(40)
    return sets[:count]


@pytest.mark.parametrize("crowd, block, count", [(32, 512, 2000), (4, 16, 600)])
def test_similar_sets(spark, monkeypatch, crowd, block, count):
    monkeypatch.setattr(setjoin, "CROWD", crowd)
    monkeypatch.setattr(setjoin, "BLOCK", block)
    sets = [set(members) for members in drifting_families(count, crowd)]
    pairs = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in combinations(range(count), 2)
             if 0.69 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b]))}
    linked = {pair: score for pair, score in pairs.items() if score >= 0.7}
    df = spark.createDataFrame([(f"{n:05d}", list(members)) for n, members in enumerate(sets)] + [("none", [])], "id string, members array<long>")
    links = {(int(r.a), int(r.b)): r.score for r in setjoin.similar_sets(df, 0.7).collect()}
    assert links.items() <= linked.items()
    assert union_find(range(count), links) == union_find(range(count), linked)


def test_sets_that_share_a_little_are_not_compared(spark, monkeypatch):
    """Members of some three sets each lie among a million of one set; only sets 0 and 1 are alike."""
    compared, scores = [], setjoin.scores
    monkeypatch.setattr(setjoin, "scores", lambda pairs, sets: compared.append(pairs.count()) or scores(pairs, sets))
    own = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda x: F.xxhash64(F.greatest("no", F.lit(1)), x))
    pool = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda x: F.pmod(F.xxhash64("no", -x), F.lit(7000)))
    df = spark.range(2000).toDF("no").select(F.format_string("%05d", "no").alias("id"), F.array_distinct(F.concat(own, pool)).alias("members"))
    assert {(row.a, row.b) for row in setjoin.similar_sets(df, 0.7).collect()} == {("00000", "00001")}
    assert sum(compared) == 1


def test_near_duplicates_of_chains(spark):
    words = [f"w{n}" for n in range(200)]
    rows = []
    for n in range(40):
        words = [f"v{n}x{k}" if 4 * n <= k < 4 * n + 4 else word for k, word in enumerate(words)]
        rows.append((f"f{n:02d}", " ".join(words)))
    got = {r.path: (r.leader, r.score) for r in similarity.near_duplicates(spark.createDataFrame(rows, "path string, text string")).collect()}
    grams = {path: {tuple(text.split()[at:at + 3]) for at in range(198)} for path, text in rows}
    assert got == {path: ("f00", round(len(grams[path] & grams["f00"]) / len(grams[path] | grams["f00"]), 6)) for path in list(grams)[1:]}
    assert got["f39"][1] < 0.2


@pytest.mark.parametrize("tolerance", [0, 1, 3])
def test_findings_meet_labels_one_to_one(spark, tolerance):
    rng = random.Random(tolerance)
    spots = lambda: [(f"p{p}", "R", line) for p in range(60) for line in rng.sample(range(1, 16), rng.randint(0, 7))]
    found, labels = spots(), spots()
    tp = 0
    for path in {row[0] for row in found}:
        lines = [row[2] for row in found if row[0] == path]
        owner = {}
        def place(label, tried):
            for line in lines:
                if abs(line - label) <= tolerance and line not in tried:
                    tried.add(line)
                    if line not in owner or place(owner[line], tried):
                        owner[line] = label
                        return True
            return False
        tp += sum(place(row[2], set()) for row in labels if row[0] == path)
    schema = "path string, rule_id string, line_start int"
    row = findings.score_oracle(spark.createDataFrame(found + found, schema), spark.createDataFrame(labels, schema), tolerance).first()
    assert (row.tp, row.tp + row.fp, row.tp + row.fn) == (tp, len(found), len(labels))


def test_one_finding_meets_one_of_two_labels(spark):
    schema = "path string, rule_id string, line_start int"
    row = findings.score_oracle(spark.createDataFrame([("p", "R", 10)], schema), spark.createDataFrame([("p", "R", 9), ("p", "R", 11)], schema)).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall) == (1, 0, 1, 1.0, 0.5)


def merged_items(base, override):
    """Keyed merge stated directly on lists of (code, id, item)."""
    both = base + override
    column = 0 if all(r[0] for r in both) else 1 if all(r[1] for r in both) else None
    if column is None:
        return [r[2] for r in both]
    latest = {}
    for row in override:
        latest[row[column]] = row[2]
    last = {row[column]: n for n, row in enumerate(base)}
    out = [latest[r[column]] if r[column] in latest and last[r[column]] == n else r[2] for n, r in enumerate(base)]
    return out + [item for key, item in latest.items() if key not in last]


@pytest.mark.parametrize("seed", range(11, 17))
def test_keyed_arrays(spark, seed):
    rng = random.Random(seed)
    def items(name, with_code, with_id):
        return [(rng.choice("abc") if with_code else rng.choice(["a", None]), rng.choice("xyz") if with_id else rng.choice(["x", None]), f"{name}{n}")
                for n in range(rng.randrange(1, 6))]
    with_code, with_id = seed % 3 == 0, seed % 3 < 2
    base, override = items("b", with_code, with_id), items("o", with_code, with_id)
    schema = "project string, path string, idx int, code string, id string, item string"
    def table(rows):
        return spark.createDataFrame([("p", "k", n, *r) for n, r in enumerate(rows)], schema)
    got = layered.merge_keyed_arrays(table(base), table(override)).orderBy("idx").collect()
    assert [r.item for r in got] == merged_items(base, override)
    assert [r.idx for r in got] == list(range(len(got)))


def test_findings_do_not_depend_on_row_order(spark):
    rows = [("f", n, "error") for n in range(30)]
    a = spark.createDataFrame(rows, "finding_id string, line_start int, severity string").withColumn("line_end", F.col("line_start"))
    b = a.orderBy(F.col("line_start").desc()).repartition(7)
    result = findings.same_findings(a, b).first()
    assert (result.only_a, result.only_b, result.same) == (0, 0, True)


def test_ancestry_rounds_touch_a_commit_once(spark, monkeypatch):
    """Every commit is in the table of one round only, whatever the number of rounds; many rounds stay few tables."""
    monkeypatch.setattr(trends, "SMALL", 8)
    monkeypatch.setattr(trends, "FEW", 3)
    parents = [(0, None)] + [(n, (n - 1) // 2) for n in range(1, 400)] + [(n, (n - 1) // 3) for n in range(4, 400)]
    rank = {0: 0}
    for n in range(1, 400):
        rank[n] = rank[(n - 1) // 2] + 1
    widest, cut = [], trends.cut_lineage

    def counted(df):
        done = cut(df)
        if done.columns == ["head", "need", "got", "generation"]:
            widest.append(done.filter("got = need").count())
        return done
    monkeypatch.setattr(trends, "cut_lineage", counted)
    df = spark.createDataFrame(parents, "sha int, parent_sha int")
    assert {r.sha: r.generation for r in trends.ancestry_rank(df).collect()} == rank
    assert widest and sum(widest) < 400
