"""Clone classes against brute force."""

import random
from collections import defaultdict

import pytest

from corpus_audit.operators import clones


def brute_force(files, k):
    lines = {path: [(no, " ".join(line.split())) for no, line in enumerate(text.split("\n"), 1) if line.strip()]
             for path, text in files if text is not None}
    places = defaultdict(list)
    for path, own in lines.items():
        for at in range(len(own)):
            for end in range(at + k, len(own) + 1):
                places[tuple(line for _, line in own[at:end])].append((path, at))
    longest = {}
    for run, at in places.items():
        if len(at) > 1:
            for place in at:
                longest[place] = max(longest.get(place, ()), run, key=len)
    out = []
    for (path, at), run in longest.items():
        if len(longest.get((path, at - 1), ())) != len(run) + 1:
            first = min(places[run])
            out.append((path, lines[path][at][0], lines[path][at + len(run) - 1][0], len(run), len(places[run]),
                        first[0], lines[first[0]][first[1]][0]))
    return sorted(out)


def found(spark, files, k):
    return sorted(tuple(row) for row in clones.clone_classes(spark.createDataFrame(files, "path string, text string"), k).collect())


@pytest.mark.parametrize("seed,alphabet", [(1, 3), (2, 40), (3, 400)])
def test_longest_runs_and_their_classes(spark, seed, alphabet):
    draw = random.Random(seed)
    pool = [[f"line {draw.randrange(alphabet)}" for _ in range(draw.choice([4, 9, 30]))] for _ in range(8)]
    files = []
    for number in range(200 if alphabet > 3 else 25):
        body = []
        for _ in range(draw.randrange(1, 4)):
            block = draw.choice(pool)
            start = draw.randrange(len(block))
            body += block[start:start + draw.randrange(1, 31)] + ["", *(f"  line  {draw.randrange(alphabet * 5)}" for _ in range(draw.randrange(3)))]
        files.append((f"f{number:03}", "\n".join(body)))
    expected = brute_force(files, 3)
    assert len(expected) > 20 and found(spark, files, 3) == expected


def test_repeats_within_a_file_nulls_and_short_files(spark):
    files = [("a", "x\n" * 9), ("b", None), ("c", ""), ("d", "x\ny"), ("e", "p\nq\nr\ns"), ("e2", "o\np\n\nq\nr\nt")]
    assert found(spark, files, 3) == brute_force([f for f in files if f[1] is not None], 3)
    assert found(spark, [("a", "one\ntwo\nthree"), ("b", "four")], 3) == []
    assert found(spark, [], 3) == []
