"""Whole configuration documents: against a merge of Python values, and defined cases."""

import json
import random

from corpus_audit.operators import config_documents, layered

SCHEMA = "project string, layer int, document string, kind string"


def joined(low, high):
    """What two layers say together; ``high`` wins."""
    if isinstance(low, dict) and isinstance(high, dict):
        return {key: joined(low[key], high[key]) if key in low and key in high else high.get(key, low.get(key)) for key in [*low, *high]}
    if not (isinstance(low, list) and isinstance(high, list)):
        return high
    for name in ("code", "id"):
        if all(isinstance(item, dict) and item.get(name) is not None for item in low + high):
            break
    else:
        return low + high
    places = {json.dumps(item[name]): at for at, item in enumerate(low)}
    out = list(low)
    for item in high:
        at = places.setdefault(json.dumps(item[name]), len(out))
        out[at:at + 1] = [item]
    return out


def leaves(value, steps=()):
    if isinstance(value, dict) and (value or not steps):
        for key, child in value.items():
            yield from leaves(child, (*steps, key))
    else:
        yield steps, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def resolved(spark, rows):
    found = config_documents.resolve(spark.createDataFrame([(*row, "extra") for row in rows], SCHEMA)).collect()
    assert len({(row["project"], *row["steps"]) for row in found}) == len(found)
    return {(row["project"], *row["steps"]): row["value"] for row in found}


def some_value(rng, depth=0):
    kind = rng.random()
    if kind < 0.4 and depth < 3:
        return {key: some_value(rng, depth + 1) for key in rng.sample("abc", rng.randint(0, 3))}
    if kind < 0.75:
        shape = rng.choice(["code", "id", "both", "plain", "some"])
        keys = {"code": ["code"], "id": ["id"], "both": ["code", "id"], "plain": [], "some": rng.choice([["code"], ["id"], []])}[shape]
        return [{**{key: rng.choice([1, 2, "x", "1"]) for key in keys}, "v": rng.randint(0, 99)} if shape != "plain" or rng.random() < 0.5
                else rng.choice([1, "t", None, [1], {"code": None}]) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, True, None, "text", "{}", "é\"", -3])


def test_documents_merge_like_python_values(spark):
    rng, rows, wanted = random.Random(5), [], {}
    for number in range(1000):
        project, whole = f"p{number}", {}
        for layer in range(rng.randint(1, 5)):
            document = {key: some_value(rng) for key in rng.sample("abcd", rng.randint(0, 4))}
            whole = joined(whole, document)
            rows.append((project, layer, json.dumps(document)))
        wanted.update({(project, *steps): text for steps, text in leaves(whole)} if whole else {})
    rng.shuffle(rows)
    found = resolved(spark, rows)
    assert found.keys() == wanted.keys()
    assert [(key, found[key], wanted[key]) for key in wanted if found[key] != wanted[key]] == []
    assert len({steps[-1] for steps in wanted}) > 2 and max(map(len, wanted)) > 4


def test_what_is_replaced_starts_anew(spark):
    rows = [("p", 1, '{"a": {"x": 1, "deep": {"y": 1}}, "l": [1]}'), ("p", 2, '{"a": 5, "l": {"k": 1}}'),
            ("p", 3, '{"a": {"z": {}}, "l": [2]}'), ("p", 4, '{"l": [3], "a.z": 7}')]
    assert resolved(spark, rows) == {("p", "a", "z"): "{}", ("p", "l"): "[2,3]", ("p", "a.z"): "7"}


def test_documents_that_cannot_be_read(spark):
    rows = [("p", 1, '{"a": 1}'), ("p", 2, "no json"), ("p", 3, "[1]"), ("p", 4, None), (None, 1, "{}"), ("p", None, "{}"),
            ("q", 1, '{"a": 1}'), ("q", 1, '{"a": 2}'), ("q", 1, '{"a": 2}'), ("r", 1, "{}"), ("s", 2, "")]
    assert resolved(spark, rows) == {("p", "a"): "1", ("q", "a"): "2"}
    frame = spark.createDataFrame([(*row, None) for row in rows], SCHEMA)
    errors = sorted(map(tuple, config_documents.unreadable(frame).collect()), key=str)
    assert errors == sorted([("p", 2, "no JSON"), ("p", 3, "no table"), ("p", 4, "no document"), (None, 1, "no project or layer"),
                             ("p", None, "no project or layer"), ("s", 2, "no JSON")], key=str)
    assert config_documents.resolve(frame.limit(0)).collect() == [] and config_documents.unreadable(frame.limit(0)).collect() == []
    found = layered.extract(config_documents.resolve(frame), ["a", "absent"])
    assert {(row["project"], row["value"]) for row in found.collect()} == {("p", "1"), ("q", "2")}


def test_long_arrays_and_deep_tables(spark):
    deep = '{"k":' * 30 + "1" + "}" * 30
    low = json.dumps({"items": [{"code": n, "v": 0} for n in range(1500)], "t": json.loads(deep)})
    high = json.dumps({"items": [{"code": n, "v": 1} for n in range(1000, 2000)]})
    found = resolved(spark, [("p", 1, low), ("p", 2, high)])
    assert found["p", "t", *["k"] * 30] == "1"
    assert [(item["code"], item["v"]) for item in json.loads(found["p", "items"])] == [(n, int(n >= 1000)) for n in range(2000)]
