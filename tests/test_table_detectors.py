"""Detectors as table functions: columns by argument, crashes of one file or group, order within groups."""

import pytest

from corpus_audit.operators import detectors, table_detectors


def file_detector():
    """Made inside a function, so that it travels by value."""
    def marks(path, text, mark="TODO"):
        for number, line in enumerate(text.split("\n"), 1):
            if line == "crash":
                raise ValueError("cannot read")
            if mark in line:
                yield "MARK", number, number, line, len(line) / 2
    return marks


def test_file_detectors_agree_with_plain_ones_and_survive_a_crash(spark):
    rows = [("a", "x\nTODO 1\nTODO 22", 1), ("b", "TODO 3\ncrash", 2), ("c", None, 3), (None, "FIX", 4), ("d", "", 5), ("a", "TODO 4", 6)]
    files = spark.createDataFrame(rows, "path string, text string, message int")
    found = table_detectors.per_file(files, file_detector(), "half double")
    assert found.columns == ["path", "rule_id", "line_start", "line_end", "message", "half", "degraded"]
    hits = [tuple(row)[:6] for row in found.filter("degraded IS NULL").collect()]
    assert sorted(hits) == [("a", "MARK", 1, 1, "TODO 4", 3.0), ("a", "MARK", 2, 2, "TODO 1", 3.0), ("a", "MARK", 3, 3, "TODO 22", 3.5)]
    lost = {row["path"]: row["degraded"] for row in found.filter("degraded IS NOT NULL").collect()}
    assert lost.keys() == {"b", "c"} and lost["b"] == "ValueError: cannot read" and lost["c"].startswith("AttributeError")
    marks = file_detector()
    plain = detectors.per_file(files.filter("path IN ('a', 'd')"), lambda path, text: (hit[:4] for hit in marks(path, text)), axiom=3)
    assert sorted((row["path"], row["line_start"]) for row in plain.collect()) == sorted((hit[0], hit[2]) for hit in hits)
    assert [row["path"] for row in table_detectors.per_file(files.filter("text = 'FIX'"), file_detector(), "half double", mark="FIX").collect()] == [None]
    assert table_detectors.per_file(files.limit(0), file_detector(), "half double").collect() == []


def test_what_does_not_fit_the_columns_is_an_error_of_the_detector(spark):
    files = spark.createDataFrame([("a", "TODO")], "path string, text string")
    row, = table_detectors.per_file(files, file_detector()).collect()
    assert row["degraded"].startswith("TypeError: no finding") and row["rule_id"] is None
    for more in ("half decimal", "path string", "half", "x int, x int"):
        with pytest.raises(ValueError):
            table_detectors.result_columns(more)


def group_detector():
    class Jumps:
        """Values that are smaller than the one before, and how many rows there were."""

        def __init__(self):
            self.last, self.n = None, 0

        def row(self, row):
            self.n += 1
            if row["value"] < 0:
                raise ValueError("negative")
            if self.last is not None and row["value"] < self.last:
                yield "DOWN", row["at"], row["at"], None, row["value"]
            self.last = row["value"]

        def end(self):
            yield "ROWS", None, None, None, self.n
    return Jumps


def test_group_detectors_see_rows_in_order(spark):
    rows = [("a", at, at % 5) for at in range(12)] + [("b", 1, 4), ("b", 2, 3), ("b", 3, -1), ("b", 4, 1), (None, 1, 1)]
    table = spark.createDataFrame(rows, "zone string, at int, value int").repartition(5)
    found = table_detectors.per_group(table, group_detector(), "zone", ["at"], "value int")
    assert found.columns[0] == "zone"
    got = sorted(((row["zone"] or "", row["rule_id"], row["line_start"], row["value"], row["degraded"]) for row in found.collect()), key=str)
    assert got == sorted([("a", "DOWN", 5, 0, None), ("a", "DOWN", 10, 0, None), ("a", "ROWS", None, 12, None), ("b", "DOWN", 2, 3, None),
                          ("b", None, None, None, "ValueError: negative"), ("", "ROWS", None, 1, None)], key=str)
    assert table_detectors.per_group(table.limit(0), group_detector(), "zone", ["at"], "value int").collect() == []
