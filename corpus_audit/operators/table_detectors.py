"""User-defined detectors as table functions: a table goes in, findings come out, in columns the arguments ask for.

A file detector is a function called as ``detect(path, text, **options)``; it yields (rule_id, line_start, line_end, message,
*more).  Files lie as they are, nothing is shuffled.  A group detector is a class made anew for every group; its
``row(row)`` sees the group's rows one by one in order and its ``end()`` comes last, both yield the same tuples without a
path.  The group is partitioned and sorted by Spark and streams through, so the detector holds only what it keeps itself.

``more`` names further columns as "name type, ..."; the schema of the result follows when the query is analysed.

Defined cases: a detector that raises leaves one row with ``degraded`` (the error's type and text) and without rule, and
other files and groups go on; of a file nothing else is returned, of a group what it yielded before stays and its further
rows are not looked at.  Rows that do not fit the columns count as an error of the detector.  Null paths, texts and groups
reach the detector as None; further columns of the table are not passed to file detectors; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult

TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
HIT = [("rule_id", "string"), ("line_start", "int"), ("line_end", "int"), ("message", "string")]


def result_columns(more: str) -> list[tuple[str, str]]:
    """Names and types of what a detector yields."""
    asked = [tuple(part.split()) for part in (more or "").split(",") if part.strip()]
    taken = [name for name, _ in HIT] + ["path", "degraded"]
    for column in asked:
        if len(column) != 2 or column[1] not in TYPES or column[0] in taken:
            raise ValueError(f"no further column: {' '.join(column)}; types are {', '.join(TYPES)}")
        taken.append(column[0])
    return HIT + asked


def _schema(keys: Iterable[T.StructField], more: str) -> T.StructType:
    own = [T.StructField(name, TYPES[kind]) for name, kind in result_columns(more)]
    return T.StructType([*keys, *own, T.StructField("degraded", T.StringType())])


def _fitting(hit: tuple, kinds: list[str]) -> tuple:
    """The hit itself, if every value is of its column's type."""
    python = {"string": str, "int": int, "bigint": int, "double": (int, float), "boolean": bool}
    if len(hit) != len(kinds) or not all(value is None or isinstance(value, python[kind]) for value, kind in zip(hit, kinds)):
        raise TypeError(f"no finding: {hit!r}")
    return tuple(float(value) if kind == "double" and value is not None else value for value, kind in zip(hit, kinds))


def _degraded(error: Exception, n: int) -> tuple:
    return (*[None] * n, f"{type(error).__name__}: {error}")


def per_file(files: DataFrame, detect: Callable, more: str = "", **options) -> DataFrame:
    """(path, rule_id, line_start, line_end, message, *more, degraded) of every file of ``files(path, text)``."""
    class Detector:
        @staticmethod
        def analyze(files, more):
            path, = (field for field in files.dataType.fields if field.name == "path")
            return AnalyzeResult(schema=_schema([T.StructField("path", path.dataType)], more.value))

        def eval(self, row, more):
            kinds = [kind for _, kind in result_columns(more)]
            try:
                hits = [_fitting(hit, kinds) for hit in detect(row["path"], row["text"], **options)]
            except Exception as error:  # noqa: BLE001
                yield row["path"], *_degraded(error, len(kinds))
            else:
                for hit in hits:
                    yield row["path"], *hit, None
    return F.udtf(Detector)(files.select("path", "text").asTable(), F.lit(more))


def per_group(table: DataFrame, detector: type, by: str, order: list[str], more: str = "") -> DataFrame:
    """(by, rule_id, line_start, line_end, message, *more, degraded) of every group of ``table``.

    A group is one task's work; a key that holds a large part of all rows should be split by a finer key.
    """
    class Detector:
        def __init__(self):
            self.own, self.key, self.failed, self.kinds = None, None, False, None

        @staticmethod
        def analyze(table, more, by):
            key, = (field for field in table.dataType.fields if field.name == by.value)
            return AnalyzeResult(schema=_schema([T.StructField(by.value, key.dataType)], more.value))

        def _taken(self, hits):
            try:
                for hit in hits():
                    yield self.key, *_fitting(hit, self.kinds), None
            except Exception as error:  # noqa: BLE001
                self.failed = True
                yield self.key, *_degraded(error, len(self.kinds))

        def eval(self, row, more, by):
            if self.kinds is None:
                self.key, self.kinds = row[by], [kind for _, kind in result_columns(more)]
            if not self.failed:
                yield from self._taken(lambda: self._row(row))

        def _row(self, row):
            if self.own is None:
                self.own = detector()
            return self.own.row(row) or ()

        def terminate(self):
            if self.own is not None and not self.failed:
                yield from self._taken(lambda: self.own.end() or ())
    return F.udtf(Detector)(table.asTable().partitionBy(by).orderBy(*order), F.lit(more), F.lit(by))
