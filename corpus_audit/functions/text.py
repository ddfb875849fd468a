"""Column expressions over one file's text.

A file is one row, so everything that looks at neighbouring lines works on the row's own line
array: no shuffle, no window, and the task that read the file also scans it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_COMMENT = r"(^|[ \t])//.*$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    """All lines of a text, a trailing empty line included."""
    return F.split(text, "\n", -1)


def strip_comment(line: Column) -> Column:
    return F.when(line.contains("//"), F.regexp_replace(line, LINE_COMMENT, "")).otherwise(line)


def squeeze(line: Column) -> Column:
    """Whitespace-normalised line: the context that survives re-indentation."""
    return F.trim(F.regexp_replace(line, r"[ \t\r]+", " "))


def squeeze_all(text: Column) -> Column:
    """Like :func:`squeeze`, for a text of several lines."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def numbered(lines: Column) -> Column:
    """Array of (line_no, line), 1-based."""
    return F.transform(lines, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))


def positions(lines: Column, predicate) -> Column:
    """1-based numbers of the lines that satisfy ``predicate``."""
    marked = F.transform(lines, lambda line, i: F.when(predicate(line), i + 1))
    return F.filter(marked, lambda n: n.isNotNull())


def runs_of(lines: Column, predicate, min_run: int) -> Column:
    """Maximal runs of at least ``min_run`` lines satisfying ``predicate``.

    The lines that do not satisfy it are separators; a run lies between two neighbouring
    separators that are far enough apart.
    """
    breaks = F.concat(F.array(F.lit(0)), positions(lines, lambda line: ~predicate(line)),
                      F.array(F.size(lines) + 1))
    gaps = let(breaks, lambda at: F.zip_with(
        F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1),
        lambda a, b: F.struct((a + 1).alias("line_start"), (b - 1).alias("line_end"))))
    return F.filter(gaps, lambda g: g.line_end - g.line_start + 1 >= min_run)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}0-9]+", -1), lambda w: w != "")


def hash32(value: Column) -> Column:
    """32-bit hash taken from md5, so that any SQL engine can state the same value."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def hash60(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def joined_path(base_dir: Column, relative: Column) -> Column:
    """Resolve ``.`` and ``..`` of ``relative`` against ``base_dir``."""
    parts = F.split(F.concat_ws("/", base_dir, relative), "/", -1)
    folded = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))))
    return F.array_join(folded, "/")
