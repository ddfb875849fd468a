"""User-defined detectors, rules and scores."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FINDING
from .rules import as_findings

Detector = Callable[[DataFrame, dict], DataFrame]


class Registry:
    """Detectors by id.  A detector takes (changed files, context tables) and returns findings."""

    def __init__(self):
        self._detectors: dict[str, Detector] = {}

    def register(self, detector: Detector, detector_id: str | None = None, replaces: str | None = None) -> str:
        """Add a detector; ``replaces`` drops another one, with a warning."""
        name = detector_id or detector.__name__
        if replaces is not None:
            if replaces not in self._detectors:
                raise KeyError(f"no detector {replaces} to replace")
            warnings.warn(f"detector {replaces} is replaced by {name}", stacklevel=2)
            del self._detectors[replaces]
        elif name in self._detectors:
            raise ValueError(f"detector {name} exists; say replaces={name!r} to replace it")
        self._detectors[name] = detector
        return name

    def ids(self) -> list[str]:
        return sorted(self._detectors)

    def run(self, change: DataFrame, context: dict | None = None) -> DataFrame:
        """Findings of all detectors; each output must have the finding record's columns and types."""
        outputs = []
        for name in self.ids():
            found = self._detectors[name](change, context or {})
            types = {f.name: f.dataType for f in found.schema.fields}
            bad = [f.name for f in FINDING.fields if types.get(f.name) != f.dataType]
            if bad:
                raise TypeError(f"detector {name} returns no valid findings: {', '.join(bad)}")
            outputs.append(found.select(*FINDING.fieldNames()).withColumn("detector", F.lit(name)))
        return reduce(DataFrame.unionByName, outputs)


PER_FILE = "path string, rule_id string, line_start int, line_end int, message string"


def per_file(files: DataFrame, detect: Callable[[str, str], Iterator[tuple[str, int, int, str]]], axiom: int,
             severity: str = "warning", run_id: str | None = None) -> DataFrame:
    """Findings of a Python function called once per file with (path, text).

    It yields (rule_id, line_start, line_end, message).  Files travel in Arrow batches; no file meets
    another, so nothing is shuffled.
    """
    def batches(frames):
        for frame in frames:
            rows = [(path, *hit) for path, text in zip(frame["path"], frame["text"]) for hit in detect(path, text)]
            yield pd.DataFrame(rows, columns=["path", "rule_id", "line_start", "line_end", "message"])
    hits = files.select("path", "text").mapInPandas(batches, PER_FILE)
    return as_findings(hits, run_id=run_id, axiom=axiom, severity=severity, source="agg")


def custom_score(findings: DataFrame, score: Callable[[pd.DataFrame], float], by: str = "axiom") -> DataFrame:
    """(axiom, score) from a Python function over the axis' counts (rule_id, severity, n).

    The counts are made by Spark first, so the function sees one row per rule and severity and never
    the findings themselves.
    """
    counts = findings.groupBy(by, "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [frame[by].iloc[0]], "score": [float(score(frame))]})
    kind = counts.schema[by].dataType.simpleString()
    return counts.groupBy(by).applyInPandas(one, f"{by} {kind}, score double")
