"""Quality rules judged per document and per host.

Every document is measured on its own.  The failures of each rule are then counted by host, the rate of each host is
shrunk towards the rate of all documents with a beta prior fitted by the moments of a beta-binomial, and a host
whose shrunk rate of any rule is above ``max_rate`` is turned down together with its documents.  A host with few
documents thus stays close to the common rate, a host with many stands for itself.

Defined cases: a null text has no words and fails as too short; a null host has no verdict, its documents are judged by
their own text alone; an empty table gives an empty result; repeated rows count once each, as rows.  Only the named
columns are read, so further columns may have any name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
MIN_WEIGHT = 2.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, repeated = set(), set()
    for window in windows:
        (repeated if window in seen else seen).add(window)
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        if window in repeated:
            covered[at:at + 3] = b"\1\1\1"
    return sum(covered)


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measure(text: str | None) -> tuple:
    """The five measures of one text, in the order of ``MEASURES``."""
    if not text:
        return (0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            _repeated_lines(text), _repeated_words(words))


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(text) for text in texts], columns=list(MEASURES), dtype="int64")


def rules() -> dict[str, Column]:
    """Each rule is true where a measured document fails it; the first two make the base verdict."""
    return {
        "short": F.col("n_words") < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > F.col("n_words"),
    }


def prior(hosts: int, docs: int | None, squares: float | None, failures: int | None, own: float | None) -> tuple[float, float | None]:
    """Mean and weight of the prior; no weight means that hosts do not differ beyond chance.

    ``squares`` sums the squared sizes of the hosts, ``own`` the squared failures of each over its size.
    """
    if not docs:
        return 0.0, None
    mean, free = failures / docs, hosts - 1
    room = docs - squares / docs - free
    if not 0 < mean < 1 or room < 1e-9:
        return mean, None
    alike = ((own - failures * mean) / (mean * (1 - mean)) - free) / room
    return mean, None if alike < 1e-9 else max(1 / alike - 1, MIN_WEIGHT)


def host_verdicts(measured: DataFrame, max_rate: float = 0.75) -> DataFrame:
    """(host, n_docs, rate_<rule>..., host_failed): shrunk failure rates of every host.

    The prior of a rule has the mean of all documents.  Its weight comes from the spread of the hosts' rates beyond what hosts of
    their sizes show by chance, and is ``MIN_WEIGHT`` documents at least, so a host of one document stays near the common rate.
    Hosts that do not differ beyond chance, hosts of one document each or a single host all get the common rate.
    """
    names = list(rules())
    hosts = (measured.filter("host IS NOT NULL").groupBy("host")
             .agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(rule).alias(name) for name, rule in rules().items()]))
    hosts = stored(hosts, "hosts")
    size = F.col("n_docs").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(size * size).alias("squares"),
                     *[F.sum(name).alias(f"sum_{name}") for name in names],
                     *[F.sum(F.col(name).cast("double") * F.col(name) / size).alias(f"own_{name}") for name in names]).first()
    for name in names:
        mean, weight = prior(sums["hosts"], sums["docs"], sums["squares"], sums[f"sum_{name}"], sums[f"own_{name}"])
        rate = F.lit(mean) if weight is None else (F.col(name) + mean * weight) / (F.col("n_docs") + weight)
        hosts = hosts.withColumn(f"rate_{name}", F.round(rate, 6))
    failed = F.greatest(*[F.col(f"rate_{name}") for name in names]) > max_rate
    return hosts.select("host", "n_docs", *[f"rate_{name}" for name in names], failed.alias("host_failed"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple = ("doc_id",),
           max_rate: float = 0.75) -> DataFrame:
    """``keep`` columns, the measures, base_failed, the host's verdict and ``kept`` for every row of ``docs``.

    Measures are written once to the shared folder; only those narrow rows meet the verdicts, and adaptive execution
    splits a hot host.
    """
    own = docs.select(*[F.col(name).alias(f"_{name}") for name in keep], F.col(host).alias("host"),
                      measures(F.col(text)).alias("m"))
    base = rules()
    measured = own.select(*[f"_{name}" for name in keep], "host", "m.*").withColumn(
        "base_failed", base["short"] | base["repetitive"])
    measured = stored(measured, "measures")
    turned_down = host_verdicts(measured, max_rate).filter("host_failed").select("host", "host_failed")
    return (measured.join(turned_down, "host", "left")
            .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
            .select(*[F.col(f"_{name}").alias(name) for name in keep], *MEASURES, "base_failed", "host_failed",
                    (~F.col("base_failed") & ~F.col("host_failed")).alias("kept")))
