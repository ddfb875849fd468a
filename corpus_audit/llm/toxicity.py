"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models are counted over all labelled learning rows, one of the toxic and one of the ordinary texts.  A bigram's
discounted count in its class backs off to the class's word model.  The word model uses Kneser-Ney continuation counts
(the number of different words a word follows in its class), which a thousand copies of a text do not raise, and backs
off to continuation counts that both classes share.  The shared part also holds ``FLOOR`` pseudo counts per expression in
either class.  A log-ratio counts only as far as it exceeds ``CERTAINTY`` standard errors of the counts behind it: a
bigram's beyond that of its second word, a word's beyond zero.  So an expression that is rare in both classes says nothing.
A text's evidence is the difference of both log-likelihoods divided by its length.  A logistic curve, fitted to one of
``CALIBRATION`` learning rows, whose texts were left out of the counts, turns the evidence into a probability.

Bigrams below ``MIN_COUNT`` occurrences have no entry of their own and are priced by back-off, as is usual for such
models; they count in full in all totals and continuation counts.

The finished model is a table of log-ratios.  Up to ``BROADCAST_ENTRIES`` it is sent to the tasks as sorted arrays, a
larger one is joined; both ways add up the same numbers.

Defined cases: null and empty texts have no evidence and get the score of evidence zero; unlabelled rows and rows
without doc_id are scored, never learned from; repeated labels of a doc_id count as often as they stand there; without
learning rows of both classes every score is the share of toxic rows among those there are (0 if there are none); an
empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import fold
from .storage import stored

DISCOUNT = 0.75
FLOOR = 1.0
CERTAINTY = 2.0
MIN_COUNT = 2
CALIBRATION = 5
BROADCAST_ENTRIES = 2_000_000
BROADCAST_LABELS = 1_000_000
START, END = 0, 1
# ASCII characters as they count in words: letters in lower case, any digit as 0, all others end a word.
SHAPES = bytes(byte + 32 if 65 <= byte <= 90 else 48 if 48 <= byte <= 57 else byte if 97 <= byte <= 122 or byte > 127 else 32
               for byte in range(256))
LOW = np.uint64(0xFFFFFFFF)


def word_ids(text: str | None) -> np.ndarray:
    """The 32-bit hashes of a text's words between START and END; empty if there is no word."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(SHAPES).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = np.empty(len(words) + 2, dtype=np.uint64)
    ids[0], ids[-1] = START, END
    ids[1:-1] = np.maximum(np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)), 2)
    return ids


def bigrams(ids: np.ndarray) -> np.ndarray:
    """Each word with the word before it, as one 64-bit key."""
    return (ids[:-1] << np.uint64(32)) | ids[1:]


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(key, n0, n1): ordinary and toxic occurrences of every bigram."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, part in batch.groupby("toxic"):
                keys = [bigrams(ids) for ids in map(word_ids, part["text"]) if len(ids)]
                if keys:
                    found, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pd.DataFrame({"key": found.view(np.int64), "n0": 0 if toxic else n, "n1": n if toxic else 0})
    counted = rows.mapInPandas(count, "key long, n0 long, n1 long")
    return counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


WORDS = ("n0", "n1", "types0", "types1", "types")


def _split(pairs: DataFrame) -> DataFrame:
    """Kept bigrams (``types`` is null) and, for each task, words with their counts and continuations by class."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts = [], []
        for batch in batches:
            keys, low, high = (batch[name].to_numpy(np.int64) for name in ("key", "n0", "n1"))
            kept = low + high >= MIN_COUNT
            empty = pd.array([None] * int(kept.sum()), dtype="Int64")
            yield pd.DataFrame({"key": keys[kept], "n0": low[kept], "n1": high[kept], "types0": empty, "types1": empty,
                                "types": empty})
            words.append((keys.view(np.uint64) & LOW).astype(np.uint32))
            counts.append(np.stack([low, high]))
        if words:
            found, place, types = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            both = np.concatenate(counts, axis=1)
            total = lambda weights: np.bincount(place, weights=weights, minlength=len(found)).astype(np.int64)
            yield pd.DataFrame({"key": found.astype(np.int64), "n0": total(both[0]), "n1": total(both[1]),
                                "types0": pd.array(total(both[0] > 0), dtype="Int64"),
                                "types1": pd.array(total(both[1] > 0), dtype="Int64"),
                                "types": pd.array(types, dtype="Int64")})
    return pairs.mapInPandas(cut, "key long, " + ", ".join(f"{name} long" for name in WORDS))


def _left(count: Column) -> Column:
    return F.greatest(count - DISCOUNT, F.lit(0.0))


def _certain(ratio: Column, toxic: Column, ordinary: Column) -> Column:
    """The part of a log-ratio beyond the standard errors that go with its effective counts."""
    margin = F.lit(CERTAINTY) * F.sqrt(1 / toxic + 1 / ordinary)
    return F.signum(ratio) * F.greatest(F.abs(ratio) - margin, F.lit(0.0))


def log_ratios(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The model of rows (text, toxic): bigrams (key, value) and words (key, value).

    A bigram of the table adds its ``value``, any other the ``value`` of its second word, if that has one.  Entries that
    would change nothing are left out, and these are nearly all: rare expressions have no certain ratio.
    """
    counted = stored(_split(_pair_counts(rows)), "toxicity-counts")
    words = stored(counted.filter("types IS NOT NULL").groupBy("key").agg(*[F.sum(n).alias(n) for n in WORDS]),
                   "toxicity-words")
    total = words.agg(F.count(F.lit(1)).alias("words"), *[F.sum(name).alias(name) for name in WORDS]).first()
    if not total["n0"] or not total["n1"]:
        return None
    all_types = float(total["types"])
    shared = (F.col("types") * F.lit(DISCOUNT * total["words"] / all_types) + FLOOR) / all_types
    price = lambda types, of: _left(F.col(types)) / F.lit(float(of)) + shared
    priced = words.select("key", price("types0", total["types0"]).alias("p0"), price("types1", total["types1"]).alias("p1"),
                          price("types", all_types).alias("p"))
    priced = priced.withColumn("value", _certain(F.log(F.col("p1") / F.col("p0")), F.col("p1") * float(total["types1"]),
                                                 F.col("p0") * float(total["types0"])))
    # START comes before as many words as END follows.
    ends = words.filter(F.col("key") == END).first()
    opening = rows.sparkSession.createDataFrame([(START, ends["n0"], ends["n1"])], "before long, h0 long, h1 long")
    history = words.select(F.col("key").alias("before"), F.col("n0").alias("h0"), F.col("n1").alias("h1")).unionByName(opening)
    pairs = counted.filter("types IS NULL").select(
        "key", F.shiftrightunsigned("key", 32).alias("before"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("word"),
        F.col("n0").alias("c0"), F.col("n1").alias("c1"))
    chance = [_left(F.col(f"c{c}")) / F.col(f"h{c}")
              + F.lit(FLOOR) / (F.col("h0") + F.col("h1")) * F.col(f"p{c}") / F.col("p") for c in (0, 1)]
    beyond = _certain(F.log(chance[1] / chance[0]) - F.col("value"), chance[1] * F.col("h1"), chance[0] * F.col("h0"))
    # A history that one class has not seen tells nothing about the words after it.
    kept = (pairs.join(priced.withColumnRenamed("key", "word"), "word")
            .join(history.filter("h0 > 0 AND h1 > 0"), "before")
            .withColumn("beyond", beyond).filter("beyond <> 0").select("key", (F.col("value") + F.col("beyond")).alias("value")))
    return stored(kept, "toxicity-bigrams"), stored(priced.filter("value <> 0").select("key", "value"), "toxicity-ratios")


class _Table:
    """Values by sorted key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def values_of(self, wanted: np.ndarray, default: np.ndarray) -> np.ndarray:
        """The value of each key, or its default."""
        if not len(self.keys):
            return default
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], default)


def _evidence_by_arrays(rows: DataFrame, kept: DataFrame, words: DataFrame) -> DataFrame:
    pairs, single = kept.toPandas(), words.toPandas()
    model = rows.sparkSession.sparkContext.broadcast((
        _Table(pairs["key"].to_numpy(np.int64).view(np.uint64), pairs["value"].to_numpy()),
        _Table(single["key"].to_numpy(np.uint32), single["value"].to_numpy())))
    del pairs, single

    def weigh(text: str | None) -> float:
        ids = word_ids(text)
        if not len(ids):
            return 0.0
        bigram, word = model.value
        backed = word.values_of(ids[1:].astype(np.uint32), np.zeros(len(ids) - 1, dtype=np.float32))
        return float(bigram.values_of(bigrams(ids), backed).astype(np.float64).mean())

    @F.pandas_udf("double")
    def weighed(texts: pd.Series) -> pd.Series:
        return pd.Series([weigh(text) for text in texts], dtype="float64")
    return rows.withColumn("evidence", weighed("text"))


def _evidence_by_join(rows: DataFrame, kept: DataFrame, words: DataFrame) -> DataFrame:
    """The same sums with the model as a table: every different bigram of a text meets its entries."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                keys, n = np.unique(bigrams(word_ids(text)), return_counts=True)
                yield pd.DataFrame({"row": row, "key": keys.view(np.int64), "n": n})

    found = rows.select("row", "text").mapInPandas(cut, "row long, key long, n long")
    found = (found.withColumn("word", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
             .join(kept.withColumnRenamed("value", "own"), "key", "left")
             .join(words.select(F.col("key").alias("word"), "value"), "word", "left"))
    each = F.coalesce(F.col("own").cast("float"), F.col("value").cast("float"), F.lit(0.0)).cast("double")
    sums = found.groupBy("row").agg((F.sum(each * F.col("n")) / F.sum("n")).alias("evidence"))
    return rows.join(sums, "row", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0.0))).drop("row")


def evidence(rows: DataFrame, kept: DataFrame, words: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """``rows`` with the evidence of their column ``text``."""
    by = _evidence_by_arrays if kept.count() + words.count() <= broadcast_entries else _evidence_by_join
    return by(rows, kept, words)


def _fit_logistic(x: np.ndarray, targets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Damped Newton steps with a weak pull of the slope to zero; ``x`` has a column of ones."""
    w, pull = start.copy(), np.diag([0.01, 1e-6])
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (chance * (1 - chance))[:, None]).T @ x + pull + 1e-9 * np.eye(2)
        step = np.clip(np.linalg.solve(bend, x.T @ (chance - targets) + pull @ w), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_curve(points: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Base, slope and offset of ``base + (1 - base) * logistic(slope * evidence + offset)``.

    The base is the share of toxic labels that no evidence explains.  It is found by expectation maximisation: each toxic
    label is split between base and curve, and the curve is fitted to its part.
    """
    scale = points.std() or 1.0
    x = np.column_stack([points / scale, np.ones(len(points))])
    w, base = _fit_logistic(x, labels, np.zeros(2)), 0.5 * labels.mean()
    for _ in range(60):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        explained = labels * chance / np.maximum(base + (1 - base) * chance, 1e-12)
        base = float((labels - explained).sum() / max((1 - explained).sum(), 1e-12))
        w = _fit_logistic(x, explained, w)
    return base, float(w[0] / scale), float(w[1])


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(text, toxic, aside) of the rows that have a label."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("label_id"), (F.col(label) == 1).cast("int").alias("toxic"))
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    aside = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(CALIBRATION)) == 0
    return rows.join(known, F.col("doc_id") == F.col("label_id")).select("text", "toxic", aside.alias("aside"))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
           folds: int = 3, held_out_fold: int = 1, threshold: float = 0.7, calibration_docs: int = 20_000,
           broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, learned from the folds that are not held out.

    The curve has three parameters and is fitted to at most about ``calibration_docs`` rows, drawn by hash.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    learning = labelled(rows.filter(fold("doc_id", folds) != held_out_fold), labels, doc_id, label)
    model = log_ratios(learning.filter(~F.col("aside")))
    if model is None:
        share = learning.agg(F.avg("toxic")).first()[0]
        score = F.lit(float(share or 0.0))
        judged = rows
    else:
        aside = learning.filter("aside")
        wanted = min(1.0, calibration_docs / max(1, aside.count()))
        drawn = aside.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= wanted * (1 << 30))
        points = evidence(drawn, *model, broadcast_entries).select("evidence", "toxic").toPandas()
        points = points.sort_values(["evidence", "toxic"])
        base, slope, offset = fit_curve(points["evidence"].to_numpy(float), points["toxic"].to_numpy(float))
        judged = evidence(rows, *model, broadcast_entries)
        score = base + (1 - base) / (1 + F.exp(-(F.col("evidence") * slope + offset)))
    held_out = F.coalesce(fold("doc_id", folds) == held_out_fold, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
