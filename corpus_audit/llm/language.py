"""Language identification with a sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams of one to three characters of the whole lower-case text (everything that is no letter counts as
a blank), hashed into ``DIMENSIONS`` places.  Document frequencies cover all learning documents.  The weights are fitted
with follow-the-regularised-leader (FTRL-proximal) steps under an elastic-net penalty on a sample of learning documents
that is bounded by ``sample_docs``, spread evenly over the languages and drawn by a hash of doc_id; a fifth of it is set
aside to fit the temperature that calibrates the probabilities.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without lang or without doc_id are never
learned from and are predicted like all others; without any learning row every prediction is ``und``; repeated rows are
learned and predicted once each; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

DIMENSIONS = 1 << 13
UNKNOWN = "und"
STEP, SMOOTH, L1, L2, EPOCHS = 2.0, 1.0, 0.02, 0.01, 4
STRETCH = 1 << 20
FEATURES = T.StructType([T.StructField("lang", T.StringType()), T.StructField("turn", T.LongType()),
                         T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType())])
GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(point).isalpha() for point in range(0x110000)])
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and counts of the n-grams of one text; None if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letter_table()[points]
    if not letter.any():
        return None
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint32)
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for start in range(0, len(points), STRETCH):
        part = points[start:start + STRETCH + 2]
        for size in (1, 2, 3):
            n = min(STRETCH, len(points) - start, len(part) - size + 1)
            mixed = np.full(max(n, 0), size, dtype=np.uint32)
            for at in range(size):
                mixed = mixed * np.uint32(0x01000193) + part[at:at + len(mixed)]
                mixed ^= mixed >> np.uint32(15)
            counts += np.bincount((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=DIMENSIONS)
    places = np.flatnonzero(counts)
    return places, counts[places]


@dataclass
class Model:
    """Weights by place and language, inverse document frequencies and the temperature."""

    langs: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS, 0)))
    temperature: float = 1.0

    def values(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        found = np.log1p(counts) * self.idf[places]
        return found / max(np.sqrt(found @ found), 1e-12)

    def logits(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.values(places, counts) @ self.weights[places]


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def fit_weights(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """FTRL-proximal with elastic net: a weight stays exactly zero until its gradient sum passes the L1 bound."""
    z = np.zeros((DIMENSIONS, len(model.langs)))
    squares = np.zeros_like(z)

    def solved(at):
        kept = np.abs(z[at]) > L1
        return np.where(kept, -(z[at] - np.sign(z[at]) * L1) / ((SMOOTH + np.sqrt(squares[at])) / STEP + L2), 0.0)

    for _ in range(EPOCHS):
        for label, places, counts in rows:
            values, now = model.values(places, counts), solved(places)
            error = _softmax(values @ now)
            error[label] -= 1
            slope = np.outer(values, error)
            rise = (np.sqrt(squares[places] + slope ** 2) - np.sqrt(squares[places])) / STEP
            z[places] += slope - rise * now
            squares[places] += slope ** 2
    model.weights = solved(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(power: float) -> float:
        chances = _softmax(logits / np.exp(power))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(chances, 1e-12)).mean()

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(rows: DataFrame, sample_docs: int = 4000) -> Model:
    """Fit a model to rows of (text, lang, turn); ``turn`` is a non-negative hash of the document below 2**31."""
    per_lang = {row["lang"]: row["n"] for row in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_lang:
        return Model()
    share = sample_docs / len(per_lang)
    below = F.create_map(*[F.lit(x) for lang, n in per_lang.items() for x in (lang, min(1.0, share / n) * 2 ** 31)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            out = []
            for text, lang, turn, wanted in zip(batch["text"], batch["lang"], batch["turn"], batch["wanted"]):
                found = features(text)
                if found is not None:
                    seen[found[0]] += 1
                    n += 1
                    if wanted:
                        out.append((lang, turn, found[0].astype("<i4").tobytes(), found[1].astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=FEATURES.fieldNames()).astype({"turn": "int64"})
        # One row per task with its document frequencies, marked by a null language.
        yield pd.DataFrame({"lang": [None], "turn": [n], "places": [seen.astype("<i8").tobytes()], "counts": [b""]})

    marked = rows.withColumn("wanted", F.col("turn") < below[F.col("lang")])
    counted = stored(marked.mapInPandas(count, FEATURES), "language-features")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, seen in zip(batch["turn"], batch["places"]):
                yield pd.DataFrame({"place": np.arange(DIMENSIONS + 1), "n": np.append(np.frombuffer(seen, "<i8"), n)})

    totals = (counted.filter("lang IS NULL").mapInPandas(pieces, "place int, n long")
              .groupBy("place").agg(F.sum("n").alias("n")).toPandas().sort_values("place")["n"].to_numpy())
    sample = counted.filter("lang IS NOT NULL").toPandas().sort_values(["turn", "lang", "places"])
    model = Model(sorted(per_lang))
    model.idf = np.log((1 + totals[-1]) / (1 + totals[:-1])) + 1
    label = {lang: at for at, lang in enumerate(model.langs)}
    drawn = [(label[lang], np.frombuffer(places, "<i4"), np.frombuffer(counts, "<i4"))
             for lang, places, counts in zip(sample["lang"], sample["places"], sample["counts"])]
    fit_weights(model, [row for at, row in enumerate(drawn) if at % 5])
    aside = drawn[::5]
    logits = np.array([model.logits(places, counts) for _, places, counts in aside]).reshape(len(aside), len(model.langs))
    model.temperature = fit_temperature(logits, np.array([at for at, _, _ in aside], dtype=int))
    return model


def predicted(model: Model, text: Column, spark) -> Column:
    """(lang_pred, score) of each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(GUESS)
    def guess(texts: pd.Series) -> pd.DataFrame:
        known, out = shared.value, []
        for words in texts:
            found = features(words) if known.langs else None
            if found is None:
                out.append((UNKNOWN, 0.0))
            else:
                chances = _softmax(known.logits(*found) / known.temperature)
                best = int(chances.argmax())
                out.append((known.langs[best], float(chances[best])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])
    return guess(text)


def fold(doc_id: str, parts: int) -> Column:
    """The document's fold: the CRC-32 of its id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 5,
               held_out_fold: int = 0, sample_docs: int = 4000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the folds that are not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    turn = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(2 ** 31))
    learning = rows.filter((fold("doc_id", folds) != held_out_fold) & F.col("lang").isNotNull()).select(
        "text", "lang", turn.alias("turn"))
    guess = predicted(learn(learning, sample_docs), F.col("text"), docs.sparkSession)
    return (rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out_fold, F.lit(False)).alias("held_out"),
                        guess.alias("g")).select("doc_id", "held_out", "g.lang_pred", "g.score"))
