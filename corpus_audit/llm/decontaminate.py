"""Benchmark decontamination by templates, so that re-parameterised questions are caught as well.

Every text becomes a row of template tokens: lower-case words, with numbers, units behind numbers and names
(capitalised inside a sentence) replaced by typed placeholders whose values are kept as slots.  Windows of ``WINDOW``
template tokens of the benchmark are hash-joined with those of the documents.  Windows that meet on one diagonal (the
same shift between document and item) must fill the item's slots consistently: one value of the item always stands for
one value of the document and the other way round.  A document leaks an item if the windows of consistent diagonals cover
``MIN_COVER`` of the item's comparable windows, or ``MIN_RUN`` windows of one diagonal match.

Items that templates say too little about are searched word for word: those that are shorter than a window, mostly
placeholders (fewer than ``MIN_COMPARABLE`` comparable windows, and less than half of all), or in a script without blanks,
where the edges of a copy run into the text around it.  Their literal tokens are words, numbers, signs of arithmetic and
single characters of such scripts.  An item of up to ``EXACT`` literal tokens is one window; a longer one is two windows of
a power of two, from its start and up to its end, which must meet on one diagonal.  So there are few window lengths.

A bitmap of fixed size (2 MB) with the hashes of all benchmark windows goes to the tasks that read documents; only windows
that pass it are emitted, and the join decides.  A large benchmark fills the bitmap and so only costs speed.

Defined cases: null and empty texts have no windows; a window with fewer than two plain words is not compared, since
placeholders alone say nothing; an item whose literal tokens weigh less than ``MIN_WEIGHT`` (a character 1, others 2) is too
little to tell from chance and is not searched word for word; repeated items are found
each under its own id, repeated rows of a document give one result; rows that share a doc_id (or an item_id) but not a text are
compared one by one and the best result of the id is returned, those without an id under null;
an empty table on either side gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

WINDOW = 5
MIN_COVER = 0.5
MIN_RUN = 9
MIN_COMPARABLE = 3
MIN_WEIGHT = 6
EXACT = 16
MAP_BITS = 24
BUCKET_BITS = 1 << 15
BROADCAST_WINDOWS = 100_000
KNOWN_TOKENS = 300_000
# Units, as they follow a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t oz lb ml l gal s ms min h hr hrs hour hours day days week weeks month months "
         "year years mph kph kmh km/h hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa b kb mb gb tb usd eur gbp "
         "dollar dollars euro euros pound pounds cent cents percent degrees % € $ £ °c °f").split()
NAME = re.compile(r"(?<=[^\W\d_] |[,;] )[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+\b")
UNIT = re.compile(r"(\d)\s?(" + "|".join(re.escape(unit) for unit in sorted(UNITS, key=len, reverse=True)) + r")(?![^\W_])", re.I)
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|\x02[^ ]+|\x01?[^\W\d_]+")
# Signs of scripts that put no blanks between words: Thai, Lao, Myanmar, Khmer, kana, ideographs.
BLANKLESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
                       "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
LITERAL = re.compile(r"\d+(?:[.,:/]\d+)*|[-+*/^=<>%$€£°±×÷−√∑∫≤≥≠]|" + BLANKLESS.pattern
                     + "|(?:(?!" + BLANKLESS.pattern + r")[^\W\d_])+")
KINDS = {"\x01": "<name>", "\x02": "<unit>"}
WINDOWS = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("content", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("hash", T.LongType()),
    T.StructField("template", T.StringType()), T.StructField("slots", T.ArrayType(T.StringType())),
    T.StructField("n_windows", T.IntegerType()), T.StructField("length", T.IntegerType()),
])


def canonical(token: str) -> str:
    """A token as it stands in a template."""
    return "<num>" if token[0].isdigit() else KINDS.get(token[0], token)


def template_tokens(text: str | None) -> list[str]:
    """Lower-case tokens; names and units carry a mark in front."""
    if not text:
        return []
    text = NAME.sub(lambda found: f"\x01{found[0]}", text.replace("\x01", " ").replace("\x02", " "))
    if any(digit in text for digit in "0123456789"):
        text = UNIT.sub(lambda found: f"{found[1]} \x02{found[2]} ", text)
    return TOKEN.findall(text.lower())


def literal_tokens(text: str | None) -> list[str]:
    """Lower-case tokens as they stand."""
    return LITERAL.findall(text.lower()) if text else []


class _Hashes(dict):
    """Hash of the given form of a token, remembered."""

    def __init__(self, form=canonical) -> None:
        super().__init__()
        self.form = form

    def __missing__(self, token: str) -> int:
        if len(self) > KNOWN_TOKENS:
            self.clear()
        self[token] = found = xxhash.xxh64_intdigest(self.form(token), 7)
        return found


def window_hashes(tokens: list[str], known: _Hashes) -> np.ndarray:
    """One hash for each window of a text."""
    if len(tokens) < WINDOW:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    mixed = np.zeros(len(tokens) - WINDOW + 1, dtype=np.uint64)
    for at in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[at:at + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def literal_hashes(tokens: list[str], lengths: list[int], known: _Hashes) -> Iterator[tuple[int, np.ndarray]]:
    """Each length with one hash for each window of so many tokens, put together from windows of powers of two."""
    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a * np.uint64(0x9E3779B97F4A7C15) + b
        return both ^ (both >> np.uint64(29))

    levels = [np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))]
    for length in lengths:
        n, start, whole = len(tokens) - length + 1, 0, None
        if n < 1:
            continue
        for level in reversed(range(length.bit_length())):
            if length >> level & 1:
                while len(levels) <= level:
                    half = 1 << (len(levels) - 1)
                    levels.append(mixed(levels[-1][:-half], levels[-1][half:]))
                part = levels[level][start:start + n]
                whole = part if whole is None else mixed(whole, part)
                start += 1 << level
        yield length, (whole + np.uint64(length)) * np.uint64(0xBF58476D1CE4E5B9)


def literal_length(n_tokens: int) -> int:
    """How many tokens a literal window of an item has."""
    return n_tokens if n_tokens <= EXACT else 1 << (n_tokens.bit_length() - 1)


def _passing(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of the hashes that are in the bitmap."""
    bit = hashes & np.uint64((1 << MAP_BITS) - 1)
    return np.flatnonzero(wanted[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)


def _by_templates(n_comparable: int, n_windows: int) -> bool:
    """Whether an item has enough comparable windows to be searched by them."""
    return 0 < n_windows and n_comparable >= min(MIN_COMPARABLE, -(-n_windows // 2))


def windows(rows: DataFrame, key: str, text: str, bitmap: bytes | None = None, lengths: list[int] = ()) -> DataFrame:
    """The windows by which each item is searched; with a bitmap the windows of every text whose hash is in it.

    ``length`` is 0 for a template window, else the number of literal tokens; texts are cut into those of ``lengths``.
    ``content`` is the hash of the whole text, which tells rows apart that share a key.
    """
    session = rows.sparkSession
    shared = session.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, literals = _Hashes(), _Hashes(str)
        wanted = None if shared is None else np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            found = []
            for owner, words in zip(batch["key"], batch["text"]):
                owner = None if pd.isna(owner) else int(owner)
                content = xxhash.xxh64_intdigest((words or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                tokens = template_tokens(words)
                hashes = window_hashes(tokens, known)
                places = range(len(hashes)) if wanted is None else _passing(hashes, wanted)
                own = []
                for at in places:
                    forms = [canonical(token) for token in tokens[at:at + WINDOW]]
                    slots = [f"{form}{token}" for form, token in zip(forms, tokens[at:at + WINDOW]) if form != token]
                    if len(slots) <= WINDOW - 2:
                        own.append((int(at), int(hashes[at].view(np.int64)), " ".join(forms), slots))
                cuts = []
                if wanted is not None:
                    if lengths:
                        tokens = literal_tokens(words)
                        cuts = [(length, marks, _passing(marks, wanted)) for length, marks in literal_hashes(tokens, lengths, literals)]
                else:
                    templated = _by_templates(len(own), len(hashes))
                    if not templated or BLANKLESS.search(words):
                        tokens = literal_tokens(words)
                        if sum(1 if BLANKLESS.match(token) else 2 for token in tokens) >= MIN_WEIGHT:
                            cuts = [(length, marks, sorted({0, len(tokens) - length}))
                                    for length, marks in literal_hashes(tokens, [literal_length(len(tokens))], literals)]
                    if not templated:
                        own = []
                found += [(owner, content, *window, len(own), 0) for window in own]
                found += [(owner, content, int(at), int(marks[at].view(np.int64)), " ".join(tokens[at:at + length]), [], len(at_all), length)
                          for length, marks, at_all in cuts for at in at_all]
            frame = pd.DataFrame(found, columns=WINDOWS.fieldNames())
            yield frame.astype({"key": "Int64"})

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(cut, WINDOWS)


def _bitmap(items: DataFrame) -> bytes:
    """All hashes of the benchmark in ``2 ** MAP_BITS`` bits, however many there are."""
    bit = F.col("hash").bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1
    pieces = (items.select(bit.alias("bit"))
              .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())
    whole = bytearray((1 << MAP_BITS) // 8)
    for piece in pieces:
        start = (piece["bucket"] - 1) * BUCKET_BITS // 8
        whole[start:start + BUCKET_BITS // 8] = piece["bits"]
    return bytes(whole)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
          item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage, verbatim) of every item that a document holds."""
    items = stored(windows(benchmark, item_id, item_text), "benchmark-windows")
    n_items = items.count()
    lengths = sorted(row["length"] for row in items.filter("length > 0").select("length").distinct().collect())
    found = windows(docs, doc_id, text, _bitmap(items), lengths).select(
        F.col("key").alias("doc_id"), "content", F.col("pos").alias("doc_pos"), "hash", "template", F.col("slots").alias("doc_slots"), "length")
    side = items.select(F.col("key").alias("item_id"), F.col("content").alias("item_content"), F.col("pos").alias("item_pos"), "hash", "template",
                        F.col("slots").alias("item_slots"), "n_windows", "length")
    met = found.join(F.broadcast(side) if n_items <= BROADCAST_WINDOWS else side, ["hash", "template", "length"])
    met = stored(met.withColumn("shift", F.col("doc_pos") - F.col("item_pos")).drop("hash", "template"), "met-windows")

    literal, met = met.filter("length > 0"), met.filter("length = 0")
    literal = (literal.groupBy("doc_id", "content", "item_id", "item_content", "shift")
               .agg(F.count_distinct("item_pos").alias("n_matched"), F.max("n_windows").alias("n_windows"))
               .filter("n_matched = n_windows").select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(True).alias("verbatim"),
                                                       "n_matched", "n_windows"))

    # A slot value and its counterpart, in both directions, must be one to one on a diagonal, which belongs to
    # two texts: rows that share an id but not a text do not spoil each other.
    diagonal = ["doc_id", "content", "item_id", "item_content", "shift"]
    slots = (met.filter(F.size("item_slots") > 0)
             .select(*diagonal, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).distinct())
    loose = slots.select(*diagonal, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("s.item_slots").alias("value")),
        F.struct(F.lit(1).alias("side"), F.col("s.doc_slots").alias("value")))).alias("v"))
    clash = (loose.groupBy(*diagonal, "v").count().filter("count > 1")
             .select(F.col("doc_id").alias("d"), F.col("content").alias("c"), F.col("item_id").alias("i"),
                     F.col("item_content").alias("ic"), F.col("shift").alias("s"), F.lit(True).alias("clash")).distinct())
    diagonals = met.groupBy(*diagonal).agg(
        F.count_distinct("item_pos").alias("run"), F.collect_set("item_pos").alias("places"),
        F.max("n_windows").alias("n_windows"), F.bool_and(F.col("item_slots") == F.col("doc_slots")).alias("verbatim"))
    consistent = diagonals.join(clash, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i"))
                                & (F.col("content") == F.col("c")) & (F.col("item_content") == F.col("ic"))
                                & (F.col("shift") == F.col("s")), "left").filter("clash IS NULL")
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("places"))))
    by_templates = (consistent.groupBy("doc_id", "content", "item_id", "item_content")
                    .agg(covered.alias("n_matched"), F.max("n_windows").alias("n_windows"), F.max("run").alias("run"),
                         F.bool_and("verbatim").alias("verbatim"))
                    .withColumn("coverage", F.round(F.col("n_matched") / F.col("n_windows"), 6))
                    .filter((F.col("coverage") >= MIN_COVER) | (F.col("run") >= MIN_RUN)))
    best = F.max(F.struct("coverage", "verbatim", "n_matched", "n_windows")).alias("best")
    return (by_templates.select(*literal.columns).unionByName(literal).groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "best.n_matched", "best.n_windows", "best.coverage", "best.verbatim"))
