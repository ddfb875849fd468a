"""Which tokens of one vocabulary stand where those of another do, over a corpus.

Vocabulary A is byte-level BPE (a tokenizers file), B a sentencepiece model; both see a blank and the text.  Places where
tokens of both end cut a text into groups; the last tokens of a group are a link.  For every id of A the id of B with
the same bytes is known beforehand: groups of one such pair are counted in vectors as long as the vocabulary.  Only links of
other groups are counted as pairs, in a shuffle.

Neither vocabulary joins anything across a single blank or a line end (checked for B, given by the pattern for A), so texts
are cut there and a worker aligns each word it meets once; texts with other runs of white space are aligned whole.  The
tokens of a batch of documents become one row, a chunk: its distinct pairs with their numbers of links, and for every document
the places of its pairs among them.  The shuffle of pairs carries those of chunks, not those of documents.  Counts come back to
the chunks the same way, and each document adds up its own.

The driver collects vectors as long as a vocabulary, nothing else.  A document's links stay in one chunk, however long it is.

Defined cases: null and empty texts, and those whose tokens do not give back a blank and the text, have no tokens and an empty
digest; rows without doc_id and repeated rows give a row each; an empty table gives an empty result.  Only the named columns
are read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import sizes_of, slices
from .memory import Recent
from .storage import stored
from .tokens import irregular

KNOWN_WORDS = 150_000
CHUNK_LINKS = 1 << 20
TEXT_SLICE = 2 << 20
BYTE_SIGN = "▁"
# Words with the blank before them, and line ends.
UNIT = re.compile(r"\n| ?[^ \n]+")
COUNTS = ("n_a", "n_b", "n_groups")


def _list(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, T.ArrayType(kind))


# Per chunk: vectors of ids of A that stand alone with their twin, pairs and their links; per document: where its own end.
CHUNK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), _list("doc_ids", T.LongType()),
    *[_list(name, T.LongType()) for name in COUNTS], _list("digests", T.StringType()),
    _list("twins", T.IntegerType()), _list("twin_links", T.LongType()), _list("pairs", T.LongType()), _list("pair_links", T.LongType()),
    _list("twin_ends", T.LongType()), _list("twin_at", T.IntegerType()), _list("twin_times", T.IntegerType()),
    _list("pair_ends", T.LongType()), _list("pair_at", T.IntegerType()), _list("pair_times", T.IntegerType())])
TWINS = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("links", T.LongType())])
SCORED = T.StructType([T.StructField("doc_id", T.LongType())] + [
    T.StructField(name, T.LongType()) for name in (*COUNTS, "n_links", "n_best", "count_sum")] + [
    T.StructField("groups_sha256", T.StringType())])


class Word(NamedTuple):
    """A word's alignment; ``links`` are pairs as little-endian 64-bit integers."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


class Aligner:
    """One worker's vocabularies and the words it has met."""

    def __init__(self, a_content: bytes, b_content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_buffer(a_content)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_content)
        # Byte-level vocabularies write bytes as visible characters: those not visible in Latin-1 follow from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(byte): byte for byte in seen} | {
            chr(256 + at): byte for at, byte in enumerate(byte for byte in range(256) if byte not in seen)}
        tokens = [self.a.id_to_token(number) or "" for number in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(byte_of[sign] for sign in token) if all(sign in byte_of for sign in token) else token.encode()
                        for token in tokens]
        pieces = [self.b.id_to_piece(number) for number in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(piece[3:-1], 16)]) if self.b.is_byte(number) else piece.replace(BYTE_SIGN, " ").encode()
                        for number, piece in enumerate(pieces)]
        self.n_b = len(pieces)
        # A piece proper goes before a byte of the same content.
        by_bytes = {content: number for number, content in sorted(enumerate(self.b_bytes), key=lambda item: -self.b.is_byte(item[0]))}
        self.twin = np.array([by_bytes.get(content, -1) for content in self.a_bytes], dtype=np.int64)
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        joining = [piece for piece in pieces if BYTE_SIGN in piece.lstrip(BYTE_SIGN) or "\n" in piece
                   or piece.startswith(2 * BYTE_SIGN) and piece.strip(BYTE_SIGN)]
        self.cuts = not joining and len(self.b.encode("\n")) == 2
        self.known = Recent(KNOWN_WORDS)

    def align(self, units: list[str]) -> Iterator[Word | None]:
        """The alignment of every unit, or nothing if its tokens say something else.

        B puts a blank before what it is given; a unit without one is given behind a line end, which is taken off again.
        """
        ids_a = [found.ids for found in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.b.encode([unit[1:] if unit[0] == " " else "\n" + unit for unit in units], num_threads=1)
        for unit, a, b in zip(units, ids_a, ids_b):
            if unit[0] != " ":
                b = b[2:]
            content = unit.encode("utf-8")
            same = content == b"".join([self.a_bytes[x] for x in a]) == b"".join([self.b_bytes[x] for x in b])
            yield self._groups(a, b) if same else None

    def _groups(self, a: list[int], b: list[int]) -> Word:
        a_sizes, b_sizes, groups, links = self.a_sizes, self.b_sizes, [], []
        first_a = first_b = at = a_end = b_end = 0
        for place, x in enumerate(a, 1):
            a_end += a_sizes[x]
            while b_end < a_end:
                b_end += b_sizes[b[at]]
                at += 1
            if a_end == b_end:
                groups.append(f"{','.join(map(str, a[first_a:place]))}|{','.join(map(str, b[first_b:at]))}")
                links.append(x * self.n_b + b[at - 1])
                first_a, first_b = place, at
        return Word(len(a), len(b), len(links), ";".join(groups), np.array(links, "<i8").tobytes())

    def documents(self, texts: list[str]) -> Iterator[list[Word]]:
        """The aligned words of every text; none where the tokens do not give back a blank and the text."""
        cut = [None if not self.cuts or irregular(text) or text[0] == "\n" else UNIT.findall(f" {text}") for text in texts]
        unknown = list(self.known.unknown(set().union(*filter(None, cut))))
        self.known.learn(zip(unknown, self.align(unknown)))
        of_word = self.known.now.__getitem__
        for text, units in zip(texts, cut):
            words = [] if not text else list(self.align([f" {text}"])) if units is None else list(map(of_word, units))
            yield [] if None in words else words


@functools.lru_cache(maxsize=2)
def aligner(a_content: bytes, b_content: bytes) -> Aligner:
    return Aligner(a_content, b_content)


class _Chunk:
    """Documents until their links fill a row."""

    def __init__(self):
        self.doc_ids, self.digests, self.numbers, self.kinds, self.times = [], [], [], [], []
        self.held = 0

    def add(self, doc_id: int | None, words: list[Word]) -> None:
        links, times = np.unique(np.frombuffer(b"".join([word.links for word in words]), "<i8"), return_counts=True)
        self.doc_ids.append(doc_id)
        self.digests.append(hashlib.sha256(";".join([word.groups for word in words]).encode()).hexdigest() if words else "")
        self.numbers.append([sum(word[at] for word in words) for at in range(3)])
        self.kinds.append(links)
        self.times.append(times)
        self.held += len(links)

    def row(self, part: int, chunk: int, work: Aligner) -> pa.RecordBatch:
        links, times = np.concatenate(self.kinds), np.concatenate(self.times)
        owner = np.repeat(np.arange(len(self.kinds)), [len(kinds) for kinds in self.kinds])
        a, b = np.divmod(links, work.n_b)
        regular = work.twin[a] == b

        def counted(chosen: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
            distinct, place = np.unique(of[chosen], return_inverse=True)
            total = np.bincount(place, times[chosen], len(distinct)).astype(np.int64)
            ends = np.cumsum(np.bincount(owner[chosen], minlength=len(self.kinds)))
            return distinct, total, ends, place, times[chosen]

        twins, twin_links, *twin_places = counted(regular, a)
        pairs, pair_links, *pair_places = counted(~regular, links)
        columns = [part, chunk, self.doc_ids, *zip(*self.numbers), self.digests, twins, twin_links, pairs, pair_links,
                   *twin_places, *pair_places]
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        arrays = []
        for value, field in zip(columns, CHUNK):
            if isinstance(field.dataType, T.ArrayType):
                inner = pa.array(value, kinds[field.dataType.elementType.simpleString()])
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner))
            else:
                arrays.append(pa.array([value], kinds[field.dataType.simpleString()]))
        return pa.record_batch(arrays, names=CHUNK.names)


def chunks(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The aligned documents in rows of ``CHUNK``, stored."""
    content = []
    for path in (a_vocabulary, b_vocabulary):
        with open(path, "rb") as file:
            content.append(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(content))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, part, number, current = aligner(*shared.value), TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for run in slices(sizes_of(batch["text"]), TEXT_SLICE):
                texts = [value or "" for value in batch["text"][run].to_pylist()]
                for owner, words in zip(batch["doc_id"][run].to_pylist(), work.documents(texts)):
                    current.add(owner, words)
                    if current.held >= CHUNK_LINKS:
                        yield current.row(part, number, work)
                        number, current = number + 1, _Chunk()
        if current.doc_ids:
            yield current.row(part, number, work)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(align, CHUNK), "aligned")


def twin_links(found: DataFrame, n_a: int) -> np.ndarray:
    """For every id of A how often it stands alone with its twin: vectors of the tasks, added up."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_a, dtype=np.int64)
        for batch in batches:
            ids, links = (batch[name].flatten().to_numpy(zero_copy_only=False) for name in ("twins", "twin_links"))
            np.add.at(total, ids, links)
        used = np.flatnonzero(total)
        yield pa.record_batch({"a": pa.array(used, pa.int32()), "links": pa.array(total[used], pa.int64())})

    vector = np.zeros(n_a, dtype=np.int64)
    for row in found.select("twins", "twin_links").mapInArrow(add, TWINS).groupBy("a").agg(F.sum("links").alias("links")).collect():
        vector[row["a"]] = row["links"]
    return vector


def pair_links(found: DataFrame) -> DataFrame:
    """(pair, links) of all links in groups that are no twins; a pair is its id of A times the size of B plus its id of B."""
    each = found.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("of"))
    return each.groupBy(F.col("of.pairs").alias("pair")).agg(F.sum("of.pair_links").alias("links"))


def scored(found: DataFrame, a_vocabulary: str, b_vocabulary: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of the documents in ``chunks``."""
    with open(a_vocabulary, "rb") as a_file, open(b_vocabulary, "rb") as b_file:
        work = aligner(a_file.read(), b_file.read())
    n_b, twin = work.n_b, work.twin
    twins = twin_links(found, len(twin))
    totals = stored(pair_links(found), "pairs")
    # The most links of any pair of an id of B: a vector as long as the vocabulary.
    most = np.zeros(n_b, dtype=np.int64)
    np.maximum.at(most, twin[twin >= 0], twins[twin >= 0])
    for row in totals.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("links").alias("links")).collect():
        most[row["b"]] = max(most[row["b"]], row["links"])
    vectors = found.sparkSession.sparkContext.broadcast((twins, twins == most[twin], most))

    asked = found.select("part", "chunk", F.posexplode("pairs").alias("at", "pair"))
    answers = (asked.join(totals, "pair").groupBy("part", "chunk")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "links"))), lambda x: x.links).alias("links")))
    rows = found.drop("twin_links", "pair_links").join(answers, ["part", "chunk"], "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twins, twin_best, most = vectors.value

        def added(numbers: np.ndarray, best: np.ndarray, row: dict, kind: str) -> tuple[np.ndarray, ...]:
            """Sum over links, links that are best, and links, by document."""
            ends, at, times = (np.asarray(row[f"{kind}_{name}"], dtype=np.int64) for name in ("ends", "at", "times"))
            sums = np.zeros((3, len(at) + 1), dtype=np.int64)
            sums[:, 1:] = np.cumsum([numbers[at] * times, best[at] * times, times], axis=1)
            return np.diff(sums[:, ends], axis=1, prepend=0)

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch[name][at].values for name in batch.schema.names if pa.types.is_list(batch[name].type)}
                ids = row["twins"].to_numpy(zero_copy_only=False)
                pairs = row["pairs"].to_numpy(zero_copy_only=False)
                numbers = np.zeros(0, np.int64) if row["links"] is None else row["links"].to_numpy(zero_copy_only=False)
                count_sum, n_best, n_links = (
                    added(twins[ids], twin_best[ids], row, "twin") + added(numbers, numbers == most[pairs % n_b], row, "pair"))
                yield pa.record_batch([row["doc_ids"], *[row[name] for name in COUNTS], *map(pa.array, (n_links, n_best, count_sum)),
                                       row["digests"]], names=SCORED.names)

    return rows.mapInArrow(score, SCORED)
