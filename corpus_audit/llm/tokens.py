"""Token ids in fixed-width bit-packed blocks.

Documents are range-partitioned and sorted by doc_id, encoded, and written as rows of a Parquet dataset, one row per
block of about ``BLOCK_TOKENS`` ids.  Every id takes as many bits as the largest id of the vocabulary needs, lowest bit
first, so the id at place i of a block starts at bit ``i * bits``: a reader unpacks any slice of a block with a few
numpy operations.  A block row holds ``part`` and ``block`` (their order is the order of the documents), ``bits``,
``n_tokens``, ``payload``, and the ids and token counts of its documents.  A document is never split over blocks.

Defined cases: a null text is an empty one and still gets its end id; null doc_ids come first; repeated doc_ids are
ordered by a hash of the text, and rows equal in both may fall into different partitions, so a hot id is not one task;
an empty table gives an empty dataset.  Only the named columns are read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_TOKENS = 1 << 16
KNOWN_WORDS = 1_000_000
BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("bits", T.IntegerType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
])
DECODED = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("offset", T.LongType()),
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])
LETTERS_AND_SIGNS = re.compile(r"([^\W\d_]+)([^\w\s']+)")
# White space other than blanks and line ends, as any of the involved libraries may understand it.
ODD_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each; whole bytes are the plain little-endian integers."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """The ids at places ``start`` to ``start + count`` of a packed block, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first = np.arange(start, start + count, dtype=np.int64) * bits
    data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(5, np.uint8)]).astype(np.uint64)
    byte = first >> 3
    window = sum(data[byte + at] << np.uint64(8 * at) for at in range(5))
    return ((window >> (first & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class _Words(dict):
    """The ids of words that stand behind ``before``, learnt when first met.

    Letters alone are one piece of the vocabulary's pattern and go straight to the model; signs behind letters are a
    piece of their own.  Any other word is encoded whole.
    """

    def __init__(self, tokenizer, before: str):
        super().__init__({"": b""})
        self.tokenizer, self.model, self.before = tokenizer, tokenizer.model, before
        # The vocabulary writes bytes as visible characters: those that are not visible in Latin-1 follow from 256 on.
        hidden = [byte for byte in range(256) if not (33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255)]
        self.visible = {byte: 256 + at for at, byte in enumerate(hidden)}
        self.signs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        piece = (self.before.translate(self.visible) + word if word.isascii()
                 else (self.before + word).encode("utf-8").decode("latin-1").translate(self.visible))
        return array("I", [found.id for found in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            found = self._letters(word)
        elif parts := LETTERS_AND_SIGNS.fullmatch(word):
            stem, signs = parts.groups()
            if signs not in self.signs:
                self.signs[signs] = self.whole(signs)
            found = self[stem] + self.signs[signs]
        else:
            found = self.whole(self.before + word)
        self[word] = found
        return found


class Encoder:
    """Encodes texts word by word with a bounded memory of words.

    The byte-level pattern of the vocabulary never joins white space to what stands before it, a blank joins the word
    that follows it, and a line end before a visible character stands alone.  So a text may be cut at single blanks and
    line ends.  Texts with other runs of white space, and those that spell a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self._forget()
        self.line_end = self.line_start.whole("\n")

    def _forget(self) -> None:
        self.line_start, self.after_blank = _Words(self.tokenizer, ""), _Words(self.tokenizer, " ")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if irregular(text) or any(special in text for special in self.specials):
            return self.line_start.whole(text)
        if len(self.after_blank) + len(self.line_start) > KNOWN_WORDS:
            self._forget()
        first, after = self.line_start.__getitem__, self.after_blank.__getitem__
        return self.line_end.join([first(words[0]) + b"".join(map(after, words[1:]))
                                   for words in (line.split(" ") for line in text.split("\n"))])


def irregular(text: str) -> bool:
    """Whether a text has white space of which the pattern makes more than line ends and word starts."""
    return bool(text[:1] in ("", " ") or text[-1] == " " or text.endswith("\n\n") or ODD_SPACE.search(text)
                or any(run in text for run in ("  ", " \n", "\n\n\n", "\n\n ")))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """Write the blocks of all documents in ascending doc_id order to ``path``; returns the dataset as read back."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_one, bits = encoder(vocabulary).encode, encoder(vocabulary).bits
        part, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
        block, held, ids, owners, lengths = 0, 0, [], [], []

        def row():
            numbers = np.frombuffer(b"".join(ids), dtype="<u4")
            return pd.DataFrame({"part": [part], "block": [block], "bits": [bits], "n_tokens": [len(numbers)],
                                 "payload": [pack(numbers, bits)], "doc_ids": [owners], "lengths": [lengths]})

        for batch in batches:
            for owner, words in zip(batch["doc_id"], batch["text"]):
                ids.append(encode_one(words or "") + end)
                owners.append(None if pd.isna(owner) else int(owner))
                lengths.append(len(ids[-1]) // 4)
                held += lengths[-1]
                if held >= BLOCK_TOKENS:
                    yield row()
                    block, held, ids, owners, lengths = block + 1, 0, [], [], []
        if ids:
            yield row()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"turn": F.xxhash64("text"), "copy": F.xxhash64(F.monotonically_increasing_id())})
    order = [F.col("doc_id").asc_nulls_first(), F.col("turn"), F.col("copy")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInPandas(encode, BLOCKS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the blocks.

    A block's first place is the sum of the parts before its own and of the earlier blocks of its part; only the parts,
    of which there are as many as write tasks, are summed in one place.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.asarray(row.lengths, dtype=np.int64)
                ids = unpack(row.payload, row.bits, 0, row.n_tokens).astype("<u4")
                ends = np.cumsum(lengths)
                yield pd.DataFrame({
                    "part": row.part, "block": row.block, "offset": ends - lengths,
                    "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64"),
                    "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(ids[end - size:end].tobytes()) for end, size in zip(ends, lengths)]})

    sizes = blocks.select("part", "block", "n_tokens")
    before = lambda window: F.sum("n_tokens").over(window.rowsBetween(Window.unboundedPreceding, -1))
    parts = (sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
             .select("part", F.coalesce(before(Window.orderBy("part")), F.lit(0)).alias("part_start")))
    starts = (sizes.withColumn("inside", F.coalesce(before(Window.partitionBy("part").orderBy("block")), F.lit(0)))
              .join(parts, "part").select("part", "block", (F.col("part_start") + F.col("inside")).alias("first")))
    return (blocks.mapInPandas(decode, DECODED).join(starts, ["part", "block"])
            .select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))
