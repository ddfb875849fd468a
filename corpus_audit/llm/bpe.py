"""Byte-level BPE encoding and decoding with a rank file, by recursive DuckDB queries inside the tasks.

The driver reads the rank file, whose size a vocabulary bounds, and broadcasts its bytes.  Each worker makes two DuckDB
tables of it: the merges (two ids that stand side by side, and the id of their joined bytes) and the bytes of every id.

Encoding.  The pattern cuts a text into pieces.  Pieces a worker has not met become rows (piece, place, id of the byte).  A recursive query joins neighbouring rows with the merges, contracts each piece's leftmost pair
of the least rank, and goes on until no pair of any piece is a merge.  Pieces above ``LONG_PIECE`` bytes go through a
second query, which contracts all places of the least rank at once, left to right, where that is the same: the new id
must be one whose later merges all rank behind it.  Both ask for ``MAX_ROWS`` rows at a time.  What a worker knows of pieces
is a bounded memory for speed; it changes no result.

Decoding joins rows (span, place, id) with the bytes of the ids and aggregates them in the order of the places.  Texts of
many ids are cut into spans, so that no query grows with the length of a text.

Defined cases: null and empty texts have no ids and decode to no bytes; rows without doc_id and repeated rows give a row
each; an empty table gives an empty result.  Only the named columns are read.  An id outside the vocabulary cannot be
decoded and raises an error.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import Recent

KNOWN_PIECES = 220_000
LONG_PIECE = 256
MAX_ROWS = 300_000
TEXT_SLICE = 3 << 20
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
DECODED = T.StructType([*ENCODED.fields, T.StructField("decoded", T.BinaryType())])

# One contraction per piece and round.  ``pick`` holds the rank above 20 bits of place.
CONTRACT = """
WITH RECURSIVE steps(round, piece, place, id) AS (
  SELECT 0, piece, place, id FROM bytes_of_pieces
  UNION ALL
  SELECT round + 1, s.piece, CASE WHEN place > pick % 1048576 THEN place - 1 ELSE place END,
    CASE WHEN place = pick % 1048576 THEN (pick // 1048576)::INTEGER ELSE id END
  FROM steps s JOIN (
    SELECT a.piece, min(merged::BIGINT * 1048576 + a.place) AS pick
    FROM steps a JOIN steps b ON b.piece = a.piece AND b.place = a.place + 1 JOIN merges ON merges.a = a.id AND merges.b = b.id
    GROUP BY a.piece) picks ON picks.piece = s.piece
  WHERE place <> pick % 1048576 + 1
)
SELECT piece, list(id ORDER BY place) AS ids
FROM steps JOIN (SELECT piece, max(round) AS round FROM steps GROUP BY piece) last USING (piece, round)
GROUP BY piece ORDER BY piece
"""

# All places of the least rank per round.  Places that overlap form an island, of which every other one is contracted.
CONTRACT_LONG = """
WITH RECURSIVE steps(round, place, id) AS (
  SELECT 0, place, id FROM bytes_of_pieces
  UNION ALL
  SELECT round + 1, (row_number() OVER (ORDER BY place) - 1)::INTEGER, id FROM (
    SELECT s.round, s.place, coalesce(m.merged, s.id) AS id, count(m.place) OVER () AS contracted
    FROM steps s LEFT JOIN (
      SELECT place + unnest([0, 1]) AS place, unnest([merged, -1]) AS merged FROM (
        SELECT place, merged, alone, n, row_number() OVER (PARTITION BY place - n ORDER BY place) AS nth FROM (
          SELECT place, merged, alone, row_number() OVER (ORDER BY place) AS n FROM (
            SELECT a.place, merged, alone, min(merged) OVER () AS least
            FROM steps a JOIN steps b ON b.place = a.place + 1 JOIN merges ON merges.a = a.id AND merges.b = b.id)
          WHERE merged = least))
      WHERE CASE WHEN alone THEN n = 1 ELSE nth % 2 = 1 END) m ON m.place = s.place)
  WHERE id >= 0 AND contracted > 0 AND round < $rounds
)
SELECT round, list(id ORDER BY place) AS ids FROM steps WHERE round = (SELECT max(round) FROM steps) GROUP BY round
"""

DECODE = """
SELECT span, string_agg(hex, '' ORDER BY place) AS hex, count(*) AS n FROM ids_of_spans JOIN vocabulary USING (id) GROUP BY span ORDER BY span
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Bytes and rank of every line of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> pa.Table:
    """(a, b, merged, alone): every way to make an id of two others.

    ``alone`` marks ids that some merge joins to one of a lesser rank: they have to be contracted one at a time.
    """
    rows = [(ranks[token[:cut]], ranks[token[cut:]], rank) for token, rank in ranks.items() for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks]
    a, b, merged = np.array(rows or [(-1, -1, -1)], dtype=np.int32).T
    alone = np.unique(np.concatenate([a[a > merged], b[b > merged]]))
    return pa.table({"a": a, "b": b, "merged": merged, "alone": np.isin(merged, alone)})


class Codec:
    """One worker's DuckDB tables of a rank file, and the pieces it has met."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb
        import regex
        self.ranks = read_ranks(content)
        if any(bytes([byte]) not in self.ranks for byte in range(256)):
            raise ValueError("a byte-level vocabulary has an id for every byte")
        self.pieces_of = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([byte])] for byte in range(256)], dtype=np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1})
        self._load("merges", merges_of(self.ranks))
        self._load("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()),
                                           "hex": [token.hex() for token in self.ranks]}))
        self.pieces = Recent(KNOWN_PIECES)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _ask(self, sql: str, name: str, rows: pa.Table, **values) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql, params=values or None).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _contract(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The ids of pieces, in their order."""
        lengths = np.array([len(piece) for piece in pieces])
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        rows = pa.table({"piece": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths),
                         "place": (np.arange(len(ids)) - np.repeat(starts, lengths)).astype(np.int32), "id": ids})
        found = self._ask(CONTRACT, "bytes_of_pieces", rows)["ids"].combine_chunks()
        flat = found.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = found.offsets.to_numpy() - found.offsets[0].as_py()
        return (flat[4 * start:4 * end] for start, end in zip(ends, ends[1:]))

    def _contract_long(self, piece: bytes) -> bytes:
        """The ids of one long piece, some rounds a query."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        while True:
            rounds = max(1, MAX_ROWS // len(ids))
            rows = pa.table({"place": np.arange(len(ids), dtype=np.int32), "id": ids})
            found = self._ask(CONTRACT_LONG, "bytes_of_pieces", rows, rounds=rounds)
            ids = found["ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            if found["round"][0].as_py() < rounds:
                return ids.astype("<u4").tobytes()

    def _learn(self, pieces: Iterable[str]) -> None:
        batch, held = [], 0

        def close():
            if batch:
                self.pieces.learn(zip([piece for piece, _ in batch], self._contract([raw for _, raw in batch])))

        for piece in pieces:
            raw = piece.encode("utf-8")
            if raw in self.ranks:
                self.pieces.now[piece] = np.array([self.ranks[raw]], "<u4").tobytes()
            elif len(raw) > LONG_PIECE:
                self.pieces.now[piece] = self._contract_long(raw)
            else:
                if held + len(raw) > MAX_ROWS // 2:
                    close()
                    batch, held = [], 0
                batch.append((piece, raw))
                held += len(raw)
        close()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces_of(text) for text in texts]
        self._learn(self.pieces.unknown(set().union(*cut)))
        of_piece = self.pieces.now.__getitem__
        return [b"".join(map(of_piece, pieces)) for pieces in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes behind every sequence of ids."""
        decoded: list[list[bytes]] = [[] for _ in ids]
        spans = [(owner, sequence[start:start + 4 * MAX_ROWS]) for owner, sequence in enumerate(ids)
                 for start in range(0, len(sequence), 4 * MAX_ROWS)]
        for part in slices([len(span) // 4 for _, span in spans], MAX_ROWS):
            lengths = np.array([len(span) // 4 for _, span in spans[part]])
            flat = np.frombuffer(b"".join([span for _, span in spans[part]]), "<u4")
            starts = np.cumsum(lengths) - lengths
            rows = pa.table({"span": np.repeat(np.arange(len(lengths), dtype=np.int32), lengths),
                             "place": (np.arange(len(flat)) - np.repeat(starts, lengths)).astype(np.int32), "id": flat.astype(np.int64)})
            found = self._ask(DECODE, "ids_of_spans", rows)
            if sum(found["n"].to_pylist()) != len(flat):
                raise ValueError("an id is not in the vocabulary")
            for (owner, _), piece in zip(spans[part], found["hex"].to_pylist()):
                decoded[owner].append(bytes.fromhex(piece))
        return [b"".join(parts) for parts in decoded]


@functools.lru_cache(maxsize=2)
def codec(content: bytes, pattern: str) -> Codec:
    return Codec(content, pattern)


def sizes_of(column: pa.Array) -> list[int]:
    """The bytes of every text or binary value."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of rows with at most ``most`` together, or of a single row."""
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield slice(start, at)
            start, held = at, 0
        held += size
    if sizes:
        yield slice(start, len(sizes))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every row; ids are little-endian unsigned 32-bit integers."""
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(content.value, pattern)
        for batch in batches:
            for part in slices(sizes_of(batch["text"]), TEXT_SLICE):
                texts = [value or "" for value in batch["text"][part].to_pylist()]
                yield pa.record_batch({"doc_id": batch["doc_id"][part], "ids": pa.array(work.encode(texts), pa.binary())})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, ENCODED)


def decoded(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids): the bytes the ids stand for."""
    with open(vocabulary, "rb") as file:
        content = rows.sparkSession.sparkContext.broadcast(file.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(content.value, pattern)
        for batch in batches:
            for part in slices(sizes_of(batch["ids"]), TEXT_SLICE):
                ids = batch["ids"][part]
                found = pa.array(work.decode([value or b"" for value in ids.to_pylist()]), pa.binary())
                yield pa.record_batch({"doc_id": batch["doc_id"][part], "ids": ids, "decoded": found})

    return rows.select("doc_id", "ids").mapInArrow(decode, DECODED)
