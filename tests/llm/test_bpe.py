"""Encoding by recursive queries against the library that defines it, and the way back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cases import LONG, documents, empty
from corpus_audit.llm import bpe
from corpus_audit.llm.queries import QUERIES, table, vocabulary

RANKS, PATTERN = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return bpe.Codec(file.read(), PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def same(codec, library, texts):
    ids = codec.encode(texts)
    assert [np.frombuffer(found, "<u4").tolist() for found in ids] == [library.encode_ordinary(text) for text in texts]
    assert codec.decode(ids) == [text.encode() for text in texts]


def test_random_texts(codec, library):
    draw = random.Random(13)
    signs = "ab cd\n  'sre1é中😀\t.,'!   \x1c"
    same(codec, library, ["".join(draw.choices(signs, k=draw.randint(0, 50))) for _ in range(4000)])


def test_every_code_point(codec, library):
    points = [chr(point) for point in range(0x110000) if not 0xD800 <= point < 0xE000]
    same(codec, library, [f"a{point}b {point} 1" for point in points[:3000]])
    same(codec, library, ["".join(points[at:at + 16]) for at in range(0, 0x20000, 16)])


def test_long_pieces(codec, library):
    draw = random.Random(7)
    mixed = ["".join(draw.choices(signs, k=1500)) for signs in ("ab", "abcdefghij", "ACGT", "eth", "中文字符の", "=-+", "aAbB")]
    same(codec, library, ["a" * 5000, "aba" * 400 + "ab" * 200, "thethatthe" * 300, "==" * 999, *mixed])


def test_long_pieces_in_few_rounds_a_query(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_ROWS", 1000)
    same(codec, library, ["thatthethe" * 40 + "ing" * 100, "x" * 777 + "yx" * 100, "short words too", " ".join(map(str, range(3000)))])


def test_both_contractions_agree(codec):
    draw = random.Random(5)
    for _ in range(60):
        piece = "".join(draw.choices("abeinorstth", k=draw.randint(2, 120))).encode()
        assert codec._contract_long(piece) == next(iter(codec._contract([piece])))


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 2)
    with open(RANKS, "rb") as file:
        forgetful = bpe.Codec(file.read(), PATTERN)
    for text in ("one two three four five", "two three six", "one two", "seven eight nine ten", "two six seven", "two six seven"):
        same(forgetful, library, [text])
    assert len(forgetful.pieces.before) + len(forgetful.pieces.now) < 14


def test_unknown_ids_are_an_error(codec):
    with pytest.raises(ValueError):
        codec.decode([np.array([1, 60000], "<u4").tobytes()])


def test_cases(spark):
    rows = bpe.decoded(bpe.encoded(documents(spark), RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(rows) == 12
    found = {row["doc_id"]: bytes(row["decoded"]) for row in rows if row["doc_id"] is not None}
    assert found[3] == found[4] == b"" and found[5] == LONG.encode() and found[9] == "😀 ünï\ncode ßtraße\n".encode()
    assert bpe.encoded(empty(spark), RANKS, PATTERN).collect() == []


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {row["doc_id"]: row["text"] or "" for row in table(spark, folder, "documents").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = np.array(library.encode_ordinary(texts[row["doc_id"]]), "<u4")
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
