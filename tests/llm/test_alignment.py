"""Alignment of two vocabularies against whole texts encoded by both libraries and pairs counted one by one."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from cases import LONG, documents, empty
from corpus_audit.llm import alignment
from corpus_audit.llm.queries import QUERIES, table, vocabulary

A, B = vocabulary(), vocabulary("piece_bpe_32k.model")


def byte_signs():
    """The byte that every visible sign of a byte-level vocabulary stands for."""
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    signs = {chr(byte): byte for byte in plain}
    for byte in range(256):
        if byte not in plain:
            signs[chr(256 + len(signs) - len(plain))] = byte
    return signs


class Slow:
    """Tokens of whole texts as (id, bytes), by the libraries."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.signs = byte_signs()

    def tokens(self, text):
        found = self.a.encode(f" {text}", add_special_tokens=False)
        a = [(number, bytes(self.signs[sign] for sign in token)) for number, token in zip(found.ids, found.tokens)]
        b = [(number, bytes([int(self.b.id_to_piece(number)[3:5], 16)]) if self.b.is_byte(number)
              else self.b.id_to_piece(number).replace("▁", " ").encode()) for number in self.b.encode(text)]
        whole = f" {text}".encode()
        same = text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
        return (a, b) if same else ([], [])


def ends(tokens):
    at, found = 0, []
    for number, content in tokens:
        at += len(content)
        found.append((at, number))
    return found


def slow(rows):
    """The query's rows from (doc_id, text), in order."""
    library, links, counts, result = Slow(), [], Counter(), []
    tokens = [library.tokens(text or "") for _, text in rows]
    for a, b in tokens:
        links.append([(x, y) for p, x in ends(a) for q, y in ends(b) if p == q])
        counts.update(links[-1])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    for (doc_id, _), (a, b), pairs in zip(rows, tokens, links):
        common = sorted({p for p, _ in ends(a)} & {p for p, _ in ends(b)})
        groups = [tuple(",".join(str(x) for p, x in ends(side) if start < p <= end) for side in (a, b))
                  for start, end in zip([0, *common], common)]
        text = ";".join("|".join(group) for group in groups)
        result.append((doc_id, len(a), len(b), len(groups), len(pairs), sum(counts[pair] == best[pair[1]] for pair in pairs),
                       sum(counts[pair] for pair in pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return result


def aligned(df):
    found = alignment.scored(alignment.chunks(df, A, B), A, B).collect()
    return sorted(((row["doc_id"], *(row[name] for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), row["groups_sha256"])
                   for row in found), key=str)


SIGNS = ["a", "the", "ing", " ", " ", " ", "\n", "\t", "  ", "é", "中", "文字", "😀", "▁", "\0", "<s>", "<0x41>", "<|endoftext|>", "'s", "1", "23",
         "Zeit", "ß", ".", ",", "!!", "​", "\xa0", "\r\n", "أ", "한", "unbelievable", "tokenizer", "�"]


def random_rows(n, seed):
    draw = random.Random(seed)
    return [(number, "".join(draw.choices(SIGNS, k=draw.randint(0, 25)))) for number in range(n)]


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 300)
    rows = random_rows(700, 1)
    assert aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == sorted(slow(rows), key=str)


def test_words_alone_say_what_whole_texts_say():
    with open(A, "rb") as a, open(B, "rb") as b:
        work = alignment.Aligner(a.read(), b.read())
    assert work.cuts
    library = Slow()
    for _, text in random_rows(3000, 2):
        words = list(work.documents([text]))[0]
        a, b = library.tokens(text)
        assert (sum(word.n_a for word in words), sum(word.n_b for word in words)) == (len(a), len(b)), text


def test_cases(spark):
    rows = [(row["doc_id"], row["text"]) for row in documents(spark).collect() if row["text"] != LONG]
    assert aligned(documents(spark).filter("doc_id is null or doc_id <> 5")) == sorted(slow(rows), key=str)
    found = {row[0]: row for row in aligned(documents(spark))}
    assert found[3] == (3, 0, 0, 0, 0, 0, 0, "") and found[4][1:] == found[3][1:] and found[5][1] > 10000
    assert aligned(empty(spark)) == []


@pytest.mark.parametrize("name", ["op11_tokenizer_alignment"])
def test_query(spark, name):
    folder = "/root/testdata/sf0.001"
    short = table(spark, folder, "documents").select("doc_id", "text").collect()
    found = sorted((tuple(row) for row in QUERIES[name](spark, folder).collect()), key=str)
    library, counts, links = Slow(), Counter(), {}
    for doc_id, text in short:
        a, b = (dict(ends(side)) for side in library.tokens(text or ""))
        links[doc_id] = [(a[end], b[end]) for end in a.keys() & b.keys()]
        counts.update(links[doc_id])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    assert {row[0]: row[4:7] for row in found} == {
        doc_id: (len(pairs), sum(counts[pair] == best[pair[1]] for pair in pairs), sum(counts[pair] for pair in pairs))
        for doc_id, pairs in links.items()}
