"""Repair of conversation structure at the least cost, planned once per shared suffix of all conversations.

A conversation's rows, in the order of their turns, become a signature of one sign a row: the row's role and fault.
Distinct signatures are range-partitioned and sorted by their reversal, so that those that end alike are neighbours.  Read
from the end, the signatures of a partition are an acyclic automaton whose nodes are the distinct suffixes; in sorted order
the nodes of the current signature are a stack, and each is worked out once and shared by all that follow.  A node holds,
for every state of the grammar, the least cost of what is left and the edit the best audit suffix starts with (the rest of
that suffix is in the nodes below).  Options of one state start with different edits, so comparing a cost and an initial
settles ties over whole audits.

The grammar of role initials is ``(s?(ua)+)?``.  Edits and costs: Keep 0, Rerole (to user or assistant) 3, Delete 4, Insert
(an empty user or assistant row) 3; a truncated row that stays adds 3; blank and duplicate rows must be deleted.

A conversation is planned and written by one task in the order of its rows, in bounded memory but for a byte a row: the
digest of a whole conversation is sequential.  Conversations that are alike are planned once, however many they are.

Defined cases: null roles and texts are one blank; null turns come first; rows of one turn are ordered by a hash of role and
text; an empty role or one with another initial never fits the grammar; null conv_ids are one conversation; an empty table gives
an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\x0b\f\r"
RETURNED_ROWS = 2000
LARGEST = (1 << 63) - 1
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3

# States of the grammar: at the start, behind system, behind user, behind assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = {START, ASSISTANT}
KEEPING = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}

SUMMARY = T.StructType([T.StructField("conv_id", T.LongType())] + [
    T.StructField(name, T.LongType()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal")] + [
    T.StructField("signature", T.StringType())])
PLAN = T.StructType([T.StructField("signature", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
REPAIRED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("repaired_sha256", T.StringType())])
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that a checksum of conversation and turn chooses, for tests of the repair."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", _filled("role"), _filled("text"), (F.crc32(key.cast("binary")) % 20).alias("damage"))
    text = (F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("damage <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" ")).alias(name)


def _rows(turns: DataFrame) -> DataFrame:
    """The rows of conversations with ``digest``, equal where role and text are; it orders the rows of one turn."""
    filled = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _filled("role"), _filled("text"))
    return filled.withColumn("digest", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))


def _in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("digest")]


def summaries(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation, from its rows without texts."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    narrow = _rows(turns).select(
        "conv_id", "turn", "digest", initial.alias("initial"), known.alias("known"), (said == "").alias("blank"),
        (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("truncated")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), "b").when(again, "d").when(F.col("truncated"), "t").otherwise("")
    marked = narrow.select("conv_id", "turn", "digest", "initial", "known", fault.alias("fault"))
    return (marked.sortWithinPartitions("conv_id", *_in_order()).select("conv_id", "turn", "initial", "known", "fault")
            .mapInArrow(_summarised, SUMMARY))


class _Summary:
    """What is known of a conversation from the rows read so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.first = self.turn = None
        self.turns = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}
        self.before: str | None = None
        self.signs: list[str] = []

    def add(self, turn: int | None, initial: str, known: str, fault: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.turn
            self.turn = turn
        self.illegal += self.before is not None and self.before + initial not in LEGAL_PAIRS
        self.before = initial
        self.faults[fault] += 1
        self.signs.append("-" if fault in ("b", "d") else known.upper() if fault == "t" else known)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(self.turn - self.first + 1 - self.turns, LARGEST)
        return (self.conv_id, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, "".join(self.signs))


def _returned(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(column, kinds[field.dataType.simpleString()]) for column, field in zip(columns, schema)],
                           names=schema.names)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, done = None, []
    for batch in batches:
        for conv_id, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if current is None or conv_id != current.conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Summary(conv_id)
            current.add(*row)
        if len(done) >= RETURNED_ROWS:
            yield _returned(done, SUMMARY)
            done = []
    if current is not None:
        done.append(current.row())
    yield _returned(done, SUMMARY)


def behind(sign: str | None, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Costs and first edits of a node by state, from the costs of the node its sign leads to; no sign is the end."""
    options = []
    for state in range(4):
        if sign is None:
            ways = [(0, " ")] if state in ACCEPTING else []
        else:
            ways = [(COSTS["D"] + after[state], "D")]
            if sign != "-":
                extra = TRUNCATED_COST if sign.isupper() else 0
                ways.append((COSTS["R"] + extra + after[NEXT[state]], "R"))
                if (state, sign.lower()) in KEEPING:
                    ways.append((extra + after[KEEPING[state, sign.lower()]], "K"))
        options.append(min(ways, default=(LARGEST, "I")))
    # Inserting twice behind user or assistant leads back, so one step settles these; the others follow from them.
    for state in (USER, ASSISTANT):
        ahead = options[NEXT[state]]
        if ahead[1] != "I":
            options[state] = min(options[state], (COSTS["I"] + ahead[0], "I"))
    for state in (START, SYSTEM):
        options[state] = min(options[state], (COSTS["I"] + options[NEXT[state]][0], "I"))
    return tuple(cost for cost, _ in options), "".join(edit for _, edit in options)


def step(state: int, edit: str, initial: str) -> int:
    """The state behind an edit of a row with this role initial."""
    return state if edit == "D" else KEEPING[state, initial] if edit == "K" else NEXT[state]


class Suffixes:
    """The nodes on the path of the current signature, from the end: shared with the next one as far as both end alike."""

    def __init__(self):
        costs, edits = behind(None, ())
        self.reverse, self.costs, self.edits = "", [costs], [edits]

    def plan(self, reverse: str) -> tuple[int, str]:
        """Cost and audit of the signature whose reversal this is."""
        shared = len(os.path.commonprefix([self.reverse, reverse]))
        del self.costs[shared + 1:], self.edits[shared + 1:]
        for sign in reverse[shared:]:
            costs, edits = behind(sign, self.costs[-1])
            self.costs.append(costs)
            self.edits.append(edits)
        self.reverse = reverse
        audit, node, state = [], len(reverse), START
        while (edit := self.edits[node][state]) != " ":
            audit.append(edit)
            if edit == "I":
                state = NEXT[state]
            else:
                state = step(state, edit, reverse[node - 1].lower())
                node -= 1
        return self.costs[len(reverse)][START], "".join(audit)


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    suffixes = Suffixes()
    for batch in batches:
        rows = [(signature, *suffixes.plan(signature[::-1])) for signature in batch["signature"].to_pylist()]
        yield _returned(rows, PLAN)


def plans(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    found = summaries(turns)
    reverse = F.reverse("signature")
    planned = (found.select("signature").distinct().repartitionByRange(reverse).sortWithinPartitions(reverse)
               .mapInArrow(_planned, PLAN))
    return found.join(planned, "signature").drop("signature")


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations, each conversation in one task and in order.

    ``planned`` are the rows of ``plans`` for the same ``turns``; each goes ahead of its conversation's rows.
    """
    heads = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"),
                           F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = _rows(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    return (heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_in_order())
            .select("conv_id", "kind", "role", "text").mapInArrow(_edited, REPAIRED))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv_id, audit, at, state, place, done = None, "", 0, START, 0, []

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place
        done.append((conv_id, place, edit, role, text))
        place += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            put("I", ROLE[state], "")
            at += 1

    for batch in batches:
        for owner, kind, role, text in zip(*(column.to_pylist() for column in batch.columns)):
            if kind == 0:
                inserts()
                conv_id, audit, at, state, place = owner, text, 0, START, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            state = step(state, edit, role[:1])
            if edit != "D":
                put(edit, role if edit == "K" else ROLE[state], text)
            if len(done) >= RETURNED_ROWS:
                yield _returned(done, REPAIRED)
                done = []
    inserts()
    yield _returned(done, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what ``repaired`` returns, as it returns it: conversations whole and in order."""
    return rows.select("conv_id", "place", "role", "text").mapInArrow(_digested, DIGEST)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state, done = None, None, []
    for batch in batches:
        for conv_id, place, role, text in zip(*(column.to_pylist() for column in batch.columns)):
            line = f"{role}:{text}".encode()
            if place == 0:
                if state is not None:
                    done.append((current, state.hexdigest()))
                current, state = conv_id, hashlib.sha256(line)
            else:
                state.update(b"\n" + line)
        if len(done) >= RETURNED_ROWS:
            yield _returned(done, DIGEST)
            done = []
    if state is not None:
        done.append((current, state.hexdigest()))
    yield _returned(done, DIGEST)
