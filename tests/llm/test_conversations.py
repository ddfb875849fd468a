"""Repair of conversations against a search over all edit scripts."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from corpus_audit.llm import conversations
from corpus_audit.llm.queries import QUERIES

BLANK = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")
BEGINNING = re.compile(r"|s?(ua)*u?")


def slow_plan(rows):
    """Least (cost, audit, repaired rows) of faulty rows (role, text, fault), best first over whole scripts."""
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, initials, kept = heapq.heappop(queue)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, "\n".join(f"{role}:{text}" for role, text in kept)
        if len(initials) > len(rows) + 3 or not BEGINNING.fullmatch(initials):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, audit + "I", at, initials + role[0], (*kept, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, initials, kept))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1]:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, initials + role[0], (*kept, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 3, audit + "R", at + 1, initials + other[0], (*kept, (other, text))))


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        visible = BLANK.findall(text)
        found.append("blank" if not visible else "duplicate" if (role, text) in seen else
                     "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def slow(table):
    """The result of the query from rows (conv_id, turn, role, text) in order."""
    result = {}
    for conv_id in {row[0] for row in table}:
        after = []
        for _, turn, role, text in sorted((row for row in table if row[0] == conv_id), key=lambda row: (row[1] is not None, row[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            damage = zlib.crc32(key.encode()) % 20
            text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
            after += [(turn, "user" if damage == 4 else role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
        turns = {turn for turn, _, _ in after if turn is not None}
        found = faults([row[1:] for row in after])
        initials = [role[:1] for _, role, _ in after]
        cost, audit, text = slow_plan([(role, text, fault) for (_, role, text), fault in zip(after, found)])
        result[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"),
            found.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return result


def test_plans_are_the_cheapest_and_least():
    rows = {"s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "x": ("tool", "")}
    suffixes = conversations.Suffixes()
    signs = [*"suaxSUAX-"]
    signatures = ["".join(found) for n in range(4) for found in itertools.product(signs, repeat=n)]
    draw = random.Random(12)
    signatures += ["".join(draw.choices(signs, k=draw.randint(4, 7))) for _ in range(150)]
    for signature in sorted(set(signatures), key=lambda signature: signature[::-1]):
        faulty = [(*rows.get(sign.lower(), ("user", "")), "blank" if sign == "-" else "truncated" if sign.isupper() else "")
                  for sign in signature]
        assert suffixes.plan(signature[::-1]) == slow_plan(faulty)[:2], signature


def conversation_table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def query(spark, tmp_path, rows):
    table = conversation_table(spark, rows).selectExpr("*", "'clash' AS audit", "'clash' AS digest", "'clash' AS kind", "1 AS place")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert len({row["conv_id"] for row in found}) == len(found)
    return {row["conv_id"]: tuple(row)[1:] for row in found}


def test_query_against_all_scripts(spark, tmp_path):
    draw = random.Random(3)
    texts = ["Yes.", "No!", "Why? ", "so", "", "  \n", "a b\tc.\x0b", "café", " "]
    rows = [(conv, turn + draw.choice([0, 0, 0, 2]) * (turn > 2), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "User"]),
             draw.choice(texts)) for conv in range(150) for turn in range(draw.randint(1, 6))]
    rows = list({row[:2]: row for row in rows}.values())
    rows += [(500, turn, role, "Fine.") for turn, role in enumerate(["user", "assistant"] * 3)]
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (600, None, None, None), (601, None, "user", "Who?"),
             (601, 4, None, "Me."), (602, 7, "user", None), (603, 1, "", "No role.")]
    assert query(spark, tmp_path, rows) == slow(rows)


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(row) for row in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {row["conv_id"]: tuple(row)[1:] for row in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert found == slow(rows)


def test_rows_dropped_repeated_and_tied(spark, tmp_path):
    dropped = next(conv for conv in range(1000) if zlib.crc32(f"{conv}:0".encode()) % 20 == 0)
    whole = next(conv for conv in range(1000) if zlib.crc32(f"{conv}:0".encode()) % 20 > 4)
    rows = [(dropped, 0, "user", "Gone."), (whole, 0, "user", "Same."), (whole, 0, "user", "Same."), (whole, 0, "user", "Same.")]
    found = query(spark, tmp_path, rows)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", conversations.EMPTY_SHA256)
    assert found[whole][:7] == (0, 0, 2, 0, 2, 11, "KDDI")


def test_long_conversation_and_many_alike(spark):
    turns = 30_000
    rows = [(1, turn, "assistant" if turn % 2 else "user", f"Turn {turn}.") for turn in range(turns)]
    rows += [(conv, turn, role, "Same.") for conv in range(2, 400) for turn, role in enumerate(("user", "user"))]
    table = conversation_table(spark, rows)
    planned = {row["conv_id"]: (row["cost"], row["audit"]) for row in conversations.plans(table).collect()}
    assert planned[1] == (0, "K" * turns)
    # The second row is a duplicate: it goes, and an answer is put in, before or behind it.
    assert {planned[conv] for conv in range(2, 400)} == {(7, "KDI")}
    fixed = conversations.repaired(table, conversations.plans(table).cache())
    assert fixed.filter("conv_id = 1").count() == turns
    assert [(row["place"], row["edit"], row["role"], row["text"]) for row in fixed.filter("conv_id = 7").orderBy("place").collect()] == [
        (0, "K", "user", "Same."), (1, "I", "assistant", "")]


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == {}
