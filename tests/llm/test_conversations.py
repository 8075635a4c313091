"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest

from tidings.llm import conversations
from tidings.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
FILLED = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """Conversations after damage, each in order."""
    out = {}
    for conv_id, turn, role, text in rows:
        own = out.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        filled = FILLED.findall(text)
        if not filled:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif filled[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


FINAL = re.compile(r"(s?(ua)+)?$")


def cheapest(rows, marks):
    """(cost, edits, lines): uniform-cost search over (cost, edits), the roles so far as plain text."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, place, roles, lines = heapq.heappop(heap)
        if place == len(rows) and FINAL.match(roles):
            return cost, edits, lines
        # Of what was said only how it may go on matters.
        state = (place, roles[-1:] if roles else "^", len(roles) == 1)
        if state in done:
            continue
        done.add(state)
        steps = [("I", 2, 0, role, "") for role in ("user", "assistant")]
        if place < len(rows):
            _, role, text = rows[place]
            steps.append(("D", 3, 1, None, ""))
            if marks[place] not in ("blank", "duplicate"):
                torn = marks[place] == "truncated"
                steps.append(("K", torn, 1, role, text))
                steps += [("R", 2 + torn, 1, other, text) for other in ("user", "assistant")]
        for edit, price, taken, role, text in steps:
            said = roles if role is None else roles + role[:1]
            if role is not None and (role == "" or not re.fullmatch("(s?(ua)*u?)?", said)):
                continue
            more = lines if role is None else (*lines, f"{role}:{text}")
            heapq.heappush(heap, (cost + price, edits + edit, place + taken, said, more))
    raise AssertionError


def brute_force(rows):
    out = {}
    for conv_id, own in damaged(rows).items():
        marks = faults(own)
        turns = [turn for turn, _, _ in own if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(one[1][:1] + other[1][:1]) for one, other in zip(own, own[1:], strict=False)]
        cost, edits, lines = cheapest(own, marks)
        out[conv_id] = (
            gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
            sum(pair not in ("su", "ua", "au") for pair in pairs), cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(frame):
    out = {row[0]: tuple(row[1:]) for row in conversations.audit(conversations.damage(frame)).collect()}
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_table(spark, folder):
    frame = table(spark, f"/root/testdata/{folder}", "conversations").select("conv_id", "turn", "role", "text")
    assert found(frame) == brute_force([tuple(row) for row in frame.collect()])


def odd_rows(seed, conversations_, longest):
    rng = random.Random(seed)
    rows = []
    for conv_id in range(conversations_):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", "User", None, "s"])
            text = rng.choice(["Yes.", "No", "", " \n", "Why?\n", "Well  ", "É!", None, "x\x1c", f"Turn {turn}."])
            rows.append((conv_id, rng.choice([turn, turn, turn, turn + 5, None]), role, text))
    return rows


def test_odd_rows(spark):
    rows = odd_rows(1, 300, 9) + [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(frame) == brute_force(rows)


def test_long_conversations_are_cut(spark, monkeypatch):
    """Chunks of three rows and many tasks give what one search of the whole gives."""
    monkeypatch.setattr(conversations, "CHUNK", 3)
    rows = odd_rows(2, 40, 60)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute_force(rows)


def test_one_long_conversation(spark):
    roles = ["user", "assistant", "user"]
    rows = [(7, turn, roles[turn % 3], f"Words {turn % 700}.") for turn in range(3000)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute_force(rows)


def test_very_long_text_and_repeated_rows(spark):
    rows = [(1, 1, "user", "a" * 3_000_000 + "."), (1, 2, "assistant", "b. " * 10)] + [(2, 0, "user", "Hi.")] * 500
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute_force(rows)


def test_conversation_of_dropped_rows(spark):
    conv_id = next(one for one in range(1000) if crc32(f"{one}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark.createDataFrame([(conv_id, 0, "user", "Hi.")], SCHEMA)) == {conv_id: (0, 0, 0, 0, 0, 0, "", empty)}


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}


def test_failed_states_hold_for_greater_budgets():
    """One table serves all budgets: the edits are those of a fresh search."""
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randint(0, 8)
        roles = "".join(rng.choice("sua ") for _ in range(size))
        marks = "".join(rng.choice("---bdt") for _ in range(size))
        search = conversations.Repair(roles, marks, conversations.END)
        edits, cost = search.search(conversations.START)
        fresh = conversations.Repair(roles, marks, conversations.END)
        assert edits == fresh._from(0, conversations.START, cost)
        assert conversations.Repair(roles, marks, conversations.END)._from(0, conversations.START, cost - 1) is None
