"""Repair of damaged conversations: the cheapest edits after which the roles alternate.

A conversation is cut into chunks of a few turns. In a chunk the cheapest edits are found by
iterative-deepening A*. A conversation of one chunk is done with that; in a longer one every chunk
first tells what it costs from each state of the role pattern to each other one, the costs of all
that follows a chunk are added up from the end, and with them each chunk finds its own edits. So the
search of a long conversation is spread over many tasks; only sums of a chunk's 16 costs and the hash
over the repaired text follow the order of the turns, row by row, with nothing gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.session import pin

KINDS = 20
DROPPED, EMPTIED, UNSTOPPED, REPEATED, USER = range(5)
STOPS = "[.!?]"
FILLED = r"[^\x20\x09-\x0D]"
TRUNCATED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"

# Rows of a chunk.
CHUNK = 16
# States of the role pattern (s?(ua)+)?: at the start, after s, after u, after a. What each may read
# next, and the role that an inserted or changed turn gets there.
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
READS = [{"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U}]
WANTED = ["u", "u", "a", "u"]
ROLES = {"u": "user", "a": "assistant"}
# From each state to an accepted end by insertions alone.
END = (0, 4, 2, 0)
DELETE, INSERT, CHANGE, TORN = 3, 2, 2, 1
FAR = 1 << 40
# Faults of a row: none, blank, duplicate, truncated.
FINE, EMPTY, COPY, CUT = "-bdt"


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with some damaged, as the crc32 of ``conv_id:turn`` tells.

    Every row comes out once or, if it is repeated, twice, with ``kept`` false where it is dropped,
    so that conversations that lose all rows are known. A null role or text becomes one space, and a
    null conv_id or turn counts as one in the hash and stays null in the row.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % KINDS
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == EMPTIED, "").when(kind == UNSTOPPED, F.regexp_replace(text, STOPS, "")).otherwise(text)
    copies = F.when(kind == REPEATED, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == USER, "user").otherwise(role).alias("role"),
        text.alias("text"),
        (kind != DROPPED).alias("kept"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


class Repair:
    """Iterative-deepening A* over the edits of one chunk.

    ``roles`` has the initial of every row (a space where it is none of s, u, a) and ``faults`` its
    fault. ``rest`` tells what the turns after the chunk cost from each state in which it may end.
    """

    def __init__(self, roles: str, faults: str, rest: tuple[int, ...]):
        self.roles, self.faults, self.rest = roles, faults, rest
        # What the rows from each one on cost at least: a blank one or a copy has to go, and a
        # truncated one stays at a price or goes.
        self.least = [min(rest)]
        for fault in reversed(faults):
            self.least.append(self.least[-1] + (DELETE if fault in (EMPTY, COPY) else TORN if fault == CUT else 0))
        self.least.reverse()
        # By place and state the largest budget that is known not to do.
        self.failed: dict[tuple[int, int], int] = {}

    def search(self, state: int) -> tuple[str, int]:
        """The edits' initials and their cost with that of the rest, ``FAR`` if there are none."""
        # All rows deleted and two turns inserted, if no row has to be kept.
        most = DELETE * len(self.roles) + 2 * INSERT + max(one for one in self.rest if one < FAR)
        for budget in range(self.least[0], most + 1):
            found = self._from(0, state, budget)
            if found is not None:
                return found, budget
        return "", FAR

    def _from(self, place: int, state: int, budget: int) -> str | None:
        """The first edits in ASCII order from here on that cost no more than ``budget``."""
        if place == len(self.roles):
            return "" if self.rest[state] <= budget else None
        if self.least[place] > budget or self.failed.get((place, state), -1) >= budget:
            return None
        for edit, to, cost, step in self._edits(place, state):
            found = self._from(place + step, to, budget - cost)
            if found is not None:
                return edit + found
        self.failed[place, state] = budget
        return None

    def _edits(self, place: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, next state, cost, rows it takes) in ASCII order."""
        wanted = WANTED[state]
        yield "D", state, DELETE, 1
        yield "I", READS[state][wanted], INSERT, 0
        fault = self.faults[place]
        if fault not in (EMPTY, COPY):
            torn = TORN if fault == CUT else 0
            if self.roles[place] in READS[state]:
                yield "K", READS[state][self.roles[place]], torn, 1
            yield "R", READS[state][wanted], CHANGE + torn, 1


@lru_cache(maxsize=1 << 16)
def repair(roles: str, faults: str, state: int, rest: tuple[int, ...]) -> tuple[str, int]:
    return Repair(roles, faults, rest).search(state)


def costs(roles: str, faults: str) -> list[int]:
    """What the rows cost from each state (slow index) to each state."""
    return [_cost(roles, faults, start, end) for start in STATES for end in STATES]


def _cost(roles: str, faults: str, start: int, end: int) -> int:
    # Nothing leads back to the start, nor to the state after s but an s at the start.
    if end != start and (end == START or (end == AFTER_S and start != START)):
        return FAR
    return repair(roles, faults, start, tuple(0 if state == end else FAR for state in STATES))[1]


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(" ")


def _laid_out(damaged: DataFrame) -> DataFrame:
    """The rows in order, each with ``at``, which grows along it, and ``conv``, its conversation as a
    text that is never null.

    Rows of one turn are ordered by role and text; what still ties is the same row. The ``salt``
    lets equal rows be split over tasks.
    """
    names = ["conv_id", "turn", "role", "text", "kept"]
    salted = damaged.select(*names, F.monotonically_increasing_id().alias("salt"))
    order = [F.col(name).asc_nulls_first() for name in ("conv_id", "turn", "role", "text", "salt")]
    rows = salted.repartitionByRange(*order).sortWithinPartitions(*order)
    conv = F.concat_ws("=", F.lit(""), F.col("conv_id").cast("string")).alias("conv")
    turn = F.col("turn").cast("string").alias("turn")
    placed = rows.select(conv, turn, *names[2:], F.monotonically_increasing_id().alias("at"))
    return pin(placed, "turns")


def _faulty(rows: DataFrame) -> DataFrame:
    """conv, at, initial and fault of every kept row, in order."""
    kept = rows.where("kept")
    filled = F.col("text").rlike(FILLED)
    first = kept.where(filled).groupBy("conv", "role", "text").agg(F.min("at").alias("at"))
    told = kept.select(
        "conv",
        "at",
        _initial(F.col("role")).alias("initial"),
        filled.alias("filled"),
        F.col("text").rlike(TRUNCATED).alias("cut"),
    ).join(first.select("at", F.lit(True).alias("new")), "at", "left")
    fault = F.when(~F.col("filled"), EMPTY).when(F.col("new").isNull(), COPY).when(F.col("cut"), CUT).otherwise(FINE)
    told = pin(told.select("conv", "at", "initial", fault.alias("fault")), "faults")
    return told.repartitionByRange("at").sortWithinPartitions("at")


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of up to ``CHUNK`` consecutive rows of a conversation as strings, from sorted rows."""
    names, made = ["conv", "at", "roles", "faults"], []
    conv, at, roles, faults = None, None, "", ""
    for frame in frames:
        for row in zip(frame["conv"], frame["at"], frame["initial"], frame["fault"], strict=True):
            if row[0] != conv or len(roles) == CHUNK:
                if roles:
                    made.append((conv, at, roles, faults))
                conv, at, roles, faults = row[0], row[1], "", ""
            roles += row[2]
            faults += row[3]
        yield pd.DataFrame(made, columns=names)
        made = []
    if roles:
        yield pd.DataFrame([(conv, at, roles, faults)], columns=names)


def _with_costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["costs"] = [costs(*one) for one in zip(frame["roles"], frame["faults"], strict=True)]
        yield frame


def _with_rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cost of all that follows a chunk, by state; conversations come chunk by chunk from the end."""
    conv, rest = None, END
    for frame in frames:
        found = []
        for one, own in zip(frame["conv"], frame["costs"], strict=True):
            if one != conv:
                conv, rest = one, END
            found.append(rest)
            rest = tuple(min(int(own[4 * start + end]) + rest[end] for end in STATES) for start in STATES)
        frame["rest"] = [list(one) for one in found]
        yield frame.drop(columns="costs")


def _with_edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each state in which a chunk may be entered, its edits."""
    for frame in frames:
        frame["edits"] = [
            [repair(roles, faults, start, tuple(map(int, rest)))[0] for start in STATES]
            for roles, faults, rest in zip(frame["roles"], frame["faults"], frame["rest"], strict=True)
        ]
        yield frame.drop(columns=["roles", "rest"])


class Outcome:
    """One conversation, row by row in order: its counts, its edits and the hash of what they give."""

    def __init__(self, conv: str):
        self.conv = conv
        self.first = self.last = self.before = None
        self.turns = self.illegal = self.cost = self.lines = 0
        self.faults = dict.fromkeys((EMPTY, COPY, CUT), 0)
        self.state, self.audit, self.hash = START, [], hashlib.sha256()

    def chunk(self, edits: list[str], faults: str) -> None:
        """The rows that follow have these faults, and these edits by the state they begin in."""
        own = edits[self.state]
        self.audit.append(own)
        self.edits, self.marks = iter(own), iter(faults)
        for fault in self.faults:
            self.faults[fault] += faults.count(fault)

    def row(self, turn: str | None, role: str, text: str) -> None:
        if turn is not None:
            self.first = int(turn) if self.first is None else self.first
            self.turns += int(turn) != self.last
            self.last = int(turn)
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        torn = TORN if next(self.marks) == CUT else 0
        while (edit := next(self.edits)) == "I":
            self.insert()
        if edit == "D":
            self.cost += DELETE
        elif edit == "K":
            self.cost += torn
            self.say(role, text)
        else:
            self.cost += CHANGE + torn
            self.say(ROLES[WANTED[self.state]], text)

    def insert(self) -> None:
        self.cost += INSERT
        self.say(ROLES[WANTED[self.state]], "")

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.state = READS[self.state][role[0]]

    def result(self) -> tuple:
        while END[self.state]:
            self.insert()
            self.audit.append("I")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        faults = [self.faults[fault] for fault in (EMPTY, COPY, CUT)]
        return (self.conv, gaps, *faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
OUTCOME = ["conv", *COUNTS, "audit", "repaired_sha256"]


def _outcomes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, done = None, []
    for frame in frames:
        for row in frame.itertuples(index=False):
            if now is None or row.conv != now.conv:
                if now is not None:
                    done.append(now.result())
                now = Outcome(row.conv)
            if row.edits is not None:
                now.chunk(row.edits, row.faults)
            elif row.kept:
                now.row(None if pd.isna(row.turn) else row.turn, row.role, row.text)
        yield pd.DataFrame(done, columns=OUTCOME)
        done = []
    if now is not None:
        yield pd.DataFrame([now.result()], columns=OUTCOME)


def audit(damaged: DataFrame) -> DataFrame:
    """Per conversation its gaps, faults, the cost and initials of its cheapest repair, and the hash of
    the repaired text.

    ``damaged`` has conv_id, turn, role, text and ``kept``; rows that are not kept count for nothing,
    but their conversation is returned, with zeros, an empty audit and the hash of the empty string
    if it has no other rows. Rows go by turn, nulls first, those of one turn by role and text. Rows
    without a conv_id are one conversation. A role is told by its first character; one that starts
    with none of s, u and a (an empty one too) can only be changed or deleted. An empty table gives
    no rows.
    """
    rows = _laid_out(damaged)
    schema = "conv string, at long, roles string, faults string"
    chunks = pin(_faulty(rows).mapInPandas(_chunks, schema), "chunks")
    several = chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")
    end = F.array(*(F.lit(one).cast("long") for one in END)).alias("rest")
    single = chunks.join(several, "conv", "left_anti").select(*chunks.columns, end)
    chain = chunks.join(several, "conv", "left_semi")
    chain = pin(chain.mapInPandas(_with_costs, f"{schema}, costs array<long>"), "costs")
    chain = chain.repartition("conv").sortWithinPartitions("conv", F.col("at").desc())
    chain = pin(chain.mapInPandas(_with_rest, f"{schema}, rest array<long>"), "rests")
    # Long conversations lie together; their chunks are dealt anew for the search.
    both = single.unionAll(chain.repartition("at"))
    edits = both.mapInPandas(_with_edits, "conv string, at long, faults string, edits array<string>")
    stream = edits.unionByName(rows, allowMissingColumns=True)
    # A chunk comes right before its first row, which has the same place.
    stream = stream.repartition("conv").sortWithinPartitions("conv", "at", F.col("edits").isNull())
    found = stream.mapInPandas(
        _outcomes, f"conv string, {', '.join(f'{name} long' for name in COUNTS)}, audit string, repaired_sha256 string"
    )
    conv = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(damaged.schema["conv_id"].dataType)
    return found.select(conv.alias("conv_id"), *OUTCOME[1:])
