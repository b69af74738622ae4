"""Conversation structure repair: the cheapest edits to a legal sequence of roles.

Rows of a conversation are steps of a line graph whose states say what the repaired
roles are so far: nothing, a system turn, an open user turn, an answered one. Keeping,
changing the role of, deleting and inserting rows are arcs of small integer costs.
Dial's bucket queue takes nodes by distance from the legal ends, one bucket a distance
and as many buckets as the dearest step; the recorded distances mark the tight arcs,
and a walk along them that always takes the ASCII-least edit gives the audit.

Rows of a conversation stream in order through one task, as its digest is one
sequential hash; of a long conversation the task holds a byte a row, since distances
are recorded ``SEGMENT`` rows at a time between rows whose distances are kept. The rows
then stream a second time past their audit and come out repaired, so no texts are held.
Repeats are numbered by a window, which spills.

Defined cases: nulls are one space (in the key that picks the damage as well), rows of a null
conversation id are one conversation; rows of equal turn follow role, then text, rows
with a null turn come first; repeated rows all stay, each after the first a duplicate;
a very long text is one row, the largest thing that is held; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_BLANK, STOPS = r"[^\x20\x09-\x0D]", ".!?"
EMPTY, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after a role of this initial, where it is legal.
AFTER = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
#: The role that a state asks for, of those that edits can give.
WANTED = {EMPTY: "user", SYSTEM: "user", ASKED: "assistant", ANSWERED: "user"}
LEGAL_END = {EMPTY, ANSWERED}
LEGAL_PAIRS = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Exits of a segment lie at most two insertions apart, more than any arc costs.
BUCKETS = 2 * INSERT + 1
SEGMENT = 4096
#: A row as a byte: its role's initial, then whether it must go, and whether it is cut short.
INITIALS = {"s": 1, "u": 2, "a": 3}
MUST_GO, CUT_SHORT = 4, 8
FAR = 1 << 60


def arcs(mark: int | None) -> list[list[tuple[str, int, bool, int]]]:
    """Of a row, from each state: (edit, cost, whether it takes the row, next state), ASCII-least first."""
    out = []
    for state in range(4):
        wanted = AFTER[state, WANTED[state][0]]
        found = [("I", INSERT, False, wanted)]
        if mark is not None:
            found.insert(0, ("D", DELETE, True, state))
            if not mark & MUST_GO:
                extra = TRUNCATED if mark & CUT_SHORT else 0
                initial = " sua"[mark & 3]
                if (state, initial) in AFTER:
                    found.append(("K", KEEP + extra, True, AFTER[state, initial]))
                found.append(("R", REROLE + extra, True, wanted))
        out.append(found)
    return out


#: By row byte, and for the place after the last row.
ARCS = {mark: arcs(mark) for mark in (None, *range(16))}
#: By row byte and state reached: (state left, cost), across the row; and the same along a place.
ACROSS = {m: [[(s, c) for s in range(4) for _, c, takes, to in ARCS[m][s] if takes and to == t] for t in range(4)] for m in range(16)}
ALONG = [[s for s in range(4) if ARCS[None][s][0][3] == t] for t in range(4)]


def distances(marks: bytes, ends: list[int]) -> list[list[int]]:
    """Dial: the least cost from each state before each row, and after the last, to the ends that cost ``ends``."""
    n = len(marks)
    found = [[FAR] * 4 for _ in range(n + 1)]
    base = min(ends)
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(BUCKETS)]
    for state, cost in enumerate(ends):
        if cost - base < BUCKETS:
            found[n][state] = cost
            buckets[(cost - base) % BUCKETS].append((n, state))
    cost, waiting = base, sum(map(len, buckets))
    while waiting:
        bucket = buckets[(cost - base) % BUCKETS]
        while bucket:
            i, state = bucket.pop()
            waiting -= 1
            if found[i][state] != cost:
                continue
            steps = [(i, s, INSERT) for s in ALONG[state]]
            if i:
                steps += [(i - 1, s, c) for s, c in ACROSS[marks[i - 1]][state]]
            for j, s, c in steps:
                if cost + c < found[j][s]:
                    found[j][s] = cost + c
                    buckets[(cost + c - base) % BUCKETS].append((j, s))
                    waiting += 1
        cost += 1
    return found


def walk(marks: bytes, found: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """(edits, state reached): the ASCII-least way along tight arcs, insertions after the last row only if ``last``."""
    at, edits = 0, []
    while at < len(marks) or last:
        options = ARCS[marks[at] if at < len(marks) else None][state]
        step = next(((e, takes, to) for e, cost, takes, to in options if found[at][state] == cost + found[at + takes][to]), None)
        if step is None:
            break
        edits.append(step[0])
        at, state = at + step[1], step[2]
    return "".join(edits), state


def cheapest(marks: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equal ones the ASCII-least audit."""
    segments = [marks[i : i + SEGMENT] for i in range(0, len(marks), SEGMENT)] or [b""]
    exits = [[0 if s in LEGAL_END else FAR for s in range(4)]]
    for segment in reversed(segments):
        found = distances(segment, exits[-1])
        exits.append(found[0])
    exits.reverse()
    state, audit = EMPTY, []
    for k, segment in enumerate(segments):
        found = found if len(segments) == 1 else distances(segment, exits[k + 1])
        edits, state = walk(segment, found, state, k == len(segments) - 1)
        audit.append(edits)
    return exits[0][EMPTY], "".join(audit)


class Conversation:
    """Counts of faults and a byte a row of a conversation whose rows stream by."""

    def __init__(self, conv_id):
        self.conv_id, self.marks = conv_id, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.initial = None

    def add(self, turn: int | None, role: str, copies: int, blank: bool, short: bool, seen: bool) -> None:
        if turn is not None and turn != self.last_turn and copies:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        initial = role[:1]
        for copy in range(copies):
            again = not blank and (seen or copy > 0)
            cut = short and not blank and not again
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
            self.illegal += self.initial is not None and self.initial + initial not in LEGAL_PAIRS
            self.initial = initial
            self.marks.append(INITIALS.get(initial, 0) + MUST_GO * (blank or again) + CUT_SHORT * cut)

    def rows(self) -> list[tuple]:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return [(gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(bytes(self.marks)))]


class Repaired:
    """A conversation's rows after its audit, which comes before them."""

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.at, self.place, self.state, self.done = conv_id, "", 0, 0, EMPTY, []

    def _put(self, role: str, text: str) -> None:
        self.state = AFTER[self.state, role[0]]
        self.done.append((self.place, role, text))
        self.place += 1

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(WANTED[self.state], "")

    def add(self, audit: str | None, role: str, text: str, copies: int) -> None:
        self.audit = audit or self.audit
        for _ in range(copies):
            self._insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self._put(role if edit == "K" else WANTED[self.state], text)

    def rows(self) -> list[tuple]:
        self._insert()
        return self.so_far()

    def so_far(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


class Lines:
    """SHA-256 of ``role:text`` lines joined by newlines."""

    def __init__(self, conv_id):
        self.conv_id, self.hash, self.between = conv_id, hashlib.sha256(), ""

    def add(self, place: int, role: str, text: str) -> None:
        self.hash.update(f"{self.between}{role}:{text}".encode())
        self.between = "\n"

    def rows(self) -> list[tuple]:
        return [(self.hash.hexdigest(),)]


def _by_conversation(start: Callable, fields: list[tuple[str, pa.DataType]]):
    """Streams rows that lie together by conversation; ``start`` makes what takes a conversation's rows and gives its result rows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, kind = None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(next(columns), kind), *(pa.array(c, t) for (_, t), c in zip(fields, columns, strict=True))], names=["conv_id", *(name for name, _ in fields)])

        for batch in rows:
            done, kind = [], batch.schema.field("conv_id").type
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        done += [(open_.conv_id, *r) for r in open_.rows()]
                    open_ = start(conv_id)
                open_.add(*row)
            if isinstance(open_, Repaired):
                done += [(open_.conv_id, *r) for r in open_.so_far()]
            if done:
                yield made(done)
        if open_ is not None and (done := [(open_.conv_id, *r) for r in open_.rows()]):
            yield made(done)

    return run


_AUDIT = [*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]
_TURN = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def _fields(rows: DataFrame, fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join([f"conv_id {rows.schema['conv_id'].dataType.simpleString()}", *(f"{name} {'string' if t == pa.string() else 'long'}" for name, t in fields)])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): by each row's checksum none, emptied, unpunctuated, twice or of another role."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, faults, cost, audit) of the conversations in rows (conv_id, turn, role, text, copies); rows of no copies count for nothing."""
    blank: Column = ~F.col("text").rlike(NOT_BLANK)
    short = ~F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")).rlike(r"[.!?]\z")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("copies") == 0, F.asc_nulls_first("turn"))
    dealt = rows.repartition("conv_id").withColumns({"blank": blank, "short": short, "seen": F.row_number().over(same) > 1})
    ordered = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", "copies", "blank", "short", "seen")
    return ordered.mapInArrow(_by_conversation(Conversation, _AUDIT), _fields(rows, _AUDIT))


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the conversations as their audits leave them, each in order in one partition."""
    names = ["conv_id", "audit", "turn", "role", "text", "copies"]
    first = found.select("conv_id", "audit", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")), F.lit(0).alias("copies"))
    both = first.unionByName(rows.filter("copies > 0").withColumn("audit", F.lit(None).cast("string")).select(names))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_by_conversation(Repaired, _TURN), _fields(rows, _TURN))


def with_digests(found: DataFrame, turns: DataFrame) -> DataFrame:
    """``found`` with the digest of each conversation's repaired turns, as ``repaired_turns`` streams them."""
    digest = [("repaired_sha256", pa.string())]
    digests = turns.mapInArrow(_by_conversation(Lines, digest), _fields(turns, digest)).withColumnRenamed("conv_id", "of")
    joined = found.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
