"""Repair of conversation structure: cheapest edits by an auction for shortest paths."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import scratch

SPACE = r"\x20\x09-\x0D"
RENAME, REMOVE, ADD, CUT = 2, 3, 2, 1  # costs: rerole, delete, insert, an undeleted row with a cut end
# what the repaired roles have spelled so far: nothing, s, ...u, ...a
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the state behind the role that an insert or rerole gives
ROLE = {USER: "user", ASSISTANT: "assistant"}
MUST_GO, CUT_END = 4, 8  # bits of a row's code; the lower two say its role's initial
INITIALS = "sua"
GOAL = -1


@cache
def _arcs(code: int) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """Per state the edits `(letter, cost, rows taken, next state)` before or at a row with this code, by letter."""
    initial, extra = code & 3, CUT if code & CUT_END else 0
    table = []
    for state in range(4):
        after = FOLLOWS[state]
        edits = [("D", REMOVE, 1, state), ("I", ADD, 0, after)]
        if not code & MUST_GO:
            if state == NOTHING and initial == INITIALS.index("s"):
                edits.append(("K", extra, 1, SYSTEM))
            elif initial == INITIALS.index("u" if after == USER else "a"):
                edits.append(("K", extra, 1, after))
            edits.append(("R", RENAME + extra, 1, after))
        table.append(tuple(edits))
    return tuple(table)


#: Behind the last row: inserts, and the way out where the roles may end.
_LAST = tuple((*((("", 0, GOAL, state),) if state in (NOTHING, ASSISTANT) else ()), ("I", ADD, 0, FOLLOWS[state])) for state in range(4))


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of rows with these codes; of equally cheap ones the least in ASCII.

    Nodes are (rows taken, state). Prices never exceed an arc's cost plus the price at its end. Each auction
    starts a path at one node: if the price at the path's end is below the best offer of its arcs it rises to
    it and the path contracts by a node, else the path extends along the best arc. It ends at the goal
    or at a node an earlier auction has led to the goal from; then all arcs of the path are tight and its
    prices are distances. Auctions run from the last row to the first, and every node starts at the
    least price of the next row, so a path is never longer than a few nodes. With all prices
    settled the tight arcs are just those of cheapest edits, and the trace takes the least letter of them.
    """
    n = len(codes)
    price, settled = array("q", bytes(32 * (n + 1))), bytearray(4 * (n + 1))
    for row in range(n, -1, -1):
        arcs = _LAST if row == n else _arcs(codes[row])
        if row < n:
            low = min(price[4 * row + 4 : 4 * row + 8])
            price[4 * row : 4 * row + 4] = array("q", [low] * 4)
        for origin in range(4 * row, 4 * row + 4):
            path = [origin]
            while path[-1] != GOAL and not settled[path[-1]]:
                node = path[-1]
                best, end = min(_offers(arcs[node & 3], row, price))
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(end)
            for node in path:
                if node != GOAL:
                    settled[node] = 1
    letters, row, state = [], 0, NOTHING
    while True:
        arcs, here = _LAST if row == n else _arcs(codes[row]), price[4 * row + state]
        tight = [(letter, end) for (letter, cost, *_), (offer, end) in zip(arcs[state], _offers(arcs[state], row, price)) if offer == here]
        letter, end = min(tight)
        if end == GOAL:
            return price[0], "".join(letters)
        letters.append(letter)
        row, state = divmod(end, 4)


def _offers(arcs: tuple, row: int, price: array) -> list[tuple[int, int]]:
    """Per arc its cost and the price at its end, with that end."""
    return [(cost, GOAL) if taken == GOAL else (cost + price[4 * (row + taken) + state], 4 * (row + taken) + state) for _, cost, taken, state in arcs]


def _ordered(rows: DataFrame) -> DataFrame:
    """Conversations side by side, the rows of each in order; Spark sorts on disk where they do not fit."""
    return rows.repartition("key").sortWithinPartitions("key", "kind", F.asc_nulls_first("turn"), "role", "mark")


def _said(turns: DataFrame, key: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        F.col(key).alias("key"), F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("mark"),
    )


class _Report:
    """The faults of one conversation while its rows pass by."""

    def __init__(self, key: object) -> None:
        self.key, self.codes, self.seen = key, bytearray(), set()
        self.before: str | None = None
        self.turns: list = [None, None, 0]  # smallest, greatest, how many different ones
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, mark: str, blank: bool, whole: bool) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        initial = role[:1]
        if self.before is not None and (self.before, initial) not in (("s", "u"), ("u", "a"), ("a", "u")):
            self.illegal += 1
        self.before = initial
        known = (role, mark) in self.seen
        self.seen.add((role, mark))
        code = INITIALS.index(initial) if initial and initial in INITIALS else 3
        if blank or known:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
            code |= MUST_GO
        elif not whole:
            self.truncated += 1
            code |= CUT_END
        self.codes.append(code)

    def row(self) -> tuple:
        first, last, different = self.turns
        cost, audit = cheapest(bytes(self.codes))
        gaps = last - first + 1 - different if different else 0
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(turns: DataFrame, key: str = "conv_id", conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation `(key, gaps, blank, duplicate, truncated, illegal, cost, audit)`.

    Takes `turns` with `turn`, `role` and `text`; other columns are not read. Rows come in order of `turn`, null
    first; rows that share a turn are ordered by role and then by the MD5 of their text, so that equal
    ones are neighbours and reruns agree. Null roles and texts are one space. All rows with a null key are one
    conversation. `conversations` names keys that are to come back even without any row: they have no
    fault, cost 0 and no edits. An empty table gives an empty table.

    Each row's first fault counts: blank, duplicate (role and text seen earlier; texts are compared by MD5),
    truncated. `audit` spells the cheapest edits: Delete, Insert, Keep, Rerole. Sorted rows without their texts pass
    through a task one by one. A conversation's edits depend on all its rows, so one task sees them
    all, but holds some 250 bytes of each and never a text.
    """
    said = _said(turns, key)
    filled = F.col("text").rlike(rf"[^{SPACE}]")
    rows = said.select("key", "kind", "turn", "role", "mark", (~filled).alias("blank"), F.col("text").rlike(rf"[.!?][{SPACE}]*\z").alias("whole"))
    named = (turns if conversations is None else conversations.select(key).union(turns.select(key))).select(F.col(key).alias("key")).distinct()
    heads = named.select("key", F.lit(0).alias("kind"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:]))
    kind = turns.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (None, *[pa.int64()] * 6, pa.string())
            columns = [pa.array([r[k] for r in rows], kinds[k] or key_type) for k in range(8)]
            return pa.RecordBatch.from_arrays(columns, names=["key", *_FIELDS, "audit"])

        report, done, key_type = None, [], None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for name, head, turn, role, mark, blank, whole in zip(*(c.to_pylist() for c in batch.columns)):
                if not head:  # a conversation begins
                    if report is not None:
                        done.append(report.row())
                    report = _Report(name)
                else:
                    report.add(turn, role, mark, blank, whole)
            if done:
                yield out(done)
                done = []
        if report is not None:
            yield out([report.row()])

    schema = f"key {kind}, " + ", ".join(f"{f} bigint" for f in _FIELDS) + ", audit string"
    return _ordered(heads.unionByName(rows)).mapInArrow(run, schema).withColumnRenamed("key", key)


def repaired(turns: DataFrame, audit: DataFrame, key: str = "conv_id") -> DataFrame:
    """The rows `(key, position, turn, role, text, edit)` that the edits of `audits` leave or add.

    Rows of one conversation lie side by side and in order. Inserted ones have no turn and an empty text.
    Texts pass through the task one by one.
    """
    said = _said(turns, key)
    heads = audit.select(
        F.col(key).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"),
        F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("mark"),
    )
    kind = turns.schema[key].dataType.simpleString()
    names = ["key", "position", "turn", "role", "text", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, letters, at, state, position = None, "", 0, NOTHING, 0
        made: list[tuple] = []

        def put(turn: int | None, role: str | None, text: str, edit: str) -> None:
            nonlocal state, position
            state = SYSTEM if edit == "K" and state == NOTHING and role[:1] == "s" else FOLLOWS[state]
            made.append((now, position, turn, ROLE[state] if role is None else role, text, edit))
            position += 1

        def inserts() -> None:
            nonlocal at
            while at < len(letters) and letters[at] == "I":
                put(None, None, "", "I")
                at += 1

        def out() -> pa.RecordBatch:
            kinds = (key_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            rows, made[:] = list(made), []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for name, head, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "turn", "role", "text"))):
                if not head:
                    inserts()
                    now, letters, at, state, position = name, text, 0, NOTHING, 0
                else:
                    inserts()
                    edit = letters[at]
                    at += 1
                    if edit != "D":
                        put(turn, None if edit == "R" else role, text, edit)
            if made:
                yield out()
        inserts()
        if made:
            yield out()

    schema = f"key {kind}, position bigint, turn bigint, role string, text string, edit string"
    return _ordered(said.unionByName(heads)).mapInArrow(run, schema).withColumnRenamed("key", key)


def digests(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """`(key, repaired_sha256)` of the `role:text` lines of each conversation, as `repaired` lays them side by side."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda k, d: pa.RecordBatch.from_arrays([pa.array([k], key_type), pa.array([d.hexdigest()])], names=["key", "repaired_sha256"])
        now, digest, key_type = None, None, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for name, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield out(now, digest)
                    now, digest = name, hashlib.sha256()
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if digest is not None:
            yield out(now, digest)

    found = rows.select(key, "position", "role", "text").mapInArrow(run, f"key {kind}, repaired_sha256 string")
    return found.withColumnRenamed("key", key)


def damaged(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """`turns` with faults to repair, dealt by the CRC-32 of `key:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, question and exclamation marks, 3 repeats it,
    4 makes it the user's. Nulls count as one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt: Column = F.crc32(F.concat(text_of(key), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(dealt == 1, "").when(dealt == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    rows = turns.select(
        key, "turn", F.when(dealt == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.when(dealt == 0, 0).when(dealt == 3, 2).otherwise(1).alias("times"),
    )
    return rows.filter("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def repair(turns: DataFrame, key: str = "conv_id", conversations: DataFrame | None = None) -> DataFrame:
    """`audits` with `repaired_sha256` of what they lead to; without rows that of the empty text."""
    found = scratch(audits(turns, key, conversations), "audits")
    hashed = digests(repaired(turns, found, key), key).withColumnRenamed(key, "_key")
    empty = F.lit(hashlib.sha256().hexdigest())
    joined = found.join(hashed, found[key].eqNullSafe(hashed["_key"]), "left")
    return joined.drop("_key").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))
