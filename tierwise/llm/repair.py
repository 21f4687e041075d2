"""Conversation structure repair (12): Viterbi whose survivors settle as they meet.

The cheapest edits are found that turn a conversation's rows into an optional
system row followed by pairs of a user and an assistant row: Keep (0), Rerole to
user or assistant (2), Delete (3, and the only edit of a blank row or a repeat),
Insert an empty user or assistant row (2). A truncated row that stays adds 1. Of
equally cheap edits those whose initials, in order, come first in ASCII are taken.

A row changes four survivors: the cheapest edits that end in nothing yet, the
system row, a user row, an assistant row. Survivors are leaves of a tree of
backpointers, and a node counts its children and the survivors on it. A node that
loses the last of them is freed, and so on towards the root. As long as the root
has one child and no survivor, that child's edit is settled: it is given out, its
row let go, and the child becomes the root. Two survivors of one state and cost
are compared by their whole unsettled edits: the first ones that differ are the
children of their lowest common ancestor, found by jump pointers in a number of
steps that grows with the logarithm of the unsettled length. Neither is ever the
beginning of the other, as initials fix the state. A survivor whose cost is beyond
another's by more than any continuation can make good (``LEAD``) can't win and
goes, else the one that has deleted all so far would stay for good and nothing
could settle.

Spark does the rest: repeats are found by an aggregate over (conversation, role,
text hash) and a join, not by a set that one task holds; rows are dealt by
conversation and sorted by turn; tasks stream them. A task holds the unsettled
rows of one conversation, so a conversation of any length passes through. Rows of
one conversation meet in one task, as their order decides; the sort spills.

Defined cases: a null role or text is one space; rows with null turns come first;
rows of equal turn are taken by role, then text; a null id is an id like any
other; roles count by their first character, so one other than s, u and a can't be
kept; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, column, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits; what a truncated row adds that stays.
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: States: nothing kept yet, and the initial of the last row of the result.
NONE, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
NEXT = {(NONE, SYSTEM), (NONE, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: The role that may be put behind a state by Rerole or Insert.
FREE = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: LEAD[x, y]: what a continuation of x costs y more at most, as y can do the same
#: behind one inserted row, or where x keeps a system row, delete that row.
LEAD = {
    (NONE, ASSISTANT): 3, (NONE, USER): 5, (SYSTEM, ASSISTANT): 0, (SYSTEM, USER): 2, (USER, ASSISTANT): 2, (ASSISTANT, USER): 2,
}
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"


class Node:
    """One edit behind the edits of its parents."""

    __slots__ = ("parent", "jump", "depth", "edit", "row", "kids", "held")

    def __init__(self, parent, edit, row):
        self.parent, self.edit, self.row = parent, edit, row
        self.kids, self.held = [], 0
        if parent is None:
            self.depth, self.jump = 0, self
            return
        self.depth = parent.depth + 1
        near = parent.jump
        # jumps of 1, 3, 7, ... edits: the parent's jump and the next one, if they are equally long
        self.jump = near.jump if near.jump is not None and parent.depth - near.depth == near.depth - near.jump.depth else parent
        parent.kids.append(self)


class Repair:
    """The edits of one conversation, given out as soon as they are settled."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.root.held = 1
        self.best: dict[str, tuple[int, Node]] = {NONE: (0, self.root)}
        self._insert()

    # ----------------------------------------------------------- the tree

    def _less(self, x: Node, y: Node) -> bool:
        """Whether the unsettled edits of ``x`` come before those of ``y`` in ASCII."""
        floor = self.root.depth
        a, b = x, y
        while a.depth > b.depth:
            a = a.jump if a.jump.depth >= max(b.depth, floor) else a.parent
        while b.depth > a.depth:
            b = b.jump if b.jump.depth >= max(a.depth, floor) else b.parent
        if a is b:  # one is the other's beginning
            return x.depth < y.depth
        while a.parent is not b.parent:
            if a.jump.depth == b.jump.depth >= floor and a.jump is not b.jump:
                a, b = a.jump, b.jump
            else:
                a, b = a.parent, b.parent
        return a.edit < b.edit

    def _free(self, node: Node) -> None:
        while not node.kids and not node.held and node is not self.root:
            parent = node.parent
            parent.kids.remove(node)
            node.parent = node.jump = node.row = None
            node = parent

    def _offer(self, found: dict, state: str, cost: int, parent: Node, edit: str, row) -> None:
        """A survivor of ``state``, if it beats the one there."""
        now = found.get(state)
        if now is not None and now[0] < cost:
            return
        node = Node(parent, edit, row)
        if now is not None and now[0] == cost and not self._less(node, now[1]):
            self._free(node)
            return
        node.held = 1
        found[state] = (cost, node)
        if now is not None:
            now[1].held -= 1
            self._free(now[1])

    def _insert(self) -> None:
        """Inserts behind every survivor, until none gets cheaper."""
        todo = sorted(self.best, key=lambda s: self.best[s][0])
        while todo:
            state = todo.pop(0)
            cost, node = self.best[state]
            to = FREE[state]
            before = self.best.get(to)
            self._offer(self.best, to, cost + COST[INSERT], node, INSERT, to)
            if self.best[to] is not before and to not in todo:
                todo.append(to)

    # ------------------------------------------------------------- a row

    def add(self, role: str, fault: str | None, row) -> Iterator[tuple[str, object]]:
        """Takes a row, with its role's initial and fault; gives out (edit, row) that are settled."""
        before, found = self.best, {}
        stay = TRUNCATED if fault == CUT else 0
        for state, (cost, node) in before.items():
            self._offer(found, state, cost + COST[DELETE], node, DELETE, row)
            if fault in (BLANK, DUPLICATE):
                continue
            if (state, role) in NEXT:
                self._offer(found, role, cost + COST[KEEP] + stay, node, KEEP, row)
            to = FREE[state]
            self._offer(found, to, cost + COST[REROLE] + stay, node, REROLE, (row, to))
        self.best = found
        for _, node in before.values():
            node.held -= 1
            self._free(node)
        self._insert()
        beaten = [x for x, y in LEAD if x in self.best and y in self.best and self.best[x][0] > self.best[y][0] + LEAD[x, y]]
        for state in dict.fromkeys(beaten):
            _, node = self.best.pop(state)
            node.held -= 1
            self._free(node)
        return self._settled()

    def _settled(self) -> Iterator[tuple[str, object]]:
        while len(self.root.kids) == 1 and not self.root.held:
            old, self.root = self.root, self.root.kids[0]
            old.kids.clear()
            old.jump = None
            self.root.parent = None
            out, self.root.row = (self.root.edit, self.root.row), None
            yield out

    def end(self) -> tuple[int, Iterator[tuple[str, object]]]:
        """(cost, the edits left) of the cheapest survivor that is a whole conversation."""
        ends = [self.best[s] for s in (NONE, ASSISTANT) if s in self.best]
        cost, node = ends[0]
        for c, other in ends[1:]:
            if c < cost or (c == cost and self._less(other, node)):
                cost, node = c, other
        left = []
        while node is not self.root:
            left.append((node.edit, node.row))
            node = node.parent
        return cost, reversed(left)


# ------------------------------------------------------------------- Spark


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def faulty_rows(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, first, fault) of every row. ``fault`` is blank, truncated
    or null by the text alone; ``first`` is the first turn with that role and text."""
    role, text = _spaced(column(role_col)), _spaced(column(text_col))
    bare = F.trim(F.col("text"), F.lit(WHITESPACE))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT)
    out = rows.select(column(id_col).alias("conv"), column(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    out = out.withColumn("fault", fault).withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(7), "role", "text"))
    # a null turn sorts before all others, in a struct too
    seen = out.groupBy("conv", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1")
    seen = stored(seen.select(F.col("conv").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first"), "repeats")
    # only repeats have a partner; most conversations have none, so this side is small or split where it is hot
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    return out.join(seen, on, "left").select("conv", "turn", "role", "text", F.col("first")["turn"].alias("first"), F.col("first").isNotNull().alias("repeats"), "fault")


LAYOUT = "edit string, cost int, turn {turn}, old_role string, role string, text string, fault string"


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)


def _edits(batches: Iterable[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by conversation and turn; gives out their edits in order."""
    out: list[tuple] = []
    kinds: list[pa.DataType] = []
    now, state = object(), None
    last = None  # (turn, role, text) of the row before

    def told(conv, settled, cost=0):
        for edit, row in settled:
            to = None
            if edit == REROLE:
                row, to = row
            if edit == INSERT:
                out.append((conv, edit, COST[edit], None, None, ROLES[row], "", None))
                continue
            turn, role, text, fault = row
            new = None if edit == DELETE else role if edit == KEEP else ROLES[to]
            out.append((conv, edit, COST[edit] + (TRUNCATED if fault == CUT and edit != DELETE else 0), turn, role, new, text, fault))

    def flush():
        done = _batch(out, kinds, ["conv", "edit", "cost", "turn", "old_role", "role", "text", "fault"])
        out.clear()
        return done

    for batch in batches:
        text_kind = pa.string()
        kinds = [batch.schema.field("conv").type, text_kind, pa.int32(), batch.schema.field("turn").type, *[text_kind] * 4]
        for conv, turn, role, text, first, repeats, fault in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if state is None or conv != now:
                if state is not None:
                    told(now, state.end()[1])
                now, state, last = conv, Repair(), None
            if fault != BLANK and repeats and (turn != first or last == (turn, role, text)):
                fault = DUPLICATE
            last = (turn, role, text)
            told(conv, state.add(role[:1], fault, (turn, role, text, fault)))
            if len(out) >= size:
                yield flush()
    if state is not None:
        told(now, state.end()[1])
    if out:
        yield flush()


def repair_conversations(
    rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The edits of every conversation, one row each: (``id_col``, edit, cost, turn,
    old_role, role, text, fault). A deleted row has no role, an inserted one no turn,
    old_role and fault. Rows of a conversation are in one partition, in order."""
    types = {c: rows.schema[name].dataType.simpleString() for c, name in (("conv", id_col), ("turn", turn_col))}
    found = faulty_rows(rows, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = found.repartition("conv").sortWithinPartitions(*order)
    schema = f"conv {types['conv']}, " + LAYOUT.format(turn=types["turn"])
    return dealt.mapInArrow(_edits, schema).withColumnRenamed("conv", id_col)


# ------------------------------------------------------------------ reports

COUNTS = ["gaps", BLANK, DUPLICATE, CUT, "illegal", "cost"]


class _Summary:
    """What is told of one conversation, from its edits in order."""

    def __init__(self, conv):
        self.conv = conv
        self.of = dict.fromkeys(COUNTS, 0)
        self.audit, self.digest, self.kept = bytearray(), hashlib.sha256(), False
        self.role = self.least = self.most = None
        self.turns = 0

    def add(self, edit, cost, turn, old_role, role, text, fault) -> None:
        self.of["cost"] += cost
        self.audit += edit.encode()
        if fault:
            self.of[fault] += 1
        if old_role is not None:  # a row of the input
            if self.role is not None and self.role + old_role[:1] not in ("su", "ua", "au"):
                self.of["illegal"] += 1
            self.role = old_role[:1]
            if turn is not None and turn != self.most:  # turns ascend
                self.least, self.most = turn if self.least is None else self.least, turn
                self.turns += 1
        if edit != DELETE:
            self.digest.update((("\n" if self.kept else "") + f"{role}:{text}").encode())
            self.kept = True

    def row(self) -> tuple:
        if self.turns:
            self.of["gaps"] = self.most - self.least + 1 - self.turns
        return (self.conv, *self.of.values(), self.audit.decode(), self.digest.hexdigest())


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the edits of whole conversations; one row for each conversation."""
    now = None
    kinds: list[pa.DataType] = []
    names = ["conv", *COUNTS, "audit", "repaired_sha256"]
    for batch in batches:
        kinds = [batch.schema.field(0).type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        out = []
        for conv, *edit in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = _Summary(conv)
            now.add(*edit)
        if out:
            yield _batch(out, kinds, names)
    if now is not None:
        yield _batch([now.row()], kinds, names)


def report_repairs(edits: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``repair_conversations``, read in its order and
    partitions: (``id_col``, gaps between its turns, rows by fault, illegal neighbours,
    cost, audit: the edits' initials, repaired_sha256: of its ``role:text`` lines)."""
    schema = f"conv {edits.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return edits.toDF("conv", *edits.columns[1:]).mapInArrow(_report, schema).withColumnRenamed("conv", id_col)
