"""Conversation structure: damage for training data, faults, and the cheapest repair.

A repaired conversation's role initials read ``(s?(ua)+)?``.  The repair is a dynamic programme
over the rows and the four places in that pattern; of repairs of equal cost the one whose audit
(the edits' initials in order) is least in ASCII wins.  Audits are not strings while it runs:
they are nodes of a tree that share their prefixes, each with a link to its ancestors 1, 2, 4, ...
edits back and a rolling hash.  Ties are compared by searching the longest common prefix along
those links; where hashes agree the nodes must be the same, or the prefixes are compared edit by
edit.

One conversation may hold much of the table, so it is not one group.  Rows are range-sorted by
conversation and turn; a task repairs what lies in its range, and for a conversation that goes
beyond it, gives the best audit from each place of the pattern to each.  Those few pieces are
put together per conversation, and the repaired rows are written out by ranges again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.llm.common import WORD, stage, with_package
from tickwright.session import Staged

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: Places in the pattern: nothing yet, after s, after u, after a.  It may end at the first and last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
PLACES = range(4)
_NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
_ROLE_AFTER = {START: "user", AFTER_S: "user", AFTER_A: "user", AFTER_U: "assistant"}
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Audits:
    """Edit sequences that share prefixes.  Node 0 is the empty one."""

    def __init__(self):
        self.edit, self.depth, self.hash, self.up, self.known = [""], [0], [0], [(0,)], {}

    def add(self, parent: int, edits: str) -> int:
        for edit in edits:
            node = self.known.get((parent, edit))
            if node is None:
                node = self.known[parent, edit] = len(self.edit)
                self.edit.append(edit)
                self.depth.append(self.depth[parent] + 1)
                self.hash.append((self.hash[parent] * _BASE + ord(edit)) % _PRIME)
                up, k = [parent], 0
                while up[k] and k < len(self.up[up[k]]):
                    up.append(self.up[up[k]][k])
                    k += 1
                self.up.append(tuple(up))
            parent = node
        return parent

    def _at_depth(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            gap = self.depth[node] - depth
            node = self.up[node][min(gap.bit_length(), len(self.up[node])) - 1]
        return node

    def _same(self, a: int, b: int) -> bool:
        """Equal sequences of equal length.  Hashes decide what differs; what seems equal is
        the same node, or else compared edit by edit."""
        if a == b or self.hash[a] != self.hash[b]:
            return a == b
        while a != b and self.edit[a] == self.edit[b]:
            a, b = self.up[a][0], self.up[b][0]
        return a == b

    def less(self, a: int, b: int) -> bool:
        """Is sequence ``a`` before ``b`` in ASCII order?"""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._at_depth(a, depth), self._at_depth(b, depth)
        if self._same(x, y):
            return self.depth[a] < self.depth[b]
        k = len(self.up[x]) - 1
        while k >= 0:
            if k < len(self.up[x]) and k < len(self.up[y]) and not self._same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
            k -= 1
        return self.edit[x] < self.edit[y]

    def text(self, node: int) -> str:
        edits = []
        while node:
            edits.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(edits))


Best = dict[int, tuple[int, int]]


def _offer(audits: Audits, best: Best, place: int, cost: int, parent: int, edits: str) -> None:
    held = best.get(place)
    if held is not None and held[0] < cost:
        return
    node = audits.add(parent, edits)
    if held is None or cost < held[0] or audits.less(node, held[1]):
        best[place] = (cost, node)


def with_inserts(audits: Audits, best: Best) -> Best:
    """The best audits per place once rows may be inserted; two in a row are the most that help."""
    best = dict(best)
    for _ in range(2):
        for place, (cost, node) in sorted(best.items()):
            role = _ROLE_AFTER[place]
            _offer(audits, best, _NEXT[place, role[0]], cost + COSTS[INSERT], node, INSERT)
    return best


def step(audits: Audits, best: Best, initial: str, fault: str, repeats: int) -> Best:
    """After one row and ``repeats`` equal rows that are duplicates of it."""
    after: Best = {}
    extra = TRUNCATED_COST if fault == "truncated" else 0
    for place, (cost, node) in with_inserts(audits, best).items():
        _offer(audits, after, place, cost + COSTS[DELETE], node, DELETE)
        if fault in ("blank", "duplicate"):
            continue
        if (place, initial) in _NEXT:
            _offer(audits, after, _NEXT[place, initial], cost + extra, node, KEEP)
        _offer(audits, after, _NEXT[place, _ROLE_AFTER[place][0]], cost + extra + COSTS[REROLE], node, REROLE)
    for _ in range(repeats):
        before, after = after, {}
        for place, (cost, node) in with_inserts(audits, before).items():
            _offer(audits, after, place, cost + COSTS[DELETE], node, DELETE)
    return after


def finish(audits: Audits, best: Best) -> tuple[int, int]:
    """(cost, audit) of the best complete repair."""
    final = with_inserts(audits, best)
    ends: Best = {}
    for place in (START, AFTER_A):
        if place in final:
            cost, node = final[place]
            held = ends.get(0)
            if held is None or cost < held[0] or (cost == held[0] and audits.less(node, held[1])):
                ends[0] = (cost, node)
    return ends[0]


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a row's id and turn decide, nulls of
    role and text being one space: of 20 remainders 0 drops the row, 1 empties its text, 2 takes
    its sentence ends, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"),
                     F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
                     (F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))
    return (rows.filter("fate <> 0").withColumn("copy", F.explode(copies))
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def fault_of(text: Column, is_repeat: Column) -> Column:
    """A row's first fault: blank, duplicate, truncated or none (empty)."""
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return (F.when(~text.rlike(WORD), "blank").when(is_repeat, "duplicate")
            .when(~last.isin(".", "!", "?"), "truncated").otherwise(""))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """(has, id, at, task, place, role, text, fault, repeats): unlike rows with how often each
    repeats, numbered by conversation, turn (nulls first), role and text over all tasks."""
    keyed = rows.select(F.col("conv_id").isNotNull().alias("has"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"),
                        F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn")).alias("at"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    unlike = keyed.groupBy("has", "id", "at", "role", "text").agg((F.count("*") - 1).alias("repeats"))
    unlike = stage(unlike.withColumn("digest", F.sha2("text", 256)), "repair-unlike")
    said = unlike.groupBy("has", "id", "role", "digest").agg(F.min("at").alias("first"))
    faulty = unlike.join(said, ["has", "id", "role", "digest"]).withColumn("fault", fault_of(F.col("text"), F.col("at") > F.col("first")))
    order = ["has", "id", "at", "role", "text"]
    ranged = faulty.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.select("has", "id", "at", "role", "text", "fault", "repeats", F.spark_partition_id().alias("task"),
                               F.monotonically_increasing_id().alias("place")), "repair-rows")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PIECES = ["has", "id", "task", "enter", "leave", "cost", "audit", *_COUNTS, "first", "last"]
_PIECES_SCHEMA = ("has boolean, id string, task int, enter int, leave int, cost long, audit string, blank long, duplicate long, "
                  "truncated long, illegal long, first string, last string")
_WHOLE = -1


def _legal(one: str, other: str) -> bool:
    return one + other in ("su", "ua", "au")


class _Piece:
    """The rows of one conversation in one task, as they come by."""

    def __init__(self, cut: bool):
        self.audits, self.cut = Audits(), cut
        self.best = {p: {p: (0, 0)} for p in (PLACES if cut else (START,))}
        self.counts, self.first, self.last = dict.fromkeys(_COUNTS, 0), None, ""

    def row(self, initial: str, fault: str, repeats: int) -> None:
        if fault:
            self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += repeats
        self.counts["illegal"] += repeats + (self.first is not None and not _legal(self.last, initial))
        self.first, self.last = initial if self.first is None else self.first, initial
        self.best = {enter: step(self.audits, leaves, initial, fault, repeats) for enter, leaves in self.best.items()}

    def found(self) -> list[tuple]:
        ends = tuple(self.counts.values()) + (self.first, self.last)
        if not self.cut:
            cost, node = finish(self.audits, self.best[START])
            return [(START, _WHOLE, cost, self.audits.text(node), *ends)]
        return [(enter, leave, cost, self.audits.text(node), *ends)
                for enter, leaves in self.best.items() for leave, (cost, node) in leaves.items()]


def _pieces(rows: DataFrame) -> DataFrame:
    """A conversation that lies in one task: its best audit (``leave`` -1).  One that goes over
    several: for each task the best from each place of the pattern to each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, piece, done = None, None, []
        for frame in frames:
            columns = [frame[c].tolist() for c in ("has", "id", "task", "cut", "initial", "fault", "repeats")]
            for has, conv, task, cut, initial, fault, repeats in zip(*columns, strict=True):
                if key != (has, conv, task):
                    if piece:
                        done += [(*key, *end) for end in piece.found()]
                    key, piece = (has, conv, task), _Piece(cut)
                piece.row(initial, fault, repeats)
            yield pd.DataFrame(done, columns=_PIECES)
            done = []
        if piece:
            yield pd.DataFrame([(*key, *end) for end in piece.found()], columns=_PIECES)

    # Only the first and last conversation of a task can go beyond it: no more rows than tasks.
    spread = rows.groupBy("has", "id").agg(F.min("task").alias("low"), F.max("task").alias("high")).filter("low < high")
    spread = stage(spread.select("has", "id", F.lit(True).alias("cut")), "repair-cut")
    thin = rows.select("has", "id", "task", "place", F.substring("role", 1, 1).alias("initial"), "fault", "repeats")
    thin = thin.join(F.broadcast(spread), ["has", "id"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    return with_package(thin.repartition("task").sortWithinPartitions("place")).mapInPandas(run, _PIECES_SCHEMA)


def _together(pieces: DataFrame) -> DataFrame:
    """The best audit of conversations in several pieces, and each task's part of it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        audits, best, ways = Audits(), {START: (0, 0)}, {}
        counts, last = dict.fromkeys(_COUNTS, 0), None
        frame = frame.sort_values("task", kind="stable")
        for task, own in frame.groupby("task", sort=False):
            after: Best = {}
            for enter, leave, cost, audit in own[["enter", "leave", "cost", "audit"]].itertuples(index=False):
                if enter in best:
                    held = after.get(leave)
                    _offer(audits, after, leave, best[enter][0] + cost, best[enter][1], audit)
                    if after.get(leave) != held:
                        ways[task, leave] = (enter, audit)
            head = own.iloc[0]
            for name in _COUNTS:
                counts[name] += int(head[name])
            counts["illegal"] += last is not None and not _legal(last, head["first"])
            last, best = head["last"], after
        cost, node = finish(audits, best)
        audit, parts = audits.text(node), []
        # Back from the place that only inserts may follow.
        for place, (before, held) in best.items():
            inserted = audits.depth[node] - audits.depth[held]
            if before + COSTS[INSERT] * inserted == cost and audit == audits.text(held) + INSERT * inserted:
                break
        tail = INSERT * inserted
        for task in reversed(frame["task"].unique().tolist()):
            place, piece = ways[task, place]
            parts.append({"task": task, "audit": piece + tail})
            tail = ""
        head = frame.iloc[0]
        return pd.DataFrame([(head["has"], head["id"], cost, audit, *counts.values(), parts)],
                            columns=["has", "id", "cost", "audit", *_COUNTS, "parts"])

    schema = ("has boolean, id string, cost long, audit string, blank long, duplicate long, truncated long, illegal long, "
              "parts array<struct<task:int,audit:string>>")
    return with_package(pieces).groupBy("has", "id").applyInPandas(run, schema)


def _walk(rows: DataFrame, parts: DataFrame, schema: str, open_one, row, close) -> DataFrame:
    """Rows stream by in order with their edits.  ``open_one()`` gives a conversation's state,
    ``row(state, edit, role, text)`` and ``close(state)`` give output rows."""
    names = ["has", "id", *[field.split()[0] for field in schema.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, task, place, audit, at, done = None, None, None, START, "", 0, []

        def inserts() -> None:
            nonlocal at, place
            while at < len(audit) and audit[at] == INSERT:
                role = _ROLE_AFTER[place]
                done.extend((*key, *out) for out in row(state, INSERT, role, ""))
                place, at = _NEXT[place, role[0]], at + 1

        for frame in frames:
            for has, conv, own_task, own_audit, role, text, repeats in zip(
                    *[frame[c].tolist() for c in ("has", "id", "task", "audit", "role", "text", "repeats")], strict=True):
                if key != (has, conv) or task != own_task:
                    if key is not None:
                        inserts()
                    if key != (has, conv):
                        if key is not None:
                            done.extend((*key, *out) for out in close(state))
                        key, state, place = (has, conv), open_one(), START
                    task, audit, at = own_task, own_audit, 0
                for _ in range(repeats + 1):
                    inserts()
                    edit, at = audit[at], at + 1
                    if edit != DELETE:
                        given = role if edit == KEEP else _ROLE_AFTER[place]
                        done.extend((*key, *out) for out in row(state, edit, given, text))
                        place = _NEXT[place, given[0]]
            yield pd.DataFrame(done, columns=names)
            done = []
        if key is not None:
            inserts()
            yield pd.DataFrame([*done, *((*key, *out) for out in close(state))], columns=names)

    edits = parts.select("has", "id", F.explode("parts").alias("part")).select("has", "id", "part.task", "part.audit")
    joined = rows.join(edits, ["has", "id", "task"]).repartition("has", "id").sortWithinPartitions("has", "id", "place")
    joined = joined.select("has", "id", "task", "audit", "role", "text", "repeats")
    return with_package(joined).mapInPandas(run, f"has boolean, id string, {schema}")


class Repair:
    """The cheapest repair of the conversations in ``rows`` (conv_id, turn, role, text).

    Rows are taken by turn (nulls first), then role and text; null roles and texts are one
    space, a null conversation is a conversation.  Rows that repeat conversation, turn, role and
    text follow each other and all but the first are duplicates.  Empty texts are blank, and a
    conversation of which all goes is empty.  Other columns are ignored; an empty table has no
    conversations.
    """

    def __init__(self, rows: DataFrame):
        self.kind = rows.schema["conv_id"].dataType
        self.rows = _sorted_rows(rows)
        pieces = stage(_pieces(self.rows), "repair-pieces")
        whole = pieces.filter(F.col("leave") == _WHOLE).select(
            "has", "id", "cost", "audit", *_COUNTS, F.array(F.struct("task", "audit")).alias("parts"))
        self.verdicts = stage(whole.unionByName(_together(pieces.filter(F.col("leave") != _WHOLE))), "repair-verdicts")

    def _named(self, found: DataFrame) -> DataFrame:
        named = F.when(F.col("has"), F.col("id")).cast(self.kind).alias("conv_id")
        return found.select(named, *[c for c in found.columns if c not in ("has", "id")])

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): the
        digest is that of the repaired ``role:text``, joined by line breaks."""

        def say(state: list, edit: str, role: str, text: str) -> list[tuple]:
            state[0].update(f"{chr(10) * state[1]}{role}:{text}".encode())
            state[1] = 1
            return []

        digests = _walk(self.rows, self.verdicts, "repaired_sha256 string", lambda: [hashlib.sha256(), 0], say,
                        lambda state: [(state[0].hexdigest(),)])
        turns = (self.rows.filter("at.has").groupBy("has", "id")
                 .agg((F.max("at.turn") - F.min("at.turn") + 1 - F.count_distinct("at.turn")).alias("gaps")))
        found = (self.verdicts.drop("parts").join(digests, ["has", "id"]).join(turns, ["has", "id"], "left")
                 .withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))))
        return self._named(found).select("conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")

    def repaired(self) -> DataFrame:
        """(conv_id, position, edit, role, text) of the repaired rows."""

        def number(state: list, edit: str, role: str, text: str) -> list[tuple]:
            state[0] += 1
            return [(state[0] - 1, edit, role, text)]

        found = _walk(self.rows, self.verdicts, "position long, edit string, role string, text string", lambda: [0], number, lambda state: [])
        return self._named(found)


def repair_damaged(df: DataFrame) -> DataFrame:
    """:meth:`Repair.summary` of the damaged rows of ``df``, one row for every conversation in
    it; one that the damage leaves without rows has zeros, no edits and the digest of nothing."""
    with Staged(df.sparkSession) as between:
        found = Repair(damage(df)).summary()
        everyone = df.select(F.struct("conv_id").alias("conv")).distinct()
        joined = everyone.join(found.withColumn("conv", F.struct("conv_id")).drop("conv_id"), "conv", "left")
        result = stage(joined.select(
            F.col("conv.conv_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), "repair")
        between.take_last()
    return result
