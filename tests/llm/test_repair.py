"""Conversation repair against a plain search over strings, SQL, and small tasks."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from tickwright.llm import repair
from tickwright.llm.queries import ORACLE, QUERIES

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id string, turn long, role string, text string, cost int, audit string, place int, `at` string, has boolean, id int, task int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else text.translate({ord(c): None for c in ".!?"}) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by uniform-cost search over whole audit strings."""
    seen, faults = set(), []
    for role, text in rows:
        stripped = text.strip(SPACES)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, lines = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines, faults
        if (at, last) in done:
            continue
        done.add((at, last))
        moves = [(5, "I", 0, name[0], f"{name}:") for name in ("user", "assistant") if name[0] in follow[last]]
        if at < len(rows):
            role, text = rows[at]
            extra = 5 if faults[at] == "truncated" else 0
            moves.append((2, "D", 1, last, None))
            if faults[at] not in ("blank", "duplicate"):
                if role[:1] and role[0] in follow[last]:
                    moves.append((extra, "K", 1, role[0], f"{role}:{text}"))
                moves += [(1 + extra, "R", 1, name[0], f"{name}:{text}") for name in ("user", "assistant") if name[0] in follow[last]]
        for more, edit, step, to, line in moves:
            heapq.heappush(queue, (cost + more, audit + edit, at + step, to, lines if line is None else (*lines, line)))


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [(r[2], r[3]) for r in own]
        cost, audit, lines, faults = cheapest(pairs)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs))
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                       faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def rows_of(seed, conversations=60, most=14):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "And so on", "", None, "  \t", "What?  ", "a.b", "é…", "中。", "x" * 50 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "unknown", "User"]
    rows = []
    for conv in [*[f"c{i}" for i in range(conversations)], None, ""]:
        for turn in range(draw.randint(1, most)):
            where = draw.choice([turn, turn, turn, turn, None, turn + 5, 3])
            rows.append((conv, where, draw.choice(roles[:draw.choice([3, 5, 10])]), draw.choice(texts)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "K", 2, "x", True, 3, 4) for r in rows], SCHEMA)


def as_dict(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = frame.collect()
    found = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_repairs(spark, seed):
    rows = rows_of(seed)
    assert as_dict(repair.repair_damaged(table(spark, rows))) == expected(rows)


def test_one_conversation_over_many_tasks(spark):
    """Most rows in one conversation, cut into ranges, with its repeats spread over them."""
    draw = random.Random(5)
    rows = [("hot", draw.choice([at, at, at // 9]), draw.choice(["system", "user", "assistant", "assistant"]),
             draw.choice([f"t{at % 50}.", f"t{at}", f"t{at}!", "", "Same."])) for at in range(700)] + rows_of(6, 20)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_dict(repair.repair_damaged(table(spark, rows))) == expected(rows)
        whole = repair.Repair(repair.damage(table(spark, rows)))
        assert whole.verdicts.filter("id = 'hot' AND size(parts) > 5").count() == 1
        lines = [f"{r.role}:{r.text}" for r in whole.repaired().filter("conv_id = 'hot'").orderBy("position").collect()]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == expected(rows)["hot"][-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_empty_and_vanished(spark):
    assert repair.repair_damaged(table(spark, []).limit(0)).count() == 0
    gone = next(f"g{i}" for i in range(1000) if zlib.crc32(f"g{i}:0".encode()) % 20 == 0)
    found = as_dict(repair.repair_damaged(table(spark, [(gone, 0, "user", "Hi.")])))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_order_of_audits():
    audits, draw = repair.Audits(), random.Random(3)
    words = ["".join(draw.choice("DIKR") for _ in range(draw.randint(0, 40))) for _ in range(150)]
    words += [w[:-1] + draw.choice("DIKR") for w in words if w] + [w + "I" for w in words]
    nodes = [audits.add(0, w) for w in words]
    assert [audits.text(n) for n in nodes] == words
    for (a, x), (b, y) in itertools.product(zip(words, nodes, strict=True), repeat=2):
        assert audits.less(x, y) == (a < b)


def test_equal_hashes_are_verified():
    """With all hashes equal, order must come from the edits themselves."""
    audits = repair.Audits()
    nodes = {w: audits.add(0, w) for w in ("KKDK", "KKDR", "KKIK", "KK", "KKD", "DKKK")}
    audits.hash = [0] * len(audits.hash)
    for a, b in itertools.product(nodes, repeat=2):
        if len(a) == len(b):
            assert audits._same(nodes[a], nodes[b]) == (a == b)
            assert audits.less(nodes[a], nodes[b]) == (a < b)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    assert differences(QUERIES["op11_conversation_repair"](spark, folder), ORACLE["op11_conversation_repair"], connect(folder)) is None


def test_damage_is_that_of_the_row_key(spark):
    rows = rows_of(9)
    found = sorted(((r.conv_id, r.turn, r.role, r.text) for r in repair.damage(table(spark, rows)).collect()), key=str)
    assert found == sorted(damaged(rows), key=str)
    assert table(spark, rows).filter(F.col("conv_id").isNull()).count() > 0
