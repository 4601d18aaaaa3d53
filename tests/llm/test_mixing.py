"""Mixing against a plain water-filling and one sorted list per source."""

from __future__ import annotations

import collections
import hashlib
import re

from rows import empty_table, odd_rows, odd_table

import corpus_pipeline
from checks.compare import connect, differences
from tickwright.llm import mixing
from tickwright.llm.queries import ORACLE, QUERIES


def brute(rows, weights=(5, 2, 1), most=3):
    """{source: (size, target)} by filling in rounds, and words taken per row."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for _, text, _ in rows]
    per = collections.Counter()
    for (_, _, source), n in zip(rows, size, strict=True):
        per[source] += n
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + ([None] if None in per else [])
    weight = {s: weights[at % len(weights)] for at, s in enumerate(names)}
    target, left, going = dict.fromkeys(names, 0.0), float(sum(per.values())), set(names)
    while going:
        share = {s: left * weight[s] / sum(weight[t] for t in going) for s in going}
        full = {s for s in going if share[s] >= most * per[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = float(most * per[s])
            left -= target[s]
        going -= full
    taken = {}
    for s in names:
        budget = round(target[s])
        epochs, rest = divmod(budget, per[s]) if per[s] else (0, 0)
        own = sorted((hashlib.md5(f"mix{'' if d is None else d}".encode()).hexdigest(), d or 0, n, at)
                     for at, ((d, _, source), n) in enumerate(zip(rows, size, strict=True)) if source == s)
        before = 0
        for _, _, n, at in own:
            taken[at] = epochs * n + max(0, min(n, rest - before))
            before += n
    return per, target, [taken[at] for at in range(len(rows))]


def test_plan_of_odd_rows(spark):
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    per, target, taken = brute(rows)
    found = mixing.mixing_plan(odd_table(spark), rows_per_range=3).collect()
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in found) == sorted(
        (d or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), n) for (d, t, _), n in zip(rows, taken, strict=True))
    for row in found:
        assert row.source_size == per[row.source] and abs(row.target - target[row.source]) < 1e-6
        assert row.taken <= 3 * row.size
    assert mixing.mixing_plan(empty_table(spark)).count() == 0


def test_limits_and_resharing(spark):
    rows = [(at, " ".join(["w"] * n), source) for at, (source, n) in enumerate(
        [("a", 1), ("b", 2), ("c", 500), ("c", 400), ("d", 10), ("e", 3), ("f", 0), (None, 4), ("b", 1)])]
    per, target, taken = brute(rows)
    assert target["a"] == 3 and target["b"] == 9
    found = {r.doc_id: r for r in mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [found[at].taken for at in range(len(rows))] == taken
    assert all(abs(sum(found[at].taken for at in range(len(rows)) if rows[at][2] == s) - target[s]) <= 0.5 for s in per)


def test_query_agrees_with_sql(spark, sf):
    assert differences(QUERIES["op9_source_mixing"](spark, sf), ORACLE["op9_source_mixing"], connect(sf)) is None


def test_stage_takes_what_the_plan_says(spark):
    for table in (odd_table(spark), empty_table(spark)):
        docs = table.drop("size").distinct()
        plan = {(r.doc_id, r.size, r.source): r.taken for r in mixing.mixing_plan(docs).collect()}
        mixed = corpus_pipeline.mix(spark, docs, "")
        assert mixed.columns == docs.columns
        words, texts = collections.Counter(), {r.doc_id: r.text for r in docs.collect()}
        for row in mixed.collect():
            words[row.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))
            assert (texts[row.doc_id] or "").startswith(row.text or "")
        assert all(words[d] == taken for (d, _, _), taken in plan.items())


def test_repeated_rows_at_the_cut_are_taken_alike(spark):
    """Ten equal rows and a budget inside them: all are cut alike, by the first one's place."""
    docs = spark.createDataFrame([(1, "a b c", "s")] * 10 + [(9, "x " * 60, "t")], "doc_id long, text string, source string")
    plan = mixing.mixing_plan(docs).collect()
    mixed = mixing.mix_documents(docs).collect()
    for source, repeats in (("s", 30), ("t", 60)):
        planned = sum(r.taken for r in plan if r.source == source)
        words = sum(len((r.text or "").split()) for r in mixed if r.source == source)
        assert planned <= words < planned + repeats
