"""Line deduplication against a plain dictionary of all runs."""

from __future__ import annotations

import collections
import random
import re

import pytest
from rows import TEXTS, empty_table, odd_rows, odd_table

import corpus_pipeline
from tickwright.llm import line_dedup


def brute(rows, least):
    """Removed lines by document: all runs that weigh enough and came before."""
    seen, removed = set(), collections.defaultdict(set)
    for doc, text in sorted(rows):
        lines = text.split("\n")
        for start in range(len(lines)):
            weight = 0
            for end in range(start, len(lines)):
                weight += max(1, len(re.findall(r"[^\x20\x09-\x0D]+", lines[end])))
                if weight >= least:
                    run = tuple(lines[start:end + 1])
                    if run in seen:
                        removed[doc] |= set(range(start, end + 1))
                    seen.add(run)
    return {doc: sorted(lines) for doc, lines in removed.items()}


def removed_of(frame):
    return {r.doc_id: r.removed for r in frame.collect() if r.removed}


@pytest.mark.parametrize(("seed", "least"), [(3, 4), (4, 9)])
def test_random_lines(spark, seed, least):
    draw = random.Random(seed)
    rows = [(at, "\n".join(draw.choice(["a", "b c", "d e f", "", "x"]) for _ in range(draw.randint(0, 14)))) for at in range(30)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least)
    assert removed_of(found) == brute(rows, least)
    for row in found.collect():
        assert row.kept_text == "\n".join(line for at, line in enumerate(row.text.split("\n")) if at not in row.removed)


def test_test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert removed_of(line_dedup.dedup_lines(docs)) == brute(rows, line_dedup.MIN_WORDS)


def test_odd_rows(spark):
    found = line_dedup.dedup_lines(odd_table(spark), 5)
    assert found.count() == len(odd_rows())
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].removed == [] and rows[2].removed == [0, 1] and rows[2].kept_text == ""
    assert rows[5].kept_text is None and rows[5].n_lines == 0
    assert rows[4].kept_text == "" and rows[8].removed == [] and rows[9].removed == []
    assert line_dedup.dedup_lines(empty_table(spark)).count() == 0


def test_stage_drops_what_was_nothing_but_copies(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one\n{passage}\nmore"), (2, f"two\n{passage}\nother"), (3, passage), (4, ""), (5, None), (6, "clean text"), (7, "clean text")]
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    found = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert found == {1: (rows[0][1], len(rows[0][1])), 2: ("two\nother", 9), 4: ("", 0), 5: (None, 0), 6: ("clean text", 10), 7: ("clean text", 10)}
    assert corpus_pipeline.lines(spark, empty_table(spark), "").count() == 0
    assert len(TEXTS) == 15
