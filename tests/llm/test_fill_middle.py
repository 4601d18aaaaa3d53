"""Fill-in-the-middle against cuts found by splitting the whole text, SQL and round trips."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from rows import TEXTS, empty_table, odd_rows, odd_table

from checks.compare import connect, differences
from tickwright.llm.fill_middle import LineTree, draws, fill_in_middle, restored, transform
from tickwright.llm.queries import ORACLE, QUERIES

LINES = re.compile(r"[^\n]*\n|[^\n]+")


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_places_of_all_lines(block):
    draw = random.Random(block)
    for size in (0, 1, 2, 5, 63, 64, 65, 300):
        text = "".join(draw.choice("ab\n\n中😀\r") for _ in range(size))
        tree, units = LineTree(text, block), LINES.findall(text)
        assert tree.lines == len(units)
        assert [tree.after(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_forms_of_one_text():
    text = "one\ntwo\n\nfour"
    for doc_id in range(60):
        first, second, _, which = draws(doc_id)
        units = LINES.findall(text)
        low, high = sorted((first % 5, second % 5))
        prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, 4)))
        form, output = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if which % 100 < 50 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
        assert transform(text, doc_id) == (4, form, len(prefix), len(middle), output)
        assert transform(text, doc_id, spm_percent=0)[1] == "psm" and transform(text, doc_id, percent=0) == (4, "plain", None, None, text)


def test_odd_rows(spark):
    rows = odd_rows()
    extra = spark.createDataFrame([(90, "a<M>b\nc"), (91, "tail<\nS>and <\nP>"), (92, "\n"), (93, "x" * 5000)], "doc_id long, text string")
    found = fill_in_middle(odd_table(spark).unionByName(extra, allowMissingColumns=True))
    found = found.withColumn("restored", restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows) + 4
    by_id = {r.doc_id: r for r in found}
    for doc_id, text in {**TEXTS, 91: "tail<\nS>and <\nP>", 92: "\n", 93: "x" * 5000}.items():
        row = by_id[doc_id]
        assert row.restored == (text or "") and row.n == len(LINES.findall(text or ""))
        assert (row.form == "plain") == (not text) == (row.prefix_chars is None)
        assert not text or len(row.output) == len(text) + 9
    assert by_id[90].form == "plain" and by_id[90].output == "a<M>b\nc" and by_id[None].restored == "no id here"
    assert fill_in_middle(empty_table(spark)).count() == 0


def test_query_agrees_with_sql(spark, sf):
    assert differences(QUERIES["op12_fill_in_middle"](spark, sf), ORACLE["op12_fill_in_middle"], connect(sf)) is None
