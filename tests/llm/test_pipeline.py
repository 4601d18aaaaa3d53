"""The pipeline as a whole: every stage works on all that its predecessor kept."""

from __future__ import annotations

from rows import odd_rows, odd_table

import corpus_pipeline
from tickwright.llm.queries import ORACLE, QUERIES


def test_stages_are_named_and_ordered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "mix", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert ORACLE.keys() <= QUERIES.keys() and sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, sf)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] and sizes[1] >= sizes[2] > sizes[3] > 0
    def fields(frame):
        return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())

    assert fields(corpus_pipeline.pack(spark, docs, sf)) == fields(corpus_pipeline.run(spark, sf))


def test_stages_take_odd_rows(spark):
    docs = odd_table(spark)
    for name, function in corpus_pipeline.STAGES[1:-1]:
        docs = function(spark, docs, "")
        assert 0 < docs.count() <= 3 * len(odd_rows()), name
    assert corpus_pipeline.pack(spark, docs, "").count() > 0
