"""Token counts and packing against the tokenizer library."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest
from rows import TEXTS, empty_table, odd_rows, odd_table
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from tickwright.llm import bpe, packing, token_counts
from tickwright.llm.queries import QUERIES

VOCABULARY = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_of_all_prefixes_equal_the_library(library):
    draw = random.Random(1)
    parts = ["a", "b", "er", " ", "  ", "\n", "\t", "'re", "'s", "'ll", "'ve", "é", "ß", "中", "1", "23", "!", "?", " ", "\x1c", "\x85",
             "<|endoftext|>", "<|end", "the", "ing", " the", "\U0001f600", " "]
    counter = token_counts.counter(VOCABULARY)
    for _ in range(800):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert counter.text(text).tolist() == [len(ids_of(library, text[:n])) for n in range(len(text) + 1)], repr(text)
        assert np.frombuffer(bpe.ids_bytes(text, VOCABULARY), dtype="<u4").tolist() == ids_of(library, text)


def test_ids_equal_the_library_for_every_character(library):
    for start in range(0, 0x110000, 0x400):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)} 1{chr(c)}\n" for c in range(start, start + 0x400, 7) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(bpe.ids_bytes(text, VOCABULARY), dtype="<u4").tolist() == ids_of(library, text)


def test_token_counts_of_odd_rows(spark, library):
    found = token_counts.token_counts(odd_table(spark), limit=10).collect()
    assert len(found) == len(odd_rows())
    for row in found:
        text = TEXTS.get(row.doc_id, "no id here") or ""
        n = len(ids_of(library, text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 10)
        assert len(ids_of(library, text[:row.chars_in_limit])) <= 10
        if row.over_limit and row.doc_id not in (8, 9):
            assert all(len(ids_of(library, text[:n])) > 10 for n in range(row.chars_in_limit + 1, len(text) + 1))
    assert token_counts.token_counts(empty_table(spark)).count() == 0


def test_stored_counts_answer_prefix_and_budget_questions(spark, library):
    table = odd_table(spark).filter("doc_id IN (1, 4, 5, 10)").distinct()
    counts = token_counts.prefix_counts(table)
    asked = counts.select("doc_id", token_counts.tokens_in_prefix(F.col("counts"), 9).alias("nine"),
                          token_counts.tokens_in_prefix(F.col("counts"), 500).alias("beyond"),
                          token_counts.chars_within(F.col("counts"), 5).alias("five"))
    for row in asked.collect():
        text = TEXTS[row.doc_id] or ""
        assert row.beyond is None
        assert row.nine == (len(ids_of(library, text[:9])) if len(text) >= 9 else None)
        assert row.five == max(n for n in range(len(text) + 1) if len(ids_of(library, text[:n])) <= 5)


def check_packed(rows, texts, library, capacity):
    """``texts``: how often each (doc_id, text) occurs."""
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append((row.offset, row.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, group in texts.items():
        expected = collections.Counter()
        for text in group:
            ids = np.array([*ids_of(library, text), packing.END_ID], dtype="<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
            for piece, at in enumerate(cuts[:-1]):
                own = ids[at:cuts[piece + 1]]
                expected[(piece, at, len(own), zlib.crc32(own.tobytes()))] += 1
        assert collections.Counter((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc_id]) == expected
    return len(sequences)


def test_packing_of_odd_rows_is_a_round_trip(spark, library):
    texts = collections.defaultdict(list)
    for row in odd_rows():
        texts[row[0]].append(row[1])
    for capacity, bins, per_task in ((1024, 1 << 16, 100_000), (64, 3, 5)):
        rows = packing.pack_documents(odd_table(spark), capacity=capacity, open_bins=bins, pieces_per_task=per_task).collect()
        check_packed(rows, texts, library, capacity)
    assert packing.pack_documents(empty_table(spark)).count() == 0


@pytest.mark.parametrize("path", ["query", "pipeline"])
def test_first_piece_may_be_shorter(spark, library, path, tmp_path):
    n = {doc_id: len(ids_of(library, text)) + 1 for doc_id, text in TEXTS.items()}
    folder = str(tmp_path / "docs")
    odd_table(spark).filter("doc_id IN (1, 5, 8, 9)").dropDuplicates(["doc_id"]).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = (QUERIES["op8_best_fit_packing"](spark, folder) if path == "query" else corpus_pipeline.pack(spark, docs, folder)).collect()
    assert n[8] > 1024 and n[8] % 1024 and {r.doc_id for r in rows} == {1, 5, 8, 9}
    for doc_id in (1, 5, 8, 9):
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = np.array([*ids_of(library, TEXTS[doc_id]), packing.END_ID], dtype="<u4")
        assert [r.length for r in own] == [n[doc_id] % 1024 or 1024] + [1024] * (len(own) - 1)
        assert [r.start for r in own] == [sum(r.length for r in own[:at]) for at in range(len(own))]
        assert sum(r.length for r in own) == n[doc_id]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own)
        assert all(r.offset + r.length <= 1024 for r in own)


def test_bounds_of_pieces():
    for n in range(1, 20):
        bounds = packing.piece_bounds(n, 5)
        assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
        assert all(b - a == 5 for a, b in bounds[1:]) and 0 < bounds[0][1] <= 5


def test_packing_is_close_to_the_least_number_of_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = packing.pack_documents(docs).agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("n")).first()
    assert found.n <= 1.01 * (-(-found.tokens // 1024)) + 1


def test_open_bins_are_bounded_and_best_fit():
    draw = random.Random(2)
    for most in (1, 2, 7, 1000):
        bins, free, is_open = packing.OpenBins(50, most), {}, []
        for _ in range(400):
            length = draw.randint(1, 50)
            number, offset = bins.place(length)
            fitting = [b for b in is_open if free[b] >= length]
            if fitting:
                assert number in is_open and free[number] == min(free[b] for b in fitting)
            else:
                assert number not in free
                if len(is_open) >= most:
                    least = min(free[b] for b in is_open)
                    assert bins.open <= most
                    closed = [b for b in is_open if free[b] == least][-1]
                    is_open.remove(closed)
                free[number] = 50
                is_open.append(number)
            assert offset == 50 - free[number]
            free[number] -= length
            is_open.remove(number)
            if free[number]:
                is_open.append(number)
            assert bins.open == len(is_open) <= most
