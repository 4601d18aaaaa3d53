"""Winnowing against a plain loop with the same hash."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from rows import TEXTS, empty_table, odd_rows, odd_table

from tickwright.llm import winnowing
from tickwright.llm.queries import QUERIES


def brute(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """(hash, position) of the kept grams by rolling hash and plain windows."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    hashes = [(h - (1 << 64) if h >= 1 << 63 else h) % winnowing.PRIME for h in hashes]
    if not hashes:
        return []
    if len(hashes) < gram:
        return None
    rolling, grams = 0, []
    for at, h in enumerate(hashes):
        rolling = (rolling * winnowing.BASE + h - (hashes[at - gram] * pow(winnowing.BASE, gram, winnowing.PRIME) if at >= gram else 0)) % winnowing.PRIME
        if at >= gram - 1:
            grams.append(rolling)
    kept = []
    for start in range(max(1, len(grams) - window + 1)):
        own = [(h, -at) for at, h in enumerate(grams[start:start + window], start)]
        best = min(own)
        if not kept or kept[-1] != (best[0], -best[1]):
            kept.append((best[0], -best[1]))
    return kept


def test_fingerprints_of_odd_rows(spark):
    found = winnowing.fingerprints(odd_table(spark)).collect()
    assert len(found) == len(odd_rows())
    for row in found:
        expected = brute(TEXTS.get(row.doc_id, "no id here") or "")
        if expected is None:
            assert len(row.hashes) == 1 and row.positions == [0]
        else:
            assert list(zip(row.hashes, row.positions, strict=True)) == expected
    assert winnowing.fingerprints(empty_table(spark)).count() == 0


@pytest.mark.parametrize(("gram", "window"), [(1, 3), (2, 5), (8, 4)])
def test_other_parameters(spark, gram, window):
    text = " ".join(f"w{i % 7}" for i in range(100))
    row = winnowing.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string"), gram, window).first()
    assert list(zip(row.hashes, row.positions, strict=True)) == brute(text, gram, window)
    assert sorted(set(b - a for a, b in zip(row.positions, row.positions[1:], strict=False)))[-1] <= window


def as_text(kept):
    return ",".join(f"{h:X}:{at}" for h, at in kept)


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_follow_the_ids(spark):
    rows = [(1, TEXTS[1]), (5, TEXTS[2]), (9, None), (12, TEXTS[8]), (40, TEXTS[10] + " " + TEXTS[1])]
    found = {r.doc_id: r for r in winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for at, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = found[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        kept, other, after = brute(text), brute(edited), brute(following)
        assert row.fingerprint == as_text(kept) and row.edited_fingerprint == as_text(other)
        assert row.near_edited == like(kept, other) and row.near_next == like(kept, after)
    assert found[1].near_next == 1.0


def test_edits_of_odd_rows(spark):
    found = winnowing.edited_fingerprints(odd_table(spark))
    assert found.count() == len(odd_rows())
    rows = found.collect()
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert winnowing.edited_fingerprints(empty_table(spark)).count() == 0


def test_texts_without_white_space_share_passages(spark):
    draw = random.Random(11)
    for alphabet in ([chr(0x4E00 + i) for i in range(2000)], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        passage, before, after = ("".join(draw.choices(alphabet, k=n)) for n in (60, 37, 101))
        changed = passage[:30] + "#" + passage[31:]
        rows = [(1, passage), (2, before + passage + after), (3, f"some words {passage} {after}"), (4, changed), (5, after)]
        found = {r.doc_id: set(r.hashes) for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found[1] & found[2] and found[1] & found[3] and found[1] & found[4] and not found[1] & found[5]
        assert len(found[1]) >= 60 // 8 - 1


def test_passages_of_385_characters_are_found(spark):
    draw = random.Random(12)
    rows, n = [], 40
    for at in range(n):
        longest = draw.choice([3, 9, 32, 33, 40, 500])
        passage, size = "", 0
        while size < 385:
            word = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=min(draw.randint(1, longest), 385 - size)))
            passage, size = passage + " " * bool(passage) + word, size + len(word)
        for side in (0, 1):
            around = ["".join(draw.choices("ABCDEFG ", k=draw.randint(0, 50))) for _ in range(2)]
            rows.append((2 * at + side, around[0] + passage + around[1]))
    found = {r.doc_id: set(r.hashes) for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[2 * at] & found[2 * at + 1] for at in range(n))


def test_query_finds_the_unchanged_half_of_short_texts(spark, tmp_path):
    draw = random.Random(13)
    texts = ["handkerchief", "an apple", "a quick brown fox", "it was a fine night for a cat of five", "QmFzZTY0IGlzIG5vdCB0ZXh0LCBidXQgaXQgaXM=",
             "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich und noch einmal zurück bis an das Meer"]
    texts += ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz    ", k=n)) for n in (4, 6, 30, 60, 120, 240)]
    rows = [(at, text if at % 2 == 0 else "0123456789" * 30) for at in range(2 * len(texts)) for text in [texts[at // 2]]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op1_winnowing"](spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for at, text in enumerate(texts):
        assert found[2 * at].near_edited > 0 and found[2 * at].near_next < 0.2, text
