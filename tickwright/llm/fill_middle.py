"""Fill-in-the-middle: whole texts cut at two line ends and put together in another order.

A text is divided into blocks of a fixed number of code points.  A Fenwick tree over the blocks
holds how many lines end and how many code points lie in each.  To find the place after ``k``
lines, a descent by binary lifting skips whole blocks while fewer than ``k`` lines end in them;
only the block it stops at is searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.llm.common import in_batches, texts

BLOCK = 1024
#: What marks prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SPM_PERCENT = 7, 100, 50


class LineTree:
    """Fenwick tree over blocks of a text: rows are line ends and code points."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        starts = range(0, len(text), block)
        self.blocks = len(starts)
        counts = np.zeros((2, self.blocks + 1), dtype=np.int64)
        counts[0, 1:] = [text.count("\n", at, at + block) for at in starts]
        counts[1, 1:] = [min(block, len(text) - at) for at in starts]
        self.lines = int(counts[0].sum()) + (not text.endswith("\n") and text != "")
        # A node sums the blocks since the one that lacks its lowest bit.
        sums = counts.cumsum(axis=1)
        nodes = np.arange(self.blocks + 1)
        self.tree = (sums - sums[:, nodes - (nodes & -nodes)]).tolist()

    def after(self, lines: int) -> int:
        """Code points in the first ``lines`` lines."""
        if lines <= 0:
            return 0
        if lines >= self.lines:
            return len(self.text)
        ends, points = self.tree
        node, left, place = 0, lines, 0
        for bit in reversed(range(self.blocks.bit_length())):
            below = node + (1 << bit)
            if below <= self.blocks and ends[below] < left:
                node, left, place = below, left - ends[below], place + points[below]
        at = place - 1
        for _ in range(left):
            at = self.text.index("\n", at + 1)
        return at + 1


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 from the id; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at:at + 8], 16) for at in range(0, 32, 8)]


def transform(text: str, doc_id: int | None, seed: int = SEED, percent: int = PERCENT,
              spm_percent: int = SPM_PERCENT, block: int = BLOCK) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, prefix's and middle's code points, output) of one text."""
    tree = LineTree(text, block)
    first, second, whether, which = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= percent:
        return tree.lines, "plain", None, None, text
    low, high = sorted((first % (tree.lines + 1), second % (tree.lines + 1)))
    start, end = tree.after(low), tree.after(high)
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if which % 100 < spm_percent:
        return tree.lines, "spm", start, end - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return tree.lines, "psm", start, end - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(df: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT,
                   block: int = BLOCK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of (doc_id, text).

    ``n`` is the number of lines.  ``percent`` of 100 documents are transformed, ``spm_percent``
    of these with the suffix first.  A null text counts as empty; empty texts and texts that
    hold a mark stay plain, with null lengths.  A text without line breaks is one line, so its
    cuts are its ends.  Each row is decided by its id and text alone: repeated rows get the same
    result, null ids that of an empty id, and other columns are ignored.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_pylist()
        found = [transform(text, doc_id, seed, percent, spm_percent, block)
                 for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True)]
        lines, forms, prefixes, middles, outputs = zip(*found, strict=True) if found else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
             pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return in_batches(texts(df), cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again: marks occur exactly once each in what is not plain."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
