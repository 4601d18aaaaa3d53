"""Exact token counts at every prefix of a text, by prefix dynamic programming.

The count of a prefix is one more than the count of the prefix before its last token.  The last
token of a prefix is the one vocabulary entry that ends there and that the encoder leaves alone
beside the last token before it; exactly one has this property, so going through the prefixes
once gives all counts.  Texts are cut where a cut can't matter (see ``bpe``), and a bounded
memory keeps the counts of frequent parts.

With the counts stored, "how many tokens has this prefix" is a lookup and "the longest prefix
within a budget" a search in them; neither encodes again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.llm import bpe
from tickwright.llm.common import in_batches, texts

LIMIT = 1024
MOST_PAIRS = 300_000
#: White space as the tokenizers' pattern means it (Python's own also has the separators 1C-1F).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(bpe.PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
_GAP = regex.compile(f"[{_SPACE}]+")
#: Contractions of the pattern with more than one letter: one letter short they are two pieces.
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


class _Node:
    """A state of the automaton over the vocabulary: the longest suffix so far that begins a
    token.  ``tokens`` are the vocabulary's entries that end here, longest first."""

    __slots__ = ("suffix", "next", "tokens")

    def __init__(self, suffix: bytes, tokens: list[tuple[int, int]]):
        self.suffix, self.next, self.tokens = suffix, {}, tokens


class PrefixCounter:
    """Counts for parts of texts; one per task process and vocabulary."""

    def __init__(self, vocabulary: str):
        encoding, self.ranks = bpe.encoder(vocabulary)
        self.encode, self.encode_piece = encoding.encode_ordinary, encoding._encode_single_piece
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.beginnings = {token[:n] for token in self.ranks for n in range(1, len(token) + 1)}
        self.nodes: dict[bytes, _Node] = {}
        self.root = self._node(b"")
        self.pairs: dict[int, bool] = {}
        self.memory = bpe.Memory(lambda part: self._small(" " + part))

    def _node(self, suffix: bytes) -> _Node:
        if suffix not in self.nodes:
            ending = (suffix[at:] for at in range(len(suffix)))
            self.nodes[suffix] = _Node(suffix, [
                (len(t), self.ranks[t]) for t in ending if t in self.ranks and self.encode_piece(t) == [self.ranks[t]]])
        return self.nodes[suffix]

    def _step(self, node: _Node, byte: int) -> _Node:
        suffix = node.suffix + bytes([byte])
        while suffix not in self.beginnings:
            suffix = suffix[1:]
        node.next[byte] = self._node(suffix)
        return node.next[byte]

    def _apart(self, key: int) -> bool:
        """Does the encoder leave these two tokens apart?"""
        left, right = key >> 32, key & 0xFFFFFFFF
        apart = self.encode_piece(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[key] = apart
        return apart

    def piece(self, data: bytes) -> list[int]:
        """Counts of all byte prefixes of one piece, from the empty one on."""
        node, counts, last, pairs = self.root, [0], [0], self.pairs
        for end, byte in enumerate(data, 1):
            node = node.next.get(byte) or self._step(node, byte)
            for length, token in node.tokens:
                if length == end:
                    counts.append(1)
                    last.append(token)
                    break
                key = last[end - length] << 32 | token
                apart = pairs.get(key)
                if self._apart(key) if apart is None else apart:
                    counts.append(counts[end - length] + 1)
                    last.append(token)
                    break
        return counts

    def _by_character(self, piece: str) -> list[int]:
        data = piece.encode()
        counts = self.piece(data)[1:]
        return counts if len(data) == len(piece) else [n for n, byte in zip(counts, data[1:] + b"\0", strict=True) if byte & 0xC0 != 0x80]

    def part(self, part: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a part.

        A prefix that ends inside white space has the white space so far as one piece, whereas
        the pattern leaves the last character of a longer gap to what follows.
        """
        out, tokens = [0], 0
        for piece in _PIECE.findall(part):
            own = self._by_character(piece)
            if piece in _LONG_CONTRACTIONS:
                own[1] = 2
            out += [tokens + n for n in own] if tokens else own
            tokens += own[-1]
        if len(out) > 2:
            for gap in _GAP.finditer(part):
                start, end = gap.span()
                if end - start > 1:
                    out[start + 1:end + 1] = [out[start] + n for n in self._by_character(gap[0])]
        if not part.isascii() and max(part) > "\u024f" and tokens != len(self.encode(part)):
            # characters that Unicode versions class differently
            out[1:] = [len(self.encode(part[:n])) for n in range(1, len(part) + 1)]
        return out[1:]

    def _small(self, part: str) -> bytes:
        """Counts as bytes, empty if they don't fit."""
        counts = self._by_character(part) if part[1:].isalpha() and max(part) <= "\u024f" else self.part(part)
        return bytes(counts) if max(counts) < 256 else b""

    def segment(self, text: str) -> np.ndarray:
        """As ``part`` for any text without the special token."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        first, *rest = bpe.parts(text)
        small = list(map(self.memory.__getitem__, rest))
        head = np.asarray(self.part(first), dtype=np.int64)
        if b"" in small:  # a very long part
            whole = [head, *(np.asarray(self.part(" " + part), dtype=np.int64) for part in rest)]
            before = np.cumsum([0, *(own[-1] if len(own) else 0 for own in whole[:-1])])
            return np.concatenate(whole) + np.repeat(before, list(map(len, whole)))
        if not rest:
            return head
        counts = np.frombuffer(b"".join(small), dtype=np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, small), np.int64, len(small))
        tokens = counts[np.cumsum(lengths) - 1]
        before = np.cumsum(tokens) - tokens + (head[-1] if len(head) else 0)
        return np.concatenate((head, counts + np.repeat(before, lengths)))

    def text(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, 2, ... characters."""
        out, base = [np.zeros(1, dtype=np.int64)], 0
        segments = text.split(bpe.SPECIAL)
        for segment in segments[:-1]:  # a prefix that ends inside the special token is ordinary text
            own = self.segment(segment)
            through = base + (int(own[-1]) if len(own) else 0) + 1
            out += [base + self.segment(segment + bpe.SPECIAL[:-1]), np.array([through])]
            base = through
        out.append(base + self.segment(segments[-1]))
        return np.concatenate(out)


@functools.cache
def counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def prefix_counts(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, counts): ``counts[n]`` tokens in the text's first ``n`` code points, from 0 on.

    A null text counts as empty; every row gives a row; other columns are ignored.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = [counter(vocabulary).text(text) for text in batch.column("text").to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(c) for c in counts])))
        values = pa.array(np.concatenate(counts), pa.int32()) if counts else pa.array([], pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "counts"])

    return in_batches(texts(df), count, "doc_id long, counts array<int>")


def token_counts(df: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_in_limit) of every text, from the counts of
    all its prefixes; ``chars_in_limit`` is the longest prefix of at most ``limit`` tokens.

    The counts stay in the task, so that a row carries a few numbers; ``prefix_counts`` gives
    them whole.  A null text counts as empty; other columns are ignored.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens, within = [], []
        for text in batch.column("text").to_pylist():
            counts = counter(vocabulary).text(text)
            tokens.append(int(counts[-1]))
            within.append(len(counts) - 1 if counts[-1] <= limit else int(np.flatnonzero(counts <= limit)[-1]))
        n_bytes = pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), n_bytes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(within, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit"])

    return in_batches(texts(df), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long")


def tokens_in_prefix(counts: Column, n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` code points; null beyond the text's end."""
    return F.get(counts, n_chars if isinstance(n_chars, Column) else F.lit(n_chars))


def chars_within(counts: Column, budget: Column | int) -> Column:
    """Length of the longest prefix of at most ``budget`` tokens; null for a budget below 0."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return F.array_max(F.filter(F.transform(counts, lambda n, at: F.when(n <= limit, at)), lambda at: at.isNotNull()))
