"""Secret scan: three fixed patterns, and windows of high entropy per character class.

Entropy is looked at only in candidate strings, the longest runs of characters that secrets
are written in.  Within a candidate each class has its own runs, window and threshold; the
entropy of a sliding window follows from counts that change by one character in and one out.
Windows over the threshold are joined into spans.  An allow-list suppresses what only looks
random: of a span that overlaps it what lies within ``REACH``, or a candidate that is all names
and paths.  It never touches the spans of the fixed patterns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tickwright.llm.common import in_batches, texts

#: Fixed patterns; group 2 of an assignment has 6 characters or more, a key 20, a hex run 24.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: What an assignment's keyword must contain in lower case; texts without any are not searched.
_KEYWORDS = ("passw", "secret", "token", "key")

CANDIDATE_LENGTH = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``characters``; a window of ``window`` is high from ``bits`` of entropy on."""

    kind: str
    characters: str
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", "0-9a-f", 20, 3.0),
    CharacterClass("entropy_alnum", "A-Za-z0-9", 20, 3.7),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 4.0),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))

#: Strings that look random and are none: identifiers, examples, counting.
ALLOW = tuple(re.compile(p) for p in (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)example|sample|placeholder|changeme|dummy|x{8,}",
    r"0123456789|1234567890|abcdefghij|ABCDEFGHIJ",
))
#: Characters before and after an allowed string that it speaks for, about the length of a key.
REACH = 40
#: Names and paths; a whole candidate or nothing.
ALLOW_WHOLE = re.compile(r"(?:[A-Za-z]+[-_.=/+]+)+[A-Za-z]*")


def _runs(classes: tuple[CharacterClass, ...]) -> list[tuple[CharacterClass, re.Pattern]]:
    return [(c, re.compile(f"[{c.characters}]{{{c.window},}}")) for c in classes]


def entropy_spans(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy is at least ``bits`` and that hold both letters
    and digits."""
    term = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, digits, spans = 0.0, 0, []
    for at, character in enumerate(run):
        n = counts.get(character, 0)
        counts[character] = n + 1
        total += term[n + 1] - term[n]
        digits += character.isdigit()
        if at >= window:
            out = run[at - window]
            n = counts[out]
            counts[out] = n - 1
            total += term[n - 1] - term[n]
            digits -= out.isdigit()
        if at >= window - 1 and 0 < digits < window and math.log2(window) - total / window >= bits - 1e-9:
            start = at - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


def spans_beside(run: str, allowed: list[tuple[int, int]], window: int, bits: float) -> list[tuple[int, int]]:
    """``entropy_spans`` without what the allowed places of ``run`` suppress."""
    spans = []
    for start, end in entropy_spans(run, window, bits):
        at = start
        for begin, stop in sorted(place for place in allowed if start < place[1] and place[0] < end):
            until = min(begin - REACH, end)
            if until - at >= window:
                spans += [(at + a, at + b) for a, b in entropy_spans(run[at:until], window, bits)]
            at = max(at, stop + REACH)
        if at == start:
            spans.append((start, end))
        elif end - at >= window:
            spans += [(at + a, at + b) for a, b in entropy_spans(run[at:end], window, bits)]
    return spans


def find_secrets(text: str, classes: tuple[CharacterClass, ...] = CLASSES) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then by kind as listed."""
    found: list[tuple[int, str, int]] = []
    lowered = text.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if len(max(text.split(), key=len, default="")) >= CANDIDATE_LENGTH:
        for candidate in CANDIDATE.finditer(text):  # runs of keys and hex digits lie inside candidates
            own, base = candidate[0], candidate.start()
            found += [(base + m.start(), "access", base + m.end()) for m in ACCESS.finditer(own) if m.end() - m.start() >= LEAST_ACCESS]
            found += [(base + m.start(), "hex", base + m.end()) for m in HEX.finditer(own)]
            if ALLOW_WHOLE.fullmatch(own):
                continue
            allowed = [m.span() for pattern in ALLOW for m in pattern.finditer(own)]
            for kind, pattern in _runs(classes):
                for run in pattern.finditer(own):
                    at = run.start()
                    own_allowed = [(begin - at, stop - at) for begin, stop in allowed]
                    found += [(base + at + start, kind.kind, base + at + end)
                              for start, end in spans_beside(run[0], own_allowed, kind.window, kind.bits)]
    order = {kind: at for at, kind in enumerate(KINDS)}
    return sorted(found, key=lambda span: (span[0], order.get(span[1], len(order)), span[2]))


def scan_secrets(df: DataFrame) -> DataFrame:
    """(doc_id, findings) of every row: structs of kind, start and end (exclusive, code points).

    A null text counts as empty; repeated rows give a row each; other columns are ignored.
    """

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [[{"kind": kind, "start": start, "end": end} for start, kind, end in find_secrets(text)]
                 for text in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "findings"])

    return in_batches(texts(df), scan, "doc_id long, findings array<struct<kind:string,start:bigint,end:bigint>>")
