"""Byte-level BPE inside tasks: exact ids of whole texts, and places where a text can be cut.

The merges are those of the rank file that belongs to the vocabulary; the test suite holds
the ids against the tokenizer library itself.  A space between two characters that are no
white space always begins a new piece of the pre-tokenizer's pattern, so a text can be cut
there and each part encoded alone.  Parts are mostly single words.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import struct

#: The vocabulary's own special token: a text is split at it, and it is one id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pre-tokenizer pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
MOST_PARTS, LONGEST_PART = 200_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(vocabulary: str):
    """The encoder of ``x.json`` by the ranks in ``x.tiktoken`` beside it."""
    import tiktoken

    with open(os.path.splitext(vocabulary)[0] + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def parts(text: str) -> list[str]:
    """Cut at spaces that have no white space on either side.  All parts but the first have
    lost the space before them."""
    words = len(text.split())
    if words == text.count(" ") + text.count("\n") + 1:  # each gap is one space or line feed
        return text.split(" ")
    return _CUT.split(text)


class Memory(dict):
    """A dict that fills itself by ``make`` and starts anew when it holds ``most`` entries."""

    def __init__(self, make, most: int = MOST_PARTS, longest: int = LONGEST_PART):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, part: str):
        value = self.make(part)
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[part] = value
        return value


def ids_bytes(text: str, vocabulary: str) -> bytes:
    """Ids of the whole text as little-endian unsigned 32-bit numbers."""
    encode = encoder(vocabulary)[0].encode_ordinary
    first, *others = (encode(segment) for segment in text.split(SPECIAL))
    for ids in others:
        first.append(SPECIAL_ID)
        first += ids
    return struct.pack(f"<{len(first)}I", *first)
