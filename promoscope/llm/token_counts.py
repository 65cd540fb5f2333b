"""Token counts of texts of any length, by overlap resynchronisation.

A text up to ``chunk_chars`` is encoded whole.  A longer one is cut into overlapping chunks; every
chunk is encoded alone, with the places where its tokens and its pre-tokens end.  Two neighbours are
spliced at the first place in their overlap where

* both chunks have a pre-token boundary (the pre-tokeniser scans from left to right and carries no
  state over a boundary, so from there on both see the same text in the same way),
* the left chunk's boundary is decided: it lies ``LOOKAHEAD`` characters or more before the chunk's
  end, so the cut cannot have moved it, and
* the tokens of both agree from there to the last such place.

Where a chunk pair has no such place (for example one unbroken run of letters longer than the
overlap), the left chunk is widened: its overlap is doubled and it is encoded again, until the pair
aligns or the chunk reaches the end of the text.  The count is therefore always that of the whole
text.  Strings of special tokens cut a text before anything else and count one token each.

The vocabulary is a file of byte-level BPE ranks, read by tiktoken on the executors; the counts are
those of the ``tokenizers`` file of the same vocabulary (tests compare them), which takes over where
tiktoken's pattern matcher runs out of stack: runs of white space of ``LONG_SPACE`` characters or more.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted alone;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import arrow_map, text_or_empty

LONG_SPACE = 100_000
_LONG_SPACE = regex.compile(rf"\s{{{LONG_SPACE}}}")
#: Characters after a boundary that can still change it (look-ahead and contractions).
LOOKAHEAD = 2


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE: file of ranks, pre-token pattern, special tokens, and the library's own file."""

    path: str
    pattern: str
    special: tuple[tuple[str, int], ...]
    library: str


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        with open(vocabulary.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=vocabulary.pattern,
                                          mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(vocabulary.pattern)
        self.library_path = vocabulary.library
        self.special = [s for s, _ in vocabulary.special]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.length[rank] = len(piece)

    @functools.cached_property
    def library(self) -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_file(self.library_path)

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)

    def segments(self, text: str) -> tuple[list[str], int]:
        """The texts between special tokens, and the number of these."""
        if not self.cut or not any(s in text for s in self.special):
            return [text], 0
        out = self.cut.split(text)
        return out, len(out) - 1


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


class Chunk:
    """A part of a text, encoded alone: its tokens, and its pre-token ends with the tokens up to each."""

    def __init__(self, enc: Encoder, text: str, start: int, end: int):
        self.start, self.end, self.last = start, min(end, len(text)), end >= len(text)
        part = text[self.start:self.end]
        self.tokens = np.asarray(enc.encode(part), np.int64)
        ends = np.cumsum(enc.length[self.tokens])  # in bytes
        chars = np.fromiter((m.end() for m in enc.pattern.finditer(part)), np.int64)
        raw = np.frombuffer(part.encode("utf-8"), np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)  # byte place of each character
        at = np.append(starts, len(raw))[chars]
        upto = np.searchsorted(ends, at, side="right")
        true = (upto > 0) & (ends[np.maximum(upto, 1) - 1] == at) if len(ends) else np.zeros(len(at), bool)
        if not self.last:
            true &= chars <= len(part) - LOOKAHEAD
        self.places, self.upto = chars[true] + start, upto[true]

    def tokens_at(self, place: int) -> int:
        return 0 if place == self.start else int(self.upto[np.searchsorted(self.places, place)])


def splice(left: Chunk, right: Chunk) -> int | None:
    """The first proven common place of two overlapping chunks, or None."""
    common = np.intersect1d(left.places, right.places, assume_unique=True)
    common = common[(common > right.start) & (common < left.end)]
    if not len(common):
        return None
    first, last = int(common[0]), int(common[-1])
    a = left.tokens[left.tokens_at(first):left.tokens_at(last)]
    b = right.tokens[right.tokens_at(first):right.tokens_at(last)]
    return first if np.array_equal(a, b) else None


def count_long(enc: Encoder, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text longer than a chunk."""
    total, done, at = 0, 0, 0  # done: the proven place up to which tokens are counted
    left = Chunk(enc, text, 0, chunk + overlap)
    while not left.last:
        at += chunk
        right = Chunk(enc, text, at, at + chunk + overlap)
        width = overlap
        while (place := splice(left, right)) is None or place <= done:
            width *= 2
            left = Chunk(enc, text, done, at + width)
            if left.last:
                break
            while at + chunk < left.end:  # the wider chunk covers the whole of the next one
                at += chunk
            right = Chunk(enc, text, at, max(at + chunk + overlap, left.end + overlap))
        else:
            total += left.tokens_at(place) - left.tokens_at(done)
            done, left = place, right
            continue
        break
    return total + len(left.tokens) - left.tokens_at(done)


def count(enc: Encoder, text: str, chunk: int, overlap: int) -> int:
    parts, total = enc.segments(text)
    for part in parts:
        total += len(enc.encode(part)) if len(part) <= chunk else count_long(enc, part, chunk, overlap)
    return total


def token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int, id_col: str = "doc_id",
                 text_col: str = "text", chunk_chars: int = 1 << 15,
                 overlap_chars: int = 512) -> DataFrame:
    """id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""
    schema = T.StructType([
        docs.schema[id_col], T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])
    text = text_or_empty(F.col(text_col))
    src = docs.select(F.col(id_col), text.alias("__text"),
                      F.octet_length(text).cast("long").alias("__bytes"))
    return arrow_map(src, counter(vocabulary, limit, chunk_chars, overlap_chars), schema)


def counter(vocabulary: Vocabulary, limit: int, chunk: int, overlap: int) -> Callable[[list], list]:
    def run(rows: list) -> list:
        enc = encoder(vocabulary)
        out = []
        for i, text, size in rows:
            n = count(enc, text, chunk, overlap)
            out.append((i, size, n, n > limit))
        return out

    return run
