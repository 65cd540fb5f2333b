"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Base patterns (leftmost, not overlapping, each kind alone): ``assign`` (a password or key name, a
separator and a value), ``access`` (access key ids) and ``hex`` (long hexadecimal runs).  Matches
that are too short are dropped after the scan, so they still take their place in it.

The method looks at every maximal run of 20 or more characters of ``[A-Za-z0-9+/_=-]``.  Natural
text costs few tokens per character under a BPE vocabulary; random strings cost many.  A run is a
``random`` span when its characters per token are below ``max_ratio``, unless

* it has the form of a known digest (hexadecimal of 32, 40, 56, 64, 96 or 128 digits) or a UUID,
* its parts are natural.  Parts are what lies between ``_``, ``-``, ``/``, ``=`` and ``+``; those without
  a letter do not count.  A part is natural if it is one token, has ``max_ratio`` characters a token, or
  reads like a word (long words of languages that the vocabulary splits into short pieces): its letters
  change case seldom, and vowels and consonants alternate, less the share of letters that are rare in
  words, by ``WORDLIKE`` or more; a piece of the alphabet is natural, too.  Natural parts must hold half of
  the characters, and no part may mix digits and letters over 8 characters or more.

Base spans stay as they are; of a run that they touch, the pieces of 20 or more characters that they
leave over are looked at like runs.

Spans count code points, end exclusive.

Defined cases: a null text is empty and has no span; texts are scanned whole; repeated rows are
scanned alone; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import arrow_map, text_or_empty
from promoscope.llm.token_counts import Vocabulary, encoder

# The base patterns; names are matched in either ASCII case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so the length can be part of the pattern
KINDS = ("assign", "access", "hex", "random")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))

_CLASS = "[A-Za-z0-9+/_=-]"
LEAST = 20  # characters of a run
CANDIDATE = re.compile(rf"(?<!{_CLASS}){_CLASS}{{{LEAST},}}")
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_PART = re.compile(r"[A-Za-z0-9]+")
VOWELS = frozenset("aeiouy")
RARE = frozenset("jqxzvwk")
WORDLIKE = 0.28  # random letters have 0.09 on average
CASE_CHANGES = 0.3  # of all pairs of letters; random letters have 0.5
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def known_form(run: str) -> bool:
    """A digest or a UUID."""
    return bool(_UUID.fullmatch(run) or _HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS)


def like_a_word(part: str) -> bool:
    """Whether letters alternate and repeat their case as those of words do, or are a piece of the alphabet."""
    pairs = list(zip(part, part[1:]))
    if not part.isalpha() or not pairs:
        return False
    if sum(ord(b) - ord(a) == 1 for a, b in pairs) >= 0.8 * len(pairs):
        return True
    if sum(a.isupper() != b.isupper() for a, b in pairs) > CASE_CHANGES * len(pairs):
        return False
    low = part.lower()
    change = sum((a in VOWELS) != (b in VOWELS) for a, b in zip(low, low[1:])) / len(pairs)
    return change - sum(c in RARE for c in low) / len(low) >= WORDLIKE


def natural_parts(run: str, enc, max_ratio: float) -> bool:
    """Whether the parts of a run look like words, as those of identifiers, paths and dates do."""
    parts = [p for p in _PART.findall(run) if _LETTER.search(p)]
    if any(len(p) >= 8 and _DIGIT.search(p) for p in parts):
        return False
    odd = 0
    for p in parts:
        tokens = len(enc.encode(p))
        odd += len(p) if tokens > 1 and len(p) < max_ratio * tokens and not like_a_word(p) else 0
    return 2 * odd <= sum(map(len, parts))


def uncovered(start: int, end: int, base: list) -> list[tuple[int, int]]:
    """The pieces of a run that no base span covers and that are long enough to be looked at."""
    out = []
    for s, _, e in base:
        if s < end and start < e:
            out.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if e - s >= LEAST]


def random_spans(text: str, base: list, enc, max_ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        for start, end in uncovered(m.start(), m.end(), base):
            run = text[start:end]
            if known_form(run):
                continue
            if len(run) < max_ratio * len(enc.encode(run)) and not natural_parts(run, enc, max_ratio):
                out.append((start, 3, end))
    return out


def say(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id",
                text_col: str = "text", max_ratio: float = 2.4) -> DataFrame:
    """id, number of spans of each kind, ``base_spans`` and ``spans`` as text, of every row."""
    schema = T.StructType([
        docs.schema[id_col],
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("base_spans", T.StringType()), T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ])
    src = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("__text"))

    def run(rows: list) -> list:
        enc, out = encoder(vocabulary), []
        for i, text in rows:
            base = base_spans(text)
            spans = sorted(base + random_spans(text, base, enc, max_ratio))
            n = [0] * len(KINDS)
            for _, k, _ in spans:
                n[k] += 1
            said = say(base)
            out.append((i, *n, said, hashlib.sha256(said.encode()).hexdigest(), say(spans)))
        return out

    return arrow_map(src, run, schema)
