"""Quality rules, line first: bad lines go, then documents that lost too much of their text.

A line of a text (split at \\n) fails by the first of these rules that it breaks:

* ``navigation``: it has as many ``|``, ``»`` or ``>`` separators as ``nav_separators`` or more, and one for
  every ``words_per_separator`` words at least, or it consists of a few words that are all menu words;
* ``boilerplate``: it contains one of the fixed phrases of site furniture and has at most
  ``furniture_words`` words (an article may name its privacy policy);
* ``punctuation``: none of its words ends like a sentence or clause in any script that has such marks
  (prose that was cut off has such words before its end), unless it is a line of wrapped prose; or most of
  its words end in symbols or doubled marks.  A line of ``wrapped_words`` words or more is wrapped prose if
  the next line goes on in lower case, or if it begins in lower case itself and the line before it does
  not end a sentence.

Lines without a word neither pass nor fail and stay.  Failing lines are removed; a document whose
removed lines hold more than ``max_lost`` of its word characters is rejected.  A document is also
rejected by the base rules: fewer than ``min_words`` words, or too many repeated words.

Defined cases: a null text is an empty text (0 words, rejected by ``min_words``); repeated rows are
each judged alone; a text is judged whole, however long; an empty table gives an empty result.  Only
the id and text columns are read, so extra or clashing columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import SPACE_CHARS, WORD, arrow_map, text_or_empty

# Menu words and phrases of site furniture (lower case).
MENU_WORDS = frozenset("""
home login logout menu search next previous contact about register sitemap share tweet
subscribe newsletter archive categories tags faq help top back more
""".split())
FURNITURE = (
    "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled",
    "privacy policy", "terms of service", "terms of use", "accept cookies", "lorem ipsum",
    "sign up for our", "click here to", "skip to content",
)
SENTENCE_END = frozenset(".!?…:;\"'”’»)]。！？：；」』｡।॥۔؟؛։።፧។៕၊။๚๛༎")
LOWER_START = r"[a-z\u00DF-\u00F6\u00F8-\u00FF\u03B1-\u03C9\u0430-\u045F]"  # letters in lower case
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost: float = 0.5
    nav_separators: int = 2
    words_per_separator: int = 8
    menu_words: int = 6
    furniture_words: int = 25
    wrapped_words: int = 5
    odd_words: float = 0.5


_WORD = re.compile(WORD)
_SYMBOL = re.compile(SYMBOLS)
_ODD = frozenset("#*$%&|<>!?")
_SEPARATOR = re.compile(r"[|»>]")


_LOWER = re.compile(LOWER_START)


def line_fault(line: str, words: list[str], rules: LineRules, before: list[str] = [], after: list[str] = []) -> str | None:
    """The rule that a line with words breaks, or None.  ``before`` and ``after``: words of the lines around it."""
    separators = len(_SEPARATOR.findall(line))
    if separators >= rules.nav_separators and separators * rules.words_per_separator >= len(words):
        return "navigation"
    if len(words) <= rules.menu_words and all(w.lower() in MENU_WORDS for w in words):
        return "navigation"
    if len(words) <= rules.furniture_words:
        low = line.lower()
        if any(p in low for p in FURNITURE):
            return "boilerplate"
    if not any(w[-1] in SENTENCE_END for w in words):
        return None if wrapped(words, rules, before, after) else "punctuation"
    odd = sum(1 for w in words if w[-1] in _ODD and w[-2:-1] in _ODD)
    return "punctuation" if odd > rules.odd_words * len(words) else None


def wrapped(words: list[str], rules: LineRules, before: list[str], after: list[str]) -> bool:
    if len(words) < rules.wrapped_words:
        return False
    if after and _LOWER.match(after[0]):
        return True
    return bool(before) and before[-1][-1] not in SENTENCE_END and bool(_LOWER.match(words[0]))


def repeated_words(words: list[str]) -> int:
    """Words within windows of three words that occur twice or more, first ones included."""
    seen = Counter(zip(words, words[1:], words[2:]))
    if len(seen) == max(0, len(words) - 2):
        return 0
    n = end = 0
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if seen[window] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def judge(text: str | None, rules: LineRules) -> tuple:
    """All columns of ``line_quality`` after the id."""
    text = text or ""
    kept, faults, seen = [], [], set()
    words: list[str] = []
    dup = lost = chars = 0
    lines = text.split("\n")
    of = [_WORD.findall(line) for line in lines]
    for at, (line, own) in enumerate(zip(lines, of)):
        if not own:
            kept.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        words += own
        n = sum(map(len, own))
        chars += n
        if fault := line_fault(line, own, rules, of[at - 1] if at else [], of[at + 1] if at + 1 < len(of) else []):
            faults.append(fault)
            lost += n
        else:
            kept.append(line)
    repeat = repeated_words(words)
    base = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    ok = not base and lost <= rules.max_lost * chars
    cleaned = text if not faults else "\n".join(kept)
    by = Counter(faults)
    return (len(words), chars, len(_SYMBOL.findall(text)), dup, repeat, base, ok,
            by["navigation"], by["boilerplate"], by["punctuation"],
            lost / chars if chars else 0.0, cleaned)


OUTPUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("n_navigation", T.LongType()),
    T.StructField("n_boilerplate", T.LongType()), T.StructField("n_punctuation", T.LongType()),
    T.StructField("lost_share", T.DoubleType()), T.StructField("cleaned", T.StringType()),
])


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: the id, the counts, the verdict and the cleaned text."""
    fields = OUTPUT.fields if with_text else OUTPUT.fields[:-1]
    schema = T.StructType([docs.schema[id_col], *fields])
    width = len(fields)
    src = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("__text"))
    return arrow_map(src, lambda rows: [(i, *judge(t, rules)[:width]) for i, t in rows], schema)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that pass, every column kept, ``text`` cleaned and ``n_chars`` its length."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__kept", T.BooleanType())])
    at = docs.columns.index("text")

    def run(rows):
        out = []
        for row in rows:
            got = judge(row[at], rules)
            if got[6]:
                out.append((*row[:at], got[-1], *row[at + 1:], True))
        return out

    out = arrow_map(docs, run, schema).drop("__kept")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
