"""Column helpers that reproduce the survey programme's scalar semantics.

All helpers map Column -> Column and stay inside Catalyst / whole-stage codegen
(no Python UDF).  Semantics that differ from Spark built-ins:

* trim:   JavaScript trim strips every Unicode space separator, NBSP and BOM,
          Spark ``trim`` only U+0020 -> set-based ``trim``.
* parse:  integer-prefix parse ("9.7" -> 9, "8abc" -> 8, "x" -> NULL); Spark 4
          runs in ANSI mode, so a plain cast would raise -> regex + try_cast.
* round:  half toward +infinity (``floor(x + 0.5)``), not half away from zero.
* length: UTF-16 code units, not code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the characters JavaScript's String.prototype.trim removes.
JS_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# the same set as a Java regex character class
JS_WHITESPACE_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in JS_WHITESPACE) + "]"

INT_MAX = 2147483647


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """Strip JavaScript white space from both ends; NULL becomes ''."""
    return F.trim(F.coalesce(col_(c), F.lit("")), F.lit(JS_WHITESPACE))


def js_int_prefix(c: Column | str) -> Column:
    """``parseInt(s, 10)`` as DOUBLE (NULL for NaN) on an already trimmed string."""
    digits = F.regexp_extract(col_(c), r"^([+-]?[0-9]+)", 1)
    return digits.try_cast("double")


def js_round(x: Column) -> Column:
    """``Math.round``: ties go toward +infinity."""
    return F.floor(x + F.lit(0.5)).cast("double")


def js_round1(x: Column) -> Column:
    """``Math.round(x * 10) / 10``."""
    return F.floor(x * F.lit(10) + F.lit(0.5)).cast("double") / F.lit(10)


def js_round_to(x: Column, digits: int) -> Column:
    """``Math.round(x * 10^d) / 10^d``."""
    scale = 10 ** digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def utf16_len(c: Column | str) -> Column:
    """Length in UTF-16 code units (JavaScript ``String.length``)."""
    return (F.octet_length(F.encode(col_(c), "UTF-16BE")) / F.lit(2)).cast("int")


def utf16_len_gt(c: Column | str, k: int) -> Column:
    """``s.length > k`` without encoding long strings.

    UTF-16 length >= code-point length, so a code-point length above ``k``
    already decides; only short strings are re-encoded.
    """
    c = col_(c)
    return F.when(F.length(c) > k, F.lit(True)).otherwise(utf16_len(c) > k)


def utf16_len_capped(c: Column | str, cap: int) -> Column:
    """``Math.min(s.length, cap)`` in UTF-16 units, encoding short strings only."""
    c = col_(c)
    return F.when(F.length(c) >= cap, F.lit(cap)).otherwise(F.least(utf16_len(c), F.lit(cap)))


def js_number_str(x: Column) -> Column:
    """``String(x)`` for a finite double with at most a few decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def replace_first(c: Column, literal: str) -> Column:
    """``s.replace(literal, '')``: drop the first occurrence only."""
    import re

    return F.regexp_replace(c, "^(.*?)" + re.escape(literal), "$1")
