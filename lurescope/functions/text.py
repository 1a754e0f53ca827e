"""Scalar helpers shared by the operators (all built-in Spark expressions)."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def _char_class(pred) -> str:
    """A Java/RE2 character class of every code point where ``pred`` holds.

    Built from a rule (Python's own string predicates) rather than listed, so
    it always agrees with the Python semantics we reproduce.
    """
    ranges = []
    start = prev = None
    for cp in range(sys.maxunicode + 1):
        if pred(chr(cp)):
            if start is None:
                start = prev = cp
            elif cp == prev + 1:
                prev = cp
            else:
                ranges.append((start, prev))
                start = prev = cp
    if start is not None:
        ranges.append((start, prev))
    parts = []
    for a, b in ranges:
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    return "[" + "".join(parts) + "]"


# Python's str.isspace() / str.isdigit() sets, as regex classes.
PY_SPACE_CLASS = _char_class(str.isspace)
PY_DIGIT_CLASS = _char_class(str.isdigit)
PY_SPACES = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


def py_strip(c: Column) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace (linear in the text)."""
    return F.btrim(c, F.lit(PY_SPACES))


def py_round(c: Column, places: int) -> Column:
    """``round(x, places)`` as Python does it: half-even on the exact binary value.

    ``round``/``bround`` work on a decimal approximation and disagree with
    Python on ~0.5% of scores; DecimalFormat rounds the exact double.
    """
    pattern = "0." + "0" * places if places > 0 else "0"
    return F.call_function("format_number", c, F.lit(pattern)).cast("double")


_DAY_MICROS = 86_400_000_000


def floor_days(later: Column, earlier: Column) -> Column:
    """``(later - earlier).days`` -- whole days, floored (negative ages give -1)."""
    d = F.unix_micros(later) - F.unix_micros(earlier)
    return ((d - F.pmod(d, F.lit(_DAY_MICROS))) / F.lit(_DAY_MICROS)).cast("int")


def count_char(c: Column, ch: str) -> Column:
    """Occurrences of one literal character."""
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("int")


def regex_alternation(words) -> str:
    """An alternation of literal words (quoted for the regex engine)."""
    import re
    return "|".join(re.escape(w) for w in words)
