"""Spans of regular expressions as built-in expressions: code-point offsets, inside whole-stage code.

A match is put between two private-use marks by regexp_replace, the text is split at the first mark, and a fold over
the pieces turns their lengths into offsets. Marks that a text itself holds are replaced first, one character by one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "", ""
SPAN = "struct<start:int,end:int,value:string>"


def guarded(text: Column) -> Column:
    return F.translate(text, OPEN + CLOSE, "��")


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str) -> str:
    """The SQL of find_spans; one parsed expression is much cheaper to build than its many column calls."""
    # Unicode classes only where blanks or word characters are asked for: digits are ASCII after normalisation
    flags = "(?U)" if r"\s" in pattern or r"\w" in pattern else ""
    regex, a, b = quoted(flags + pattern), quoted(OPEN), quoted(CLOSE)
    none = f"cast(array() as array<{SPAN}>)"
    value = f"substring_index(p, {b}, 1)"
    span = f"array(named_struct('start', acc.at, 'end', acc.at + length({value}), 'value', {value}))"
    more = f"named_struct('at', acc.at + length(p) - 1, 'found', if(length({value}) > 0, concat(acc.found, {span}), acc.found))"
    step = f"(acc, p) -> if(acc.at is null, named_struct('at', length(p), 'found', acc.found), {more})"
    marked = f"regexp_replace(translate({text}, {quoted(OPEN + CLOSE)}, {quoted(chr(0xFFFD) * 2)}), {regex}, {quoted(OPEN + '$0' + CLOSE)})"
    found = f"aggregate(split({marked}, {a}), named_struct('at', cast(null as int), 'found', {none}), {step}, acc -> acc.found)"
    return f"if(coalesce({text} rlike {regex}, false), {found}, {none})"


def find_spans(text: str, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches in a column, in order; none for null."""
    return F.expr(spans_sql(f"`{text}`", pattern))


def context_sql(text: str, words: tuple[str, ...], window: int) -> str:
    first = f"greatest(s.start - {window}, 0)"
    return f"substring({text}, {first} + 1, s.end + {window} - {first}) rlike {quoted(any_of(words))}" if words else "false"


def has_context(text: Column, start: Column, end: Column, words: tuple[str, ...], window: int = 20) -> Column:
    """Whether one of the words stands within ``window`` characters before, in or after the span."""
    if not words:
        return F.lit(False)
    first = F.greatest(start - window, F.lit(0))
    return F.substring(text, first + 1, end + window - first).rlike(any_of(words))


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, words))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
