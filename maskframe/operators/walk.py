"""Strings at any depth of JSON text, without parsing into a schema.

In valid JSON a quoted literal never lies inside another, so one pattern finds every string, key or value, at every
depth; the spans let values be replaced in place. This stays inside the row and inside built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.spans import find_spans

from .by_session import with_session_pairs
from .detect import detections
from .rules import Rule
from .scan import Finder, folded

LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
UUID_ONLY = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def unquoted(literal: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]


def strings(body: str) -> Column:
    """array<struct<start, end, is_key, value>> of a JSON text column, in order. A key's colon is found behind any blanks."""
    found = find_spans(body, LITERAL + r"[ \t\r\n]*+:?")

    def one(s: Column) -> Column:
        literal = F.regexp_replace(s["value"], r"[ \t\r\n]*:?$", "")
        return F.struct(s["start"], (s["start"] + F.length(literal)).alias("end"), s["value"].endswith(":").alias("is_key"), unquoted(literal).alias("value"))

    return F.transform(found, one)


def numbers(body: Column) -> Column:
    """Numbers outside strings, as written."""
    return F.regexp_extract_all(F.regexp_replace(body, LITERAL, '""'), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+\-]?[0-9]+)?)"), F.lit(1))


def leaves(df: DataFrame, keys: list[str], body: str, with_numbers: bool = False) -> DataFrame:
    """keys, kind (key, value, number), value: one row a string (and number, if asked for)."""
    found = F.transform(strings(body), lambda s: F.struct(F.when(s["is_key"], F.lit("key")).otherwise(F.lit("value")).alias("kind"), s["value"].alias("value")))
    if with_numbers:
        found = F.concat(found, F.transform(numbers(F.col(body)), lambda n: F.struct(F.lit("number").alias("kind"), n.alias("value"))))
    return df.select(*keys, F.inline(found))


def transform_values(body: str, change: Callable[[Column], Column]) -> Column:
    """The JSON text with ``change`` applied to every string value; keys, numbers and layout stay."""
    text = F.col(body)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        literal = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        # a one-element array is written as ["..."]; its brackets go again
        written = F.regexp_replace(F.to_json(F.array(change(s["value"]))), r"^\[|\]$", "")
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.when(s["is_key"], literal).otherwise(written))).alias("parts"))

    end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(strings(body), start, step, end)


def payload_leaks(df: DataFrame, keys: list[str], body: str, rules: list[Rule], own: DataFrame | None = None) -> DataFrame:
    """Detections in any key, string or number of a payload; keys, kind, entity_type, value. Whole opaque UUIDs and
    the session's own aliases (own: alias) do not count. An empty result means that the payload may go out."""
    texts = leaves(df, keys, body, with_numbers=True).where(~F.col("value").rlike(UUID_ONLY))
    out = detections(texts, [*keys, "kind"], "value", rules)
    if own is not None:
        out = out.join(own.select(F.col("alias").alias("value")).distinct(), "value", "left_anti")
    return out.select(*keys, "kind", "entity_type", "value")


def registered_leaks(df: DataFrame, keys: list[str], body: str, registered: DataFrame, ignore_case: bool = False) -> DataFrame:
    """df(keys, session_id, body) -> keys, kind, value: the session's registered originals, registered(session_id, value),
    that any key, string or number of a payload still holds. The values go once to each part of a session's payloads."""
    pairs = registered.select("session_id", F.col("value").alias("first"), F.lit("").alias("second"))
    own = list(dict.fromkeys([*keys, "session_id"]))
    texts = leaves(df.select(*own, body), own, body, with_numbers=True)

    def finder(values: dict[str, str]) -> Finder:
        return Finder(dict.fromkeys(folded(v)[0] if ignore_case else v for v in values if v))

    def held(values: Finder | None, text: str, _: dict) -> list[str]:
        return sorted({v for _, _, v in values.all(folded(text)[0] if ignore_case else text)}) if values else []

    return with_session_pairs(texts, pairs, "value", finder, held, "__held", "array<string>").select(*keys, "kind", F.explode("__held").alias("value"))


def header_leaks(df: DataFrame, keys: list[str], headers: Column, rules: list[Rule]) -> DataFrame:
    """Secrets, dictionary terms and users' patterns in header values; other detectors do not look at headers."""
    few = [r for r in rules if r.detector in ("secret_patterns", "dictionary", "user_regex")]
    return detections(df.select(*keys, F.explode(headers).alias("header", "value")), [*keys, "header"], "value", few).select(*keys, "header", "entity_type")
