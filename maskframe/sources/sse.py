"""Server-sent events: text to events and back, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(lines: Column, name: str) -> Column:
    """Values of a field, in order; one blank after the colon goes, a line without colon is an empty value."""
    own = F.filter(lines, lambda x: x.rlike(f"^{name}(?::|$)"))
    return F.transform(own, lambda x: F.regexp_replace(x, f"^{name}(?:: ?)?", ""))


def parse(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, seq, event, data, id, retry, comments: one row an event. Line ends may be CRLF, CR or LF; a blank line ends
    an event; of a repeated field the last counts, but data are listed; a retry that is no number is left out."""
    folded = F.regexp_replace(F.col(text), "\r\n?", "\n")
    blocks = F.filter(F.transform(F.split(folded, "\n\n+"), lambda b: F.filter(F.split(b, "\n"), lambda x: x != "")), lambda b: F.size(b) > 0)
    rows = df.select(*keys, F.posexplode(blocks).alias("seq", "__lines"))
    lines = F.col("__lines")
    last = lambda name: F.try_element_at(_named(lines, name), F.lit(-1))
    retries = F.filter(_named(lines, "retry"), lambda v: v.rlike("^[0-9]{1,9}$"))
    comments = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(":"))), lambda x: F.substring(x, F.lit(2), F.length(x)))
    return rows.select(*keys, "seq", last("event").alias("event"), _named(lines, "data").alias("data"), last("id").alias("id"), F.try_element_at(retries, F.lit(-1)).cast("int").alias("retry"), comments.alias("comments"))


def serialize(comments: Column, event: Column, data: Column, id_: Column, retry: Column) -> Column:
    one = lambda name, v: F.when(v.isNotNull(), F.array(F.concat(F.lit(f"{name}: "), v.cast("string")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.transform(comments, lambda c: F.concat(F.lit(":"), c)), one("event", event), F.transform(data, lambda d: F.concat(F.lit("data: "), d)), one("id", id_), one("retry", retry))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))
