"""Sessions, bindings and mappings as tables: precedence, expiry, upsert, cascade delete. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDLE_HOURS, ABSOLUTE_HOURS = 4, 24


def header(headers: Column, name: str) -> Column:
    """The non-empty value of a header, whatever the case of its name; the last of several spellings counts."""
    named = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.nullif(F.try_element_at(named, F.lit(-1))["value"], F.lit(""))


def with_session(requests: DataFrame, bindings: DataFrame, explicit: str, stable: tuple[str, ...]) -> DataFrame:
    """requests(headers map, previous_response_id) plus session_key, stable and unknown_previous.

    The explicit header wins, then the stable client headers in order (their value after their name), then the session
    to which the previous response is bound. A previous response without a binding is marked; requests without any of
    these get a null key, for which the caller makes a new one. ``bindings`` holds response_id, session_key, once each."""
    named = F.coalesce(header(F.col("headers"), explicit), *(F.concat(F.lit(f"{n}:"), header(F.col("headers"), n)) for n in stable))
    bound = bindings.select(F.col("response_id").alias("previous_response_id"), F.col("session_key").alias("__bound"))
    out = requests.withColumn("__named", named).join(bound, "previous_response_id", "left")
    asked = F.coalesce(F.col("previous_response_id") != "", F.lit(False))
    return out.withColumns({
        "session_key": F.coalesce("__named", "__bound"),
        "stable": F.col("__named").isNotNull() | F.col("__bound").isNotNull(),
        "unknown_previous": F.col("__named").isNull() & asked & F.col("__bound").isNull(),
    }).drop("__named", "__bound")


def expired(now: Column, last_used: Column, expires_at: Column, idle_hours: int = IDLE_HOURS) -> Column:
    """True once the end is reached or the session was idle for the whole time given; both bounds belong to it."""
    return (now >= expires_at) | (now >= last_used + F.make_dt_interval(hours=F.lit(idle_hours)))


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key. A partial aggregate, so a key with many versions is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*keys, *(F.col("__last")[c].alias(c) for c in rest)).select(*rows.columns)


def cascade_delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose session was not deleted; a null session stays."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
