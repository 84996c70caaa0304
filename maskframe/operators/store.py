"""Sessions, mappings and bindings as sealed records in an append-only table.

A record is (kind, lookup, sealed, expires, written, gone). ``lookup`` is a keyed digest of the record's kind and id,
``sealed`` its JSON under AES-256-GCM with everything that places it (schema, store, kind, lookup) as context, so that a
row moved or changed does not open. Changes are appended: the latest row of a (kind, lookup) holds, a row marked gone
ends it, and ``compact`` writes the rows that hold. Many writers may append; none rewrites another's files.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mask import has_alias_shape, hmac_sha256, opened, sealed
from .state import expired, upsert

RECORDS = "kind string, lookup string, sealed binary, expires timestamp, written timestamp, gone boolean"
SCHEMA_VERSION, CHECK = "1", "the key fits"
KINDS = ("session", "response", "mapping", "check")


def new_keys(count: int = 2) -> list[bytes]:
    """Random keys of 32 bytes; never derived from an id."""
    return [secrets.token_bytes(32) for _ in range(count)]


def master_table(spark: SparkSession, store: str, key: bytes) -> DataFrame:
    """One row with what the master key gives, to be joined: keys are in a table, never in a plan."""
    pads = [bytearray(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    return spark.createDataFrame([(store, *pads, bytearray(key))], "store string, inner_pad binary, outer_pad binary, seal_key binary")


def encoded(df: DataFrame) -> Column:
    """A row as JSON: binary as base64, times in ISO form (UTC)."""
    def cell(name: str, kind: str) -> Column:
        return F.base64(name) if kind == "binary" else F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if kind == "timestamp" else F.col(name)

    return F.to_json(F.struct(*(cell(n, k).alias(n) for n, k in df.dtypes)))


def decoded(text: Column, schema: dict[str, str]) -> list[Column]:
    """The columns of a JSON row of ``encoded``."""
    plain = {n: "string" if k in ("binary", "timestamp") else k for n, k in schema.items()}
    row = F.from_json(text, ", ".join(f"`{n}` {k}" for n, k in plain.items()))
    return [(F.unbase64(row[n]) if k == "binary" else row[n].cast("timestamp") if k == "timestamp" else row[n]).alias(n) for n, k in schema.items()]


def lookup_of(kind: Column, id_: Column) -> Column:
    return hmac_sha256(F.col("inner_pad"), F.col("outer_pad"), F.concat_ws("\0", kind, id_))


def _context(kind: Column, lookup: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(SCHEMA_VERSION), F.col("store"), kind, lookup)


def records(df: DataFrame, master: DataFrame, kind: str, id_col: str, expires: Column, written: Column, gone: bool = False) -> DataFrame:
    """Rows of ``df`` as records to append."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    text = encoded(df)
    own = df.withColumns({"__id": F.col(id_col).cast("string"), "__text": text, "__expires": expires, "__written": written}).crossJoin(F.broadcast(master))  # one row
    own = own.withColumn("lookup", lookup_of(F.lit(kind), F.col("__id")))
    body = F.lit(None).cast("binary") if gone else sealed(F.col("__text"), F.col("seal_key"), _context(F.lit(kind), F.col("lookup")))
    return own.select(F.lit(kind).alias("kind"), "lookup", body.alias("sealed"), F.col("__expires").cast("timestamp").alias("expires"), F.col("__written").cast("timestamp").alias("written"), F.lit(gone).alias("gone"))


def current(rows: DataFrame, now: Column) -> DataFrame:
    """The records that hold: the latest of each (kind, lookup), neither gone nor expired."""
    return upsert(rows, ["kind", "lookup"], ["written", "gone"]).where(~F.col("gone") & (F.col("expires").isNull() | (F.col("expires") > now)))


def read(rows: DataFrame, master: DataFrame, kind: str, schema: dict[str, str]) -> DataFrame:
    """The rows behind current records of a kind; an error for a record that was changed, moved or sealed by another key."""
    own = rows.where(F.col("kind") == kind).crossJoin(F.broadcast(master))  # one row
    text = opened(F.col("sealed"), F.col("seal_key"), _context(F.col("kind"), F.col("lookup")))
    return own.select("lookup", text.alias("__text")).select("lookup", *decoded(F.col("__text"), schema))


def found(rows: DataFrame, wanted: DataFrame, master: DataFrame, kind: str, id_col: str) -> DataFrame:
    """wanted(id_col) with ``lookup`` and whether a current record has it: a keyed lookup, no id is stored."""
    keyed = wanted.crossJoin(F.broadcast(master)).withColumn("lookup", lookup_of(F.lit(kind), F.col(id_col).cast("string"))).select(*wanted.columns, "lookup")  # one row
    known = rows.where(F.col("kind") == kind).select("lookup", F.lit(True).alias("__known")).distinct()
    return keyed.join(known, "lookup", "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("kind").parquet(path)


def opened_store(spark: SparkSession, path: str, master: DataFrame) -> DataFrame:
    """All records of a store whose check record opens with this key; an error if it doesn't."""
    rows = spark.read.schema(RECORDS).parquet(path)
    checks = read(rows.where("kind = 'check'"), master, "check", {"id": "string", "text": "string"})
    if {r.text for r in checks.collect()} != {CHECK}:  # one row for each time that the store was made
        raise ValueError("the store has no check record")
    return rows


def new_store(spark: SparkSession, path: str, master: DataFrame) -> None:
    check = spark.createDataFrame([("check", CHECK)], "id string, text string")
    append(records(check, master, "check", "id", F.lit(None), F.current_timestamp()), path)


def compact(rows: DataFrame, now: Column, path: str) -> None:
    """Write the records that hold to a new folder."""
    current(rows, now).write.mode("errorifexists").partitionBy("kind").parquet(path)


def cascade(gone: DataFrame, bound: DataFrame, master: DataFrame, now: Column) -> DataFrame:
    """Records that end sessions gone(session_key) and, with them, bound(response_id, session_key)."""
    own = bound.join(gone.select("session_key").distinct(), "session_key", "left_semi")
    return records(gone, master, "session", "session_key", F.lit(None), now, gone=True).unionByName(records(own, master, "response", "response_id", F.lit(None), now, gone=True))


def usable(sessions: DataFrame, now: Column, idle_hours: int, absolute: str = "expires_at", used: str = "last_used") -> DataFrame:
    """Sessions that are neither idle for too long nor at their end."""
    return sessions.where(~expired(now, F.col(used), F.col(absolute), idle_hours))


def refused(requests: DataFrame, text: str, stable: str = "stable") -> Column:
    """409 for a request that cannot be served: an unknown previous response, or a text with what looks like an alias in
    a session that no one can name again."""
    unknown = F.col("unknown_previous") if "unknown_previous" in requests.columns else F.lit(False)
    return F.when(unknown | (~F.col(stable) & has_alias_shape(F.col(text))), F.lit(409)).otherwise(F.lit(200))
