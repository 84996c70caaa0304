"""Rows beside what their session knows, without that being on every row.

A session may know thousands of pairs and have a third of all rows. Its rows are dealt to as many parts as there are shuffle
partitions, by a hash of their other columns (of the text where there are none), and its pairs go once to each part that has
any of its rows. A part is read as a stream, pairs first: a task holds the pairs of one session at a time. Which parts a
session has is told without the text, so that a text that is costly to make is made once. Of a session with very many pairs
a part gets those alone whose first string is in one of its texts (``wide``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import SOME
from .term_join import term_matches


def with_session_row(rows: DataFrame, sessions: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``sessions`` (one row a session), null where there is none. Rows of a session are
    dealt to parts by a hash of their columns ``by``, and its row goes once to each part that has any."""
    parts = F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*by), parts).cast("int"))
    own = dealt.where("session_id is not null").select("session_id", "__part").distinct()
    return dealt.join(sessions.join(own, "session_id"), ["session_id", "__part"], "left").drop("__part")


def with_own_pairs(rows: DataFrame, pairs: DataFrame, used: Column, by: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``, the map of the pairs of their session (session_id, first, second; no first twice) whose first is
    in ``used``, an array of strings of each row; null where there is none. Rows are dealt by what they use and a hash of ``by``."""
    parts = F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = ["session_id", "__part", "__uses"]
    dealt = rows.withColumns({"__part": F.pmod(F.xxhash64(*by), parts).cast("int"), "__uses": F.sha2(F.array_join(used, ","), 256)})
    own = dealt.select(*at, F.explode(used).alias("first")).join(pairs, ["session_id", "first"]).distinct()
    maps = own.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("first", "second"))).alias(out))
    return dealt.join(maps, at, "left").drop("__part", "__uses")


def _held(rows: DataFrame, pairs: DataFrame, text: str, told_apart: list[str]) -> DataFrame:
    """session_id, __part, first: which of their session's pairs are in texts of ``rows`` (session_id, __part, ...). Texts
    are matched by row, told by their part and a hash; rows that share these share what they hold."""
    row = F.concat_ws(" ", F.col("__part").cast("string"), F.xxhash64("session_id", *told_apart).cast("string"), F.col("session_id"))
    found = term_matches(rows.select(row.alias("__at"), text), "__at", text, pairs.select(F.col("first").alias("term")))
    told = F.split("__at", " ", 3)
    return found.select(told[2].alias("session_id"), told[0].cast("int").alias("__part"), F.col("term").alias("first")).distinct()


def with_session_pairs(df: DataFrame, pairs: DataFrame, text: str, prepare: Callable[[dict[str, str]], object], change: Callable[[object, str, dict], object], out: str, kind: str, wide: DataFrame | None = None) -> DataFrame:
    """``df`` (session_id, ...) with the column ``out`` of type ``kind``: ``change(prepared, text, row)`` with what ``prepare``
    makes of the session's pairs (session_id, first, second) once a part, None for a session without any; ``row`` holds the
    other columns of strings. Null texts stay null, and rows of a null session know nothing. Of the sessions ``wide``
    (session_id), a part gets only the pairs whose first its texts hold; ``change`` must not need others."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told_apart = [c for c in df.columns if c not in (text, "session_id")] or [text]
    rows = df.withColumns({"__part": F.pmod(F.xxhash64(*told_apart), F.lit(parts)).cast("int"), "__first": F.lit(None).cast("string"), "__second": F.lit(None).cast("string"), "__row": F.lit(True)})
    own = rows.where("session_id is not null").select("session_id", "__part").distinct()
    narrow = pairs if wide is None else pairs.join(wide, "session_id", "left_anti")
    sent = narrow.join(own, "session_id")
    if wide is not None:
        many = pairs.join(wide, "session_id", "left_semi")
        sent = sent.unionByName(many.join(_held(rows.join(wide, "session_id", "left_semi"), many, text, told_apart), ["session_id", "first"]))
    known = sent.select("session_id", "__part", F.col("first").alias("__first"), F.col("second").alias("__second")).withColumn("__row", F.lit(False))
    dealt = rows.unionByName(known, allowMissingColumns=True).repartition("session_id", "__part").sortWithinPartitions("session_id", "__part", "__row")
    names = df.columns
    strings = [n for n, t in df.dtypes if t == "string"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: dict[str, str] = {}
        prepared: object = None
        ready = False
        shape: pa.DataType | None = None
        for batch in (b.slice(i, SOME) for b in batches for i in range(0, b.num_rows, SOME)):
            cells = [batch.column(c).to_pylist() for c in ("session_id", "__part", "__row", "__first", "__second")]
            texts = {n: batch.column(n) for n in strings}
            told, kept = [], []
            for i, (session, part, is_row, first, second) in enumerate(zip(*cells, strict=True)):
                if at != (session, part):
                    at, held, prepared, ready = (session, part), {}, None, False
                if not is_row:
                    held[first] = second
                    continue
                if not ready:
                    prepared, ready = prepare(held) if held else None, True
                row = {n: c[i].as_py() for n, c in texts.items()}
                kept.append(i)
                told.append(None if row[text] is None else change(prepared, row[text], row))
            if kept:
                shape = shape or (pa.string() if kind == "string" else pa.list_(pa.string()))
                own_rows = batch.select(names).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own_rows.columns, pa.array(told, shape)], names=[*names, out])

    return dealt.mapInArrow(run, schema)
