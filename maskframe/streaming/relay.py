"""Connections on which a client and a server speak in turns: which frame passes, which one closes the connection and why.

A client asks (``response.create``), the server answers with events up to a terminal one; one answer is in flight at a time.
Other frames of a client pass if the guard finds nothing in them, frames of a server outside an answer must be events of the
connection. The first frame that breaks a rule closes its connection, and what follows is dropped.

All that a frame tells by itself is settled by built-in expressions (``told``): its code if no answer is in flight, its code if
one is, and whether it begins or ends an answer. The rest is a scan over the connection. ``relayed`` does it for a table: a
connection is cut into blocks of ``block`` sequence numbers, each is summed up for either state in which it may begin, the few
summaries are scanned, and the frames get their block's. No task holds more than a block of one connection. ``relayed_stream``
holds the state of a connection (in flight, number of the answer, closed, the restorer's rest) and restores the answers as they
pass; ``restored`` restores those of a table. Both give the same frames for any split into micro-batches.

Defined cases: sequence numbers are unique in a connection; frames without connection or number are dropped with the code
``no_place``; a null message is one of bytes; JSON objects that name a key twice are no JSON; a text of any length up to
``most`` bytes is looked at whole; further columns are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskframe.operators.detect import Rules, with_hits
from maskframe.operators.walk import UUID_ONLY, strings

from .events import TERMINAL, EventRestorer, Frames, data_of

# Events of a connection, codes of refusals and the transport's codes of closing.
CONNECTION_EVENTS = ("responsesapi.websocket_timing",)
FAILED = ("error", "response.failed", "response.incomplete")
CODES = {
    "binary_message_not_supported": (400, 1003),
    "message_too_large": (413, 1009),
    "invalid_json": (400, 1008),
    "invalid_body": (400, 1008),
    "invalid_websocket_field": (400, 1008),
    "response_in_progress": (409, 1008),
    "session_unresolved": (409, 1008),
    "blocked": (400, 1008),
    "invalid_upstream_message": (502, 1011),
    "upstream_message_too_large": (502, 1009),
    "invalid_upstream_json": (502, 1011),
    "unexpected_upstream_event": (502, 1011),
    "response_processing_failed": (502, 1008),
}
MAX_MESSAGE_BYTES = 10 * 1024 * 1024
#: Sequence numbers of a connection that one task may hold.
BLOCK = 100_000

TOLD = ("connection", "seq", "direction", "message", "if_idle", "if_busy", "turn", "outcome")


def guarded(frames: DataFrame, rules: Rules, **options) -> DataFrame:
    """frames plus ``leaks``: whether a rule hits in the strings of a message, keys too, whole UUIDs apart. Each string is a
    line of one text, so a rule that spans lines may hit across strings: more is refused, never less."""
    found = F.filter(F.transform(strings("message"), lambda s: s["value"]), lambda v: ~v.rlike(UUID_ONLY))
    hit = with_hits(frames.withColumn("__line", F.array_join(found, "\n")), "__line", rules, error="__why", **options)
    return hit.withColumn("leaks", F.col("__why").isNotNull() | (F.coalesce(F.size("__hits"), F.lit(0)) > 0)).drop("__line", "__hits", "__why")


def told(frames: DataFrame, most: int = MAX_MESSAGE_BYTES) -> DataFrame:
    """frames(connection, seq, direction: client or server, message, session_key: the connection's, bound: the session of
    the message's previous response, leaks) -> the columns of ``TOLD``."""
    frames = frames.withColumn("__node", F.try_parse_json("message"))
    node = F.col("__node")

    def at(name: str, kind: str) -> Column:
        return F.try_variant_get(node, f"$.{name}", kind)

    def is_a(name: str, kind: str) -> Column:
        return F.coalesce(F.schema_of_variant(at(name, "variant")) == kind, F.lit(False))

    is_object, kind = F.col("message").rlike(r"^\s*\{"), F.coalesce(at("type", "string"), F.lit(""))
    large, leaks = F.octet_length("message") > most, F.coalesce("leaks", F.lit(False))
    client, asks = F.col("direction") == "client", kind == "response.create"
    fields = (at("stream", "variant").isNotNull() & ~(is_a("stream", "BOOLEAN") & F.coalesce(at("stream", "boolean"), F.lit(False)))) | at("background", "variant").isNotNull()
    other = is_a("previous_response_id", "STRING") & (at("previous_response_id", "string") != "") & ~F.col("bound").eqNullSafe(F.col("session_key"))

    def first(*cases: tuple[Column, str]) -> Column:
        out = F.lit(None).cast("string")
        for when, code in reversed(cases):
            out = F.when(when, F.lit(code)).otherwise(out)
        return out

    form = ((F.col("message").isNull(), "binary_message_not_supported"), (large, "message_too_large"), (node.isNull(), "invalid_json"), (~is_object, "invalid_body"), (asks & fields, "invalid_websocket_field"))
    up = ((F.col("message").isNull(), "invalid_upstream_message"), (large, "upstream_message_too_large"), (node.isNull() | ~is_object, "invalid_upstream_json"))
    own = kind.isin(*CONNECTION_EVENTS)
    idle = F.when(client, first(*form, (asks & other, "session_unresolved"), (leaks, "blocked"))).otherwise(first(*up, (~own, "unexpected_upstream_event"), (leaks, "blocked")))
    busy = F.when(client, first(*form, (asks, "response_in_progress"), (leaks, "blocked"))).otherwise(first(*up))
    ends = ~client & kind.isin(*TERMINAL)
    outcome = F.when(ends, F.when(is_a("status", "BIGINT"), at("status", "int")).otherwise(F.when(kind.isin(*FAILED), 400).otherwise(200)))
    return frames.select("connection", F.col("seq").cast("long").alias("seq"), "direction", "message", idle.alias("if_idle"), busy.alias("if_busy"), F.when(client & asks, 1).when(ends, 0).alias("turn"), outcome.alias("outcome"))


def _closing(code: Column, which: int) -> Column:
    return F.create_map(*(F.lit(x) for c, v in CODES.items() for x in (c, v[which])))[code]


def relayed(frames: DataFrame, most: int = MAX_MESSAGE_BYTES, block: int = BLOCK) -> DataFrame:
    """frames as ``told`` takes them -> connection, seq, direction, message, action (pass, close, drop), answer (its number
    in the connection, null outside), code, status (of the refusal, or the outcome of the answer that ends), closed_with."""
    return _relayed(told(frames, most), block)


def _relayed(rows: DataFrame, block: int) -> DataFrame:
    placed = rows.where("connection is not null and seq is not null").withColumn("__block", F.floor(F.col("seq") / block))
    inside = Window.partitionBy("connection", "__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # the last turn of the block before a frame (null: the state is that in which the block begins) and its answers so far
    seen = placed.withColumns({"__last": F.last("turn", ignorenulls=True).over(inside), "__asked": F.coalesce(F.sum("turn").over(inside), F.lit(0))})

    def wrong(code: Column, when: Column) -> Column:
        return F.min(F.when(code.isNotNull() & when, F.col("seq")))

    unknown = F.col("__last").isNull()
    later = F.when(F.col("__last") == 1, F.col("if_busy")).otherwise(F.col("if_idle"))
    sums = seen.groupBy("connection", "__block").agg(
        F.max_by("turn", F.when(F.col("turn").isNotNull(), F.col("seq"))).alias("__end"),
        F.sum("turn").alias("__asks"),
        wrong(F.col("if_idle"), unknown).alias("__idle"),
        wrong(F.col("if_busy"), unknown).alias("__busy"),
        wrong(later, ~unknown).alias("__later"),
    )
    of = Window.partitionBy("connection").orderBy("__block")
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumns({"__in": F.coalesce(F.last("__end", ignorenulls=True).over(before), F.lit(0)), "__n": F.coalesce(F.sum("__asks").over(before), F.lit(0))})
    carried = carried.withColumn("__wrong", F.least(F.when(F.col("__in") == 1, F.col("__busy")).otherwise(F.col("__idle")), "__later"))
    carried = carried.withColumn("__closed", F.min("__wrong").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    out = seen.join(carried.select("connection", "__block", "__in", "__n", "__closed"), ["connection", "__block"])
    is_busy = F.coalesce("__last", "__in") == 1
    action = F.when(F.col("seq") > F.col("__closed"), "drop").when(F.col("seq") == F.col("__closed"), "close").otherwise("pass")
    code = F.when(F.col("seq") == F.col("__closed"), F.when(is_busy, F.col("if_busy")).otherwise(F.col("if_idle")))
    answer = F.when(F.coalesce(F.col("seq") < F.col("__closed"), F.lit(True)) & (is_busy | (F.col("turn") == 1)), F.col("__n") + F.col("__asked") + F.when(is_busy, 0).otherwise(1))
    out = out.select("connection", "seq", "direction", "message", action.alias("action"), answer.cast("long").alias("answer"), code.alias("code"), "outcome")
    none = rows.where("connection is null or seq is null").select("connection", "seq", "direction", "message", F.lit("drop").alias("action"), F.lit(None).cast("long").alias("answer"), F.lit("no_place").alias("code"), "outcome")
    status = F.coalesce(_closing(F.col("code"), 0), F.when(F.col("action") == "pass", F.col("outcome")))
    return out.unionByName(none).withColumns({"status": status, "closed_with": _closing(F.col("code"), 1)}).drop("outcome")


def _events(restorer: EventRestorer, message: str) -> tuple[list[str], bool]:
    """(events that go to the client, whether one is an error that the server did not send)."""
    event = json.loads(message)
    sent = restorer.payload(event)
    if event.get("type") in TERMINAL:
        sent += [data_of(x) for x in Frames().feed("".join(restorer.finish()), last=True)]
    for n, made in enumerate(sent):
        if made.get("type") == "error" and event.get("type") != "error":
            return [json.dumps(x, ensure_ascii=False) for x in sent[: n + 1]], True
    return [json.dumps(x, ensure_ascii=False) for x in sent], False


def restored(frames: DataFrame, pairs: DataFrame, trusted: tuple[str, ...] = (), most: int = MAX_MESSAGE_BYTES, block: int = BLOCK) -> DataFrame:
    """As ``relayed`` plus ``sent``: the messages that go on. Events of an answer are restored by pairs(connection, values
    map<string,string>), its aliases; an answer that cannot be restored closes its connection. One answer is in one task."""
    base = relayed(frames, most, block)
    answers = base.where("action = 'pass' and answer is not null and direction = 'server'").select("connection", "answer", "seq", "message")
    kind = dict(base.dtypes)["connection"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("seq", kind="stable")
        restorer = EventRestorer("responses", dict(right["values"].iloc[0] or {}) if len(right) else {}, trusted)
        out = []
        for seq, message in zip(left["seq"], left["message"], strict=True):
            made, failed = _events(restorer, message)
            out.append((left["connection"].iloc[0], seq, made, failed))
            if failed:
                break
        return pd.DataFrame(out, columns=["connection", "seq", "made", "failed"])

    # the aliases go once to each answer, not onto its events
    each = answers.select("connection", "answer").distinct().join(pairs, "connection").select(F.col("connection").alias("__of"), F.col("answer").alias("__nth"), "values")
    made = answers.groupBy("connection", "answer").cogroup(each.groupBy("__of", "__nth")).applyInPandas(run, f"connection {kind}, seq long, made array<string>, failed boolean")
    ended = made.where("failed").groupBy("connection").agg(F.min("seq").alias("__failed"))
    out = base.join(made.select("connection", "seq", "made"), ["connection", "seq"], "left").join(ended, "connection", "left")
    is_late, is_last = F.coalesce(F.col("seq") > F.col("__failed"), F.lit(False)), F.coalesce(F.col("seq") == F.col("__failed"), F.lit(False))
    none, code = F.lit(None), "response_processing_failed"
    sent = F.when(is_late | F.col("action").isin("close", "drop"), none).otherwise(F.coalesce("made", F.array("message")))
    return out.select(
        "connection", "seq", "direction", "message",
        F.when(is_late, "drop").when(is_last, "close").otherwise(F.col("action")).alias("action"),
        F.when(~is_late & ~is_last, F.col("answer")).alias("answer"),
        F.when(is_last, code).when(~is_late | (F.col("code") == "no_place"), F.col("code")).alias("code"),
        F.when(is_last, CODES[code][0]).when(~is_late, F.col("status")).alias("status"),
        F.when(is_last, CODES[code][1]).when(~is_late, F.col("closed_with")).alias("closed_with"),
        sent.alias("sent"),
    )


class Connection(StatefulProcessor):
    """One connection: whether it is closed, the answer in flight and its number, what the restorer holds back."""

    def __init__(self, trusted: tuple[str, ...], idle_ms: int | None):
        self.trusted, self.idle_ms = trusted, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getValueState("turns", "closed boolean, busy boolean, answers long")
        self.held = handle.getValueState("held", "held string")

    def _rows(self, rows: Iterable) -> Iterator[tuple]:
        closed, busy, answers = self.turns.get() if self.turns.exists() else (False, False, 0)
        kept, restorer = self.held.get()[0] if self.held.exists() else None, None
        for r in rows:
            place = (r.connection, r.seq, r.direction, r.message)
            if closed:
                yield (*place, "drop", None, None, None, None, None)
                continue
            code, made = r.if_busy if busy else r.if_idle, [r.message]
            if not code and r.turn == 1:
                busy, answers, kept, restorer = True, answers + 1, None, None
            elif not code and busy and r.direction == "server":
                restorer = restorer or EventRestorer("responses", json.loads(r.pairs or "{}"), self.trusted, kept)
                made, failed = _events(restorer, r.message)
                code = "response_processing_failed" if failed else None
            if code:
                closed = True
                yield (*place, "close", None, code, *CODES[code], made if code == "response_processing_failed" else None)
                continue
            outcome = None if pd.isna(r.outcome) else int(r.outcome)
            yield (*place, "pass", answers if busy else None, None, outcome, None, made)
            if r.turn == 0:
                busy, kept, restorer = False, None, None
        self.turns.update((closed, busy, answers))
        if busy and not closed and restorer is not None:
            self.held.update((restorer.state(),))
        elif kept is None or closed:
            self.held.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable").astype({"if_idle": object, "if_busy": object})
        frame[["if_idle", "if_busy"]] = frame[["if_idle", "if_busy"]].where(frame[["if_idle", "if_busy"]].notna(), None)
        out = pd.DataFrame(list(self._rows(frame.itertuples())), columns=["connection", "seq", "direction", "message", "action", "answer", "code", "status", "closed_with", "sent"])
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield out.astype({"answer": "Int64", "status": "Int32", "closed_with": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def relayed_stream(frames: DataFrame, pairs: DataFrame, trusted: tuple[str, ...] = (), most: int = MAX_MESSAGE_BYTES, idle_seconds: int | None = None) -> DataFrame:
    """As ``restored`` for a stream of frames that come in the order of their numbers; ``pairs`` is a static table. A
    connection without frames for ``idle_seconds`` is forgotten; with it a query needs a trigger that goes on, as timers keep
    one of ``availableNow`` from ending. The state store must be RocksDB. Frames without a place are left out."""
    rows = told(frames.where("connection is not null and seq is not null"), most)
    rows = rows.join(pairs.select("connection", F.to_json("values").alias("pairs")), "connection", "left")
    kind = dict(rows.dtypes)["connection"]
    schema = f"connection {kind}, seq long, direction string, message string, action string, answer long, code string, status int, closed_with int, sent array<string>"
    timed = bool(idle_seconds and frames.isStreaming)
    return rows.groupBy("connection").transformWithStateInPandas(Connection(trusted, idle_seconds * 1000 if timed else None), schema, "Append", "ProcessingTime" if timed else "None")
