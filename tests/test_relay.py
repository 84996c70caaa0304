"""Connections in turns: table and stream against a plain loop, for any size of block and any split into micro-batches."""

import json
import random

import pytest

from maskframe.operators import rules
from maskframe.plans.stream_queries import rocksdb
from maskframe.streaming import relay
from maskframe.streaming.shared import run_to_end

FRAME = "connection string, seq long, direction string, message string, session_key string, bound string, leaks boolean"
ASK, DONE, OWN = {"type": "response.create"}, {"type": "response.completed", "response": {"id": "r1"}}, {"type": "responsesapi.websocket_timing"}


def piece(text):
    return {"type": "response.output_text.delta", "output_index": 0, "content_index": 0, "delta": text}


def frame(connection, seq, direction, message, bound=None, leaks=False):
    return connection, seq, direction, message if message is None or isinstance(message, str) else json.dumps(message), "s", bound, leaks


def plain(frames):
    """(connection, seq, action, answer, code, status) without a look at the operator."""
    out, state = [], {}
    for c, seq, direction, message, session, bound, leaks in sorted(frames, key=lambda f: (f[0], f[1])):
        closed, busy, n = state.get(c, (False, False, 0))
        try:
            event = json.loads(message) if message is not None else None
            bad = "invalid_body" if not isinstance(event, dict) else None
        except ValueError:
            event, bad = None, "invalid_json"
        code, status, kind = None, None, event.get("type") if isinstance(event, dict) else None
        if closed:
            out.append((c, seq, "drop", None, None, None))
            continue
        if direction == "client":
            code = "binary_message_not_supported" if message is None else "message_too_large" if len(message.encode()) > 400 else bad
            if not code and kind == "response.create":
                if event.get("stream", True) is not True or "background" in event:
                    code = "invalid_websocket_field"
                elif busy:
                    code = "response_in_progress"
                elif isinstance(event.get("previous_response_id"), str) and event["previous_response_id"] and bound != session:
                    code = "session_unresolved"
            code = code or ("blocked" if leaks else None)
            if not code and kind == "response.create":
                busy, n = True, n + 1
            answer = n if busy else None
        else:
            code = "invalid_upstream_message" if message is None else "upstream_message_too_large" if len(message.encode()) > 400 else "invalid_upstream_json" if bad else None
            if not code and not busy:
                code = "unexpected_upstream_event" if kind not in relay.CONNECTION_EVENTS else "blocked" if leaks else None
            answer = n if busy else None
            if not code and kind in relay.TERMINAL:
                given = event.get("status")
                busy, status = False, given if isinstance(given, int) else 400 if kind in relay.FAILED else 200
        out.append((c, seq, "close" if code else "pass", None if code else answer, code, relay.CODES[code][0] if code else status))
        state[c] = (bool(code), busy, n)
    return sorted(out, key=str)


def made_up(seed, connections, length):
    rng, out = random.Random(seed), []
    odd = [None, "[1]", "7", "{", '{"type": "x", ', "", ASK | {"stream": False}, ASK | {"background": None}, ASK | {"previous_response_id": "r"}, "x" * 500, json.dumps({"type": "é" * 300}), {"type": 5}, {}, {"type": None}]
    for c in range(connections):
        busy = False
        for seq in range(length):
            usual = rng.random() < 0.96
            if usual and busy:
                direction, message = rng.choice([("server", piece("a")), ("server", OWN), ("client", {"type": "note"}), ("server", rng.choice([DONE, DONE | {"status": 302}, DONE | {"status": "no"}, {"type": "response.failed"}, {"type": "error"}]))])
            elif usual:
                direction, message = rng.choice([("client", ASK), ("client", ASK | {"stream": True, "previous_response_id": rng.choice(["", 3, None])}), ("client", {"type": "note"}), ("server", OWN)])
            else:
                direction, message = rng.choice(["client", "server"]), rng.choice([*odd, ASK, DONE, OWN])
            if direction == "client" and isinstance(message, dict) and message.get("type") == "response.create":
                busy = True
            elif direction == "server" and isinstance(message, dict) and message.get("type") in relay.TERMINAL:
                busy = False
            out.append(frame(f"c{c}", seq * 3 - 20, direction, message, rng.choice(["s", "t", None]), rng.random() < 0.01))
    return out


def rows(df):
    return sorted(((r.connection, r.seq, r.action, r.answer, r.code, r.status) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_a_table_of_frames_against_a_plain_loop(spark, block):
    frames = made_up(1, 60, 40)
    want = plain(frames)
    assert {w[4] for w in want} >= {"response_in_progress", "unexpected_upstream_event", "invalid_upstream_json", "blocked", "session_unresolved", "invalid_websocket_field"}
    assert rows(relay.relayed(spark.createDataFrame(frames, FRAME), most=400, block=block)) == want


def test_odd_rows(spark):
    odd = [(None, 1, "client", "{}", "s", None, False), ("c", None, "server", None, "s", None, None), ("d", 1, "client", '{"type":"a"}', "s", None, None)]
    df = spark.createDataFrame(odd, FRAME)
    assert sorted((str(r.connection), r.action, r.code) for r in relay.relayed(df).collect()) == [("None", "drop", "no_place"), ("c", "drop", "no_place"), ("d", "pass", None)]
    assert relay.relayed(df.limit(0)).collect() == []
    pairs = spark.createDataFrame([], "connection string, values map<string,string>")
    assert sorted((str(r.connection), r.action, r.sent) for r in relay.restored(df, pairs).collect()) == [("None", "drop", None), ("c", "drop", None), ("d", "pass", ['{"type":"a"}'])]


ARGS = {"type": "response.function_call_arguments.delta", "item_id": "f", "delta": '{"a": '}
END = {"type": "response.function_call_arguments.done", "item_id": "f", "output_index": 1}


def answers():
    """Connections whose aliases come in pieces, whose arguments are no JSON, or that break off."""
    lines = {
        "good": [("client", ASK), ("server", piece("to mf-us")), ("server", piece("er-1 now")), ("server", DONE), ("server", OWN), ("client", ASK), ("server", piece("mf-user")), ("client", {"type": "note"}), ("server", piece("-1")), ("server", DONE)],
        "bad": [("client", ASK), ("server", piece("x mf-user-1")), ("server", ARGS), ("server", END), ("server", piece("after")), ("client", ASK)],
        "open": [("client", ASK), ("server", ARGS), ("server", DONE), ("client", ASK)],
        "none": [("client", ASK), ("server", piece("mf-user-1 ")), ("server", DONE), ("server", DONE), ("client", ASK)],
        "told": [("client", ASK), ("server", piece("a")), ("server", {"type": "error"}), ("client", ASK)],
    }
    return [frame(c, k, d, m) for c, own in lines.items() for k, (d, m) in enumerate(own)]


def sent_rows(df):
    return sorted((r.connection, r.seq, r.action, r.answer, r.code, r.status, r.closed_with, [json.loads(x) for x in r.sent] if r.sent is not None else None) for r in df.collect())


def test_answers_are_restored_in_tables_and_streams(spark, tmp_path):
    values = {"mf-user-1": "ann@b.org"}
    pairs = spark.createDataFrame([(c, values) for c in ("good", "bad", "open", "told")], "connection string, values map<string,string>")
    df = spark.createDataFrame(answers(), FRAME)
    want = sent_rows(relay.restored(df, pairs))
    by = {(w[0], w[1]): w for w in want}
    text = {c: "".join(e.get("delta", "") for w in want if w[0] == c for e in w[7] or [] if e.get("type") == "response.output_text.delta") for c in ("good", "none", "bad")}
    assert text == {"good": "to ann@b.org nowann@b.org", "none": "mf-user-1 ", "bad": "x ann@b.org"} or text["bad"] == "x "
    assert by["bad", 3][2:7] == ("close", None, "response_processing_failed", 502, 1008) and by["bad", 3][7][-1]["type"] == "error"
    assert [by["bad", k][2] for k in (4, 5)] == ["drop", "drop"] and by["open", 2][4] == "response_processing_failed" and by["open", 3][2] == "drop"
    assert by["none", 3][4] == "unexpected_upstream_event" and by["told", 2][5] == 400 and by["told", 3][2:4] == ("pass", 2)
    assert by["good", 7][3] == 2 and by["good", 4][3] is None
    with rocksdb(spark):
        for name, size in (("a", 2), ("b", 7)):
            path = f"{tmp_path}/{name}"
            for k in range(0, 10, size):
                df.where(f"seq >= {k} and seq < {k + size}").coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
            got = run_to_end(relay.relayed_stream(stream, pairs), f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-check")
            assert sent_rows(got) == want


def test_a_stream_of_any_split_gives_what_a_table_gives(spark, tmp_path):
    frames = [f for f in made_up(2, 20, 30) if f[3] is None or "function" not in f[3]]
    df, none = spark.createDataFrame(frames, FRAME), spark.createDataFrame([], "connection string, values map<string,string>")
    with rocksdb(spark):
        for a, b in ((-50, -3), (-3, 0), (0, 1000)):
            df.where(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = run_to_end(relay.relayed_stream(stream, none, most=400), f"{tmp_path}/out", f"{tmp_path}/check")
        assert rows(got) == plain(frames)


class Held:
    """A value state and its handle, without a stream."""

    def __init__(self):
        self.value, self.timers = None, []
        self.exists, self.get, self.update, self.clear = lambda: self.value is not None, lambda: self.value, lambda v: setattr(self, "value", v), lambda: setattr(self, "value", None)
        self.listTimers, self.registerTimer, self.deleteTimer = lambda: iter(self.timers), self.timers.append, self.timers.remove

    def getValueState(self, name, schema):
        self.states = [*getattr(self, "states", []), Held()]
        return self.states[-1]

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_an_idle_connection_is_forgotten():
    import pandas as pd

    one, handle = relay.Connection((), 60_000), Held()
    one.init(handle)
    batch = lambda seq: pd.DataFrame([("c", seq, "client", "{}", None, "response_in_progress", 1, None, None)], columns=[*relay.TOLD, "pairs"])
    got = [f for k in (1, 2, 3) for f in one.handleInputRows(("c",), iter([batch(k)]), handle)]
    assert [f["action"].iloc[0] for f in got] == ["pass", "close", "drop"] and handle.timers == [61_000]
    assert list(one.handleExpiredTimer(("c",), handle, None)) == [] and all(s.value is None for s in handle.states)
    (after,) = one.handleInputRows(("c",), iter([batch(4)]), handle)
    assert after["action"].iloc[0] == "pass" and after["answer"].iloc[0] == 1


def test_the_guard_looks_at_every_string_of_a_message(spark):
    texts = ['{"type":"a","x":[{"y":"u@b.org"}]}', '{"u@b.org":1}', '{"type":"a"}', '{"id":"123e4567-e89b-12d3-a456-426614174000"}', None, "{"]
    df = spark.createDataFrame([frame("c", k, "client", t)[:6] for k, t in enumerate(texts)], FRAME.rpartition(",")[0])
    got = {r.seq: r.leaks for r in relay.guarded(df, rules.built_in()).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False}
