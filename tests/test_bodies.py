"""Bodies, event streams and the sealed store."""

import json
import random

import pytest
from pyspark.sql import functions as F

from maskframe.operators import bodies, headers, mask, metrics, rules, store, walk
from maskframe.streaming import events

REQUEST = {
    "instructions": "mail a@b.org", "previous_response_id": "resp_abcdef12",
    "input": [
        {"type": "message", "content": [{"type": "input_text", "text": "from c@d.org"}]}, {"type": "function_call", "arguments": '{"to": ["e@f.org"], "n": 1}', "call_id": "call_123456"},
        {"type": "function_call_output", "output": {"x": ["g@h.org", 5]}}, {"type": "function_call", "arguments": "not json i@j.org"}, "loose",
    ],
    "tools": [{"name": "t", "description": "ask k@l.org", "parameters": {"m@n.org": 1}}],
    "client_metadata": {"x-codex-turn-metadata": '{"turn_started_at_unix_ms": "1700000000000", "w": "/home/al"}'},
}
MESSAGES = {
    "system": [{"type": "text", "text": "a@b.org"}], "max_tokens": 5,
    "messages": [
        {"role": "user", "content": "c@d.org"},
        {"role": "user", "content": [{"type": "text", "text": "e@f.org"}, {"type": "tool_use", "name": "t", "input": {"q": "g@h.org"}}, {"type": "tool_result", "content": [{"type": "text", "text": "i@j.org"}]}, {"type": "thinking", "text": "k@l.org"}]},
    ],
}
EMAILS = [r for r in rules.built_in() if r.entity == "EMAIL"]


def table(spark, *rows):
    return spark.createDataFrame([(k, "s", shape, body if body is None or isinstance(body, str) else json.dumps(body)) for k, (shape, body) in enumerate(rows)], "k int, session_id string, shape string, body string")


def test_texts_of_both_shapes(spark):
    got = bodies.fields(table(spark, ("responses", REQUEST), ("messages", MESSAGES), ("responses", None), ("messages", "{bad")), ["k"]).collect()
    told = [[(r.kind, r.text) for r in got if r.k == k] for k in (0, 1)]
    assert told[0] == [("prose", "mail a@b.org"), ("prose", "from c@d.org"), ("tool_argument", "e@f.org"), ("tool_result", "g@h.org"), ("tool_argument", "not json i@j.org"), ("prose", "ask k@l.org")]
    assert told[1] == [("prose", "a@b.org"), ("prose", "c@d.org"), ("prose", "e@f.org"), ("tool_argument", "g@h.org"), ("prose", "i@j.org")]
    assert all(r.k < 2 for r in got)


def test_bodies_are_masked_in_place_and_restored_for_trusted_tools(spark):
    df = table(spark, ("responses", REQUEST), ("messages", MESSAGES), ("messages", {"messages": [{"content": [{"type": "image"}]}]}), ("messages", {"messages": []}))
    keys = mask.session_table(spark, {"s": b"1" * 32})
    out = bodies.mask_bodies(df, keys, ["k"], EMAILS, instruction="Keep aliases.").cache()
    got = {r.k: r for r in out.collect()}
    one, two = json.loads(got[0].body), json.loads(got[1].body)
    assert not any(x in got[0].body for x in ("a@b", "c@d", "e@f", "g@h", "i@j", "k@l")) and "m@n.org" in got[0].body and got[0].entity_counts == {"EMAIL": 6}
    assert one["instructions"].startswith("Keep aliases.\n\nmail mf-user-") and json.loads(one["input"][1]["arguments"])["n"] == 1 and one["input"][4] == "loose"
    assert two["system"][0]["text"] == "Keep aliases." and two["messages"][1]["content"][3]["text"] == "k@l.org"
    assert got[2].body is None and got[2].blocked_by == ["ATTACHMENT"] and json.loads(got[3].body) == {"messages": []}
    known = mask.mappings(out.withColumn("masked", F.col("body")))
    alias = json.loads(one["input"][1]["arguments"])["to"][0]
    answer = {"output": [{"content": [{"type": "output_text", "text": f"to {alias}."}]}, {"name": "good", "arguments": json.dumps({"to": alias})}, {"name": "bad", "arguments": json.dumps({"to": alias})}]}
    other = {"content": [{"type": "text", "text": alias}, {"type": "tool_use", "name": "good", "input": {"x": [alias]}}, {"type": "tool_use", "input": {"x": alias}}]}
    back = [json.loads(r.body) for r in bodies.restore_bodies(table(spark, ("responses", answer), ("messages", other)), known, ["k"], ("good",)).orderBy("k").collect()]
    assert back[0]["output"][0]["content"][0]["text"] == "to e@f.org." and [json.loads(x["arguments"])["to"] for x in back[0]["output"][1:]] == ["e@f.org", alias]
    assert back[1]["content"][0]["text"] == "e@f.org" and [x["input"]["x"] for x in back[1]["content"][1:]] == [["e@f.org"], alias]


def test_opaque_tokens_attachments_and_kinds(spark):
    df = table(spark, ("responses", REQUEST), ("messages", {"a": [{"file_id": "x"}]}), ("responses", {"file_id": 5, "type": "image"}))
    rows = df.select(bodies.opaque_tokens(F.col("body")).alias("t"), bodies.has_attachment(F.col("body"), F.col("shape")).alias("a"), bodies.is_messages(F.col("body")).alias("m")).collect()
    assert rows[0].t == ["1700000000000", "call_123456", "resp_abcdef12"] and [r.a for r in rows] == [False, True, False]
    assert [r.m for r in table(spark, ("", MESSAGES), ("", REQUEST), ("", "x")).select(bodies.is_messages(F.col("body")).alias("m")).collect()] == [True, False, False]
    heads = spark.createDataFrame([({"X-Codex-Turn-Metadata": '{"id": "abcd_123456"}', "y": "z_1234567"},), ({"X-Codex-Turn-Metadata": "{"},)], "h map<string,string>")
    assert [r.t for r in heads.select(bodies.header_payload(F.col("h"))[1].alias("t")).collect()] == [["abcd_123456"], []]
    assert df.select(bodies.without_tokens(F.lit("x ab abc"), F.array(F.lit("ab"), F.lit("abc"))).alias("t")).first().t == "x    "
    assert df.select(bodies.restores_arguments(F.lit("a"), ("a",)).alias("x"), bodies.restores_arguments(F.lit(None), ("a",)).alias("y")).first() == (True, False)


def test_refused_bodies(spark):
    rows = [("{}", "application/json", None, None), ("{}", "text/plain", None, None), ("{}", "application/json; charset=utf-8", "gzip", None), ("[1]", "application/json", "identity", None), ("{", "application/json", "", None), ("{}", "application/json", None, "99999999"), (None, "application/json", None, "x")]
    df = spark.createDataFrame(rows, "body string, type string, coding string, size string")
    assert [r.status for r in bodies.checked(df, content_type="type", encoding="coding", declared="size").collect()] == [200, 415, 415, 400, 400, 413, 400]
    frames = spark.createDataFrame([("{}", False), ("{}", True)], "body string, is_binary boolean")
    assert [r.status for r in bodies.checked(frames, binary="is_binary").collect()] == [200, 415]


VALUES = {"MF_PERSON_AB12": "Ann", "mf-user-ab12@example.invalid": "ann@x.org", "4839201": "555 777"}


def sse(*payloads):
    return "".join(f"event: {p['type']}\ndata: {json.dumps(p)}\n\n" for p in payloads).encode()


RESPONSE = sse(
    {"type": "response.created", "response": {"id": "resp_1"}},
    *({"type": "response.output_text.delta", "output_index": 0, "content_index": 0, "delta": d} for d in ("é hi MF_PER", "SON_AB", "12 48392", "01 x14839201")),
    {"type": "response.output_text.done", "output_index": 0, "content_index": 0, "text": "é hi MF_PERSON_AB12 4839201 x14839201"},
    {"type": "response.output_item.added", "item": {"id": "i1", "name": "good"}}, {"type": "response.output_item.added", "item": {"id": "i2", "name": "bad"}},
    *({"type": "response.function_call_arguments.delta", "item_id": i, "delta": d} for i in ("i1", "i2", "i3") for d in ('{"to": "MF_PER', 'SON_AB12"}')),
    {"type": "response.function_call_arguments.done", "item_id": "i1"}, {"type": "response.function_call_arguments.done", "item_id": "i2"},
    {"type": "response.function_call_arguments.done", "item_id": "i4", "arguments": "{oops"}, {"type": "response.completed", "response": {"id": "resp_1", "output": [{"content": [{"type": "output_text", "text": "MF_PERSON_AB12"}]}]}},
)
MESSAGE = sse(
    {"type": "message_start", "message": {"id": "msg_1"}}, {"type": "content_block_start", "index": 0, "content_block": {"type": "text"}},
    {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "hi mf-user-ab12@exam"}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "ple.invalid MF_"}},
    {"type": "content_block_stop", "index": 0}, {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "name": "good"}},
    {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": '{"a": "MF_PERSON_'}}, {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": 'AB12"}'}},
    {"type": "content_block_stop", "index": 1}, {"type": "content_block_start", "index": 2, "content_block": {"type": "tool_use", "name": "good"}},
)


def told(text):
    return [events.data_of(x) for x in events.Frames().feed(text, True)]


def joined(payloads):
    return "".join(p.get("delta", "") if p["type"] == "response.output_text.delta" else p["delta"].get("text", "") if p["type"] == "content_block_delta" else "" for p in payloads)


def test_streams_of_responses():
    got = told(events.EventRestorer("responses", VALUES, ("good",)).feed(RESPONSE, True))
    assert joined(got) == "é hi Ann 555 777 x14839201"
    assert next(p["text"] for p in got if p["type"] == "response.output_text.done") == "é hi Ann 555 777 x14839201"
    done = {p["item_id"]: p["arguments"] for p in got if p["type"] == "response.function_call_arguments.done"}
    assert done == {"i1": '{"to": "Ann"}', "i2": '{"to": "MF_PERSON_AB12"}'}
    assert sum(p["type"] == "error" for p in got) == 2 and got[-2]["response"]["output"][0]["content"][0]["text"] == "Ann"


def test_streams_of_messages():
    got = told(events.EventRestorer("messages", VALUES, ("good",)).feed(MESSAGE, True))
    assert joined(got) == "hi ann@x.org MF_" and [p["delta"]["partial_json"] for p in got if p.get("delta", {}).get("type") == "input_json_delta"] == ['{"a": "Ann"}']
    assert got[-1]["type"] == "error" and "1 call" in got[-1]["error"]["message"]


@pytest.mark.parametrize("shape, whole", [("responses", RESPONSE), ("messages", MESSAGE)])
def test_any_split_of_a_stream_gives_the_same(shape, whole):
    rng = random.Random(2)
    for text in (whole, whole.replace(b"\n", b"\r\n")):
        expected = told(events.EventRestorer(shape, VALUES, ("good",)).feed(whole, True))
        for _ in range(40):
            state, out, at = None, "", 0
            while at < len(text):
                step = rng.randint(1, 90)
                restorer = events.EventRestorer(shape, VALUES, ("good",), state)
                out += restorer.feed(text[at : at + step], at + step >= len(text))
                state, at = restorer.state(), at + step
            assert told(out) == expected and json.loads(state)["ids"] == ["resp_1" if shape == "responses" else "msg_1"]


def test_arguments_over_the_cap_are_dropped(monkeypatch):
    monkeypatch.setattr(events, "MAX_ARGUMENT_CHARS", 10)
    restorer = events.EventRestorer("responses", {})
    parts = [{"type": "response.function_call_arguments.delta", "item_id": "i", "delta": "x" * 6}] * 4
    got = told(restorer.feed(sse(*parts, {"type": "response.function_call_arguments.done", "item_id": "i"}), True))
    assert len(got) == 1 and "too long" in got[0]["error"]["message"] and restorer.calls == {}


def test_streams_as_tables_and_as_state(spark, tmp_path):
    schema = "s string, seq long, piece binary, is_last boolean, shape string, values map<string,string>"
    rows = [(s, k, bytearray(x), k == 2, shape, VALUES) for s, shape, text in (("a", "responses", RESPONSE), ("b", "messages", MESSAGE)) for k, x in enumerate((text[:211], text[211:500], text[500:]))]
    batch = events.restore_events(spark.createDataFrame(rows, schema), ["s"], ("good",)).collect()
    text = {s: "".join(r.sent for r in sorted((r for r in batch if r.s == s), key=lambda r: r.seq)) for s in "ab"}
    assert told(text["a"]) == told(events.EventRestorer("responses", VALUES, ("good",)).feed(RESPONSE, True))
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sent = events.restore_events(source, ["s"], ("good",))
    query = sent.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {s: "".join(r.sent for r in sorted(got.where(F.col("s") == s).collect(), key=lambda r: r.seq)) for s in "ab"} == text
    sessions = spark.createDataFrame([("a", "s1"), ("b", "s2")], "s string, session_key string")
    assert {tuple(r) for r in events.bindings(got, sessions, ["s"]).collect()} == {("resp_1", "s1"), ("msg_1", "s2")}


def test_one_response_in_flight(spark):
    rows = [("c", 1, "client", "response.create"), ("c", 2, "client", "response.create"), ("c", 3, "server", "response.completed"), ("c", 4, "client", "response.create"), ("d", 1, "client", "other")]
    got = events.responses_in_flight(spark.createDataFrame(rows, "c string, seq int, direction string, type string"), ["c"])
    assert [r.refused for r in got.orderBy("c", "seq").collect()] == [False, True, False, False, False]


def test_the_store_keeps_the_latest_and_opens_only_what_it_wrote(spark, tmp_path):
    key, other = store.new_keys()
    master, path = store.master_table(spark, "db1", key), str(tmp_path / "store")
    store.new_store(spark, path, master)
    rows = spark.createDataFrame([("s1", bytearray(b"k1"), "2024-01-01 10:00:00"), ("s2", None, None), ("s3", bytearray(b"k3"), None)], "id string, key binary, used string").withColumn("used", F.col("used").cast("timestamp"))
    at = lambda t: F.lit(t).cast("timestamp")
    store.append(store.records(rows, master, "session", "id", at("2024-02-01"), at("2024-01-01 10:00:00")), path)
    later = rows.where("id = 's1'").withColumn("key", F.lit(b"new"))
    store.append(store.records(later, master, "session", "id", at("2024-02-01"), at("2024-01-01 11:00:00")), path)
    bound = spark.createDataFrame([("r1", "s3"), ("r2", "s1")], "response_id string, session_key string")
    store.append(store.records(bound, master, "response", "response_id", at("2024-01-01 12:00:00"), at("2024-01-01 10:00:00")), path)
    gone = spark.createDataFrame([("s3",)], "session_key string")
    store.append(store.cascade(gone, bound, master, at("2024-01-01 11:30:00")), path)
    now = store.current(store.opened_store(spark, path, master), at("2024-01-01 11:45:00")).cache()
    got = {r.id: (r.key and bytes(r.key), r.used and str(r.used)) for r in store.read(now, master, "session", dict(rows.dtypes)).collect()}
    assert got == {"s1": (b"new", "2024-01-01 10:00:00"), "s2": (None, None)}
    assert [r.response_id for r in store.read(now, master, "response", dict(bound.dtypes)).collect()] == ["r2"]
    asked = spark.createDataFrame([("s1",), ("s3",), ("x",)], "id string")
    assert {r.id: r.known for r in store.found(now, asked, master, "session", "id").collect()} == {"s1": True, "s3": False, "x": False}
    assert store.current(spark.read.parquet(path), at("2024-01-01 13:00:00")).where("kind = 'response'").count() == 0
    store.compact(spark.read.parquet(path), at("2024-01-01 11:45:00"), str(tmp_path / "new"))
    assert store.opened_store(spark, str(tmp_path / "new"), master).count() == now.count()
    with pytest.raises(Exception, match="(?i)tag|check"):
        store.opened_store(spark, path, store.master_table(spark, "db1", other))
    with pytest.raises(Exception, match="(?i)tag"):
        store.read(now.where("kind = 'session'"), store.master_table(spark, "db2", key), "session", dict(rows.dtypes)).collect()


def test_requests_that_cannot_be_served(spark):
    df = spark.createDataFrame([("mf-user-0123456789ab@example.invalid", False, False), ("x", False, False), ("MF_PERSON_0123456789AB", True, False), ("x", True, True)], "t string, stable boolean, unknown_previous boolean")
    assert [r.s for r in df.select(store.refused(df, "t").alias("s")).collect()] == [409, 200, 200, 409]


def test_registered_originals_are_found_anywhere(spark):
    df = spark.createDataFrame([(1, "s", '{"Secret": ["x ann y", 1234567]}'), (2, "t", '{"a": "ann"}'), (3, "s", "{}")], "k int, session_id string, b string")
    known = spark.createDataFrame([("s", v) for v in ("Ann", "secret", "34567", "Secret")], "session_id string, value string")
    assert {tuple(r) for r in walk.registered_leaks(df, ["k"], "b", known).collect()} == {(1, "key", "Secret"), (1, "number", "34567")}
    assert {tuple(r) for r in walk.registered_leaks(df, ["k"], "b", known, ignore_case=True).collect()} == {(1, "key", "secret"), (1, "value", "ann"), (1, "number", "34567")}


def test_surfaces_are_scored_one_to_one(spark):
    gold = spark.createDataFrame([(1, 0, "P", "Ann Lee"), (1, 1, "P", "Bob"), (2, 0, "L", "Rome")], "doc int, n int, entity_type string, value string")
    found = spark.createDataFrame([(1, 0, "P", "Ann", False), (1, 1, "P", "Ann Lee", False), (2, 0, "P", "Rome", False), (3, 0, "P", "x", True), (3, 1, "P", "y", False)], "doc int, n int, entity_type string, value string, code boolean")
    got = {r.entity_type: r for r in metrics.surface_scores(gold, found, ["doc"], F.col("code")).collect()}
    assert (got["P"].tp, got["P"].fp, got["P"].fn, got["P"].prose_fp, got["P"].code_fp) == (1, 4, 1, 1, 1) and (got["L"].tp, got["L"].fn, got["L"].precision) == (0, 1, 1.0)


def test_upstream_addresses():
    assert headers.upstream("https://api.example.org/", "https://api.example.org") == "https://api.example.org" and headers.upstream("http://localhost:80", "x") == "http://localhost:80"
    for bad in ("https://other.org", "ftp://localhost", "http://u:p@localhost", "http://localhost?q", "http://localhost:x", "http://"):
        with pytest.raises(ValueError):
            headers.upstream(bad, "https://api.example.org")
