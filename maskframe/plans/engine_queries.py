"""Queries of the operators around masking: sessions, headers, segments, JSON, aliases of structure, metrics, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions import normalize
from maskframe.operators import bodies, headers, metrics, segments as seg, state, store, structure, walk
from maskframe.sources import sse
from maskframe.streaming import restore

NOW = "2024-01-30 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions: begun with the first event, used last with the last, ending 29 days after the first."""
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("begun"), F.max("ts").alias("last_used"))
    ends = F.col("begun") + F.make_dt_interval(days=F.lit(29))
    return used.select("user_id", state.expired(F.lit(NOW).cast("timestamp_ntz"), F.col("last_used").cast("timestamp_ntz"), ends.cast("timestamp_ntz"), 10).alias("expired"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey")
    return state.cascade_delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


def order_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return state.upsert(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def _some_headers(names: tuple[str, ...], value: Column) -> Column:
    """A map that holds the k-th name where bit k of the event's id is set."""
    pairs = F.array(*(F.when(F.shiftright("event_id", k) % 2 == 1, F.struct(F.lit(n).alias("k"), F.concat(F.lit(f"{n}="), value).alias("v"))) for k, n in enumerate(names)))
    return F.map_from_entries(F.array_compact(pairs))


SESSION_HEADERS = ("Session-Id", "thread-id", "X-Session")
HEADERS = ("Accept", "Cookie", "Session-Id", "anthropic-x", "x-api-key", "openai-beta", "Via")


def session_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: their ids tell which headers they have; every third names an earlier response, some unknown."""
    user = F.col("user_id").cast("string")
    requests = table(spark, sf_dir, "events").select("event_id", _some_headers(SESSION_HEADERS, user).alias("headers"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), user)).alias("previous_response_id"))
    bound = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("response_id"), F.concat(F.lit("s"), "c_custkey").alias("session_key")).where("c_acctbal > 0")
    return state.with_session(requests, bound, "x-session", ("session-id", "thread-id")).select("event_id", "session_key", "stable", "unknown_previous")


def header_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", _some_headers(HEADERS, F.col("user_id").cast("string")).alias("h"))
    names = lambda m: F.concat_ws(",", F.array_sort(F.map_keys(m)))
    h = F.col("h")
    return df.select("event_id", names(headers.forwarded(h, "openai")).alias("openai"), names(headers.forwarded(h, "anthropic")).alias("anthropic"), names(headers.scannable(h)).alias("scanned"), names(headers.free_text(h, "anthropic")).alias("free_text"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


def metric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns({
        "provider": metrics.provider_of(F.element_at(F.array(*map(F.lit, ("/v1/messages", "/responses", "/ready", "/x"))), (F.col("user_id") % 4 + 1).cast("int"))),
        "outcome": metrics.outcome(200 + F.col("event_id") % 4 * 100),
        "label": metrics.entity_label(F.col("event_type"), ("click", "view")),
        "ms": F.col("event_id") % 100,
    })
    return metrics.counters(events, ["provider", "outcome", "label"], "ms")


def events_event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def lines_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, one for each number."""
    rest = ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in rest))


LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)"


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as gold spans, each alone in its place; found spans are shifted by the quantity, some left out."""
    lines = lines_once(spark, sf_dir)
    at = F.col("l_linenumber").cast("int") * 1000
    kind = F.col("l_returnflag").alias("entity_type")
    gold = lines.where("l_partkey % 7 <> 0").select("l_orderkey", kind, at.alias("start"), (at + 20).alias("end"))
    shift = at + F.col("l_suppkey").cast("int") % 40
    found = lines.where("l_partkey % 5 <> 0").select("l_orderkey", kind, shift.alias("start"), (shift + 10).alias("end"))
    return metrics.scores(gold, found, ["l_orderkey"])


def ner_window_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fuzzy_windows(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumnRenamed("end", "stop")


def ner_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")
    return metrics.best_per_span(lines, ["l_partkey", "l_returnflag"], "l_quantity", ["l_orderkey", "l_linenumber"])


def json_string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.leaves(table(spark, sf_dir, "events"), ["event_id"], "props", with_numbers=True)


def alias_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", structure.url_alias(F.sha2("url", 256), F.col("url")).alias("alias"))


def alias_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/data/"), F.col("p_size").cast("string"), F.lit("/../p"), F.col("p_partkey").cast("string"), F.lit(".tar.gz"))
    return parts.select("p_partkey", structure.path_alias(F.lit("abc"), path).alias("alias"))


def segment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segments(table(spark, sf_dir, "documents"), ["doc_id"], "text").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def coalesce_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as segments; those of flag R leave a gap before them."""
    k = F.col("l_linenumber").cast("int") * 10
    rows = lines_once(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_returnflag") == "R", k + 1).otherwise(k).alias("start"), (k + 10).alias("end"), F.col("l_linestatus").alias("kind"))
    return seg.coalesced(rows, ["doc"]).withColumnRenamed("end", "stop")


def nfkc_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every document in NFKC; DuckDB has NFC only, so there is no SQL."""
    got = normalize.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(got["normalized"]).cast("long").alias("n"))


def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation written as events and read back."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    none = F.array().cast("array<string>")
    wire = turns.select("conv_id", "turn", sse.serialize(none, F.col("role"), F.split("text", "\n"), F.col("turn").cast("string"), F.lit(None)).alias("wire"))
    events = sse.parse(wire, ["conv_id", "turn"], "wire")
    return events.select("conv_id", "turn", F.col("event").alias("role"), F.array_join("data", "\n").alias("text"))


def stream_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as pieces of a list; every fifth user's list is not closed, every seventh's call not done."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("],")).alias("chunk"), F.lit(False).alias("is_done"))
    users = events.select("user_id").distinct()
    first = users.select("user_id", F.lit(-1).cast("long").alias("seq"), F.lit("[").alias("chunk"), F.lit(False).alias("is_done"))
    last = users.select("user_id", F.lit(1 << 60).alias("seq"), F.when(F.col("user_id") % 5 == 0, "0").otherwise("0]").alias("chunk"), (F.col("user_id") % 7 != 0).alias("is_done"))
    return restore.reassembled(events.unionByName(first).unionByName(last), ["user_id"])


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as request bodies of both shapes, by the parity of their ids."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    said = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    parts = F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), t["text"].alias("text"))).alias("content")))
    even = F.col("conv_id") % 2 == 0
    body = F.when(even, F.to_json(F.struct(said.alias("messages"), F.lit(9).alias("max_tokens")))).otherwise(F.to_json(F.struct(parts.alias("input"))))
    return turns.select("conv_id", F.when(even, "messages").otherwise("responses").alias("shape"), body.alias("body"))


def request_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = request_bodies(spark, sf_dir)
    return bodies.fields(df, ["conv_id"]).select("conv_id", "n", "kind", "text")


def request_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with every text turned around, read again."""
    df = request_bodies(spark, sf_dir)
    changed = bodies.fields(df, ["conv_id"]).select("conv_id", "path", F.reverse("text").alias("text"))
    return bodies.fields(bodies.rebuilt(df, changed, ["conv_id"]), ["conv_id"]).select("conv_id", "n", "text")


def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bodies: with opaque tokens, attachments and flaws by their ids and types."""
    k = F.col("event_id")
    item = F.struct(F.concat(F.lit("call_"), F.lpad(k.cast("string"), 8, "0")).alias("call_id"), F.when(k % 4 == 0, "input_image").otherwise("message").alias("type"), F.col("event_type").alias("text"))
    body = F.to_json(F.struct(F.array(item).alias("input"), F.when(k % 3 == 0, F.concat(F.lit("resp_"), F.lpad(F.col("user_id").cast("string"), 6, "0"))).otherwise("short").alias("previous_response_id")))
    cut = F.when(k % 10 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(k % 10 == 1, F.substring(body, 1, 9)).otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"), cut.alias("sent"), F.when(k % 6 == 5, "text/plain").otherwise("application/json").alias("type"), F.when(k % 13 == 3, "gzip").alias("coding"))


def opaque_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_bodies(spark, sf_dir)
    return df.select("event_id", F.concat_ws(",", bodies.opaque_tokens(F.col("body"))).alias("tokens"), bodies.has_attachment(F.col("body"), F.lit("responses")).alias("attached"))


def body_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies.checked(event_bodies(spark, sf_dir), "sent", content_type="type", encoding="coding").select("event_id", "status")


def store_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes to a sealed store (the last event of some users ends them), and what it holds at a time, opened."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    master = store.master_table(spark, "demo", bytes(range(32)))
    kept = store.records(events.select("user_id", "event_id", "event_type", "ts"), master, "session", "user_id", F.col("ts") + F.make_dt_interval(days=F.lit(20)), F.col("ts") + F.make_dt_interval(secs=F.col("event_id") / 1e6))
    ends = events.where("user_id % 6 = 0").groupBy("user_id").agg(F.max("ts").alias("ts")).withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.lit(1)))
    every = kept.unionByName(store.records(ends, master, "session", "user_id", F.lit(None), F.col("ts"), gone=True))
    schema = {"user_id": "bigint", "event_id": "bigint", "event_type": "string", "ts": "timestamp"}
    return store.read(store.current(every, F.lit(NOW).cast("timestamp")), master, "session", schema).select("user_id", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        session_expiry, cascade_delete, order_upsert, session_precedence, header_allowlist, latency_percentiles, metric_labels, events_event_type_counts, precision_recall,
        ner_window_offsets, ner_dedupe, json_string_leaves, alias_url, alias_path, segment_kinds, coalesce_segments, nfkc_values, sse_events, stream_arguments,
        request_fields, request_rebuilt, opaque_tokens, body_status, store_current,
    )
}

def _token(token: str, label: str) -> str:
    return f"substr(sha256({token} || chr(31) || {label}), 1, 8)"


ORACLE_SQL = {
    "session_expiry": f"""SELECT user_id, TIMESTAMP '{NOW}' >= min(ts) + INTERVAL 29 DAY OR TIMESTAMP '{NOW}' >= max(ts) + INTERVAL 10 HOUR AS expired FROM events GROUP BY user_id""",
    "cascade_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "order_upsert": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "session_precedence": """SELECT event_id, coalesce(named, bound) AS session_key, named IS NOT NULL OR bound IS NOT NULL AS stable, named IS NULL AND asked AND bound IS NULL AS unknown_previous
      FROM (SELECT event_id, CASE WHEN (event_id >> 2) % 2 = 1 THEN 'X-Session=' || user_id WHEN event_id % 2 = 1 THEN 'session-id:Session-Id=' || user_id WHEN (event_id >> 1) % 2 = 1 THEN 'thread-id:thread-id=' || user_id END AS named,
        event_id % 3 = 0 AS asked, CASE WHEN event_id % 3 = 0 AND c_acctbal > 0 THEN 's' || c_custkey END AS bound FROM events LEFT JOIN customer ON c_custkey = user_id)""",
    "header_allowlist": f"""WITH h AS (SELECT event_id, list_filter({list(HEADERS)}, lambda n, i: (event_id >> (i - 1)) % 2 = 1) AS n FROM events)
      SELECT event_id, array_to_string(list_sort(list_filter(n, lambda x: x IN ('Accept', 'Session-Id', 'openai-beta'))), ',') AS openai,
        array_to_string(list_sort(list_filter(n, lambda x: x IN ('Accept', 'anthropic-x', 'x-api-key'))), ',') AS anthropic,
        array_to_string(list_sort(list_filter(n, lambda x: x IN ('Cookie', 'Session-Id', 'anthropic-x', 'openai-beta'))), ',') AS scanned, array_to_string(list_filter(n, lambda x: x = 'anthropic-x'), ',') AS free_text FROM h""",
    "latency_percentiles": """SELECT event_type, min(value) FILTER (share >= 0.5) AS p50, min(value) FILTER (share >= 0.95) AS p95
      FROM (SELECT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS share FROM events WHERE value IS NOT NULL) GROUP BY event_type""",
    "metric_labels": """SELECT CASE user_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'admin' ELSE 'unknown' END AS provider,
      CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'success' WHEN 2 THEN 'client_error' ELSE 'server_error' END AS outcome,
      CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'CUSTOM' END AS label, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS ms_sum FROM events GROUP BY ALL""",
    "events_event_type_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "precision_recall": f"""WITH t AS (SELECT l_returnflag AS entity_type, CAST(count(*) FILTER (g AND f AND s < 20) AS BIGINT) AS tp, CAST(count(*) FILTER (f AND NOT (g AND s < 20)) AS BIGINT) AS fp, CAST(count(*) FILTER (g AND NOT (f AND s < 20)) AS BIGINT) AS fn
        FROM (SELECT l_returnflag, l_partkey % 7 <> 0 AS g, l_partkey % 5 <> 0 AS f, l_suppkey % 40 AS s FROM {LINES}) GROUP BY 1),
      u AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 1.0::DOUBLE) AS p, coalesce(tp / nullif(tp + fn, 0), 1.0::DOUBLE) AS r FROM t)
      SELECT entity_type, tp, fp, fn, p AS "precision", r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0.0::DOUBLE) AS f1 FROM u""",
    "ner_window_offsets": """SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(s + 400, length(text)) AS INTEGER) AS stop
      FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 64, 1), 336)) AS s FROM documents WHERE length(text) > 0)""",
    "ner_dedupe": """SELECT l_partkey, l_returnflag, l_quantity, l_orderkey, l_linenumber FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) = 1""",
    "json_string_leaves": """SELECT event_id, 'key' AS kind, unnest(json_keys(props)) AS value FROM events
      UNION ALL SELECT event_id, 'number', json_extract_string(props, '$.k') FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')""",
    "alias_url": f"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://mf-host-' || {_token("t", "'host'")} || '.example.invalid' ||
        array_to_string(list_transform(string_split(path, '/'), lambda s, i: CASE WHEN s = '' THEN '' ELSE 'mf-seg-' || {_token("t", "('seg' || (i - 1))")} || regexp_extract(s, '^[^.]*(.*)$', 1) END), '/') ||
        CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_transform(string_split(query, '&'), lambda q, i: regexp_extract(q, '^([^=]*)', 1) || '=mf-val-' || {_token("t", "('q' || (i - 1))")}), '&') END ||
        CASE WHEN contains(url, '#') THEN '#mf-frag-' || {_token("t", "'frag'")} ELSE '' END AS alias
      FROM (SELECT page_id, url, sha256(url) AS t, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages)""",
    "alias_path": f"""SELECT p_partkey, '/mf-seg-' || {_token("'abc'", "'seg1'")} || '/mf-seg-' || {_token("'abc'", "'seg2'")} || '/../mf-seg-' || {_token("'abc'", "'seg4'")} || '.tar.gz' AS alias FROM part""",
    "coalesce_segments": f"""WITH s AS (SELECT l_orderkey AS doc, CAST(l_linenumber * 10 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS start, CAST(l_linenumber * 10 + 10 AS INTEGER) AS stop, l_linestatus AS kind FROM {LINES}),
        n AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(stop) OVER w = start THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY doc ORDER BY start)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY start) AS run FROM n)
      SELECT doc, kind, min(start) AS start, max(stop) AS stop FROM r GROUP BY doc, run, kind""",
    "sse_events": "SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL",
    "stream_arguments": """SELECT user_id, CASE WHEN user_id % 7 <> 0 AND user_id % 5 <> 0 THEN '[' || string_agg('[' || event_id || '],', '' ORDER BY event_id) || '0]' END AS arguments,
      CASE WHEN user_id % 7 = 0 THEN 'unfinished' WHEN user_id % 5 = 0 THEN 'invalid JSON' END AS error FROM events GROUP BY user_id""",
    "request_fields": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS n, 'prose' AS kind, coalesce(text, '') AS text FROM conversations",
    "request_rebuilt": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS n, reverse(coalesce(text, '')) AS text FROM conversations",
    "opaque_tokens": """SELECT event_id, 'call_' || lpad(CAST(event_id AS VARCHAR), 8, '0') || CASE WHEN event_id % 3 = 0 THEN ',resp_' || lpad(CAST(user_id AS VARCHAR), 6, '0') ELSE '' END AS tokens, event_id % 4 = 0 AS attached FROM events""",
    "body_status": "SELECT event_id, CASE WHEN event_id % 13 = 3 THEN 415 WHEN event_id % 6 = 5 THEN 415 WHEN event_id % 10 < 2 THEN 400 ELSE 200 END AS status FROM events",
    "store_current": f"""SELECT user_id, event_id, event_type FROM events WHERE user_id % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts + to_microseconds(event_id) DESC) = 1 AND ts + INTERVAL 20 DAY > TIMESTAMP '{NOW}'""",
}
