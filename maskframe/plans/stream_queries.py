"""Queries that run a stream over a table to its end, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.streaming import bindings, relay
from maskframe.streaming.mask import ROCKSDB, mask_stream
from maskframe.streaming.shared import folder, run_to_end

from .queries import EMAILS, FORMATS, _hmac, _pad, document_sessions

#: Documents that share a session, and the idle time of a binding.
SESSIONS, IDLE_US = 50, 2 * 24 * 3600 * 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session with the state store of RocksDB, as long as streams run."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def mask_stream_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a row of a stream, masked under the e-mail rule in sessions of many documents."""
    path = f"{sf_dir}/documents.parquet"
    # as a pattern: a stream reads files or folders by it, while a plain path must be a folder
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[d]ocuments.parquet")
    rows = docs.select("doc_id", F.concat(F.lit("s"), F.coalesce(F.pmod("doc_id", F.lit(SESSIONS)), F.lit(0))).alias("session_id"), "text")
    sessions = document_sessions(spark.range(SESSIONS).select(F.concat(F.lit("s"), "id").alias("session_id")))
    out = folder(spark, "mask-stream")
    with rocksdb(spark):
        masked = mask_stream(rows, sessions, ["doc_id"], "doc_id", "text", [r for r in FORMATS if r.entity == "EMAIL"])
        return run_to_end(masked.select("doc_id", "masked", "error"), f"{out}/rows", f"{out}/checkpoint")


def bindings_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as uses of one binding: purchases bind it anew to a session, all else are requests for it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"at": F.col("ts").cast("timestamp_ntz"), "session": F.when(F.col("event_type") == "purchase", F.concat(F.lit("s"), "event_id"))})
    return bindings.resolved(bindings.uses(events, "user_id", "at", "event_id", "session"), IDLE_US).select(F.col("order").alias("event_id"), F.col("session_key"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a frame of a connection: eight in a row are one, each fourth asks or ends, the others are by type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    place = F.pmod(F.col("event_id"), F.lit(8))
    kind = (
        F.when(place.isin(0, 4), "response.create")
        .when(place.isin(3, 7) & (F.col("event_type") != "signup"), "response.completed")
        .when(F.col("event_type") == "purchase", "session.update")
        .when(F.col("event_type") == "error", "responsesapi.websocket_timing")
        .otherwise("response.output_text.delta")
    )
    fields = F.concat(
        F.lit('{"type": "'), kind, F.lit('", "props": '), "props",
        F.when(place.isin(0, 4) & (F.col("user_id") % 5 == 0), F.concat(F.lit(', "previous_response_id": "r'), "user_id", F.lit('"'))).otherwise(""),
        F.when(place.isin(3, 7) & (F.col("event_id") % 3 == 0), ', "status": 499').otherwise(""),
        F.when(place.isin(0, 4) & (F.col("user_id") % 17 == 0), ', "stream": false').otherwise(""),
        F.lit("}"),
    )
    message = F.when(F.col("user_id") % 29 == 1, F.lit(None)).when(F.col("user_id") % 29 == 2, "[1]").when(F.col("user_id") % 29 == 3, '{"type"').otherwise(fields)
    direction = F.when(kind.isin("response.create", "session.update"), "client").otherwise("server")
    return events.select(F.floor(F.col("event_id") / 8).alias("connection"), F.col("event_id").alias("seq"), direction.alias("direction"), message.alias("message"), F.lit("s0").alias("session_key"), F.concat(F.lit("s"), F.col("user_id") % 2).alias("bound"), (F.col("value") > 60).alias("leaks"))


def relayed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each of these frames."""
    return relay.relayed(event_frames(spark, sf_dir)).select("connection", "seq", "action", "answer", "code", "status", "closed_with")


QUERIES = {f.__name__: f for f in (mask_stream_emails, bindings_resolved, relayed_frames)}

ORACLE_SQL = {
    "mask_stream_emails": f"""SELECT doc_id, list_reduce(list_prepend(text, list_sort(list_distinct({EMAILS}))), lambda t, v: replace(t, v, 'mf-user-' || substr({_hmac("i", "o", "encode(v || chr(0) || 'EMAIL' || chr(0) || 'email')")}, 1, 12) || '@example.invalid')) AS masked, CAST(NULL AS VARCHAR) AS error
      FROM (SELECT doc_id, text, {_pad(0x3, 0x6)} AS i, {_pad(0x5, 0xC)} AS o FROM (SELECT doc_id, text, sha256('s' || coalesce(CAST(doc_id % {SESSIONS} AS VARCHAR), '0')) AS h FROM documents))""",
    "bindings_resolved": f"""WITH e AS (SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, CASE WHEN event_type = 'purchase' THEN 's' || event_id END AS session FROM events),
        g AS (SELECT *, CASE WHEN us - lag(us) OVER w < {IDLE_US} THEN 0 ELSE 1 END AS new FROM e WHERE user_id IS NOT NULL AND us IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM g)
      SELECT event_id, (SELECT arg_max(b.session, (b.us, b.event_id)) FROM r AS b WHERE b.user_id = r.user_id AND b.run = r.run AND b.session IS NOT NULL AND (b.us, b.event_id) < (r.us, r.event_id)) AS session_key FROM r WHERE session IS NULL
      UNION ALL SELECT event_id, NULL FROM e WHERE (user_id IS NULL OR us IS NULL) AND session IS NULL""",
    "relayed_frames": """WITH e AS (SELECT event_id AS seq, event_id // 8 AS connection, event_id % 8 AS place, user_id % 29 AS odd, user_id, value, event_type FROM events),
        k AS (SELECT *, CASE WHEN place IN (0, 4) THEN 'ask' WHEN place IN (3, 7) AND event_type <> 'signup' THEN 'end' WHEN event_type = 'purchase' THEN 'other' WHEN event_type = 'error' THEN 'own' ELSE 'piece' END AS kind FROM e),
        f AS (SELECT *, kind IN ('ask', 'other') AS client, CASE WHEN odd IN (1, 2, 3) THEN NULL WHEN kind = 'ask' THEN 1 WHEN kind = 'end' THEN 0 END AS turn FROM k),
        s AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER w, 0) AS busy, coalesce(sum(turn) OVER w, 0) AS asked FROM f WINDOW w AS (PARTITION BY connection ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, CASE WHEN client THEN CASE WHEN odd = 1 THEN 'binary_message_not_supported' WHEN odd = 2 THEN 'invalid_body' WHEN odd = 3 THEN 'invalid_json' WHEN kind = 'ask' AND user_id % 17 = 0 THEN 'invalid_websocket_field'
            WHEN kind = 'ask' AND busy = 1 THEN 'response_in_progress' WHEN kind = 'ask' AND user_id % 5 = 0 AND user_id % 2 = 1 THEN 'session_unresolved' WHEN value > 60 THEN 'blocked' END
          ELSE CASE WHEN odd = 1 THEN 'invalid_upstream_message' WHEN odd IN (2, 3) THEN 'invalid_upstream_json' WHEN busy = 1 THEN NULL WHEN kind <> 'own' THEN 'unexpected_upstream_event' WHEN value > 60 THEN 'blocked' END END AS wrong FROM s),
        m AS (SELECT *, min(CASE WHEN wrong IS NOT NULL THEN seq END) OVER (PARTITION BY connection) AS closed FROM c)
      SELECT connection, seq, CASE WHEN seq > closed THEN 'drop' WHEN seq = closed THEN 'close' ELSE 'pass' END AS action,
        CASE WHEN coalesce(seq < closed, true) AND (busy = 1 OR turn = 1) THEN CAST(asked + CASE WHEN busy = 1 THEN 0 ELSE 1 END AS BIGINT) END AS answer,
        CASE WHEN seq = closed THEN wrong END AS code,
        CASE WHEN seq = closed THEN CASE WHEN wrong IN ('response_in_progress', 'session_unresolved') THEN 409 WHEN wrong LIKE '%upstream%' THEN 502 ELSE 400 END WHEN coalesce(seq < closed, true) AND kind = 'end' THEN CASE WHEN seq % 3 = 0 THEN 499 ELSE 200 END END AS status,
        CASE WHEN seq = closed THEN CASE WHEN wrong = 'binary_message_not_supported' THEN 1003 WHEN wrong LIKE '%upstream%' THEN 1011 ELSE 1008 END END AS closed_with FROM m""",
}
