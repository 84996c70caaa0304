"""Counts that are observed while rows are written equal those of the rows, in batches and streams."""

from collections import Counter

from pyspark.sql import Observation

from maskframe.operators import audit, mask, rules
from maskframe.plans import stream_queries
from maskframe.streaming.mask import mask_stream

ROWS = [(k, "s1", f"u{k}@b.org wrote to 10.0.{k}.7") for k in range(30)] + [(30, "gone", "a@b.org"), (31, "s1", None), (32, "s1", "card 4242 4242 4242 4242 and c@d.org"), (33, None, ""), (34, "s1", "x" * 600), (35, "s1", "Aurora a@b.org")]
CUSTOM = rules.Rule("user_regex", "MY_CODENAME", "Aurora", 0.9, 100, "prose_identifier", "literal")


def plain(rows):
    seen = Counter()
    for r in rows.collect():
        seen["event", "request_blocked" if r.blocked_by else "request_masked"] += 1
        for kind, labels in (("reason", r.blocked_by), ("entity", [a.entity_type for a in r.aliases or [] if not r.error])):
            seen.update((kind, x if x in audit.KNOWN or kind == "reason" else "CUSTOM") for x in labels)
    return dict(seen)


def told(log):
    seen = Counter()
    for r in log.collect():
        seen[r.kind, r.label] += r.n
    return dict(seen)


def test_batch_counts_and_records(spark, tmp_path):
    keys = mask.session_table(spark, {"s1": b"k" * 32})
    masked = mask.mask(spark.createDataFrame(ROWS, "k long, session_id string, text string"), keys, ["k"], "text", [*rules.built_in(), CUSTOM], max_chars=500)
    audit.write_audited(masked, f"{tmp_path}/rows", f"{tmp_path}/log", "first")
    rows, log = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/log")
    want = plain(rows)
    assert rows.count() == len(ROWS) and told(log) == want and {(r.run, r.batch) for r in log.collect()} == {("first", None)}
    assert want["event", "request_blocked"] == 4 and want["reason", "NO_SESSION"] == 2 and want["reason", "TEXT_TOO_LONG"] == 1 and want["reason", "CREDIT_CARD"] == 1
    assert want["entity", "EMAIL"] == 32 and want["entity", "IP_ADDRESS"] == 30 and want["entity", "CUSTOM"] == 1
    got = {r.k: r for r in audit.records(rows, ["k"]).collect()}
    assert got[0].entity_count == 2 and got[0].reason is None and len(got[0].session_fp) == 12 and got[33].session_fp is None
    assert (got[30].event, got[30].reason, got[30].entity_count) == ("request_blocked", "NO_SESSION", None) and got[32].reason == "CREDIT_CARD" and got[31].entity_count == 0
    assert not any(secret in str(r) for r in [*log.collect(), *got.values()] for secret in ("@", "4242", "Aurora"))


def test_an_empty_table_counts_nothing(spark, tmp_path):
    keys = mask.session_table(spark, {"s1": b"k" * 32})
    masked = mask.mask(spark.createDataFrame([], "k long, session_id string, text string"), keys, ["k"], "text", rules.built_in())
    audit.write_audited(masked, f"{tmp_path}/rows", f"{tmp_path}/log", "none")
    assert spark.read.schema(audit.SCHEMA).parquet(f"{tmp_path}/log").count() == 0 and audit.observed(masked, Observation()).count() == 0


def test_stream_counts_by_batch(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k long, session_id string, text string")
    for a, b in ((0, 10), (10, 31), (31, 99)):
        df.where(f"k >= {a} and k < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with stream_queries.rocksdb(spark):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        masked = mask_stream(stream, mask.session_table(spark, {"s1": b"k" * 32}), ["k"], "k", "text", [*rules.built_in(), CUSTOM], max_chars=500)
        audit.stream_audited(masked, f"{tmp_path}/rows", f"{tmp_path}/log", f"{tmp_path}/checkpoint", "run").awaitTermination()
    rows, log = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/log")
    assert rows.count() == len(ROWS) and told(log) == plain(rows)
    by_batch = {r.batch: r["sum(n)"] for r in log.where("kind = 'event'").groupBy("batch").sum("n").collect()}
    assert by_batch == {r.batch: r["count"] for r in rows.groupBy("batch").count().collect()} and len(by_batch) == 3
