"""Sessions' pairs beside their rows, and the linear matching of spans."""

import json
import random
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from maskframe.operators import by_session, detect, mask, metrics
from maskframe.streaming import mask as streamed


def test_every_row_meets_its_sessions_pairs_once_a_part(spark):
    rows = [(k, "hot" if k % 3 else f"s{k}", f"x{k % 50} y{k % 7}") for k in range(600)] + [(1000, None, "x1"), (1001, "none", "x1"), (1002, "hot", None), (1003, "hot", "")]
    df = spark.createDataFrame(rows, "k int, session_id string, t string")
    pairs = spark.createDataFrame([("hot", f"x{k}", f"v{k}") for k in range(50)] + [(f"s{k}", "y0", "z") for k in range(0, 600, 3)] + [("other", "a", "b")], "session_id string, first string, second string")
    calls = spark.sparkContext.accumulator(0)

    def prepare(values):
        calls.add(1)
        return values

    out = by_session.with_session_pairs(df, pairs, "t", prepare, lambda own, t, row: " ".join((own or {}).get(w, w) for w in t.split(" ")) + row["session_id"][:0] if row["session_id"] else t, "o", "string")
    got = {r.k: r.o for r in out.collect()}
    of = {"hot": {f"x{k}": f"v{k}" for k in range(50)}} | {f"s{k}": {"y0": "z"} for k in range(0, 600, 3)}
    assert got == {k: None if t is None else " ".join(of.get(s, {}).get(w, w) for w in t.split(" ")) for k, s, t in rows}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert calls.value <= parts + 200  # the hot session once a part, the others have a row each


def test_restoring_ten_thousand_aliases_of_one_session(spark):
    known = spark.range(10_000).select(F.lit("s").alias("session_id"), F.format_string("mf-user-%012x@example.invalid", "id").alias("alias"), F.concat(F.lit("u"), "id").alias("value"), F.lit("literal").alias("policy"))
    df = spark.range(3000).select("id", F.lit("s").alias("session_id"), F.format_string("mail mf-user-%012x@example.invalid now", "id").alias("t"))
    got = mask.restore(df, known, ["id"], "t")
    assert got.where(F.col("restored") != F.concat(F.lit("mail u"), "id", F.lit(" now"))).count() == 0 and got.count() == 3000


def plain(gold, found):
    tp, free = 0, sorted(found)
    for a, b in sorted(gold):
        first = next((f for f in free if f[0] < b and a < f[1]), None)
        if first:
            free.remove(first)
            tp += 1
    return tp


def test_matching_equals_a_plain_fold_and_is_linear(spark):
    rng = random.Random(3)
    for _ in range(300):
        span = lambda: (a := rng.randrange(40), a + rng.randrange(9))
        gold, found = [span() for _ in range(rng.randrange(15))], [span() for _ in range(rng.randrange(15))]
        rows = sorted([(*g, False) for g in gold] + [(*f, True) for f in found])
        assert metrics.matches(iter(rows)) == (plain(gold, found), len(found), len(gold))
    n = 100_000
    began = time.time()
    assert metrics.matches(iter(sorted([(3 * k, 3 * k + 5, False) for k in range(n)] + [(3 * k + 1, 3 * k + 3, True) for k in range(n)])))[0] == n
    assert time.time() - began < 5
    df = lambda rows: spark.createDataFrame(rows, "d int, entity_type string, start int, end int")
    got = {r.entity_type: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in metrics.scores(df([(1, "A", 0, 5), (1, "B", 0, 5), (2, None, 1, 2)]), df([(1, "A", 4, 9), (1, "A", None, 3), (3, "C", 1, 2)]), ["d"]).collect()}
    assert got == {"A": (1, 1, 0, 0.5, 1.0), "B": (0, 0, 1, 1.0, 0.0), None: (0, 0, 1, 1.0, 0.0), "C": (0, 1, 0, 0.0, 1.0)}


def test_one_session_of_all_rows_is_dealt_to_many_parts(spark):
    """Rows meet what their session has in parts, so that no task reads a whole session's texts."""
    rows = spark.range(2000).selectExpr("id", "if(id = 7, null, if(id = 8, 'b', 'a')) as session_id")
    sessions = spark.createDataFrame([("a", 1)], "session_id string, n int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = by_session.with_session_row(rows, sessions, ["id"]).selectExpr("id", "session_id", "n", "spark_partition_id() as p").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 2000 and all((r.n == 1) == (r.session_id == "a") for r in got)
    assert len({r.p for r in got if r.session_id == "a"}) > 1


def test_batches_are_masked_some_rows_at_a_time():
    sizes = []

    def run(texts, other):
        sizes.append(len(texts))
        return texts

    texts = pa.array([None if k % 7 == 0 else str(k) for k in range(1000)])
    assert detect.in_slices(run, texts, texts).equals(texts) and max(sizes) == detect.SOME and detect.in_slices(run, texts[:0], texts[:0]).equals(texts[:0])
    hits = pa.array([[]] * 1000, detect.hit_lists([[]]).type)
    masked = mask._masked(texts, hits, pa.nulls(1000, pa.map_(pa.string(), pa.string())), pa.nulls(1000, pa.string()))
    assert masked.field("masked").equals(texts)


def test_a_session_of_a_stream_is_told_in_small_frames_without_texts_twice():
    own = streamed.SessionAliases(10, None)
    frames = [pd.DataFrame({"order": [9 - k for k in range(5)] * 200, "keys": [str(k) for k in range(1000)], "text": [f"t{k}" if k % 3 else None for k in range(1000)], "aliased": ["[]"] * 1000, "error": [None] * 1000}) for _ in range(2)]
    out = list(own.handleInputRows(("s",), iter(frames), None))
    assert [len(f) for f in out[:-1]] == [detect.SOME] * 7 and sum(map(len, out)) == 2000
    every = pd.concat(out)
    plain = pd.concat(frames, ignore_index=True).sort_values("order", kind="stable")
    assert every["keys"].tolist() == plain["keys"].tolist() and every["masked"].tolist() == plain["text"].tolist()
    assert all("masked" not in json.loads(t) for t in every["told"])
