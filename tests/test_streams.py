"""Aliases and bindings as state of streams: any split into micro-batches gives what a batch gives."""

import random
from datetime import datetime, timedelta

import pytest

from maskframe.operators import mask, rules
from maskframe.plans.stream_queries import rocksdb
from maskframe.streaming import bindings
from maskframe.streaming import mask as streaming
from maskframe.streaming.shared import run_to_end

ALL = rules.built_in()


@pytest.fixture()
def with_rocksdb(spark):
    with rocksdb(spark):
        yield


def in_files(df, path, cuts, order):
    """Rows as one file for each range of ``order``."""
    for a, b in zip(cuts, cuts[1:]):
        df.where(f"{order} >= {a} and {order} < {b}").coalesce(1).write.mode("append").parquet(path)


def streamed(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain(rows):
    return sorted(str((r.k, r.session_id, r.masked, r.blocked_by, r.aliases, r.error)) for r in rows.collect())


def test_masking_a_stream_equals_a_batch(spark, tmp_path, with_rocksdb):
    rng = random.Random(1)
    rows = [(k, rng.choice(["s0", "s1", "gone", None]) if k % 9 == 0 else f"s{k % 2}", f"10.{rng.randrange(30)}.1.1 and u{rng.randrange(9)}@b.org 10.{rng.randrange(30)}.2.2") for k in range(60)]
    rows += [(60, "s0", None), (61, "s1", "card 4242 4242 4242 4242 x"), (62, "s1", "x" * 500)]
    df = spark.createDataFrame(rows, "k int, session_id string, t string")
    keys = mask.session_table(spark, {"s0": b"1" * 32, "s1": b"2" * 32})
    own = lambda d: streaming.mask_stream(d, keys, ["k"], "k", "t", ALL, max_chars=400)
    want = plain(own(df))
    assert len(want) == len(rows) and sum("NO_SESSION" in w for w in want) == sum(s not in ("s0", "s1") for _, s, _ in rows) and sum("TEXT_TOO_LONG" in w for w in want) == 1
    assert len({a.alias for r in own(df).where("session_id = 's0'").collect() for a in r.aliases}) == len({a.value for r in own(df).where("session_id = 's0'").collect() for a in r.aliases})
    for name, cuts in (("a", [0, 10, 35, 100]), ("b", [0, 1, 100])):
        path, out = f"{tmp_path}/{name}-in", f"{tmp_path}/{name}-out"
        in_files(df, path, cuts[:-1], "k")
        run_to_end(own(streamed(spark, df, path)), out, f"{tmp_path}/{name}-check")
        in_files(df, path, cuts[-2:], "k")  # a restart from the checkpoint keeps the aliases
        assert plain(run_to_end(own(streamed(spark, df, path)), out, f"{tmp_path}/{name}-check")) == want
    mails = [r for r in ALL if r.entity == "EMAIL"]
    assert plain(streaming.mask_stream(df, keys, ["k"], "k", "t", mails)) == plain(mask.mask(df, keys, ["k"], "t", mails))  # nothing clashes
    back = mask.restore(own(df).where("masked is not null").select("k", "session_id", "masked"), mask.mappings(own(df)), ["k"], "masked")
    assert all(r.restored == rows[r.k][2] for r in back.collect())


def test_a_session_of_too_many_values_refuses_new_ones_alone(spark, with_rocksdb):
    rows = [(1, "s", "a@b.org c@d.org"), (2, "s", "e@f.org"), (3, "s", "a@b.org"), (4, "t", "e@f.org")]
    df = spark.createDataFrame(rows, "k int, session_id string, t string")
    keys = mask.session_table(spark, {"s": b"1" * 32, "t": b"2" * 32})
    got = {r.k: r.error for r in streaming.mask_stream(df, keys, ["k"], "k", "t", ALL, most=2).collect()}
    assert got == {1: None, 2: "TOO_MANY_VALUES", 3: None, 4: None}


def test_the_state_store_must_be_rocksdb(spark):
    df = spark.createDataFrame([(1, "s", "x")], "k int, session_id string, t string")
    with pytest.raises(RuntimeError, match="RocksDB"):
        streaming.mask_stream(df, mask.session_table(spark, {"s": b"1"}), ["k"], "k", "t", ALL)


def test_bindings_end_when_idle_in_batches_and_streams(spark, tmp_path, with_rocksdb):
    rng = random.Random(2)
    start, rows = datetime(2024, 3, 1), []
    for k in range(120):
        rows.append((k, rng.choice(["a", "b", "c"]), start + timedelta(minutes=10 * k + rng.randrange(5)), f"s{k}" if rng.random() < 0.2 else None))
    df = spark.createDataFrame(rows, "k int, id string, at timestamp_ntz, session string")
    idle = 40 * 60 * 10**6
    want, state = set(), {}
    for k, i, at, session in rows:
        held = state.get(i)
        if held and (at - held[1]) // timedelta(microseconds=1) >= idle:
            held = None
        if session:
            state[i] = (session, at)
        else:
            want.add((k, held[0] if held else None))
            state[i] = (held[0], at) if held else None
    own = lambda d: bindings.uses(d, "id", "at", "k", "session")
    assert {(r.order, r.session_key) for r in bindings.resolved(own(df), idle).collect()} == want and {s is None for _, s in want} == {True, False}
    path = f"{tmp_path}/in"
    in_files(df, path, [0, 7, 50, 51], "k")
    run_to_end(bindings.resolved_stream(own(streamed(spark, df, path)), idle), f"{tmp_path}/out", f"{tmp_path}/check")
    in_files(df, path, [51, 200], "k")
    got = run_to_end(bindings.resolved_stream(own(streamed(spark, df, path)), idle), f"{tmp_path}/out", f"{tmp_path}/check")
    assert {(r.order, r.session_key) for r in got.collect()} == want
    odd = spark.createDataFrame([(1, None, start, None), (2, "a", None, None), (3, None, start, "s")], df.schema)
    assert sorted((r.order, r.session_key) for r in bindings.resolved(own(odd), idle).collect()) == [(1, None), (2, None)]
