"""Sessions of any number of values: none is refused, and no task holds one."""

import random

import pytest
from pyspark.sql import functions as F

from maskframe.operators import by_session, mask, rules
from maskframe.plans import queries
from maskframe.plans.stream_queries import rocksdb
from maskframe.streaming import mask as streaming

MAILS = [r for r in rules.built_in() if r.entity == "EMAIL"]
MANY = 12_000


def test_a_round_trip_of_many_values_in_a_session_brings_every_text_back(spark, tmp_path):
    mails = lambda k: " ".join(f"u{k}.{n}@a.example.com" for n in range(100))
    rows = [(7 * k, f"x {mails(k)} y") for k in range(MANY // 100)]
    rows += [(1, "plain"), (14, None), (21, ""), (None, "from e@f.org"), (-3, "to g@h.org"), (2, "a@b.org " + "`a`\n" * 2100), (7, mails(0))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.mask_round_trip(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_rounds_settle_as_taking_turns_does(spark, seed):
    rng = random.Random(seed)
    values, known = [], []
    for session, n in (("a", 900), ("b", 40), ("c", 300)):
        for _ in range(n):
            profile, entity = rng.choice([("ipv4", "IP_ADDRESS"), ("ipv4", "IP_ADDRESS"), ("numeric", "PHONE"), ("email", "EMAIL"), ("hostname", "HOSTNAME")])
            print_ = "%064x" % (rng.randrange(5 if profile == "email" else 4000) << 208 | rng.getrandbits(rng.choice([8, 208])))
            value = str(rng.randrange(10**7, 10**8))
            alias = mask.alias_of(profile, entity, print_[:12], value)
            hit = {"start": 0, "end": 1, "value": value, "entity_type": entity, "profile": profile, "policy": "literal", "fingerprint": print_, "alias": alias, "taken": rng.random() < 0.05}
            values.append((session, [hit]))
            if rng.random() < 0.1:
                known.append((session, print_ if rng.random() < 0.7 else "%064x" % rng.getrandbits(256), alias if rng.random() < 0.5 else mask.alias_of(profile, entity, print_[20:32], value)))
    found = spark.createDataFrame(values, f"session_id string, aliased {mask.ALIASED}")
    issued = spark.createDataFrame(list({(s, a): (s, f, a) for s, f, a in {(s, f): (s, f, a) for s, f, a in known}.values()}.values()), "session_id string, fingerprint string, alias string")
    told = [sorted(map(tuple, mask.allocated(found, issued if seed else None, together=n)[0].collect()), key=str) for n in (100, 10**6)]
    assert told[0] == told[1] and len(told[0]) > 400 and any(alias is None for _, _, alias in told[0])


def test_aliases_of_large_sessions_go_to_the_parts_that_hold_them(spark):
    alias = F.format_string("mf-user-%012x@example.invalid", "id")
    known = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 2).alias("session_id"), alias.alias("alias"), F.concat(F.lit("u"), "id").alias("value"), F.lit("literal").alias("policy"))
    known = known.unionByName(known.where("session_id = 's0'").limit(5).withColumn("session_id", F.lit("few")))
    text = F.concat(F.lit("mail "), alias, F.lit(" now"))
    df = spark.range(2000).select((F.col("id") % 50).alias("k"), F.concat(F.lit("s"), F.col("id") % 3).alias("session_id"), text.alias("t"))
    df = df.unionByName(spark.createDataFrame([(1, None, "x"), (2, "s0", None), (3, "few", "mf-user-000000000002@example.invalid"), (3, "s1", "")], "k long, session_id string, t string"))
    plain = lambda rows: sorted(map(str, rows.collect()))
    want = plain(mask.restore(df, known, ["k"], "t"))
    assert sum("mail u" in w for w in want) == 668 and plain(mask.restore(df, known, ["k"], "t", together=100)) == want
    pairs = known.select("session_id", F.col("alias").alias("first"), F.col("value").alias("second"))
    seen = spark.sparkContext.accumulator(0)

    def prepare(held):
        seen.add(len(held))
        return held

    wide = spark.createDataFrame([("s0",), ("s1",)], "session_id string")
    by_session.with_session_pairs(df, pairs, "t", prepare, lambda own, t, row: t, "o", "string", wide).collect()
    assert seen.value <= 680  # about as many as texts hold, where all pairs of both sessions in each part would be 3,000 a part


def test_a_stream_refuses_no_session_for_its_values(spark):
    text = " ".join(f"u{n}@a.example.com" for n in range(10_050))
    df = spark.createDataFrame([(1, "s", text)], "k int, session_id string, t string")
    keys = mask.session_table(spark, {"s": b"1" * 32})
    with rocksdb(spark):
        row = streaming.mask_stream(df, keys, ["k"], "k", "t", MAILS).first()
    assert row.error is None and len({a.alias for a in row.aliases}) == 10_050 and "@a.example.com" not in row.masked
