"""Operators 11 to 13 against plain versions, and their defined cases."""

import hashlib
import random
import zlib
from datetime import datetime, timedelta
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.llm import overlap_join, suffix_dedup, vector_codes
from maskframe.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int, code string, vector string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(k, [floor(4096 * float(np.float32(x))) for x in v], lab) for k, v, lab in rows if v and None not in v and all(isfinite(x) for x in v) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    if not kept:
        return {}
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min(range(len(book[p])), key=lambda e: (dist(x, book[p][e]), e))
    for _ in range(rounds):
        told = [[near(c[p], p) for c in cut] for p in range(parts)]
        new = []
        for p in range(parts):
            groups = [[c[p] for c, e in zip(cut, told[p], strict=True) if e == k] for k in range(len(book[p]))]
            new.append([[sum(col) // len(g) for col in zip(*g, strict=True)] if g else book[p][k] for k, g in enumerate(groups)])
        book = new
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    codes = [[near(c[p], p) for p in range(parts)] for c in cut]
    errors = [sum(dist(c[p], book[p][e[p]]) for p in range(parts)) for c, e in zip(cut, codes, strict=True)]
    total = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + e
    fits = lambda x: x if x < 1 << 63 else None
    total = {lab: None if any(not fits(e) for (_, _, own), e in zip(kept, errors, strict=True) if own == lab and e) else fits(x) for lab, x in total.items()}
    errors = [fits(e) for e in errors]
    return sorted(((k, "".join(f"{x:02x}" for x in c), e, total[lab], sha) for (k, _, lab), c, e in zip(kept, codes, errors, strict=True)), key=str)


def vectors(seed, n, scale, d=16):
    rng = random.Random(seed)
    out = [(k, [rng.gauss(0, 1) * scale for _ in range(d)], rng.choice([None, 1, 1, 1, 2])) for k in range(n)]
    out += [(n + k, list(out[k][1]), 3) for k in range(20)]  # repeated vectors
    return out


@pytest.mark.parametrize("scale", [0.2, 1e-4, 3e6])
def test_vector_codes_against_a_plain_version(spark, scale):
    rows = vectors(1, 150, scale)
    rows += [(900, None, 1), (901, [0.0] * 15 + [None], 1), (902, [nan] * 16, 1), (903, [inf] + [0.0] * 15, 1), (904, [], 1), (905, [0.1] * 12, 2), (906, [0.1] * 24, 2), (None, [0.0] * 16, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(5)
    got = vector_codes.vector_codes(spark, df).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_codes(rows)


def test_vector_codes_of_few_and_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.vector_codes(spark, none).count() == 0
    rows = vectors(2, 30, 1.0)[:3]
    got = vector_codes.vector_codes(spark, spark.createDataFrame([(*r, None, None) for r in rows], VECTORS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_codes(rows)
    assert vector_codes.vector_codes(spark, spark.createDataFrame([(1, None, 1, "", "")], VECTORS)).count() == 0


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(3)
    for size in (3, 1000, 1 << 24, 1 << 31, 1 << 60):
        x, c = rng.integers(-size, size, (200, 8)), rng.integers(-size, size, (16, 8))
        x[:50] = c[rng.integers(0, 16, 50)]
        c[7] = c[3]  # a tie
        x[50:60] += 1
        want = [min(range(16), key=lambda e: (sum((int(a) - int(b)) ** 2 for a, b in zip(row, c[e], strict=True)), e)) for row in x]
        assert vector_codes.nearest(x, c).tolist() == want


def plain_sessions(clicks, gap=timedelta(minutes=30)):
    out = []
    for key in {c for c, *_ in clicks if c is not None}:
        rows = sorted((ts, kind) for c, ts, kind in clicks if c == key and ts is not None)
        own = []
        for ts, kind in rows:
            if not own or ts - own[-1][-1][0] > gap:
                own.append([])
            own[-1].append((ts, kind))
        out += [(key, s[0][0], s[-1][0], any(k == "error" for t, k in s if t == s[-1][0])) for s in own]
    return out


EPOCH = datetime(1970, 1, 1)


def plain_overlaps(clicks, sales, lines):
    us = lambda t: (t - EPOCH) // timedelta(microseconds=1)
    slot = lambda t: us(t) // (6 * 3600 * 10**6)
    sess = [(k, slot(a), inf if o else slot(b), zlib.crc32(str(us(a)).encode())) for k, a, b, o in plain_sessions(clicks)]
    out = []
    for sale, client, status, sold in sales:
        if client is None or sold is None:
            continue
        s = slot(sold)
        e = inf if status == "open" else slot(max([sold, *(t for i, t in lines if i == sale and sale is not None and t is not None)]))
        found = {}
        for k, a, b, crc in sess:
            if k == client and s <= b and a <= e:
                which = (e > b) - (e < b)
                name = {-1: {-1: "overlaps", 0: "finished_by", 1: "contains"}, 0: {-1: "starts", 0: "equals", 1: "started_by"}, 1: {-1: "during", 0: "finishes", 1: "overlapped_by"}}[(s > a) - (s < a)][which]
                n, shared, total = found.get(name, (0, 0, 0))
                both = e == b == inf
                found[name] = (n + 1, None if both else shared + min(e, b) - max(s, a) + 1, total + crc)
        out += [(sale, name, *x) for name, x in found.items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("parts, seed", [("1", 1), ("4", 2), ("13", 3)])
def test_overlap_join_against_a_plain_version(spark, parts, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    when = lambda days=8: rng.choice([None] + [start + timedelta(microseconds=rng.randrange(days * 86400 * 10**6))] * 30)
    client = lambda: rng.choice([None, 1, 1, 1, 2, 3, 4, 5])
    clicks = [(client(), when(), rng.choice([None, "view", "view", "error"])) for _ in range(400)]
    clicks += [(1, start + timedelta(minutes=20 * k), "view") for k in range(200)]  # a session over many buckets
    clicks += [(2, datetime(1969, 12, 31, 23, 50), "view"), (2, datetime(1970, 1, 1, 0, 20), "error"), (2, datetime(1970, 1, 1, 0, 20), "view"), (2, datetime(1970, 1, 1, 0, 50), "view")] + clicks[:20]
    sales = [(k if k % 40 else None, client(), rng.choice([None, "open", "done", "done"]), when()) for k in range(200)] + [(300, 2, "done", datetime(1969, 12, 31, 22))]
    lines = [(rng.choice([None, *range(200)]), when(20)) for _ in range(400)]
    as_clicks = spark.createDataFrame([(*c, 1) for c in clicks], "client_id long, ts timestamp_ntz, kind string, key int")
    as_sales = spark.createDataFrame([(*s, 1) for s in sales], "sale_id long, client_id long, status string, sold_at timestamp_ntz, end int")
    as_lines = spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in overlap_join.sales_in_sessions(spark, as_clicks, as_sales, as_lines).collect()), key=str)
        assert got == plain_overlaps(clicks, sales, lines)
        if seed == 2:  # with a zone, and in days whose clocks are turned
            zoned = [df.select(*(F.to_utc_timestamp(c, "UTC").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes)) for df in (as_clicks, as_sales, as_lines)]
            assert dict(zoned[0].dtypes)["ts"] == "timestamp"
            assert sorted((tuple(r) for r in overlap_join.sales_in_sessions(spark, *zoned).collect()), key=str) == got
            for empty in range(3):
                some = [df.limit(0) if k == empty else df for k, df in enumerate((as_clicks, as_sales, as_lines))]
                told = overlap_join.sales_in_sessions(spark, *some).collect()
                assert told == [] if empty < 2 else sorted((tuple(r) for r in told), key=str) == plain_overlaps(clicks, sales, [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_overlaps_of_any_intervals_with_a_hot_key(spark):
    rng = random.Random(7)
    interval = lambda: (a := rng.randrange(60), rng.choice([a, a + rng.randrange(40), overlap_join.OPEN]))
    left = [(rng.choice([1, 1, 1, 2]), *interval()) for _ in range(500)]
    right = [(rng.choice([1, 1, 1, 2]), *interval(), rng.randrange(9)) for _ in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        got = overlap_join.overlaps(spark.createDataFrame(left, "key long, start long, end long"), spark.createDataFrame(right, "key long, start long, end long, crc long"), Scratch(spark, "t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for k, s, e in set(left):
        for j, a, b, crc in right:
            if j == k and s <= b and a <= e:
                r = 3 * (1 + (s > a) - (s < a)) + 1 + (e > b) - (e < b)
                n, t = want.get((k, s, e, r), (0, 0))
                want[k, s, e, r] = (n + 1, t + crc)
    assert {(r.key, r.start, r.end, r.relation): (r.n, r.crc) for r in got} == want


def plain_bytes(rows, window):
    """Rows that share an id stand one behind the other in the order of their digests; equal ones are one."""
    place = {}
    for k in {k for k, _ in rows if k is not None}:
        for i, t in enumerate(sorted({t or "" for j, t in rows if j == k}, key=lambda t: hashlib.sha256(t.encode()).hexdigest())):
            place[k, t] = i
    first = {}
    for k, t in sorted(place, key=lambda x: (x[0], place[x])):
        b = t.encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], (k, place[k, t], i))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1) if k is not None else ():
            if first[b[i : i + window]] < (k, place[k, t or ""], i):
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcde fé中") for _ in range(n))
    base, passage = some(900), some(130)
    out = [(1, base), (2, base), (3, base[:400] + "X" + base[401:]), (4, some(50) + passage + some(60)), (5, some(80) + passage), (6, passage[:98]), (7, None), (8, ""), (9, "a" * 700), (10, "ab" * 200 + "c" + "ab" * 200)]
    out += [(20, some(300) + base[100:250]), (20, some(300)), (20, some(200) + base[:150]), (11, base[50:700] + base[50:700]), (1, base), (None, base), (12, passage + base[300:420] + passage)]
    out += [(30 + k, base[: 100 + 7 * k] + some(5) + base[100 + 7 * k :]) for k in range(30)]
    thue = ["".join("ab"[(k.bit_count() + turn) % 2] for k in range(1024)) for turn in (0, 1)]
    return out + [(80, thue[0]), (81, thue[1])]


@pytest.mark.parametrize("window, piece", [(100, 1 << 20), (100, 130), (16, 1 << 20), (37, 64), (256, 1 << 20)])
def test_suffix_dedup_against_a_plain_version(spark, monkeypatch, window, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, id int, at string, digit string").repartition(3)
    got = suffix_dedup.suffix_dedup(spark, df, window=window)
    assert sorted((tuple(r) for r in got.drop("kept_bytes").collect()), key=str) == plain_bytes(rows, window)
    if window == 16:
        assert suffix_dedup.suffix_dedup(spark, df.limit(0), window=window).count() == 0
        assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in got.where("kept_bytes is not null").collect())
        with pytest.raises(ValueError):
            suffix_dedup.suffix_dedup(spark, df, window=15)


def test_runs_of_equal_bytes_are_equal_wherever_they_stand():
    rng = random.Random(5)
    common = bytes(rng.randrange(97, 101) for _ in range(400))
    for a, b in ((b"", b"xyz" * 50), (b"q" * 31, b"")):
        data = a + common + b
        first, last, place, gram = suffix_dedup.runs(data, [len(data)], 100)
        inner = [(f - len(a), p - len(a), g) for f, la, p, g in zip(first, last, place, gram, strict=True) if f > len(a) + 100 and la < len(a) + 200]
        assert inner and (a == b"" or inner == kept)
        kept = inner
        assert (last - first).max() < 256 and sum(last - first + 1) == len(data) - 99
