"""Islands, guarded spans and resolution over tables, against a look at every pair and the resolver of one text."""

import random

import pytest

from maskframe.operators import span_tables
from maskframe.operators.scan import ALIAS_TYPE, Hit, resolved

SPAN = "doc string, start int, end int, more string"


def some_spans(rng, n, far):
    rows = [(rng.choice(["a", "b", None]), k := rng.randrange(far), k + rng.choice((0, 1, 2, 3, 9, far // 6)), "x") for _ in range(n)]
    return rows + rows[:5] + [("lone", 3, 4, None), ("far", 2_000_000_000, 2_000_000_009, "x"), ("far", 0, 2_000_000_001, "x")]


def plain_islands(rows):
    out = []
    for doc in {r[0] for r in rows}:
        begun = reach = None
        for start, end in sorted((r[1], r[2]) for r in rows if r[0] == doc):
            if begun is None or (start >= reach and start != last):
                begun = start
            reach, last = max(end, -1 if reach is None else reach), start
            out.append((doc, start, end, begun))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_islands_and_guard_against_every_pair(spark, monkeypatch, width):
    monkeypatch.setattr(span_tables, "WIDTH", width)
    rng = random.Random(width)
    rows, covers = some_spans(rng, 90, 300), some_spans(rng, 25, 300)
    broken = [("a", None, 3, "x"), ("a", 3, None, "x")]
    df, over = spark.createDataFrame(rows + broken, SPAN), spark.createDataFrame(covers + broken, SPAN)
    got = span_tables.islands(df, ["doc"])
    assert got.columns == ["doc", "start", "end", "more", "island"]
    assert sorted(((r.doc, r.start, r.end, r.island) for r in got.collect()), key=str) == plain_islands(rows)
    held = lambda d, s, e: any(c[0] == d and c[1] <= s and c[2] >= e and (c[1], c[2]) != (s, e) for c in covers)
    told = sorted(((r.doc, r.start, r.end, r.inside) for r in span_tables.inside(df, over, ["doc"]).collect()), key=str)
    assert told == sorted(((d, s, e, held(d, s, e)) for d, s, e, _ in rows), key=str) and {t[3] for t in told} == {True, False}
    assert {r.inside for r in span_tables.inside(df, over.limit(0), ["doc"]).collect()} == {False}
    assert span_tables.islands(df.limit(0), ["doc"]).count() == 0


@pytest.mark.parametrize("width", [5, 4096])
def test_resolution_equals_that_of_one_text(spark, monkeypatch, width):
    monkeypatch.setattr(span_tables, "WIDTH", width)
    rng, rows = random.Random(width), []
    for doc, start, end, _ in some_spans(rng, 160, 400):
        kind = rng.choice(("EMAIL", "CREDIT_CARD", "PASSWORD", "PHONE", ALIAS_TYPE if rng.random() < 0.3 else "URL"))
        rows.append((doc, Hit(start, end, f"v{rng.randrange(9)}", "n", kind, "d", rng.choice((0.5, 0.9)), rng.choice((10, 20)), "numeric", rng.choice(("literal", "redacted", "unheard")), len(rows))))
    df = spark.createDataFrame([(doc, *h) for doc, h in rows], "doc string, start int, end int, value string, normalized string, entity_type string, detector string, score double, priority int, profile string, policy string, ord int")
    want = sorted(((doc, *h) for doc in {d for d, _ in rows} for h in resolved([h for d, h in rows if d == doc])), key=str)
    assert sorted((tuple(r) for r in span_tables.resolve_table(df, ["doc"]).collect()), key=str) == want and len(want) > 20
    assert span_tables.resolve_table(df.limit(0), ["doc"]).count() == 0
    many = df.unionByName(df).unionByName(df.where(f"start < `end` and entity_type <> '{ALIAS_TYPE}'"))  # repeated rows win once
    assert sorted((tuple(r) for r in span_tables.resolve_table(many.where("start < `end`"), ["doc"]).collect()), key=str) == sorted((tuple(r) for r in span_tables.resolve_table(df.where("start < `end`"), ["doc"]).collect()), key=str)


def test_one_document_of_a_million_spans(spark):
    df = spark.range(1_000_000).selectExpr("1 as doc", "cast(id * 3 as int) as start", "cast(id * 3 + if(id % 10 = 9, 3, 4) as int) as end")
    got = span_tables.islands(df, ["doc"]).groupBy("island").count().groupBy("count").count().collect()
    assert [tuple(r) for r in got] == [(10, 100_000)]


HITS = "doc string, start int, end int, value string, normalized string, entity_type string, detector string, score double, priority int, profile string, policy string, ord int"


def some_hits(rng, docs, far, lengths, kinds):
    return [
        (f"d{d}", Hit(k := rng.randrange(far), k + rng.choice(lengths), "v", "n", rng.choice(kinds), "d", rng.choice((0.5, 0.9)), rng.choice((10, 20)), "numeric", rng.choice(("literal", "redacted", "unheard")), n))
        for d in range(docs) for n in range(rng.choice((1, 2, 5, 12, 40)))
    ]


@pytest.mark.parametrize("lengths, kinds", [((1, 4, 9), ("EMAIL", "CREDIT_CARD", "PASSWORD")), ((0, 1, 4, 9, 150), ("EMAIL", "CREDIT_CARD", ALIAS_TYPE))])
def test_bins_of_few_hits_are_settled_as_one_text(spark, monkeypatch, lengths, kinds):
    monkeypatch.setattr(span_tables, "WIDTH", 64)
    rows = some_hits(random.Random(len(lengths)), 80, 600, lengths, kinds)
    got = span_tables.resolve_table(spark.createDataFrame([(d, *h) for d, h in rows], HITS), ["doc"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, *h) for d in {d for d, _ in rows} for h in resolved([h for x, h in rows if x == d])), key=str)


def test_spans_that_leave_no_bin_are_shuffled_once(spark):
    rows = [(d, *h) for d, h in some_hits(random.Random(3), 20, 4000, (1, 4, 9), ("EMAIL", "PASSWORD")) if h.end <= span_tables.WIDTH]
    plan = span_tables.resolve_table(spark.createDataFrame(rows, HITS), ["doc"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
