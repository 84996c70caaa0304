"""Terms of a table in texts, against a look at every pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from maskframe.operators import term_join

DOC, TERM = "k int, t string, term string", "term string, t string"


def of(spark, docs, terms, **options):
    d, t = spark.createDataFrame([(*d, "other") for d in docs], DOC), spark.createDataFrame([(t, "x") for t in terms], TERM)
    return sorted(((r.k, r.term) for r in term_join.term_matches(d, "k", "t", t, **options).collect()), key=str)


def plain(docs, terms):
    return sorted({(k, t) for k, text in docs if text is not None for t in terms if t and t in text}, key=str)


def test_terms_of_all_lengths_against_every_pair(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé漢😀") for _ in range(rng.randrange(1, 7)))
    docs = [(k % 70, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(80)] + [(None, "ab ba é"), (None, None), (3, ""), (4, None), (5, "a" * 3000 + "needle in a very long text")]
    terms = [word() for _ in range(200)] + [docs[k][1][3 : 3 + n] for k in range(40) for n in (2, 9, 30)] + [None, "", "a" * 40, "a" * 3001, "needle in a very long text", "absent altogether", "\x00"]
    want = plain(docs, terms)
    assert of(spark, docs, terms) == want and (5, "needle in a very long text") in want and any(k is None for k, _ in want)
    monkeypatch.setattr(term_join, "SLICE", 64)  # in many slices, and a filter that lets much through
    monkeypatch.setattr(term_join, "MAX_BITS", 1 << 10)
    assert of(spark, docs, terms) == want


def test_folded_and_empty(spark):
    docs = [(1, "The Quick FOX"), (2, "quick")]
    assert of(spark, docs, ["QUICK", "quick fox", "Fo"], fold=F.lower) == sorted([(1, "fo"), (1, "quick"), (1, "quick fox"), (2, "quick")], key=str)
    assert of(spark, docs, ["QUICK"]) == [] and of(spark, docs, []) == [] and of(spark, docs, [None, ""]) == []
    assert of(spark, [], ["a"]) == []


def test_grams_of_different_lengths_are_never_equal():
    data = bytes(range(1, 128)) + "é漢😀".encode() * 9
    seen = [set(term_join.grams(data, k).tolist()) for k in range(1, 9)]
    assert sum(map(len, seen)) == len(set().union(*seen)) and all(len(s) == len({data[i : i + k] for i in range(len(data) - k + 1)}) for k, s in enumerate(seen, 1))
    assert not len(term_join.grams(b"abc", 4)) and term_join.grams(b"abc", 3).dtype == np.uint64


def test_few_terms_are_looked_for_where_the_texts_are(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(rng.choice((None, *range(30))), " ".join(rng.choice(("anna", "ben", "é漢😀", "needle-work", "x")) for _ in range(rng.randrange(40)))) for _ in range(60)]
    terms = ["anna ben", "needle-work x", "é", "漢😀 ben", "x x x", "absent altogether", "n"]
    d, t = spark.createDataFrame([(*d, "other") for d in docs], DOC), spark.createDataFrame([(t, "x") for t in terms], TERM)
    plan = term_join.term_matches(d, "k", "t", t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of matches alone: no text is shuffled
    want = plain(docs, terms)
    assert of(spark, docs, terms) == want and len(want) > 50
    monkeypatch.setattr(term_join, "MAX_SENT", 0)
    monkeypatch.setattr(term_join, "COUNTED", 10)
    assert of(spark, docs, terms) == want
