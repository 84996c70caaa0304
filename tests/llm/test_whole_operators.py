import random

import pytest

import plain_contamination

from maskframe.llm import decontaminate, url_filter


def words(n, rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_decontamination_equals_the_checks_over_all_windows(spark):
    rng = random.Random(3)
    common = words(40, rng)
    mixed = lambda n: [rng.choice(common) if i % 3 else words(1, rng)[0] for i in range(n)]
    items = [mixed(n) for n in (5, 8, 15, 16, 18, 21, 22, 30, 40, 41, 60, 64, 100)]
    rows = []
    for w in items * 30:
        changed = [words(1, rng)[0] if i % 6 == 0 else x for i, x in enumerate(w)]  # half of the rare words
        rows.append((len(rows), " ".join(mixed(rng.randint(0, 90)) + changed + mixed(rng.randint(0, 90)))))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " ".join(items[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.selectExpr("doc_id as id", "text")
    idf, _ = decontaminate.inverse_frequencies(texts)
    found = [p for k, w in enumerate(items) for p in decontaminate.passages(k, decontaminate.words_of([" ".join(w)])[0], idf)]
    plain = [(p.item, p.words, set(p.rare)) for p in found]
    expected = {k: plain_contamination.matches(decontaminate.words_of([text])[0].tolist(), plain) for k, text in rows}
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for cosine in (0.45, 9.0):  # the second is never met, so that the rare words decide alone
        got = {r.doc_id: r for r in decontaminate.search(spark, docs, benchmark, cosine=cosine).collect()}
        assert {k for k, r in got.items() if r.contaminated} == {k for k, x in expected.items() if x}
        assert all(r.item_id in expected[k] for k, r in got.items() if r.contaminated)
        assert all(expected[k][r.item_id] == max(expected[k].values()) for k, r in got.items() if r.found_by == "rare_words")
    assert sum(map(bool, expected.values())) > 100


def test_clean_drops_contaminated_rows_alone_whatever_their_ids(spark):
    rng = random.Random(4)
    item = words(30, rng)
    held = [" ".join(words(50, rng) + item + words(20, rng)) for _ in range(3)]
    plain = [" ".join(words(90, rng)) for _ in range(20)]
    rows = [(None, held[0]), (1, held[1]), (1, plain[0]), (2, held[2]), (None, plain[1]), (3, None), *enumerate(plain[2:], 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.clean(spark, docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[1] not in held)


def test_distrust_of_a_long_chain_converges(spark):
    n = 23
    host = lambda k: f"h{k}.org" if k else "bad.net"
    pages = [(0, "http://bad.net/es/", None), *((k, f"http://{host(k)}/", f'<a href="http://{host(k - 1)}/es/">') for k in range(1, n))]
    df, rules = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
    got = {r.page_id: r for r in url_filter.judge(spark, df, rules).collect()}
    assert all(got[k].distrust == pytest.approx(0.85**k) and got[k].verdict == ("block" if 0.85**k >= 0.05 else "allow") for k in range(n))
    with pytest.raises(RuntimeError):
        url_filter.judge(spark, df, rules, rounds=3)
