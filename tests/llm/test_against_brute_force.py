"""Queries without SQL against plain versions of them, on small tables."""

import inspect
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_contamination

from maskframe.llm import common, decontaminate, language, quality, url_filter

SF = "/root/testdata/sf0.001"


def words(n, rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_compiled_rules_equal_the_fitted_ones(spark):
    """The columns that score whole texts against the rules as numbers, on every document and on odd texts."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    assert model.rules
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "!!!"), (-4, "a\n\nb " * 30_000), (-5, "ÀÉ 12 | x")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    scored = model.score(rows, F.col("text")).collect()
    assert len(scored) == rows.count()
    for r in scored:
        total = model.intercept + sum(x.weight for x in model.rules if all(r[n] <= bound if low else r[n] > bound for n, low, bound in x.tests))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))
    for r in scored:
        t = r.text or ""
        split = [w for w in re.split(r"[ \t\n\x0B\f\r]+", t) if w]
        assert r.digit == pytest.approx(sum(c in "0123456789" for c in t) / max(1, len(t)))
        assert r.word_variety == pytest.approx(len(set(split)) / max(1, len(split)))


def test_quality_of_ties_repeated_rows_and_nothing(spark):
    rows = [(k % 7, "same text" if k % 2 else f"text {k} !!!") for k in range(40)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k % 7, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r, (_, t) in zip(got, rows, strict=True) if t == "same text"}) == 1
    assert quality.scores(docs.limit(0), labels).count() == quality.good(docs.limit(0), labels).count() == 0


def test_propagation_equals_power_iteration(spark):
    rng = random.Random(5)
    hosts = [f"h{k}.org" for k in range(30)] + ["good.com", "bad.net"]
    pages, n = [], 0
    for h in hosts:
        for _ in range(rng.randint(1, 4)):
            to = rng.choices(hosts, weights=[9 if x == "h0.org" else 1 for x in hosts], k=rng.randint(0, 6))
            path = "/es/x" if h == "bad.net" else "/"
            pages.append((n, f"http://{h}{path}", "".join(f'<a href="http://{t}/">' for t in to)))
            n += 1
    pages.append(pages[-1])
    df, rules = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
    links = defaultdict(Counter)
    for _, url, html in pages:
        own = url.split("/")[2]
        for t in [x.split("/")[0] for x in html.split('href="http://')[1:]]:
            if t != own:
                links[own][t] += 1
    every = sorted({u.split("/")[2] for _, u, _ in pages} | {t for c in links.values() for t in c})
    at = {h: k for k, h in enumerate(every)}
    m = np.zeros((len(every), len(every)))
    for a, c in links.items():
        for b, k in c.items():
            m[at[a], at[b]] = k
    forth = m / np.maximum(m.sum(1, keepdims=True), 1)
    back = m / np.maximum(m.sum(0, keepdims=True), 1)
    trusted, blocked = (np.array([float(h == x) for h in every]) for x in ("good.com", "bad.net"))
    t, d = 0.15 * trusted, 0.15 * blocked
    for _ in range(500):
        t, d = 0.15 * trusted + 0.85 * forth.T @ t, 0.15 * blocked + 0.85 * back @ d
    got = url_filter.judge(spark, df, rules, tolerance=1e-9).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.trust == pytest.approx(t[at[r.host]] / 0.15, abs=1e-6) and r.distrust == pytest.approx(d[at[r.host]] / 0.15, abs=1e-6)
        suspect = r.distrust >= 0.05 and r.distrust > r.trust
        assert r.verdict == {"good.com": "allow", "bad.net": "block"}.get(r.host, "block" if suspect else "allow")
    assert any(r.verdict == "block" and r.rule is None for r in got)
    assert url_filter.judge(spark, df.limit(0), rules).count() == 0


def test_url_rules_over_whole_pages_equal_a_plain_loop(spark):
    got = {r.page_id: r for r in url_filter.op3_url_filter(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect():
        after = r.url.partition("://")[2] if r.url and "://" in r.url else ""
        cut = min([after.find(c) for c in "/?#" if c in after] or [len(after)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in after[:cut])
        path = after[cut : min([k for k in (after.find("?", cut), after.find("#", cut)) if k >= 0] or [len(after)])]
        fit = [(len(x), x, v) for v, x in url_filter.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, max(fit)[1] if fit else None)
        assert not fit or got[r.page_id].verdict == max(fit)[2]


def test_join_of_each_key_keeps_all_rows(spark):
    rows = [(k, "hot" if k % 3 else f"k{k}") for k in range(3000)] + [(-1, None), (-2, None)]
    df = spark.createDataFrame(rows, "n long, key string")
    each = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "key string, v int")
    got = common.join_each(df, each, "key").collect()
    assert sorted((r.n, r.key, r.v) for r in got if r.key) == sorted((n, k, {"hot": 1, "k3": 2}.get(k)) for n, k in rows if k)
    assert sum(r.key is None and r.v is None for r in got) == 2 and len(got) == len(rows)


def test_language_fusion_equals_a_plain_version(spark):
    """Priors and fusion worked out row by row from the likelihoods of the texts; nulls, ties, repeated rows, no host."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    langs, weights = model
    few = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(40).collect()]
    rng = random.Random(2)
    rows = [(k, few[k % 40][: rng.choice([0, 5, 30, 400])], rng.choice(["a.de", "b.de", "c.fr", None]), None, rng.choice(["de", "en", None])) for k in range(120)]
    rows = [(k, t, h, h and h.split(".")[1], c) for k, t, h, _, c in rows] + [(1, None, None, None, None), (1, None, None, None, None), (2, "", "a.de", None, "xx"), (3, "", None, "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, declared string")
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll = []
    for r in rows:
        grams, _ = language.trigrams([(r[1] or "").encode()])
        ll.append(weights[grams].sum(0, dtype=float) / max(1, len(grams)) * min(len(grams), language.TRIGRAMS) if len(grams) else np.zeros(len(langs)))
    p = [softmax(x) for x in ll]
    total = lambda keep: (sum((p[k] for k, r in enumerate(rows) if keep(r)), np.zeros(len(langs))), sum(map(keep, rows)))
    all_p, all_n = total(lambda r: True)
    prior = (all_p + 1) / (all_n + len(langs))
    codes = {r[4] for r in rows if r[4]}
    told_all, _ = total(lambda r: r[4] is not None)
    got = language.identify(spark, df, model, ["doc_id"]).collect()
    expected = Counter()
    for k, r in enumerate(rows):
        def shrunk(keep, to, own=p[k]):
            s, n = total(keep)
            return (np.maximum(s - own, 0) + language.STRENGTH * to) / (n - 1 + language.STRENGTH)

        base = prior
        if r[3] is not None and total(lambda x: x[2] is not None and x[3] == r[3])[1]:
            base = shrunk(lambda x: x[2] is not None and x[3] == r[3], prior)
        host = shrunk(lambda x: x[2:4] == r[2:4], base) if r[2] else base
        told = np.log((total(lambda x: x[4] == r[4])[0] + 0.1) / (told_all + 0.1 * (len(codes) + 1))) if r[4] else 0
        post = softmax(ll[k] + np.log(host) + told)
        expected[r[0], langs[int(post.argmax())], round(float(post.max()), 6)] += 1
    assert Counter((r.doc_id, r.lang, round(r.probability, 6)) for r in got) == expected
    assert language.identify(spark, df.limit(0), model, ["doc_id"]).count() == 0
    assert language.identify(spark, df, ([], weights), ["doc_id"]).where("lang is null").count() == len(rows)


@pytest.mark.parametrize("block_items", [1, 3, 10_000])
def test_blocks_of_the_benchmark_change_nothing(spark, block_items):
    rng = random.Random(9)
    items = [words(n, rng) for n in (12, 20, 30, 70)]
    texts = [" ".join(words(60, rng) + w + words(30, rng)) for w in items]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, None), (1, " ".join(words(80, rng))), (2, texts[0] + " " + texts[3])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_id string, row int")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontaminate.search(spark, docs, benchmark, block_items=block_items).collect()
    assert sorted((r.doc_id or 0, -1 if r.item_id is None else r.item_id) for r in got) == sorted([(1, 0), (1, 1), (0, 2), (0, 3), (0, -1), (1, -1), (2, 0)])
    kept = decontaminate.clean(spark, docs, benchmark, block_items=block_items)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for t in (rows[4][1], rows[5][1]))


def test_decontamination_of_every_document_equals_a_plain_version(spark):
    docs, benchmark = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark"))
    rows = docs.select("doc_id", "text").collect()
    found = plain_contamination.passages_of([tuple(r) for r in benchmark.select("item_id", "text").collect()], [r.text for r in rows])
    got = {r.doc_id: r for r in decontaminate.op4_decontaminate(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        best = plain_contamination.matches(plain_contamination.words_of(r.text), found)
        own = got[r.doc_id]
        assert own.contaminated == bool(best) and (own.item_id in best if best else own.item_id is own.found_by is None)


def test_the_sample_of_the_fit_works_at_every_size(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as id", "text")
    idf, n = decontaminate.inverse_frequencies(docs)
    assert [decontaminate.least_hash(10_000, k) for k in (10_000, 20_000)] == [1 << 63, 0] and decontaminate.least_hash(10_000, 50_000_000_000) > -(1 << 63) + 10**12
    with pytest.raises(RuntimeError, match="empty"):
        decontaminate.latent_directions(spark, docs, idf, 10, 50_000_000_000)
    # a count as large as that, of which these rows are told to be a part: the fit sees some of them
    assert decontaminate.latent_directions(spark, docs, idf, 10_000_000_000, 50_000_000_000).std() > 0


def test_the_index_is_fitted_on_every_document(spark):
    assert inspect.signature(decontaminate._matches).parameters["fit_docs"].default is None
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + i * i) % 900} w{i % 5}" for i in range(20 + k % 60))) for k in range(300)] + [(300, None)], "id long, text string").repartition(5)
    idf, n = decontaminate.inverse_frequencies(docs)
    test = np.random.default_rng(11).standard_normal((decontaminate.COARSE, 80)).astype(np.float32)
    z = np.zeros(test.shape)
    for r in docs.collect():
        h = decontaminate.words_of([r.text])[0]
        for k in range(0, len(h), 32):
            row, weight = decontaminate._features(h[k : k + 32], idf)
            v = np.bincount(row, weight, decontaminate.COARSE)
            z += np.outer(v, v @ test) / (v @ v)
    values, vectors = np.linalg.eigh((test.T @ z + (test.T @ z).T) / 2)
    keep = values > 1e-9 * values.max()
    left, sizes, _ = np.linalg.svd(z @ vectors[:, keep] / np.sqrt(values[keep]), full_matrices=False)
    own, plain = (m[:, :20] @ m[:, :20].T for m in (decontaminate.latent_directions(spark, docs, idf, None, n), left / sizes))
    assert np.abs(own - plain).max() < 1e-3 * np.abs(plain).max()


def test_swapped_halves_and_changed_words_are_found(spark):
    rng = random.Random(12)
    items = [words(n, rng) for n in (20, 30, 45, 60)]
    texts = []
    for k, w in enumerate(items):
        h = len(w) // 2
        for own in (w[h:] + w[:h], [words(1, rng)[0] if i % 6 == 5 else x for i, x in enumerate(w)]):
            texts.append((k, " ".join(words(70, rng) + own + words(50, rng))))
    texts += [(-1, " ".join(words(150, rng))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.search(spark, docs, benchmark).collect()}
    assert all((got[i].item_id, got[i].contaminated) == ((k, True) if k >= 0 else (None, False)) for i, (k, _) in enumerate(texts))
    # without the cosine search the same documents are told, by the rare words
    other = {r.doc_id: r for r in decontaminate.search(spark, docs, benchmark, cosine=9.0).collect()}
    assert {r.found_by for r in other.values()} == {None, "rare_words"} and all(other[i].contaminated == got[i].contaminated for i in got)


def test_scratch_needs_a_shared_folder_on_clusters(spark):
    class Other:
        conf = {}

        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError):
        common.shared_folder(Other)


def test_nothing_outside_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    outside = [p for p in (root / "maskframe").rglob("*.py") if "llm" not in p.parts]
    assert outside and not any(re.search(r"\bllm\b", p.read_text()) for p in outside)
