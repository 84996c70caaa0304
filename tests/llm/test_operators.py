import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from maskframe.llm import bpe, chat, decontaminate, exact_dedup, language, near_dedup, quality, substring_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string"


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows and clashing columns."""
    base, passage = words(120, 1), words(60, 2)
    near = [*base[:60], "changed", *base[61:]]
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", "", "one two", "one two", "A B C d e f", "a b c D E F", " ".join(words(30, 3) + passage), " ".join(passage + words(30, 4)), " ".join(words(6000, 5)), "tab\tand\nline " + " ".join(words(70, 6))]
    out = [(k, t, "en", "s", 0, 7, "x") for k, t in enumerate(texts)]
    # an id of two rows whose texts have a near copy each
    for text in (words(90, 21), words(90, 22)):
        out += [(50, " ".join(text), "en", "s", 0, 7, "x"), (60 + len(out), " ".join([*text[:40], "changed", *text[41:]]), "en", "s", 0, 7, "x")]
    return [*out, out[7], (None, "one two", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(spark, docs, nothing):
    got = exact_dedup.exact_dedup(spark, docs).collect()
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (max(x for x in own if x is not None), len(own))
    assert sum(r.kept for r in got) == len(groups) and len(got) == len(rows())
    weak = exact_dedup.exact_dedup(spark, docs, digest=lambda c: F.lit("same"), files_per_trigger=1).collect()
    assert sorted(map(str, weak)) == sorted(map(str, got))  # equal digests of different bytes
    assert exact_dedup.without_copies(spark, docs).columns == docs.columns
    assert exact_dedup.exact_dedup(spark, nothing).count() == 0


def brute_shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("few", [40, 1])
def test_near_dedup_against_brute_force(spark, docs, nothing, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "CHUNK", 2)
    middle = ["".join("ab"[(k.bit_count() + turn) % 2] for k in range(1024)) for turn in (0, 1)]  # sums of powers can't tell these apart
    alike = [(200 + turn, " ".join([*words(2, 41), middle[turn], *words(2, 42)]), "en", "s", 0, 7, "x") for turn in (0, 1)]
    docs = docs.unionByName(spark.createDataFrame(alike, DOCS))
    sets = {(r[0], r[1]): brute_shingles(r[1]) for r in rows() + alike}
    group = {k[0]: k[0] for k in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            if None not in (a[0], b[0]) and x and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((group[a[0]], group[b[0]]))
                group = {k: p if v == q else v for k, v in group.items()}
    for r in near_dedup.near_dedup(spark, docs, percent=85).collect():
        assert r.component_id == group[r.doc_id] and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    if few == 1:
        assert near_dedup.near_dedup(spark, nothing).count() == 0


@pytest.mark.parametrize("window, least", [(50, 25), (7, 25), (51, 25), (50, 5), (101, 25)])
def test_substring_dedup_against_brute_force(spark, docs, nothing, monkeypatch, window, least):
    monkeypatch.setattr(substring_dedup, "LEAST", least)
    assert substring_dedup.lengths_of(window) == {(50, 25): [25, 50], (7, 25): [3, 7], (51, 25): [25, 51], (50, 5): [6, 12, 24, 50], (101, 25): [25, 50, 101]}[window, least]
    first = {}
    # the middle words are Thue-Morse words and their complements, which sums of powers can't tell apart
    middle = ["".join("ab"[(k.bit_count() + turn) % 2] for k in range(1024)) for turn in (0, 1)]
    alike = [(200 + turn, " ".join([*words(30, 41), middle[turn], *words(30, 42)]), "en", "s", 0, 7, "x") for turn in (0, 1)]
    split = [(r[0], (r[1] or "").encode().split()) for r in rows() + alike]
    for k, w in sorted((r for r in split if r[0] is not None), key=lambda r: r[0]):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    want = []
    for k, w in split:
        gone = {j for i in range(len(w) - window + 1) if k is not None and first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        want.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    got = substring_dedup.substring_dedup(spark, docs.unionByName(spark.createDataFrame(alike, DOCS)), window=window).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got)
    if window == 50:
        assert substring_dedup.substring_dedup(spark, nothing, window=window).count() == 0


def test_bpe_against_the_library(spark, docs, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    odd = spark.createDataFrame([(100, " <|endoftext|>  x\n\n y's <|endoftext|>"), (101, "é😀    \x1c中文 123")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    want = []
    for r in every.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert t.decode(ids, skip_special_tokens=False) == (r.text or "")
        want.append((r.doc_id, len(ids), ids, r.text or ""))
    got = bpe.encode_decode(spark, every, bpe.default_tokenizer(), with_ids=True, block_chars=3000).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids, r.decoded)) for r in got)
    assert bpe.encode_decode(spark, nothing, bpe.default_tokenizer()).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("maskframe_")]


def test_a_worker_that_encodes_again_and_again_does_not_grow():
    """Twelve tasks in one worker, each with words of its own; a dropped tokenizer would leave about 11 MB a task behind."""
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        spec = type("Shared", (), {"value": f.read()})
    held = []
    for task in range(12):
        own = [f" w{k}x{(task * 12_000 + k) * 7919 % 1_000_003}".encode() for k in range(12_000)]
        places = bpe._pack(np.arange(len(own)), np.array([len(w) for w in own]))
        row = pa.RecordBatch.from_pylist([{"block": 0, "places": places, "words": zstandard.ZstdCompressor().compress(b"".join(own))}])
        assert sum(b.num_rows for b in bpe._encode(spec)(iter([row]))) == 1
        with open("/proc/self/statm") as f:
            held.append(int(f.read().split()[1]) * 4096 / 1e6)
    assert held[-1] - held[2] < 40, held


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a</s>b\\"), (1, 0, "user", "\\<s>[INST]x<sep>"), (1, 1, "assistant", None), (1, 2, "assistant", "é😀<<s>s><msg>\\\\n\\"), (1, None, None, "<"), (2, 0, "as<msg>s", "[[/INST]")]
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2):
        own = sorted((-1 if t is None else t, r or "", x or "") for k, t, r, x in turns if k == c)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest() and out[c].n_turns == len(own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_warc_and_lookup(spark):
    pages = spark.createDataFrame([(1, "http://A.b.com/x?y#z", "hi"), (2, "http://a.b.com/x?y", "hi"), (None, None, None), (3, "", "hé"), (4, "http://a.b.com/x\r\ny", "hi")], "page_id long, url string, html string")
    directory = warc.write_archives(spark, pages)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(directory).collect()}
    assert got == {1: (2, "response", None), 2: (2, "revisit", 1), 4: (2, "revisit", 1), 3: (3, "response", None), None: (0, "response", None)}
    hits = warc.lookup(spark, directory, pages.where("page_id = 2").select("url")).collect()
    assert {(r.page_id, r.record_type) for r in hits} == {(1, "response"), (2, "revisit")}
    assert warc.read_archives(warc.write_archives(spark, pages.limit(0))).count() == 0


def test_url_filter(spark):
    pages = [(1, "https://good.com/a", '<a href="//x.org/">'), (2, "http://x.org/", "<a href=http://y.org/1>"), (4, "http://link.org/q", '<a href="http://BAD.net/es/1">'), (5, "http://bad.net/es/", None), (6, "nohost", None), (7, None, None), (8, "http://farm.org", '<a href="http://link.org/">'), (9, "http://www.example.com/en/1", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark, df, spark.createDataFrame(url_filter.RULES, "verdict string, rule string")).collect()}
    assert out[1] == ("good.com", "/a", "com/", "allow") and out[5] == ("bad.net", "/es/", "net/es/", "block") and out[9][2:] == ("www.example.com/en/", "allow")
    assert out[4][2:] == (None, "block") and out[8][3] == "block" and out[2][3] == "allow" and out[6] == out[7] == ("", "", None, "allow")


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.good(docs, none).columns == docs.columns and {r.score for r in quality.scores(docs, none).collect()} == {0.5}


def test_language(spark, docs, nothing):
    d = "/root/testdata/sf0.001"
    got = language.op10_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("gold")), "doc_id").collect()
    assert sum(r.lang == r.gold for r in got) >= 0.97 * len(got)


def test_decontamination(spark, nothing):
    items = [words(n, 1000 + n) for n in (15, 30, 45, 55)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, None), (10, ""), (None, "x")], "item_id long, text string")
    texts = [(k, " ".join(words(200, 60 + k)) + " " + " ".join(w) + " " + " ".join(words(150, 70 + k))) for k, w in enumerate(items)]
    changed = [(10 + k, " ".join(words(90, 80 + k)) + " " + " ".join("zz" if i % 9 == 4 else x.upper() for i, x in enumerate(w)) + ".") for k, w in enumerate(items)]
    clean = [(100 + k, " ".join(words(300, 200 + k))) for k in range(60)] + [(200, None), (201, "")]
    df = spark.createDataFrame(texts + changed + clean, "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.search(spark, df, benchmark).collect()}
    assert {k for k, r in got.items() if r.contaminated} == {0, 1, 2, 3, 10, 11, 12, 13} and all(got[k].item_id == k % 10 for k in (0, 1, 2, 3, 10, 11, 12, 13))
    assert decontaminate.search(spark, nothing, benchmark).count() == 0 and not decontaminate.search(spark, df, benchmark.limit(0)).where("contaminated").count()


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]
