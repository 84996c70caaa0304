"""Rows that are refused alone, models in windows, secrets, and the segmenter's states."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskframe.operators import detect, mask, refused, rules, scan, segments, walk
from maskframe.plans import queries

ALL = rules.built_in()
FENCES = "```\n" * 4000
CODES = [rules.user_rule("t", r"T-[0-9]+", "TICKET")]


def test_one_bad_document_of_each_kind_leaves_all_others(spark):
    shapes = "`a`\n" * 2100
    rows = [(1, "s", "a@b.org"), (2, "s", shapes), (3, "s", "T-1 " + "x" * 200), (4, "s", "Ann boom"), (5, "u", "a@b.org"), (6, None, "c@d.org"), (7, "s", None), (8, "s", ""), (9, "s", "Ann a@b.org"), (10, "s", "card 4242 4242 4242 4242 x")]
    df = spark.createDataFrame(rows, "k int, session_id string, t string")
    keys = mask.session_table(spark, {"s": b"1" * 32})
    def find(text):
        if "boom" in text:
            raise RuntimeError("model")
        return []

    own = [*ALL, scan.Model("m", find)]
    got = mask.mask(df, keys, ["k"], "t", own, max_chars=20_000).cache()
    error = {r.k: r.error for r in got.collect()}
    assert error == {1: None, 2: "TOO_MANY_SHAPES", 3: None, 4: "MODEL_FAILED", 5: "NO_SESSION", 6: "NO_SESSION", 7: None, 8: None, 9: None, 10: None}
    good, bad = refused.split_quarantine(got)
    assert good.count() == 6 and "error" not in good.columns and {(r.k, r.masked, r.blocked_by[0]) for r in bad.collect()} == {(2, None, "TOO_MANY_SHAPES"), (4, None, "MODEL_FAILED"), (5, None, "NO_SESSION"), (6, None, "NO_SESSION")}
    out = {r.k: r for r in good.collect()}
    assert "a@b.org" not in out[1].masked and out[10].masked is None and out[10].blocked_by == ["CREDIT_CARD"] and (out[7].masked, out[8].masked) == (None, "")
    assert mask.mappings(got).count() == 1  # of the refused rows none is told
    told = detect.detections(df, ["k"], "t", own, max_chars=100).where("detector = 'refused'").collect()
    assert {(r.k, r.entity_type, r.policy) for r in told} == {(2, "TEXT_TOO_LONG", "block"), (3, "TEXT_TOO_LONG", "block"), (4, "MODEL_FAILED", "block")}
    opened = scan.Model("m", find, fail_open=True)
    assert detect.detections(df.where("k = 4"), ["k"], "t", [opened]).count() == 0
    clean, away = detect.quarantine(df, "t", own, max_chars=100)
    assert clean.count() == 7 and away.count() == 3 and clean.columns == df.columns


def test_refusals_of_rules_and_shapes(spark):
    with pytest.raises(refused.Refused):
        scan.Scanner(tuple(CODES), max_chars=5).scan("T-1234")
    assert segments.tiles(FENCES)[-1][1] == len(FENCES) and len(segments.tiles("```\n" * 400)) <= segments.MAX_SEGMENTS
    with pytest.raises(refused.Refused):
        segments.tiles("```\n```\n\n" * 3000)
    df = spark.createDataFrame([(1, "`a` b"), (2, "```\n```\n\n" * 3000), (3, None)], "k int, t string")
    assert {(r.k, r.kind) for r in segments.segments(df, ["k"], "t").collect()} == {(1, "markdown_inline_code"), (1, "prose"), (2, "refused")}
    assert {r.k: r.why for r in segments.with_segments(df, "t", error="why").collect()} == {1: None, 2: "TOO_MANY_SHAPES", 3: None}


def test_quarantined_documents_query(spark, tmp_path):
    rows = [(1, "a@b.org and c@d.org"), (2, "x" * 30_000), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.error, r.n_hits) for r in queries.quarantined_documents(spark, str(tmp_path)).collect()}
    assert got == {1: (None, 2), 2: ("TEXT_TOO_LONG", None), 3: (None, 0), 4: (None, 0)}


class Stub:
    """A model of words of eight letters or more that counts its loads, with words as tokens."""

    loads = 0

    def __init__(self):
        Stub.loads += 1

    def offsets(self, text):
        return [m.span() for m in re.finditer(r"\S+", text)]

    def find_many(self, texts):
        assert all(len(t.split()) <= 20 for t in texts)
        return [[(m.start(), m.end(), "PROJECT_NAME", 0.9) for m in re.finditer("[A-Za-z]{8,}", t)] for t in texts]


def test_models_load_once_and_windows_equal_the_whole_text():
    Stub.loads = 0
    scan._loaded.clear()
    model = scan.Model("stub", load=Stub, window=20, shared=4, batch=3)
    texts = [" ".join(f"{'word' * (k % 4)}x{n}" for k in range(n)) for n in (0, 1, 19, 20, 21, 36, 37, 200)]
    for _ in range(2):
        found = scan.Scanner((model,), segment=False).scan_many(texts)
        for text, (hits, code) in zip(texts, found, strict=True):
            assert code is None and [(h.start, h.end) for h in hits] == [m.span() for m in re.finditer("[A-Za-z]{8,}", text)]
    assert Stub.loads == 1
    plain = scan.Model("plain", lambda t: [(m.start(), m.end(), "P", len(t) / 1000) for m in re.finditer("kk+", t)], least=0.0, window=50, shared=10)
    text = ("a" * 37 + "kkkk ") * 30
    assert [h.value for h in scan.Scanner((plain,), segment=False).scan(text)] == ["kkkk"] * 30
    assert scan.windows("x" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)] and scan.windows("", 5, 1) == [] and scan.windows("abc", None, 1) == [(0, 3)]


def test_secrets_of_more_names_and_forms():
    def found(text):
        return [(h.entity_type, h.value) for h in scan.Scanner(tuple(ALL)).scan(text)]

    assert ("JWT", "eyJhbGciOi.eyJzdWIiOm.SflKxwRJSM") in found("bearer eyJhbGciOi.eyJzdWIiOm.SflKxwRJSM")
    assert found("x npm_" + "c" * 36) == [("API_KEY", "npm_" + "c" * 36)]
    for name in ("MY_PASSWORD=", "db_password: ", 'client_secret="', "password = ", "APP.token="):
        assert found(f"{name}hunter2hunter2") == [("GENERIC_SECRET", "hunter2hunter2")], name
    assert found("mypassword=hunter2hunter2") == []
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----"
    assert found(f"a {key} b {key}") == [("PRIVATE_KEY", key)] * 2
    assert found("-----BEGIN PRIVATE KEY-----\n" * 20_000) == []


POSITIVE = [
    ("連絡は 03-1234-5678 または hanako@firma.example.com まで、電話ください", ["03-1234-5678", "hanako@firma.example.com"]),
    ("API key is sk-proj-ABCDEFGHIJKLMNOPQRSTUV", ["sk-proj-ABCDEFGHIJKLMNOPQRSTUV"]), ("host 10.20.30.40 is down", ["10.20.30.40"]),
    ("住所は大阪府大阪市北区梅田1-2-3です", ["大阪府大阪市北区梅田1-2-3"]), ("郵便番号 530-0001", ["530-0001"]), ("生年月日: 1985年3月4日", ["1985年3月4日"]),
    ("個人番号は 1234 5678 9018", ["1234 5678 9018"]), ("口座番号 7654321 に振込", ["7654321"]), ("jdbc postgres://app:s3cret@db.internal/x", ["postgres://app:s3cret@db.internal/x"]),
    ("card 5555 5555 5555 4444.", ["5555 5555 5555 4444"]),
]
NEGATIVE = ["version 1.2.3 of the library", "order 1234567 was shipped", "meet at 10:30 on 2024-05-01", "the token ring network", "id 123e4567-e89b-12d3-a456-426614174000", "sha 9f86d081884c7d65", "３月の会議は三階です", "price 1,234,567 yen"]


def test_precision_and_recall_on_own_texts():
    right = wrong = missed = 0
    for text, gold in POSITIVE:
        values = [h.value.strip() for h in scan.Scanner(tuple(ALL)).scan(text)]
        right += sum(v in gold for v in values)
        wrong += sum(v not in gold for v in values)
        missed += sum(g not in values for g in gold)
    for text in NEGATIVE:
        wrong += len(scan.Scanner(tuple(ALL)).scan(text))
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.85 and not any(scan.Scanner(tuple(ALL)).scan(t) for t in NEGATIVE)


def kinds(text):
    return [(k, text[a:b]) for a, b, k in segments.tiles(text) if k != "prose"]


def test_blocks_of_the_segmenter():
    assert kinds("a\n```py\nx\n```\nb") == [("source_code", "```py\nx\n```")] and kinds("~~~ json\n{}\n") == [("json_string", "~~~ json\n{}\n")]
    assert kinds("t\n{\n \"a\": 1\n}\nafter") == [("json_string", '{\n "a": 1\n}')] and kinds("{ open") == []
    assert kinds("ab: x\ncé: y\nfoo: z\nend") == [("yaml_scalar", "ab: x\ncé: y\nfoo: z\n")] and kinds("one: line only") == []
    assert kinds("$ ls -l\n# top\nx") == [("shell", "$ ls -l\n# top\n")] and kinds("grep -r x .\nplain") == [("shell", "grep -r x .")]
    assert kinds("def f(x):\n    return x\n\ntext") == [("source_code", "def f(x):\n    return x\n")]
    assert kinds("select a from b;\nx") == [("source_code", "select a from b;")] and kinds("static int x = 1;") == [("source_code", "static int x = 1;")]
    assert kinds("*** Begin Patch\n+a\n*** End Patch\nx") == [("patch", "*** Begin Patch\n+a\n*** End Patch")]
    assert kinds("--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y\nend") == [("diff", "--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y\n")]
    assert kinds("a `b` ``c`d`` e`") == [("markdown_inline_code", "`b`"), ("markdown_inline_code", "``c`d``")]
    assert kinds("{\n```\n}\n```\n") == [("source_code", "```\n}\n```")] or kinds("{\n```\n}\n```\n") == [("markdown_code", "```\n}\n```")]
    long = "key: value\n" * 50_000 + "{\n" * 50_000
    assert [k for k, _ in kinds(long)] == ["yaml_scalar"]


def test_tiles_of_the_segment_query_cover_every_text(spark):
    from maskframe.plans import engine_queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {(r.doc_id, r.kind): (r.n, r.chars) for r in engine_queries.segment_kinds(spark, d).collect()}
    want = Counter()
    chars = Counter()
    for k, t in texts.items():
        for a, b, kind in segments.tiles(t):
            want[k, kind] += 1
            chars[k, kind] += b - a
        assert sum(v for (i, _), v in chars.items() if i == k) == len(t)
    assert got == {k: (n, chars[k]) for k, n in want.items()}


def test_counts_equal_the_hits(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    hits = Counter((r.doc_id, r.entity_type) for r in detect.detections(docs, ["doc_id"], "text", ALL, resolve=False).collect())
    assert hits == Counter({(r.doc_id, r.entity_type): r.n for r in detect.entity_counts(docs, ["doc_id"], "text", ALL).collect()})


def test_texts_that_cannot_hit_stay_in_the_jvm(spark):
    own = [r for r in ALL if r.entity == "EMAIL"]
    df = spark.createDataFrame([(1, "a@b.org"), (2, "none"), (3, "a＠b.org"), (4, None)], "k int, t string")
    assert {r.k for r in df.where(detect.may_hit(scan.Scanner(tuple(own)), F.col("t"))).collect()} == {1, 3}
    assert {(r.k, r.value) for r in detect.detections(df, ["k"], "t", own).collect()} == {(1, "a@b.org"), (3, "a＠b.org")}


def test_keys_far_from_their_colon(spark):
    body = '{"a"' + " " * 200 + ': "x", "b"\n:\t"y:", "c": ["d"]}'
    rows = spark.createDataFrame([(1, body)], "k int, body string")
    assert [(r.kind, r.value) for r in walk.leaves(rows, ["k"], "body").collect()] == [("key", "a"), ("value", "x"), ("key", "b"), ("value", "y:"), ("key", "c"), ("value", "d")]
    assert rows.select(walk.transform_values("body", lambda v: F.upper(v)).alias("b")).first().b == body.replace('"x"', '"X"').replace('"y:"', '"Y:"').replace('"d"', '"D"')
