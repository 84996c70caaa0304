"""The scanner, alias allocation and restoring."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskframe.operators import detect, mask, rules, scan, structure

ALL = rules.built_in()


def found(text, own=ALL, **options):
    return [(h.entity_type, h.value) for h in scan.Scanner(tuple(own), **options).scan(text)]


def test_full_width_text_is_found_and_told_as_written():
    text = "電話 ０９０-１２３４-５６７８ と taro＠example.co.jp ㍿"
    hits = scan.Scanner(tuple(ALL)).scan(text)
    assert [(h.entity_type, h.value, h.normalized) for h in hits] == [("PHONE", "０９０-１２３４-５６７８", "090-1234-5678"), ("EMAIL", "taro＠example.co.jp", "taro@example.co.jp")]
    assert all(text[h.start : h.end] == h.value for h in hits)


def test_many_hits_and_many_terms_are_quick():
    began = time.time()
    text = "".join(f"user{i}@example.com from 10.0.{i % 250}.{i % 200}\n" for i in range(10_000))
    assert len(found(text)) == 20_000
    terms = [f"term{k:05d}" for k in range(10_000)]
    rng = random.Random(1)
    text = " ".join(rng.choice(["lorem", "ipsum", rng.choice(terms)]) for _ in range(15_000))[:100_000]
    got = found(text, [*rules.dictionary_rules({"PROJECT_NAME": terms}), *ALL])
    assert len(got) == len(re.findall(r"term\d{5}", text))
    assert len(found("x" * 200_000 + "@")) == 0 and len(found("[INFO] a\n" * 20_000)) == 0
    assert time.time() - began < 20


def test_overlapping_terms_case_and_blanks():
    own = rules.dictionary_rules({"A": ["aba", "ba b"]})
    assert [(h.start, h.value) for h in scan.Scanner(tuple(own), resolve=False, segment=False).scan("ababa b")] == [(0, "aba"), (2, "aba"), (3, "ba b")]
    own = rules.dictionary_rules({"A": ["Straße"]}, ignore_case=True)
    assert found("x ß STRASSE y straße", own) == [("A", "STRASSE"), ("A", "straße")]
    own = rules.dictionary_rules({"P": ["山田太郎"]})
    assert found("山田太郎 山田 太郎 山 田 太 郎 山田  太郎 山田\n太郎", own, segment=False) == [("P", "山田太郎"), ("P", "山田 太郎"), ("P", "山 田 太 郎")]


def test_finder_without_the_automaton(monkeypatch):
    values = {f"k{k}": None for k in range(20)} | {"k1k": None}
    text = "k1k12 k19x k3"
    expected = sorted(scan.Finder(values).all(text))
    monkeypatch.setattr(scan, "ahocorasick", None)
    assert sorted(scan.Finder(values).all(text)) == expected and (0, 3, "k1k") in expected


def test_resolution_equals_a_plain_greedy_choice():
    rng = random.Random(4)
    for _ in range(300):
        hits = []
        for k in range(rng.randint(0, 25)):
            a = rng.randint(0, 60)
            kind = rng.choice(["A", "B", "CREDIT_CARD", "EXISTING_ALIAS"] if rng.random() < 0.2 else ["A", "B"])
            hits.append(scan.Hit(a, a + rng.randint(1, 12), "", "", kind, "x", rng.choice([0.5, 0.9]), rng.choice([10, 20]), "numeric", rng.choice(["literal", "redacted"]), k))
        touch = lambda x, y: x.start < y.end and y.start < x.end
        shut = [h for h in hits if h.entity_type == "EXISTING_ALIAS"]
        left = [h for h in hits if h.entity_type != "EXISTING_ALIAS" and not any(touch(h, s) for s in shut)]
        kept = []
        for h in sorted(left, key=lambda h: (-scan.safety(h), -h.priority, h.start - h.end, -h.score, h.start, h.end, h.ord)):
            if not any(touch(h, o) for o in kept):
                kept.append(h)
        assert [h[:2] for h in scan.resolved(hits)] == sorted(h[:2] for h in kept)


def test_issued_aliases_are_left_alone(spark):
    df = spark.createDataFrame([(1, "mf-user-0123456789ab@example.invalid a@b.org", ["mf-user-0123456789ab@example.invalid"]), (2, "mf-user-0123456789ab@example.invalid", None)], "k int, t string, known array<string>")
    got = detect.detections(df, ["k"], "t", ALL, issued="known").collect()
    assert [(r.k, r.value) for r in got] == [(1, "a@b.org"), (2, "mf-user-0123456789ab@example.invalid")]


def test_models_see_prose_once_and_are_clipped():
    calls = []

    def find(text):
        calls.append(text)
        return [(m.start(), m.end(), "PERSON", 0.9) for m in re.finditer("Ann[^.]*Bob", text)]

    text = "Ann met\n```\nAnn code Bob\n```\nBob. end"
    model = scan.Model("model", find, words=())
    got = scan.Scanner((model,)).scan(text)
    assert len(calls) == 1 and "code" not in calls[0] and [h.value for h in got] == ["Ann met\n", "\nBob"]
    assert scan.Scanner((scan.Model("model", find, words=("Mr",), least=0.75),)).scan("Ann x Bob") == []


def test_two_stages_settle_segments_first():
    own = [rules.user_rule("a", "aaaa", "A", priority=10), rules.user_rule("b", "aa", "B", priority=5)]
    assert found("aaaa", own, twice=True) == found("aaaa", own) == [("A", "aaaa")]


def test_groups_of_patterns_and_configuration():
    own = [rules.user_rule("a", r"id=(\d+)", "ID", group=1)]
    assert found("id=12 id=x", own) == [("ID", "12")]
    with pytest.raises(ValueError):
        rules.user_rule("a", "x", "ID", group=1)
    got, session = rules.load_config('{"version": 1, "entities": [{"id": "e", "type": "PROJECT_NAME", "values": ["Kestrel"], "case_insensitive": true}], "patterns": [{"id": "p", "type": "TICKET", "pattern": "T-[0-9]+"}], "session": {"idle_ttl": "30m"}}')
    assert found("kestrel T-12", got) == [("PROJECT_NAME", "kestrel"), ("TICKET", "T-12")] and session == {"idle_seconds": 1800, "absolute_seconds": 86400}
    for bad in ('{"version": 2}', '{"version": 1, "x": 1}', '{"version": 1, "session": {"idle_ttl": "2d"}}', '{"version": 1, "patterns": [{"id": "a", "type": "T", "pattern": "(a+)+"}]}'):
        with pytest.raises(ValueError):
            rules.load_config(bad)


def masked(spark, rows, own=ALL, **options):
    keys = mask.session_table(spark, {s: s.encode() * 32 for s in {r[1] for r in rows}})
    return mask.mask(spark.createDataFrame(rows, "k int, session_id string, t string"), keys, ["k"], "t", own, **options)


def back(spark, out, known=None):
    rows = mask.restore(out.where("masked is not null").select("k", "session_id", "masked"), known or mask.mappings(out), ["k"], "masked")
    return {r.k: r.restored for r in rows.collect()}


def test_short_numbers_and_digits_elsewhere_come_back_exactly(spark):
    text = "内線 7 電話 room 3 1234 5678 90 and 090-1234-5678 x109012345678 tel"
    out = masked(spark, [(1, "s", text)]).cache()
    assert "内線 7" not in out.first().masked and back(spark, out)[1] == text


def test_a_hundred_and_twenty_addresses_in_a_session(spark):
    text = " ".join(f"10.1.{k // 50}.{k % 50 + 1}" for k in range(120))
    out = masked(spark, [(1, "s", text), (2, "s", "10.1.0.1 again"), (3, "t", "10.1.0.1")]).cache()
    rows = {r.k: r for r in out.collect()}
    aliases = [a.alias for a in rows[1].aliases]
    assert len(set(aliases)) == 120 and rows[2].masked.split()[0] == aliases[0] and "10.1." not in rows[1].masked
    assert back(spark, out) == {1: text, 2: "10.1.0.1 again", 3: "10.1.0.1"}
    # another run of the session keeps what is known, and does not look into its own aliases
    known = mask.mappings(out)
    later = masked(spark, [(1, "s", "10.1.0.1 10.9.9.9 " + rows[1].masked)], known=known).cache()
    assert later.first().masked.split()[0] == aliases[0] and later.first().masked.endswith(rows[1].masked)
    few = {r.k: r for r in masked(spark, [(1, "s", text), (2, "s", "plain"), (3, "t", "10.1.0.1")], most=100).collect()}
    assert all((few[k].masked, few[k].error, few[k].blocked_by) == (None, "TOO_MANY_VALUES", ["TOO_MANY_VALUES"]) for k in (1, 2)) and few[3].masked and few[3].error is None


def test_values_without_a_free_alias_are_refused(spark):
    text = " ".join(f"10.{k // 200}.{k % 200}.9" for k in range(800))
    got = {r.k: r for r in masked(spark, [(1, "s", text), (2, "s", "plain")]).collect()}
    assert (got[1].masked, got[1].error, got[1].aliases) == (None, "NO_FREE_ALIAS", []) and (got[2].masked, got[2].error) == ("plain", None)


def test_repeats_are_masked_in_one_pass_and_forms_may_share(spark):
    out = masked(spark, [(1, "s", "token = abcdefgh12 and abcdefgh12, redacted x")], [*ALL, rules.user_rule("r", "redacted", "R", policy="redacted")]).first()
    assert "abcdefgh12" not in out.masked and out.masked.count("MF_SECRET_") == 2 and "[REDACTED]" in out.masked
    rows = [(1, "s", "電話 090-1234-5678"), (2, "s", "電話 ０９０-１２３４-５６７８")]
    one = {r.k: r.masked for r in masked(spark, rows, merge_surface_forms=True).collect()}
    two = {r.k: r.masked for r in masked(spark, rows).collect()}
    assert one[1] == one[2] and two[1] != two[2]


def test_aliases_that_a_text_holds_already_are_not_used(spark):
    first = masked(spark, [(1, "s", "a@b.org")]).first().masked
    out = masked(spark, [(1, "s", f"a@b.org {first}x")], [r for r in ALL if r.entity == "EMAIL"]).cache()
    assert not out.first().masked.startswith(first + " ")


def test_url_and_path_profiles_equal_the_columns(spark):
    urls = ["https://u:p@Host.example.com:8080/a/b.tar.gz?k=v&q=w#f", "http://h", "mailto:a@b.org", "no scheme", "http://h:x/", "http://[::1]:99999/", "ftp://h/.bashrc/?flag", "http://h/a%2Fb/../c?a=1&b&c=2", "http://h/?"]
    urls += [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", structure.url_alias(F.lit("t"), F.col("u")).alias("a")).collect()
    assert all(structure.url_alias_of("t", r.u) == r.a for r in got)
    paths = ["/home/al/x.tar.gz", "C:\\Users\\al\\n.txt", "\\\\srv\\share\\f.doc", "../a/", "x", ".bashrc", "a/.b.c"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", structure.path_alias(F.lit("t"), F.col("p")).alias("a")).collect()
    assert all(structure.path_alias_of("t", r.p) == r.a for r in got)


def test_values_are_sealed_with_their_context(spark):
    df = spark.createDataFrame([("é secret", bytearray(b"k" * 32), "fp")], "v string, k binary, c string")
    sealed = df.select("*", mask.sealed(F.col("v"), F.col("k"), F.col("c")).alias("s")).cache()
    assert sealed.select(mask.opened(F.col("s"), F.col("k"), F.col("c")).alias("v")).first().v == "é secret"
    with pytest.raises(Exception, match="(?i)tag"):
        sealed.select(mask.opened(F.col("s"), F.col("k"), F.lit("other")).alias("v")).collect()
