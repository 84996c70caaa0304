"""Queries of the masking operators and their SQL."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions import checksums
from maskframe.operators import audit, detect, mask, rules, scan, span_tables, state, term_join
from maskframe.streaming.shared import folder

from .engine_queries import LINES, lines_once

FORMATS = [r for r in rules.built_in() if r.detector == "formats"]
#: None of these overlaps itself.
TERMS = ("en", "te", "ten", "an", "est")
TOKENS = [r for r in rules.built_in() if r.entity == "GENERIC_SECRET"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _of(entity: str):
    own = [r for r in FORMATS if r.entity == entity]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect.detections(documents(spark, sf_dir), ["doc_id"], "text", own).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))

    return query


def detect_token_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detections(documents(spark, sf_dir), ["doc_id"], "text", TOKENS).select("doc_id", "value")


def entity_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.entity_counts(documents(spark, sf_dir), ["lang"], "text", rules.built_in())
    return found.groupBy("lang", "entity_type").agg(F.sum("n").alias("n"))


def docs_blocked_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detections(documents(spark, sf_dir), ["doc_id"], "text", rules.built_in())
    return detect.blocking(found, ["doc_id"]).select("doc_id", F.concat_ws(",", "blocked_by").alias("blocked_by"))


def mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [r for r in FORMATS if r.entity == "EMAIL"]
    docs = documents(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("s"), F.coalesce(F.pmod("doc_id", F.lit(7)), F.lit(0))).alias("session_id"))
    keys = mask.session_table(spark, {f"s{k}": bytes([k] * 32) for k in range(7)})
    masked = mask.mask(docs, keys, ["doc_id"], "text", own, segment=False)  # cut into segments, a text of too many shapes would be refused
    back = mask.restore(masked.select("doc_id", "session_id", "masked"), mask.mappings(masked), ["doc_id"], "masked")
    return back.select("doc_id", F.col("restored").alias("text"))


def document_sessions(docs: DataFrame) -> DataFrame:
    """A session for each id (of null: one) with demonstration keys: every digit of a digest twice, so that the pads are digit maps."""
    digits, rows = "0123456789abcdef", docs.select("session_id").distinct()
    pad = lambda a, b: F.unhex(F.array_join(F.transform(mask.characters(F.sha2("session_id", 256)), lambda c: F.concat(*(F.translate(c, digits, "".join(f"{int(d, 16) ^ x:x}" for d in digits)) for x in (a, b)))), ""))
    return rows.select("session_id", pad(0x3, 0x6).alias("inner_pad"), pad(0x5, 0xC).alias("outer_pad"))


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document masked by all rules in a session of its own, and restored: doc_id, blocked_by, masked_sha256, text.

    Secrets stay masked in ``text``. A blocked document and a null text have null text and an empty digest."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("s"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("session_id"))
    masked = mask.mask(docs, document_sessions(docs), ["doc_id"], "text", rules.built_in())
    # a null id joins with nothing, so rows go on by session
    masked = masked.withColumns({"blocked_by": F.concat_ws(",", "blocked_by"), "masked_sha256": F.coalesce(F.sha2("masked", 256), F.lit(""))}).persist(StorageLevel.DISK_ONLY)
    keys = ["blocked_by", "masked_sha256"]
    back = mask.restore(masked.select("session_id", *keys, "masked"), mask.mappings(masked), keys, "masked")
    return back.select(F.expr("cast(nullif(substring(session_id, 2), '') as long)").alias("doc_id"), *keys, F.col("restored").alias("text"))


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masking every document under the rules for e-mail addresses and cards tells of itself, in 50 sessions."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("s"), F.coalesce(F.pmod("doc_id", F.lit(50)), F.lit(0))).alias("session_id"))
    own = [r for r in FORMATS if r.entity in ("EMAIL", "CREDIT_CARD")]
    keys = document_sessions(spark.range(50).select(F.concat(F.lit("s"), "id").alias("session_id")))
    out = folder(spark, "audit")
    audit.write_audited(mask.mask(docs, keys, ["doc_id"], "text", own), f"{out}/rows", f"{out}/log", "audit_counts", audit.types_of(own))
    return spark.read.schema(audit.SCHEMA).parquet(f"{out}/log").groupBy("kind", "label").agg(F.sum("n").alias("n"))


def mask_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked text of every document under the e-mail rule, in a session for each id."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("s"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("session_id"))
    return mask.mask(docs, document_sessions(docs), ["doc_id"], "text", [r for r in FORMATS if r.entity == "EMAIL"]).select("doc_id", "masked")


def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of some terms, which overlap one another, is in each document, whatever the case."""
    own = [rules.dictionary_rules({t: [t]}, ignore_case=True)[0] for t in TERMS]
    rows = documents(spark, sf_dir).withColumn("row", F.monotonically_increasing_id())
    return detect.entity_counts(rows, ["doc_id", "row"], "text", own, segment=False).groupBy("doc_id", F.col("entity_type").alias("term")).agg(F.sum("n").alias("n"))


def table_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shop's people, addresses and places, and the lines of the benchmark, as a dictionary."""
    clients, lines = spark.read.parquet(f"{sf_dir}/clients.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return clients.select(F.explode(F.array("name", "email", "city")).alias("term")).unionByName(lines.select(F.explode(F.split("text", r"\. |\n")).alias("term")))


def table_terms_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of these terms each document holds."""
    return term_join.term_matches(documents(spark, sf_dir), "doc_id", "text", table_terms(spark, sf_dir))


#: The longest text that ``quarantined_documents`` looks through.
LONGEST = 20_000


def quarantined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a limit of characters: the reason for which it is refused, or how many e-mail addresses it holds."""
    found = detect.with_hits(documents(spark, sf_dir).select("doc_id", "text"), "text", [r for r in FORMATS if r.entity == "EMAIL"], error="error", max_chars=LONGEST)
    return found.select("doc_id", "error", F.when(F.col("error").isNull(), F.size("__hits")).alias("n_hits"))


class LongWords:
    """A stand-in for a model that is loaded: runs of twelve or more ASCII letters."""

    def find_many(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        return [[(m.start(), m.end(), "PROJECT_NAME", 0.9) for m in re.finditer("[A-Za-z]{12,}", t)] for t in texts]


def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model of 400 characters finds in every whole document, window by window."""
    model = scan.Model("long_words", load=LongWords, window=400, shared=64)
    found = detect.detections(documents(spark, sf_dir), ["doc_id"], "text", [model], segment=False)
    return found.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as spans: every two neighbours overlap or touch, and pairs lie apart."""
    lines = lines_once(spark, sf_dir)
    k = F.col("l_linenumber").cast("int")
    spans = lines.select(
        F.col("l_orderkey").alias("doc"), (F.floor((k - 1) / 2) * 100 + (k - 1) % 2 * 10).cast("int").alias("start"), (F.floor((k - 1) / 2) * 100 + (k - 1) % 2 * 10 + 6 + F.col("l_suppkey") % 10).cast("int").alias("end"),
        F.when(F.col("l_partkey") % 5 == 0, "CREDIT_CARD").otherwise(F.col("l_returnflag")).alias("entity_type"), F.lit(0.5).alias("score"), (F.col("l_partkey") % 3 * 10).cast("int").alias("priority"),
        F.when(F.col("l_suppkey") % 4 == 0, "redacted").otherwise("literal").alias("policy"), k.alias("ord"), F.lit("").alias("value"), F.lit("x").alias("detector"), F.lit("numeric").alias("profile"),
    )
    return span_tables.resolve_table(spans, ["doc"]).select("doc", "start", F.col("end").alias("stop"), "entity_type", "policy")


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order as a span of the text of its flag, so that a few texts have all spans; some have no length."""
    at, long = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.pmod("l_partkey", F.lit(13)) - F.pmod("l_suppkey", F.lit(3))
    spans = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("doc"), at.cast("int").alias("start"), (at + F.greatest(long, F.lit(0))).cast("int").alias("end"), "l_linenumber")
    return spans.where("start is not null and `end` is not null")


def span_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each text that spans cover without a gap."""
    found = span_tables.islands(line_spans(spark, sf_dir), ["doc"])
    return found.groupBy("doc", "island").agg(F.max("end").alias("stop"), F.count(F.lit(1)).alias("n"))


def guard_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of odd numbers as identifiers: how many of each span lie in a longer one of the others and would be dropped."""
    spans = line_spans(spark, sf_dir)
    odd = F.col("l_linenumber") % 2 == 1
    found = span_tables.inside(spans.where(odd), spans.where(~odd), ["doc"], "dropped")
    return found.groupBy("doc", "start", F.col("end").alias("stop"), "dropped").agg(F.count(F.lit(1)).alias("n"))


def checksum_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    number = lambda n: F.lpad((F.col("o_orderkey") * 7919 % 10_000_019).cast("string"), n, "4")
    card, mine, firm = number(16), number(12), number(13)
    ip = F.concat_ws(".", F.col("o_orderkey") % 300, F.col("o_orderkey") % 7, F.lit("2"), F.concat(F.when(F.col("o_orderkey") % 11 == 0, "0").otherwise(""), (F.col("o_orderkey") % 99).cast("string")))
    residence = F.concat(F.lit("AB"), F.substring(card, -8, 8), F.lit("CD"))
    return orders.select(
        "o_orderkey", checksums.luhn(card).alias("luhn"), checksums.my_number(mine).alias("my_number"), checksums.corporate_number(firm).alias("corporate"), checksums.ipv4(ip).alias("ipv4"), checksums.residence_card(residence).alias("residence")
    )


def alias_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = mask.session_table(spark, {"s": b"key"})
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").crossJoin(F.broadcast(keys))  # one row
    return names.select("c_custkey", mask.hmac_sha256(F.col("inner_pad"), F.col("outer_pad"), F.col("c_name")).alias("hmac"))


def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    last = state.upsert(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")
    return last.join(events.groupBy("user_id").agg(F.max("event_id").alias("last_id")), "user_id")


QUERIES = {
    "detect_email": _of("EMAIL"),
    "detect_ipv4": _of("IP_ADDRESS"),
    "detect_card_luhn": _of("CREDIT_CARD"),
    **{f.__name__: f for f in (detect_token_assignment, entity_counts_by_lang, docs_blocked_by_policy, mask_round_trip, mask_emails, mask_documents, audit_counts, dictionary_matches, table_terms_found, quarantined_documents, model_windows, resolve_overlaps, span_islands, guard_spans, checksum_rules, alias_hmac, latest_wins_upsert)},
}

EMAILS = r"""regexp_extract_all(text, '[^\s@,;:<>()\[\]\\"''、。，．！？「」『』（）぀-ゟ]+@[^\s@,;:<>()\[\]\\"''、。，．！？「」『』（）]+\.(?:[A-Za-z]{2,}|[^\s@,;:<>()\[\]\\"''、。，．！？「」『』（）.]{2,})')"""
IPS = r"""list_filter(regexp_extract_all(regexp_replace(text, '([^0-9.])', '\1\1', 'g'), '(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:$|[^0-9.])', 1),
  lambda v: NOT regexp_matches(v, '^(192\.0\.2|198\.51\.100|203\.0\.113)\.') AND len(list_filter(string_split(v, '.'), lambda p: CAST(p AS INTEGER) > 255 OR (length(p) > 1 AND p[1] = '0'))) = 0)"""

#: Digits with one separator after each; what stands before and after a run is doubled, so that runs may share it.
CARDS = r"""list_transform(regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])((?:[0-9](?:  |--)?){13,19})(?:$|[^0-9])', 1), lambda v: replace(replace(v, '  ', ' '), '--', '-'))"""
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INTEGER) ELSE CAST(substr(d, i, 1) AS INTEGER) * 2 - CASE WHEN substr(d, i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
#: Nothing but a letter or digit may stand before a name; RE2 has no look-behind, so the character before is taken in.
_TOKEN = r"""(?i)(?:^|[^A-Za-z0-9])(?:password|passwd|pwd|secret|token|api_key|apikey|access_key|secret_key)\s{0,3}[:=]\s{0,3}["'']?([A-Za-z0-9+/_.~-]{8,}={0,2})"""


def _digits(value: str, weights: tuple[int, ...], first: int = 1) -> str:
    return " + ".join(f"CAST(substr({value}, {first + i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights))


def _pad(high: int, low: int) -> str:
    hexes = "0123456789abcdef"
    of = lambda x: f"translate(h, '{hexes}', '{''.join(f'{int(c, 16) ^ x:x}' for c in hexes)}')"
    return f"unhex(array_to_string(list_transform(range(1, 65), lambda i: substr({of(high)}, i, 1) || substr({of(low)}, i, 1)), ''))"


def _hmac(inner: str, outer: str, message: str) -> str:
    return f"sha256({outer} || unhex(sha256({inner} || {message})))"


_FIXED = [f"unhex('{(bytes(b ^ x for b in b'key'.ljust(64, bytes(1)))).hex()}')" for x in (0x36, 0x5C)]
_SPANS = """(SELECT l_returnflag AS doc, CAST(l_orderkey * 8 + l_linenumber AS INTEGER) AS start, CAST(l_orderkey * 8 + l_linenumber + greatest(l_partkey % 13 - l_suppkey % 3, 0) AS INTEGER) AS stop, l_linenumber FROM lineitem
    WHERE l_orderkey + l_linenumber IS NOT NULL)"""
_OVER = "o.start < s.stop AND s.start < o.stop"

ORACLE_SQL = {
    "detect_email": f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest({EMAILS}) AS value FROM documents) GROUP BY ALL",
    "detect_ipv4": f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest({IPS}) AS value FROM documents) GROUP BY ALL",
    "table_terms_found": r"""WITH t AS (SELECT DISTINCT term FROM (SELECT unnest([name, email, city]) AS term FROM clients UNION ALL SELECT unnest(regexp_split_to_array(text, '\. |\n')) FROM benchmark) WHERE term <> '')
      SELECT DISTINCT doc_id, term FROM documents JOIN t ON contains(text, term)""",
    "quarantined_documents": f"SELECT doc_id, CASE WHEN length(text) > {LONGEST} THEN 'TEXT_TOO_LONG' END AS error, CAST(CASE WHEN length(text) > {LONGEST} THEN NULL ELSE coalesce(len({EMAILS}), 0) END AS INTEGER) AS n_hits FROM documents",
    "model_windows": "SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{12,}')) AS value FROM documents) GROUP BY ALL",
    "audit_counts": f"""WITH d AS (SELECT coalesce(len({EMAILS}), 0) AS mails, coalesce(len(list_filter(list_transform({CARDS}, lambda v: regexp_replace(v, '[ -]', '', 'g')), lambda d: {_LUHN})), 0) AS cards FROM documents),
        n AS (SELECT unnest([{{'kind': 'event', 'label': 'request_masked', 'n': count(*) FILTER (cards = 0)}}, {{'kind': 'event', 'label': 'request_blocked', 'n': count(*) FILTER (cards > 0)}}, {{'kind': 'reason', 'label': 'CREDIT_CARD', 'n': count(*) FILTER (cards > 0)}},
          {{'kind': 'entity', 'label': 'EMAIL', 'n': CAST(sum(mails) AS BIGINT)}}, {{'kind': 'entity', 'label': 'CREDIT_CARD', 'n': CAST(sum(cards) AS BIGINT)}}], recursive := true) FROM d)
      SELECT kind, label, n FROM n WHERE n > 0""",
    "mask_round_trip": "SELECT doc_id, text FROM documents",
    "detect_token_assignment": f"SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}', 1)) AS value FROM documents",
    "detect_card_luhn": f"""SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, value, regexp_replace(value, '[ -]', '', 'g') AS d FROM (SELECT doc_id, unnest({CARDS}) AS value FROM documents)) WHERE {_LUHN} GROUP BY ALL""",
    "mask_emails": f"""SELECT doc_id, list_reduce(list_prepend(text, list_sort(list_distinct({EMAILS}))), lambda t, v: replace(t, v, 'mf-user-' || substr({_hmac("i", "o", "encode(v || chr(0) || 'EMAIL' || chr(0) || 'email')")}, 1, 12) || '@example.invalid')) AS masked
      FROM (SELECT doc_id, text, {_pad(0x3, 0x6)} AS i, {_pad(0x5, 0xC)} AS o FROM (SELECT doc_id, text, sha256('s' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents))""",
    "dictionary_matches": f"""SELECT doc_id, term, n FROM (SELECT doc_id, term, (length(text) - length(replace(lower(text), term, ''))) // length(term) AS n
      FROM documents, (SELECT unnest({list(TERMS)}) AS term)) WHERE n > 0""",
    "resolve_overlaps": f"""WITH s AS (SELECT l_orderkey AS doc, CAST((l_linenumber - 1) // 2 * 100 + (l_linenumber - 1) % 2 * 10 AS INTEGER) AS start, CAST((l_linenumber - 1) // 2 * 100 + (l_linenumber - 1) % 2 * 10 + 6 + l_suppkey % 10 AS INTEGER) AS stop,
        CASE WHEN l_partkey % 5 = 0 THEN 'CREDIT_CARD' ELSE l_returnflag END AS entity_type, l_partkey % 3 AS priority, l_linenumber AS ord,
        CASE WHEN l_partkey % 5 = 0 THEN 3 WHEN l_suppkey % 4 = 0 THEN 2 ELSE 0 END AS safe FROM {LINES})
      SELECT doc, start, stop, entity_type, CASE safe WHEN 3 THEN 'block' WHEN 2 THEN 'redacted' ELSE 'literal' END AS policy FROM s
      WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.doc = s.doc AND o.ord <> s.ord AND {_OVER} AND (o.safe, o.priority, o.stop - o.start, -o.start) > (s.safe, s.priority, s.stop - s.start, -s.start))""",
    "span_islands": f"""WITH p AS (SELECT doc, start, max(stop) AS stop, count(*) AS n FROM {_SPANS} GROUP BY ALL),
        f AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY start) AS run FROM f)
      SELECT doc, min(start) AS island, max(stop) AS stop, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY doc, run""",
    "guard_spans": f"""WITH s AS (SELECT *, l_linenumber % 2 = 1 AS odd FROM {_SPANS}), p AS (SELECT doc, start, max(stop) FILTER (NOT odd) AS here FROM s GROUP BY ALL),
        b AS (SELECT *, max(here) OVER (PARTITION BY doc ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
      SELECT s.doc, s.start, s.stop, coalesce(b.before >= s.stop, FALSE) OR coalesce(b.here > s.stop, FALSE) AS dropped, count(*) AS n
      FROM s JOIN b ON s.doc IS NOT DISTINCT FROM b.doc AND s.start = b.start WHERE odd GROUP BY ALL""",
    "checksum_rules": f"""SELECT o_orderkey, {_LUHN} AS luhn,
        (CASE WHEN ({_digits("m", (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2))}) % 11 <= 1 THEN 0 ELSE 11 - ({_digits("m", (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2))}) % 11 END) = CAST(substr(m, 12, 1) AS INTEGER) AS my_number,
        9 - ({_digits("c", (2, 1) * 6, 2)}) % 9 = CAST(substr(c, 1, 1) AS INTEGER) AS corporate, o_orderkey % 300 <= 255 AND o_orderkey % 11 <> 0 AND NOT (o_orderkey % 300 = 192 AND o_orderkey % 7 = 0) AS ipv4,
        ({_digits("r", (7, 6, 5, 4, 3, 2, 7))}) % 11 = CAST(substr(r, 8, 1) AS INTEGER) AS residence
      FROM (SELECT o_orderkey, lpad(v, 16, '4') AS d, lpad(v, 12, '4') AS m, lpad(v, 13, '4') AS c, right(lpad(v, 16, '4'), 8) AS r FROM (SELECT o_orderkey, CAST(o_orderkey * 7919 % 10000019 AS VARCHAR) AS v FROM orders))""",
    "alias_hmac": f"SELECT c_custkey, {_hmac(*_FIXED, 'encode(c_name)')} AS hmac FROM customer",
    "latest_wins_upsert": "SELECT user_id, max_by(event_type, struct_pack(ts, event_id)) AS event_type, max(event_id) AS last_id FROM events GROUP BY user_id",
}
