"""Counters with bounded labels, latency, and precision and recall of detections."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Routes and what they are counted as.
ROUTES = {"/responses": "openai", "/v1/responses": "openai", "/models": "openai", "/v1/models": "openai", "/messages": "anthropic", "/v1/messages": "anthropic", "/health": "admin", "/ready": "admin"}


def provider_of(path: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))[path], F.lit("unknown"))


def outcome(status: Column) -> Column:
    return F.when(status < 400, F.lit("success")).when(status < 500, F.lit("client_error")).otherwise(F.lit("server_error"))


def entity_label(entity: Column, known: tuple[str, ...]) -> Column:
    """Types of users' own rules count as CUSTOM, so that labels stay few."""
    return F.when(entity.isin(*known), entity).otherwise(F.lit("CUSTOM"))


def counters(rows: DataFrame, labels: list[str], millis: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"), F.sum(millis).alias("ms_sum"))


def latency(rows: DataFrame, by: list[str], millis: str) -> DataFrame:
    """Median and 95th percentile, both a value that occurs (the first with at least that share at or below it). The
    aggregate counts distinct values before the shuffle; round ``millis`` where there are many."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by {millis})")
    return rows.groupBy(*by).agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"))


def short_fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def surface_scores(gold: DataFrame, found: DataFrame, keys: list[str], code: Column) -> DataFrame:
    """entity_type, tp, fp, fn, precision, recall, f1, prose_fp, code_fp of gold and found (keys, n, entity_type, value).

    Gold values by ``n`` take the first free found value of their type that holds them or is held by them. ``code`` tells
    of a found row whether it stands in code; the last two columns count what was found in documents without any gold."""
    list_of = lambda df, name: df.groupBy(*keys, "entity_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda v: v["value"]).alias(name))
    both = list_of(gold, "__gold").join(list_of(found, "__found"), [*keys, "entity_type"], "full")
    both = both.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("__gold", "__found")})
    free = F.transform("__found", lambda v, i: F.struct(i.alias("i"), v.alias("v")))

    def take(acc: Column, g: Column) -> Column:
        first = F.try_element_at(F.filter(acc["free"], lambda f: F.contains(f["v"], g) | F.contains(g, f["v"])), F.lit(1))
        rest = F.filter(acc["free"], lambda f: first.isNull() | (f["i"] != first["i"]))
        return F.struct(rest.alias("free"), (acc["tp"] + first.isNotNull().cast("int")).alias("tp"))

    rows = both.withColumn("tp", F.aggregate("__gold", F.struct(free.alias("free"), F.lit(0).alias("tp")), take)["tp"])
    total = rows.groupBy("entity_type").agg(F.sum("tp").alias("tp"), F.sum(F.size("__found") - F.col("tp")).alias("fp"), F.sum(F.size("__gold") - F.col("tp")).alias("fn"))
    alone = found.withColumn("__code", code).join(gold.select(*keys).distinct(), keys, "left_anti").groupBy("entity_type")
    alone = alone.agg(F.count_if(~F.col("__code")).alias("prose_fp"), F.count_if("__code").alias("code_fp"))
    total = with_shares(total).join(alone, "entity_type", "left")
    return total.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("prose_fp", "code_fp")})


def with_shares(total: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; without anything found (or wanted) precision (or recall) is 1."""
    share = lambda other: F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), F.lit(1.0))
    total = total.withColumns({"precision": share("fp"), "recall": share("fn")})
    p, r = F.col("precision"), F.col("recall")
    return total.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def scores(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """entity_type, tp, fp, fn, precision, recall, f1 of gold and found (keys, entity_type, start, end).

    Within a document and type a found span serves one gold span: gold spans by start take the first free found span
    that overlaps. Without anything found (or wanted) precision (or recall) is 1. Spans without a start or an end match
    nothing. A document's spans pass through a task in the order of their starts, and only those that may still match are
    held, so that documents of any number of spans are matched in linear time."""
    side = lambda df, found: df.select(*keys, "entity_type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(found).alias("__found"))
    rows = side(gold, False).unionByName(side(found, True))
    own = [*keys, "entity_type"]
    dealt = rows.withColumn("__of", F.to_json(F.struct(*own))).repartition("__of").sortWithinPartitions("__of", "start", "end", "__found")
    told = dealt.select("__of", "entity_type", "start", "end", "__found").mapInArrow(_matched, "entity_type string, tp long, n_found long, n_gold long")
    total = told.groupBy("entity_type").agg(*(F.sum(c).alias(c) for c in ("tp", "n_found", "n_gold")))
    return with_shares(total.select("entity_type", "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn")))


def matches(rows: Iterator[tuple[int | None, int | None, bool]]) -> tuple[int, int, int]:
    """(matched, found, gold) of one document's spans (start, end, whether found), sorted."""
    gold: deque[tuple[int, int]] = deque()
    free: deque[tuple[int, int]] = deque()
    tp = found = wanted = 0

    def settle() -> int:
        start, end = gold.popleft()
        while free and free[0][1] <= start:
            free.popleft()  # ends before this gold span and all later ones begin
        if free and free[0][0] < end:
            free.popleft()
            return 1
        return 0

    for start, end, is_found in rows:
        found, wanted = found + is_found, wanted + (not is_found)
        if start is None or end is None:
            continue
        while gold and gold[0][1] <= start:  # all found spans that begin before its end are known
            tp += settle()
        (free if is_found else gold).append((start, end))
    while gold:
        tp += settle()
    return tp, found, wanted


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str | None, list[int]] = {}
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("__of", "entity_type", "start", "end", "__found")), strict=True))
    for (_, entity), own in groupby(rows, itemgetter(0, 1)):
        cells = total.setdefault(entity, [0, 0, 0])
        for k, n in enumerate(matches(itemgetter(2, 3, 4)(r) for r in own)):
            cells[k] += n
    names = ("tp", "n_found", "n_gold")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([c[k] for c in total.values()], pa.int64()) for k in range(3))], names=["entity_type", *names])


def fuzzy_windows(df: DataFrame, keys: list[str], text: str, size: int = 400, shared: int = 64) -> DataFrame:
    """keys, start, end of windows that cover a text, neighbours sharing ``shared`` characters; none for empty texts."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - shared - 1, F.lit(0)), F.lit(size - shared))
    return df.where(n > 0).select(*keys, n.alias("__n"), F.explode(starts).alias("start")).select(*keys, "start", F.least(F.col("start") + size, F.col("__n")).alias("end"))


def best_per_span(rows: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """The row of the highest score for each key; of equal scores the one that comes first by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), *order)).alias("__best"))
    return best.select(*keys, *(F.col("__best")[c].alias(c) for c in rest))
