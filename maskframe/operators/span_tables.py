"""Tables of spans (keys, start, end): islands, spans that lie inside others, and resolution, for documents of any number of spans.

All come from one running maximum by place, which is taken in two steps so that no task holds a document: in bins of ``WIDTH``
places, and over the bins' maxima. Of a bin at most ``WIDTH`` rows are ordered together, as spans that start at one place are
one row by then; of a document one narrow row a bin (at most 2^31 / WIDTH, as places are integers). No pair of spans is made.

Defined cases: null keys are a key; rows without a start or an end name no span and are left out; repeated rows are spans like
others; an empty table gives an empty result; further columns are kept by ``islands`` and ``inside``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import HIT, hit_lists
from .rules import FLOOR, STRENGTH
from .scan import ALIAS_TYPE, Hit, resolved

WIDTH = 4096
#: The most hits of a bin that are settled in the plan, where each looks at those taken before it.
FEW = 16


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys are equal."""
    named = right.select(*(F.col(f"`{k}`").alias(f"__of_{n}") for n, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.col(f"__of_{n}")) for n, k in enumerate(keys)))
    return left.join(named, on, how).drop(*(f"__of_{n}" for n in range(len(keys))))


def running_max(places: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """places(keys, start, ...), one row a place, with the largest ``value`` of the places before."""
    binned = places.withColumn("__bin", F.floor(F.col("start") / WIDTH))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = binned.groupBy(*keys, "__bin").agg(F.max(value).alias("__top"))
    carried = tops.withColumn("__carried", F.max("__top").over(earlier(keys, "__bin"))).drop("__top")
    here = F.max(value).over(earlier([*keys, "__bin"], "start"))
    return _beside(binned, carried, [*keys, "__bin"]).withColumn(out, F.greatest(here, F.col("__carried"))).drop("__bin", "__carried")


def _spans(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def islands(rows: DataFrame, keys: list[str], out: str = "island") -> DataFrame:
    """``rows`` with the place at which their island begins. Spans that overlap, directly or over others, and spans that start
    at one place are of one island; spans that only touch are not."""
    rows = _spans(rows)
    places = running_max(rows.groupBy(*keys, "start").agg(F.max("end").alias("__end")), keys, "__end", "__reach")
    first = F.when(F.col("__reach").isNull() | (F.col("start") >= F.col("__reach")), F.col("start"))
    begun = running_max(places.select(*keys, "start", first.alias("__first")), keys, "__first", "__last")
    return _beside(rows, begun.select(*keys, "start", F.greatest("__first", "__last").alias(out)), [*keys, "start"])


def inside(rows: DataFrame, covers: DataFrame, keys: list[str], out: str = "inside") -> DataFrame:
    """``rows`` with whether a span of ``covers`` with the same keys holds theirs and is longer: what starts before has to reach
    their end, what starts with them has to go beyond it."""
    rows, none = _spans(rows), F.lit(None).cast(dict(covers.dtypes)["end"])
    both = rows.select(*keys, "start", none.alias("__end")).unionByName(_spans(covers).select(*keys, "start", F.col("end").alias("__end")))
    reach = running_max(both.groupBy(*keys, "start").agg(F.max("__end").alias("__here")), keys, "__here", "__before")
    held = [F.coalesce(F.col("__before") >= F.col("end"), F.lit(False)), F.coalesce(F.col("__here") > F.col("end"), F.lit(False))]
    return _beside(rows, reach, [*keys, "start"]).withColumn(out, held[0] | held[1]).drop("__here", "__before")


def safety(policy: Column, entity_type: Column) -> Column:
    """The strength of a policy, at least that which the entity type allows."""
    strength = F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair))
    least = F.create_map(*(F.lit(x) for kind, name in FLOOR.items() for x in (kind, STRENGTH[name])))
    return F.greatest(F.coalesce(strength[policy], F.lit(0)), F.coalesce(least[entity_type], F.lit(0)))


def _settled(rows: pa.Array) -> pa.Array:
    return hit_lists([resolved([Hit(**h) for h in hits or ()]) for hits in rows.to_pylist()])


def open_bins(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __bin: the bins out of which or into which a span reaches. The islands of all others lie in them whole."""
    tops = spans.groupBy(*keys, "__bin").agg(F.max("end").alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    reached = tops.withColumn("__carried", F.max("__top").over(before))
    return reached.where((F.col("__top") > (F.col("__bin") + 1) * WIDTH) | (F.col("__carried") > F.col("__bin") * WIDTH)).select(*keys, "__bin")


def _taken(ranked: Column) -> Column:
    """``scan.resolved`` as an expression, for a few hits that all have a length and none of which is an alias: best first, a
    hit that overlaps one already taken goes."""
    hit = lambda r: r["hit"]
    meets = lambda x: lambda y: (hit(y)["start"] < hit(x)["end"]) & (hit(x)["start"] < hit(y)["end"])
    best = F.sort_array(ranked)
    taken = F.aggregate(best, F.slice(best, 1, 0), lambda told, x: F.when(F.exists(told, meets(x)), told).otherwise(F.concat(told, F.array(x))))
    names = F.array(*(F.lit(name) for name in STRENGTH))
    cells = lambda r: {f: hit(r)[f] for f in Hit._fields} | {"policy": names[-r["safety"]]}
    return F.transform(taken, lambda r: F.struct(*(c.alias(f) for f, c in cells(r).items())))


def resolve_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The hits of a detections table that win (see ``scan.resolved``): hits of different islands don't meet. Of hits on one
    span the best alone can win, so that it alone is settled. A bin out of which and into which no span reaches is settled by
    itself, after one shuffle by bins; the others island by island. What meets in one row is the spans of a bin or an island,
    the latter a stretch of text that is covered without a gap. Null scores, priorities and places in the order of rules count
    as 0. ``rows`` are looked through once when this is called, to tell whether any span leaves its bin."""
    if "normalized" not in rows.columns:
        rows = rows.withColumn("normalized", F.col("value"))
    known = {"score": F.coalesce("score", F.lit(0.0)), "priority": F.coalesce("priority", F.lit(0)), "ord": F.coalesce("ord", F.lit(0))}
    bin_of = F.floor(F.col("start") / WIDTH)
    spans = _spans(rows).select(*keys, F.col("start").cast("int"), F.col("end").cast("int")).withColumn("__bin", bin_of)
    hits = _spans(rows).withColumns(known).select(*keys, F.struct(*Hit._fields).cast(HIT).alias("__hit")).withColumn("__bin", F.floor(F.col("__hit.start") / WIDTH))
    if not spans.agg(F.max((F.col("end") > (F.col("__bin") + 1) * WIDTH).cast("int"))).first()[0]:
        return _by_bins(hits, keys)
    opened, by = open_bins(spans, keys), [*keys, "__bin"]
    return _by_bins(_beside(hits, opened, by, "left_anti"), keys).unionByName(_by_islands(_beside(hits, opened, by, "left_semi"), keys))


def _best(hits: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end, __ranked: of the hits on each span the best alone, of a span of no length and an alias as often as it
    was there; spans of no length take nothing from each other."""
    h = F.col("__hit")
    # as scan.resolved puts them, but for the length, which comes before the score and is that of all hits on a span
    rank = {"safety": -safety(h["policy"], h["entity_type"]), "priority": -h["priority"], "length": h["start"] - h["end"], "score": -h["score"], "start": h["start"], "end": h["end"], "ord": h["ord"], "hit": h}
    alias = F.coalesce(h["entity_type"] == ALIAS_TYPE, F.lit(False))
    empty = F.when(h["start"] >= h["end"], h)
    spans = hits.groupBy(*by, h["start"].alias("start"), h["end"].alias("end"), alias.alias("__alias"), empty.alias("__empty"))
    best = spans.agg(F.min(F.struct(*(c.alias(n) for n, c in rank.items()))).alias("__best"), F.count(F.lit(1)).alias("__n"))
    times = F.when(F.col("__empty").isNotNull(), F.col("__n")).otherwise(F.lit(1)).cast("int")
    return best.select(*by, "start", "end", (F.col("__alias") | F.col("__empty").isNotNull() | (F.col("start") < 0)).alias("__odd"), F.array_repeat("__best", times).alias("__ranked"))


def _by_bins(hits: DataFrame, keys: list[str]) -> DataFrame:
    by = [*keys, "__bin"]
    met = _best(hits.repartition(*(F.col(f"`{k}`") for k in by)), by).groupBy(*by).agg(F.flatten(F.collect_list("__ranked")).alias("__ranked"), F.max("__odd").alias("__odd"))
    few = ~F.col("__odd") & (F.size("__ranked") <= FEW)
    others = F.arrow_udf(_settled, f"array<{HIT}>")(F.when(~few, F.col("__ranked.hit")))
    return met.select(*keys, F.inline(F.when(few, _taken(F.col("__ranked"))).otherwise(others)))


def _by_islands(hits: DataFrame, keys: list[str]) -> DataFrame:
    islanded = islands(_best(hits, keys), keys, "__island")
    met = islanded.groupBy(*keys, "__island").agg(F.flatten(F.collect_list("__ranked.hit")).alias("__hits"))
    return met.select(*keys, F.inline(F.arrow_udf(_settled, f"array<{HIT}>")("__hits")))
