"""Interval overlap join by a global range partition, a boundary scan and local sweeps.

``overlaps`` holds the intervals of two tables that share a key against each other and counts, for each left interval and
relation, its partners; no row for a pair is ever made. Equal intervals of a key are one row with a weight first, so that
a hot key is as large as its different intervals. These are range-partitioned by (key, start): a hot key is spread over as
many partitions as it needs, and equal starts stay together. What is still active at a partition's border has to meet the
key's intervals beyond it. A partition tells, for the one key that can go on, the ends of its intervals with weights; the
boundary scan adds these up over partitions by (key, end) with a shuffle, and gives every later partition of the key those
that reach its first start, whose number doesn't depend on how many rows have an end. Starts needn't be carried: against
anything that starts later they play no part. Each partition then sweeps its own intervals and those carried in; what a
carried left end finds is added to all left intervals with that end from earlier partitions, and sums are merged.

``sessions`` cuts the clicks of a key into sessions the same way: clicks of a key within one gap-long bucket are one row
first; partitions of (key, time) cut what they hold; a partition's first and last session, two rows, are merged by key.

Defined cases: null keys and starts: no interval; a null sale_id is kept as one; rows that share a sale_id add up; a sale
without partners has no row; an end before its start counts as the start; empty tables give an empty result; further columns
are not read. Timestamps without a zone are taken as they are, those with one as UTC.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

GAP_US, SLOT_US = 30 * 60 * 1_000_000, 6 * 3600 * 1_000_000
#: An end that no interval outlasts; equal to itself.
OPEN = 1 << 40
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
OVERLAPS, FINISHED_BY, CONTAINS, STARTS, EQUALS, STARTED_BY, DURING, FINISHES, OVERLAPPED_BY = range(9)
#: Kinds of rows: intervals of either side, ends of either side that a partition hands on, a partition's first start.
LEFT, RIGHT, LEFT_END, RIGHT_END, FIRST = range(5)
PART = "part int, kind int, key long, start long, end long, n long, crc long"


def micros(c: Column, kind: str) -> Column:
    """Whole microseconds since 1970 of a timestamp with or without a zone."""
    if kind == "timestamp_ntz":
        return ((c - F.lit("1970-01-01").cast("timestamp_ntz")).cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def us(df: DataFrame, name: str) -> Column:
    return micros(df[name], dict(df.dtypes)[name])


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _cut(gap: int):
    """Sessions of a partition of buckets sorted by (key, lo); the first and the last are marked."""
    names = ["edge", "key", "lo", "hi", "failed"]

    def made(rows: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(edge), *(pa.array(c) for c in rows)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        first = True
        for batch in (b for b in batches if b.num_rows):
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names[1:]]
            key, lo, hi, failed = own if held is None else [np.concatenate([h, o]) for h, o in zip(held, own, strict=True)]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] - hi[:-1] > gap)]))
            last = np.concatenate([at[1:], [len(key)]]) - 1
            done = [key[at], lo[at], hi[last], failed[last]]
            held = [c[-1:] for c in done]
            if len(at) > 1:
                edge = np.zeros(len(at) - 1, bool)
                edge[0], first = first, False
                yield made([c[:-1] for c in done], edge)
        if held is not None:
            yield made(held, np.ones(1, bool))

    return run


def sessions(clicks: DataFrame, scratch: Scratch, *, gap: int = GAP_US) -> DataFrame:
    """(key, lo, hi, failed) of the sessions of ``clicks`` (key long, ts in microseconds, failed boolean), without nulls in
    key and ts. ``failed``: a click at the session's last time is."""
    bucket = clicks.groupBy("key", F.floor(F.col("ts") / gap).alias("bucket")).agg(F.min("ts").alias("lo"), F.max(F.struct("ts", "failed")).alias("last"))
    rows = bucket.select("key", "lo", F.col("last.ts").alias("hi"), F.col("last.failed").alias("failed"))
    dealt = rows.repartitionByRange(_width(scratch.spark), "key", "lo").sortWithinPartitions("key", "lo")
    found = scratch.save_narrow(dealt.mapInArrow(_cut(gap), "edge boolean, key long, lo long, hi long, failed boolean"), "sessions")
    over = Window.partitionBy("key").orderBy("lo", "hi")  # at most two rows of a partition, whatever its size
    edges = found.where("edge").withColumn("new", F.coalesce((F.col("lo") - F.lag("hi").over(over) > gap).cast("int"), F.lit(1)))
    edges = edges.withColumn("session", F.sum("new").over(over)).groupBy("key", "session").agg(F.min("lo").alias("lo"), F.max(F.struct("hi", "failed")).alias("last"))
    return found.where("not edge").drop("edge").unionByName(edges.select("key", "lo", F.col("last.hi").alias("hi"), F.col("last.failed").alias("failed")))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition sorted by (key, start), its first row again, and for its last key the ends of either side."""
    names = ("part", "kind", "key", "start", "end", "n", "crc")
    first: tuple | None = None
    last, ends = None, [{}, {}]
    for batch in (b for b in batches if b.num_rows):
        yield pa.RecordBatch.from_arrays(batch.columns, names=names)  # without the marks of columns that hold no null
        part, kind, key, start, end, n, crc = (batch.column(c).to_numpy() for c in names)
        first = first or (int(part[0]), FIRST, int(key[0]), int(start[0]), 0, 0, 0)
        if key[-1] != last:
            last, ends = int(key[-1]), [{}, {}]
        own = np.flatnonzero(key == last)
        for side, e, x, y in zip(kind[own].tolist(), end[own].tolist(), n[own].tolist(), crc[own].tolist(), strict=True):
            so_far = ends[side].get(e, (0, 0))
            ends[side][e] = (so_far[0] + x, so_far[1] + y)
    if first is not None:
        more = [first, *((first[0], LEFT_END + side, last, 0, e, *sums) for side in (LEFT, RIGHT) for e, sums in ends[side].items())]
        yield _rows(more, names)


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    """Columns of longs, the first two of them ints."""
    columns = [[r[i] for r in rows] for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.int64()) for i, c in enumerate(columns)], names=list(names))


Four = tuple[int, int, int, int]


def add(x: Four, y: Four) -> Four:
    return x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3]


def less(x: Four, y: Four) -> Four:
    return x[0] - y[0], x[1] - y[1], x[2] - y[2], x[3] - y[3]


NONE: Four = (0, 0, 0, 0)


class ByEnd:
    """Sums (rows, crc, ends, starts) of right intervals in the order of their ends."""

    def __init__(self, rows: dict[int, Four]):
        self.ends = sorted(rows)
        self.sums = [NONE, *accumulate((rows[e] for e in self.ends), add)]

    def below(self, end: int) -> Four:
        return self.sums[bisect_left(self.ends, end)]

    def split(self, end: int) -> tuple[Four, Four, Four]:
        """Sums of those that end before, at and after ``end``."""
        if not self.ends:
            return NONE, NONE, NONE
        low, high = self.sums[bisect_left(self.ends, end)], self.sums[bisect_right(self.ends, end)]
        return low, less(high, low), less(self.sums[-1], high)


def by_end(rows: list[tuple[int, int, int, int]]) -> dict[int, Four]:
    out: dict[int, Four] = {}
    for start, end, n, crc in rows:
        out[end] = add(out.get(end, NONE), (n, crc, n * end, n * start))
    return out


def sweep(left: list[tuple[int, int]], right: list[tuple[int, int, int, int]], carried: list[tuple[int, int, int, int]], left_ends: list[int]) -> Iterator[tuple]:
    """What the intervals of one key in one partition find: (start, end, relation, rows, shared slots, crc) for each left one,
    with start None for the ends of those that are carried in. ``right`` and ``carried`` are (start, end, rows, crc)."""
    if not right and not carried:
        return
    right.sort()
    starts = [r[0] for r in right]
    started = [NONE, *accumulate(((n, crc, n * b, n * a) for a, b, n, crc in right), add)]
    whole = ByEnd(by_end(right))

    def later(end: int, since: int, contains: Four, same: Four) -> Iterator[tuple]:
        """Of right intervals that start later, those from the place ``since``: ``contains`` end before ``end``, ``same`` with it."""
        rest = less(less(less(started[bisect_right(starts, end)], started[since]), contains), same)
        if contains[0]:
            yield end, CONTAINS, contains[0], contains[2] - contains[3] + contains[0], contains[1]
        if same[0]:
            yield end, FINISHED_BY, same[0], None if end == OPEN else same[0] * (end + 1) - same[3], same[1]
        if rest[0]:
            yield end, OVERLAPS, rest[0], rest[0] * (end + 1) - rest[3], rest[1]

    for end in left_ends:
        below, same, _ = whole.split(end)
        for found in later(end, 0, below, same):
            yield None, *found
    earlier: dict[int, Four] = {}
    at = 0
    before = by_end(carried)
    for start, ends in groupby(sorted(left), itemgetter(0)):
        while at < len(right) and starts[at] < start:
            for end, sums in by_end(right[at : at + 1]).items():
                earlier[end] = add(earlier.get(end, NONE), sums)
            at += 1
        since = bisect_right(starts, start)
        earlier = {e: sums for e, sums in earlier.items() if e >= start}
        own, here, handed = ByEnd(earlier), ByEnd(by_end(right[at:since])), ByEnd({e: sums for e, sums in before.items() if e >= start} if before else {})
        ended = whole.below(start)
        for _, end in ends:
            below, same, _ = whole.split(end)
            low, level, high = own.split(end)
            low_here, level_here, high_here = here.split(end)
            contains = less(less(less(below, ended), low), low_here)
            for found in later(end, since, contains, less(less(same, level), level_here)):
                yield start, *found
            low_handed, level_handed, high_handed = handed.split(end)
            for (b, s, a), names in (((low_here, level_here, high_here), (STARTED_BY, EQUALS, STARTS)), ((add(low, low_handed), add(level, level_handed), add(high, high_handed)), (OVERLAPPED_BY, FINISHES, DURING))):
                if b[0]:
                    yield start, end, names[0], b[0], b[2] - b[0] * (start - 1), b[1]
                if s[0]:
                    yield start, end, names[1], s[0], None if end == OPEN else s[0] * (end - start + 1), s[1]
                if a[0]:
                    yield start, end, names[2], a[0], a[0] * (end - start + 1), a[1]


SWEPT = ("part", "relation", "key", "start", "end", "n", "slots", "crc")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep a partition sorted by key, key by key."""
    out: list[tuple] = []
    columns = ("part", "key", "kind", "start", "end", "n", "crc")
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    for (part, key), own in groupby(rows, itemgetter(0, 1)):
        left, right, carried, left_ends = [], [], [], []
        for _, _, kind, start, end, n, crc in own:
            if kind == LEFT:
                left.append((start, end))
            elif kind == LEFT_END:
                left_ends.append(end)
            else:
                (right if kind == RIGHT else carried).append((start, end, n, crc))
        for start, end, relation, n, slots, crc in sweep(left, right, carried, left_ends):
            out.append((part, relation, key, start, end, n, slots, crc))
        if len(out) >= 50_000:
            yield _rows(out, SWEPT)
            out = []
    if out:
        yield _rows(out, SWEPT)


def overlaps(left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, start, end, relation, n, slots, crc) for the different intervals of ``left`` (key, start, end) and the relations
    in which they share a slot with intervals of ``right`` (key, start, end, crc): partners, shared slots, sum of crc. Ends
    are inclusive, ``OPEN`` at most."""
    own = left.groupBy("key", "start", "end").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("crc"))
    other = right.groupBy("key", "start", "end").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc"))
    rows = own.withColumn("kind", F.lit(LEFT)).unionByName(other.withColumn("kind", F.lit(RIGHT)))
    width = _width(scratch.spark)
    dealt = rows.repartitionByRange(width, "key", "start").sortWithinPartitions("key", "start").withColumn("part", F.spark_partition_id())
    marked = scratch.save_narrow(dealt.select("part", "kind", "key", "start", "end", "n", "crc").mapInArrow(_mark, PART), "marked")
    # the boundary scan: what earlier partitions of a key hand to each later one
    first = marked.where(f"kind = {FIRST}").select("key", F.col("part").alias("to"), F.col("start").alias("from"))
    ends = marked.where(f"kind in ({LEFT_END}, {RIGHT_END})").groupBy("key", "kind", "end").agg(F.collect_list(F.struct("part", "n", "crc")).alias("each"))
    ends = ends.withColumn("since", F.array_min("each.part")).join(first.groupBy("key").agg(F.max("to").alias("until")), "key").where("since < until")
    to = ends.select("*", F.explode(F.expr("sequence(since + 1, until)")).alias("to")).join(first.select("to", "from"), "to").where("from <= end")
    earlier = F.filter("each", lambda x: x["part"] < F.col("to"))
    total = lambda c: F.aggregate(earlier, F.lit(0).cast("long"), lambda so_far, x: so_far + x[c])
    carried = to.select(F.col("to").alias("part"), "kind", "key", F.lit(0).cast("long").alias("start"), "end", total("n").alias("n"), total("crc").alias("crc"))
    together = marked.where(f"kind in ({LEFT}, {RIGHT})").unionByName(carried)
    swept = together.repartitionById(width, F.col("part")).sortWithinPartitions("key")
    swept = scratch.save_narrow(swept.mapInArrow(_sweep, "part int, relation int, key long, start long, end long, n long, slots long, crc long"), "swept")
    beyond = swept.where("start is null").select("key", "end", F.col("part").alias("to"), "relation", "n", "slots", "crc")
    mine = marked.where(f"kind = {LEFT}").select("key", "start", "end", "part").join(beyond, ["key", "end"]).where("part < to")
    every = swept.where("start is not null").drop("part").unionByName(mine.drop("part", "to"))
    return every.groupBy("key", "start", "end", "relation").agg(*[F.sum(c).alias(c) for c in ("n", "slots", "crc")])


def slot(us: str, width: int = SLOT_US) -> Column:
    return F.expr(f"({us} - pmod({us}, {width}L)) div {width}L")


def sales_in_sessions(spark: SparkSession, clicks: DataFrame, sales: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per sale and relation to click sessions of its client: sale_id, relation, n_pairs, overlap_slots, sessions_crc."""
    scratch = Scratch(spark, "overlap-join")
    seen = clicks.select(clicks["client_id"].cast("long").alias("key"), us(clicks, "ts").alias("ts"), F.coalesce(clicks["kind"] == "error", F.lit(False)).alias("failed"))
    cut = sessions(seen.where("key is not null and ts is not null"), scratch)
    right = cut.select("key", slot("lo").alias("start"), F.when(F.col("failed"), OPEN).otherwise(slot("hi")).alias("end"), F.crc32(F.col("lo").cast("string")).alias("crc"))
    shipped = lines.select(lines["sale_id"].alias("line_of"), us(lines, "shipped_at").alias("shipped")).where("line_of is not null and shipped is not null").groupBy("line_of").agg(F.max("shipped").alias("shipped"))
    sold = sales.select("sale_id", sales["client_id"].cast("long").alias("key"), us(sales, "sold_at").alias("sold"), F.coalesce(sales["status"] == "open", F.lit(False)).alias("open"))
    sold = sold.where("key is not null and sold is not null").join(shipped, F.col("sale_id") == F.col("line_of"), "left")
    last = sold.select("*", F.greatest("sold", "shipped").alias("last"))
    left = scratch.save_narrow(last.select("sale_id", "key", slot("sold").alias("start"), F.when(F.col("open"), OPEN).otherwise(slot("last")).alias("end")), "sales")
    found = scratch.save_narrow(overlaps(left.drop("sale_id"), right, scratch), "found")
    name = F.array(*[F.lit(r) for r in RELATIONS])[F.col("relation")]
    return left.join(found, ["key", "start", "end"]).select(
        "sale_id", name.alias("relation"), F.col("n").alias("n_pairs"), F.col("slots").alias("overlap_slots"), F.col("crc").alias("sessions_crc")
    )


def op12_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_in_sessions(spark, *(table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines")))


#: DuckDB has no crc32, so it is taken bit by bit: 13 to 16 digits, a list of their codes folded through the reflected polynomial.
ORACLE_SQL = f"""
WITH c AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS failed FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= {GAP_US} THEN 0 ELSE 1 END AS new FROM c),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS session FROM marked),
s AS MATERIALIZED (
  SELECT client_id, min(us) AS lo, max(us) AS hi, max(struct_pack(us := us, failed := failed)).failed AS open FROM (SELECT client_id, session, us, bool_or(failed) AS failed FROM numbered GROUP BY ALL) GROUP BY client_id, session),
t AS MATERIALIZED (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) AS v FROM range(256) AS r(i)),
u AS (SELECT list(v ORDER BY i) AS table_ FROM t),
r AS MATERIALIZED (
  SELECT client_id, lo // {SLOT_US} AS a, CASE WHEN open THEN {OPEN} ELSE hi // {SLOT_US} END AS b,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(lo::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda x, y: xor(table_[(xor(x, y) & 255) + 1], x >> 8)), 4294967295::BIGINT)::HUGEINT AS crc
  FROM s, u),
l AS (
  SELECT sale_id, epoch_us(sold_at) // {SLOT_US} AS s, client_id, status,
    epoch_us(greatest(sold_at, (SELECT max(shipped_at) FROM sale_lines AS x WHERE x.sale_id = sales.sale_id))) // {SLOT_US} AS last
  FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, s, CASE WHEN status = 'open' THEN {OPEN} ELSE last END AS e, r.* FROM l JOIN r USING (client_id)),
q AS (
  SELECT *, CASE WHEN s < a THEN CASE WHEN e < b THEN 'overlaps' WHEN e = b THEN 'finished_by' ELSE 'contains' END
    WHEN s = a THEN CASE WHEN e < b THEN 'starts' WHEN e = b THEN 'equals' ELSE 'started_by' END
    ELSE CASE WHEN e < b THEN 'during' WHEN e = b THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
    CASE WHEN e < {OPEN} OR b < {OPEN} THEN least(e, b) - greatest(s, a) + 1 END AS shared
  FROM p WHERE s <= b AND a <= e)
SELECT sale_id, relation, count(*) AS n_pairs, sum(shared)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM q GROUP BY sale_id, s, e, relation
"""
