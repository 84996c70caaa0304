"""MinHash near-dedup with SuperMinHash signatures.

Each element of a shingle set runs through one random permutation of the signature's slots: in step j it puts
``j + r`` into slot ``p[j]``. The ranks of one element are correlated, which lowers the variance, and the steps end as
soon as every slot holds a value below the step. Bands of slots give buckets; links between texts of a bucket are
confirmed on full shingle sets; union-find and star steps make groups.

Documents with equal sets form a class; only the class's smallest id goes on, so copies cost nothing. In a bucket all
members are compared with the smallest one (a star, linear in the bucket). Only pairs of one bucket which the stars
leave in different groups are compared as well, in large buckets block by block without making rows of pairs; so no
bucket is expanded to all pairs, and no link that could join two groups is skipped. Before sets are shipped, the share of equal slots drops pairs that are
0.2 below the threshold (a link lost this way has a chance below 1e-8).

Defined cases: null and empty text: empty set, linked with nothing; fewer words than a shingle: the whole sequence is
the one shingle; a null id: linked with nothing, kept, component null; rows that share an id are one node; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP, Scratch, hashed_words, in_chunks, mixed, table, window_hashes
from .components import connected_components

#: 30 bands of 6 slots find a pair of similarity 0.85 with chance 1 - 7e-7, one of 0.8 with 1 - 1e-4.
BANDS, ROWS = 30, 6
SLACK = 0.2
#: Buckets of up to FEW members are expanded to pairs, larger ones compared in blocks of two chunks.
FEW, CHUNK = 40, 256


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of the distinct shingles of its ASCII-lower-cased words."""
    for first, last in in_chunks(texts):
        h, at = hashed_words(texts[first:last], fold=True)
        every = window_hashes(h, size)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            if n >= size:
                yield np.unique(every[a : b - size + 1])
            else:  # the whole sequence, told apart from longer shingles by its length
                yield mixed(window_hashes(h[a:b], n) ^ np.uint64(n)) if n else np.empty(0, np.uint64)


def superminhash(x: np.ndarray, slots: int) -> np.ndarray:
    """Signature of a non-empty array of distinct 64-bit hashes."""
    sig = np.full(slots, np.inf)
    n, turn = len(x), None
    for j in range(slots):
        bits = mixed(x + np.uint64((j + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF))
        rank = (bits >> np.uint64(24)).astype(np.float64) * 2.0**-40 + j
        to = ((bits & np.uint64(0xFFFFFF)) % np.uint64(slots - j)).astype(np.int64) + j
        if j == 0:
            np.minimum.at(sig, to, rank)
            first = to
        else:
            if turn is None:
                every = np.arange(n)
                turn = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
                turn[every, first], turn[:, 0] = 0, first
            here = turn[every, to]
            turn[every, to], turn[:, j] = turn[:, j], here
            np.minimum.at(sig, here.astype(np.int64), rank)
        if sig.max() < j + 1:
            break
    return sig


def _sketch(size: int, bands: int, rows: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
    salt = np.arange(1, bands + 1, dtype=np.uint64) * STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for x in shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], size):
                if not len(x):
                    row = (0, None, None, None)
                else:
                    sig = superminhash(x, bands * rows)
                    slots = sig.view(np.uint64).reshape(bands, rows)
                    key = salt
                    for i in range(rows):
                        key = mixed(key + slots[:, i])
                    small = (mixed(sig.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
                    row = (len(x), xxhash.xxh3_128_digest(x.tobytes()), key.view(np.int64), small.tobytes())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], size))
            keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            right = pa.compute.equal(keys, batch.column("key"))  # of rows that share an id, the one that is meant
            full = pa.RecordBatch.from_arrays([batch.column("id"), keys, pa.array([x.tobytes() for x in sets], pa.binary())], schema=schema)
            yield full.filter(right)

    return run


def _close(percent: int, bands: int, rows: int):
    least = int(bands * rows * max(0.0, percent / 100 - SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column("sig_a").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            b = np.frombuffer(b"".join(batch.column("sig_b").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _linked(percent: int):
    """Rows (a, b, set) sorted so that the set of ``a`` itself (b is null) comes before those that are held against it;
    rows that share the id ``a`` have a set each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: list[np.ndarray] = []
        begun = False
        for batch in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            keep = []
            for b, blob in zip(batch.column("b").to_pylist(), batch.column("set").to_pylist(), strict=True):
                own = np.frombuffer(blob, np.uint64)
                if b is None:
                    centres = [*centres, own.copy()] if begun else [own.copy()]
                    keep.append(False)
                else:
                    both = [(len(np.intersect1d(x, own, assume_unique=True)), len(x) + len(own)) for x in centres]
                    keep.append(any(100 * n >= percent * (total - n) for n, total in both))
                begun = b is None
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forest(percent: int, bands: int, rows: int):
    """Links between the groups of one block of a large bucket: at most one a member, a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = int(bands * rows * max(0.0, percent / 100 - SLACK))

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        bucket, own = table.column("bucket")[0].as_py(), table.column("chunk").to_numpy()
        ids, groups = table.column("id").to_pylist(), table.column("group").to_pylist()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        keys = np.array(table.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        band = int(np.flatnonzero((keys == bucket).all(axis=0))[0])
        parent: dict[int, int] = {}

        def root(g: int) -> int:
            while (up := parent.get(g, g)) != g:
                g = up
            return g

        found = []
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for x in left.tolist():
            others = right if i != j else right[right > x]
            # a pair that an earlier band brings together is compared there
            fresh = others[~(keys[others, :band] == keys[x, :band]).any(axis=1)]
            for y in fresh[(sigs[fresh] == sigs[x]).sum(axis=1) >= least].tolist():
                p, q = root(groups[x]), root(groups[y])
                if p == q:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    parent[max(p, q)] = min(p, q)
                    found.append((ids[x], ids[y]))
        return pa.Table.from_arrays([pa.array([k[c] for k in found], pa.int64()) for c in (0, 1)], schema=schema)

    return run


def full_sets(wanted: DataFrame, reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, key, set) of the classes whose ids are wanted."""
    return docs.join(wanted.distinct().join(reps.select("id", "key"), "id"), "id").mapInArrow(_sets(size), "id long, key binary, set binary")


def in_blocks(lone: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, percent: int, size: int, bands: int, rows: int) -> DataFrame:
    """Links between groups in large buckets. The members of a bucket are dealt to chunks of about CHUNK, and each pair of
    chunks is compared in a task of its own, which holds two chunks and returns links alone."""
    full = scratch.keep(full_sets(lone.select("id"), reps, docs, size).join(reps.select("id", "key", "sig", "bands"), ["id", "key"]))
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    own = lone.select("bucket", "id", "group", chunks.alias("chunks"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("bucket", "id", "group", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    # of rows that share an id, those that are in the bucket
    here = dealt.join(full, "id").where(F.array_contains("bands", F.col("bucket")))
    return scratch.save_narrow(here.groupBy("bucket", "i", "j").applyInArrow(_forest(percent, bands, rows), "a long, b long"), "block-links")


def links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, percent: int, size: int, bands: int, rows: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose full sets reach the threshold.

    The partners of a representative are dealt to as many parts as there are shuffle partitions, and its set goes once to
    each part that has any, so neither a copy of it for every pair nor one task for all its partners is made."""
    own = lambda x: reps.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    alike = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = pairs.join(own("a"), "a").join(own("b"), "b").where(alike).select("a", "b", "sig_a", "sig_b").mapInArrow(_close(percent, bands, rows), "a long, b long")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    near = scratch.keep(near.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")))
    sets = scratch.keep(full_sets(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))), reps, docs, size).drop("key"))
    centres = near.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")
    members = near.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "set")
    dealt = centres.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = scratch.save_narrow(dealt.select("a", "b", "set").mapInArrow(_linked(percent), "a long, b long"), "links")
    scratch.let_go(near, sets)
    scratch.release()
    return found


def near_dedup(
    spark: SparkSession, docs: DataFrame, *, percent: int = 80, size: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sketch = scratch.save(texts.mapInArrow(_sketch(size, bands, rows), "id long, n long, key binary, bands array<long>, sig binary"), "sketch")
    known = sketch.where("id is not null and n > 0")
    # all else of a row follows from its key, so the first of a class stands for it
    reps = scratch.save_narrow(known.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    # ids of rows with different texts tie their classes together
    twice = known.groupBy("id").agg(F.min("key").alias("k"), F.max("key").alias("l")).where("k <> l").select("id")
    tied = known.select("id", "key").join(twice, "id").join(reps.select(F.col("id").alias("rep"), "key"), "key").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    exploded = reps.select("id", F.explode("bands").alias("bucket"))
    centre = exploded.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
    bucket = scratch.save_narrow(exploded.join(centre.select("bucket", "a"), "bucket"), "buckets")
    stars = scratch.keep(bucket.where("id <> a").select("a", F.col("id").alias("b")).distinct())
    args = (reps, texts, scratch, percent, size, bands, rows)
    edges = tied.unionByName(links(stars, *args).toDF("u", "v"))
    groups = connected_components(edges, scratch)
    scratch.release()
    # pairs of a bucket that the stars left apart
    lone = bucket.join(groups, bucket["id"] == groups["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("group"))
    split = lone.groupBy("bucket").agg(F.min("group").alias("g"), F.max("group").alias("h"), F.count(F.lit(1)).alias("members")).where("g <> h").select("bucket", "members")
    lone = scratch.save_narrow(lone.join(split, "bucket"), "apart")
    few = lone.where(f"members <= {FEW}")
    x, y = few.alias("x"), few.alias("y")
    apart = (
        x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.group") != F.col("y.group")))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .join(stars, ["a", "b"], "left_anti")
        .distinct()
    )
    more = links(apart, *args)
    many = lone.where(f"members > {FEW}")
    if not many.isEmpty():
        more = more.unionByName(in_blocks(many, reps, texts, scratch, percent, size, bands, rows))
    if not more.isEmpty():
        edges = groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.toDF("u", "v"))
        groups = connected_components(edges, scratch)
    classes = reps.select("key", "id").join(groups, reps["id"] == groups["node"], "left").select("key", F.coalesce("component", "id").alias("component"))
    classes = scratch.save_narrow(classes, "components")
    scratch.let_go()
    alone = sketch.where("id is null or n = 0").select("id", "n", F.col("id").alias("component"))
    out = sketch.where("id is not null and n > 0").select("id", "n", "key").join(classes, "key").select("id", "n", "component").unionByName(alone)
    kept = F.coalesce(F.col("component") == F.col("id"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all columns."""
    gone = near_dedup(spark, docs, id_col=id_col, **options).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, table(spark, sf_dir, "documents"), percent=85)
