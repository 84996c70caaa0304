"""Vector code compression: product quantisation in integers, screened by float32 matrix products.

A component x becomes the integer floor(scale * x); a vector is cut into equal consecutive parts, and each part position
has a codebook, at first that part of the vectors with the smallest ids. A round assigns every part to its nearest entry
and replaces each entry by the floored mean of its parts. Distances are screened in float32: |c|^2 - 2 x.c for all parts
and entries comes from one matrix product a part position, with an interval around it that no rounding can leave. Entries
whose intervals overlap the best one's are evaluated again in int64 (in Python's integers where these could overflow), and
the smallest exact distance with the lowest index wins; so the codes are exact, whatever order the product sums in.

Tasks return sums and counts for each entry and component, which Spark adds up; only codebooks (parts x entries x
components, whatever the number of vectors) go to the driver and back to the tasks with the next round's function.

Defined cases: rows are dropped whose vector is null, empty, holds a null or a value that isn't finite, has a length that
isn't a multiple of ``parts``, another length than the smallest kept id's, or an integer of 2**62 or more; an error beyond
2**63 - 1 is null, and so is a sum with or beyond it; fewer vectors than ``entries`` make a smaller codebook; rows that share an id are told apart by their vectors in the first codebook, and each has its own code;
null ids come last there; null labels count as one label; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_each, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Unit roundoff of float32; components at most so large have distances that fit int64 (over sqrt(length)); a vector with a
#: larger one than LARGEST counts as broken.
UNIT, WIDE, LARGEST = 2.0**-24, 1 << 30, 2.0**62


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of integer rows; Python's integers where int64 might overflow."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= WIDE // max(1, int(sqrt(x.shape[-1]))):
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=-1)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of ``book`` for each integer row of ``x``, the lower of equals."""
    n, d = x.shape
    x32, c32 = x.astype(np.float32), book.astype(np.float32)
    norms = (book.astype(np.float64) ** 2).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        score = norms - 2.0 * (x32 @ c32.T).astype(np.float64)
    # |fl(x.c) - x.c| <= (gamma_d + two roundings to float32) sum |x_i c_i|, and that sum is at most |x||c|; the norms and
    # this bound are float64, and the factor 1.01 covers their own roundings
    long = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    gamma = (d + 2) * UNIT / (1 - (d + 2) * UNIT)
    radius = 1.01 * (2 * gamma * long[:, None] * np.sqrt(norms)[None, :] + 2.0**-48 * (norms[None, :] + long[:, None] ** 2)) + 2.0**-120
    lost = ~np.isfinite(score)  # overflowed: nothing is known
    score[lost], radius[lost] = 0.0, np.inf
    close = score - radius <= (score + radius).min(axis=1)[:, None]
    best = close.argmax(axis=1)
    rows = np.flatnonzero(close.sum(axis=1) > 1)
    if len(rows):
        at, entry = np.nonzero(close[rows])
        far = exact(x[rows[at]], book[entry])
        # the first of the smallest of each row: pairs are sorted by row and entry, and lexsort keeps the order of equals
        order = np.lexsort((far, at)) if far.dtype != object else np.array(sorted(range(len(at)), key=lambda k: (at[k], far[k])), np.int64)
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        best[rows] = entry[order[first]]
    return best


def _integers(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column("ints").to_pylist()), np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def _floored(parts: int, scale: int):
    """Rows with the integers of their vectors; broken vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(length)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # nulls are nan
            broken = ~(np.abs(whole) < LARGEST)
            so_far = np.concatenate([[0], np.cumsum(broken)])
            keep = np.flatnonzero((length > 0) & (length % parts == 0) & (so_far[end] == so_far[end - length]))
            ints = np.where(broken, 0, whole).astype(np.int64)
            taken = batch.select(["vec_id", "label"]).take(pa.array(keep))
            blobs = [ints[end[i] - length[i] : end[i]].tobytes() for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(blobs, pa.binary())], names=["vec_id", "label", "ints"])

    return run


def _sums(books: np.ndarray):
    """(part, entry, position, high, low, rows) of a task's vectors: totals of the upper and lower 32 bits, which fit int64."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, rows = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in (b for b in batches if b.num_rows):
            x = _integers(batch, parts)
            for p in range(parts):
                code = nearest(x[:, p], books[p])
                np.add.at(high[p], code, x[:, p] >> 32)
                np.add.at(low[p], code, x[:, p] & 0xFFFFFFFF)
                rows[p] += np.bincount(code, minlength=entries)
        columns = [*np.indices(books.shape).reshape(3, -1), high.ravel(), low.ravel(), np.repeat(rows.ravel(), width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "position", "high", "low", "rows"])

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x = _integers(batch, len(books))
            code = np.stack([nearest(x[:, p], books[p]) for p in range(len(books))], axis=1)
            error = sum(exact(x[:, p], books[p][code[:, p]]) for p in range(len(books)))
            texts = ["".join(f"{k:02x}" for k in row) for row in code.tolist()]
            error = [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def fit(kept: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) of the integer vectors ``kept``; only codebooks and their sums are collected."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    if not first:
        return np.empty((parts, 0, 0), np.int64)
    books = np.stack([np.frombuffer(r.ints, np.int64).reshape(parts, -1) for r in first], axis=1)
    for _ in range(rounds):
        each = kept.select("ints").mapInArrow(_sums(books), "part long, entry long, position long, high long, low long, rows long")
        new = books.copy()
        sums = each.groupBy("part", "entry", "position").agg(*[F.sum(c).alias(c) for c in ("high", "low", "rows")])
        for r in sums.where("rows > 0").collect():
            new[r.part, r.entry, r.position] = ((r.high << 32) + r.low) // r.rows
        books = new
    return books


def vector_codes(
    spark: SparkSession, vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256. ``entries`` is at most 256."""
    scratch = Scratch(spark, "vector-codes")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    kinds = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("ints", T.BinaryType())])
    kept = scratch.save(rows.mapInArrow(_floored(parts, scale), kinds), "integers")
    for smallest in kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.length("ints").alias("size")).limit(1).collect():
        kept = kept.where(F.length("ints") == smallest.size)
    books = fit(kept, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shape = T.StructType([*kinds.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = scratch.save(kept.mapInArrow(_codes(books), shape), "codes")
    # a label is told from null by its first character, so that nulls have a key as well
    coded = coded.withColumn("key", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    labels = coded.groupBy("key").agg(F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error"))
    return join_each(coded, labels, "key").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark, table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as one common table expression each."""
    pairs = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    out = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, part * len(v) // {PARTS} + 1, (part + 1) * len(v) // {PARTS}) AS x FROM kept, range({PARTS}) AS r(part))",
        f"b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    near = f"SELECT p.vec_id, p.label, p.part, p.x, min(struct_pack(d := {pairs}, e := b.entry)) AS best FROM p JOIN b{{k}} AS b ON b.part = p.part GROUP BY ALL"
    for k in range(ROUNDS):
        out.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        out.append(
            f"m{k} AS MATERIALIZED (SELECT part, entry, list(floor_mean ORDER BY i) AS c FROM (SELECT part, best.e AS entry, i, "
            "(sum(x[i]) - (((sum(x[i]) % count(*)) + count(*)) % count(*))) // count(*) AS floor_mean "
            f"FROM a{k}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL)"
        )
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(list_transform(m.c, lambda x: x::BIGINT), b.c) AS c FROM b{k} AS b LEFT JOIN m{k} AS m ON m.part = b.part AND m.entry = b.entry)")
    out.append(f"z AS MATERIALIZED ({near.format(k=ROUNDS)})")
    out.append("coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', best.e::INTEGER), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM z GROUP BY vec_id, label)")
    final = f"SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}"
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, ({final}) AS codebooks_sha256 FROM coded"


ORACLE_SQL = _sql()
