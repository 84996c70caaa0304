"""Substring dedup by level-wise doubling.

Level 1 looks at windows of a fraction (window / 2, / 4, ... but not under ``LEAST`` words, unless at half) of the final
length. Not every window is sent out but, for each final window, the minimum (by hash) of the first-level windows inside
it: two equal windows of 50 words contain the same 26 windows of 25 words, so they choose the same one, and nothing that
repeats is missed while about one window in 13 is shuffled. Such an anchor survives if its words also occur in a document
of another id. Each further level takes the survivors alone and looks at windows of twice the length that begin or end
with the anchor, one of which any final window around it contains; it ends early when none survives. On the last level
the final windows around the surviving anchors are compared, and those alone count whose words start in a document with
a smaller id. Doubling ends at the window length asked for: longer repeats are unions of such windows.

A document whose whole word sequence equals that of a smaller id is settled by that: it goes as a whole (if it has a
window at all), and takes no part in the levels, since the smallest id of its class stands for it.

Defined cases: null and empty text: no words; fewer words than a window: nothing removed; a null id neither removes
nor loses words; rows that share an id don't remove each other's words; an empty table gives an empty result; further
columns are not read. The final windows are compared by two hashes of 64 bits from words hashed with different seeds;
words are hashed eight bytes at a time and windows by pairing halves, mixed after each step, so that no arrangement of equal
letters or words makes sums meet. On earlier levels a collision only costs work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hashed_words, in_chunks, table, window_hashes

WINDOW, LEAST = 50, 25
#: Seed of the second hash.
SECOND = 0x5DEECE66D


def lengths_of(window: int) -> list[int]:
    """Window lengths of the levels: the first, its doubles up to half of the final one, the final one."""
    first = window // 2
    while first // 2 >= LEAST:
        first //= 2
    out = [first]
    while 2 * out[-1] <= window // 2:
        out.append(2 * out[-1])
    return [*out, window]


def anchors(short: np.ndarray, first: int, window: int) -> np.ndarray:
    """Positions of the chosen ones among the hashes of a text's first-level windows: of those of each final window the
    least, the last of equals."""
    span = window - first + 1
    if len(short) < span:
        return np.empty(0, np.int64)
    views = sliding_window_view(short[::-1], span)
    chosen = np.arange(len(views)) + views.argmin(axis=1)
    return np.unique(len(short) - 1 - chosen)


def levels(texts: list[bytes], lengths: list[int], seed: int = 0) -> Iterator[list[np.ndarray]]:
    """For each text the hashes of its windows of each length."""
    for first, last in in_chunks(texts):
        h, at = hashed_words(texts[first:last], seed=seed)
        every = [(n, window_hashes(h, n)) for n in lengths]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield [x[a : max(a, b - n + 1)] for n, x in every]


def chains(own: list[np.ndarray], lengths: list[int]) -> np.ndarray:
    """A row for each different anchor of a text: its hash, and for each middle level the hashes of the windows that begin
    and end with it (0 where the text is too short for one)."""
    first, window = lengths[0], lengths[-1]
    at = anchors(own[0], first, window)
    out = [own[0][at]]
    for n, h in zip(lengths[1:-1], own[1:-1], strict=True):
        for start in (at, at + first - n):
            fits = (start >= 0) & (start < len(h))
            out.append(np.where(fits, h[np.where(fits, start, 0)] if len(h) else np.uint64(0), np.uint64(0)))
    return np.unique(np.stack(out, axis=1), axis=0)


def _scan(window: int):
    lengths = lengths_of(window)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sha", pa.string()), ("chains", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for text, own in zip(texts, levels(texts, lengths), strict=True):
                words = text.split()
                whole = b" ".join(words)
                found = chains(own, lengths).view(np.int64).ravel() if len(words) >= window else None
                for column, value in zip(out, (len(words), xxhash.xxh3_128_digest(whole), hashlib.sha256(whole).hexdigest(), found), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    return run


def _windows(window: int):
    """Candidates of the last level: both hashes and the start of each final window around a surviving anchor."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("hashes", pa.list_(pa.int64())), ("second", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("text", pa.binary())])
    first = lengths_of(window)[0]
    reach = window - first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), texts, batch.column("found").to_pylist(), levels(texts, [first, window]), levels(texts, [window], SECOND), strict=True)
            for id_, key, text, found, (short, full), (other,) in rows:
                if not len(full) or xxhash.xxh3_128_digest(b" ".join(text.split())) != key:
                    continue
                at = anchors(short, first, window)
                at = at[np.isin(short[at].view(np.int64), np.array(found, np.int64))]
                edge = np.zeros(len(full) + 1, np.int32)
                np.add.at(edge, np.maximum(at - reach, 0), 1)
                np.add.at(edge, np.minimum(at + 1, len(full)), -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]))
                if len(starts):
                    for column, value in zip(out, (id_, key, full[starts].view(np.int64), other[starts].view(np.int64), starts.astype(np.int32), text), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _cut(window: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("removed", pa.int64()), ("kept", pa.string()), ("kept_sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int32)
                at = np.array(starts, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
                for column, value in zip(out, (int((~keep).sum()), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()).cast(pa.string()), pa.array(out[2], pa.string())], schema=schema
            )

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and kept_text where some but not all words went."""
    scratch = Scratch(spark, "substring-dedup")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    scan = scratch.save(texts.mapInArrow(_scan(window), "id long, n long, key binary, sha string, chains array<long>"), "scan")
    known = scan.where(f"id is not null and n >= {window}")
    classes = scratch.save(known.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "classes")
    firsts = known.join(classes, (known["key"] == classes["key"]) & (known["id"] == classes["first"]), "left_semi").dropDuplicates(["id", "key"])
    middle = len(lengths_of(window)) - 2
    width = 1 + 2 * middle
    if middle:
        chain = F.explode(F.transform(F.expr(f"sequence(1, size(chains), {width})"), lambda k: F.slice("chains", k, F.lit(width))))
        alive = firsts.where("size(chains) > 0").select("id", "key", chain.alias("chain")).select("id", "key", F.col("chain")[0].alias("half"), "chain")
    else:
        alive = firsts.select("id", "key", F.explode("chains").alias("half"))
    repeated = alive.groupBy("half").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("half")
    # written first: against a table of its own, Spark can split the windows of a very common passage in the join
    repeated = scratch.save(repeated, "repeated")
    alive = alive.join(repeated, "half")
    for k in range(middle):
        alive = scratch.save(alive, "alive")
        if alive.isEmpty():
            break
        each = alive.select("*", F.explode(F.slice("chain", 2 * k + 2, 2)).alias("longer")).where("longer <> 0")
        again = scratch.save(each.groupBy("longer").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("longer"), "repeated")
        alive = each.join(again, "longer").select("id", "key", "half", "chain").distinct()
    found = scratch.save(alive.groupBy("id", "key").agg(F.collect_set("half").alias("found")), "found")
    scratch.release()
    candidates = texts.join(found, "id").mapInArrow(_windows(window), "id long, key binary, hashes array<long>, second array<long>, starts array<int>, text binary")
    candidates = scratch.save(candidates, "candidates")
    scratch.drop(found, repeated)
    scratch.release()
    each = candidates.select("id", "key", F.explode(F.arrays_zip("hashes", "second", "starts")).alias("w"))
    each = each.select("id", "key", F.col("w.hashes").alias("hash"), F.col("w.second").alias("second"), F.col("w.starts").alias("start"))
    least = each.groupBy("hash", "second").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("hash", "second", "least")
    least = scratch.save(least, "least")
    gone = each.join(least, ["hash", "second"]).where("id > least").groupBy("id", "key").agg(F.collect_set("start").alias("gone"))
    cut = (
        candidates.select("id", "key", "text")
        .dropDuplicates(["id", "key"])
        .join(gone, ["id", "key"])
        .mapInArrow(_cut(window), "id long, key binary, removed long, kept string, kept_sha string")
    )
    cut = scratch.save(cut, "cut")
    scratch.drop(candidates, least)
    rows = scan.select("id", "n", "key", "sha").join(classes, "key", "left").join(cut, ["id", "key"], "left")
    whole = F.coalesce((F.col("id") > F.col("first")) & (F.col("n") >= window), F.lit(False))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept_text"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, table(spark, sf_dir, "documents")).drop("kept_text")
