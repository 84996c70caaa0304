"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through ``window`` bytes, by most-significant-digit passes: a pass deals its items by a digit of
their content, drops those whose digit nobody shares, and hands on those whose digit still leaves them unordered. Items of
the last pass are single windows, and equal groups there are exactly the repeated windows.

The digits are chosen by content, so that few rows are needed. Every window of ``window`` bytes has an anchor, the least (by
hash, the first of equals) of the grams of ``gram`` bytes inside it; equal windows have equal anchors at the same place. So
consecutive windows with one anchor, a run, are one item of the first pass: about 1 row in 35 bytes instead of one a byte.

1. Runs: the digit is the anchor's gram. A run whose bytes equal an earlier run's is settled by that, all its windows are
   repeated; only the first of equal runs goes on, if its gram has runs of other content.
2. Blocks: a run's windows at eight neighbouring distances from the anchor. The digit is what all eight have in common.
   Blocks are settled like runs.
3. Windows of the blocks that are left: digit and content are the window itself.

In each pass the first of equals is a grouped minimum and what shares a digit is told by a grouped count, both pre-added in
every task, and these are joined back as written tables of unique keys, so that Spark can split a digit that is common. Runs
carry hashes only; the bytes of those few that go on to the second pass are taken from the text in one join.

Defined cases: null and empty text: no bytes; fewer bytes than a window: nothing removed; a null id neither removes nor loses
bytes; rows that share an id are one document, in the order of their digests, and equal ones of these have equal results; an
empty table gives an empty result; further columns are not read; a text of any length is read in pieces of about 1 MB, runs end
at the pieces' borders. A window must have 16 bytes or more. Contents are compared by two hashes of 64 bits each: of runs, the
gram's and xxh3 of the whole, of windows a paired hash and xxh3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, doubled, lanes, mixed, table

WINDOW = 100
#: Windows of a block, bytes of a piece of text.
BLOCK, PIECE = 8, 1 << 20
#: Rows that share an id have their starts this far apart; the lower eight bits of a place are a run's windows less one.
ROW, BITS = 40, 8
PLACE = np.uint64((1 << 32) - 1)


def gram_of(window: int) -> int:
    """The longest power of two of at most a third of the window, 8 at least; a run then has at most 256 windows."""
    if not 16 <= window <= 256:
        raise ValueError("windows of 16 to 256 bytes can be ordered")
    return max(8, 1 << (window // 3).bit_length() - 1)


def hashes(data: bytes, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` bytes, 8 at least."""
    return doubled(mixed(lanes(data)), 8, length)


def pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number of the text, where the piece starts, its bytes) of about PIECE bytes together; the pieces of a text overlap so
    that each window is in one of them."""
    group, total = [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(0, len(text) - window + 1), PIECE):
            part = text[start : start + PIECE + window - 1] if len(text) > PIECE else text
            group.append((k, start, part))
            total += len(part)
            if total >= PIECE:
                yield group
                group, total = [], 0
    if group:
        yield group


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(data: bytes, sizes: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first and last window, place and hash of the anchor) of each run of windows that lie within one of the parts that
    ``data`` is joined of, by their sizes."""
    gram = gram_of(window)
    g = hashes(data, gram)
    anchor = least_of(g & ~PLACE | np.arange(len(g), dtype=np.uint64), window - gram + 1)  # the first of equals
    end = np.cumsum(sizes)
    inside = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(inside, end - sizes, 1)
    np.add.at(inside, end - window + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    place = (anchor[at] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(at) else np.empty(0, np.int64)
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    return at[first], at[last], place[first], g[place[first]]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(window: int):
    """The items of the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, base = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "base"))
            for group in pieces([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], window):
                data, sizes = b"".join(p for _, _, p in group), np.array([len(p) for _, _, p in group])
                first, last, _, gram = runs(data, sizes, window)
                begin = np.cumsum(sizes) - sizes
                part = np.searchsorted(begin, first, "right") - 1
                row, start = (np.array([g[i] for g in group])[part] for i in (0, 1))
                at = (base[row] << ROW) + ((start + first - begin[part]) << BITS) + last - first
                content = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([_long(gram), _long(content), pa.array(ids[row]), pa.array(at)], names=["digit", "content", "id", "at"])

    return run


def _bytes_of(window: int):
    """The bytes of the runs at the places ``on`` of a text."""
    schema = pa.schema([("id", pa.int64()), ("run", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for id_, text, on in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("on").to_pylist(), strict=True):
                for at in on:
                    start = (at & (1 << ROW) - 1) >> BITS
                    for column, value in zip(out, (id_, at, text[start : start + (at & 255) + window]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _blocks(window: int):
    """The items of the second pass, from runs with their bytes."""
    names = ["digit", "content", "id", "at", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            texts, out = batch.column("bytes").to_pylist(), []
            data, sizes = b"".join(texts), np.array([len(t) for t in texts])
            # a run has one anchor, whose place within it follows from its bytes
            first, _, anchor, _ = runs(data, sizes, window)
            begin = np.cumsum(sizes) - sizes
            near = dict(zip((np.searchsorted(begin, first, "right") - 1).tolist(), (anchor - first).tolist(), strict=True))
            for k, (id_, at, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("run").to_pylist(), texts, strict=True)):
                far, least = near[k], near[k] - (at & 255)  # distances of the first and the last window
                for j in range(least // BLOCK, far // BLOCK + 1):
                    low, high = max(BLOCK * j, least), min(BLOCK * j + BLOCK - 1, far)
                    common = text[far - BLOCK * j : far - BLOCK * j - BLOCK + 1 + window]
                    whole = text[far - high : far - low + window]
                    place = (at >> BITS) + far - high
                    out.append((xxhash.xxh3_64_intdigest(common, seed=j), xxhash.xxh3_64_intdigest(whole), id_, place << BITS | high - low, at))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([_long(np.array(c, np.uint64)) for c in columns[:2]] + [pa.array(c, pa.int64()) for c in columns[2:]], names=names)

    return run


def _windows(window: int):
    """The items of the last pass, from blocks with the bytes of their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            digit, content, ids, places = [], [], [], []
            for id_, at, run_at, text in zip(*(batch.column(c).to_pylist() for c in ("id", "at", "run", "bytes")), strict=True):
                skip, count = (at >> BITS) - (run_at >> BITS), (at & 255) + 1
                own = text[skip : skip + count - 1 + window]
                digit.append(hashes(own, window))
                content += [xxhash.xxh3_64_intdigest(own[k : k + window]) for k in range(count)]
                ids += [id_] * count
                places += [(at >> BITS) + k << BITS for k in range(count)]
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(digit)), _long(np.array(content, np.uint64)), pa.array(ids, pa.int64()), pa.array(places, pa.int64())], names=["digit", "content", "id", "at"])

    return run


def settle(items: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """One pass over items (digit, content, id, at, ...): those that equal an earlier one in digit and content as (id, at), and
    the items, with all columns, that stand for others and share their digit with other contents."""
    shared = scratch.save_narrow(items.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit"), f"{name}-digits")
    alive = scratch.save_narrow(items.join(shared, "digit"), name)
    scratch.drop(shared)
    scratch.release()
    classes = alive.groupBy("digit", "content").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = scratch.save_narrow(classes, f"{name}-classes")
    later = alive.join(classes.where("n > 1"), ["digit", "content"]).where(F.struct("id", "at") > F.col("first"))
    gone = scratch.save_narrow(later.select("id", "at"), f"{name}-gone")
    open_ = classes.groupBy("digit").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("digit")
    open_ = scratch.save_narrow(open_, f"{name}-open")
    first = classes.join(open_, "digit").select("digit", "content", "first.*")
    on = alive.join(first, ["digit", "content", "id", "at"]).drop("digit", "content").distinct() if len(items.columns) > 4 else first.drop("digit", "content").distinct()
    on = scratch.save_narrow(on, f"{name}-on")
    scratch.drop(alive, classes, open_)
    scratch.release()
    return gone, on


def _cut(window: int):
    schema = pa.schema([("id", pa.int64()), ("base", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                at = np.array(gone, np.int64) & (1 << ROW) - 1
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, at >> BITS, 1)
                np.add.at(edge, (at >> BITS) + (at & 255) + window, -1)
                away = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~away].tobytes()
                for column, value in zip(out, (int(away.sum()), int(away[0]) + int((away[1:] & ~away[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("base"), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[2:], strict=True))], schema=schema)

    return run


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, base): base is 0, or where different texts share an id, their number in the order of their digests."""
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    twice = texts.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).where("low <> high").select("id")
    if twice.isEmpty():
        return texts.withColumn("base", F.lit(0).cast("long"))
    own = texts.join(twice, "id", "left_semi").select("id", F.sha2("text", 256).alias("digest"))
    number = own.groupBy("id").agg(F.array_sort(F.collect_set("digest")).alias("digests"))
    found = texts.join(number, "id", "left")
    return found.select("id", "text", F.coalesce(F.array_position("digests", F.sha2("text", 256)) - 1, F.lit(0)).cast("long").alias("base"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_bytes where some bytes went."""
    gram_of(window)
    scratch = Scratch(spark, "suffix-dedup")
    texts = numbered(docs, id_col, text_col)
    kinds = "digit long, content long, id long, at long"
    # hashes can be computed again, so they are not kept: a written table of them would take as much disk as the texts
    items = texts.where("id is not null").mapInArrow(_runs(window), kinds)
    gone, on = settle(items, scratch, "runs")
    places = on.groupBy("id", F.shiftright("at", ROW).alias("base")).agg(F.collect_set("at").alias("on"))
    opened = scratch.save_narrow(texts.join(places, ["id", "base"]).mapInArrow(_bytes_of(window), "id long, run long, bytes binary").dropDuplicates(["id", "run"]), "opened")
    scratch.release()
    more, blocks = settle(opened.mapInArrow(_blocks(window), f"{kinds}, run long"), scratch, "blocks")
    single = blocks.join(opened, ["id", "run"]).mapInArrow(_windows(window), kinds)
    single = scratch.save_narrow(single, "windows")
    first = single.groupBy("digit", "content").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.save_narrow(first, "first")
    last = single.join(first, ["digit", "content"]).where(F.struct("id", "at") > F.col("first")).select("id", "at")
    every = gone.unionByName(more).unionByName(last)
    gone_of = scratch.save_narrow(every.groupBy("id", F.shiftright("at", ROW).alias("base")).agg(F.collect_set("at").alias("gone")), "gone")
    scratch.drop(single, first, opened, blocks, gone, more, on)
    scratch.release()
    shape = "id long, base long, removed long, spans long, sha string, kept binary"
    cut = scratch.save(texts.join(gone_of, ["id", "base"]).mapInArrow(_cut(window), shape), "cut")
    scratch.release()
    plain = texts.select("id", "base", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("own"))
    rows = plain.join(cut.dropDuplicates(["id", "base"]), ["id", "base"], "left")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
        F.col("kept").alias("kept_bytes"),
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, table(spark, sf_dir, "documents")).drop("kept_bytes")
