"""Dictionaries of any size: which of a table's terms each text holds, as joins and not as an automaton in every worker.

Terms and texts meet in their grams: strings of eight bytes of UTF-8, or of the whole term where it is shorter. A first pass
over the texts counts the grams that terms have. A term of which a gram is in no text is out; of every other its rarest gram
stands for it (of long terms some grams are looked at, which only makes more candidates). A second pass gives the texts that
hold such grams, and each candidate is confirmed on the whole text: where it stands, if the terms that are left are few
enough to be sent to every task, else texts and candidates are shuffled.

A gram is one long, exactly: of shorter ones the first byte is one that UTF-8 never has. Texts' grams pass Bloom filters of
the terms' grams, one for each length, before they are shuffled; they grow with the terms up to ``MAX_BITS``, a few MB, beyond
which they let more through and change no result. They and at most ``MAX_SENT`` bytes of terms are all that goes to the driver
or into a broadcast.

Defined cases: null and empty terms and null texts match nothing; repeated terms and rows that share a key give one row for a
key and a term; null keys are a key; texts and terms of any length are taken whole, in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.streaming.shared import folder

GRAM = 8
#: The largest Bloom filter: 4 MB, an eighth of it for grams that are shorter.
MIN_BITS, MAX_BITS = 1 << 18, 1 << 25
#: Grams of texts that are counted together in a task.
COUNTED = 1 << 20
#: Terms of so many bytes in all, and 64 for each, are sent to every task.
MAX_SENT = 1 << 23
#: Bytes of texts that are looked at together: few enough for a processor's cache.
SLICE = 1 << 17
#: Places of a term whose grams are counted; of a longer term those that are spread over it.
PLACES = 64
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def grams(data: bytes, length: int) -> np.ndarray:
    """The grams of one length, one for each place."""
    return grams_of(np.frombuffer(data, np.uint8), [length])[length]


def grams_of(data: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the grams at each place; a gram is the one that is a byte shorter and its next byte."""
    cells, out, found = data.astype(np.uint64), np.zeros(len(data), np.uint64), {}
    for k in range(1, max(lengths) + 1):
        n = max(len(data) - k + 1, 0)
        out = (out[:n] << np.uint64(8)) | cells[k - 1 : k - 1 + n]
        if k in lengths:
            found[k] = out if k == GRAM else out | np.uint64((0xF8 + k) << 56)
    return found


def _place(found: np.ndarray, odd: np.uint64, bits: int) -> np.ndarray:
    return ((found * odd) >> np.uint64(64 - bits.bit_length() + 1)).view(np.int64)


def _lengths(found: np.ndarray) -> np.ndarray:
    """The lengths of grams, as their first byte tells them."""
    first = (found >> np.uint64(56)).astype(np.int64)
    return np.where(first > 0xF8, first - 0xF8, GRAM)


def bloom(terms: DataFrame, n_grams: dict[int, int]) -> dict[int, np.ndarray]:
    """terms(gram) and how many grams there are of each length -> the words of 64 bits of each length's filter."""
    bits = {k: min(MAX_BITS if k == GRAM else MAX_BITS // 8, max(MIN_BITS, 1 << (16 * n).bit_length())) for k, n in n_grams.items()}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {k: np.zeros(n // 64, np.uint64) for k, n in bits.items()}
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            length = _lengths(every)
            for k, n in bits.items():
                for odd in _ODD:
                    at = _place(every[length == k], odd, n)
                    np.bitwise_or.at(words[k], at >> 6, np.uint64(1) << (at & 63).view(np.uint64))
        for k, own in words.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int64)), pa.array(own[used].view(np.int64))], ["length", "word", "bits"])

    merged = terms.select("gram").mapInArrow(part, "length int, word long, bits long").groupBy("length", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    length, word, value = (merged.column(c).to_numpy() for c in ("length", "word", "bits"))
    words = {k: np.zeros(n // 64, np.uint64) for k, n in bits.items()}
    for k, own in words.items():
        own[word[length == k]] = value[length == k].view(np.uint64)
    return words


def _known(found: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The places of the grams that the filter, as a truth value for each bit, knows; the second bit is only looked at where
    the first one holds."""
    at = np.flatnonzero(held[_place(found, _ODD[0], len(held))])
    return at[held[_place(found[at], _ODD[1], len(held))]]


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """(bytes, rows, ends): about ``SLICE`` bytes of texts one after the other, the row of each piece and where it ends.
    Longer texts are in several pieces, which share as many bytes as no gram is longer than."""
    some, rows, ends, total = [], [], [], 0
    for n, value in enumerate(texts):
        data = (value.as_py() or "").encode()
        for start in range(0, len(data), SLICE):
            some.append(data[start : start + SLICE + GRAM - 1])
            total += len(some[-1])
            rows.append(n)
            ends.append(total)
            if total >= SLICE:
                yield np.frombuffer(b"".join(some), np.uint8), rows, ends
                some, rows, ends, total = [], [], [], 0
    if some:
        yield np.frombuffer(b"".join(some), np.uint8), rows, ends


def _unpacked(words: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {k: np.unpackbits(own.view(np.uint8), bitorder="little").view(bool) for k, own in words.items()}


def _row_grams(texts: pa.Array, held: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram): the grams of texts that the filters know, once for each piece of a text; rows ascend."""
    for data, rows, ends in _blocks(texts):
        owners, found, ends = [], [], np.array(ends)
        for k, every in grams_of(data, list(held)).items():
            at = _known(every, held[k])
            owner = np.searchsorted(ends, at, side="right")
            inside = at + k <= ends[owner]  # not across two texts
            owners.append(owner[inside])
            found.append(every[at[inside]])
        owner, gram = np.concatenate(owners), np.concatenate(found)
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        first = np.ones(len(gram), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        yield np.array(rows, np.int64)[owner[first]], gram[first].view(np.int64)


def text_grams(docs: DataFrame, key: str, text: str, words: dict[int, np.ndarray]) -> DataFrame:
    """key, gram: the grams of a text that the filters know, once for each piece of it."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _unpacked(words)
        for b in batches:
            for rows, gram in _row_grams(b.column(1), held):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(gram)], [key, "gram"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, gram long")


def gram_counts(docs: DataFrame, text: str, words: dict[int, np.ndarray]) -> DataFrame:
    """gram, n: how often ``text_grams`` tells each gram, counted in the tasks first."""

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, total = _unpacked(words), [], 0
        for b in batches:
            for _, gram in _row_grams(b.column(0), held):
                found.append(gram)
                total += len(gram)
                if total >= COUNTED:
                    yield counted(found)
                    found, total = [], 0
        if found:
            yield counted(found)

    return docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def grams_column(text: Column, words: dict[int, np.ndarray]) -> Column:
    """array<long>: what ``text_grams`` tells, beside the text."""

    def run(texts: pa.Array) -> pa.Array:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_row_grams(texts, _unpacked(words))]
        rows, grams = (np.concatenate(c) for c in zip(*found, strict=True))
        ends = np.cumsum(np.bincount(rows, minlength=len(texts)))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(grams))

    return F.arrow_udf(run, "array<bigint>")(text)


def term_grams(terms: DataFrame) -> DataFrame:
    """term, gram, length: grams of at most ``PLACES`` places of a term, from its beginning to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, found, lengths = [], [], []
            for n, value in enumerate(b.column(0)):
                data = value.as_py().encode()
                length = min(GRAM, len(data))
                own = grams(data, length)
                if len(own) > PLACES:
                    own = own[np.arange(PLACES) * (len(own) - 1) // (PLACES - 1)]
                own = np.unique(own)
                owners += [n] * len(own)
                lengths += [length] * len(own)
                found.append(own)
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owners, pa.int64())), pa.array(np.concatenate(found).view(np.int64)), pa.array(lengths, pa.int32())], ["term", "gram", "length"])

    return terms.select("term").mapInArrow(run, "term string, gram long, length int")


def term_matches(docs: DataFrame, key: str, text: str, terms: DataFrame, fold: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """docs(key, text), terms(term) -> key, term: the terms that a text holds. ``fold`` is put on both before they are
    compared (``F.lower``); terms are told as folded."""
    own = terms.select(fold(F.col("term")).alias("term")).where("term is not null and term <> ''").distinct()
    rows = docs.select(F.col(key), fold(F.col(text)).alias("__text")).where("__text is not null")
    spark, written = docs.sparkSession, folder(docs.sparkSession, "terms")
    term_grams(own).write.mode("overwrite").parquet(f"{written}/grams")
    cut = spark.read.schema("term string, gram long, length int").parquet(f"{written}/grams")
    lengths = dict(map(tuple, cut.groupBy("length").agg(F.countDistinct("gram")).collect()))
    none = rows.select(key, F.lit(None).cast("string").alias("term")).limit(0)
    if not lengths:
        return none
    counts = gram_counts(rows, "__text", bloom(cut, lengths))
    rarest = cut.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
    rarest.where("rare.n > 0").select("term", F.col("rare.gram").alias("gram")).write.mode("overwrite").parquet(f"{written}/chosen")
    chosen = spark.read.schema("term string, gram long").parquet(f"{written}/chosen")
    bytes_of = F.octet_length("term")
    told = chosen.groupBy(F.least(bytes_of, F.lit(GRAM)).alias("length")).agg(F.countDistinct("gram").alias("n"), F.sum(bytes_of + 64).alias("size")).collect()
    if not told:
        return none
    words = bloom(chosen, {r.length: r.n for r in told})
    if sum(r.size for r in told) <= MAX_SENT:
        beside = rows.select(key, "__text", F.explode(grams_column(F.col("__text"), words)).alias("__gram"))
        sent = F.broadcast(chosen.select("term", F.col("gram").alias("__gram")))
        return beside.join(sent, "__gram").where(F.contains("__text", "term")).select(key, "term").distinct()
    candidates = text_grams(rows, key, "__text", words).join(chosen, "gram").select(F.col(key).alias("__key"), "term").distinct()
    confirmed = F.col(key).eqNullSafe(F.col("__key")) & F.contains("__text", "term")
    return rows.join(candidates, confirmed).select(key, "term").distinct()
