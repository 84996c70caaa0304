"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents (grouped sums; a fixed number of buckets).
2. A randomised SVD of the TF-IDF passages of all documents: every task multiplies its passages with a random test matrix
   and back (Z = A'A O, a fixed-size matrix), the tasks' matrices are added by strips, and the sum goes to the driver, where
   the small factorisation gives the latent directions (Nystroem). Only if asked to (``fit_docs``) is the index fitted on a
   sample, chosen by hash; every document is searched.
3. Cosine search: every passage (windows of 16, 32 and 48 words, dealt to benchmark passages by their length) against
   all benchmark passages, in blocks of ``block_items``; a matrix product, never a join.
4. A candidate is confirmed by the longest common subsequence of words between the benchmark passage and the window
   with a margin, or, where parts of it stand in another order, by the share of its neighbouring words that are neighbours
   there too; and by the answer check: enough of the rare words of the passage must be in the window.
5. In documents in which no candidate is confirmed, what the cosine search passes over is found from the rare words
   themselves: every window, at any word, that holds as many of them as the answer check asks for is compared as in 4. So a
   document is contaminated exactly if some window of it passes 4, and ``found_by`` tells which search told so.

Words are lower-cased and freed of ASCII punctuation, so changed case, marks and some changed words don't hide a passage.

Defined cases: null text counts as empty: never contaminated; benchmark items without words are passed over, those of
fewer than ``PHRASE`` words must occur word for word; without benchmark items nothing is contaminated; of equally good
matches the least item id is told; rows that share an id stay separate, however many blocks the benchmark takes, and
``clean`` drops a row by its own text, with a null id too; an empty table gives an empty result; further columns are not
read by ``search`` and are kept by ``clean``. A worker holds one text of any length at a time, the driver a block of the
benchmark and what it reads of the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATES, Scratch, hashed_words, in_chunks, table

FINE, COARSE, RANK, STEP_WORDS = 1 << 16, 2048, 64, 8
SCALES = ((16, 21, 0.9), (32, 40, 1.0), (48, 1 << 30, 1.0))  # window, the longest benchmark passage that it serves, share of the cosine asked for
PHRASE = 8
#: The least shares of a passage: longest common subsequence, rare words, neighbours.
COMMON, ANSWER, ORDER = 0.5, 0.4, 0.5
#: The fit's sums go in so many parts of the matrix to the tasks that add them, as whole numbers of 1 / SCALE.
STRIPS, SCALE = 16, 1 << 20
#: Cosines of windows and passages that are held at once.
CELLS = 1 << 22
MARKS = SEPARATES.copy()
MARKS[[c for c in range(128) if not chr(c).isalnum()]] = True


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, first word of each text and the end)."""
    return hashed_words([(t or "").lower().encode() for t in texts], separates=MARKS)


def batched(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows without their texts, word hashes and first words of a few texts at a time."""
    texts, rest = batch.column("text").to_pylist(), batch.drop_columns("text")
    for first, last in in_chunks([t or "" for t in texts]):
        yield rest.slice(first, last - first), *words_of(texts[first:last])


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit a word of ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(FINE, np.int64), 0
    for batch in batches:
        for some, h, at in batched(batch):
            word = (h % np.uint64(FINE)).astype(np.int64)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                seen[word[a:b]] += 1  # once for a document, however often the word is in it
            docs += some.num_rows
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], docs), pa.int64())], names=["word", "n"])


def inverse_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Weights of the hashed words over all documents, and the number of documents; FINE numbers however large the corpus."""
    rows = texts.mapInArrow(_frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df, docs = np.zeros(FINE), int(rows.loc[rows.word == -1, "n"].sum())
    rows = rows[rows.word >= 0]
    df[rows.word] = rows.n
    return np.log((docs + 1) / (df + 0.5)).clip(0.05).astype(np.float32), docs


def _features(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(latent table row, signed weight) of each word."""
    weight = idf[(h % np.uint64(FINE)).astype(np.int64)]
    return (h >> np.uint64(32)).astype(np.int64) % COARSE, np.where(h >> np.uint64(63), weight, -weight)


SUMS = "strip int, z binary, rows long"


def _range_finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, test = shared.value
        total, rows = np.zeros((COARSE, test.shape[1])), 0
        for batch in batches:
            rows += batch.num_rows
            for _, h, at in batched(batch):
                if not len(h):
                    continue
                row, weight = _features(h, idf)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                passage = np.cumsum((np.arange(len(h)) - at[doc]) % 32 == 0) - 1
                for first in range(0, int(passage[-1]) + 1, 1024):
                    a, b = np.searchsorted(passage, [first, first + 1024])
                    some = np.bincount((passage[a:b] - first) * COARSE + row[a:b], weight[a:b], 1024 * COARSE).astype(np.float32).reshape(1024, COARSE)
                    seen = some @ test
                    seen /= np.maximum(np.einsum("ij,ij->i", some, some), 1e-24)[:, None]  # as of passages of length 1
                    total += some.T @ seen
        whole = np.rint(total * SCALE).astype(np.int64)  # whole numbers, so that no order of tasks changes the sums
        yield _sums(whole.reshape(STRIPS, -1), rows)

    return run


def _sums(strips: np.ndarray, rows: int) -> pa.RecordBatch:
    n = len(strips)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([s.tobytes() for s in strips], pa.binary()), pa.array([rows] + [0] * (n - 1), pa.int64())], names=["strip", "z", "rows"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's strips."""
    total: dict[int, list] = {}
    for batch in batches:
        for strip, z, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = total.setdefault(strip, [0, 0])
            own[0], own[1] = own[0] + np.frombuffer(z, np.int64), own[1] + rows
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([z.tobytes() for z, _ in total.values()], pa.binary()), pa.array([n for _, n in total.values()], pa.int64())], names=["strip", "z", "rows"])


def least_hash(fit_docs: int, docs: int) -> int:
    """A signed 64-bit hash is below this for about ``fit_docs`` of ``docs`` rows, however many there are."""
    return -(1 << 63) + (fit_docs << 64) // docs


def latent_directions(spark: SparkSession, texts: DataFrame, idf: np.ndarray, fit_docs: int | None, docs: int, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """COARSE x rank: whitened right singular vectors of the TF-IDF passages of all documents, or of a sample of about ``fit_docs``."""
    extra = rank + 16
    test = np.random.default_rng(seed).standard_normal((COARSE, extra)).astype(np.float32)
    part = texts
    if fit_docs is not None and docs > fit_docs:  # the fit alone; every document is searched
        part = texts.where(F.xxhash64("id", "text") < F.lit(least_hash(fit_docs, docs)))
    # each task has a matrix of fixed size, so there are no more than a few for each core
    sums = part.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(_range_finder(spark.sparkContext.broadcast((idf, test))), SUMS)
    z, rows = np.zeros((STRIPS, COARSE // STRIPS, extra)), 0
    for told in sums.repartition(STRIPS, "strip").mapInArrow(_added, SUMS).collect():  # one matrix in all
        z[told["strip"]] = np.frombuffer(told["z"], np.int64).reshape(z.shape[1:]) / SCALE
        rows += told["rows"]
    z = z.reshape(COARSE, extra)
    if docs and not rows:
        raise RuntimeError("the sample for the latent directions is empty: raise fit_docs")
    core = test.T.astype(float) @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-30)
    if not keep.any():
        return test[:, :rank]
    left, sizes, _ = np.linalg.svd(z @ vectors[:, keep] / np.sqrt(values[keep]), full_matrices=False)
    return (left / np.maximum(sizes, 1e-12 + sizes.max() * 1e-6))[:, :rank].astype(np.float32)


@dataclass
class Passage:
    item: int
    words: list[int]
    rare: frozenset
    pairs: frozenset


def pairs_of(words: list[int]) -> frozenset:
    return frozenset(zip(words, words[1:], strict=False))


def passages(item: int, h: np.ndarray, idf: np.ndarray) -> list[Passage]:
    """A benchmark text in parts of at most 64 words, each with its rare words (a third), the answer."""
    parts = [h[i : i + 48] for i in range(0, len(h), 48)] if len(h) > 64 else [h]
    out = []
    for part in parts:
        if len(part) >= min(PHRASE, len(h)) and len(part):
            order = np.argsort(-idf[(part % np.uint64(FINE)).astype(np.int64)], kind="stable")[: max(1, len(part) // 3)]
            out.append(Passage(item, part.tolist(), frozenset(part[order].tolist()), pairs_of(part.tolist())))
    return out


def _vector(words: list[int], idf: np.ndarray, latent: np.ndarray) -> np.ndarray:
    row, weight = _features(np.array(words, np.uint64), idf)
    v = weight @ latent[row]
    return v / max(np.linalg.norm(v), 1e-12)


def margin_of(p: Passage, size: int) -> int:
    """Words before and after a window that are compared with it."""
    return max(STEP_WORDS, len(p.words) - size + STEP_WORDS)


@dataclass(frozen=True)
class Limits:
    """The least share of a passage in the longest common subsequence, of its rare words, and of its pairs of neighbours
    where these stand in another order."""

    common: float = COMMON
    answer: float = ANSWER
    order: float = ORDER

    def shares(self, p: Passage, region: list[int]) -> tuple[float, float]:
        """(longest common subsequence, pairs of neighbours) as shares of the passage."""
        together = len(p.pairs & pairs_of(region)) / len(p.pairs) if p.pairs else 0.0
        return common_subsequence(p.words, region) / len(p.words), together

    def rank(self, lcs: float, together: float) -> float | None:
        """How good a match is, None if it is none."""
        best = max(lcs if lcs >= self.common else 0.0, together if together >= self.order else 0.0)
        return best or None


def confirmed(h: np.ndarray, p: Passage, start: int, size: int, limits: Limits) -> tuple[float, float, float] | None:
    """(rank, share of the passage in the longest common subsequence, share of its rare words), if they suffice."""
    margin = margin_of(p, size)
    region = h[max(0, start - margin) : start + size + margin].tolist()
    share = len(p.rare.intersection(region)) / len(p.rare)
    if share < limits.answer:
        return None
    n = len(p.words)
    if n < PHRASE:
        return (1.0, 1.0, share) if any(region[i : i + n] == p.words for i in range(len(region) - n + 1)) else None
    lcs, together = limits.shares(p, region)
    best = limits.rank(lcs, together)
    return (best, lcs, share) if best else None


class RareWords:
    """The rare words of all passages by value, to find every window that can meet the answer check (of more than 0)."""

    def __init__(self, found: list[Passage], answer: float):
        self.found, self.sizes = found, [next(size for size, longest, _ in SCALES if len(p.words) <= longest) for p in found]
        words, of = np.array([w for p in found for w in p.rare], np.uint64), np.repeat(np.arange(len(found)), [len(p.rare) for p in found])
        order = np.argsort(words, kind="stable")
        self.words, self.of = words[order], of[order]
        self.need = np.array([next(k for k in range(1, len(p.rare) + 1) if k / len(p.rare) >= answer or k == len(p.rare)) for p in found], np.int64)
        self.margins = [margin_of(p, size) for p, size in zip(found, self.sizes, strict=True)]
        self.reach = np.array([size + 2 * m for size, m in zip(self.sizes, self.margins, strict=True)], np.int64)

    def windows(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, passage, first and last start of its windows) wherever enough rare words are near each other; in order."""
        if not len(self.words):
            return
        a = np.searchsorted(self.words, h)
        n = np.searchsorted(self.words, h, "right") - a
        place = np.repeat(np.arange(len(h)), n)
        q = self.of[np.arange(len(place)) + np.repeat(a - (np.cumsum(n) - n), n)]
        doc = np.searchsorted(at, place, "right") - 1
        order = np.lexsort((place, q, doc))
        place, q, doc = place[order], q[order], doc[order]
        last = np.arange(len(q)) + self.need[q] - 1
        i = np.flatnonzero(last < len(q))
        j = last[i]
        near = (doc[j] == doc[i]) & (q[j] == q[i]) & (place[j] - place[i] < self.reach[q[i]])
        now: tuple | None = None
        for k, p, x, y in zip(*(v[near].tolist() for v in (doc[i], q[i], place[i] - at[doc[i]], place[j] - at[doc[i]])), strict=True):
            start, end = max(0, y - self.sizes[p] - self.margins[p] + 1), min(x + self.margins[p], max(0, int(at[k + 1] - at[k]) - self.sizes[p]))
            if now and now[:2] == (k, p) and start <= now[3] + 1:
                now = (k, p, now[2], max(now[3], end))
            else:
                if now:
                    yield now
                now = (k, p, start, end)
        if now:
            yield now

    def matches(self, h: np.ndarray, p: int, first: int, last: int, least: float, limits: Limits) -> Iterator[tuple[int, float, float, float]]:
        """(start, rank, lcs, answer) of the windows that are confirmed; groups of windows whose words together rank under ``least`` are left out."""
        own, size, margin = self.found[p], self.sizes[p], self.margins[p]
        for a in range(first, last + 1, STEP_WORDS):
            b = min(a + STEP_WORDS - 1, last)
            if (limits.rank(*limits.shares(own, h[max(0, a - margin) : b + size + margin].tolist())) or 0.0) >= max(least, 1e-9):
                for s in range(a, b + 1):
                    if told := confirmed(h, own, s, size, limits):
                        yield s, *told


def _search(shared, cosine: float, limits: Limits):
    told_schema = [("item_id", pa.int64()), ("cosine", pa.float64()), ("rank", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("found_by", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, latent, found = shared.value
        by_scale, low = [], 0
        for size, longest, share in SCALES:
            own = [p for p in found if low < len(p.words) <= longest]
            low = longest
            if own:
                by_scale.append((size // STEP_WORDS, cosine * share, own, np.stack([_vector(p.words, idf, latent) for p in own]).T.copy()))
        most = SCALES[-1][0] // STEP_WORDS
        rare = RareWords(found, limits.answer)
        for batch in batches:
            for rows, h, at in batched(batch):
                best: list[tuple] = [(None,) * len(told_schema)] * rows.num_rows
                # blocks of STEP_WORDS words; each text's are followed by empty ones, so that no window crosses texts
                n = np.diff(at)
                blocks = -(-n // STEP_WORDS)
                first = np.cumsum([0, *(blocks + most).tolist()])
                doc = np.repeat(np.arange(len(best)), n)
                place = first[doc] * STEP_WORDS + np.arange(len(h)) - at[doc]
                row, weight = np.zeros(first[-1] * STEP_WORDS, np.int64), np.zeros(first[-1] * STEP_WORDS, np.float32)
                row[place], weight[place] = _features(h, idf)
                one = np.empty((first[-1], latent.shape[1]), np.float32)
                for i in range(0, len(one), 512):
                    r, w = (x[i * STEP_WORDS : (i + 512) * STEP_WORDS] for x in (row, weight))
                    one[i : i + 512] = np.matmul(w.reshape(-1, 1, STEP_WORDS), latent[r].reshape(-1, STEP_WORDS, latent.shape[1]))[:, 0]
                two = one[:-1] + one[1:]
                for size, least, own, matrix in by_scale:
                    starts = np.maximum(blocks - size + 1, 1) * (blocks > 0)
                    of = np.repeat(np.arange(len(best)), starts)
                    start = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
                    i = first[of] + start
                    for low in range(0, len(i), max(1, CELLS // matrix.shape[1])):
                        part = i[low : low + max(1, CELLS // matrix.shape[1])]
                        v = sum(two[part + k] for k in range(0, size, 2))
                        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                        near = v @ matrix
                        for w, q in zip(*(x.tolist() for x in np.nonzero(near >= least)), strict=True):
                            k, p = int(of[low + w]), own[q]
                            now = best[k]
                            told = confirmed(h[at[k] : at[k + 1]], p, int(start[low + w]) * STEP_WORDS, size * STEP_WORDS, limits)
                            if told and (now[0] is None or (-told[0], p.item) < (-now[2], now[0])):
                                best[k] = (p.item, float(near[w, q]), *told, "cosine")
                for k, q, a, b in rare.windows(h, at):
                    if best[k][-1] == "cosine":
                        continue
                    text, p, size = h[at[k] : at[k + 1]], found[q], rare.sizes[q]
                    for start, *told in rare.matches(text, q, a, b, best[k][2] or 0.0, limits):
                        now = best[k]
                        if now[0] is None or (-told[0], p.item) < (-now[2], now[0]):
                            near = _vector(text[start : start + size].tolist(), idf, latent) @ _vector(p.words, idf, latent)
                            best[k] = (p.item, float(near), *told, "rare_words")
                told_cells = [pa.array(c, kind) for c, (_, kind) in zip(zip(*best, strict=True), told_schema, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *told_cells], names=[*rows.schema.names, *(name for name, _ in told_schema)])

    return run


def search(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """One row per input row: doc_id, contaminated, item_id, cosine, lcs, answer, found_by (of the best match, else null)."""
    return _matches(spark, docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), benchmark, **options)


def _matches(
    spark: SparkSession,
    texts: DataFrame,
    benchmark: DataFrame,
    *,
    cosine: float = 0.45,
    common: float = COMMON,
    answer: float = ANSWER,
    order: float = ORDER,
    fit_docs: int | None = None,
    block_items: int = 10_000,
) -> DataFrame:
    """``search`` of texts(id, text) with ids of any type."""
    idf, n = inverse_frequencies(texts)
    latent = latent_directions(spark, texts, idf, fit_docs, n)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator()
    limits = Limits(common, answer, order)

    def blocks() -> Iterator[list[Passage]]:
        block: list[Passage] = []
        for item in items:
            block += passages(item[0], words_of([item[1]])[0], idf)
            if len(block) >= block_items:
                yield block
                block = []
        if block:
            yield block

    def searched(texts: DataFrame, columns: list[str], block: list[Passage]) -> DataFrame:
        schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns) + ", item_id long, cosine double, rank double, lcs double, answer double, found_by string"
        shared = spark.sparkContext.broadcast((idf, latent, block))
        return texts.select(*columns, "text").mapInArrow(_search(shared, cosine, limits), schema)

    # the benchmark is the stated query set: one scan for each block of it
    told = ("item_id", "cosine", "lcs", "answer", "found_by")
    every = blocks()
    block, after = next(every, []), next(every, None)
    if after is None:
        result = searched(texts, ["id"], block)
    else:
        scratch = Scratch(spark, "decontaminate")
        # a number for each row, written so that all scans see the same; matches alone are written for each block
        texts = scratch.save(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
        found = None
        while block is not None:
            part = scratch.save_narrow(searched(texts, ["row"], block).where("item_id is not null"), "matches")
            found = part if found is None else found.unionByName(part)
            block, after = after, next(every, None)
        best = F.min(F.struct(-F.col("rank"), "item_id", "cosine", "lcs", "answer", "found_by"))
        result = texts.select("row", "id").join(found.groupBy("row").agg(best.alias("b")), "row", "left").select("id", *(F.col("b")[c].alias(c) for c in told))
    return result.select(F.col("id").alias("doc_id"), F.col("item_id").isNotNull().alias("contaminated"), *told)


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns; rows are told by their text, whatever their ids."""
    digest = F.sha2(docs[text_col], 256)
    found = _matches(spark, docs.select(digest.alias("id"), docs[text_col].alias("text")), benchmark, **options)
    gone = found.where("contaminated").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, digest == F.col("__gone"), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
