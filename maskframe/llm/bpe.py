"""BPE encoding and decoding over a distinct-word table.

Documents are split into words (pre-tokens) in blocks of about 16 million characters. A block keeps its documents as
positions in its own list of distinct words; the words go, packed by hash bucket, to the one task that owns the bucket,
which encodes each distinct word of the corpus once. The ids come back to the block and are joined to the documents by
position. Decoding joins the ids of the words with the pieces of the vocabulary and puts words together by position.

Text itself is never shuffled, and packed documents are laid out by block when written, so only words and ids move:
what moves is a few bytes a word, and a word moves once a block, however frequent it is,
so no key is hot. A task holds one block, or the distinct words of one bucket; buckets follow spark.sql.shuffle.partitions.
The tokenizer file (its size is that of the vocabulary, not of the data) is broadcast.

Defined cases: null text counts as empty, with no ids; strings of added tokens in a text become their ids, as the
tokenizers library does by default; rows that share an id stay separate rows; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

BLOCK_CHARS = 16_000_000
#: Fixed value: the public pattern of byte-level BPE that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Words:
    """Splits text as the tokenizer file says; the files this engine reads split by PATTERN and match added tokens plainly."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        before = parsed["pre_tokenizer"] or {}
        if parsed["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("the tokenizer must be byte-level BPE without a normaliser")
        added = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parsed["added_tokens"]):
            raise ValueError("added tokens must match plainly")
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.marks = added
        self.find = regex.compile(PATTERN).findall

    def __call__(self, text: str) -> list[str]:
        if not any(m in text for m in self.marks):
            return self.find(text)
        out: list[str] = []
        for i, part in enumerate(self.added.split(text)):
            out += [part] if i % 2 else self.find(part)
        return out


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 and up."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in printable else next(rest)): b for b in range(256)}


def pieces(spec: str) -> list[bytes]:
    """The bytes of each id."""
    parsed, alphabet = json.loads(spec), byte_of_char()
    vocab = parsed["model"]["vocab"]
    added = {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
    out = [b""] * (max([*vocab.values(), *added]) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(alphabet[c] for c in piece)
    for i, content in added.items():
        out[i] = content
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers as byte planes, compressed."""
    flat = np.concatenate([np.array([len(arrays), *map(len, arrays)], np.uint32), *(a.astype(np.uint32) for a in arrays)])
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(blob: bytes) -> list[np.ndarray]:
    flat = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    sizes = flat[1 : 1 + flat[0]].astype(np.int64)
    return np.split(flat[1 + flat[0] :], np.cumsum(sizes)[:-1])


def _give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one step leaves is held beside the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Distinct words that a task holds at once.
MAX_KNOWN = 2_000_000


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


PACKED = "kind string, block long, bucket int, ids array<long>, places binary, words binary"


def _blocks(split: Words, buckets: int, block_chars: int):
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("places", pa.binary()), ("words", pa.binary())])

    def packed(block: int, numbers: _Numbers, docs: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(numbers), np.int64)
        for _, places in docs:
            np.add.at(counts, places, 1)
        rank = np.empty(len(numbers), np.uint32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(numbers))  # frequent words get small numbers
        for i in range(0, len(docs), 512):  # documents packed together compress better than each of them
            part = docs[i : i + 512]
            sizes = np.array([len(p) for _, p in part], np.uint32)
            cells = [["doc"], [block], [None], [[x for x, _ in part]], [_pack(rank[np.concatenate([p for _, p in part])], sizes)], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
        every = list(numbers)
        bucket_of = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) % buckets for w in every), np.int64, len(every))
        by_bucket = np.argsort(bucket_of, kind="stable")
        bounds = np.searchsorted(bucket_of[by_bucket], np.arange(buckets + 1))
        compress = zstandard.ZstdCompressor(level=3).compress
        cells = [[], [], [], [], [], []]
        for bucket in np.unique(bucket_of).tolist():  # words of one bucket at a time, so that few are held twice
            found = sorted((every[k].encode(), k) for k in by_bucket[bounds[bucket] : bounds[bucket + 1]].tolist())
            sizes = np.array([len(w) for w, _ in found], np.uint32)
            row = ("words", block, bucket, None, _pack(rank[[k for _, k in found]], sizes), compress(b"".join(w for w, _ in found)))
            for c, v in zip(cells, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers, docs, chars = TaskContext.get().partitionId() << 24, _Numbers(), [], 0
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):  # few texts as Python strings
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = split(text or "")
                docs.append((id_, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
                chars += len(text or "")
                if chars >= block_chars:
                    yield from packed(block, numbers, docs)
                    block, numbers, docs, chars = block + 1, _Numbers(), [], 0
                    _give_back()
        if docs:
            yield from packed(block, numbers, docs)
            del numbers, docs
            _give_back()

    return run


@lru_cache(maxsize=1)
def _tokenizer(spec: str):
    """The library's tokenizer, made once in a worker: one that has encoded leaves about 11 MB behind when it is dropped, so one
    for each task would fill a worker that is used again and again."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encode(spec):
    """Each distinct word of the task's buckets once; the ids go back to the blocks."""
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for block, places, words in zip(batch.column("block").to_pylist(), batch.column("places").to_pylist(), batch.column("words").to_pylist(), strict=True):
                at, sizes = _unpack(places)
                raw, ends = zstandard.ZstdDecompressor().decompress(words), np.cumsum(sizes).tolist()
                cut = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                new = [w for w in cut if w not in known]
                if len(known) + len(new) > MAX_KNOWN:  # then words may be encoded again, but memory stays bounded
                    known, new = {}, cut
                for w, e in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.uint32).tobytes()
                ids = [known[w] for w in cut]
                blob = _pack(np.frombuffer(b"".join(ids), np.uint32), np.array([len(i) // 4 for i in ids], np.uint32))
                cells = [[block], [_pack(at)], [blob]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
        del known
        _give_back()

    return run


def _joined(piece_of, keep: bool):
    """Join by position: documents of a block with the ids, and through them the pieces, of the block's words."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * keep
    )

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        piece = piece_of.value
        at = [_unpack(x)[0] for x in words.column("places").to_pylist()]
        size = 1 + max((int(a.max()) for a in at if len(a)), default=-1)
        text, raw, count, kept = [""] * size, [b""] * size, np.zeros(size, np.int64), [()] * size
        for places, blob in zip(at, words.column("ids").to_pylist(), strict=True):
            flat, sizes = _unpack(blob)
            count[places] = sizes
            ids, ends = flat.tolist(), np.cumsum(sizes).tolist()
            for k, a, b in zip(places.tolist(), [0, *ends[:-1]], ends, strict=True):
                own = ids[a:b]
                text[k], raw[k] = ",".join(map(str, own)), b"".join([piece[i] for i in own])
                if keep:
                    kept[k] = own
        cells: list[list] = [[] for _ in schema]
        packs = zip(docs.column("ids").to_pylist(), map(_unpack, docs.column("places").to_pylist()), strict=True)
        for id_, places in ((x, p) for xs, (every, sizes) in packs for x, p in zip(xs, np.split(every, np.cumsum(sizes.astype(np.int64))[:-1]), strict=True)):
            own = places.tolist()
            decoded = b"".join([raw[k] for k in own])
            row = [id_, int(count[places].sum()), hashlib.sha256(",".join([text[k] for k in own]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
            if keep:
                row += [[i for k in own for i in kept[k]], decoded.decode()]
            for c, v in zip(cells, row, strict=True):
                c.append(v)
        del text, raw, kept, at
        _give_back()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    return run


def encode_decode(
    spark: SparkSession, docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids: and ids, decoded.

    ``tokenizer`` is the path of a tokenizers JSON file on the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        whole = f.read()
    # the file is parsed on the driver: parsed in a worker it takes more memory than a block
    spec, piece_of = spark.sparkContext.broadcast(whole), spark.sparkContext.broadcast(pieces(whole))
    scratch = Scratch(spark, "bpe")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    packed = scratch.save_bucketed(texts.mapInArrow(_blocks(Words(whole), buckets, block_chars), PACKED), "blocks", "block", buckets)
    words = packed.where("kind = 'words'").select("bucket", "block", "places", "words")
    ids = words.repartitionById(buckets, F.col("bucket").cast("int")).select("block", "places", "words").mapInArrow(_encode(spec), "block long, places binary, ids binary")
    of_docs = packed.where("kind = 'doc'").select("block", "ids", "places")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return of_docs.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_joined(piece_of, with_ids), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark, table(spark, sf_dir, "documents"), default_tokenizer())
