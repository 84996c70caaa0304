"""WARC archives with a two-level capture index.

Pages are dealt by ranges of their key (reversed host, then path), and every task writes one archive of gzip members
and one index file: its records in key order as lines in compressed blocks. The sparse block directory has one row a
block (first and last key and id, file, offset, length). A lookup deals what is asked by the bounds of the archives (a
row for each writing task, so few), meets each archive's part of the directory in key order, binary-searches it for the
block, reads that by its byte range, binary-searches its lines, and then reads the records by theirs. The directory
itself is never gathered. Files of a failed task stay unreferenced. A record's id is
that of its place, so it is unique.

Among records of equal payload (SHA-256 of the bytes) of at least ``least_bytes`` bytes the one with the smallest
page_id is a response, the others are revisits without payload. A revisit tells the length of its payload in the
extension field ``WARC-Payload-Length``.

Defined cases of a lookup: a url captured several times gives a row for each capture, one that isn't there none, and a
url asked for twice is answered twice. Of pages: null html is an empty payload; a null or odd url has no host, its key is ``)`` and the text, and control
characters in it are percent-encoded; a row with a null page_id is a revisit if its payload has an id elsewhere, else
a response; rows that share the smallest id are all responses; an empty table gives an empty result; further columns
are not read. One url or host may hold any share of the rows: ranges are cut within it by page_id.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

BLOCK_LINES, BLOCK_BYTES = 500, 4_000_000
DIRECTORY = "first string, first_id long, last string, last_id long, cdx string, offset long, length long, records long"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def capture_key(url: Column) -> Column:
    """com,example,www)/path?query: the labels of the lower-cased host reversed, then the rest without its fragment."""
    host = F.lower(F.regexp_extract(url, r"^[^/?#]*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^[^/?#]*?://[^/?#]*([^#]*)", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(host != "", F.concat(labels, F.lit(")"), rest)).otherwise(F.concat(F.lit(")"), F.coalesce(url, F.lit(""))))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def place_of(key: str, page_id: int | None) -> tuple:
    """A capture's place in the order of the archives: by key, then null ids, then ids."""
    return key, page_id is not None, page_id or 0


def record(row: dict, place: str) -> bytes:
    payload, revisit = row["payload"], row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Page-ID": row["page_id"],
        "WARC-Target-URI": None if row["url"] is None else quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~<>\"\\^`{|}"),
        "WARC-Payload-Digest": "sha1:" + digest32(payload),
        "WARC-Payload-Length": len(payload),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page-ID": row["refers_to"]}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 3, mtime=0)


def parsed(member: bytes) -> dict:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and "sha1:" + digest32(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError("payload and digest differ")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("WARC-Page-ID"),
        "payload_bytes": number("WARC-Payload-Length") if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"][5:],
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
    }


def _write(folder: str):
    schema = pa.schema([(n, pa.string() if n in ("first", "last", "cdx") else pa.int64()) for n in ("first", "first_id", "last", "last_id", "cdx", "offset", "length", "records")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        warc = cdx = None
        lines: list[str] = []
        keys: list[tuple] = []
        at = start = done = 0
        out: list[list] = [[] for _ in schema]

        def close_block() -> None:
            nonlocal done, start
            packed = zlib.compress("\n".join(lines).encode(), 6)
            cdx.write(packed)
            for c, v in zip(out, (*keys[0], *keys[-1], f"{folder}/{name}.cdx", done, len(packed), len(lines)), strict=True):
                c.append(v)
            done, start = done + len(packed), at
            lines.clear()
            keys.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if warc is None:
                    fs.create_dir(path, recursive=True)
                    warc, cdx = (fs.open_output_stream(posixpath.join(path, name + end), compression=None) for end in (".warc.gz", ".cdx"))
                member = record(row, f"{name}/{at}")
                warc.write(member)
                lines.append(json.dumps([row["key"], row["page_id"], f"{name}.warc.gz", at, len(member)]))
                keys.append((row["key"], row["page_id"]))
                at += len(member)
                if len(lines) == BLOCK_LINES or at - start >= BLOCK_BYTES:
                    close_block()
        if lines:
            close_block()
        if warc is not None:
            warc.close()
            cdx.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def write_archives(spark: SparkSession, pages: DataFrame, *, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives and return the block directory. Without a ``folder`` of the caller's they lie in the shared
    folder as long as the application runs."""
    scratch = Scratch(spark, "warc")
    folder = folder or scratch.folder("archives")
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), capture_key(F.col("url")).alias("key"))
    same = F.sha2("payload", 256).alias("same")
    # payloads that occur more than once, written first: their size decides how they are joined
    often = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", same).groupBy("same").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    often = scratch.save(often.where("n > 1 and first_id is not null").select("same", "first_id"), "repeated")
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least_bytes, same)).join(often, "same", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(again, "revisit").otherwise("response")
    rows = rows.select("key", "page_id", "url", "payload", kind.alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return scratch.save(dealt.mapInArrow(_write(folder), DIRECTORY), "directory")


def block_lines(fs, path: str, offset: int, length: int) -> list[list]:
    with fs.open_input_file(path) as f:
        return [json.loads(x) for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]


def _located(cdx: str):
    fs, path = pa.fs.FileSystem.from_uri(cdx)
    return fs, path, posixpath.dirname(path)


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            fs, path, folder = _located(block["cdx"])
            lines = block_lines(fs, path, block["offset"], block["length"])
            start, end = lines[0][3], lines[-1][3] + lines[-1][4]  # the records of a block are neighbours
            with fs.open_input_file(posixpath.join(folder, lines[0][2])) as f:
                raw = f.read_at(end - start, start)
            rows = [parsed(raw[at - start : at - start + n]) for _, _, _, at, n in lines]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names=names)


def read_archives(directory: DataFrame) -> DataFrame:
    """All records, block by block: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return directory.mapInArrow(_read_all, PAGES)


CAPTURES = "url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _dealt(archives, exact: bool):
    """Each row that asks, with every archive that can hold what it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = archives.value
        for batch in batches:
            at, names = [], []
            for i, (key, page_id) in enumerate(zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True)):
                low = place_of(key, page_id) if exact else (key,)
                k = bisect.bisect_left(bounds, low, key=lambda b: b[1])
                while k < len(bounds) and (bounds[k][0] <= low or not exact and bounds[k][0][0] == key):
                    at.append(i)
                    names.append(bounds[k][2])
                    k += 1
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, pa.array(names, pa.string())], names=["url", "key", "page_id", "cdx"])

    return run


def _searched(exact: bool, payloads: bool):
    """Rows of one archive after another: first its blocks in order, then what is asked, by key. A block and the bytes
    of its records are read once for neighbours that fall into it."""
    schema = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def answers(blocks: list[dict], row: dict, kept: dict) -> Iterator[dict]:
        low = place_of(row["key"], row["page_id"]) if exact else (row["key"],)
        k = bisect.bisect_left(blocks, low, key=lambda b: place_of(b["last"], b["last_id"]))
        while k < len(blocks) and (place_of(blocks[k]["first"], blocks[k]["first_id"]) <= low or not exact and blocks[k]["first"] == row["key"]):
            if kept.get("block") is not blocks[k]:
                fs, path, folder = _located(blocks[k]["cdx"])
                lines = block_lines(fs, path, blocks[k]["offset"], blocks[k]["length"])
                kept |= {"block": blocks[k], "lines": lines, "file": (fs, posixpath.join(folder, lines[0][2])), "raw": None}
            lines = kept["lines"]
            i = bisect.bisect_left(lines, low, key=lambda x: place_of(x[0], x[1]))
            while i < len(lines) and place_of(lines[i][0], lines[i][1])[: len(low)] == low:
                if kept["raw"] is None:  # the records of a block are neighbours
                    with kept["file"][0].open_input_file(kept["file"][1]) as f:
                        kept["raw"] = f.read_at(lines[-1][3] + lines[-1][4] - lines[0][3], lines[0][3])
                at = lines[i][3] - lines[0][3]
                yield parsed(kept["raw"][at : at + lines[i][4]])
                i += 1
            k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, blocks, kept, before = None, [], {}, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["cdx"] != archive:
                    archive, blocks, kept, before = row["cdx"], [], {}, None
                if not row["asked"]:
                    blocks.append(row)
                elif not exact or (row["key"], row["page_id"]) != before:  # a place is answered once
                    before = (row["key"], row["page_id"])
                    out += (tuple(row["url"] if f.name == "url" and not exact else r[f.name] for f in schema) for r in answers(blocks, row, kept))
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def lookup(spark: SparkSession, directory: DataFrame, wanted: DataFrame, *, url_col: str = "url", id_col: str | None = None, payloads: bool = False) -> DataFrame:
    """The captures of each url asked for: url, page_id, payload_bytes, payload_digest, record_type, refers_to and, with
    ``payloads``, payload (null of a revisit). With ``id_col`` those of its id alone, and the records of a url and id that
    several rows ask for come once each, with the url as the record tells it."""
    own = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    asked = wanted.select(F.col(url_col).alias("url"), capture_key(F.col(url_col)).alias("key"), own.alias("page_id"))
    # the bounds of the archives: one row for each task that wrote, whatever the number of pages
    place = lambda key, id_: F.struct(F.col(key).alias("key"), F.col(id_).isNotNull().alias("known"), F.coalesce(id_, F.lit(0)).alias("id"))
    bounds = directory.groupBy("cdx").agg(F.min(place("first", "first_id")).alias("low"), F.max(place("last", "last_id")).alias("high")).orderBy("low").collect()
    archives = spark.sparkContext.broadcast([(tuple(r.low), tuple(r.high), r.cdx) for r in bounds])
    dealt = asked.mapInArrow(_dealt(archives, bool(id_col)), "url string, key string, page_id long, cdx string")
    columns = [("first", "string"), ("first_id", "long"), ("last", "string"), ("last_id", "long"), ("offset", "long"), ("length", "long")]
    dealt = dealt.select("*", F.lit(True).alias("asked"), *(F.lit(None).cast(t).alias(n) for n, t in columns))
    blocks = directory.select(F.lit(None).cast("string").alias("url"), F.col("first").alias("key"), F.col("first_id").alias("page_id"), "cdx", F.lit(False).alias("asked"), *(n for n, _ in columns))
    # as many parts as the session asks for, however narrow these rows are: each part reads the archives dealt to it
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.unionByName(dealt).repartition(n, "cdx").sortWithinPartitions("cdx", "asked", "key", F.col("page_id").asc_nulls_first(), "offset")
    return rows.mapInArrow(_searched(bool(id_col), payloads), CAPTURES + ", payload binary" * payloads)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    directory = write_archives(spark, pages)
    return lookup(spark, directory, pages, id_col="page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base-32 digits come from the 40 hex digits of SHA-1, five bits at a time.
ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
b AS (SELECT page_id, octet_length(payload) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
d AS (SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(hex, i, 1)) - 1) AS nibbles FROM b),
e AS (SELECT *, array_to_string(list_transform(range(160), lambda k: CAST((nibbles[1 + k // 4] >> (3 - k % 4)) & 1 AS VARCHAR)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 1 + 5 * g + j, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM e
"""
