"""Shared folder, materialisation and hashing helpers of the pipeline operators.

Every cut of lineage is a parquet table in the folder that the cluster names in ``spark.checkpoint.dir``; only where
that setting is missing and the master is local (unit tests on one machine) a folder of our own is used. Tables that
are read a few times and are cheap to make again are kept on the executors' disks instead, with their lineage: a lost
executor's part is computed again. Every file that an executor writes costs processes for its permissions, so small
steps had better not write any.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit mixers; any odd constants do.
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "made" not in _own:
            _own["made"] = f"file://{tempfile.mkdtemp(prefix='maskframe-')}"
        found = _own["made"]
    return found.rstrip("/")


class Scratch:
    """A folder for the intermediate tables of one run, removed when the application ends; ``drop`` removes a table that
    is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.held: list[DataFrame] = []
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def folder(self, name: str) -> str:
        self.count += 1
        return f"{self.path}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Write ``df`` as parquet and return the table as read again."""
        path = self.folder(name)
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._maskframe_path = path
        return out

    def save_narrow(self, df: DataFrame, name: str) -> DataFrame:
        """As ``save``, for a table of few bytes a row behind a shuffle: into at most four files for each core that the
        application has, however many parts the shuffle dealt it to."""
        return self.save(df, name, 4 * self.spark.sparkContext.defaultParallelism)

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As ``save``, laid out by the hash of ``key``: a later grouping by it over as many partitions needs no shuffle. The
        catalog knows the table only until its plan is made; what is read later are the files."""
        path, known = self.folder(name), f"maskframe_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(known)
        out = self.spark.table(known)
        self.spark.sql(f"DROP TABLE {known}")
        out._maskframe_path = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, computed once and kept on the executors' disks until ``let_go``. What is kept should be made from written
        tables in few steps: plans of kept tables are told whole wherever they are read."""
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def let_go(self, *tables: DataFrame) -> None:
        """Stop keeping ``tables``, or all."""
        for df in tables or self.held:
            df.unpersist()
        self.held = [df for df in self.held if tables and not any(df is t for t in tables)]

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._maskframe_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now, not at the driver's next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_each(rows: DataFrame, each: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join with a table that holds each key once, whatever share of the rows a key has. At most ``share`` keys can
    hold one in ``share`` of the rows, so these are few enough to be sent to all tasks with what belongs to them; the
    other keys are joined by a shuffle, and rows without a key by none."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    hot = counts.join(F.broadcast(total), F.col("__n") * share >= F.col("__all")).select(key)  # at most ``share`` rows
    kinds = {f.name: f.dataType for f in each.schema if f.name != key}
    cold = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(each, key, "left")
    dealt = rows.join(F.broadcast(each.join(F.broadcast(hot), key, "right")), key)
    none = rows.where(F.col(key).isNull()).withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    return cold.unionByName(dealt).unionByName(none)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of (x, y), elementwise. Each step is mixed, so no identity of sums or polynomials carries over to longer runs."""
    t = x * MIX_A
    t += y
    t ^= t >> np.uint64(29)
    t *= MIX_B
    t ^= t >> np.uint64(32)
    return t


#: Separators between words: space and x09 to x0D.
SEPARATES = np.zeros(256, bool)
SEPARATES[[9, 10, 11, 12, 13, 32]] = True
#: A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: The lower 0 to 8 bytes of a lane.
LOWER = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
SHORT = 32


def lanes(data: bytes | np.ndarray) -> np.ndarray:
    """The 8 bytes from every position of ``data`` but the last 7 as a number: a view, without a copy."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def hashed_words(texts: list[bytes], fold: bool = False, seed: int = 0, separates: np.ndarray = SEPARATES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end): words are runs of bytes that don't separate. With ``fold``,
    A-Z count as a-z. A word is hashed by its length and its bytes, eight at a time, mixed after each eight."""
    data = np.frombuffer(b"\n".join([*texts, b""]) + bytes(8), np.uint8)
    if fold:
        data = FOLD[data]
    inside = np.zeros(len(data) - 8 + 1, np.int8)
    inside[1:] = ~separates[data[:-8]]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    length, eight = end - start, lanes(data)
    h = mixed(length.astype(np.uint64) * STEP + np.uint64(seed))
    which = np.arange(len(start))
    for at in range(0, SHORT, 8):
        which = which[(length[which] > at) & (length[which] <= SHORT)]
        lane = eight[start[which] + at] & LOWER[np.minimum(length[which] - at, 8)]
        h[which] = mixed(paired(h[which], lane))
    for k in np.flatnonzero(length > SHORT).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed=seed)
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(start, ends)


def in_chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is a range of its own."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def doubled(v: np.ndarray, have: int, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` from those of all runs of ``have``: runs are paired to twice their length, and those
    of a length in between are made of two that overlap."""
    while 2 * have <= length:
        v = paired(v[: max(0, len(v) - have)], v[have:])
        have *= 2
    rest = length - have
    return paired(v[: max(0, len(v) - rest)], v[rest:]) if rest else v


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all windows of ``length`` consecutive word hashes; equal windows have equal hashes."""
    return doubled(mixed(h), 1, length)
