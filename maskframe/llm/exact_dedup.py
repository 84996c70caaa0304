"""Exact dedup by stateful streaming (DataFrame and SQL functions only).

A digest table is read as a stream into keyed state that RocksDB keeps on disk and that never expires. Per digest the
state holds the stable identifier of the row that stays (largest id), its content locator (file and row) and the
number of rows. A digest with more than one row is a hit: the full bytes of its rows are compared, and rows whose
bytes differ in spite of equal digests are grouped by the bytes themselves.

Defined cases: null text counts as empty; a null id is smaller than any id; of rows with equal text and equal id the
one with the largest locator stays, so one row of a group stays; an empty table gives an empty result; further
columns of the input are not read.

Scale: text crosses the network once, for the byte check, dealt by (digest, salt) so that one large group spreads over
``SALTS`` partitions; its minimum and maximum are pre-aggregated, so no task ever holds a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SALTS = 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(docs, id + text + locator). Rows that don't come from files get files, as a stream needs a source to replay."""

    def view(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select(
            df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"), meta["file_path"].alias("file"), meta["row_index"].alias("row")
        )

    try:
        return docs, view(docs)
    except AnalysisException:
        docs = scratch.save(docs, "source")
        return docs, view(docs)


def stream_state(spark: SparkSession, digests: DataFrame, scratch: Scratch, files_per_trigger: int | None = None) -> DataFrame:
    """Run the digest table through the keyed state: digest, winner(id, file, row), n. Every run has a state of its own;
    within it, a batch that fails is done again from the checkpoint."""
    session = spark.newSession()
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # many small stores: no files laid out ahead, and logs of changes in place of snapshots
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # a store is closed when its task ends, so that its memory is free for what runs next on the executor
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        session.conf.set(key, value)
    out = scratch.folder("state-rows")
    reader = session.readStream.schema(digests.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    state = (
        reader.parquet(digests._maskframe_path)
        .groupBy("digest")
        .agg(F.max(F.struct("id", "file", "row")).alias("winner"), F.count(F.lit(1)).alias("n"))
    )
    query = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", scratch.folder("state"))
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if digests.isEmpty():
        return spark.createDataFrame([], state.schema)
    rows = spark.read.schema(state.schema).parquet(out)
    # each batch tells a digest's state so far; winner and n only ever grow
    return rows.groupBy("digest").agg(F.max("winner").alias("winner"), F.max("n").alias("n"))


def grouped(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_trigger: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(docs as read, rows of id, file, row, digest, sha, winner, n): one row per input row."""
    scratch = Scratch(spark, "exact-dedup")
    docs, rows = located(docs, scratch, id_col, text_col)
    digests = scratch.save(rows.select("id", "file", "row", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha")), "digests")
    state = scratch.save(stream_state(spark, digests, scratch, files_per_trigger), "state-table")
    hits = state.where("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    texts = rows.select("*", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("file", "row"), F.lit(SALTS)).cast("int").alias("salt"))
    bounds = (
        texts.join(hits, ["digest", "salt"], "left_semi")
        .groupBy("digest", "salt")
        .agg(F.min("text").alias("least"), F.max("text").alias("most"))
        .groupBy("digest")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"))
    )
    unequal = scratch.save(bounds.where("least <> most").select("digest"), "unequal")
    found = digests.join(state, "digest")
    if not unequal.isEmpty():  # equal digests of different bytes: the bytes decide
        again = texts.join(unequal, "digest", "left_semi").drop("salt")
        groups = again.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("winner"), F.count(F.lit(1)).alias("n"))
        right = again.join(groups, ["digest", "text"]).select("file", "row", F.struct("winner", "n").alias("right"))
        found = (
            found.join(right, ["file", "row"], "left")
            .withColumn("winner", F.coalesce("right.winner", "winner"))
            .withColumn("n", F.coalesce("right.n", "n"))
            .drop("right")
        )
    return docs, found.withColumn("kept", F.expr("file = winner.file and row = winner.row"))


def exact_dedup(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    _, rows = grouped(spark, docs, **options)
    return rows.select(
        F.col("id").alias("doc_id"), F.col("winner.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256")
    )


def without_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs, rows = grouped(spark, docs, **options)
    meta = docs.metadataColumn("_metadata")
    gone = rows.where(~F.col("kept")).select(F.col("file").alias("__gone_file"), F.col("row").alias("__gone_row"))
    return docs.join(gone, (meta["file_path"] == F.col("__gone_file")) & (meta["row_index"] == F.col("__gone_row")), "left_anti")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
