"""The folder that driver and executors share, for checkpoints and results of streams that a query runs to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the application ends; without that setting, on one machine
    alone, below a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='maskframe-')}")
        top = _own[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append what a stream gives for all that is there now to the folder ``out``; the table of that folder."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
