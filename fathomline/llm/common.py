"""What the operators of this subpackage share: reading tables, batch sizes, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from fathomline.sources.tables import spread

#: Rows and bytes of an Arrow batch handed to Python: bounds a worker's memory whatever the row count.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: For Python workers, which stay between tasks: what they free goes back to the system, instead of being kept by each.
LEAN = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: The tables that the innermost settled() has seen written so far.
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, dealt out to all cores where its files give fewer tasks."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(df: DataFrame) -> DataFrame:
    """Let Arrow batches hold few rows, as texts can be megabytes long, and workers keep little."""
    conf, env = df.sparkSession.conf, df.sparkSession.sparkContext.environment
    env.update({k: v for k, v in LEAN.items() if k not in env})
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only where the session names none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends here and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a written table; the tables that were written on the way to it are deleted."""
    before = _passing.set(passing := [])
    try:
        out = make()
        _passing.reset(before)
        before = None
        return written(out)
    finally:
        if before is not None:
            _passing.reset(before)
        for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, passing):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """The rows of df as a bucketed table in the warehouse: joins and groups on the column by read it without a shuffle.

    For rows that are compressed already.
    """
    spark, name = df.sparkSession, f"t_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "uncompressed").bucketBy(buckets, by).saveAsTable(name)
    return spark.table(name)
