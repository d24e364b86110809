"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pactspark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Bytes of text that a Python worker gets at once in the pipeline.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH`` bytes, if they may be larger (Spark's default is 64 MB).

    Executor and worker each hold a batch several times, outside the heap, and
    keep much of that memory for later stages. No row depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


#: Bytes of a table that a task reads in the pipeline, rows that it decodes at once, and bytes of a row group of the tables that ``save`` writes.
SPLIT, ROWS, GROUP = 16 << 20, 512, 16 << 20


def small_tasks(spark: SparkSession) -> None:
    """``small_batches``, and the session's scans held to ``SPLIT`` bytes a task and ``ROWS`` rows at once, if they may be larger.

    Under Spark's defaults (128 MB, 4096 rows) each task's share of the heap must
    hold thousands of whole texts and a row group of up to 128 MB that it writes.
    All rows are read; how many tasks they are dealt to depends on it.
    """
    small_batches(spark)
    key = "spark.sql.files.maxPartitionBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > SPLIT:
        spark.conf.set(key, str(SPLIT))
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > ROWS:
        spark.conf.set(key, str(ROWS))


#: Folders of the tables that this process wrote.
_written: list[str] = []


def sweep(spark: SparkSession) -> None:
    """Delete the tables that ``save`` wrote; answers that still read them must be done with."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/pactspark-{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table and read it again: cuts the lineage, survives lost executors.

    A writing task holds a row group until it is full, a reading one while it reads: these are of ``GROUP`` bytes.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _written.append(path.rsplit("/", 1)[0])
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
