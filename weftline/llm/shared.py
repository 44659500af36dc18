"""What the operators share with the cluster: its checkpoint folder and its parallelism."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only a local session, as in tests, gets a folder of its own where that is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return named or context.getCheckpointDir()


#: Rows of an Arrow batch: texts are long, and both sides of a Python worker hold whole batches, outside the JVM's heap.
BATCH_ROWS = 512


def hold_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS rows, unless it has asked for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def kept(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: it survives lost executors and cuts the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
