"""Where reliable checkpoints and files of the engine's own go."""

from __future__ import annotations

import tempfile
import uuid

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


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it survives lost executors and ends the plan's lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: for what is read again and again by a few of its columns."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
