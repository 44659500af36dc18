"""Event-time windows (Z10), tumbling and sliding, as a stream and as a batch, and an account of the rows that came too late for them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.checkpoints import shared_folder


def windowed(rows: DataFrame, at: str, width: str, slide: str | None, by: list[str], sums: list[str]) -> DataFrame:
    """(start, end, by, n, sums) of each window. On a stream with a watermark on ``at`` a window is given once, in append mode, when the watermark passes its end, and its state is freed."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    made = rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", *sums)


class LateRows:
    """For foreachBatch: counts by ``by`` the rows of each batch of which no window was open any more.

    The watermark that a batch meets is the latest event time of the batches two and more before it, less the delay, as Spark has it for late rows. Each batch writes its
    own folder whole, so a batch that is run again changes nothing.
    """

    def __init__(self, folder: str, at: str, width_s: int, slide_s: int, delay_s: int, by: list[str]) -> None:
        self.folder, self.at, self.width, self.slide, self.delay, self.by = folder, at, width_s, slide_s, delay_s, by

    def last_end(self) -> Column:
        """The end of the last window that holds a row, in seconds."""
        return F.floor(F.unix_seconds(F.col(self.at)) / self.slide) * self.slide + self.width

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = f"{self.folder}/latest"
        batch.agg(F.max(self.at).alias("latest")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{latest}/{number}")
        before = self._latest(spark, number - 1)  # one value
        late = batch.where(self.last_end() <= F.unix_seconds(F.lit(before)) - self.delay) if before is not None else batch.limit(0)
        late.groupBy(*self.by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/late/{number}")

    def _latest(self, spark: SparkSession, below: int):
        seen = spark.read.schema("latest timestamp, batch int").option("recursiveFileLookup", True).parquet(f"{self.folder}/latest")
        return seen.where(F.col("batch") < below).agg(F.max("latest")).first()[0]

    def counts(self, spark: SparkSession, schema: str) -> DataFrame:
        read = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/late")
        return read.groupBy(*self.by).agg(F.sum("n").alias("n"))


def replay(rows: DataFrame, arrival: str, at: str, width: str, slide: str | None, delay: str, by: list[str], sums: list[str], late: LateRows | None = None) -> DataFrame:
    """Streams a table through ``windowed``, a batch for each value of ``arrival`` in order, in a folder of its own; late, if given, sees the same batches."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    plain = rows.drop(arrival)
    # one file a batch, written in order, so that the source takes them in order
    for (n,) in rows.select(arrival).distinct().orderBy(arrival).collect():
        rows.where(F.col(arrival) == n).drop(arrival).coalesce(1).write.mode("append").parquet(f"{folder}/in/{n:06d}")
    source = lambda: spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{folder}/in")
    out = windowed(source().withWatermark(at, delay), at, width, slide, by, sums)
    start = lambda w, name: w.option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    start(out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), "state").awaitTermination()
    if late is not None:
        start(source().writeStream.foreachBatch(late), "late-state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
