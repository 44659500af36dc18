"""Late evidence as a stream (Z6): sessions that close after their edges were published are still taken, by the batch rule of ``consolidate.late_claims``.

Each batch of closed sessions is joined with the edges as they stand and its claims replace those of the same batch number; so a batch that is run
again, after a failure or by hand, changes nothing. A claim that several batches make is one claim.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import consolidate
from weftline.operators.checkpoints import shared_folder


class LateClaims:
    """For foreachBatch. edges: as ``late_claims`` takes them, read anew for each batch: so a table, not what is made of one."""

    def __init__(self, edges: DataFrame, folder: str) -> None:
        self.edges, self.folder = edges, folder
        self.columns = ["provenance_id", "edge_key", "sources", "target", "edge_type", "mechanism", "transform", "exact", "scope", "session_complete"]

    def __call__(self, batch: DataFrame, number: int) -> None:
        claims = consolidate.late_claims(batch, self.edges, consolidate.late_shapes(batch)).select(*self.columns, F.lit(number).alias("batch"))
        claims.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.folder)

    def claims(self) -> DataFrame:
        """Every claim once, with the number of the batch that made it first."""
        schema = "provenance_id string, edge_key string, sources array<string>, target string, edge_type string, mechanism string, transform string, exact boolean, scope string, session_complete boolean, batch int"
        read = self.edges.sparkSession.read.schema(schema).parquet(self.folder)
        others = [c for c in self.columns if c not in ("provenance_id", "edge_key")]
        return read.groupBy("provenance_id", "edge_key").agg(F.min_by(F.struct(*others), "batch").alias("claim"), F.min("batch").alias("batch")).select("provenance_id", "edge_key", "claim.*", "batch")


def replay(observed: DataFrame, edges: DataFrame, files: int = 4, again: int | None = None) -> DataFrame:
    """Streams a table of observed rows through ``LateClaims`` in so many batches, in a folder of its own; the batch ``again``, if given, is run a second time."""
    spark = observed.sparkSession
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    observed.repartition(files).write.parquet(f"{folder}/in")
    claims = LateClaims(edges, f"{folder}/claims")
    stream = spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def take(batch: DataFrame, number: int) -> None:
        claims(batch, number)
        if number == again:
            claims(batch, number)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return claims.claims()
