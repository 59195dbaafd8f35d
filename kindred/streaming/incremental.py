"""An extension: entities that arrive as a stream are linked to a fixed pool of targets, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import rules


def linked_stream(arriving: DataFrame, targets: DataFrame, rule: str, out: str) -> DataStreamWriter:
    """A writer that appends (batch_id, s1_id, target_id) of each micro-batch to the Parquet folder out.

    arriving: a stream of records of source 1. A batch that is run again writes the same folder again, so each link is
    there once.
    """
    pool = rules.normalised(targets)

    def link(batch: DataFrame, batch_id: int) -> None:
        norm = rules.normalised(batch).unionByName(pool)
        found = rules.matches(norm, rule).withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return arriving.writeStream.foreachBatch(link)
