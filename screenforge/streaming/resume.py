"""Resumable batch processing: only batch files that no earlier run has finished are read.

A file stream with an available-now trigger keeps the list of finished files in its checkpoint,
commits output exactly once and stops when nothing is left, so an interrupted run goes on where
it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_batches(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema, transform: Callable[[DataFrame], DataFrame],
    files_per_step: int = 64,
) -> None:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(source)
    job = (
        transform(rows).writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    job.awaitTermination()
