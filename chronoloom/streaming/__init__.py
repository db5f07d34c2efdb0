"""Structured Streaming jobs: each reads files as they come and may be stopped and started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocabulary import APPROVAL, approval_stream, current_entries

__all__ = ["APPROVAL", "approval_stream", "current_entries", "staged_run"]


def staged_run(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, stage) -> None:
    """T-R1: apply a stage (DataFrame -> DataFrame) to new files only; files that were done are skipped by the checkpoint."""
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
