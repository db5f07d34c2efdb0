"""Ids and clocks of turns that follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: str = "session_id", order: str = "ord", form: str = "t%05d", name: str = "id") -> DataFrame:
    """Ids without gaps, from zero.  format_string, as lpad would cut longer numbers."""
    return df.withColumn(name, F.format_string(form, F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1))


def turn_clock(df: DataFrame, by: str = "session_id", order: str = "ord", word_ms: int = 400, gap_ms: int = 400) -> DataFrame:
    """Start and end of each turn when a word takes word_ms and turns are gap_ms apart.  One shuffle by session serves ids and clock."""
    w = Window.partitionBy(by).orderBy(order)
    length = F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\S+"))).cast("bigint") * word_ms
    out = df.withColumn("_ms", length).withColumn("id", F.format_string("t%05d", F.row_number().over(w) - 1)).withColumn("end_ms", F.sum(F.col("_ms") + gap_ms).over(w) - gap_ms)
    return out.withColumn("start_ms", F.col("end_ms") - F.col("_ms")).drop("_ms")
