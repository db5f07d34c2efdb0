"""Importers of what recognisers and diarisers write, as rows of segments, spans and frames.  Running an engine is a plug: a callable that yields these rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECOGNISED = "transcription array<struct<offsets:struct<`from`:bigint,`to`:bigint>,text:string,tokens:array<struct<text:string,p:double>>>>"
DIARISED = "segments array<struct<start:double,`end`:double,speaker:int>>"


def token_confidence(tokens) -> Column:
    """P10: mean probability of the tokens that are not special; null if there are none."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    real = F.filter(tokens, lambda x: ~F.startswith(x.getField("tok"), F.lit("[_")))
    total = F.aggregate(real, F.lit(0.0), lambda a, x: a + x["p"])
    return F.round(F.try_divide(total, F.size(real).cast("double")), 6)


def speaker_label(n) -> Column:
    return F.format_string("SPEAKER_%02d", n)


def _documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Documents with session_id: a file is one document and names it; with `lines` a line is one, named by its field `recording`, so that there need not be a file for each recording."""
    if lines:
        return spark.read.schema(f"recording string, {schema}").json(path).withColumnRenamed("recording", "session_id")
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("session_id", F.input_file_name())


def recognised(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A recogniser's JSON documents -> session_id (file or recording), ord, start_ms, end_ms, text, confidence."""
    x = _documents(spark, path, RECOGNISED, lines).select("session_id", F.posexplode("transcription").alias("ord", "s"))
    tokens = F.transform("s.tokens", lambda q: F.struct(q["text"].alias("tok"), q["p"].alias("p")))
    return x.select("session_id", "ord", F.col("s.offsets.from").alias("start_ms"), F.col("s.offsets.to").alias("end_ms"), "s.text", token_confidence(tokens).alias("confidence"))


def diarised(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A diariser's JSON documents -> session_id (file or recording), ord, start_ms, end_ms, label."""
    x = _documents(spark, path, DIARISED, lines).select("session_id", F.posexplode("segments").alias("ord", "s"))
    ms = lambda c: F.bround(F.col(c) * 1000).cast("bigint")
    return x.select("session_id", "ord", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), speaker_label(F.col("s.speaker")).alias("label"))


def loudness(text) -> Column:
    """The levels in a decoder's report, in order; what is not finite is the floor of -120."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(r"RMS_level=(\S+)"), F.lit(1))
    return F.transform(found, lambda x: F.coalesce(F.when(x.rlike(r"^-?\d"), x.try_cast("double")), F.lit(-120.0)))
