"""Session documents in JSON: scans, versions, encodings of transcripts, and the resumable stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = "struct<turn_ids:array<string>,start_ms:bigint,end_ms:bigint>"
TURN = "struct<id:string,start_ms:bigint,end_ms:bigint,text:string,physical_speaker:string,confidence:double,confidence_kind:string,speaker_coverage:double,speaker_purity:double>"
FIXTURE = f"""session struct<id:string,recording:string,title:string,note:string>, engine_output struct<engine:string,engine_version:string,turns:array<{TURN}>>,
 expected_analysis struct<summary:string,scenes:array<struct<id:string,title:string,summary:string,turn_ids:array<string>>>,entities:array<struct<id:string,name:string,kind:string,aliases:array<string>,turn_ids:array<string>>>,
 threads:array<struct<id:string,description:string,turn_ids:array<string>>>,review_questions:array<struct<id:string,issue:string,recommendation:string,why_it_matters:string,turn_ids:array<string>,confidence:double,consequence:string>>>"""
SESSION = f"""schema_version string, session_id string, source map<string,string>, status string, turns array<{TURN}>, scenes array<struct<id:string,title:string,summary:string,evidence:{EVIDENCE}>>,
 entities array<struct<id:string,name:string,kind:string,aliases:array<string>,evidence:{EVIDENCE}>>, threads array<struct<id:string,description:string,evidence:{EVIDENCE}>>,
 review_questions array<struct<id:string,issue:string,recommendation:string,why_it_matters:string,evidence:{EVIDENCE},confidence:double,consequence:string,status:string>>, summary string, processor_artifacts map<string,string>"""
# Versions that can be read, and what an old confidence is taken to mean.
VERSIONS = ("0.1", "0.2")
UNSTATED = "unstated"
STAGES = ("imported", "transcribed", "analyzed", "review_ready")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the storage that driver and executors share: below spark.checkpoint.dir; where that is unset, in a local temporary folder, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/chronoloom"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: made once, whoever reads it, and still there when an executor is lost."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, where its files give fewer splits than there are cores (so it is small); what is read in more splits stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURE).option("multiLine", True).json(path)


def fixture_turns(docs: DataFrame) -> DataFrame:
    """Turns of fixtures; a confidence without a kind was declared."""
    x = docs.select(F.col("session.id").alias("session_id"), F.posexplode("engine_output.turns").alias("ord", "t")).select("session_id", "ord", "t.*")
    return x.withColumn("confidence_kind", F.when(F.col("confidence").isNotNull() & (F.trim(F.coalesce("confidence_kind", F.lit(""))) == ""), "declared").otherwise(F.col("confidence_kind")))


def fixture_claims(docs: DataFrame, group: str) -> DataFrame:
    """Declared scenes, entities, threads or review_questions."""
    return docs.select(F.col("session.id").alias("session_id"), F.posexplode(f"expected_analysis.{group}").alias("ord", "c")).select("session_id", "ord", "c.*")


def sessions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """S3: session documents; a version that can't be read raises (strict) or is marked.  Version 0.1 had confidences without a kind."""
    x = spark.read.schema(SESSION).json(path)
    ok = F.coalesce(F.col("schema_version").isin(*VERSIONS), F.lit(False))
    if strict:
        x = x.withColumn("schema_version", F.when(ok, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("unreadable session version "), F.coalesce("schema_version", F.lit("(none)")))).cast("string")))
    else:
        x = x.withColumn("readable", ok)
    old = (F.col("schema_version") == "0.1") & F.lit(True)
    fix = lambda t: t.withField("confidence_kind", F.when(old & t["confidence"].isNotNull() & (F.trim(F.coalesce(t["confidence_kind"], F.lit(""))) == ""), F.lit(UNSTATED)).otherwise(t["confidence_kind"]))
    return x.withColumn("turns", F.transform("turns", fix)).withColumn("schema_version", F.when(old, F.lit("0.2")).otherwise(F.col("schema_version")))


def lenient(spark: SparkSession, path: str) -> DataFrame:
    """Session documents as variants, for scoring: whatever parses is kept, and what is missing is null."""
    text = spark.read.text(path).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("doc"))
    get = lambda p, k: F.try_variant_get("doc", p, k)
    return text.select("path", get("$.session_id", "string").alias("session_id"), get("$.summary", "string").alias("summary"), get("$.turns", "variant").alias("turns"), "doc")


def transcript(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """session_id, id, text, confidence of a canonical session, a recogniser's JSON, or window files.  A recogniser's blank texts are dropped, but ids keep the original index."""
    if encoding == "canonical":
        return spark.read.schema(SESSION).json(path).select("session_id", F.explode("turns").alias("t")).select("session_id", "t.id", "t.text", "t.confidence")
    if encoding == "recogniser":
        from .engines import recognised

        x = recognised(spark, path).filter(F.trim("text") != "")
        return x.select("session_id", F.format_string("t%04d", "ord").alias("id"), F.trim("text").alias("text"), "confidence")
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    x = spark.read.option("wholetext", True).text(path).select(stem.alias("session_id"), F.posexplode(F.split(F.col("value"), "\n")).alias("i", "text")).filter(F.trim("text") != "")
    return x.select("session_id", F.concat("session_id", F.format_string("-%04d", F.col("i"))).alias("id"), "text", F.lit(None).cast("double").alias("confidence"))


def pending(sessions_: DataFrame, done: DataFrame, stage: str) -> DataFrame:
    """T-R1, C8: sessions that have come to the stage before this one and have no output of it yet."""
    if stage not in STAGES[1:]:
        raise ValueError(f"{stage!r} is not one of {STAGES[1:]}")
    before = STAGES[STAGES.index(stage) - 1]
    return sessions_.filter(F.col("status") == before).join(done.select("session_id"), "session_id", "left_anti")
