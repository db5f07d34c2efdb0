"""Answer keys: where they are, their targets and the names in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "label:string,kind:string,status:string,evidence:string,anchor_ms:bigint,basis:string"
SCHEMA = f"""schema_version string, id string, title string, corpus_tier string,
 source struct<landing_url:string,media_url:string,publisher:string,published_at:string,accessed_at:string,episode_duration_ms:bigint,media_bytes:bigint,media_sha256:string,content_fingerprint:struct<method:string,path:string,sha256:string>>,
 excerpt struct<start_ms:bigint,end_ms:bigint,timestamp_basis:string,verification:string>,
 recording_conditions struct<capture_layout:string,production:string,expected_physical_speakers:int,proven_distinct_speakers:int,overlap:string,music_or_effects:boolean,observations:string>,
 `references` struct<caption_or_transcript:string,reference_url:string,speaker_labels:boolean,annotation_status:string>,
 truth struct<important_entities:array<struct<{TARGET}>>,important_events:array<struct<{TARGET}>>,notes:string,threads:array<struct<label:string,first_anchor_ms:bigint,last_anchor_ms:bigint,evidence:string>>,method:string,contaminating_providers:array<string>,negative_controls:array<struct<term:string,kind:string,rationale:string>>>,
 rights struct<copyright_holder:string,license:string,license_url:string,local_processing:string,redistribution:string,review_notes:string,accessed_at:string>,
 selection struct<r0_status:string,diagnostic_value:string,risks:array<string>>"""


def resolve(reference: str, folder: str) -> str:
    """A manifest's path as given, or by its id in the folder."""
    return reference if reference.endswith(".json") or "/" in reference else f"{folder.rstrip('/')}/{reference}.json"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every manifest below path, each with its text and, if it parses, its contents; a bad file does not hurt the others."""
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    whole = text.withColumn("manifest", F.from_json("text", SCHEMA, {"mode": "PERMISSIVE"}))
    return whole.withColumn("parses", F.try_parse_json("text").isNotNull())


def targets(manifests: DataFrame) -> DataFrame:
    """One row a target, with its place in the document."""
    out = None
    for group in ("important_entities", "important_events"):
        x = manifests.select(F.col("id").alias("manifest_id"), F.posexplode_outer(f"truth.{group}").alias("i", "t")).filter("t is not null")
        x = x.select("manifest_id", F.lit(group).alias("grp"), "i", F.format_string(f"truth.{group}[%d]", F.col("i")).alias("path"), "t.*")
        out = x if out is None else out.unionByName(x)
    return out


def truth_names(targets_: DataFrame) -> DataFrame:
    """Verified entities of one or two words that do not open with an article."""
    words = F.split(F.trim("label"), r"\s+")
    named = targets_.filter("grp = 'important_entities' and status = 'verified'").withColumn("name", F.trim("label")).withColumn("_w", words)
    return named.filter(F.size("_w").between(1, 2) & ~F.lower(F.get("_w", F.lit(0))).isin("the", "a", "an") & (F.col("name") != "")).drop("_w")
