"""Rules on turns and answer keys, as one table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the answer key's schema.
VERIFIABLE = ("audio_heard", "audio_machine_assisted")
STATUSES = ("candidate", "verified", "rejected")
TIERS = ("primary", "secondary", "diagnostic")
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def turn_findings(turns: DataFrame) -> DataFrame:
    """C1 to C4."""
    bad = lambda c: c.isNotNull() & ~c.between(0, 1)
    c = F.col
    rules = [
        ("C1", (c("start_ms") < 0) | (c("end_ms") <= c("start_ms"))), ("C2", F.trim("text") == ""), ("C3", c("confidence").isNotNull() & (F.trim(F.coalesce("confidence_kind", F.lit(""))) == "")),
        ("C4", bad(c("speaker_coverage")) | bad(c("speaker_purity"))),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(k, F.lit(False)), F.lit(n)) for n, k in rules]))
    return turns.select("session_id", "id", F.explode(found).alias("rule"))


def question_findings(questions: DataFrame) -> DataFrame:
    """Shapes of drafted questions."""
    blank = lambda x: F.trim(F.coalesce(F.col(x), F.lit(""))) == ""
    rules = [("C6 consequence", ~F.col("consequence").isin("low", "medium", "high")), ("C6 confidence", ~F.col("confidence").between(0, 1)), ("V16 issue", blank("issue")), ("V16 turn_ids", F.size("turn_ids") < 1)]
    found = F.array_compact(F.array(*[F.when(F.coalesce(k, F.lit(True)), F.lit(n)) for n, k in rules]))
    return questions.select("session_id", "question_id", F.explode(found).alias("rule"))


def sessions_without_scenes(sessions: DataFrame, scenes: DataFrame) -> DataFrame:
    """V17."""
    return sessions.select("session_id").distinct().join(scenes.select("session_id"), "session_id", "left_anti")


def _rule(df: DataFrame, rule: str, when: Column, path: Column | str, message: str) -> DataFrame:
    return df.filter(F.coalesce(when, F.lit(False))).select("id", F.lit(rule).alias("rule"), (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(message).alias("message"))


def manifest_findings(m: DataFrame) -> DataFrame:
    """V1 (enumerations and patterns), V2 to V9, V11 to V13, J18.  m has the nested columns of an answer key; semantic rules are kept to manifests without a finding of V1."""
    c = F.col
    groups = ("important_entities", "important_events")
    targets = None
    for g in groups:
        x = m.select("id", "excerpt", F.posexplode(f"truth.{g}").alias("i", "t")).withColumn("path", F.format_string(f"truth.{g}[%d]", c("i")))
        targets = x if targets is None else targets.unionByName(x)
    threads = m.select("id", "excerpt", F.posexplode("truth.threads").alias("i", "t")).withColumn("path", F.format_string("truth.threads[%d]", c("i")))
    ends = threads.select("id", "excerpt", F.concat("path", F.lit("."), F.lit("")).alias("path"), F.explode(F.array(F.struct(F.lit("first_anchor_ms").alias("n"), c("t.first_anchor_ms").alias("v")), F.struct(F.lit("last_anchor_ms").alias("n"), c("t.last_anchor_ms").alias("v")))).alias("e"))
    ends = ends.select("id", "excerpt", F.concat("path", "e.n").alias("path"), c("e.v").alias("v"))
    inside = lambda v: (v >= c("excerpt.start_ms")) & (v < c("excerpt.end_ms"))
    anchors = targets.filter("t.anchor_ms is not null").select("id", c("t.anchor_ms").alias("v")).distinct()
    verified = F.exists(F.concat(*[F.coalesce(f"truth.{g}", F.array().cast(m.select(f"truth.{g}").schema[0].dataType)) for g in groups]), lambda t: t["status"] == "verified")
    assisted = F.exists(F.concat(*[F.coalesce(f"truth.{g}", F.array().cast(m.select(f"truth.{g}").schema[0].dataType)) for g in groups]), lambda t: t["basis"] == "audio_machine_assisted")
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    is_v = c("t.status") == "verified"
    schema = (
        _rule(m, "V1", ~c("corpus_tier").isin(*TIERS), "corpus_tier", "unknown value")
        .unionByName(_rule(targets, "V1", ~c("t.status").isin(*STATUSES), c("path"), "unknown status"))
        .unionByName(_rule(m, "V13", ~c("id").rlike(SLUG), "id", "not a slug"))
    )
    rules = [
        _rule(m, "V2", c("excerpt.end_ms") <= c("excerpt.start_ms"), "excerpt", "ends before it starts"),
        _rule(m, "V2", c("excerpt.end_ms") > c("source.episode_duration_ms"), "excerpt", "ends after the episode"),
        _rule(m, "V3", (c("rights.local_processing") == "permitted") & blank(c("rights.license_url")), "rights", "permitted without a licence"),
        _rule(m, "V4", c("recording_conditions.proven_distinct_speakers") > c("recording_conditions.expected_physical_speakers"), "recording_conditions", "more speakers proven than expected"),
        _rule(threads, "V5", c("t.last_anchor_ms") <= c("t.first_anchor_ms"), c("path"), "ends before it starts"),
        _rule(ends, "V5", ~inside(c("v")), c("path"), "outside the excerpt"),
        _rule(ends.filter(inside(c("v"))).join(anchors, ["id", "v"], "left_anti"), "J18", F.lit(True), c("path"), "no target's anchor"),
        _rule(targets, "V6", c("t.anchor_ms").isNotNull() & ~inside(c("t.anchor_ms")), c("path"), "outside the excerpt"),
        _rule(targets, "V7", is_v & c("t.anchor_ms").isNull(), c("path"), "verified without an anchor"),
        _rule(targets, "V7", is_v & ~F.coalesce(c("t.basis"), F.lit("")).isin(*VERIFIABLE), c("path"), "verified without a verifiable basis"),
        _rule(targets, "V7", is_v & blank(c("t.evidence")), c("path"), "verified without evidence"),
        _rule(m, "V8", verified & blank(c("truth.method")), "truth", "verified targets without a method"),
        _rule(m, "V9", verified & c("source.media_sha256").isNull() & c("source.content_fingerprint").isNull(), "source", "verified targets without a digest of the medium"),
        _rule(m, "V11", assisted & (F.coalesce(F.size("truth.contaminating_providers"), F.lit(0)) < 1), "truth", "machine-assisted targets without their providers"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return schema.unionByName(out.join(schema.select("id").distinct(), "id", "left_anti"))


def fingerprint_findings(m: DataFrame, files: DataFrame) -> DataFrame:
    """files(path, sha256) that fingerprints must name inside the root, and match."""
    f = m.filter("source.content_fingerprint is not null").select("id", F.col("source.content_fingerprint.path").alias("path"), F.col("source.content_fingerprint.sha256").alias("said"))
    x = f.join(files.select("path", F.col("sha256").alias("have")), "path", "left")
    outside = F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), "..")
    why = F.when(outside, "outside the root").when(F.col("have").isNull(), "no such file").when(F.col("have") != F.col("said"), "digest differs")
    return x.select("id", F.lit("V10").alias("rule"), "path", why.alias("message")).filter("message is not null")
