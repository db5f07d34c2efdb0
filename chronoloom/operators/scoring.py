"""Scoring sessions against answer keys, and refusing to where the engine wrote the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_run, distinctive, engine_tokens, mentions, share, tokens

# Fields that identify an engine in its artifact, and how deep they are looked for.
IDENTITY_FIELDS = ("engine", "model", "model_file", "model_name", "provider", "backend")
DEPTH = 6
# Assumed seconds of review for a question and a scene, and the target for an hour.
SECONDS_QUESTION, SECONDS_SCENE, SECONDS_TARGET = 45, 20, 180
TERM_FLOOR = 0.5


def basis_census(targets: DataFrame, key: str = "session_id") -> DataFrame:
    """A8."""
    return targets.groupBy(key, F.coalesce("basis", F.lit("unstated")).alias("basis")).agg(F.count("*").alias("targets"))


def time_basis(turns: DataFrame, targets: DataFrame, excerpt: DataFrame, key: str = "session_id") -> DataFrame:
    """Which offset (none, or the excerpt's start) puts more anchors inside a session; ties go to none.  usable: an anchor is inside, or there are none."""
    span = turns.groupBy(key).agg(F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
    base = span.join(excerpt.select(key, "excerpt_start_ms"), key, "left").withColumn("excerpt_start_ms", F.coalesce("excerpt_start_ms", F.lit(0)))
    anchors = base.join(targets.filter("anchor_ms is not null").select(key, "anchor_ms"), key, "left")
    inside = lambda o: F.count_if(F.col("anchor_ms").isNotNull() & (F.col("anchor_ms") - o).between(F.col("first_ms"), F.col("last_ms")))
    g = anchors.groupBy(key, "excerpt_start_ms").agg(inside(F.lit(0)).alias("plain"), inside(F.col("excerpt_start_ms")).alias("shifted"), F.count("anchor_ms").alias("anchors"))
    moved = F.col("shifted") > F.col("plain")
    n = F.greatest("plain", "shifted")
    return g.select(key, F.when(moved, F.col("excerpt_start_ms")).otherwise(F.lit(0)).cast("bigint").alias("offset_ms"), F.when(moved, "excerpt_relative").otherwise("media_offsets").alias("hypothesis"),
                    n.alias("anchors_inside"), "anchors", ((F.col("anchors") == 0) | (n > 0)).alias("usable"))


def target_outcomes(targets: DataFrame, entities: DataFrame, basis: DataFrame, key: str = "session_id") -> DataFrame:
    """Each entity target with whether some entity's name or alias matches it, and whether such an entity's evidence covers its anchor.

    Labels and surfaces are tokenised once.  One of the two is a run of the other, so the first token of one is among the other's: two joins on that token, one for either direction.
    """
    e = entities.select(key, "entity_id", "start_ms", "end_ms", F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "surface")).withColumn("b", tokens("surface"))
    e = e.filter(F.length(F.array_join("b", "")) >= 3)
    x = targets.filter("grp = 'important_entities'").join(basis.select(key, "offset_ms", "usable"), key, "left").withColumn("aligned_ms", F.col("anchor_ms") - F.col("offset_ms"))
    label = x.select(key, "path", "aligned_ms", tokens("label").alias("a")).filter(F.size("a") > 0)
    each = lambda c: F.explode(F.array_distinct(c)).alias("token")
    inside = label.select("*", each("a")).join(e.withColumn("token", F.get("b", F.lit(0))), [key, "token"]).filter(contains_run(F.col("a"), F.col("b")))
    around = label.withColumn("token", F.get("a", F.lit(0))).join(e.select("*", each("b")), [key, "token"]).filter(contains_run(F.col("b"), F.col("a")))
    hits = inside.unionByName(around).groupBy(key, "path", "entity_id", "aligned_ms", "start_ms", "end_ms").agg(F.min_by("surface", "pos").alias("surface"))
    per = hits.groupBy(key, "path").agg(F.count("*").alias("entities"), F.max(F.coalesce(F.col("aligned_ms").between(F.col("start_ms"), F.col("end_ms")), F.lit(False))).alias("anchored"))
    out = x.join(per, [key, "path"], "left")
    return out.select(key, "path", "label", "basis", "status", "anchor_ms", "aligned_ms", "usable", (F.coalesce("entities", F.lit(0)) > 0).alias("matched"), F.coalesce("anchored", F.lit(False)).alias("anchored"))


def recall_by_basis(outcomes: DataFrame, key: str = "session_id") -> DataFrame:
    """Recall by name, and by anchor where the clock is usable."""
    n = F.count("*")
    return outcomes.groupBy(key, F.coalesce("basis", F.lit("unstated")).alias("basis")).agg(
        n.alias("targets"), F.count_if("matched").alias("matched"), share(F.count_if("matched"), n).alias("recall_by_name"),
        F.when(F.bool_and("usable"), share(F.count_if("anchored"), n)).alias("recall_anchored"),
    )


def entity_capture(outcomes: DataFrame, key: str = "session_id") -> DataFrame:
    """A12."""
    n = F.count("*")
    return outcomes.groupBy(key).agg(
        n.alias("targets"), F.count_if("matched").alias("matched"), share(F.count_if("matched"), n).alias("recall_by_name"),
        F.when(F.bool_and("usable"), share(F.count_if("anchored"), n)).alias("recall_anchored"), F.count_if(~F.col("matched")).alias("missed"),
    )


def plot_capture(targets: DataFrame, scenes: DataFrame, basis: DataFrame, key: str = "session_id") -> DataFrame:
    """Event anchors that some scene's evidence covers, and those of them whose words a covering scene repeats."""
    ev = targets.filter("grp = 'important_events' and anchor_ms is not null").join(basis.select(key, "offset_ms", "usable"), key)
    ev = ev.withColumn("aligned_ms", F.col("anchor_ms") - F.col("offset_ms")).withColumn("wanted", distinctive("label")).select(key, "path", "aligned_ms", "wanted", "usable")
    s = scenes.select(F.col(key).alias("_k"), "start_ms", "end_ms", tokens(F.concat_ws(" ", "title", "summary")).alias("have"))
    met = ev.join(s, (F.col(key) == F.col("_k")) & F.col("aligned_ms").between(F.col("start_ms"), F.col("end_ms")), "left")
    ratio = F.try_divide(F.size(F.filter("wanted", lambda w: F.array_contains("have", w))).cast("double"), F.size("wanted").cast("double"))
    per = met.groupBy(key, "path", "usable").agg(F.max(F.col("_k").isNotNull()).alias("covered"), F.max(ratio).alias("best"))
    n = F.count("*")
    return per.groupBy(key).agg(
        n.alias("anchored_events"), F.when(F.bool_and("usable"), F.count_if("covered")).alias("covered"), F.when(F.bool_and("usable"), share(F.count_if("covered"), n)).alias("coverage"),
        F.when(F.bool_and("usable"), share(F.count_if(F.col("covered") & (F.coalesce("best", F.lit(-1.0)) >= TERM_FLOOR)), n)).alias("term_overlap_share"),
    )


def holding(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows(..., hay: tokens) with each of terms(term) that is a run of its tokens.  A row meets only the terms whose first token it holds."""
    needles = terms.select("term").distinct().withColumn("needle", tokens("term")).withColumn("token", F.get("needle", F.lit(0))).filter("token is not null")
    met = rows.withColumn("token", F.explode(F.array_distinct("hay"))).join(needles, "token")
    return met.filter((F.size("needle") == 1) | contains_run(F.col("hay"), F.col("needle"))).drop("token", "needle")


def control_findings(controls: DataFrame, texts: DataFrame, turns: DataFrame, key: str = "session_id") -> DataFrame:
    """The negative controls that a session's claims assert (in how many texts) or its transcript holds."""
    said = holding(texts.withColumn("hay", tokens("text")), controls).groupBy(key, "term").agg(F.count("*").alias("asserted_in"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    heard = holding(turns.groupBy(key).agg(tokens(body).alias("hay")), controls).select(key, "term", F.lit(True).alias("in_transcript"))
    x = heard.join(said, [key, "term"], "full")
    return x.select(key, "term", F.coalesce("in_transcript", F.lit(False)).alias("in_transcript"), F.coalesce("asserted_in", F.lit(0)).alias("asserted_in"))


def absent_from_evidence(entities: DataFrame, turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Entities of whose surfaces none is in their cited text, if they cite any."""
    t = turns.select(F.col(key).alias("_k"), F.col("id").alias("_id"), F.col("text").alias("said"))
    x = entities.select(key, "entity_id", "name", "aliases", F.posexplode("turn_ids").alias("pos", "turn_id"))
    x = x.join(t, (F.col(key) == F.col("_k")) & (F.col("turn_id") == F.col("_id")), "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("said", F.lit("")).alias("s")))), lambda p: p["s"])
    g = x.groupBy(key, "entity_id", "name", "aliases").agg(F.array_join(parts, " ").alias("cited"))
    found = F.exists(F.concat(F.array("name"), "aliases"), lambda a: mentions("cited", a))
    return g.filter((F.col("cited") != "") & ~found).select(key, "entity_id", "name")


def surfaced_errors(outcomes: DataFrame, findings: DataFrame, questions: DataFrame, key: str = "session_id") -> DataFrame:
    """Missed anchored targets that some question's evidence covers, and asserted controls that some question names."""
    missed = outcomes.filter("not matched and anchor_ms is not null")
    q = questions.select(F.col(key).alias("_k"), "start_ms", "end_ms")
    caught = missed.join(q, (F.col(key) == F.col("_k")) & F.col("aligned_ms").between(F.col("start_ms"), F.col("end_ms")), "left_semi").groupBy(key).agg(F.count("*").alias("caught"))
    m = missed.groupBy(key).agg(F.count("*").alias("missed"), F.bool_and("usable").alias("clock"))
    words = F.concat_ws(" ", "issue", F.coalesce("recommendation", F.lit("")), "why_it_matters")
    text = questions.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", words.alias("w")))), lambda x: x["w"]), " ").alias("asked"))
    f = findings.filter("asserted_in > 0").join(text, key, "left").groupBy(key).agg(F.count("*").alias("asserted"), F.count_if(mentions(F.coalesce("asked", F.lit("")), F.col("term"))).alias("flagged"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    x = m.join(caught, key, "left").join(f, key, "full").withColumn("ok", F.coalesce("clock", F.lit(True)))
    errors, got = z("missed") + z("asserted"), z("caught") + z("flagged")
    on = lambda c: F.when(F.col("ok"), c)
    return x.select(key, on(errors).alias("detected"), on(got).alias("surfaced"), on(errors - got).alias("unsurfaced"), on(share(got, errors)).alias("surfaced_share"))


def review_burden(counts: DataFrame) -> DataFrame:
    """counts(session_id, questions, scenes, excerpt_ms) -> questions and assumed review seconds an hour."""
    hours = F.col("excerpt_ms") / 3_600_000
    seconds = F.col("questions") * SECONDS_QUESTION + F.col("scenes") * SECONDS_SCENE
    per = F.try_divide(seconds.cast("double"), hours)
    return counts.select("session_id", F.round(F.try_divide(F.col("questions").cast("double"), hours), 2).alias("questions_per_hour"), seconds.alias("estimated_seconds"), F.round(per, 1).alias("seconds_per_hour"), (per <= SECONDS_TARGET).alias("within_target"))


def processing(reports: DataFrame) -> DataFrame:
    """reports(session_id, excerpt_ms, wall_s, three memory keys) -> realtime factor and peak memory; null is not measured."""
    peak = F.coalesce("peak_rss_bytes", "peak_memory_bytes", "max_rss_bytes")
    return reports.select("session_id", F.round(F.try_divide(F.col("excerpt_ms") / 1000, F.col("wall_s")), 2).alias("realtime_factor"), peak.alias("peak_rss_bytes"), F.round(peak / 1048576, 1).alias("peak_rss_mib"))


def declared_matches(strings: DataFrame, declared: DataFrame, key: str = "session_id") -> DataFrame:
    """declared(session_id, provider) with what the recorded strings(session_id, value) say of each provider: is_known (some engine is), full (every token of it is recorded), part (one recorded string holds
    some of its tokens, nothing else, and not all)."""
    s = strings.select(key, engine_tokens("value").alias("t")).filter(F.size("t") > 0).distinct()
    union = s.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("known"), F.collect_list("t").alias("each"))  # distinct names of engines, few in a session
    x = declared.select(key, "provider", engine_tokens("provider").alias("p")).join(union, key, "left")
    named = F.size("p") > 0
    part = F.exists("each", lambda t: (F.size(F.array_except(t, F.col("p"))) == 0) & (F.size(F.array_except(F.col("p"), t)) > 0))
    full = named & F.col("known").isNotNull() & (F.size(F.array_except("p", "known")) == 0)
    return x.select(key, "provider", F.col("known").isNotNull().alias("is_known"), full.alias("full"), F.coalesce(named & part, F.lit(False)).alias("part"))


def contamination(sessions: DataFrame, strings: DataFrame, declared: DataFrame, key: str = "session_id") -> DataFrame:
    """sessions(session_id, declared_truth), strings(session_id, value), declared(session_id, provider) -> state and the providers that match.

    Steps, in order: declared truth; clean where nothing is declared; undetermined where no engine is known; contaminated where all tokens of a declared provider are recorded;
    undetermined where one recorded string is a proper part of a declared provider; clean.
    """
    x = declared_matches(strings, declared, key)
    g = x.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("full"), F.col("provider")))).alias("matched"), F.max("part").alias("part"), F.max("is_known").alias("is_known"))
    y = sessions.join(g, key, "left")
    state = (
        F.when(F.col("declared_truth"), "declared_truth").when(F.col("n").isNull(), "clean").when(~F.col("is_known"), "undetermined")
        .when(F.size("matched") > 0, "contaminated").when(F.col("part"), "undetermined").otherwise("clean")
    )
    return y.select(key, state.alias("state"), F.when(state == "contaminated", F.array_join("matched", "|")).otherwise(F.lit("")).alias("matched"))


def withheld(metrics: DataFrame, verdicts: DataFrame, key: str = "session_id") -> DataFrame:
    """metrics(session_id, dimension, dependent, value) with the values that read the key nulled where the session can't be scored, and why."""
    x = metrics.join(verdicts.select(key, "state"), key, "left")
    ok = (F.col("state") == "clean") | ~F.col("dependent")
    return x.select(key, "dimension", F.when(ok, F.col("value")).alias("value"), F.when(~ok, F.col("state")).alias("withheld_because"))


def assembled(metrics: DataFrame, key: str = "session_id") -> DataFrame:
    """Reported, withheld and unmeasurable dimensions."""
    reported = F.col("value").isNotNull()
    return metrics.groupBy(key).agg(F.count_if(reported).alias("reported"), F.count_if(F.col("withheld_because").isNotNull()).alias("withheld"), F.count_if(~reported & F.col("withheld_because").isNull()).alias("unmeasurable"))


def engine_strings(artifacts: DataFrame, document: str = "native", key: str = "session_id") -> DataFrame:
    """Values of identity fields to depth 6 in JSON artifacts, with where.  Each round opens one more level of objects and lists; the bound keeps untrusted documents from going on."""
    level = artifacts.select(key, F.try_parse_json(document).alias("v"), F.lit("").alias("where"))
    out = None
    for _ in range(DEPTH + 1):
        spread = level.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select(F.col("key").alias("k"), F.col("value").alias("opened"))
        opened = level.lateralJoin(spread).select(key, "where", "k", F.col("opened").alias("v"))
        kind = F.schema_of_variant("v")
        path = F.when(F.col("k").isNull(), F.col("where")).otherwise(F.concat("where", F.lit("."), F.col("k")))
        here = opened.filter(F.col("k").isin(*IDENTITY_FIELDS) & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"))
        found = here.select(key, path.alias("where"), F.col("v").cast("string").alias("value"))
        out = found if out is None else out.unionByName(found)
        level = opened.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select(key, "v", path.alias("where"))
    return out


