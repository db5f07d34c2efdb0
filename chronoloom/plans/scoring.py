"""Queries on scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import scoring as S
from . import register, tables as t
from .claims import _ALL, _TEXTS, texts

W = "WITH "


def excerpt(spark, d):
    return t.turns(spark, d).groupBy("session_id").agg(F.min(F.col("start_ms")).alias("m")).select("session_id", (F.when(F.col("session_id") % 3 == 0, 0).otherwise(900000)).cast("bigint").alias("excerpt_start_ms"))


_BASIS = """ex AS (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 0 ELSE 900000 END::BIGINT AS o, min(start_ms) AS a, max(end_ms) AS b FROM turns GROUP BY 1),
  bc AS (SELECT ex.session_id, o, count(*) FILTER (WHERE anchor_ms BETWEEN a AND b) AS plain, count(*) FILTER (WHERE anchor_ms - o BETWEEN a AND b) AS shifted, count(anchor_ms) AS anchors
    FROM ex LEFT JOIN targets t ON t.session_id = ex.session_id AND anchor_ms IS NOT NULL GROUP BY ALL),
  basis AS (SELECT session_id, CASE WHEN shifted > plain THEN o ELSE 0 END AS offset_ms, CASE WHEN shifted > plain THEN 'excerpt_relative' ELSE 'media_offsets' END AS hypothesis, greatest(plain, shifted) AS anchors_inside, anchors,
    anchors = 0 OR greatest(plain, shifted) > 0 AS usable FROM bc)"""


def basis(spark, d):
    return S.time_basis(t.turns(spark, d), t.targets(spark, d), excerpt(spark, d))


@register("a8_basis_census", f"{W}{t.TURNS}, {t.TARGETS} SELECT session_id, coalesce(basis, 'unstated') AS basis, count(*) AS targets FROM targets GROUP BY ALL")
def a8(spark, d):
    return S.basis_census(t.targets(spark, d))


@register("p17_manifest_targets", f"{W}{t.TURNS}, {t.TARGETS} SELECT session_id, 'truth.' || grp || '[' || (row_number() OVER (PARTITION BY session_id, grp ORDER BY ord) - 1) || ']' AS path, label, anchor_ms FROM targets")
def p17(spark, d):
    """Manifests with each session's targets, exploded again; a place counts within its group."""
    from ..sources import manifests

    one = F.struct("label", "kind", "status", F.lit(None).cast("string").alias("evidence"), "anchor_ms", "basis")
    x = t.targets(spark, d).groupBy("session_id", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda r: r["t"]).alias("ts"))
    pick = lambda g: F.first(F.when(F.col("grp") == g, F.col("ts")), ignorenulls=True).alias(g)
    docs = x.groupBy("session_id").agg(F.struct(pick("important_entities"), pick("important_events")).alias("truth")).withColumnRenamed("session_id", "id")
    return manifests.targets(docs).select(F.col("manifest_id").alias("session_id"), "path", "label", "anchor_ms")


register("a11_time_basis", f"{W}{t.TURNS}, {t.TARGETS}, {_BASIS} SELECT * FROM basis")(basis)


@register("a44_clock_guard", f"{W}{t.TURNS}, {t.TARGETS}, {_BASIS} SELECT session_id, CASE WHEN usable THEN anchors_inside END AS anchors_inside FROM basis")
def a44(spark, d):
    return basis(spark, d).select("session_id", F.when(F.col("usable"), F.col("anchors_inside")).alias("anchors_inside"))


def spanned(spark, d):
    """Entities and scenes with the span of their evidence."""
    turns = t.turns(spark, d)
    e, s = t.entities(spark, d), t.scenes(spark, d)
    span = lambda x, i: x.join(C.evidence(x, i, turns).select("session_id", i, "start_ms", "end_ms"), ["session_id", i])
    return span(e, "entity_id"), span(s, "scene_id")


def _ev(table: str, i: str) -> str:
    return f"""{table}_ev AS (SELECT x.session_id, x.{i}, CASE WHEN bool_and(t.id IS NOT NULL) THEN min(t.start_ms) END AS start_ms, CASE WHEN bool_and(t.id IS NOT NULL) THEN max(t.end_ms) END AS end_ms
  FROM (SELECT session_id, {i}, unnest(turn_ids) AS tid FROM {table}) x LEFT JOIN turns t ON t.session_id = x.session_id AND t.id = x.tid GROUP BY 1, 2)"""


_OUT = f"""{W}{_ALL}, {t.TARGETS}, {_BASIS}, {_ev('entities', 'entity_id')}, {_ev('scenes', 'scene_id')},
  surf AS (SELECT session_id, entity_id, unnest(list_concat([name], aliases)) AS surface FROM entities),
  tg AS (SELECT t.*, anchor_ms - offset_ms AS aligned_ms, usable FROM targets t JOIN basis USING (session_id) WHERE grp = 'important_entities'),
  hit AS (SELECT DISTINCT tg.session_id, path, s.entity_id, aligned_ms FROM tg JOIN surf s ON s.session_id = tg.session_id AND {t.sql_label('tg.label', 's.surface')}),
  per AS (SELECT h.session_id, path, bool_or(coalesce(aligned_ms BETWEEN e.start_ms AND e.end_ms, FALSE)) AS anchored FROM hit h JOIN entities_ev e USING (session_id, entity_id) GROUP BY 1, 2),
  outc AS (SELECT tg.session_id, tg.path, label, basis, status, anchor_ms, aligned_ms, usable, p.path IS NOT NULL AS matched, coalesce(anchored, FALSE) AS anchored FROM tg LEFT JOIN per p ON p.session_id = tg.session_id AND p.path = tg.path)"""


def outcomes(spark, d):
    return S.target_outcomes(t.targets(spark, d), spanned(spark, d)[0], basis(spark, d))


register("j7_target_outcomes", f"{_OUT} SELECT * FROM outc")(outcomes)
_SHARE = "round({}::DOUBLE / nullif(count(*), 0), 4)"


@register("a9_recall_by_basis", f"""{_OUT} SELECT session_id, coalesce(basis, 'unstated') AS basis, count(*) AS targets, count(*) FILTER (WHERE matched) AS matched, {_SHARE.format('count(*) FILTER (WHERE matched)')} AS recall_by_name,
  CASE WHEN bool_and(usable) THEN {_SHARE.format('count(*) FILTER (WHERE anchored)')} END AS recall_anchored FROM outc GROUP BY session_id, coalesce(basis, 'unstated')""")
def a9(spark, d):
    return S.recall_by_basis(outcomes(spark, d))


@register("a10_share", f"{_OUT} SELECT session_id, {_SHARE.format('count(*) FILTER (WHERE matched)')} AS share FROM outc GROUP BY 1")
def a10(spark, d):
    return S.entity_capture(outcomes(spark, d)).select("session_id", F.col("recall_by_name").alias("share"))


_CAPTURE = f"""{_OUT}, cap AS (SELECT session_id, count(*) AS targets, count(*) FILTER (WHERE matched) AS matched, {_SHARE.format('count(*) FILTER (WHERE matched)')} AS recall_by_name,
  CASE WHEN bool_and(usable) THEN {_SHARE.format('count(*) FILTER (WHERE anchored)')} END AS recall_anchored, count(*) FILTER (WHERE NOT matched) AS missed FROM outc GROUP BY session_id)"""


@register("a12_entity_capture", f"{_CAPTURE} SELECT * FROM cap")
def a12(spark, d):
    return S.entity_capture(outcomes(spark, d))


_PLOT = f"""{_OUT}, evt AS (SELECT t.session_id, path, anchor_ms - offset_ms AS aligned_ms, usable, list_filter({t.sql_tokens('label')}, lambda x: length(x) >= 4) AS wanted FROM targets t JOIN basis USING (session_id) WHERE grp = 'important_events' AND anchor_ms IS NOT NULL),
  met AS (SELECT evt.session_id, path, usable, s.scene_id IS NOT NULL AS cov, len(list_filter(wanted, lambda x: list_contains({t.sql_tokens("s.title || ' ' || s.summary")}, x)))::DOUBLE / nullif(len(wanted), 0) AS ratio
    FROM evt LEFT JOIN (SELECT * FROM scenes JOIN scenes_ev USING (session_id, scene_id)) s ON s.session_id = evt.session_id AND aligned_ms BETWEEN s.start_ms AND s.end_ms),
  pe AS (SELECT session_id, path, usable, bool_or(cov) AS cov, max(ratio) AS best FROM met GROUP BY 1, 2, 3)"""


@register("a13_plot_capture", f"""{_PLOT} SELECT session_id, count(*) AS anchored_events, CASE WHEN bool_and(usable) THEN count(*) FILTER (WHERE cov) END AS covered, CASE WHEN bool_and(usable) THEN {_SHARE.format('count(*) FILTER (WHERE cov)')} END AS coverage,
  CASE WHEN bool_and(usable) THEN {_SHARE.format('count(*) FILTER (WHERE cov AND coalesce(best, -1) >= 0.5)')} END AS term_overlap_share FROM pe GROUP BY 1""")
def a13(spark, d):
    return S.plot_capture(t.targets(spark, d), spanned(spark, d)[1], basis(spark, d))


@register("j8_covered_events", f"{_PLOT} SELECT session_id, path, cov AS covered FROM pe")
def j8(spark, d):
    ev = t.targets(spark, d).filter("grp = 'important_events' and anchor_ms is not null").join(basis(spark, d), "session_id").withColumn("aligned_ms", F.col("anchor_ms") - F.col("offset_ms"))
    s = spanned(spark, d)[1].select(F.col("session_id").alias("k"), "start_ms", "end_ms")
    met = ev.join(s, (F.col("session_id") == F.col("k")) & F.col("aligned_ms").between(F.col("start_ms"), F.col("end_ms")), "left")
    return met.groupBy("session_id", "path").agg(F.max(F.col("k").isNotNull()).alias("covered"))


_FIND = f"""{_OUT}, {t.CONTROLS}, {_TEXTS}, whole AS (SELECT session_id, string_agg(text, ' ' ORDER BY ord) AS body FROM turns GROUP BY 1),
  said AS (SELECT session_id, term, count(*) AS n FROM ct JOIN controls ON {t.sql_mentions('text', 'term')} GROUP BY 1, 2),
  find AS (SELECT w.session_id, c.term, {t.sql_mentions('body', 'c.term')} AS in_transcript, coalesce(n, 0) AS asserted_in FROM whole w CROSS JOIN controls c LEFT JOIN said s ON s.session_id = w.session_id AND s.term = c.term)"""


def findings(spark, d):
    return S.control_findings(t.controls(spark, d), texts(spark, d), t.turns(spark, d))


register("j21_controls", f"{_FIND} SELECT * FROM find WHERE asserted_in > 0 OR in_transcript")(findings)
_ABSENT = f"""absent AS (SELECT session_id, entity_id, name FROM (SELECT e.session_id, entity_id, name, aliases, string_agg(coalesce(t.text, ''), ' ' ORDER BY p) AS cited
  FROM (SELECT *, turn_ids[p] AS tid FROM (SELECT *, unnest(range(1, len(turn_ids) + 1)) AS p FROM entities)) e LEFT JOIN turns t ON t.session_id = e.session_id AND t.id = e.tid GROUP BY ALL)
  WHERE cited <> '' AND len(list_filter(list_concat([name], aliases), lambda a: {t.sql_mentions('cited', 'a')})) = 0)"""


@register("j22_absent_from_evidence", f"{W}{_ALL}, {_ABSENT} SELECT * FROM absent")
def j22(spark, d):
    return S.absent_from_evidence(t.entities(spark, d), t.turns(spark, d))


@register("a14_unsupported_claims", f"""{_FIND}, {_ABSENT}, miss AS (SELECT session_id, count(*) AS n FROM (SELECT session_id, unnest(turn_ids) AS id FROM entities UNION ALL SELECT session_id, unnest(turn_ids) FROM scenes) x
  WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.session_id = x.session_id AND t.id = x.id) GROUP BY 1)
SELECT f.session_id, count(*) FILTER (WHERE asserted_in > 0) AS control_hits, coalesce(max(a.n), 0) AS absent, coalesce(max(m.n), 0) AS missing_turns FROM find f
LEFT JOIN (SELECT session_id, count(*) AS n FROM absent GROUP BY 1) a ON a.session_id = f.session_id LEFT JOIN miss m ON m.session_id = f.session_id GROUP BY 1""")
def a14(spark, d):
    e, turns = t.entities(spark, d), t.turns(spark, d)
    hits = findings(spark, d).groupBy("session_id").agg(F.count_if(F.col("asserted_in") > 0).alias("control_hits"))
    hits = turns.select("session_id").distinct().join(hits, "session_id", "left")
    absent = S.absent_from_evidence(e, turns).groupBy("session_id").agg(F.count("*").alias("absent"))
    gone = C.missing_citations([e, t.scenes(spark, d)], turns).select("session_id", F.col("occurrences").alias("missing_turns"))
    return hits.join(absent, "session_id", "left").join(gone, "session_id", "left").na.fill(0)


_SURF = f"""{_FIND}, m AS (SELECT session_id, count(*) AS missed, bool_and(usable) AS clock, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM questions q WHERE q.session_id = o.session_id AND aligned_ms BETWEEN q.start_ms AND q.end_ms)) AS caught
    FROM outc o WHERE NOT matched AND anchor_ms IS NOT NULL GROUP BY 1),
  qt AS (SELECT session_id, string_agg(issue || ' ' || coalesce(recommendation, '') || ' ' || why_it_matters, ' ' ORDER BY ord) AS asked FROM questions GROUP BY 1),
  fl AS (SELECT f.session_id, count(*) AS asserted, count(*) FILTER (WHERE {t.sql_mentions('asked', 'term')}) AS flagged FROM find f JOIN qt USING (session_id) WHERE asserted_in > 0 GROUP BY 1),
  z AS (SELECT session_id, coalesce(missed, 0) + coalesce(asserted, 0) AS e, coalesce(caught, 0) + coalesce(flagged, 0) AS g, coalesce(clock, TRUE) AS ok FROM m FULL JOIN fl USING (session_id))"""


@register("a15_surfaced_errors", f"{_SURF} SELECT session_id, CASE WHEN ok THEN e END AS detected, CASE WHEN ok THEN g END AS surfaced, CASE WHEN ok THEN e - g END AS unsurfaced, CASE WHEN ok THEN round(g::DOUBLE / nullif(e, 0), 4) END AS surfaced_share FROM z")
def a15(spark, d):
    return S.surfaced_errors(outcomes(spark, d), findings(spark, d), t.questions(spark, d))


@register("j9_surfaced_misses", f"{_OUT} SELECT session_id, path FROM outc o WHERE NOT matched AND anchor_ms IS NOT NULL AND EXISTS (SELECT 1 FROM questions q WHERE q.session_id = o.session_id AND aligned_ms BETWEEN q.start_ms AND q.end_ms)")
def j9(spark, d):
    q = t.questions(spark, d).select(F.col("session_id").alias("k"), "start_ms", "end_ms")
    m = outcomes(spark, d).filter("not matched and anchor_ms is not null")
    return m.join(q, (F.col("session_id") == F.col("k")) & F.col("aligned_ms").between(F.col("start_ms"), F.col("end_ms")), "left_semi").select("session_id", "path")


_COUNTS = f"{W}{_ALL}, n AS (SELECT session_id, count(*) AS questions, max(end_ms) AS ms FROM questions GROUP BY 1), s AS (SELECT session_id, count(*) AS scenes FROM scenes GROUP BY 1), c AS (SELECT * FROM n JOIN s USING (session_id))"


def counts(spark, d):
    n = t.questions(spark, d).groupBy("session_id").agg(F.count("*").alias("questions"), F.max("end_ms").alias("excerpt_ms"))
    return n.join(t.scenes(spark, d).groupBy("session_id").agg(F.count("*").alias("scenes")), "session_id")


@register("a16_question_count", f"{_COUNTS} SELECT session_id, questions, round(questions::DOUBLE / (ms / 3600000::DOUBLE), 2) AS questions_per_hour FROM c")
def a16(spark, d):
    c = counts(spark, d)
    return c.select("session_id", "questions").join(S.review_burden(c).select("session_id", "questions_per_hour"), "session_id")


_REPORTS = f"{W}{t.TURNS}, r AS (SELECT session_id, max(end_ms) AS ms, CASE WHEN session_id % 4 <> 0 THEN (session_id % 50 + 1)::DOUBLE END AS wall, CASE WHEN session_id % 3 = 0 THEN session_id * 1048000 + 1 END AS m1, CASE WHEN session_id % 2 = 0 THEN 77000000::BIGINT END AS m2 FROM turns GROUP BY 1)"


def reports(spark, d):
    k = F.col("session_id")
    return t.turns(spark, d).groupBy("session_id").agg(F.max("end_ms").alias("excerpt_ms")).withColumns(
        {"wall_s": F.when(k % 4 != 0, (k % 50 + 1).cast("double")), "peak_rss_bytes": F.when(k % 3 == 0, k * 1048000 + 1), "peak_memory_bytes": F.when(k % 2 == 0, F.lit(77000000).cast("bigint")), "max_rss_bytes": F.lit(None).cast("bigint")}
    )


@register("a17_processing_time", f"{_REPORTS} SELECT session_id, round(ms / 1000::DOUBLE / wall, 2) AS realtime_factor FROM r")
def a17(spark, d):
    return S.processing(reports(spark, d)).select("session_id", "realtime_factor")


@register("a18_peak_memory", f"{_REPORTS} SELECT session_id, coalesce(m1, m2) AS peak_rss_bytes, round(coalesce(m1, m2) / 1048576::DOUBLE, 1) AS peak_rss_mib FROM r")
def a18(spark, d):
    return S.processing(reports(spark, d)).select("session_id", "peak_rss_bytes", "peak_rss_mib")


@register("a19_review_burden", f"""{_COUNTS} SELECT session_id, round(questions::DOUBLE / (ms / 3600000::DOUBLE), 2) AS questions_per_hour, questions * 45 + scenes * 20 AS estimated_seconds, round((questions * 45 + scenes * 20)::DOUBLE / (ms / 3600000::DOUBLE), 1) AS seconds_per_hour,
  (questions * 45 + scenes * 20)::DOUBLE / (ms / 3600000::DOUBLE) <= 180 AS within_target FROM c""")
def a19(spark, d):
    return S.review_burden(counts(spark, d))


# Fixture: what sessions record of their engines, and what keys declare.
#: An engine's native document for each event, by which its session (the user's) is judged, and a provider that every 37th event declares.  A ninth of the sessions has documents that name no engine, a thirteenth holds the truth.
_DOCS = """(SELECT user_id AS session_id, CASE WHEN user_id % 9 <> 0 THEN event_type || CASE WHEN user_id % 4 = 0 THEN '' ELSE ' engine' END END AS provider, CASE WHEN user_id % 9 <> 0 AND event_id % 4 = 0 THEN 'ggml-' || event_type || '-v' || (event_id % 3) || '.bin' END AS model_file,
    CASE WHEN event_id % 37 = 0 THEN event_type || CASE WHEN event_id % 2 = 0 THEN ' v' || (event_id % 5) ELSE ' the ' || (event_id % 7) END END AS declared FROM events)"""


def documents(spark, d):
    """session_id, native: what an engine left of each event, as JSON."""
    k, u = F.col("event_id"), F.col("user_id")
    model = F.when((u % 9 != 0) & (k % 4 == 0), F.format_string("ggml-%s-v%d.bin", F.col("event_type"), k % 3))
    doc = F.struct(F.when(u % 9 != 0, F.concat("event_type", F.when(u % 4 == 0, "").otherwise(" engine"))).alias("provider"), F.struct(model.alias("model_file"), F.col("event_type").alias("note")).alias("recognition"), F.array(F.struct(k.alias("engine_ms"))).alias("steps"))
    return t.read(spark, d, "events").select(u.alias("session_id"), F.to_json(doc).alias("native"))


def declared(spark, d):
    k = F.col("event_id")
    name = F.concat("event_type", F.when(k % 2 == 0, F.concat(F.lit(" v"), (k % 5).cast("string"))).otherwise(F.concat(F.lit(" the "), (k % 7).cast("string"))))
    return t.read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.when(k % 37 == 0, name).alias("provider")).filter("provider is not null").distinct()


def judged(spark, d):
    """session_id, declared_truth, events of each session."""
    return t.read(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg((F.col("session_id") % 13 == 0).alias("declared_truth"), F.count("*").alias("events"))


_NOISE = "'ggml','bin','model','models','v','and','the','no','with'"
_ET = lambda x: f"list_distinct({t.sql_tokens(x, _NOISE)})"
_CONT = f"""{W}docs AS {_DOCS}, ses AS (SELECT session_id, session_id % 13 = 0 AS declared_truth, count(*) AS events FROM docs GROUP BY 1),
  s AS (SELECT DISTINCT session_id, list_sort({_ET('value')}) AS t FROM (SELECT session_id, unnest([provider, model_file]) AS value FROM docs) WHERE value IS NOT NULL AND len({_ET('value')}) > 0), un AS (SELECT session_id, list_distinct(flatten(list(t))) AS known, list(t) AS each_ FROM s GROUP BY 1),
  d AS (SELECT DISTINCT session_id, declared AS provider, {_ET('declared')} AS p FROM docs WHERE declared IS NOT NULL),
  x AS (SELECT d.*, known IS NOT NULL AS is_known, len(p) > 0 AND known IS NOT NULL AND len(list_filter(p, lambda q: NOT list_contains(known, q))) = 0 AS full_,
    coalesce(len(list_filter(each_, lambda t: len(list_filter(t, lambda q: NOT list_contains(p, q))) = 0 AND len(list_filter(p, lambda q: NOT list_contains(t, q))) > 0)) > 0, FALSE) AS part FROM d LEFT JOIN un USING (session_id)),
  g AS (SELECT session_id, count(*) AS n, coalesce(string_agg(provider, '|' ORDER BY provider) FILTER (WHERE full_), '') AS matched, bool_or(part) AS part, bool_or(is_known) AS is_known FROM x GROUP BY 1),
  v AS (SELECT session_id, CASE WHEN declared_truth THEN 'declared_truth' WHEN n IS NULL THEN 'clean' WHEN NOT is_known THEN 'undetermined' WHEN matched <> '' THEN 'contaminated' WHEN part THEN 'undetermined' ELSE 'clean' END AS state, matched FROM ses LEFT JOIN g USING (session_id))"""


def verdicts(spark, d):
    """Identities are walked out of the native documents, whatever their shape, and meet what sessions declare."""
    return S.contamination(judged(spark, d), S.engine_strings(documents(spark, d)).select("session_id", "value"), declared(spark, d))


register("j14_contamination", f"{_CONT} SELECT session_id, state, CASE WHEN state = 'contaminated' THEN matched ELSE '' END AS matched FROM v")(verdicts)


@register("j15_underspecified", f"{_CONT} SELECT session_id, provider FROM x WHERE part")
def j15(spark, d):
    return S.declared_matches(S.engine_strings(documents(spark, d)).select("session_id", "value"), declared(spark, d)).filter("part").select("session_id", "provider")


_METRICS = "metrics AS (SELECT session_id, dimension, dependent, CASE WHEN (session_id + length(dimension)) % 4 <> 0 THEN events * 10 END AS value FROM ses, (VALUES ('entity_capture', TRUE), ('plot_capture', TRUE), ('question_count', FALSE), ('peak_memory', FALSE)) dims(dimension, dependent))"


def metrics(spark, d):
    dims = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.lit(x).alias("dependent")) for n, x in (("entity_capture", True), ("plot_capture", True), ("question_count", False), ("peak_memory", False))]))
    x = judged(spark, d).select("session_id", "events", dims.alias("m")).select("session_id", "events", "m.*")
    return x.withColumn("value", F.when((F.col("session_id") + F.length("dimension")) % 4 != 0, F.col("events") * 10))


_HELD = f"{_CONT}, {_METRICS}, held AS (SELECT session_id, dimension, CASE WHEN state = 'clean' OR NOT dependent THEN value END AS value, CASE WHEN NOT (state = 'clean' OR NOT dependent) THEN state END AS withheld_because FROM metrics LEFT JOIN v USING (session_id))"


@register("p9_withheld", f"{_HELD} SELECT * FROM held")
def p9(spark, d):
    return S.withheld(metrics(spark, d), verdicts(spark, d))


@register("a20_report_counts", f"{_HELD} SELECT session_id, count(*) FILTER (WHERE value IS NOT NULL) AS reported, count(*) FILTER (WHERE withheld_because IS NOT NULL) AS withheld, count(*) FILTER (WHERE value IS NULL AND withheld_because IS NULL) AS unmeasurable FROM held GROUP BY 1")
def a20(spark, d):
    return S.assembled(p9(spark, d))


@register("p24_evidence_spans", f"{W}{_ALL}, {_ev('entities', 'entity_id')} SELECT session_id, entity_id, start_ms, end_ms FROM entities_ev WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL")
def p24(spark, d):
    return spanned(spark, d)[0].filter("start_ms is not null and end_ms is not null").select("session_id", "entity_id", "start_ms", "end_ms")


@register("f1_tokens", f"{W}{t.TURNS} SELECT session_id, id, array_to_string({t.sql_tokens('text')}, ' ') AS tokens FROM turns")
def f1(spark, d):
    from ..functions.text import tokens

    return t.turns(spark, d).select("session_id", "id", F.array_join(tokens("text"), " ").alias("tokens"))


@register("f3_label_matches", f"{W}{_ALL}, {t.TARGETS} SELECT t.session_id, path, entity_id FROM targets t JOIN entities e ON e.session_id = t.session_id AND e.ord = t.ord WHERE {t.sql_label('label', 'name')}")
def f3(spark, d):
    from ..functions.text import label_matches

    e = t.entities(spark, d).select("session_id", "ord", "entity_id", "name")
    return t.targets(spark, d).join(e, ["session_id", "ord"]).filter(label_matches("label", "name")).select("session_id", "path", "entity_id")


@register("f25_distinctive", f"{W}{t.TURNS}, {t.TARGETS} SELECT session_id, path, len(list_filter({t.sql_tokens('label')}, lambda x: length(x) >= 4)) AS n FROM targets")
def f25(spark, d):
    from ..functions.text import distinctive

    return t.targets(spark, d).select("session_id", "path", F.size(distinctive("label")).alias("n"))


@register("g3_engine_strings", """SELECT event_id AS session_id, unnest(['.provider', '.recognition.model_file', '.recognition.deep.engine']) AS "where", unnest(['p' || (event_id % 7), 'ggml-' || (event_id % 5) || '.bin', 'e' || (event_id % 3)]) AS value FROM events""")
def g3(spark, d):
    native = F.format_string('{"provider":"p%d","recognition":{"model_file":"ggml-%d.bin","deep":[{"engine":"e%d","x":{"backend":null}}]},"text":"no"}', F.col("event_id") % 7, F.col("event_id") % 5, F.col("event_id") % 3)
    a = t.read(spark, d, "events").select(F.col("event_id").alias("session_id"), native.alias("native"))
    return S.engine_strings(a)
