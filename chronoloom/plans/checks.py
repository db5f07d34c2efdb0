"""Queries on validation and alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align as L
from ..operators import replies as R
from ..operators import validate as V
from ..sources import engines, pcm, sessions, sinks
from . import register, tables as t
from .claims import _ALL


def raw_turns(spark, d):
    k = F.col("session_id") + F.col("ord")
    x = t.segments(spark, d).withColumn("id", F.format_string("t%05d", F.col("ord")))
    return x.withColumn("confidence_kind", F.when(k % 3 != 0, "mean")).withColumn("speaker_coverage", (k % 12) / 10.0).withColumn("speaker_purity", F.when(k % 5 != 0, (k % 10) / 10.0))


@register("c1_turn_constraints", f"""WITH {t.SEGMENTS}, x AS (SELECT session_id, printf('t%05d', ord) AS id, start_ms, end_ms, text, confidence, session_id + ord AS k FROM segments)
SELECT session_id, id, rule FROM (SELECT session_id, id, unnest([CASE WHEN start_ms < 0 OR end_ms <= start_ms THEN 'C1' END, CASE WHEN trim(text) = '' THEN 'C2' END, CASE WHEN confidence IS NOT NULL AND k % 3 = 0 THEN 'C3' END, CASE WHEN k % 12 > 10 THEN 'C4' END]) AS rule FROM x) WHERE rule IS NOT NULL""")
def c1(spark, d):
    return V.turn_findings(raw_turns(spark, d))


@register("c5_unsupported_claims", f"""WITH {_ALL} SELECT DISTINCT session_id, entity_id FROM (SELECT session_id, entity_id, unnest(turn_ids) AS id FROM entities) e WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.session_id = e.session_id AND t.id = e.id)""")
def c5(spark, d):
    from ..operators.claims import evidence

    return evidence(t.entities(spark, d), "entity_id", t.turns(spark, d)).filter("not supported").select("session_id", "entity_id")


@register("c6_question_constraints", f"""WITH {_ALL}, x AS (SELECT session_id, question_id, CASE WHEN (session_id + ord) % 7 = 0 THEN 'dire' ELSE consequence END AS c, CASE WHEN (session_id + ord) % 5 = 0 THEN 1.5 ELSE confidence END AS p, CASE WHEN (session_id + ord) % 11 = 0 THEN ' ' ELSE issue END AS i FROM questions)
SELECT session_id, question_id, rule FROM (SELECT session_id, question_id, unnest([CASE WHEN c = 'dire' THEN 'C6 consequence' END, CASE WHEN p > 1 THEN 'C6 confidence' END, CASE WHEN trim(i) = '' THEN 'V16 issue' END]) AS rule FROM x) WHERE rule IS NOT NULL""")
def c6(spark, d):
    k = F.col("session_id") + F.col("ord")
    q = t.questions(spark, d).withColumn("consequence", F.when(k % 7 == 0, "dire").otherwise(F.col("consequence"))).withColumn("confidence", F.when(k % 5 == 0, 1.5).otherwise(F.col("confidence"))).withColumn("issue", F.when(k % 11 == 0, " ").otherwise(F.col("issue")))
    return V.question_findings(q)


@register("v17_sessions_without_scenes", f"WITH {_ALL} SELECT DISTINCT session_id FROM turns WHERE session_id NOT IN (SELECT session_id FROM scenes WHERE session_id % 6 <> 0)")
def v17(spark, d):
    return V.sessions_without_scenes(t.turns(spark, d), t.scenes(spark, d).filter("session_id % 6 <> 0"))


_T = "struct<label:string,kind:string,status:string,evidence:string,anchor_ms:bigint,basis:string>"
_MAN = f"""id string, corpus_tier string, source struct<episode_duration_ms:bigint,media_sha256:string,content_fingerprint:struct<method:string,path:string,sha256:string>>, excerpt struct<start_ms:bigint,end_ms:bigint>,
 recording_conditions struct<expected_physical_speakers:int,proven_distinct_speakers:int>, truth struct<important_entities:array<{_T}>,important_events:array<{_T}>,threads:array<struct<label:string,first_anchor_ms:bigint,last_anchor_ms:bigint,evidence:string>>,method:string,contaminating_providers:array<string>>,
 rights struct<local_processing:string,license_url:string>"""


def manifests(spark, d):
    """An answer key for each benchmark item; each breaks a rule or two by its number."""
    k = F.col("item_id").cast("bigint")
    n = lambda x: F.lit(x).cast("bigint")
    target = lambda kind, m: F.struct(F.concat(F.lit(kind), k.cast("string")).alias("label"), F.lit(kind).alias("kind"), F.when(k % 17 == m, "sure").otherwise(F.when(k % 3 == 0, "candidate").otherwise("verified")).alias("status"),
        F.when(k % 7 != m, F.lit("heard it")).alias("evidence"), F.when(k % 5 != m, 1000 + k * 10 * (1 + m)).alias("anchor_ms"), F.when(k % 4 == m, "published").when(k % 2 == 0, "audio_heard").otherwise("audio_machine_assisted").alias("basis"))
    thread = F.struct(F.lit("thread").alias("label"), (1000 + k * 10).alias("first_anchor_ms"), F.when(k % 6 == 0, n(900)).otherwise(1000 + k * 20).alias("last_anchor_ms"), F.lit("e").alias("evidence"))
    finger = F.when(k % 5 != 0, F.struct(F.lit("rms").alias("method"), F.when(k % 5 == 1, F.concat(F.lit("../f"), k.cast("string"))).otherwise(F.concat(F.lit("f"), k.cast("string"))).alias("path"), F.when(k % 5 == 2, F.lit("00")).otherwise(F.sha2(k.cast("string"), 256)).alias("sha256")))
    return t.read(spark, d, "benchmark").select(
        F.concat(F.when(k % 13 == 0, F.lit("Bad Id ")).otherwise(F.lit("key-")), k.cast("string")).alias("id"), F.when(k % 11 == 0, "odd").otherwise("primary").alias("corpus_tier"),
        F.struct(F.when(k % 8 == 0, n(1200)).otherwise(n(9000)).alias("episode_duration_ms"), F.when(k % 2 == 0, F.lit("aa")).alias("media_sha256"), finger.alias("content_fingerprint")).alias("source"),
        F.struct(n(1000).alias("start_ms"), F.when(k % 9 == 0, n(1000)).otherwise(n(1500)).alias("end_ms")).alias("excerpt"), F.struct(F.lit(4).alias("expected_physical_speakers"), (k % 6).cast("int").alias("proven_distinct_speakers")).alias("recording_conditions"),
        F.struct(F.array(target("person", 1)).alias("important_entities"), F.array(target("event", 0)).alias("important_events"), F.array(thread).alias("threads"), F.when(k % 4 != 2, F.lit("listened")).alias("method"), F.when(k % 3 == 1, F.array(F.lit("x"))).alias("contaminating_providers")).alias("truth"),
        F.struct(F.when(k % 2 == 0, "permitted").otherwise("unclear").alias("local_processing"), F.when(k % 4 == 0, F.lit("https://l")).alias("license_url")).alias("rights"),
    )


def _st(m):
    return f"CASE WHEN k % 17 = {m} THEN 'sure' WHEN k % 3 = 0 THEN 'candidate' ELSE 'verified' END"


def _tg(grp, kind, m):
    return f"SELECT id, k, s, e, 'truth.{grp}[0]' AS path, {_st(m)} AS status, k % 7 <> {m} AS has_evidence, CASE WHEN k % 5 <> {m} THEN 1000 + k * 10 * {1 + m} END AS anchor, CASE WHEN k % 4 = {m} THEN 'published' WHEN k % 2 = 0 THEN 'audio_heard' ELSE 'audio_machine_assisted' END AS basis FROM b"


_M = f"""b AS (SELECT item_id AS k, CASE WHEN item_id % 13 = 0 THEN 'Bad Id ' ELSE 'key-' END || item_id AS id, 1000 AS s, CASE WHEN item_id % 9 = 0 THEN 1000 ELSE 1500 END AS e FROM benchmark),
tg AS ({_tg('important_entities', 'person', 1)} UNION ALL {_tg('important_events', 'event', 0)}),
th AS (SELECT id, k, s, e, 'truth.threads[0]' AS path, 1000 + k * 10 AS a, CASE WHEN k % 6 = 0 THEN 900 ELSE 1000 + k * 20 END AS z FROM b),
en AS (SELECT id, s, e, path || '.first_anchor_ms' AS path, a AS v FROM th UNION ALL SELECT id, s, e, path || '.last_anchor_ms', z FROM th),
vf AS (SELECT id, bool_or(status = 'verified') AS verified, bool_or(basis = 'audio_machine_assisted') AS assisted FROM tg GROUP BY 1),
sch AS (SELECT id, 'V1' AS rule, 'corpus_tier' AS path, 'unknown value' AS message FROM b WHERE k % 11 = 0 UNION ALL SELECT id, 'V1', path, 'unknown status' FROM tg WHERE status = 'sure' UNION ALL SELECT id, 'V13', 'id', 'not a slug' FROM b WHERE k % 13 = 0),
sem AS (SELECT id, 'V2' AS rule, 'excerpt' AS path, 'ends before it starts' AS message FROM b WHERE e <= s UNION ALL SELECT id, 'V2', 'excerpt', 'ends after the episode' FROM b WHERE e > CASE WHEN k % 8 = 0 THEN 1200 ELSE 9000 END
  UNION ALL SELECT id, 'V3', 'rights', 'permitted without a licence' FROM b WHERE k % 2 = 0 AND k % 4 <> 0 UNION ALL SELECT id, 'V4', 'recording_conditions', 'more speakers proven than expected' FROM b WHERE k % 6 > 4
  UNION ALL SELECT id, 'V5', path, 'ends before it starts' FROM th WHERE z <= a UNION ALL SELECT id, 'V5', path, 'outside the excerpt' FROM en WHERE NOT (v >= s AND v < e)
  UNION ALL SELECT id, 'J18', path, 'no target''s anchor' FROM en WHERE v >= s AND v < e AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.id = en.id AND anchor = v) UNION ALL SELECT id, 'V6', path, 'outside the excerpt' FROM tg WHERE anchor IS NOT NULL AND NOT (anchor >= s AND anchor < e)
  UNION ALL SELECT id, 'V7', path, 'verified without an anchor' FROM tg WHERE status = 'verified' AND anchor IS NULL UNION ALL SELECT id, 'V7', path, 'verified without a verifiable basis' FROM tg WHERE status = 'verified' AND basis = 'published'
  UNION ALL SELECT id, 'V7', path, 'verified without evidence' FROM tg WHERE status = 'verified' AND NOT has_evidence UNION ALL SELECT b.id, 'V8', 'truth', 'verified targets without a method' FROM b JOIN vf USING (id) WHERE verified AND k % 4 = 2
  UNION ALL SELECT b.id, 'V9', 'source', 'verified targets without a digest of the medium' FROM b JOIN vf USING (id) WHERE verified AND k % 2 <> 0 AND k % 5 = 0 UNION ALL SELECT b.id, 'V11', 'truth', 'machine-assisted targets without their providers' FROM b JOIN vf USING (id) WHERE assisted AND k % 3 <> 1),
fnd AS (SELECT * FROM sch UNION ALL SELECT * FROM sem WHERE id NOT IN (SELECT id FROM sch))"""


@register("v1_manifest_findings", f"WITH {_M} SELECT * FROM fnd")
def v1(spark, d):
    return V.manifest_findings(manifests(spark, d))


def _one(name, rule):
    register(name, f"WITH {_M} SELECT id, path, message FROM fnd WHERE rule = '{rule}'")(lambda spark, d: V.manifest_findings(manifests(spark, d)).filter(F.col("rule") == rule).select("id", "path", "message"))


for _n, _r in (("v2_excerpt", "V2"), ("v3_licence", "V3"), ("v4_speakers", "V4"), ("v5_threads", "V5"), ("j18_thread_anchors", "J18"), ("v6_anchor_window", "V6"), ("v7_verified_targets", "V7"), ("v8_method", "V8"), ("v9_media_digest", "V9"), ("v11_providers", "V11"), ("v13_slug", "V13")):
    _one(_n, _r)


@register("v12_schema_gate", f"WITH {_M} SELECT id, count(*) AS findings, bool_or(rule IN ('V1', 'V13')) AS schema_only FROM fnd GROUP BY 1")
def v12(spark, d):
    return V.manifest_findings(manifests(spark, d)).groupBy("id").agg(F.count("*").alias("findings"), F.bool_or(F.col("rule").isin("V1", "V13")).alias("schema_only"))


@register("v10_fingerprints", f"WITH {_M} SELECT id, 'V10' AS rule, CASE WHEN k % 5 = 1 THEN '../f' ELSE 'f' END || k AS path, CASE WHEN k % 5 = 1 THEN 'outside the root' WHEN k % 10 IN (3, 8) THEN 'no such file' ELSE 'digest differs' END AS message FROM b WHERE k % 5 IN (1, 2, 3)")
def v10(spark, d):
    files = t.read(spark, d, "benchmark").filter("item_id % 5 <> 3").select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), F.sha2(F.col("item_id").cast("string"), 256).alias("sha256"))
    return V.fingerprint_findings(manifests(spark, d), files)


# ------------------------------------------------------------------------------------------------ alignment


def frames(spark, d):
    """Hourly loudness of each group of users, and a copy that is 4 frames late and a little different."""
    e = t.read(spark, d, "events").select((F.col("user_id") % 8).alias("pair"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 10800).alias("h"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    r = e.groupBy("pair", "h").agg(F.floor(F.sum("v") / F.count("*")).cast("double").alias("level"))
    r = r.withColumn("ix", F.col("h") - F.min("h").over(Window.partitionBy("pair")))
    r = r.withColumn("level", F.when(F.col("pair") == 7, 1.0).otherwise(F.col("level")))
    return r.select("pair", "ix", "level"), r.select("pair", (F.col("ix") + 4).alias("ix"), F.when(F.col("pair") == 7, F.col("level")).otherwise(F.col("level") + (F.col("ix") % 3) * 0.5).alias("level"))


_FR = """e AS (SELECT user_id % 8 AS pair, floor(epoch(ts) / 10800)::BIGINT AS h, round(value * 100)::BIGINT AS v FROM events), r0 AS (SELECT pair, h, floor(sum(v)::DOUBLE / count(*)) AS level FROM e GROUP BY 1, 2),
r AS (SELECT pair, h - min(h) OVER (PARTITION BY pair) AS ix, CASE WHEN pair = 7 THEN 1.0::DOUBLE ELSE level END AS level FROM r0), c AS (SELECT pair, ix + 4 AS ix, CASE WHEN pair = 7 THEN level ELSE level + (ix % 3) * 0.5::DOUBLE END AS level FROM r),
met AS (SELECT r.pair, g.lag, r.level AS x, c.level AS y FROM r, (SELECT unnest(range(-8, 9)) AS lag) g, c WHERE c.pair = r.pair AND c.ix = r.ix + g.lag),
cor AS (SELECT pair, lag, count(*) AS frames, CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0 ELSE corr(x, y) END AS r FROM met GROUP BY 1, 2)"""


@register("j17_lagged_frames", f"WITH {_FR} SELECT pair, lag, count(*) AS frames, round(sum(x * y), 2) AS product FROM met GROUP BY 1, 2")
def j17(spark, d):
    r, c = frames(spark, d)
    return L.lagged(r, c, 8).groupBy("pair", "lag").agg(F.count("*").alias("frames"), F.round(F.sum(F.col("x") * F.col("y")), 2).alias("product"))


@register("a42_pearson", f"WITH {_FR} SELECT pair, lag, frames, round(r, 4) AS r FROM cor")
def a42(spark, d):
    r, c = frames(spark, d)
    return L.correlations(L.lagged(r, c, 8)).select("pair", "lag", "frames", F.round("r", 4).alias("r"))


@register("a43_best_lag", f"WITH {_FR} SELECT pair, arg_max(lag, (round(r, 6), -lag)) AS lag, round(max(r), 4) AS r FROM cor WHERE frames >= 30 AND r > -1 GROUP BY 1")
def a43(spark, d):
    r, c = frames(spark, d)
    return L.best_lags(L.correlations(L.lagged(r, c, 8)), places=6).select("pair", "lag", F.round("r", 4).alias("r"))


# Coarse frames of a second hold two fine ones; a probe of 20 s begins at 10 s.
COARSE_MS, FINE_MS, PROBE, PROBE_S = 1000.0, 500.0, 10.0, 20.0


def recordings(spark, d):
    """Fine and coarse frames of a recording for each group of users (a frame an event) and of another: a late and slightly different copy, or, of groups 6 and 7, unlike or silent."""
    e = t.read(spark, d, "events").select((F.col("user_id") % 8).alias("pair"), "event_id", F.floor(F.col("value") * 100).cast("double").alias("level"))
    ix = F.row_number().over(Window.partitionBy("pair").orderBy("event_id")).cast("bigint") - 1
    own = e.select("pair", ix.alias("ix"), "level")
    other = F.when(F.col("pair") == 7, 1.0).when(F.col("pair") == 6, F.col("level") * (F.col("ix") % 5 - 2)).otherwise(F.col("level") + (F.col("ix") % 3) * 0.5)
    late = own.select("pair", (F.col("ix") + (F.col("pair") % 4) * 3).alias("ix"), other.alias("level"))
    coarse = lambda df: df.groupBy("pair", F.floor(F.col("ix") / 2).alias("ix")).agg((F.sum("level") / F.count("*")).alias("level"))
    return coarse(own), own, coarse(late), late


_REC = """f AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY event_id) - 1 AS ix, level FROM (SELECT user_id % 8 AS pair, event_id, floor(value * 100)::DOUBLE AS level FROM events)),
 l AS (SELECT pair, ix + (pair % 4) * 3 AS ix, CASE WHEN pair = 7 THEN 1.0::DOUBLE WHEN pair = 6 THEN level * (ix % 5 - 2) ELSE level + (ix % 3) * 0.5::DOUBLE END AS level FROM f),
 fc AS (SELECT pair, ix // 2 AS ix, sum(level) / count(*) AS level FROM f GROUP BY 1, 2), lc AS (SELECT pair, ix // 2 AS ix, sum(level) / count(*) AS level FROM l GROUP BY 1, 2),
 cm AS (SELECT fc.pair, g.lag, count(*) AS frames, CASE WHEN min(fc.level) = max(fc.level) OR min(lc.level) = max(lc.level) THEN 0 ELSE corr(fc.level, lc.level) END AS r FROM fc, (SELECT unnest(range(-60, 61)) AS lag) g, lc WHERE lc.pair = fc.pair AND lc.ix = fc.ix + g.lag GROUP BY 1, 2),
 cb AS (SELECT pair, lag, round(r, 6) AS r, frames FROM cm WHERE frames >= 30 AND r > -1 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(r, 6) DESC, lag) = 1),
 lo AS (SELECT pair, lag, round(greatest(0.0::DOUBLE, 10.0 + lag - 3.0) * 2)::BIGINT AS first_ FROM cb WHERE r >= 0.30),
 wi AS (SELECT l.pair, ix - first_ AS ix, level FROM l JOIN lo ON lo.pair = l.pair AND ix >= first_ AND ix < first_ + 52), pr AS (SELECT pair, ix - 20 AS ix, level FROM f WHERE ix >= 20 AND ix < 60),
 fm_ AS (SELECT pr.pair, g.lag, count(*) AS frames, CASE WHEN min(pr.level) = max(pr.level) OR min(wi.level) = max(wi.level) THEN 0 ELSE corr(pr.level, wi.level) END AS r FROM pr, (SELECT unnest(range(-12, 13)) AS lag) g, wi WHERE wi.pair = pr.pair AND wi.ix = pr.ix + g.lag GROUP BY 1, 2),
 fb AS (SELECT pair, lag, round(r, 6) AS r FROM fm_ WHERE frames >= 30 AND r > -1 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(r, 6) DESC, lag) = 1)"""


@register("a45_identity_verdict", f"""WITH {_REC}, v AS (SELECT p.pair, CASE WHEN cb.pair IS NULL THEN 'too short' WHEN cb.r < 0.30 THEN 'different' WHEN fb.pair IS NULL THEN 'too short' WHEN fb.r >= 0.90 THEN 'same' ELSE 'different' END AS verdict, cb.lag AS c, fb.lag AS f FROM (SELECT DISTINCT pair FROM fc) p LEFT JOIN cb USING (pair) LEFT JOIN fb USING (pair))
SELECT pair, verdict, CASE WHEN verdict = 'same' THEN round(c - (10.0::DOUBLE + c - greatest(0.0::DOUBLE, 10.0 + c - 3.0)) + f * 0.5, 3) END AS offset_s FROM v""")
def a45(spark, d):
    """Located by coarse frames, decided by the fine ones at the place that they give."""
    return L.identity(*recordings(spark, d), COARSE_MS, FINE_MS, PROBE, PROBE_S)


def _le(n, size: int):
    """A number as `size` little-endian bytes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(size)])


def waves(spark, d):
    """Pages as recordings: their bytes are samples of 8 bits at 1000 a second; of every ten, one has another container, one another codec, and one ends too early."""
    k, body = F.col("page_id"), F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    n = F.octet_length("html").cast("bigint")
    size = F.coalesce(n, F.lit(0).cast("bigint"))
    two = lambda x: _le(F.lit(x), 2)
    form = F.concat(F.lit(b"fmt "), _le(F.lit(16), 4), _le(F.when(k % 10 == 5, 6).otherwise(1), 2), two(1), _le(F.lit(1000), 4), _le(F.lit(1000), 4), two(1), two(8))
    content = F.concat(F.when(k % 10 == 3, F.lit(b"RIFX")).otherwise(F.lit(b"RIFF")), _le(size + 36, 4), F.lit(b"WAVE"), form, F.lit(b"data"), _le(F.when(k % 10 == 7, size + 9).otherwise(size), 4), body)
    return t.read(spark, d, "pages").select(F.concat(k.cast("string"), F.lit(".wav")).alias("path"), content.alias("content"))


def measured(spark, d):
    root = sessions.shared_folder(spark, "recordings")
    sinks.write_files(waves(spark, d), root)
    x = pcm.loudness(spark, root, 100)
    return x.withColumn("page_id", F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("bigint"))


@register("s13_pcm_loudness", r"""WITH b AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS h FROM pages WHERE page_id % 10 NOT IN (3, 5, 7)), s AS (SELECT page_id, i // 100 AS ix, ('0x' || substr(h, 2 * i + 1, 2))::INT - 128 AS v FROM (SELECT *, unnest(range(0, length(h) // 2)) AS i FROM b))
SELECT page_id, ix, round(CASE WHEN sum(v * v) = 0 THEN -120 ELSE greatest(-120, 10 * log10(sum(v * v)::DOUBLE / count(*) / 16384)) END, 6) AS level FROM s GROUP BY 1, 2""")
def s13(spark, d):
    return measured(spark, d).filter("finding is null and ix is not null").select("page_id", "ix", F.round("level", 6).alias("level"))


@register("s13_pcm_findings", "SELECT page_id, CASE page_id % 10 WHEN 3 THEN 'not a RIFF/WAVE container' WHEN 5 THEN 'codec 6 of 8 bits needs a decoder' ELSE 'chunk data ends beyond the file' END AS finding FROM pages WHERE page_id % 10 IN (3, 5, 7)")
def s13_findings(spark, d):
    return measured(spark, d).filter("finding is not null").select("page_id", "finding")


@register("s12_loudness_frames", "SELECT page_id, [CASE WHEN page_id % 3 = 0 THEN -120.0 ELSE -(page_id % 70) - 0.5 END, -120.0, -33.25]::DOUBLE[] AS levels FROM pages")
def s12(spark, d):
    k = F.col("page_id")
    level = F.when(k % 3 == 0, F.lit("-inf")).otherwise((-(k % 70) - 0.5).cast("string"))
    text = F.concat(F.lit("frame:0 RMS_level="), level, F.lit("\nframe:1 RMS_level=nan\nframe:2 RMS_level=-33.25\n"))
    return t.read(spark, d, "pages").select("page_id", engines.loudness(text).alias("levels"))


@register("f22_json_recovery", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE page_id END AS value FROM pages""")
def f22(spark, d):
    k = F.col("page_id").cast("string")
    obj = F.concat(F.lit('{"value": '), k, F.lit(', "note": "two\nlines"}'))
    text = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n```\nDone."))).when(F.col("page_id") % 4 == 1, obj).when(F.col("page_id") % 4 == 2, F.concat(F.lit("Well, "), obj, F.lit(" so."))).otherwise(F.lit("[1, 2]"))
    found = F.from_json(T.json_object(text), "value bigint, note string", {"allowUnquotedControlChars": "true"})
    return t.read(spark, d, "pages").select("page_id", found["value"].alias("value"))


@register("f26_digit_moves", "SELECT event_id, 'roll ' || (1 + (event_id % 25 + (event_id % 4) * 2) % 24) || ' of ' || (1 + (7 + (event_id % 4) * 3) % 24) || ' in 1999' AS line FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, 'roll ' || (event_id % 25) || ' of 7 in 1999' FROM events WHERE event_id % 4 = 0")
def f26(spark, d):
    k = F.col("event_id")
    line = F.concat(F.lit("roll "), (k % 25).cast("string"), F.lit(" of 7 in 1999"))
    return t.read(spark, d, "events").select("event_id", T.vary_digits(line, (k % 4).cast("int")).alias("line"))


@register("f29_grounds", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'spelled ' || (event_id % 3 + 1) || ' ways' WHEN event_id % 2 = 0 THEN 'in no lexicon' ELSE 'rare in general' END AS grounds FROM events")
def f29(spark, d):
    from ..operators.names import grounds

    grounds = grounds(F.col("event_id") % 3 + 1, F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(1.5))
    return t.read(spark, d, "events").select("event_id", grounds.alias("grounds"))


# ------------------------------------------------------------------------------------------------ replies


def replies(spark, d):
    """A reply on each session: a scene and a question for each of its turns, some of them wrong in some way."""
    x = t.turns(spark, d).select("session_id", "ord", "id", "text", (F.col("session_id") + F.col("ord")).alias("k"))
    k = F.col("k")
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    title = F.when(k % 7 == 0, F.lit('" \\n "')).otherwise(F.concat(F.lit('"Scene '), F.col("ord").cast("string"), F.lit('"')))
    ids = F.when(k % 5 == 0, F.lit("[]")).when(k % 6 == 1, F.concat(F.lit('["t'), F.col("ord").cast("string"), F.lit('"]'))).when(k % 13 == 2, F.concat(F.lit("["), quoted("id"), F.lit(',"t99999",3]'))).otherwise(F.concat(F.lit("["), quoted("id"), F.lit("]")))
    scene = F.concat(F.lit('{"title":'), title, F.lit(',"summary":'), F.when(k % 11 == 0, F.lit("5")).otherwise(quoted("text")), F.lit(',"turn_ids":'), ids, F.lit("}"))
    confidence = F.when(k % 17 == 1, F.lit('"high"')).otherwise(((k % 15) / 10.0).cast("string"))
    question = F.concat(F.lit('{"issue":'), quoted("text"), F.when(k % 9 == 2, F.lit("")).otherwise(F.lit(',"why_it_matters":"it does"')), F.lit(',"turn_ids":['), quoted("id"), F.lit('],"confidence":'), confidence, F.lit(',"consequence":'), F.when(k % 8 == 3, F.lit('"huge"')).otherwise(F.lit('"low"')), F.lit("}"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "id", scene.alias("s"), question.alias("q"))))
    g = x.groupBy("session_id").agg(parts.alias("p"))
    joined = lambda c: F.array_join(F.transform("p", lambda y: y[c]), ",")
    s = F.col("session_id")
    entities = F.when(s % 10 == 6, F.lit('[1,{"name":"N","kind":"","turn_ids":"t"}]')).otherwise(F.lit("null"))
    questions = F.when(s % 9 == 4, F.lit('"none"')).otherwise(F.concat(F.lit("["), joined("q"), F.lit("]")))
    payload = F.when(s % 14 == 5, F.lit("[1]")).otherwise(F.concat(F.lit('{"scenes":['), joined("s"), F.lit('],"entities":'), entities, F.lit(',"questions":'), questions, F.lit("}")))
    return g.select("session_id", F.lit(0).alias("window_ix"), payload.alias("payload"), F.transform("p", lambda y: y["id"]).alias("turn_ids"))


@register("v16_reply_findings", f"""WITH {t.TURNS}, x AS (SELECT session_id, id, session_id + ord AS k, text, ord, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS i, count(*) FILTER (WHERE TRUE) OVER (PARTITION BY session_id) AS n FROM turns WHERE session_id % 14 <> 5), s AS (SELECT DISTINCT session_id FROM turns),
  f AS (SELECT session_id, '' AS path, 'must be an object' AS finding FROM s WHERE session_id % 14 = 5 UNION ALL SELECT session_id, 'entities[0]', 'must be an object' FROM s WHERE session_id % 10 = 6 AND session_id % 14 <> 5
  UNION ALL SELECT session_id, 'entities[1].kind', 'must be a string with more than space' FROM s WHERE session_id % 10 = 6 AND session_id % 14 <> 5 UNION ALL SELECT session_id, 'entities[1].turn_ids', 'must cite a turn' FROM s WHERE session_id % 10 = 6 AND session_id % 14 <> 5
  UNION ALL SELECT session_id, 'questions', 'must be a list of objects' FROM s WHERE session_id % 9 = 4 AND session_id % 14 <> 5
  UNION ALL SELECT session_id, 'scenes[' || i || '].title', 'must be a string with more than space' FROM x WHERE k % 7 = 0 UNION ALL SELECT session_id, 'scenes[' || i || '].summary', 'must be a string with more than space' FROM x WHERE k % 11 = 0 OR trim(text, e' \\t\\n\\r') = ''
  UNION ALL SELECT session_id, 'scenes[' || i || '].turn_ids', 'must cite a turn' FROM x WHERE k % 5 = 0 UNION ALL SELECT session_id, 'scenes[' || i || '].turn_ids[0]', 'is no turn of the window' FROM x WHERE k % 5 <> 0 AND k % 6 = 1 AND ord >= n
  UNION ALL SELECT session_id, 'scenes[' || i || '].turn_ids[1]', 'is no turn of the window' FROM x WHERE k % 5 <> 0 AND k % 6 <> 1 AND k % 13 = 2 UNION ALL SELECT session_id, 'scenes[' || i || '].turn_ids[2]', 'must be a turn''s id' FROM x WHERE k % 5 <> 0 AND k % 6 <> 1 AND k % 13 = 2
  UNION ALL SELECT session_id, 'questions[' || i || '].issue', 'must be a string with more than space' FROM x WHERE session_id % 9 <> 4 AND trim(text, e' \\t\\n\\r') = '' UNION ALL SELECT session_id, 'questions[' || i || '].why_it_matters', 'must be a string with more than space' FROM x WHERE session_id % 9 <> 4 AND k % 9 = 2
  UNION ALL SELECT session_id, 'questions[' || i || '].confidence', 'must be a number from 0 to 1' FROM x WHERE session_id % 9 <> 4 AND (k % 17 = 1 OR k % 15 > 10) UNION ALL SELECT session_id, 'questions[' || i || '].consequence', 'must be low, medium or high' FROM x WHERE session_id % 9 <> 4 AND k % 8 = 3)
SELECT session_id, path, finding FROM f""")
def v16(spark, d):
    return R.findings(replies(spark, d)).drop("window_ix")
