"""Queries on claims and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import names as N
from ..sources.sessions import written
from . import register, tables as t

W = "WITH "
_ALL = f"{t.TURNS}, {t.ENTITIES}, {t.SCENES}, {t.THREADS}, {t.QUESTIONS}"


@register("j3_fail_closed_evidence", f"""{W}{_ALL}, x AS (SELECT session_id, entity_id, unnest(turn_ids) AS id FROM entities),
  g AS (SELECT x.session_id, entity_id, min(start_ms) AS a, max(end_ms) AS b, count(*) FILTER (WHERE t.id IS NULL) AS unknown FROM x LEFT JOIN turns t ON x.session_id = t.session_id AND x.id = t.id GROUP BY ALL)
SELECT session_id, entity_id, CASE WHEN unknown = 0 THEN a END AS start_ms, CASE WHEN unknown = 0 THEN b END AS end_ms, unknown = 0 AS supported FROM g""")
def j3(spark, d):
    return C.evidence(t.entities(spark, d), "entity_id", t.turns(spark, d))


_CANON = "regexp_replace({}, '^(.*?)0*(\\d+)$', '\\1\\2')"


@register("j4_two_stage_citations", f"""{W}{_ALL}, x AS (SELECT session_id, entity_id, p - 1 AS pos, turn_ids[p] AS turn_id FROM (SELECT *, unnest(range(1, len(turn_ids) + 1)) AS p FROM entities)),
  loose AS (SELECT session_id, {_CANON.format('id')} AS c, min(id) AS id FROM turns GROUP BY 1, 2 HAVING count(*) = 1)
SELECT x.session_id, entity_id, pos, turn_id, coalesce(t.id, l.id) AS resolved FROM x LEFT JOIN turns t ON t.session_id = x.session_id AND t.id = turn_id
LEFT JOIN loose l ON l.session_id = x.session_id AND l.c = {_CANON.format('turn_id')}""")
def j4(spark, d):
    return C.resolved_ids(t.entities(spark, d), "entity_id", t.turns(spark, d))


@register("j5_missing_citations", f"""{W}{_ALL}, x AS (SELECT session_id, unnest(turn_ids) AS id FROM entities UNION ALL SELECT session_id, unnest(turn_ids) FROM scenes UNION ALL SELECT session_id, unnest(turn_ids) FROM threads
  UNION ALL SELECT session_id, unnest(turn_ids) FROM questions)
SELECT session_id, count(*) AS occurrences, count(DISTINCT id) AS distinct_ids FROM x WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.session_id = x.session_id AND t.id = x.id) GROUP BY 1""")
def j5(spark, d):
    return C.missing_citations([f(spark, d) for f in (t.entities, t.scenes, t.threads, t.questions)], t.turns(spark, d))


@register("j6_entities_in_question_evidence", f"""{W}{_ALL} SELECT DISTINCT q.session_id, question_id, entity_id FROM (SELECT *, unnest(turn_ids) AS id FROM questions) q JOIN (SELECT *, unnest(turn_ids) AS id FROM entities) e ON q.session_id = e.session_id AND q.id = e.id""")
def j6(spark, d):
    return C.sharing_turns(t.questions(spark, d), t.entities(spark, d))


@register("a3_entity_merge", f"""{W}{_ALL}, al AS (SELECT session_id, lower(name) AS n, lower(kind) AS k, window_ix, ord, p, aliases[p] AS v FROM (SELECT *, unnest(range(1, len(aliases) + 1)) AS p FROM entities)),
  a1 AS (SELECT session_id, n, k, v, min((window_ix, ord, p)) AS f FROM al WHERE lower(v) <> n AND trim(v) <> '' GROUP BY ALL), a2 AS (SELECT session_id, n, k, list(v ORDER BY f) AS aliases FROM a1 GROUP BY ALL),
  tu AS (SELECT session_id, lower(name) AS n, lower(kind) AS k, window_ix, ord, p, turn_ids[p] AS v FROM (SELECT *, unnest(range(1, len(turn_ids) + 1)) AS p FROM entities)),
  t1 AS (SELECT session_id, n, k, v, min((window_ix, ord, p)) AS f FROM tu GROUP BY ALL), t2 AS (SELECT session_id, n, k, list(v ORDER BY f) AS turn_ids FROM t1 GROUP BY ALL),
  g AS (SELECT session_id, lower(name) AS n, lower(kind) AS k, min(ord) AS first_ord, arg_min(name, (window_ix, ord)) AS name, arg_min(kind, (window_ix, ord)) AS kind FROM entities GROUP BY 1, 2, 3)
SELECT session_id, first_ord, name, kind, coalesce(aliases, []) AS aliases, turn_ids FROM g LEFT JOIN a2 USING (session_id, n, k) LEFT JOIN t2 USING (session_id, n, k)""")
def a3(spark, d):
    return C.merge_entities(t.entities(spark, d))


@register("a4_scene_dedup", f"""{W}{_ALL} SELECT session_id, scene_id, title FROM scenes QUALIFY row_number() OVER (PARTITION BY session_id, list_sort(list_distinct(turn_ids)) ORDER BY window_ix, ord) = 1""")
def a4(spark, d):
    return C.distinct_claims(t.scenes(spark, d)).select("session_id", "scene_id", "title")


@register("a5_thread_dedup", f"""{W}{_ALL} SELECT session_id, thread_id, description FROM threads QUALIFY row_number() OVER (PARTITION BY session_id, list_sort(list_distinct(turn_ids)), lower(trim(description)) ORDER BY window_ix, ord) = 1""")
def a5(spark, d):
    return C.distinct_claims(t.threads(spark, d), F.lower(F.trim("description"))).select("session_id", "thread_id", "description")


_ONCE = f"{W}{_ALL}, once AS (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY session_id, lower(trim(issue)) ORDER BY ord) = 1)"


@register("a6_question_dedup", f"{_ONCE} SELECT session_id, question_id, issue FROM once")
def a6(spark, d):
    return C.question_queue(t.questions(spark, d), 1_000_000).select("session_id", "question_id", "issue")


@register("o1_question_queue", f"""{_ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE consequence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, confidence, ord) AS rank,
  greatest(0, count(*) OVER (PARTITION BY session_id) - 3) AS dropped_count FROM once) SELECT session_id, rank, question_id, consequence, confidence, dropped_count FROM r WHERE rank <= 3""")
def o1(spark, d):
    return C.question_queue(t.questions(spark, d), 3).select("session_id", "rank", "question_id", "consequence", "confidence", "dropped_count")


@register("a7_usage_rollup", """SELECT user_id, sum(event_id % 1000)::BIGINT AS fresh, sum(event_id % 300)::BIGINT AS cached, sum(event_id % 1000 + event_id % 300)::BIGINT AS billed, count(*) AS requests FROM events GROUP BY 1""")
def a7(spark, d):
    e = t.read(spark, d, "events").select("user_id", (F.col("event_id") % 1000).alias("fresh"), (F.col("event_id") % 300).alias("cached"))
    return e.groupBy("user_id").agg(F.sum("fresh").alias("fresh"), F.sum("cached").alias("cached"), F.sum(F.col("fresh") + F.col("cached")).alias("billed"), F.count("*").alias("requests"))


_TEXTS = """ct AS (
  SELECT session_id, 'scene:' || scene_id AS "where", coalesce(title, '') || ' ' || coalesce(summary, '') AS text FROM scenes
  UNION ALL SELECT session_id, 'entity:' || entity_id, array_to_string(list_concat([name], aliases), ' ') FROM entities
  UNION ALL SELECT session_id, 'thread:' || thread_id, description FROM threads
  UNION ALL SELECT session_id, 'question:' || question_id, coalesce(issue, '') || ' ' || coalesce(recommendation, '') || ' ' || coalesce(why_it_matters, '') || ' ' || coalesce(consequence, '') FROM questions)"""


def texts(spark, d):
    return C.claim_texts(t.scenes(spark, d), t.entities(spark, d), t.threads(spark, d), t.questions(spark, d))


register("p5_claim_texts", f'{W}{_ALL}, {_TEXTS} SELECT session_id, "where", text FROM ct')(texts)


@register("u1_claim_union", f"{W}{_ALL}, {_TEXTS} SELECT session_id, count(*) AS claims, sum(length(text))::BIGINT AS characters FROM ct GROUP BY 1")
def u1(spark, d):
    return texts(spark, d).groupBy("session_id").agg(F.count("*").alias("claims"), F.sum(F.length("text")).alias("characters"))


@register("u2_cited_union", f"{W}{_ALL} SELECT session_id, count(DISTINCT id) AS cited FROM (SELECT session_id, unnest(turn_ids) AS id FROM entities UNION SELECT session_id, unnest(turn_ids) FROM scenes) GROUP BY 1")
def u2(spark, d):
    ids = lambda df: df.select("session_id", F.explode("turn_ids").alias("id"))
    return ids(t.entities(spark, d)).union(ids(t.scenes(spark, d))).distinct().groupBy("session_id").agg(F.count("*").alias("cited"))


@register("u3_cited_minus_existing", f"{W}{_ALL} SELECT session_id, id FROM (SELECT DISTINCT session_id, unnest(turn_ids) AS id FROM scenes) EXCEPT SELECT session_id, id FROM turns")
def u3(spark, d):
    return t.scenes(spark, d).select("session_id", F.explode("turn_ids").alias("id")).subtract(t.turns(spark, d).select("session_id", "id"))


@register("u4_intersections", f"{W}{_ALL} SELECT e.session_id, entity_id, scene_id, len(list_intersect(e.turn_ids, s.turn_ids)) AS shared FROM entities e JOIN scenes s USING (session_id, ord)")
def u4(spark, d):
    s = t.scenes(spark, d).select("session_id", "ord", "scene_id", F.col("turn_ids").alias("other"))
    return t.entities(spark, d).join(s, ["session_id", "ord"]).select("session_id", "entity_id", "scene_id", F.size(F.array_intersect("turn_ids", "other")).alias("shared"))


@register("u5_subsets", f"""{W}{_ALL} SELECT e.session_id, entity_id, len(list_filter(e.turn_ids, lambda x: NOT list_contains(s.turn_ids, x))) = 0 AS subset,
  len(list_filter(e.turn_ids, lambda x: NOT list_contains(s.turn_ids, x))) = 0 AND len(list_filter(s.turn_ids, lambda x: NOT list_contains(e.turn_ids, x))) > 0 AS proper FROM entities e JOIN scenes s USING (session_id, ord)""")
def u5(spark, d):
    s = t.scenes(spark, d).select("session_id", "ord", F.col("turn_ids").alias("other"))
    sub = F.size(F.array_except("turn_ids", "other")) == 0
    return t.entities(spark, d).join(s, ["session_id", "ord"]).select("session_id", "entity_id", sub.alias("subset"), (sub & (F.size(F.array_except("other", "turn_ids")) > 0)).alias("proper"))


@register("u6_ordered_distinct", f"""{W}{_ALL}, x AS (SELECT session_id, entity_id, name, p, aliases[p] AS v FROM (SELECT *, unnest(range(1, len(aliases) + 1)) AS p FROM entities)),
  k AS (SELECT session_id, entity_id, lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) AS k, arg_min(v, p) AS v, min(p) AS p FROM x WHERE lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) <> lower(trim(name)) GROUP BY 1, 2, 3)
SELECT e.session_id, e.entity_id, coalesce(list(v ORDER BY p) FILTER (WHERE v IS NOT NULL), []) AS aliases FROM entities e LEFT JOIN k USING (session_id, entity_id) GROUP BY 1, 2""")
def u6(spark, d):
    return t.entities(spark, d).select("session_id", "entity_id", C.ordered_distinct(F.col("aliases"), T.fold_surface, F.col("name")).alias("aliases"))


@register("u7_set_identity", f"{W}{_ALL} SELECT session_id, array_to_string(list_sort(list_distinct(turn_ids)), ',') AS identity, count(*) AS claims FROM scenes GROUP BY 1, 2")
def u7(spark, d):
    return t.scenes(spark, d).groupBy("session_id", F.array_join(F.array_sort(F.array_distinct("turn_ids")), ",").alias("identity")).agg(F.count("*").alias("claims"))


@register("p7_open_questions", f"{W}{_ALL} SELECT session_id, question_id FROM questions WHERE status = 'open'")
def p7(spark, d):
    return t.questions(spark, d).filter("status = 'open'").select("session_id", "question_id")


@register("p15_entity_snapshot", f"{W}{_ALL} SELECT session_id, entity_id, name || '|' || kind || '|' || array_to_string(aliases, ',') || '|' || array_to_string(turn_ids, ',') AS snapshot FROM entities")
def p15(spark, d):
    return t.entities(spark, d).select("session_id", "entity_id", F.concat_ws("|", "name", "kind", F.array_join("aliases", ","), F.array_join("turn_ids", ",")).alias("snapshot"))


@register("p16_prompt_names", f"{W}{_ALL} SELECT session_id, string_agg('- ' || name || ' (' || kind || ')', chr(10) ORDER BY ord) AS preamble FROM entities GROUP BY 1")
def p16(spark, d):
    return t.entities(spark, d).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "kind"))), lambda x: F.format_string("- %s (%s)", x["name"], x["kind"])), "\n").alias("preamble"))


@register("p18_synthesis_fallback", f"""{W}{_ALL} SELECT session_id, question_id, TRUE AS from_synthesis FROM questions WHERE consequence = 'high'
UNION ALL SELECT session_id, question_id, FALSE FROM questions WHERE session_id NOT IN (SELECT session_id FROM questions WHERE consequence = 'high')""")
def p18(spark, d):
    q = t.questions(spark, d).select("session_id", "question_id", "consequence")
    return C.synthesis(q.filter("consequence = 'high'"), q).drop("consequence")


@register("p23_window_prompts", f"""{W}{_ALL} SELECT session_id, ord // 3 AS window_ix, 'Window ' || (ord // 3 + 1) || ' of ' || max(max(ord) // 3 + 1) OVER (PARTITION BY session_id) || chr(10)
  || string_agg('[' || id || '] (' || physical_speaker || ') ' || text, chr(10) ORDER BY ord) AS prompt FROM turns GROUP BY 1, ord // 3""")
def p23(spark, d):
    item = F.struct("ord", T.render_turn("id", "physical_speaker", "text").alias("r"))
    g = t.turns(spark, d).groupBy("session_id", F.floor(F.col("ord") / 3).alias("window_ix")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]), "\n").alias("body"))
    total = F.max("window_ix").over(Window.partitionBy("session_id")) + 1
    return g.select("session_id", "window_ix", F.concat(F.format_string("Window %d of %d", F.col("window_ix") + 1, total), F.lit("\n"), F.col("body")).alias("prompt"))


@register("p25_usage_counters", """SELECT event_id, coalesce(try_cast(raw AS BIGINT), 0) AS tokens, raw IS NOT NULL AND try_cast(raw AS BIGINT) IS NULL AS unreadable
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'many' ELSE (event_id % 977)::VARCHAR END AS raw FROM events)""")
def p25(spark, d):
    raw = F.when(F.col("event_id") % 5 == 1, "many").when(F.col("event_id") % 5 != 0, (F.col("event_id") % 977).cast("string"))
    e = t.read(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("n", F.col("raw").try_cast("bigint"))
    return e.select("event_id", F.coalesce("n", F.lit(0)).alias("tokens"), (F.col("raw").isNotNull() & F.col("n").isNull()).alias("unreadable"))


@register("p27_question_drafts", f"""{W}{_ALL} SELECT session_id, question_id, trim(issue) AS issue, nullif(trim(recommendation), '') AS recommendation, trim(why_it_matters) AS why_it_matters, confidence, lower(trim(consequence)) AS consequence FROM questions""")
def p27(spark, d):
    return C.drafts(t.questions(spark, d))


@register("p4_review_package", f"""{W}{_ALL}, weak AS (SELECT session_id, list(id ORDER BY ord) AS weak FROM turns WHERE least(speaker_coverage, speaker_purity) < 0.75 GROUP BY 1),
  q AS (SELECT session_id, list(question_id ORDER BY ord) AS questions FROM questions GROUP BY 1), e AS (SELECT session_id, list(entity_id ORDER BY ord) AS entities FROM entities GROUP BY 1),
  s AS (SELECT session_id, list(scene_id ORDER BY ord) AS scenes FROM scenes GROUP BY 1)
SELECT session_id, coalesce(weak, []) AS weak, questions, entities, scenes, 4 AS actions FROM q JOIN e USING (session_id) JOIN s USING (session_id) LEFT JOIN weak USING (session_id)""")
def p4(spark, d):
    from ..operators.attribution import weak

    listed = lambda df, i, name: df.groupBy("session_id").agg(C.in_order(["ord"], i).alias(name))
    out = listed(t.questions(spark, d), "question_id", "questions").join(listed(t.entities(spark, d), "entity_id", "entities"), "session_id").join(listed(t.scenes(spark, d), "scene_id", "scenes"), "session_id")
    return out.join(listed(weak(t.turns(spark, d)), "id", "weak"), "session_id", "left").withColumn("weak", F.coalesce("weak", F.array().cast("array<string>"))).withColumn("actions", F.lit(4))


# ------------------------------------------------------------------------------------------------ names

_STEM0 = "regexp_replace(replace(lower(tok), '’', ''''), '^''+|''+$', '', 'g')"
_CASES = " ".join(f"WHEN ends_with(l, '{c.replace(chr(39), chr(39) * 2)}') AND length(l) > {len(c) + 1} THEN substr(l, 1, length(l) - {len(c)})" for c in T.CLITICS)
_RARE = f"""lex AS (SELECT word, log10(n / sum(n) OVER () * 1e9) AS zipf FROM (SELECT word, count(*)::DOUBLE AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1)),
  tk AS (SELECT session_id, ord, id, p, toks[p] AS tok FROM (SELECT session_id, ord, id, toks, unnest(range(1, len(toks) + 1)) AS p FROM (SELECT *, regexp_extract_all(text, '[A-Za-z][A-Za-z''’]*') AS toks FROM turns))),
  st AS (SELECT session_id, ord, id, p, tok, CASE {_CASES} ELSE l END AS stem FROM (SELECT *, {_STEM0} AS l FROM tk)),
  rare AS (SELECT st.*, coalesce(a.zipf, 0) AS zipf FROM st LEFT JOIN lex a ON a.word = stem LEFT JOIN lex b ON ends_with(stem, 's') AND b.word = substr(stem, 1, length(stem) - 1)
    WHERE length(stem) >= 3 AND regexp_full_match(stem, '[a-z]+') AND coalesce(a.zipf, 0) < %s AND NOT (ends_with(stem, 's') AND coalesce(b.zipf, 0) >= %s)),
  forms AS (SELECT session_id, stem, tok AS token, count(*) AS occurrences, list(id ORDER BY ord, p) AS turn_ids, min(zipf) AS zipf FROM rare GROUP BY ALL),
  stems AS (SELECT DISTINCT session_id, stem FROM forms),
  pairs AS (SELECT a.session_id, a.stem AS a, b.stem AS b FROM stems a JOIN stems b ON a.session_id = b.session_id AND a.stem < b.stem AND abs(length(a.stem) - length(b.stem)) <= 2
    AND levenshtein(a.stem, b.stem) <= CASE WHEN least(length(a.stem), length(b.stem)) < 6 THEN 1 ELSE 2 END)"""
FLOOR = 3.6
_R = _RARE % (FLOOR, FLOOR)
_CLUSTER = "both_ AS (SELECT session_id, a, b FROM pairs UNION ALL SELECT session_id, b, a FROM pairs), reach(session_id, stem, other) AS (SELECT session_id, stem, stem FROM stems UNION SELECT r.session_id, r.stem, p.b FROM reach r JOIN both_ p ON p.session_id = r.session_id AND p.a = r.other), roots AS (SELECT session_id, stem, min(other) AS root FROM reach GROUP BY 1, 2)"


def _forms(spark, d, floor=FLOOR):
    return N.forms(N.rare_tokens(N.surface_tokens(t.turns(spark, d)), N.lexicon(t.read(spark, d, "documents")), floor))


@register("f8_stems", f"""{W}{t.TURNS}, tk AS (SELECT DISTINCT unnest(regexp_extract_all(text || ' don''t Thon''s we’ll o''er''', '[A-Za-z][A-Za-z''’]*')) AS tok FROM turns)
SELECT tok AS token, CASE {_CASES} ELSE l END AS stem FROM (SELECT tok, {_STEM0} AS l FROM tk)""")
def f8(spark, d):
    x = t.turns(spark, d).select(F.explode(T.name_tokens(F.concat("text", F.lit(" don't Thon's we’ll o'er'")))).alias("token")).distinct()
    return x.withColumn("stem", T.stem("token"))


@register("f12_rare_tokens", f"{W}{t.TURNS}, {_R} SELECT session_id, id, p - 1 AS pos, tok AS token, stem FROM rare")
def f12(spark, d):
    return N.rare_tokens(N.surface_tokens(t.turns(spark, d)), N.lexicon(t.read(spark, d, "documents")), FLOOR).select("session_id", "id", "pos", "token", "stem")


@register("a30_surface_forms", f"{W}{t.TURNS}, {_R} SELECT session_id, stem, token, occurrences, turn_ids FROM forms")
def a30(spark, d):
    return _forms(spark, d)


@register("j16_edit_distance_pairs", f"{W}{t.TURNS}, {_R} SELECT session_id, a, b FROM pairs")
def j16(spark, d):
    return N.near_pairs(written(_forms(spark, d).select("session_id", "stem").distinct(), "stems"))


@register("g1_stem_clusters", f"WITH RECURSIVE {t.TURNS}, {_R}, {_CLUSTER} SELECT session_id, stem, root FROM roots")
def g1(spark, d):
    stems = written(_forms(spark, d).select("session_id", "stem").distinct(), "stems")
    return N.clusters(stems, N.near_pairs(stems))


_CAND = f"""WITH RECURSIVE {t.TURNS}, {_R}, {_CLUSTER}, c AS (SELECT session_id, root, sum(occurrences)::BIGINT AS occurrences, count(DISTINCT stem) AS stems, count(DISTINCT lower(token)) AS spellings,
    array_to_string(list(token ORDER BY occurrences DESC, token), '|') AS forms, list(zipf ORDER BY occurrences DESC, token)[1] AS z FROM forms JOIN roots USING (session_id, stem) GROUP BY 1, 2)"""


@register("o3_uncertain_names", f"""{_CAND} SELECT session_id, printf('n%04d', row_number() OVER (PARTITION BY session_id ORDER BY stems DESC, occurrences DESC, root) - 1) AS candidate_id, root, forms, occurrences, stems,
  CASE WHEN stems > 1 THEN 'spelled ' || stems || ' ways' WHEN z = 0 THEN 'in no lexicon' ELSE 'rare in general' END AS grounds FROM c""")
def o3(spark, d):
    """The flagship: names that were probably misheard, the most contradictory first."""
    c = N.candidates(t.turns(spark, d), N.lexicon(t.read(spark, d, "documents")), FLOOR)
    return c.select("session_id", "candidate_id", "root", F.array_join(F.transform("forms", lambda x: x["text"]), "|").alias("forms"), "occurrences", "stems", "grounds")


@register("o4_ranked_forms", f"{W}{t.TURNS}, {_R} SELECT session_id, stem, list(token ORDER BY occurrences DESC, token) AS tokens FROM forms GROUP BY 1, 2")
def o4(spark, d):
    best = F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("n"), "token")))
    return _forms(spark, d).groupBy("session_id", "stem").agg(F.transform(best, lambda x: x["token"]).alias("tokens"))


@register("a31_self_contradictions", f"{_CAND} SELECT session_id, count(*) AS candidates, count(*) FILTER (WHERE spellings > 1) AS contradictory FROM c GROUP BY 1")
def a31(spark, d):
    c = N.candidates(t.turns(spark, d), N.lexicon(t.read(spark, d, "documents")), FLOOR)
    return c.groupBy("session_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("spellings") > 1).alias("contradictory"))


@register("p20_name_summary", f"{_CAND} SELECT s.session_id, count(c.root) AS candidates, s.session_id % 5 <> 4 AS computed FROM (SELECT DISTINCT session_id FROM turns) s LEFT JOIN c ON c.session_id = s.session_id AND s.session_id % 5 <> 4 GROUP BY 1")
def p20(spark, d):
    turns = t.turns(spark, d)
    run = turns.filter("session_id % 5 <> 4")
    c = N.candidates(run, N.lexicon(t.read(spark, d, "documents")), FLOOR).groupBy("session_id").agg(F.count("*").alias("candidates"))
    s = turns.select("session_id").distinct().join(c, "session_id", "left")
    return s.select("session_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), (F.col("session_id") % 5 != 4).alias("computed"))


@register("a38_floor_sweep", f"""{W}{t.TURNS}, {_R.replace(f'< {FLOOR}', '< 99').replace(f'>= {FLOOR}', '>= 99')}, fl AS (SELECT unnest([2.0, 3.0, 3.6]::DOUBLE[]) AS floor)
SELECT floor, session_id, count(DISTINCT stem) AS stems, count(*) AS tokens FROM rare, fl WHERE zipf < floor GROUP BY 1, 2""")
def a38(spark, d):
    floors = F.broadcast(spark.createDataFrame([(2.0,), (3.0,), (3.6,)], "floor double"))
    words = N.lexicon(t.read(spark, d, "documents"))
    rare = N.with_zipf(N.rare_tokens(N.surface_tokens(t.turns(spark, d)), words, 99.0), words)
    return rare.join(floors, F.col("zipf") < F.col("floor")).groupBy("floor", "session_id").agg(F.count_distinct("stem").alias("stems"), F.count("*").alias("tokens"))


_TRUTH = "truth AS (SELECT DISTINCT session_id, lower(regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g')) AS name FROM turns)"


def _truth(spark, d):
    return t.turns(spark, d).select("session_id", F.lower(F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(1)), "[^A-Za-z]", "")).alias("name")).distinct()


@register("j24_candidate_known_names", f"""{W}{t.TURNS}, {_R}, {_TRUTH} SELECT s.session_id, stem, name FROM stems s JOIN truth t ON s.session_id = t.session_id AND abs(length(stem) - length(name)) <= 2
  AND levenshtein(stem, name) <= CASE WHEN least(length(stem), length(name)) < 6 THEN 1 ELSE 2 END""")
def j24(spark, d):
    stems = _forms(spark, d).select("session_id", "stem").distinct()
    return stems.join(_truth(spark, d), "session_id").filter((F.abs(F.length("stem") - F.length("name")) <= 2) & T.near("stem", "name"))


@register("a37_name_outcomes", f"""{W}{t.TURNS}, {_R}, {_TRUTH}, heard AS (SELECT DISTINCT session_id, stem FROM st), m AS (SELECT t.session_id, name, count(*) FILTER (WHERE stem = name) AS exact, count(*) FILTER (WHERE stem <> name
  AND abs(length(stem) - length(name)) <= 2 AND levenshtein(stem, name) <= CASE WHEN least(length(stem), length(name)) < 6 THEN 1 ELSE 2 END) AS missed FROM truth t JOIN heard USING (session_id) WHERE length(name) >= 3 GROUP BY ALL)
SELECT session_id, name, CASE WHEN exact > 0 AND missed = 0 THEN 'clean' WHEN exact > 0 THEN 'contradicted' WHEN missed > 0 THEN 'replaced' ELSE 'lost' END AS outcome FROM m""")
def a37(spark, d):
    stems = N.surface_tokens(t.turns(spark, d)).select("session_id", "stem").distinct()
    m = _truth(spark, d).filter("length(name) >= 3").join(stems, "session_id").groupBy("session_id", "name").agg(F.count_if(F.col("stem") == F.col("name")).alias("exact"),
        F.count_if((F.col("stem") != F.col("name")) & (F.abs(F.length("stem") - F.length("name")) <= 2) & T.near("stem", "name")).alias("missed"))
    outcome = F.when((F.col("exact") > 0) & (F.col("missed") == 0), "clean").when(F.col("exact") > 0, "contradicted").when(F.col("missed") > 0, "replaced").otherwise("lost")
    return m.select("session_id", "name", outcome.alias("outcome"))


@register("o6_lowest_confidence", f"""{W}{t.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY confidence, ord) AS n, count(*) OVER (PARTITION BY session_id) AS total FROM turns WHERE confidence IS NOT NULL)
SELECT session_id, id FROM r WHERE n <= greatest(1, total * 20 // 100)""")
def o6(spark, d):
    w = Window.partitionBy("session_id")
    r = t.turns(spark, d).filter("confidence is not null").withColumn("n", F.row_number().over(w.orderBy("confidence", "ord"))).withColumn("total", F.count("*").over(w))
    return r.filter("n <= greatest(1, total * 20 div 100)").select("session_id", "id")


@register("f30_literal_counts", f"{W}{t.TURNS} SELECT session_id, sum(len(regexp_extract_all(lower(text), '\\b(of the)\\b')))::BIGINT AS n FROM turns GROUP BY 1")
def f30(spark, d):
    return t.turns(spark, d).groupBy("session_id").agg(F.sum(T.literal_count("text", F.lit("of the"))).cast("bigint").alias("n"))


@register("s26_truth_names", f"""{W}{t.TURNS}, {t.TARGETS}, x AS (SELECT session_id, path, trim(label) AS name, regexp_split_to_array(trim(label), '\\s+') AS w FROM targets WHERE grp = 'important_entities' AND status = 'verified')
SELECT session_id, path, name FROM (SELECT session_id, path, replace(name, 'The ', '') AS name, w[2:] AS w FROM x WHERE len(w) > 1) WHERE len(w) BETWEEN 1 AND 2 AND lower(w[1]) NOT IN ('the', 'a', 'an')""")
def s26(spark, d):
    from ..sources.manifests import truth_names

    x = t.targets(spark, d).withColumn("label", F.regexp_replace("label", "^The ", ""))
    return truth_names(x).select("session_id", "path", "name")
