"""Queries on sources, sinks, plugs and streams: they write what they read into shared storage first."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import plugs, streaming
from ..functions.text import fold_surface
from ..operators import notes as N
from ..operators.windows import Budget, plan_windows
from ..sources import collections, engines, generator, manifests, plugged, media, sessions, sinks
from . import register, tables as t
from .checks import _REC
from .claims import _ALL
from .corrections import VOCABULARY, approvals
from .notes import _N, files as note_files
from .scoring import _HELD
from .transcripts import _W3


def _turn_structs(spark, d):
    x = t.turns(spark, d)
    turn = F.struct("id", "start_ms", "end_ms", "text", "physical_speaker", "confidence", F.lit(None).cast("string").alias("confidence_kind"), "speaker_coverage", "speaker_purity")
    return x.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", turn.alias("t")))), lambda y: y["t"]).alias("turns"))


def _fixtures(spark, d):
    ent = t.entities(spark, d).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(F.col("entity_id").alias("id"), "name", "kind", "aliases", "turn_ids").alias("e")))), lambda y: y["e"]).alias("entities"))
    x = _turn_structs(spark, d).join(ent, "session_id").select(F.struct(F.col("session_id").cast("string").alias("id")).alias("session"), F.struct(F.lit("fixture").alias("engine"), "turns").alias("engine_output"), F.struct(F.lit("s").alias("summary"), "entities").alias("expected_analysis"))
    path = sessions.shared_folder(spark, "fixtures")
    x.write.json(path)
    # One document a line here; multi-line documents read alike.
    return spark.read.schema(sessions.FIXTURE).json(path)


@register("s1_fixture_turns", f"WITH {t.TURNS} SELECT session_id::VARCHAR AS session_id, id, start_ms, end_ms, CASE WHEN confidence IS NOT NULL THEN 'declared' END AS confidence_kind FROM turns")
def s1(spark, d):
    return sessions.fixture_turns(_fixtures(spark, d)).select("session_id", "id", "start_ms", "end_ms", "confidence_kind")


@register("s2_fixture_claims", f"WITH {_ALL} SELECT session_id::VARCHAR AS session_id, entity_id AS id, name, array_to_string(turn_ids, ',') AS turn_ids FROM entities")
def s2(spark, d):
    return sessions.fixture_claims(_fixtures(spark, d), "entities").select("session_id", "id", "name", F.array_join("turn_ids", ",").alias("turn_ids"))


def _sessions(spark, d):
    k = F.col("session_id")
    x = _turn_structs(spark, d).select(F.when(k % 3 == 0, "0.1").otherwise("0.2").alias("schema_version"), k.cast("string").alias("session_id"), F.element_at(F.array(*[F.lit(s) for s in sessions.STAGES]), (k % 4 + 1).cast("int")).alias("status"), "turns")
    path = sessions.shared_folder(spark, "sessions")
    x.write.json(path)
    return path


@register("s3_versioned_sessions", f"WITH {t.TURNS} SELECT session_id::VARCHAR AS session_id, id, CASE WHEN session_id % 3 = 0 AND confidence IS NOT NULL THEN 'unstated' END AS confidence_kind FROM turns")
def s3(spark, d):
    x = sessions.sessions(spark, _sessions(spark, d))
    return x.select("session_id", F.explode("turns").alias("t")).select("session_id", "t.id", "t.confidence_kind")


@register("s4_lenient_sessions", f"WITH {t.TURNS} SELECT session_id::VARCHAR AS session_id, CAST(NULL AS VARCHAR) AS summary, count(*)::INT AS turns, CASE session_id % 4 WHEN 0 THEN 'imported' WHEN 1 THEN 'transcribed' WHEN 2 THEN 'analyzed' ELSE 'review_ready' END AS status FROM turns GROUP BY ALL")
def s4(spark, d):
    x = sessions.lenient(spark, _sessions(spark, d))
    return x.select("session_id", "summary", F.size(F.try_variant_get("doc", "$.turns", "array<variant>")).alias("turns"), F.try_variant_get("doc", "$.status", "string").alias("status"))


@register("s24_transcript_encodings", f"WITH {t.TURNS} SELECT session_id::VARCHAR AS session_id, id, text, confidence FROM turns")
def s24(spark, d):
    return sessions.transcript(spark, _sessions(spark, d), "canonical")


@register("tr1_pending_sessions", f"WITH {t.TURNS} SELECT DISTINCT session_id::VARCHAR AS session_id FROM turns WHERE session_id % 4 = 1 AND session_id % 5 <> 0")
def tr1(spark, d):
    x = sessions.sessions(spark, _sessions(spark, d)).select("session_id", "status")
    return sessions.pending(x, x.filter("cast(session_id as bigint) % 5 = 0"), "analyzed").select("session_id")


@register("c8_session_stages", f"WITH {t.TURNS} SELECT CASE session_id % 4 WHEN 0 THEN 'imported' WHEN 1 THEN 'transcribed' WHEN 2 THEN 'analyzed' ELSE 'review_ready' END AS status, count(DISTINCT session_id) AS sessions FROM turns GROUP BY 1")
def c8(spark, d):
    return sessions.sessions(spark, _sessions(spark, d)).groupBy("status").agg(F.count("*").alias("sessions"))


@register("s10_recogniser_import", f"WITH {t.SEGMENTS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS ord, start_ms, end_ms, text, confidence FROM segments")
def s10(spark, d):
    s = t.segments(spark, d)
    one = F.struct(F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to")).alias("offsets"), "text", F.array(F.struct(F.lit("x").alias("text"), F.col("confidence").alias("p"))).alias("tokens"))
    path = sessions.shared_folder(spark, "recognised")
    docs = s.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("o")))), lambda y: y["o"]).alias("transcription"))
    docs.select(F.col("session_id").cast("string").alias("recording"), "transcription").write.json(path)
    x = engines.recognised(spark, path, lines=True)
    return x.select(F.col("session_id").cast("bigint").alias("session_id"), F.col("ord").cast("bigint").alias("ord"), "start_ms", "end_ms", "text", "confidence")


@register("s10_engine_source", f"WITH {t.SEGMENTS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS ord, start_ms, end_ms, text, confidence FROM segments")
def s10_source(spark, d):
    """What s10 imports, through the engine source: a partition for eight recordings."""
    one = F.struct(F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to")).alias("offsets"), "text", F.array(F.struct(F.lit("[_BEG]").alias("text"), F.lit(0.5).alias("p")), F.struct(F.lit("x").alias("text"), F.col("confidence").alias("p"))).alias("tokens"))
    one = F.when(F.col("confidence").isNotNull(), one).otherwise(F.struct(one["offsets"].alias("offsets"), F.col("text"), F.slice(one["tokens"], 1, 1).alias("tokens")))
    docs = t.segments(spark, d).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("o")))), lambda y: y["o"]).alias("transcription"))
    path = sessions.shared_folder(spark, "recordings")
    sinks.write_files(docs.select(F.concat(F.lit("r"), F.col("session_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct("transcription")).alias("content")), path)
    x = engine_rows(spark, path, "recognised")
    return x.select(F.regexp_extract("recording", "r(-?[0-9]+)[.]json$", 1).cast("bigint").alias("session_id"), "ord", "start_ms", "end_ms", "text", "confidence")


@register("s11_engine_source", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord, event_id AS start_ms, event_id + event_id % 900 AS end_ms, printf('SPEAKER_%02d', event_id % 12) AS label FROM events")
def s11_source(spark, d):
    """What s11 imports, through the engine source."""
    k = F.col("event_id")
    one = F.struct((k / 1000).alias("start"), ((k + k % 900) / 1000).alias("end"), (k % 12).cast("int").alias("speaker"))
    docs = t.read(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("o")))), lambda x: x["o"]).alias("segments"))
    path = sessions.shared_folder(spark, "diarised")
    sinks.write_files(docs.select(F.concat(F.lit("r"), F.col("user_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct("segments")).alias("content")), path)
    return engine_rows(spark, path, "diarised").select(F.regexp_extract("recording", "r(-?[0-9]+)[.]json$", 1).cast("bigint").alias("user_id"), "ord", "start_ms", "end_ms", "label")


def engine_rows(spark, path, kind):
    spark.dataSource.register(plugged.EngineSource)
    return spark.read.format("engine").option("engine", kind).option("kind", kind).option("suffix", ".json").option("per_task", "8").load(path)


@register("s9_manifest_scan", "SELECT item_id, item_id % 4 <> 0 AS parses, CASE WHEN item_id % 4 <> 0 THEN 'key-' || item_id END AS id FROM benchmark")
def s9(spark, d):
    path = sessions.shared_folder(spark, "manifests")
    b = t.read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.concat(F.lit("key-"), F.col("item_id").cast("string")).alias("id")))).alias("value"))
    b.write.partitionBy("item_id").text(path)
    return manifests.read(spark, path + "/*/*.txt").select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "parses", "manifest.id")


@register("s8_manifest_reference", "SELECT how, 'key-' || item_id AS id FROM (SELECT 'by id' AS how, min(item_id) AS item_id FROM benchmark UNION ALL SELECT 'by path', max(item_id) FROM benchmark)")
def s8(spark, d):
    """The first manifest by its id, the last one by its path."""
    root = sessions.shared_folder(spark, "keys")
    name = F.concat(F.lit("key-"), F.col("item_id").cast("string"))
    b = t.read(spark, d, "benchmark")
    sinks.write_files(b.select(F.concat(name, F.lit(".json")).alias("path"), F.to_json(F.struct(name.alias("id"))).alias("content")), root)
    first, last = b.agg(F.min("item_id"), F.max("item_id")).first()
    read = lambda how, ref: manifests.read(spark, manifests.resolve(ref, root)).select(F.lit(how).alias("how"), "manifest.id")
    return read("by id", f"key-{first}").unionByName(read("by path", f"{root}/key-{last}.json"))


@register("s5_whole_documents", "SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def s5(spark, d):
    """A document written whole, then read again."""
    root = sessions.shared_folder(spark, "documents")
    counts = t.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events")).orderBy("event_type")
    sinks.write_document(f"{root}/counts.json", {"types": [r.asDict() for r in counts.collect()]})  # a handful of types
    return spark.read.schema("types array<struct<event_type:string,events:bigint>>").option("multiLine", True).json(f"{root}/counts.json").select(F.inline("types"))


@register("s23_media_digests", """SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN strlen(coalesce(html, '')) END::BIGINT AS size_bytes, CASE WHEN page_id % 7 <> 0 THEN sha256(coalesce(html, '')) END AS sha256,
  CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'size differs' WHEN page_id % 5 = 1 THEN 'digest differs' WHEN page_id % 5 = 2 THEN 'digest not recorded' END AS finding, page_id % 7 <> 0 AND page_id % 5 > 1 AS kept FROM pages""")
def s23(spark, d):
    """Pages as media: some were never fetched, some are not what was recorded."""
    root = sessions.shared_folder(spark, "media")
    k, body = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    p = t.read(spark, d, "pages").withColumn("path", F.concat(F.lit("m"), (k % 16).cast("string"), F.lit("/"), k.cast("string"), F.lit(".bin")))
    sinks.write_files(p.filter(k % 7 != 0).select("path", body.alias("content")), root)
    said = p.select("path", (F.octet_length(body) + F.when(k % 5 == 0, 1).otherwise(0)).alias("said_bytes"), F.when(k % 5 == 1, F.lit("0")).when(k % 5 != 2, F.upper(F.sha2(body.cast("binary"), 256))).alias("said_sha256"))
    found = media.verified(said, root)
    return found.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("bigint").alias("page_id"), "size_bytes", "sha256", "finding", "kept")


@register("f28_utc_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS stamp FROM events")
def f28(spark, d):
    from ..functions.text import utc_stamp

    return t.read(spark, d, "events").select("event_id", utc_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@register("s6_markdown_scan", f"WITH {_N} SELECT split_part(path, '/', -1) AS name, strlen(content)::INT AS size_bytes, sha256(content) AS digest FROM files")
def s6(spark, d):
    """The notes of the collection written as files and scanned again."""
    root = sessions.shared_folder(spark, "notes")
    name = F.regexp_replace("path", "[^A-Za-z0-9/._ -]", "_")
    # Files that share a path are 930 documents apart: a folder holds those of 930.
    folder = F.floor(F.col("modified") / 930_000).cast("string")
    sinks.write_files(sessions.spread(note_files(spark, d)).select(F.concat(folder, F.lit("/"), name).alias("path"), "content"), root)
    return collections.markdown(spark, root).select(F.substring_index("path", "/", -1).alias("name"), F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("digest"))


@register("s7_assets", "SELECT page_id || '.PNG' AS name, strlen(url)::BIGINT AS length FROM pages WHERE page_id % 2 = 0")
def s7(spark, d):
    """Attachments among other files, told by their suffix."""
    root = sessions.shared_folder(spark, "assets")
    k = F.col("page_id")
    sinks.write_files(t.read(spark, d, "pages").select(F.concat(F.lit("media/"), k.cast("string"), F.when(k % 2 == 0, ".PNG").otherwise(".txt")).alias("path"), F.col("url").alias("content")), root)
    return collections.assets(spark, root).select("name", "length")


@register("s17_report_documents", f"WITH {t.TURNS} SELECT session_id, '{{\"session_id\":' || session_id || ',\"turns\":' || count(*) || ',\"missing\":null}}' AS document FROM turns GROUP BY 1")
def s17(spark, d):
    x = t.turns(spark, d).groupBy("session_id").agg(F.count("*").alias("turns"), F.lit(None).cast("int").alias("missing"))
    return sinks.report_rows(x)


@register("s25_fingerprints", f"""WITH {_REC}, c AS (SELECT pair, replace(list(round(level, 1) ORDER BY ix)::VARCHAR, ', ', ',') AS v FROM fc GROUP BY 1), n AS (SELECT pair, replace(list(round(level, 1) ORDER BY ix)::VARCHAR, ', ', ',') AS v FROM f GROUP BY 1)
SELECT pair AS recording, '{{"coarse":' || c.v || ',"fine":' || n.v || ',"coarse_frame_ms":1000,"fine_frame_ms":500,"fine_probe_start_seconds":10.0,"fine_probe_seconds":20.0}}' AS document FROM c JOIN n USING (pair)""")
def s25(spark, d):
    from .checks import recordings

    coarse, fine, *_ = recordings(spark, d)
    return sinks.write_fingerprint(coarse.withColumnRenamed("pair", "recording"), fine.withColumnRenamed("pair", "recording"), 1000, 500, 10.0, 20.0)


@register("s22_generated_sessions")
def s22(spark, d):
    line = F.struct(F.col("physical_speaker").alias("speaker"), F.concat("text", F.lit(" 7 of 12")).alias("text"))
    g = t.turns(spark, d).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]).alias("pool"))
    plans = g.select("session_id", F.lit(120000).cast("bigint").alias("target_ms"), F.explode(F.array(F.lit(0), F.lit(1))).alias("beat"), F.slice("pool", 1, 1).alias("lines"), "pool")
    return generator.generate(plans)


@register("w9_filler_turns")
def w9(spark, d):
    return s22(spark, d).groupBy("session_id").agg(F.count("*").alias("turns"), F.max("end_ms").alias("end_ms"))


def echo(prompt: str) -> tuple[str, int, int]:
    """A model that only repeats: the first turn it is shown is its scene."""
    import re

    first = re.search(r"\[(t\d+)\]", prompt)
    return 'Sure: {"scenes": [{"title": "one", "summary": "two", "turn_ids": ["%s"]}]}' % (first[1] if first else "none"), len(prompt), 10


@register("p19_window_analysis", f"SELECT session_id, window_ix, 1::INT AS attempts, CAST(NULL AS VARCHAR) AS error, id AS cited FROM ({_W3}) WHERE pos = 0")
def p19(spark, d):
    turns = t.turns(spark, d)
    w = plan_windows(turns, Budget(200, 50, 2))
    x = w.join(turns.select("session_id", "id", "ord", "physical_speaker", "text"), ["session_id", "id"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("["), "id", F.lit("] "), "text").alias("r")))), lambda y: y["r"]), "\n")
    prompts = x.groupBy("session_id", "window_ix").agg(body.alias("prompt"), F.collect_list("id").alias("turn_ids"))
    return plugs.analysed(prompts.withColumn("window_ix", F.col("window_ix").cast("bigint")), plugs.Model(echo)).select("session_id", "window_ix", "attempts", "error", F.get_json_object("payload", "$.scenes[0].turn_ids[0]").alias("cited"))


@register("p26_alias_types", "SELECT event_id, event_id % 3 <> 0 AND event_id % 4 <> 0 AS valid FROM events")
def p26(spark, d):
    k = F.col("event_id")
    doc = F.when(k % 3 == 0, F.lit('{"aliases": "one"}')).when(k % 4 == 0, F.lit('{"aliases": ["a", 2]}')).otherwise(F.lit('{"aliases": ["a", "b"]}'))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), "$.aliases", "variant"))
    return t.read(spark, d, "events").select("event_id", (kind == "ARRAY<STRING>").alias("valid"))


@register("tr7_approval_stream", VOCABULARY + " SELECT kind, root, entry, canonical, array_to_string(aliases, '|') AS aliases, contested, approvals FROM v")
def tr7(spark, d):
    """Approvals arrive in two lots, the later first; the stream is stopped and started between them."""
    base = sessions.shared_folder(spark, "stream")
    rows = sessions.written(approvals(spark, d).select("kind", "canonical", "aliases", "approver", "seq", "event_id"), "approvals")
    for lot in (1, 0):
        rows.filter(F.col("event_id") % 2 == lot).drop("event_id").write.mode("append").parquet(f"{base}/in")
        streaming.approval_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    return streaming.current_entries(spark, f"{base}/out").withColumn("aliases", F.array_join("aliases", "|")).drop("kind_key")


@register("f7_folded_surfaces", f"WITH {_ALL} SELECT DISTINCT lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS folded FROM scenes")
def f7(spark, d):
    return t.scenes(spark, d).select(fold_surface("title").alias("folded")).distinct()


@register("f24_overlaps", f"WITH {t.SEGMENTS}, {t.SPANS} SELECT s.session_id, s.ord, p.ord AS span, greatest(0, least(s.end_ms, p.end_ms) - greatest(s.start_ms, p.start_ms)) AS ms FROM segments s JOIN spans p ON s.session_id = p.session_id AND p.ord // 2 = s.ord")
def f24(spark, d):
    from ..functions.text import overlap_ms

    p = t.spans(spark, d).select("session_id", F.col("ord").alias("span"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    x = t.segments(spark, d).join(p.withColumn("ord", F.floor(F.col("span") / 2)), ["session_id", "ord"])
    return x.select("session_id", "ord", "span", overlap_ms("start_ms", "end_ms", "a", "b").alias("ms"))


@register("f5_covers", f"WITH {t.TURNS} SELECT session_id, id FROM turns WHERE 5000 BETWEEN start_ms AND end_ms")
def f5(spark, d):
    from ..functions.text import covers

    return t.turns(spark, d).filter(covers("start_ms", "end_ms", F.lit(5000))).select("session_id", "id")


@register("f2_token_runs", f"WITH {t.TURNS} SELECT session_id, id FROM turns WHERE {t.sql_mentions('text', chr(39) + 'is of' + chr(39))}")
def f2(spark, d):
    from ..functions.text import mentions

    return t.turns(spark, d).filter(mentions("text", F.lit("is of"))).select("session_id", "id")


@register("f6_engine_tokens", "SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ('ggml','bin','model','models','v','and','the','no','with')))), ' ') AS tokens FROM pages")
def f6(spark, d):
    from ..functions.text import engine_tokens

    return t.read(spark, d, "pages").select("page_id", F.array_join(F.array_sort(engine_tokens("url")), " ").alias("tokens"))




@register("f4_mentions", f"WITH {t.TURNS}, {t.CONTROLS} SELECT session_id, id, term FROM turns, controls WHERE {t.sql_mentions('text', 'term')}")
def f4(spark, d):
    from ..functions.text import tokens
    from ..operators.scoring import holding

    return holding(t.turns(spark, d).select("session_id", "id", tokens("text").alias("hay")), t.controls(spark, d)).select("session_id", "id", "term")


@register("f10_edit_distance", f"WITH {t.TURNS}, pw AS (SELECT DISTINCT lower(regexp_replace(split_part(text, ' ', 1), '[^!-~]', '?', 'g')) AS a, lower(regexp_replace(split_part(text, ' ', 2), '[^!-~]', '?', 'g')) AS b FROM turns) SELECT a, b, CASE WHEN levenshtein(a, b) <= 4 THEN levenshtein(a, b) ELSE -1 END AS distance FROM pw")
def f10(spark, d):
    word = lambda n: F.lower(F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(n)), "[^!-~]", "?"))
    return t.turns(spark, d).select(word(1).alias("a"), word(2).alias("b")).distinct().withColumn("distance", F.levenshtein("a", "b", 4).cast("bigint"))


@register("f11_tolerance", f"WITH {t.TURNS}, pw AS (SELECT DISTINCT split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b FROM turns) SELECT a, b, CASE WHEN least(length(a), length(b)) < 6 THEN 1 ELSE 2 END AS allowed FROM pw")
def f11(spark, d):
    from ..functions.text import tolerance

    w = t.turns(spark, d).select(F.split_part("text", F.lit(" "), F.lit(1)).alias("a"), F.split_part("text", F.lit(" "), F.lit(2)).alias("b")).distinct()
    return w.withColumn("allowed", tolerance("a", "b"))


@register("f13_name_tokens", f"WITH {t.TURNS} SELECT session_id, id, array_to_string(regexp_extract_all(text, '[A-Za-z][A-Za-z''’]*'), '|') AS tokens FROM turns")
def f13(spark, d):
    from ..functions.text import name_tokens

    return t.turns(spark, d).select("session_id", "id", F.array_join(name_tokens("text"), "|").alias("tokens"))


@register("o8_first_evidence", f"WITH {_ALL} SELECT session_id, entity_id, array_to_string(turn_ids[1:1], ',') AS shown FROM entities")
def o8(spark, d):
    return t.entities(spark, d).select("session_id", "entity_id", F.array_join(F.slice("turn_ids", 1, 1), ",").alias("shown"))


@register("s15_vocabulary_table", VOCABULARY + " SELECT kind, root, entry, canonical, array_to_string(aliases, '|') AS aliases, contested, approvals FROM v")
def s15(spark, d):
    """The vocabulary written as a table and read again."""
    from ..operators import corrections

    path = sessions.shared_folder(spark, "vocabulary")
    corrections.vocabulary(approvals(spark, d)).write.parquet(path)
    return spark.read.parquet(path).withColumn("aliases", F.array_join("aliases", "|")).drop("kind_key")


@register("s18_cost_report", "SELECT user_id AS session_id, '{\"session_id\":' || user_id || ',\"requests\":' || count(*) || '}' AS document FROM events GROUP BY 1")
def s18(spark, d):
    return sinks.report_rows(t.read(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("requests")))


@register("s19_score_reports", f"""{_HELD} SELECT session_id, '{{"session_id":' || session_id || ',"dimension":"' || dimension || '","value":' || coalesce(value::VARCHAR, 'null') || ',"withheld_because":' || coalesce('"' || withheld_because || '"', 'null') || '}}' AS document FROM held""")
def s19(spark, d):
    """Reports written and read again."""
    from .scoring import p9

    path = sessions.shared_folder(spark, "reports")
    sinks.write_reports(p9(spark, d), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.session_id").cast("bigint").alias("session_id"), F.col("value").alias("document"))


@register("s20_survey_document", f"""WITH {_N}, tp AS (SELECT path, coalesce(note_type, '(untyped)') AS kind FROM notes), sp AS (SELECT idx, max(idx) OVER (PARTITION BY path) AS last, session_ref FROM sec WHERE level >= 2),
  ps AS (SELECT CASE WHEN last = 0 OR idx::DOUBLE / last < 1/3::DOUBLE THEN 'first-third' WHEN idx::DOUBLE / last < 2/3::DOUBLE THEN 'middle-third' ELSE 'last-third' END AS p, idx = last AS final FROM sp WHERE session_ref IS NOT NULL),
  eg AS (SELECT 'opening' AS edge, arg_min(title, idx) AS title FROM sec WHERE level >= 2 GROUP BY path UNION ALL SELECT 'terminal', arg_max(title, idx) FROM sec WHERE level >= 2 GROUP BY path),
  rt AS (SELECT count(*) FILTER (WHERE NOT is_embed) AS total, count(DISTINCT basename) FILTER (WHERE NOT is_embed) AS distinct_targets, count(*) FILTER (WHERE state = 'resolved') AS resolved, count(*) FILTER (WHERE state = 'unresolved') AS unresolved, count(*) FILTER (WHERE state = 'ambiguous') AS ambiguous,
    count(*) FILTER (WHERE NOT is_embed AND display IS NOT NULL) AS piped, count(*) FILTER (WHERE NOT is_embed AND anchor IS NOT NULL) AS anchored, count(*) FILTER (WHERE NOT is_embed AND contains(target, '/')) AS path_qualified, count(*) FILTER (WHERE is_embed AND ends_with(target, '.png')) AS embeds_to_asset,
    count(*) FILTER (WHERE is_embed AND NOT ends_with(target, '.png')) AS embeds_to_note FROM rs)
SELECT 'notes' AS part, '' AS name, '' AS detail, count(*) AS n FROM files UNION ALL SELECT 'note_types', kind, '', count(*) FROM tp GROUP BY 2 UNION ALL SELECT 'folders', folder, '', count(*) FROM notes GROUP BY 2 UNION ALL SELECT 'frontmatter_keys', key, '', count(*) FROM fm GROUP BY 2
UNION ALL SELECT 'inconsistent_value_shapes', key, array_to_string(list_sort(list(DISTINCT shape)), ','), count(*) FROM fm GROUP BY 2 HAVING count(DISTINCT shape) > 1 UNION ALL SELECT 'link_topology', name, '', n FROM (UNPIVOT rt ON COLUMNS(*) INTO NAME name VALUE n)
UNION ALL SELECT 'stubs', path, '', count(*) FROM notes WHERE size_bytes < 16 AND path NOT IN (SELECT path FROM sec) AND path NOT IN (SELECT path FROM fm) GROUP BY 2 UNION ALL SELECT 'accumulation_positions', p, '', count(*) FROM ps GROUP BY 2
UNION ALL SELECT 'accumulation_positions', 'final-section-in-note', '', count(*) FROM ps WHERE final HAVING count(*) > 0 UNION ALL SELECT 'edge_sections', edge, title, count(*) FROM eg GROUP BY 2, 3
UNION ALL SELECT 'recurring_sections', kind, title, count(*) FROM (SELECT DISTINCT path, title FROM sec WHERE level >= 2) JOIN tp USING (path) GROUP BY 2, 3 HAVING count(*) >= 2
UNION ALL SELECT 'provenance_signals', key, '', count(*) FROM fm WHERE replace(replace(lower(trim(key)), '-', '_'), ' ', '_') IN ({', '.join(repr(k) for k in N.PROVENANCE_KEYS)}) GROUP BY 2""")
def s20(spark, d):
    """The parts as the document holds them: written as JSON by the executors and read again, entry by entry."""
    path = sessions.shared_folder(spark, "survey")
    sinks.survey_parts(N.survey(note_files(spark, d))).write.parquet(path)
    x = spark.read.parquet(path).select("part", F.explode(F.from_json("document", "array<struct<name:string,detail:string,n:bigint>>")).alias("e"))
    return x.select("part", "e.name", "e.detail", "e.n")


@register("s21_text_report", f"WITH {t.TURNS} SELECT unnest(['Sessions', '========', 'turns: ' || count(*), 'longest session, ms: ' || max(end_ms), 'memory: not measured']) AS line FROM turns")
def s21(spark, d):
    totals = t.turns(spark, d).agg(F.count("*").alias("turns"), F.max("end_ms").alias("longest session, ms"), F.lit(None).cast("int").alias("memory")).first().asDict()
    return spark.createDataFrame([(line,) for line in sinks.render("Sessions", totals).splitlines()], "line string")
