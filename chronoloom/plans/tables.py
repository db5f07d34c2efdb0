"""Working tables derived from the test data, each once for Spark and once as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clock import turn_clock


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("ord"), F.col("role").alias("physical_speaker"), "text")
    rows = turn_clock(rows)
    k = F.col("session_id") * 7 + F.col("ord") * 3
    return rows.withColumn("confidence", F.when(k % 4 != 3, (k % 100) / 100.0)).withColumn("speaker_coverage", F.when(k % 10 != 9, (k % 10) / 10.0)).withColumn(
        "speaker_purity", F.when(k % 7 != 6, ((k + 5) % 10) / 10.0)
    )


TURNS = r"""w AS (
  SELECT conv_id AS session_id, turn::BIGINT AS ord, role AS physical_speaker, text, (greatest(1, len(regexp_extract_all(text, '\S+'))) * 400)::BIGINT AS dur FROM conversations
), turns AS (
  SELECT session_id, ord, physical_speaker, text, printf('t%05d', (row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1)) AS id,
    (sum(dur + 400) OVER (PARTITION BY session_id ORDER BY ord) - dur - 400)::BIGINT AS start_ms, (sum(dur + 400) OVER (PARTITION BY session_id ORDER BY ord) - 400)::BIGINT AS end_ms,
    CASE WHEN (session_id * 7 + ord * 3) % 4 <> 3 THEN ((session_id * 7 + ord * 3) % 100) / 100.0::DOUBLE END AS confidence,
    CASE WHEN (session_id * 7 + ord * 3) % 10 <> 9 THEN ((session_id * 7 + ord * 3) % 10) / 10.0::DOUBLE END AS speaker_coverage,
    CASE WHEN (session_id * 7 + ord * 3) % 7 <> 6 THEN ((session_id * 7 + ord * 3 + 5) % 10) / 10.0::DOUBLE END AS speaker_purity
  FROM w
)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised segments with some defects."""
    k = F.col("session_id") + F.col("ord")
    return turns(spark, sf_dir).select(
        "session_id", "ord", "start_ms", F.when(k % 13 == 0, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(k % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text"))).alias("text"), "confidence",
    )


SEGMENTS = f"""{TURNS}, segments AS (
  SELECT session_id, ord, start_ms, CASE WHEN (session_id + ord) % 13 = 0 THEN start_ms ELSE end_ms END AS end_ms,
    CASE WHEN (session_id + ord) % 11 = 0 THEN '  ' ELSE ' ' || text END AS text, confidence
  FROM turns
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker spans that overlap turns and each other."""
    t = turns(spark, sf_dir)
    length = F.col("end_ms") - F.col("start_ms")
    label = lambda k: F.concat(F.lit("SPEAKER_0"), (k % 3).cast("string"))
    one = t.select("session_id", (F.col("ord") * 2).alias("ord"), F.greatest(F.lit(0).cast("bigint"), F.col("start_ms") - 500).alias("start_ms"),
                   (F.col("start_ms") + F.floor(length / 2)).alias("end_ms"), label(F.col("session_id") + F.col("ord")).alias("label"))
    two = t.select("session_id", (F.col("ord") * 2 + 1).alias("ord"), (F.col("start_ms") + F.floor(length * 2 / 5)).alias("start_ms"), (F.col("end_ms") + 300).alias("end_ms"),
                   label(F.col("session_id") + F.col("ord") * 2 + 1).alias("label"))
    return one.unionByName(two).filter("(session_id + ord) % 19 <> 0")


SPANS = """spans AS (
  SELECT * FROM (
    SELECT session_id, ord * 2 AS ord, greatest(0, start_ms - 500) AS start_ms, start_ms + (end_ms - start_ms) // 2 AS end_ms, 'SPEAKER_0' || ((session_id + ord) % 3) AS label FROM turns
    UNION ALL
    SELECT session_id, ord * 2 + 1, start_ms + (end_ms - start_ms) * 2 // 5, end_ms + 300, 'SPEAKER_0' || ((session_id + ord * 2 + 1) % 3) FROM turns
  ) WHERE (session_id + ord) % 19 <> 0
)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed entities: three turns make a window; some cite a turn that is not there."""
    t = turns(spark, sf_dir)
    k = F.col("session_id") + F.col("ord")
    word = F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(1)), "[^A-Za-z]", "")
    other = F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(2)), "[^A-Za-z]", "")
    return t.select(
        "session_id", F.floor(F.col("ord") / 3).alias("window_ix"), "ord", F.concat(F.lit("e"), F.col("ord").cast("string")).alias("entity_id"),
        F.when(F.col("ord") % 2 == 0, word).otherwise(F.upper(F.substring(word, 1, 2))).alias("name"), F.when(F.col("ord") % 4 < 2, "person").otherwise("Place").alias("kind"),
        F.array(F.lower(word), other, F.lit(" "), F.substring(word, 1, 2)).alias("aliases"),
        F.array("id", F.when(k % 17 == 0, F.lit("t99999")).when(k % 5 == 0, F.regexp_replace("id", "^t0", "t")).otherwise(F.lit("t00000"))).alias("turn_ids"),
    )


ENTITIES = """entities AS (
  SELECT session_id, ord // 3 AS window_ix, ord, 'e' || ord AS entity_id,
    CASE WHEN ord % 2 = 0 THEN word ELSE upper(substr(word, 1, 2)) END AS name, CASE WHEN ord % 4 < 2 THEN 'person' ELSE 'Place' END AS kind,
    [lower(word), other, ' ', substr(word, 1, 2)] AS aliases,
    [id, CASE WHEN (session_id + ord) % 17 = 0 THEN 't99999' WHEN (session_id + ord) % 5 = 0 THEN regexp_replace(id, '^t0', 't') ELSE 't00000' END] AS turn_ids
  FROM (SELECT *, regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g') AS word, regexp_replace(split_part(text, ' ', 2), '[^A-Za-z]', '', 'g') AS other FROM turns)
)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of two turns, proposed by both of them, with the turns in either order."""
    t = turns(spark, sf_dir)
    even = F.format_string("t%05d", F.col("ord") - F.col("ord") % 2)
    odd = F.format_string("t%05d", F.col("ord") - F.col("ord") % 2 + 1)
    return t.select(
        "session_id", F.floor(F.col("ord") / 3).alias("window_ix"), "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("scene_id"), F.substring("text", 1, 12).alias("title"),
        F.col("text").alias("summary"), F.when(F.col("ord") % 2 == 0, F.array(even, odd)).otherwise(F.array(odd, even, odd)).alias("turn_ids"),
    )


SCENES = """scenes AS (
  SELECT session_id, ord // 3 AS window_ix, ord, 's' || ord AS scene_id, substr(text, 1, 12) AS title, text AS summary,
    CASE WHEN ord % 2 = 0 THEN [printf('t%05d', ord), printf('t%05d', ord + 1)] ELSE [printf('t%05d', ord), printf('t%05d', ord - 1), printf('t%05d', ord)] END AS turn_ids
  FROM turns
)"""


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark, sf_dir).select("session_id", "window_ix", "ord", F.regexp_replace("scene_id", "s", "h").alias("thread_id"),
        F.when(F.col("ord") % 2 == 0, F.lit("Who took it")).otherwise(F.when(F.col("ord") % 4 == 1, F.lit(" WHO took it ")).otherwise(F.col("title"))).alias("description"), "turn_ids")


THREADS = """threads AS (
  SELECT session_id, window_ix, ord, replace(scene_id, 's', 'h') AS thread_id,
    CASE WHEN ord % 2 = 0 THEN 'Who took it' WHEN ord % 4 = 1 THEN ' WHO took it ' ELSE title END AS description, turn_ids FROM scenes
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    k = F.col("session_id") * 5 + F.col("ord") * 3
    return t.select(
        "session_id", "ord", F.concat(F.lit("q"), F.col("ord").cast("string")).alias("question_id"),
        F.when(F.col("ord") % 3 == 2, F.concat(F.lit(" "), F.lower(F.first("text").over(_by_session())))).otherwise(F.col("text")).alias("issue"),
        F.when(k % 2 == 0, F.substring("text", 5, 15)).alias("recommendation"), F.col("text").alias("why_it_matters"), F.array("id").alias("turn_ids"),
        ((k % 10) / 10.0).alias("confidence"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int")).alias("consequence"),
        F.when(k % 4 == 0, F.lit("answered")).otherwise(F.lit("open")).alias("status"), "start_ms", "end_ms",
    )


def _by_session():
    from pyspark.sql import Window

    return Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


QUESTIONS = """questions AS (
  SELECT session_id, ord, 'q' || ord AS question_id,
    CASE WHEN ord % 3 = 2 THEN ' ' || lower(first(text) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) ELSE text END AS issue,
    CASE WHEN (session_id * 5 + ord * 3) % 2 = 0 THEN substr(text, 5, 15) END AS recommendation, text AS why_it_matters, [id] AS turn_ids,
    ((session_id * 5 + ord * 3) % 10) / 10.0::DOUBLE AS confidence, ['low', 'medium', 'high'][((session_id * 5 + ord * 3) % 3 + 1)::INT] AS consequence,
    CASE WHEN (session_id * 5 + ord * 3) % 4 = 0 THEN 'answered' ELSE 'open' END AS status, start_ms, end_ms
  FROM turns
)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer key for every session: entity labels from its turns (some spoilt), events, anchors."""
    t = turns(spark, sf_dir)
    k = F.col("session_id") + F.col("ord")
    word = F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(1)), "[^A-Za-z]", "")
    entity = t.select("session_id", F.lit("important_entities").alias("grp"), "ord", F.concat(F.lit("The "), word, F.when(k % 3 == 0, F.lit("zzq")).otherwise(F.lit(""))).alias("label"),
        F.when(k % 2 == 0, "character").otherwise("place").alias("kind"), F.when(k % 4 == 0, "unverified").otherwise("verified").alias("status"),
        F.when(k % 5 != 0, F.when(k % 2 == 0, "heard").otherwise("published")).alias("basis"), F.when(k % 6 != 5, F.col("start_ms") + 100).alias("anchor_ms"))
    event = t.select("session_id", F.lit("important_events").alias("grp"), "ord", F.col("text").alias("label"), F.lit("event").alias("kind"), F.lit("verified").alias("status"),
        F.lit("heard").alias("basis"), F.when(k % 4 != 3, F.col("start_ms") + (F.col("ord") % 2) * 900000).alias("anchor_ms"))
    return entity.unionByName(event).withColumn("path", F.concat(F.lit("truth."), F.col("grp"), F.lit("["), F.col("ord").cast("string"), F.lit("]")))


TARGETS = """targets AS (
  SELECT *, 'truth.' || grp || '[' || ord || ']' AS path FROM (
    SELECT session_id, 'important_entities' AS grp, ord, 'The ' || regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g') || CASE WHEN (session_id + ord) % 3 = 0 THEN 'zzq' ELSE '' END AS label,
      CASE WHEN (session_id + ord) % 2 = 0 THEN 'character' ELSE 'place' END AS kind, CASE WHEN (session_id + ord) % 4 = 0 THEN 'unverified' ELSE 'verified' END AS status,
      CASE WHEN (session_id + ord) % 5 <> 0 THEN CASE WHEN (session_id + ord) % 2 = 0 THEN 'heard' ELSE 'published' END END AS basis,
      CASE WHEN (session_id + ord) % 6 <> 5 THEN start_ms + 100 END AS anchor_ms FROM turns
    UNION ALL
    SELECT session_id, 'important_events', ord, text, 'event', 'verified', 'heard', CASE WHEN (session_id + ord) % 4 <> 3 THEN start_ms + (ord % 2) * 900000 END FROM turns)
)"""


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative controls: terms of the benchmark, and one that sessions do hold."""
    b = read(spark, sf_dir, "benchmark").select(F.regexp_replace(F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)), "[^A-Za-z ]", "").alias("term"))
    return b.unionByName(spark.sql("SELECT explode(array('of the', 'and', 'Thon', 'is')) AS term")).distinct()


CONTROLS = """controls AS (
  SELECT DISTINCT term FROM (SELECT regexp_replace(array_to_string(split(text, ' ')[1:2], ' '), '[^A-Za-z ]', '', 'g') AS term FROM benchmark
  UNION ALL SELECT unnest(['of the', 'and', 'Thon', 'is']))
)"""

# Tokens of a text as the engine compares them, as SQL of a string expression.
def sql_tokens(x: str, dropped: str = "'the','a','an','of','and'") -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({dropped}))"


def sql_padded(x: str) -> str:
    return f"(' ' || array_to_string({sql_tokens(x)}, ' ') || ' ')"


def sql_mentions(text: str, term: str) -> str:
    return f"(len({sql_tokens(term)}) > 0 AND contains({sql_padded(text)}, {sql_padded(term)}))"


def sql_label(a: str, b: str) -> str:
    return f"(len({sql_tokens(a)}) > 0 AND length(array_to_string({sql_tokens(b)}, '')) >= 3 AND (contains({sql_padded(a)}, {sql_padded(b)}) OR contains({sql_padded(b)}, {sql_padded(a)})))"
