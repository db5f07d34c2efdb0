"""Queries on answers, corrections and vocabulary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corrections as C
from . import register, tables as t
from .claims import _ALL


def answers(spark, d):
    """An answer for some questions of each session, some of them wrong in some way."""
    q = t.questions(spark, d)
    k = F.col("session_id") + F.col("ord")
    e = lambda n: F.concat(F.lit("e"), (F.col("ord") + n).cast("string"))
    none = F.lit(None).cast("string")
    revise = F.struct(F.lit("revise_entity").alias("op"), e(0).alias("entity_id"), F.when(k % 9 != 0, F.substring("issue", 1, 6)).alias("name"), none.alias("entity_kind"), F.lit(None).cast("array<string>").alias("absorbs"))
    merge = F.struct(F.lit("merge_entities").alias("op"), e(0).alias("entity_id"), none.alias("name"), F.when(k % 2 == 0, F.lit("person")).alias("entity_kind"), F.array(F.when(k % 173 == 0, e(0)).otherwise(e(3))).alias("absorbs"))
    op = F.when(k % 4 == 1, revise).when(k % 8 == 2, merge)
    action = F.when(k % 211 == 0, "maybe").when(op.isNotNull(), F.when(k % 191 == 0, "defer").otherwise("correct")).when(k % 3 == 0, "accept").otherwise("irrelevant")
    return q.select("session_id", F.col("ord").alias("pos"), F.concat(F.lit("p"), (F.col("session_id") % 3).cast("string")).alias("answered_by"), F.when(k % 311 != 0, F.col("question_id")).otherwise(F.lit(" ")).alias("question_id"), action.alias("action"), op.alias("operation"))


_A = f"""{_ALL}, answers AS (SELECT session_id, ord AS pos, 'p' || (session_id % 3) AS answered_by, CASE WHEN k % 311 <> 0 THEN question_id ELSE ' ' END AS question_id, op, entity_id, name, kind, absorbs,
    CASE WHEN k % 211 = 0 THEN 'maybe' WHEN op IS NOT NULL THEN CASE WHEN k % 191 = 0 THEN 'defer' ELSE 'correct' END WHEN k % 3 = 0 THEN 'accept' ELSE 'irrelevant' END AS action
  FROM (SELECT *, session_id + ord AS k, CASE WHEN (session_id + ord) % 4 = 1 THEN 'revise_entity' WHEN (session_id + ord) % 8 = 2 THEN 'merge_entities' END AS op, 'e' || ord AS entity_id,
    CASE WHEN (session_id + ord) % 4 = 1 AND (session_id + ord) % 9 <> 0 THEN substr(issue, 1, 6) END AS name, CASE WHEN (session_id + ord) % 4 <> 1 AND (session_id + ord) % 8 = 2 AND (session_id + ord) % 2 = 0 THEN 'person' END AS kind,
    CASE WHEN (session_id + ord) % 4 <> 1 AND (session_id + ord) % 8 = 2 THEN [CASE WHEN (session_id + ord) % 173 = 0 THEN 'e' || ord ELSE 'e' || (ord + 3) END] END AS absorbs FROM questions)),
findings AS (SELECT session_id, pos, finding FROM (SELECT session_id, pos, unnest([CASE WHEN trim(question_id) = '' THEN 'question_id must be given' END, CASE WHEN action = 'maybe' THEN 'unknown action' END, CASE WHEN action IN ('defer', 'irrelevant') AND op IS NOT NULL THEN 'this action carries no operation' END,
    CASE WHEN op = 'revise_entity' AND name IS NULL AND kind IS NULL THEN 'a revision must set something' END, CASE WHEN op = 'merge_entities' AND list_contains(absorbs, entity_id) THEN 'an entity cannot absorb itself' END]) AS finding FROM answers) WHERE finding IS NOT NULL
  UNION ALL SELECT session_id, min(pos), 'a question has two answers' FROM answers GROUP BY session_id, question_id HAVING count(*) > 1),
touched AS (SELECT session_id, pos, answered_by, unnest(list_concat(['question:' || question_id], CASE WHEN op IS NULL THEN [] ELSE list_transform(list_concat([entity_id], coalesce(absorbs, [])), lambda e: 'entity:' || e) END)) AS decided FROM answers),
coll AS (SELECT session_id, decided, count(DISTINCT pos) AS answers FROM touched WHERE starts_with(decided, 'entity:') GROUP BY 1, 2 HAVING count(DISTINCT pos) > 1),
log AS (SELECT user_id AS session_id, event_id AS sequence, 'p' || (event_id % 3) AS answered_by, CASE WHEN event_id % 2 = 0 THEN 'question:q' || (event_id % 397) ELSE 'entity:e' || (event_id % 397) END AS decided, event_type AS before, event_id % 5 AS pos FROM events),
owners AS (SELECT session_id, decided, arg_max(answered_by, sequence) AS owner FROM log GROUP BY 1, 2),
conf AS (SELECT t.session_id, pos, decided, owner, answered_by FROM touched t JOIN owners o USING (session_id, decided) WHERE owner <> answered_by),
opf AS (SELECT session_id, pos, CASE WHEN missing > 0 THEN 'no such entity' ELSE 'a merge across kinds must say which stays' END AS finding FROM (
    SELECT p.session_id, p.pos, p.op, p.said, count(*) FILTER (WHERE e.entity_id IS NULL) AS missing, count(DISTINCT lower(e.kind)) AS kinds
    FROM (SELECT session_id, pos, op, kind AS said, unnest(list_distinct(list_concat([entity_id], coalesce(absorbs, [])))) AS entity_id FROM answers WHERE op IS NOT NULL) p
    LEFT JOIN entities e ON e.session_id = p.session_id AND e.entity_id = p.entity_id GROUP BY 1, 2, 3, 4) WHERE missing > 0 OR (op = 'merge_entities' AND kinds > 1 AND said IS NULL)),
bad AS (SELECT session_id FROM findings UNION SELECT session_id FROM coll UNION SELECT session_id FROM conf UNION SELECT session_id FROM opf)"""
W = f"WITH {_A} "


def log(spark, d):
    e = t.read(spark, d, "events")
    k = F.col("event_id")
    decided = F.when(k % 2 == 0, F.concat(F.lit("question:q"), (k % 397).cast("string"))).otherwise(F.concat(F.lit("entity:e"), (k % 397).cast("string")))
    return e.select(F.col("user_id").alias("session_id"), k.alias("sequence"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("answered_by"), decided.alias("decided"), F.col("event_type").alias("before"), (k % 5).alias("pos"))


@register("s14_correction_log", f"{W} SELECT session_id, count(*) AS entries, max(sequence) AS last FROM log GROUP BY 1")
def s14(spark, d):
    return log(spark, d).groupBy("session_id").agg(F.count("*").alias("entries"), F.max("sequence").alias("last"))


@register("v14_sheet_findings", f"{W} SELECT * FROM findings")
def v14(spark, d):
    return C.sheet_findings(answers(spark, d))


@register("s16_answer_sheets", f"{W} SELECT session_id, pos, answered_by, question_id, action, op FROM answers")
def s16(spark, d):
    """Sheets written as JSON and parsed again."""
    a = answers(spark, d)
    one = F.struct("question_id", "action", F.lit(None).cast("string").alias("note"), F.lit(" ").alias("answered_by"), "operation")
    sheets = a.groupBy("session_id").agg(F.to_json(F.struct(F.first("answered_by").alias("answered_by"), F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("a")))), lambda x: x["a"]).alias("answers"))).alias("payload"))
    return C.parse_sheets(sheets).select("session_id", F.col("pos").cast("bigint").alias("pos"), "answered_by", "question_id", "action", F.col("operation.op").alias("op"))


@register("j23_sheet_collisions", f"{W} SELECT * FROM coll")
def j23(spark, d):
    return C.collisions(answers(spark, d))


@register("v15_operation_findings", f"{W} SELECT * FROM opf")
def v15(spark, d):
    return C.operation_findings(answers(spark, d), t.entities(spark, d))


@register("j20_prior_decisions", f"{W} SELECT * FROM conf")
def j20(spark, d):
    return C.conflicts(answers(spark, d), log(spark, d))


@register("tr2_accepted_sheets", f"{W} SELECT session_id, pos, action FROM answers WHERE session_id NOT IN (SELECT session_id FROM bad)")
def tr2(spark, d):
    return C.accepted(answers(spark, d), log(spark, d), entities=t.entities(spark, d)).select("session_id", "pos", "action")


@register("tr8_overridden_conflicts", f"{W} SELECT session_id, pos, action FROM answers WHERE session_id NOT IN (SELECT session_id FROM findings UNION SELECT session_id FROM coll UNION SELECT session_id FROM opf)")
def tr8(spark, d):
    return C.accepted(answers(spark, d), log(spark, d), override=True, entities=t.entities(spark, d)).select("session_id", "pos", "action")


@register("w7_original_values", f"{W} SELECT session_id, decided AS target, arg_min(before, (sequence, pos)) AS original FROM log GROUP BY 1, 2")
def w7(spark, d):
    return C.originals(log(spark, d).withColumnRenamed("decided", "target"))


@register("w8_log_sequence", f"{W} SELECT a.session_id, a.pos, coalesce(l.last, 0) + row_number() OVER (PARTITION BY a.session_id ORDER BY a.pos) AS sequence FROM answers a LEFT JOIN (SELECT session_id, max(sequence) AS last FROM log GROUP BY 1) l ON l.session_id = a.session_id")
def w8(spark, d):
    return C.appended(log(spark, d), answers(spark, d)).select("session_id", "pos", "sequence")


@register("w10_latest_owners", f"{W} SELECT * FROM owners")
def w10(spark, d):
    return C.latest_owners(log(spark, d))


@register("p22_log_filter", f"{W} SELECT session_id, sequence, pos > 0 AS applied FROM log WHERE answered_by = 'p1'")
def p22(spark, d):
    return log(spark, d).filter("answered_by = 'p1'").select("session_id", "sequence", (F.col("pos") > 0).alias("applied"))


@register("tr5_question_status", f"{W} SELECT q.session_id, q.question_id, coalesce(CASE action WHEN 'accept' THEN 'accepted' WHEN 'correct' THEN 'corrected' WHEN 'defer' THEN 'deferred' WHEN 'irrelevant' THEN 'irrelevant' END, status) AS status FROM questions q LEFT JOIN answers a ON a.session_id = q.session_id AND a.question_id = q.question_id")
def tr5(spark, d):
    return C.dispositions(t.questions(spark, d), answers(spark, d)).select("session_id", "question_id", "status")


_FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@register("tr3_revised_entities", f"""{W}, rv AS (SELECT session_id, entity_id, name AS new_name FROM answers WHERE op = 'revise_entity' AND name IS NOT NULL),
  x AS (SELECT e.session_id, e.entity_id, coalesce(new_name, name) AS name, new_name IS NOT NULL AS hit, aliases, list_concat(aliases, [name]) AS s FROM entities e LEFT JOIN rv ON rv.session_id = e.session_id AND rv.entity_id = e.entity_id),
  y AS (SELECT session_id, entity_id, name, p, s[p] AS v FROM (SELECT *, unnest(range(1, len(s) + 1)) AS p FROM x)),
  z AS (SELECT session_id, entity_id, list(v ORDER BY p) AS al FROM (SELECT session_id, entity_id, {_FOLD.format('v')} AS f, arg_min(v, p) AS v, min(p) AS p FROM y WHERE {_FOLD.format('v')} <> {_FOLD.format('name')} GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT x.session_id, x.entity_id, name, array_to_string(CASE WHEN hit THEN coalesce(al, []) ELSE aliases END, '|') AS aliases FROM x LEFT JOIN z ON z.session_id = x.session_id AND z.entity_id = x.entity_id""")
def tr3(spark, d):
    r = answers(spark, d).filter("operation.op = 'revise_entity' and operation.name is not null").select("session_id", "operation.entity_id", F.col("operation.name").alias("new_name"), F.lit(None).cast("string").alias("new_kind"))
    return C.revised(t.entities(spark, d), r).select("session_id", "entity_id", "name", F.array_join("aliases", "|").alias("aliases"))


_MG = f"""{W}, mg AS (SELECT session_id, entity_id AS survivor, kind AS new_kind, list_concat([entity_id], absorbs) AS parts FROM answers WHERE op = 'merge_entities' AND NOT list_contains(absorbs, entity_id)),
  mp AS (SELECT session_id, survivor, new_kind, p - 1 AS place, parts[p] AS entity_id FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS p FROM mg)),
  mx AS (SELECT mp.*, e.name, e.kind, e.turn_ids, CASE WHEN place = 0 THEN list_concat(aliases, [name]) ELSE list_concat([name], aliases) END AS surf FROM mp JOIN entities e ON e.session_id = mp.session_id AND e.entity_id = mp.entity_id),
  ok AS (SELECT session_id, survivor, coalesce(max(new_kind), arg_min(kind, place)) AS kind, arg_min(name, place) AS name, flatten(list(turn_ids ORDER BY place)) AS tids FROM mx GROUP BY 1, 2 HAVING count(DISTINCT lower(kind)) = 1 OR max(new_kind) IS NOT NULL)"""


def merges(spark, d):
    a = answers(spark, d).filter("operation.op = 'merge_entities' and not array_contains(operation.absorbs, operation.entity_id)")
    return a.select("session_id", "operation.entity_id", "operation.absorbs", F.lit(None).cast("string").alias("new_name"), F.col("operation.entity_kind").alias("new_kind"))


@register("tr4_merged_entities", f"""{_MG}, tv AS (SELECT session_id, survivor, v, min(p) AS p FROM (SELECT session_id, survivor, p, tids[p] AS v FROM (SELECT *, unnest(range(1, len(tids) + 1)) AS p FROM ok)) GROUP BY 1, 2, 3)
SELECT session_id, entity_id, name, kind, array_to_string(turn_ids, ',') AS turn_ids FROM entities e WHERE NOT EXISTS (SELECT 1 FROM mp JOIN ok USING (session_id, survivor) WHERE mp.session_id = e.session_id AND mp.entity_id = e.entity_id)
UNION ALL SELECT ok.session_id, survivor, name, kind, (SELECT string_agg(v, ',' ORDER BY p) FROM tv WHERE tv.session_id = ok.session_id AND tv.survivor = ok.survivor) FROM ok""")
def tr4(spark, d):
    return C.merged(t.entities(spark, d), merges(spark, d)).select("session_id", "entity_id", "name", "kind", F.array_join("turn_ids", ",").alias("turn_ids"))


register("g4_merge_absorption", f"{_MG} SELECT session_id, count(*) AS entities FROM (SELECT session_id, entity_id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM mp JOIN ok USING (session_id, survivor) WHERE mp.session_id = e.session_id AND mp.entity_id = e.entity_id) UNION ALL SELECT session_id, survivor FROM ok) GROUP BY 1")(
    lambda spark, d: C.merged(t.entities(spark, d), merges(spark, d)).groupBy("session_id").agg(F.count("*").alias("entities"))
)


@register("tr9_learned_names", f"{W} SELECT session_id, pos FROM answers WHERE op IS NOT NULL AND (name IS NOT NULL OR op = 'merge_entities') AND action IN ('accept', 'correct')")
def tr9(spark, d):
    return C.learned(answers(spark, d)).select("session_id", "pos")


@register("tr2_sheet_transactions", f"""{W}, lst AS (SELECT session_id, max(sequence) AS last FROM log GROUP BY 1), good AS (SELECT * FROM answers WHERE session_id NOT IN (SELECT session_id FROM bad))
SELECT session_id, coalesce(last, 0) + row_number() OVER (PARTITION BY session_id ORDER BY pos) AS sequence, answered_by, question_id, action, question_id <> '' AND op IS NOT NULL AS changes FROM good LEFT JOIN lst USING (session_id)""")
def tr2_stream(spark, d):
    """Sheets arrive in two lots on a log that is there; each lot is a transaction of a stream that is stopped and started between them."""
    from ..sources import sessions
    from ..streaming import sheets as S

    base = sessions.shared_folder(spark, "sheets")
    store = S.Versions(spark, f"{base}/store")
    old = log(spark, d).select("session_id", "sequence", F.col("pos").cast("int").alias("pos"), "answered_by", F.lit(None).cast("string").alias("question_id"), F.lit(None).cast("string").alias("action"), F.array("decided").alias("decided"))
    old.write.parquet(f"{base}/store/log/version-before")
    S.write_document(f"{base}/store/manifests/0.json", {"batch": -1, "tables": {"log": ["log/version-before"]}})
    one = F.struct("question_id", "action", F.lit(None).cast("string").alias("note"), F.lit(" ").alias("answered_by"), "operation")
    rows = answers(spark, d).groupBy("session_id").agg(F.to_json(F.struct(F.first("answered_by").alias("answered_by"), F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("a")))), lambda x: x["a"]).alias("answers"))).alias("payload"))
    for lot in (1, 0):
        rows.filter(F.pmod("session_id", F.lit(2)) == lot).coalesce(2).write.mode("append").parquet(f"{base}/in")
        S.sheet_stream(spark, f"{base}/in", store, f"{base}/checkpoint", t.entities(spark, d))
    return store.read("log", S.LOG).filter("action is not null").select("session_id", "sequence", "answered_by", "question_id", "action", (F.size("decided") > 1).alias("changes"))


def approvals(spark, d):
    """Each session counts its own approvals, so numbers repeat across sessions."""
    e = t.read(spark, d, "events")
    k = F.col("event_id")
    own = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    return e.select(F.concat(F.lit("kind "), (F.col("user_id") % 3).cast("string")).alias("kind"), (k % 20).alias("entry"), F.concat("event_type", F.lit(" "), (k % 60).cast("string")).alias("canonical"),
        F.array(F.concat(F.lit("alias "), (k % 60).cast("string"))).alias("aliases"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("approver"), k.alias("event_id"), own.alias("seq"))


@register("a39_contested", "WITH l AS (SELECT event_id % 20 AS entry, 'p' || (user_id % 5) AS approver, arg_max(lower(event_type || ' ' || (event_id % 60)), event_id) AS c FROM events GROUP BY 1, 2) SELECT entry, count(DISTINCT c) > 1 AS contested, count(*) AS approvers FROM l GROUP BY 1")
def a39(spark, d):
    return C.contested(approvals(spark, d).withColumn("seq", F.col("event_id")))


#: Canonical names and aliases of one number belong together here, so an entry is a kind and a number.  Sessions number their approvals themselves; of equal numbers the greater id is the later.
VOCABULARY = r"""WITH o AS (SELECT kind, n, canonical, approver, max(seq) AS seq, md5(kind || chr(31) || canonical || chr(31) || 'alias ' || n || chr(31) || approver) AS id
    FROM (SELECT 'kind ' || (user_id % 3) AS kind, event_id % 60 AS n, event_type || ' ' || (event_id % 60) AS canonical, 'p' || (user_id % 5) AS approver, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events) GROUP BY ALL),
  l AS (SELECT kind, n, approver, lower(canonical) AS c FROM o QUALIFY row_number() OVER (PARTITION BY kind, n, approver ORDER BY seq DESC, id DESC) = 1), k AS (SELECT kind, n, count(DISTINCT c) > 1 AS contested FROM l GROUP BY 1, 2),
  top AS (SELECT kind, n, seq AS entry, canonical FROM o QUALIFY row_number() OVER (PARTITION BY kind, n ORDER BY seq DESC, id DESC) = 1),
  nm AS (SELECT kind, n, s, f, seq, id, p FROM (SELECT kind, n, seq, id, unnest([canonical, 'alias ' || n]) AS s, unnest([0, 1]) AS p, lower(unnest([canonical, 'alias ' || n])) AS f FROM o)
    QUALIFY row_number() OVER (PARTITION BY kind, n, f ORDER BY seq DESC, id DESC, p) = 1),
  al AS (SELECT nm.kind, nm.n, min(f) AS root, list(s ORDER BY seq DESC, id DESC, p) FILTER (WHERE f <> lower(top.canonical)) AS aliases FROM nm JOIN top ON top.kind = nm.kind AND top.n = nm.n GROUP BY 1, 2),
  v AS (SELECT kind, root, entry, canonical, aliases, contested, approvals FROM top JOIN al USING (kind, n) JOIN k USING (kind, n) JOIN (SELECT kind, n, count(*) AS approvals FROM o GROUP BY 1, 2) USING (kind, n))"""


@register("j13_vocabulary_fold", VOCABULARY + " SELECT kind, root, entry, canonical, array_to_string(aliases, '|') AS aliases, contested, approvals FROM v")
def j13(spark, d):
    """Entries are components of approvals by their surfaces."""
    return C.vocabulary(approvals(spark, d)).withColumn("aliases", F.array_join("aliases", "|")).drop("kind_key")


_V = "v AS (SELECT entry, 'kind ' || (entry % 3) AS kind, 'Name ' || entry AS canonical, ['alias ' || entry, 'shared ' || (entry % 4), 'Thon'] AS aliases, entry % 5 = 0 AS contested FROM (SELECT DISTINCT event_id % 20 AS entry FROM events)), sf AS (SELECT kind AS k, s, count(DISTINCT entry) AS n, min(entry) AS entry FROM (SELECT *, lower(trim(unnest(list_concat([canonical], aliases)))) AS s FROM v) GROUP BY 1, 2)"


def small_vocab(spark, d):
    e = approvals(spark, d).select("entry").distinct()
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    k = F.col("entry")
    return e.select("entry", c("kind ", k % 3).alias("kind"), c("Name ", k).alias("canonical"), F.array(c("alias ", k), c("shared ", k % 4), F.lit("Thon")).alias("aliases"), (k % 5 == 0).alias("contested"))


@register("j12_unique_surfaces", f"WITH {_V} SELECT k, s, entry FROM sf WHERE n = 1")
def j12(spark, d):
    return C.surfaces(small_vocab(spark, d)).select("k", "s", "entry")


register("p8_uncontested_names", f"WITH {_V} SELECT kind, canonical FROM v WHERE NOT contested")(lambda spark, d: small_vocab(spark, d).filter("not contested").select("kind", "canonical"))


@register("tr6_carry_forward", f"""WITH {_V}, en AS (SELECT event_id AS entity_id, user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'Name ' || (event_id % 23) ELSE 'x' END AS name, 'kind ' || (event_id % 3) AS kind, ['alias ' || (event_id % 23), 'thon'] AS aliases FROM events),
  ex AS (SELECT *, p, lower(trim(s[p])) AS f FROM (SELECT *, list_concat([name], aliases) AS s, unnest(range(1, 4)) AS p FROM en)), h AS (SELECT session_id, entity_id, arg_min(sf.entry, p) AS entry FROM ex JOIN sf ON sf.k = ex.kind AND sf.s = f AND n = 1 GROUP BY 1, 2)
SELECT en.session_id, en.entity_id, CASE WHEN v.entry IS NULL THEN 'unknown' WHEN lower(canonical) = lower(name) THEN 'kept' WHEN contested THEN 'declined' ELSE 'renamed' END AS outcome,
  CASE WHEN v.entry IS NOT NULL AND lower(canonical) <> lower(name) AND NOT contested THEN canonical ELSE name END AS name FROM en LEFT JOIN h USING (session_id, entity_id) LEFT JOIN v ON v.entry = h.entry""")
def tr6(spark, d):
    k = F.col("event_id")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    e = t.read(spark, d, "events").select(k.alias("entity_id"), F.col("user_id").alias("session_id"), F.when(k % 2 == 0, c("Name ", k % 23)).otherwise(F.lit("x")).alias("name"), c("kind ", k % 3).alias("kind"), F.array(c("alias ", k % 23), F.lit("thon")).alias("aliases"))
    return C.carried(e, small_vocab(spark, d))
