"""Answers to review questions, the log of corrections, and the vocabulary that they teach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_surface
from ..sources.sessions import written
from .claims import ordered_distinct

# What a person may answer, and the state of the question after it.
STATUS = {"accept": "accepted", "correct": "corrected", "defer": "deferred", "irrelevant": "irrelevant"}
OPERATIONS = ("revise_entity", "merge_entities")
SHEET = "answered_by string, answers array<struct<question_id:string,action:string,note:string,answered_by:string,operation:struct<op:string,entity_id:string,name:string,entity_kind:string,absorbs:array<string>>>>"


def parse_sheets(sheets: DataFrame) -> DataFrame:
    """sheets(session_id, payload JSON) -> one row an answer."""
    x = sheets.withColumn("s", F.from_json("payload", SHEET)).select("session_id", "s.answered_by", F.posexplode("s.answers").alias("pos", "a"))
    who = F.coalesce(F.nullif(F.trim("a.answered_by"), F.lit("")), "answered_by")
    return x.select("session_id", "pos", who.alias("answered_by"), "a.question_id", "a.action", F.nullif(F.trim("a.note"), F.lit("")).alias("note"), F.col("a.operation").alias("operation"))


def sheet_findings(answers: DataFrame) -> DataFrame:
    """What is wrong with a sheet; a sheet with any finding is refused whole."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    o = F.col("operation")
    rules = [
        (blank(F.col("question_id")), "question_id must be given"),
        (~F.col("action").isin(*STATUS), "unknown action"),
        (F.col("action").isin("defer", "irrelevant") & o.isNotNull(), "this action carries no operation"),
        (o.isNotNull() & ~F.coalesce(o["op"], F.lit("")).isin(*OPERATIONS), "unknown operation"),
        (o.isNotNull() & blank(o["entity_id"]), "entity_id must be given"),
        ((o["op"] == "revise_entity") & o["name"].isNull() & o["entity_kind"].isNull(), "a revision must set something"),
        ((o["op"] == "merge_entities") & (F.coalesce(F.size(o["absorbs"]), F.lit(0)) < 1), "a merge must absorb something"),
        ((o["op"] == "merge_entities") & F.array_contains(o["absorbs"], o["entity_id"]), "an entity cannot absorb itself"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules]))
    own = answers.select("session_id", "pos", F.explode(found).alias("finding"))
    twice = answers.groupBy("session_id", "question_id").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).filter("n > 1").select("session_id", "pos", F.lit("a question has two answers").alias("finding"))
    return own.unionByName(twice)


def operation_findings(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Operations on an entity that is not there, and merges of unlike kinds (whatever their case) that do not say which kind stays."""
    o = F.col("operation")
    ids = F.array_distinct(F.concat(F.array(o["entity_id"]), F.coalesce(o["absorbs"], F.array().cast("array<string>"))))
    x = answers.filter(o["op"].isin(*OPERATIONS)).select("session_id", "pos", o["op"].alias("op"), o["entity_kind"].alias("said"), F.explode(ids).alias("entity_id"))
    have = entities.select("session_id", "entity_id", F.lower("kind").alias("kind"), F.lit(True).alias("there"))
    g = x.join(have, ["session_id", "entity_id"], "left").groupBy("session_id", "pos").agg(F.first("op").alias("op"), F.first("said").alias("said"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_distinct("kind").alias("kinds"))
    unlike = (F.col("op") == "merge_entities") & (F.col("kinds") > 1) & F.col("said").isNull()
    why = F.when(F.col("missing") > 0, "no such entity").when(unlike, "a merge across kinds must say which stays")
    return g.select("session_id", "pos", why.alias("finding")).filter("finding is not null")


def keys_touched(answers: DataFrame) -> DataFrame:
    """The question and the entities that an answer decides."""
    o = F.col("operation")
    names = F.when(o.isNotNull(), F.array_compact(F.concat(F.array(o["entity_id"]), F.coalesce(o["absorbs"], F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(F.concat(F.lit("question:"), F.col("question_id"))), F.transform(names, lambda e: F.concat(F.lit("entity:"), e)))
    return answers.select("session_id", "pos", "answered_by", F.explode(keys).alias("decided"))


def collisions(answers: DataFrame) -> DataFrame:
    """Entities that two answers of one sheet claim."""
    k = keys_touched(answers).filter(F.startswith("decided", F.lit("entity:")))
    return k.groupBy("session_id", "decided").agg(F.count_distinct("pos").alias("answers")).filter("answers > 1")


def latest_owners(log: DataFrame) -> DataFrame:
    """log(session_id, sequence, answered_by, decided) -> who last decided each key."""
    return log.groupBy("session_id", "decided").agg(F.max_by("answered_by", "sequence").alias("owner"))


def conflicts(answers: DataFrame, log: DataFrame) -> DataFrame:
    """J20, T-R8: keys of a sheet that somebody else has settled."""
    return keys_touched(answers).join(latest_owners(log), ["session_id", "decided"]).filter("owner <> answered_by").select("session_id", "pos", "decided", "owner", "answered_by")


def accepted(answers: DataFrame, log: DataFrame, override: bool = False, entities: DataFrame | None = None) -> DataFrame:
    """T-R2: answers of sheets without any finding, collision or conflict; a sheet is applied whole or not at all.  Operations are checked against entities, where these are given."""
    bad = sheet_findings(answers).select("session_id").unionByName(collisions(answers).select("session_id"))
    if entities is not None:
        bad = bad.unionByName(operation_findings(answers, entities).select("session_id"))
    if not override:
        bad = bad.unionByName(conflicts(answers, log).select("session_id"))
    return answers.join(bad.distinct(), "session_id", "left_anti")


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """entries(session_id, pos, ...) numbered after what each session's log holds."""
    have = log.groupBy("session_id").agg(F.max("sequence").alias("_last"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return entries.join(have, "session_id", "left").withColumn("sequence", (F.coalesce("_last", F.lit(0)) + n).cast("bigint")).drop("_last")


def originals(log: DataFrame) -> DataFrame:
    """What each target was before the first change to it."""
    return log.groupBy("session_id", "target").agg(F.min_by("before", F.struct("sequence", "pos")).alias("original"))


def dispositions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """T-R5: the state of every question after its answer."""
    to = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    a = answers.select("session_id", "question_id", to[F.col("action")].alias("after"))
    return questions.join(a, ["session_id", "question_id"], "left").withColumn("status", F.coalesce("after", "status")).drop("after")


def revised(entities: DataFrame, revisions: DataFrame) -> DataFrame:
    """T-R3: revisions(session_id, entity_id, new_name, new_kind); a name that is displaced becomes an alias."""
    x = entities.join(revisions, ["session_id", "entity_id"], "left")
    name = F.coalesce("new_name", "name")
    hit = F.col("new_name").isNotNull() | F.col("new_kind").isNotNull()
    aliases = F.when(hit, ordered_distinct(F.concat("aliases", F.array("name")), fold_surface, name)).otherwise(F.col("aliases"))
    return x.withColumn("aliases", aliases).withColumn("name", name).withColumn("kind", F.coalesce("new_kind", "kind")).drop("new_name", "new_kind")


def merged(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """G4, T-R4: merges(session_id, entity_id, absorbs, new_name, new_kind): survivors take the absorbed entities' surfaces and turns, in order.  A merge across kinds
    without a kind is not done (operation_findings refuses its sheet before)."""
    m = merges.select("session_id", F.col("entity_id").alias("survivor"), "new_name", "new_kind", F.posexplode(F.concat(F.array("entity_id"), "absorbs")).alias("place", "entity_id"))
    x = m.join(entities, ["session_id", "entity_id"])
    order = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("place", v))), lambda p: p["v"])
    g = x.withColumn("surfaces", F.when(F.col("place") == 0, F.concat("aliases", F.array("name"))).otherwise(F.concat(F.array("name"), "aliases"))).groupBy("session_id", "survivor").agg(
        F.count_distinct(F.lower("kind")).alias("kinds"), F.first("new_kind").alias("new_kind"), F.first("new_name").alias("new_name"), F.min_by("name", "place").alias("name"), F.min_by("kind", "place").alias("kind"),
        F.min_by("ord", "place").alias("ord"), F.flatten(order(F.col("surfaces").alias("v"))).alias("surfaces"), F.flatten(order(F.col("turn_ids").alias("v"))).alias("turns"),
    ).filter("kinds = 1 or new_kind is not null")
    name = F.coalesce("new_name", "name")
    done = g.select("session_id", F.col("survivor").alias("entity_id"), "ord", name.alias("name"), F.coalesce("new_kind", "kind").alias("kind"), ordered_distinct(F.col("surfaces"), fold_surface, name).alias("aliases"), F.array_distinct("turns").alias("turn_ids"))
    gone = m.join(done.select("session_id", F.col("entity_id").alias("survivor")), ["session_id", "survivor"], "left_semi").select("session_id", "entity_id")
    return entities.join(gone, ["session_id", "entity_id"], "left_anti").select(*done.columns).unionByName(done)


def contested(approvals: DataFrame) -> DataFrame:
    """approvals(entry, approver, canonical, seq): entries on which the latest approvals of their approvers differ.  It asks for no order, so late approvals just recompute it."""
    last = approvals.groupBy("entry", "approver").agg(F.max_by(fold_surface("canonical"), "seq").alias("c"))
    return last.groupBy("entry").agg((F.count_distinct("c") > 1).alias("contested"), F.count("*").alias("approvers"))


#: An approval is known by what it says: folded kind, name, aliases and approver.  Its number orders it, and its id where numbers are equal.
IDENTIFIED = "approval_id string, kind_key string, kind string, canonical string, aliases array<string>, approver string, seq bigint, surfaces array<string>"


def identified(approvals: DataFrame) -> DataFrame:
    """approvals(kind, canonical, aliases, approver, seq) with an id and their folded surfaces, one a name, the canonical one first.  Numbers need not be unique: each session may count its own.  Without a kind or a name an approval settles nothing and is left out."""
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull())
    x = approvals.filter(F.col("kind").isNotNull() & F.col("canonical").isNotNull()).select(fold_surface("kind").alias("kind_key"), "kind", "canonical", aliases.alias("aliases"), "approver", F.col("seq").cast("bigint").alias("seq"))
    said = F.concat_ws("\x1f", "kind_key", "canonical", F.array_join("aliases", "\x1e"), F.coalesce("approver", F.lit("\x1d")))
    surfaces = F.transform(F.concat(F.array("canonical"), "aliases"), fold_surface)
    return x.select(F.md5(said.cast("binary")).alias("approval_id"), *x.columns, surfaces.alias("surfaces"))


def vocabulary(approvals: DataFrame) -> DataFrame:
    """S15, J13, T-R7: approvals(kind, canonical, aliases, approver, seq) -> entries: approvals of one kind that share a surface, directly or through others, are one entry.

    An entry is known by its kind and its least surface (kind_key, root).  Its latest approval gives its canonical name, its kind's spelling and its number; aliases follow from the latest approval to the first, each
    surface in its latest spelling.  It is contested where the latest approvals of its approvers differ in the name.
    """
    order = F.struct(F.coalesce("seq", F.lit(-(1 << 62))), "approval_id")
    same = ["approval_id", "kind_key", "canonical", "aliases", "approver", "surfaces"]
    once = written(identified(approvals).groupBy(*same).agg(F.max("seq").alias("seq"), F.max_by("kind", F.struct("seq", "kind")).alias("kind")), "approvals")
    roots = entries_of(once.select("approval_id", F.explode(F.transform(F.array_distinct("surfaces"), lambda s: F.concat_ws("\x1f", "kind_key", s))).alias("key")))
    x = once.join(roots, "approval_id").withColumn("at", order).withColumn("names", F.concat(F.array("canonical"), "aliases"))
    last = x.groupBy("root", "approver").agg(F.max_by(fold_surface("canonical"), "at").alias("c")).groupBy("root").agg((F.count_distinct("c") > 1).alias("contested"))
    late = F.reverse(F.array_sort(F.collect_list(F.struct("at", "names"))))
    g = x.groupBy("root").agg(F.max_by(F.struct("kind", "canonical", "seq"), "at").alias("l"), F.flatten(F.transform(late, lambda r: r["names"])).alias("names"), F.count("*").alias("approvals")).join(last, "root")
    return g.select(
        F.split_part("root", F.lit("\x1f"), F.lit(1)).alias("kind_key"), F.split_part("root", F.lit("\x1f"), F.lit(2)).alias("root"), "l.kind", F.col("l.seq").alias("entry"), "l.canonical",
        ordered_distinct(F.col("names"), fold_surface, F.col("l.canonical")).alias("aliases"), "contested", "approvals",
    )


def entries_of(edges: DataFrame) -> DataFrame:
    """edges(approval_id, key) -> approval_id, root: approvals that share a key are joined; the root is their least key.

    Each round gives a key the least root of its approvals, an approval the least of its keys, and then follows roots to their own; the rounds needed grow with the logarithm of a chain.
    """
    edges = written(edges, "edges")
    now = edges.groupBy("approval_id").agg(F.min("key").alias("root"))
    before = None
    while True:
        by_key = edges.join(now, "approval_id").groupBy("key").agg(F.min("root").alias("root"))
        least = edges.join(by_key, "key").groupBy("approval_id").agg(F.min("root").alias("root"))
        jump = by_key.select(F.col("key").alias("_k"), F.col("root").alias("_r"))
        now = written(least.join(jump, F.col("root") == F.col("_k"), "left").select("approval_id", F.least("root", "_r").alias("root")), "entries")
        told = now.agg(F.sum(F.xxhash64("approval_id", "root").cast("decimal(38,0)")), F.count("*")).first()  # two numbers
        if told == before:
            return now
        before = told


def surfaces(vocab: DataFrame) -> DataFrame:
    """Folded kinds and surfaces that belong to one entry only (J12): entries are told apart by their root, or by their number in a table without roots."""
    who = F.col("root") if "root" in vocab.columns else F.col("entry")
    x = vocab.select(who.alias("_who"), fold_surface("kind").alias("k"), F.explode(F.concat(F.array("canonical"), "aliases")).alias("s"), "entry", "canonical", "contested").withColumn("s", fold_surface("s"))
    return x.groupBy("k", "s").agg(F.count_distinct("_who").alias("n"), F.first("entry").alias("entry"), F.first("canonical").alias("canonical"), F.first("contested").alias("contested")).filter("n = 1").drop("n")


def carried(entities: DataFrame, vocab: DataFrame) -> DataFrame:
    """T-R6: what happens to each entity's name: no entry, already canonical, declined as contested, or renamed; by its first surface that names one entry."""
    e = entities.select("session_id", "entity_id", "name", fold_surface("kind").alias("k"), F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "s")).withColumn("s", fold_surface("s"))
    hit = e.join(surfaces(vocab), ["k", "s"]).groupBy("session_id", "entity_id").agg(F.min_by(F.struct("canonical", "contested"), "pos").alias("v"))
    x = entities.join(hit, ["session_id", "entity_id"], "left")
    outcome = F.when(F.col("v").isNull(), "unknown").when(fold_surface("v.canonical") == fold_surface("name"), "kept").when(F.col("v.contested"), "declined").otherwise("renamed")
    return x.select("session_id", "entity_id", outcome.alias("outcome"), F.when(outcome == "renamed", F.col("v.canonical")).otherwise(F.col("name")).alias("name"))


def learned(answers: DataFrame) -> DataFrame:
    """T-R9: operations that settle a name."""
    o = F.col("operation")
    return answers.filter(o.isNotNull() & (o["name"].isNotNull() | (o["op"] == "merge_entities")) & F.col("action").isin("accept", "correct"))


