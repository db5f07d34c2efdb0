"""Claims about a session: citations, merges across windows, and the queue of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_id

# Weights of consequences.
WEIGHTS = {"high": 3, "medium": 2, "low": 1}


def cited(claims: DataFrame, claim: str, turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Citations with the turn that each names, if there is one."""
    t = turns.select(F.col(key).alias("_k"), F.col("id").alias("_id"), "start_ms", "end_ms")
    x = claims.select(key, claim, F.posexplode("turn_ids").alias("pos", "turn_id"))
    return x.join(t, (F.col(key) == F.col("_k")) & (F.col("turn_id") == F.col("_id")), "left").drop("_k")


def evidence(claims: DataFrame, claim: str, turns: DataFrame, key: str = "session_id", strict: bool = False) -> DataFrame:
    """The span of a claim's turns.  A claim that cites nothing, or a turn that is not there, has a null span; strict raises instead."""
    x = cited(claims, claim, turns, key)
    found = x.groupBy(key, claim).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count_if(F.col("_id").isNull()).alias("unknown"))
    out = claims.select(key, claim, F.size("turn_ids").alias("cites")).join(found, [key, claim], "left")
    bad = (F.col("cites") < 1) | (F.coalesce("unknown", F.lit(1)) > 0)
    start = F.when(~bad, F.col("start_ms"))
    if strict:
        start = start.otherwise(F.raise_error(F.concat(F.lit("unsupported claim "), F.col(claim).cast("string"))).cast("bigint"))
    return out.select(key, claim, start.alias("start_ms"), F.when(~bad, F.col("end_ms")).alias("end_ms"), (~bad).alias("supported"))


def resolved_ids(claims: DataFrame, claim: str, turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Cited ids by their exact form, or else by their form without leading zeros where that names one turn only."""
    exact = turns.select(F.col(key).alias("_k"), F.col("id").alias("exact"))
    loose = turns.groupBy(F.col(key).alias("_l"), canonical_id("id").alias("canonical")).agg(F.count("*").alias("n"), F.min("id").alias("loose")).filter("n = 1")
    x = claims.select(key, claim, F.posexplode("turn_ids").alias("pos", "turn_id")).withColumn("c", canonical_id("turn_id"))
    x = x.join(exact, (F.col(key) == F.col("_k")) & (F.col("turn_id") == F.col("exact")), "left").join(loose, (F.col(key) == F.col("_l")) & (F.col("c") == F.col("canonical")), "left")
    return x.select(key, claim, "pos", "turn_id", F.coalesce("exact", "loose").alias("resolved"))


def missing_citations(groups: list[DataFrame], turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Citations of turns that are not there, as occurrences and as distinct ids."""
    x = None
    for g in groups:
        ids = g.select(key, F.explode("turn_ids").alias("id"))
        x = ids if x is None else x.unionByName(ids)
    gone = x.join(turns.select(key, "id"), [key, "id"], "left_anti")
    return gone.groupBy(key).agg(F.count("*").alias("occurrences"), F.count_distinct("id").alias("distinct_ids"))


def sharing_turns(questions: DataFrame, entities: DataFrame, key: str = "session_id") -> DataFrame:
    """Entities whose evidence shares a turn with a question's."""
    q = questions.select(key, "question_id", F.explode("turn_ids").alias("id"))
    e = entities.select(key, "entity_id", F.explode("turn_ids").alias("id"))
    return q.join(e, [key, "id"]).select(key, "question_id", "entity_id").distinct()


def ordered_distinct(values: Column, fold=lambda x: x, excluding: Column | None = None) -> Column:
    """The first of each folded value, in order, without one folded value."""
    pairs = F.transform(values, lambda v: F.struct(fold(v).alias("k"), v.alias("v")))
    empty = F.slice(pairs, 1, 0)
    keep = F.aggregate(pairs, empty, lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    if excluding is not None:
        keep = F.filter(keep, lambda p: p["k"] != fold(excluding))
    return F.transform(keep, lambda p: p["v"])


def in_order(order: list[str], value: str) -> Column:
    """Values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])


def merge_entities(entities: DataFrame, key: str = "session_id") -> DataFrame:
    """A3: entities of all windows with one name and kind, whatever their case: the first spelling, aliases (blank ones left out) and turns in order and once."""
    by = [key, F.lower("name").alias("name_key"), F.lower("kind").alias("kind_key")]
    first = F.struct("window_ix", "ord")
    g = entities.groupBy(*by).agg(
        F.min_by("name", first).alias("name"), F.min_by("kind", first).alias("kind"), F.min("ord").alias("first_ord"),
        F.flatten(in_order(["window_ix", "ord"], "aliases")).alias("aliases"), F.flatten(in_order(["window_ix", "ord"], "turn_ids")).alias("turn_ids"),
    )
    aliases = F.filter(F.array_distinct("aliases"), lambda a: (F.trim(a) != "") & (F.lower(a) != F.col("name_key")))
    return g.select(key, "first_ord", "name", "kind", aliases.alias("aliases"), F.array_distinct("turn_ids").alias("turn_ids"))


def distinct_claims(claims: DataFrame, *more: Column, key: str = "session_id") -> DataFrame:
    """Claims whose sets of turns (and other keys) are equal are one; the first stays."""
    rows = claims.withColumn("_turns", F.array_sort(F.array_distinct("turn_ids")))
    names = []
    for i, c in enumerate(more):
        rows = rows.withColumn(f"_m{i}", c)
        names.append(f"_m{i}")
    w = Window.partitionBy(key, "_turns", *names).orderBy("window_ix", "ord")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_turns", *names)


def question_queue(questions: DataFrame, most: int = 10, key: str = "session_id") -> DataFrame:
    """One question an issue (whatever its case and the space around it), the weightiest and least certain first, `most` of them; how many were dropped is told."""
    if most < 1:
        raise ValueError("at least one question must be allowed")
    once = questions.withColumn("_n", F.row_number().over(Window.partitionBy(key, F.lower(F.trim("issue"))).orderBy("ord"))).filter("_n = 1").drop("_n")
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("consequence")]
    w = Window.partitionBy(key)
    ranked = once.withColumn("rank", F.row_number().over(w.orderBy(weight.desc(), "confidence", "ord"))).withColumn("dropped_count", F.greatest(F.lit(0), F.count("*").over(w) - most))
    return ranked.filter(F.col("rank") <= most)


def claim_texts(scenes: DataFrame, entities: DataFrame, threads: DataFrame, questions: DataFrame, key: str = "session_id") -> DataFrame:
    """Everything that is asserted, with where."""
    row = lambda df, kind, i, text: df.select(key, F.concat(F.lit(f"{kind}:"), F.col(i)).alias("where"), text.alias("text"))
    join = lambda *c: F.array_join(F.array(*[F.coalesce(x, F.lit("")) for x in c]), " ")
    c = F.col
    return (
        row(scenes, "scene", "scene_id", join(c("title"), c("summary")))
        .unionByName(row(entities, "entity", "entity_id", F.array_join(F.concat(F.array("name"), "aliases"), " ")))
        .unionByName(row(threads, "thread", "thread_id", c("description")))
        .unionByName(row(questions, "question", "question_id", join(c("issue"), c("recommendation"), c("why_it_matters"), c("consequence"))))
    )


def synthesis(final: DataFrame, candidates: DataFrame, key: str = "session_id") -> DataFrame:
    """The questions of the last pass, or a session's candidates where it returned none."""
    has = final.select(key).distinct()
    return final.withColumn("from_synthesis", F.lit(True)).unionByName(candidates.join(has, key, "left_anti").withColumn("from_synthesis", F.lit(False)))


def drafts(questions: DataFrame) -> DataFrame:
    """Trimmed drafts; a missing recommendation stays missing."""
    return questions.select("session_id", "question_id", F.trim("issue").alias("issue"), F.nullif(F.trim("recommendation"), F.lit("")).alias("recommendation"), F.trim("why_it_matters").alias("why_it_matters"), "confidence", F.lower(F.trim("consequence")).alias("consequence"))



