"""Everything that is wrong with a model's reply, each with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plugs import CONSEQUENCES, SAID


def _unpadded(turn_id: Column) -> Column:
    """An id with the number that ends it, if any, without leading zeros."""
    head = F.rtrim(turn_id, F.lit("0123456789"))
    digits = F.substr(turn_id, F.length(head) + 1)
    return F.when(digits == "", turn_id).otherwise(F.concat(head, F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _string(v: Column) -> Column:
    """The value where it is a string."""
    return F.when(_kind(v) == "STRING", v.try_cast("string"))


def findings(replies: DataFrame, keys: tuple[str, ...] = ("session_id", "window_ix")) -> DataFrame:
    """replies(keys, payload JSON, turn_ids of the window) -> keys, path, finding: every violation, not the first one only.

    Groups are lists of objects, or absent or null; what a claim must say is a string with more than space; it cites one turn at least, by strings, all of its window (by their exact id, or by one that differs in
    leading zeros from one known id only); a question's confidence is a number of [0, 1] and its consequence a known one.  A reply that is no object has one finding; paths count from 0.
    """
    keys = list(keys)
    told = lambda path, text: F.struct(path.alias("path"), F.lit(text).alias("finding"))
    read = replies.select(*keys, "turn_ids", F.try_parse_json("payload").alias("v"))
    # One pass: a reply is read once and goes on as a row a group, then a row an item; what is no object or no list goes on as a row of its own.
    groups = F.array(*[F.struct(F.lit(g).alias("grp"), _field(F.col("v"), g).alias("list"), F.array(*[F.lit(f) for f in fields]).alias("says")) for g, fields in SAID.items()])
    none_ = F.array(F.struct(F.lit(None).cast("string").alias("grp"), F.lit(None).cast("variant").alias("list"), F.lit(None).cast("array<string>").alias("says")))
    g = read.select(*keys, "turn_ids", F.explode(F.when(_kind(F.col("v")).startswith("OBJECT"), groups).otherwise(none_)).alias("g")).select(*keys, "turn_ids", "g.*")
    g = g.withColumn("kind", _kind(F.col("list"))).filter(F.col("grp").isNull() | (F.col("kind") != "VOID")).withColumn("listed", F.col("kind").startswith("ARRAY"))
    items = g.select(*keys, "turn_ids", "grp", "says", "listed", F.posexplode_outer(F.when(F.col("listed"), F.col("list").try_cast("array<variant>"))).alias("i", "x"))
    items = items.filter(~F.col("listed") | F.col("i").isNotNull()).withColumn("at", F.format_string("%s[%d]", "grp", "i"))
    x, question = F.col("x"), F.col("grp") == "questions"
    finding = lambda wrong, field, text: F.when(wrong, told(F.concat("at", F.lit(f".{field}")), text))
    rules = []
    for field in dict.fromkeys(f for fields in SAID.values() for f in fields):
        said = _string(_field(x, field))
        rules.append(finding(F.array_contains("says", F.lit(field)) & (F.coalesce(F.trim(said, F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""), field, "must be a string with more than space"))
    ids, confidence = _field(x, "turn_ids"), _field(x, "confidence")
    cites = F.coalesce(F.when(_kind(ids).startswith("ARRAY"), ids.try_cast("array<variant>")), F.array().cast("array<variant>"))
    number = ~_kind(confidence).isin("STRING", "BOOLEAN", "VOID") & confidence.try_cast("double").between(0, 1)
    rules += [
        finding(F.size(cites) < 1, "turn_ids", "must cite a turn"), finding(question & ~F.coalesce(number, F.lit(False)), "confidence", "must be a number from 0 to 1"),
        finding(question & ~F.coalesce(_string(_field(x, "consequence")).isin(*CONSEQUENCES), F.lit(False)), "consequence", "must be low, medium or high"),
    ]

    def stray(cited: Column, j: Column) -> Column:
        turn = F.get(cited, F.lit(0))
        blank = F.coalesce(F.trim(turn, F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
        loose = F.size(F.filter("turn_ids", lambda k: _unpadded(k) == _unpadded(turn))) == 1
        path = F.format_string("%s.turn_ids[%d]", "at", j)
        return F.when(blank, told(path, "must be a turn's id")).when(~F.array_contains("turn_ids", turn) & ~loose, told(path, "is no turn of the window"))

    said = F.transform(F.transform(cites, lambda v: F.array(_string(v))), stray)
    own = F.concat(F.array_compact(F.array(*rules)), F.filter(said, lambda f: f.isNotNull()))
    found = F.when(F.col("grp").isNull(), F.array(told(F.lit(""), "must be an object"))).when(~F.col("listed"), F.array(told(F.col("grp"), "must be a list of objects")))
    found = found.when(~_kind(x).startswith("OBJECT"), F.array(told(F.col("at"), "must be an object"))).otherwise(own)
    return items.select(*keys, F.explode(found).alias("f")).select(*keys, "f.path", "f.finding")
