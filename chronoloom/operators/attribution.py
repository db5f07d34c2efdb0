"""Segments, the speakers who overlap them, and what that is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap_ms
from .clock import numbered


def quarantine(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, with ids without gaps; rejected, with reason, place and length but never the words)."""
    text = F.trim(F.coalesce("text", F.lit("")))
    reason = F.when(text == "", "empty text").when((F.col("end_ms") <= F.col("start_ms")) | (F.col("start_ms") < 0), "non-positive span")
    marked = segments.withColumn("reason", reason).withColumn("text", text)
    kept = numbered(marked.filter("reason is null").drop("reason"))
    rejected = marked.filter("reason is not null").select("session_id", F.col("ord").alias("source_index"), "start_ms", "end_ms", F.length("text").alias("characters"), "reason")
    return kept, rejected


def overlaps(units: DataFrame, spans: DataFrame, key: str = "session_id", bin_ms: int | None = None) -> DataFrame:
    """Left join of units (ord, start_ms, end_ms) and spans (ord, start_ms, end_ms, label) that overlap by more than nothing; adds label, span_ord, ms.

    The session is an equi key.  With bin_ms, both sides are cut into bins, so that one very long session spreads over many tasks; a pair counts in the bin of its later start.
    """
    s = spans.select(F.col(key).alias("_k"), F.col("ord").alias("span_ord"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), "label").filter("_e > _s")
    on = (F.col(key) == F.col("_k")) & (F.col("start_ms") < F.col("_e")) & (F.col("_s") < F.col("end_ms"))
    u = units
    if bin_ms:
        cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_ms), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bin_ms)))
        pairs = u.select(key, F.col("ord").alias("_o"), "start_ms", "end_ms").withColumn("_b", cut("start_ms", "end_ms")).join(
            s.withColumn("_c", cut("_s", "_e")), on & (F.col("_b") == F.col("_c")) & (F.col("_b") == F.floor(F.greatest("start_ms", "_s") / bin_ms))
        )
        pairs = pairs.select(F.col(key).alias("_k"), "_o", "span_ord", "label", overlap_ms("start_ms", "end_ms", "_s", "_e").alias("ms"))
        return u.join(pairs, (F.col(key) == F.col("_k")) & (F.col("ord") == F.col("_o")), "left").drop("_k", "_o")
    return u.join(s, on, "left").withColumn("ms", F.when(F.col("label").isNotNull(), overlap_ms("start_ms", "end_ms", "_s", "_e"))).drop("_k", "_s", "_e")


def attribute(units: DataFrame, spans: DataFrame, key: str = "session_id", bin_ms: int | None = None) -> DataFrame:
    """The label with the largest total overlap (ties: met first), with coverage and purity."""
    by = [key, "ord"]
    per = overlaps(units, spans, key, bin_ms).groupBy(*by, "start_ms", "end_ms", "label").agg(F.sum("ms").alias("ms"), F.min("span_ord").alias("first"))
    best = F.max_by("label", F.struct("ms", -F.col("first"))).alias("speaker")
    out = per.groupBy(*by, "start_ms", "end_ms").agg(best, F.max("ms").alias("won"), F.sum("ms").alias("total"))
    span = F.greatest(F.lit(1).cast("bigint"), F.col("end_ms") - F.col("start_ms"))
    covered = F.least(F.coalesce("total", F.lit(0)), span)
    purity = F.when(covered > 0, F.round(F.least(F.col("won"), covered) / covered, 3)).otherwise(F.lit(0.0))
    return out.select(*by, "speaker", F.round(covered / span, 3).alias("coverage"), purity.alias("purity"))


def longest_single(units: DataFrame, spans: DataFrame, key: str = "session_id") -> DataFrame:
    """The label of the single longest overlap (ties: the first span)."""
    return overlaps(units, spans, key).groupBy(key, "ord").agg(F.max_by("label", F.struct("ms", -F.col("span_ord"))).alias("speaker"), F.max("ms").alias("overlap_ms"))


def islands(spans: DataFrame, key: str = "session_id") -> DataFrame:
    """Unions of spans that overlap or touch."""
    w = Window.partitionBy(key).orderBy("start_ms", "end_ms")
    seen = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.filter("end_ms > start_ms").withColumn("new", F.when(seen >= F.col("start_ms"), 0).otherwise(1))
    return marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def speech(spans: DataFrame, key: str = "session_id") -> DataFrame:
    """Spoken time as a union, and as a sum that counts simultaneous speakers twice."""
    union = islands(spans, key).groupBy(key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("union_ms"), F.count("*").alias("islands"))
    total = spans.groupBy(key).agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("sum_ms"))
    return total.join(union, key, "left")


def exact_coverage(units: DataFrame, spans: DataFrame, key: str = "session_id") -> DataFrame:
    """A1 by the union of spans: simultaneous speakers count once."""
    met = overlaps(units, islands(spans, key).withColumnRenamed("island", "ord").withColumn("label", F.lit("speech")), key)
    span = F.greatest(F.lit(1).cast("bigint"), F.col("end_ms") - F.col("start_ms"))
    return met.groupBy(key, "ord", "start_ms", "end_ms").agg(F.sum("ms").alias("ms")).select(key, "ord", F.round(F.coalesce("ms", F.lit(0)) / span, 3).alias("exact_coverage"))


def weak(turns: DataFrame, floor: float = 0.75) -> DataFrame:
    """Some measure of the attribution is under the floor; unmeasured is not weak."""
    return turns.filter(F.least("speaker_coverage", "speaker_purity") < floor)


def speaker_scores(truth: DataFrame, predicted: DataFrame, key: str = "session_id") -> DataFrame:
    """Each truth turn's predicted label with the most overlap, and its purity (uncovered: 0)."""
    met = overlaps(truth, predicted, key).groupBy(key, "ord", "physical_speaker", "label").agg(F.sum("ms").alias("ms"), F.min("span_ord").alias("first"))
    out = met.groupBy(key, "ord", "physical_speaker").agg(F.max_by("label", F.struct("ms", -F.col("first"))).alias("winner"), F.max("ms").alias("won"), F.sum("ms").alias("total"))
    return out.select(key, "ord", "physical_speaker", "winner", F.when(F.col("total") > 0, F.round(F.col("won") / F.col("total"), 3)).otherwise(F.lit(0.0)).alias("purity"))


def majorities(scores: DataFrame, key: str = "session_id") -> DataFrame:
    """For every true speaker the label that most of the turns got (ties: the smaller), how many labels, and whether another speaker has the same one."""
    n = scores.filter("winner is not null").groupBy(key, "physical_speaker", "winner").agg(F.count("*").alias("n"))
    top = Window.partitionBy(key, "physical_speaker").orderBy(F.desc("n"), "winner")
    best = n.withColumn("r", F.row_number().over(top)).withColumn("fragments", F.count("*").over(Window.partitionBy(key, "physical_speaker"))).filter("r = 1")
    return best.withColumn("collides", F.count("*").over(Window.partitionBy(key, "winner")) > 1).select(key, "physical_speaker", F.col("winner").alias("majority"), "fragments", "collides")


def heard_at(truth: DataFrame, produced: DataFrame, key: str = "session_id") -> DataFrame:
    """The produced text at each truth turn, in order."""
    p = produced.select(F.col(key).alias("_k"), F.col("ord").alias("_o"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("text").alias("_t"), F.col("confidence").alias("_c"))
    on = (F.col(key) == F.col("_k")) & (overlap_ms("start_ms", "end_ms", "_s", "_e") > 0)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_o", "_t")))), lambda x: x["_t"])
    return truth.join(p, on, "left").groupBy(key, "ord", "text").agg(F.array_join(parts, " ").alias("produced"), F.avg("_c").alias("confidence"))
