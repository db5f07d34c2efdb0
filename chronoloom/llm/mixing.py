"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies that each of its words should have.  Whole copies are certain: every document gets them.  What is open after that is
sampled with unequal probabilities, in proportion to a document's size: a document of size s is included with p = min(1, c s), where c makes the words expected, the sum of p s, what is open; those that reach 1 are
certain.  Documents are ranked by their random odds divided by their inclusion odds, and the first ones in that order are taken until the source's words reach its target as nearly as whole
documents allow.

c follows from a histogram of each source's sizes.  No source is sorted whole: a histogram of 4,096 bins of the rank variable finds the bin in which a source's sample ends, and only that bin's documents are put in order.  Random numbers come from a digest of the seed and doc_id, so reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 times; null is a source of its own, last in order; rows that repeat a doc_id share its random number,
ties go by doc_id and size; a null doc_id is a value like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, attach, documents, ranked, stored

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
BINS = 4096
SPAN = 1 << 48


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source key (null last), size, a random integer below 2**48 and a hash of the text of every row."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("skey"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("bigint").alias("u"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"),
    )


def targets(rows: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """skey, source_size, n (rows), target: weights of sources in order share all sizes; none gets over `most` times its size."""
    totals = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("bigint")
    each = stored(ranked(totals, ["skey"], "sources").withColumn("w", weight), "weights")
    whole = each.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    total, open_weight, stopped, before = whole["t"] or 0, whole["w"] or 0, 0, -1
    level = total / open_weight if open_weight else 0.0
    limit = F.col("source_size") * most
    while stopped != before:  # each round stops at least one more source; rounds follow the excess, not the rows
        over = limit.cast("double") < F.col("w") * F.lit(level)
        r = each.agg(F.sum(F.when(over, limit)).alias("c"), F.sum(F.when(over, F.col("w"))).alias("w"), F.count_if(over).alias("n")).first()
        before, stopped = stopped, r["n"]
        if open_weight - (r["w"] or 0) > 0:
            level = (total - (r["c"] or 0)) / (open_weight - (r["w"] or 0))
    return each.select("skey", "source_size", "n", F.least(limit.cast("double"), F.col("w") * F.lit(level)).alias("target"))


def chances(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan(skey, open, ...) with `largest`, the largest size whose documents are not certain, and `c`, by which sizes up to it give their inclusion probabilities.

    Sizes are taken off from the top as long as c, which makes up for the rest, would put them above 1; sizes of a source are few next to its documents.
    """
    sizes = rows.filter("size > 0").groupBy("skey", "size").agg(F.count("*").alias("m")).join(plan.select("skey", "open"), "skey")
    down = Window.partitionBy("skey").orderBy(F.desc("size"))
    wider = F.coalesce(F.sum(F.col("m") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    rest = F.sum(F.col("m") * F.col("size") * F.col("size")).over(Window.partitionBy("skey").orderBy("size"))
    c = (F.col("open") - wider.cast("double")) / rest.cast("double")
    fit = sizes.withColumn("c", c).filter(F.col("c") * F.col("size") < 1)
    return plan.join(fit.groupBy("skey").agg(F.max("size").alias("largest"), F.max_by("c", "size").alias("c")), "skey", "left").withColumns({"largest": F.coalesce("largest", F.lit(0).cast("bigint")), "c": F.coalesce("c", F.lit(0.0))})


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, tag, skey, size, source_size, target, copies of every row."""
    rows = stored(sized(docs, seed), "sizes")
    plan = targets(rows, weights, most)
    plan = plan.withColumn("sure", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("open", F.col("target") - F.col("sure") * F.col("source_size"))
    plan = stored(chances(rows, plan), "targets")
    rows = attach(rows, plan, "skey", "n", rows.count())
    u = (F.col("u") + 0.5) / SPAN
    p = F.when(F.col("size") > F.col("largest"), F.lit(1.0)).otherwise(F.col("c") * F.col("size"))
    rows = rows.withColumn("p", F.when((F.col("open") > 0) & (F.col("size") > 0), p).otherwise(F.lit(0.0))).drop("c", "largest")
    q = F.when(F.col("p") > 0, u / (1 - u) * ((1 - F.col("p")) / F.col("p"))).otherwise(F.lit(float("inf")))
    # Certain documents have a bin of their own before all others: together they never go beyond what is open.
    bin_ = F.when(F.col("p") == 1, F.lit(-1)).when(F.col("p") > 0, F.least(F.lit(BINS - 1), F.floor(F.col("q") / (1 + F.col("q")) * BINS))).otherwise(F.lit(BINS))
    rows = stored(rows.withColumn("q", q).withColumn("bin", bin_.cast("int")), "ranked")
    in_order = Window.partitionBy("skey").orderBy("bin")
    bins = rows.filter("p > 0").groupBy("skey", "bin").agg(F.sum("size").alias("s"), F.count("*").alias("c"), F.first("open").alias("open"))
    bins = bins.withColumn("upto", F.sum("s").over(in_order)).withColumn("base", F.col("upto") - F.col("s"))
    # A document is taken while the middle of its words lies within the open ones, so only the bin around their end needs an order.
    ends = bins.filter((F.col("base") <= F.col("open")) & (F.col("upto") > F.col("open"))).select("skey", F.col("bin").alias("cut"), "base")
    ends = stored(ends.join(plan.select("skey", "n"), "skey"), "ends")
    rows = attach(rows.drop("n"), ends, "skey", "n", rows.count())
    within = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    before = F.sum("size").over(Window.partitionBy("skey").orderBy("q", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    middle = 2 * (F.col("base") + F.coalesce(before, F.lit(0))) + F.col("size")
    tight = rows.filter(within).withColumn("extra", (middle <= 2 * F.col("open")).cast("int"))
    other = rows.filter(~within).withColumn("extra", F.coalesce((F.col("bin") < F.col("cut")).cast("int"), F.lit(0)))
    done = tight.unionByName(other)
    copies = F.when(F.col("size") > 0, F.least(F.lit(most), F.col("sure") + F.col("extra"))).otherwise(F.lit(0)).cast("int")
    return done.select("doc_id", "tag", "skey", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (rows equal in doc_id and text alike)."""
    taken = mix(docs, weights, most, seed).groupBy(F.col("doc_id").alias("__cl_d"), F.col("tag").alias("__cl_t")).agg(F.max("copies").alias("__cl_copies")).filter("__cl_copies > 0")
    rows = docs.withColumn("__cl_tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(taken, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__cl_d")) & (F.col("__cl_tag") == F.col("__cl_t")))
    return rows.withColumn("__cl_copy", F.explode(F.sequence(F.lit(1), F.col("__cl_copies")))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS u
  FROM documents
), sources AS (
  SELECT skey, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::BIGINT AS w FROM sized GROUP BY skey
), ordered AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS t, sum(w) OVER ()::BIGINT AS all_w,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w::DOUBLE, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped,
    coalesce(sum(w) OVER (ORDER BY source_size / w::DOUBLE, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped_w
  FROM sources
), levels AS (
  SELECT *, (t - stopped)::DOUBLE / (all_w - stopped_w)::DOUBLE AS level FROM ordered
), level AS (
  SELECT min_by(level, source_size / w::DOUBLE) FILTER (WHERE (3 * source_size)::DOUBLE >= w * level) AS level FROM levels
), targets AS (
  SELECT skey, source_size, least((3 * source_size)::DOUBLE, w * level.level) AS target FROM sources, level
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS sure FROM targets
), sizes AS (
  SELECT skey, size, count(*)::BIGINT AS m FROM sized WHERE size > 0 GROUP BY 1, 2
), tops AS (
  SELECT s.skey, size, (p.target - p.sure * p.source_size - coalesce(sum(m * size) OVER (PARTITION BY s.skey ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(m * size * size) OVER (PARTITION BY s.skey ORDER BY size))::DOUBLE AS c FROM sizes s JOIN plan p ON p.skey = s.skey
), fit AS (
  SELECT skey, max(size) AS largest, arg_max(c, size) AS c FROM tops WHERE c * size < 1 GROUP BY 1
), chance AS (
  SELECT s.*, p.source_size, p.target, p.sure, p.target - p.sure * p.source_size AS open, (u + 0.5) / 281474976710656::DOUBLE AS v,
    CASE WHEN p.target - p.sure * p.source_size > 0 AND size > 0 THEN CASE WHEN size > coalesce(largest, 0) THEN 1::DOUBLE ELSE c * size END ELSE 0::DOUBLE END AS p
  FROM sized s JOIN plan p USING (skey) LEFT JOIN fit USING (skey)
), ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY CASE WHEN p > 0 THEN v / (1 - v) * ((1 - p) / p) ELSE 'inf'::DOUBLE END, u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM chance
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN size * least(3, sure + CASE WHEN p > 0 AND 2 * before + size <= 2 * open THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM ranked
"""
