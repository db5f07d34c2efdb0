"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-step: every node's neighbours (larger ones, or else smaller ones and itself) are linked to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter(F.col("v") < F.col("u"))
    both = stored(both, "both-ways")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
    rows = attach(both, stored(least, "least"), "u", "_n", both.count()).drop("_n")
    if large:
        out = rows.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = rows.select("u", F.col("m").alias("v"))
        out = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return stored(out.filter(F.col("u") != F.col("v")).distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> node, root (the least node that it reaches); nodes without an edge have no row.

    Alternates large and small stars, which need a number of rounds logarithmic in the nodes; each node's least neighbour is pre-aggregated, and hot nodes are
    attached without filling one task.
    """
    now = stored(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        told = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()  # two numbers
        if told == before or not told["n"]:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = told
        now = _star(_star(now, True), False)
