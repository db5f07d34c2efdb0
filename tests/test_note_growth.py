"""Notes whose files share a path: work grows as the files, not as their square."""

import time

from pyspark.sql import functions as F

from chronoloom import plans
from chronoloom.operators import notes as N
from test_oracle import DATA

plans.load()


def files(spark, n, body):
    """n files of one path, with headings at the same lines."""
    text = F.concat(F.lit("# N\n## Session "), (F.col("id") % 3).cast("string"), F.lit(f"\n{body}\n### Detail\nx\n## "), F.when(F.col("id") == 0, "Last").otherwise("End"), F.lit("\ny"))
    return spark.range(n).repartition(4).select(F.lit("a/N.md").alias("path"), text.alias("content"), F.col("id").alias("modified"))


def test_bodies_are_digested_once_a_range(spark):
    """sections of one line and level are one range of the path's lines: four digests here, not one a section over all files."""
    n, start = 2000, time.time()
    got = N.section_bodies(N.parse(files(spark, n, "\n".join(["word " * 20] * 10)), links=False), texts=False).groupBy("line", "level", "end_line").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("d")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 17, n, 1), (2, 2, 15, n, 1), (13, 3, 15, n, 1), (15, 2, 17, n, 1)]
    assert time.time() - start < 40


def test_a_survey_looks_at_a_heading_once(spark):
    """F16: places, sessions and edges of a note's headings are told in one pass."""
    n, start = 8000, time.time()
    got = {(r.part, r.name, r.detail): r.n for r in N.survey(files(spark, n, "z")).collect()}
    assert got["edge_sections", "opening", "Session 0"] == 1 and got["edge_sections", "terminal", "Last"] == 1
    assert got["accumulation_positions", "first-third", ""] == n and got["notes", "", ""] == n
    assert time.time() - start < 40


def test_ownership_reads_paths_to_count_files(spark):
    """how many files a path has is counted from paths, and rows are dealt out before they are multiplied."""
    plan = plans.QUERIES["j11_ownership"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("array_repeat") == 2 and "Repartition " in plan


def test_links_carry_a_line_each(spark):
    """F16: of a piece only the line that a link can stand in is passed on."""
    plan = N.links(plans.notes.files(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(transform(" in plan
