"""Queries on notes against their SQL on odd texts, each note in a file of its own, so that the SQL leaves nothing open."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom import plans
from test_oracle import rows

plans.load()

LINKS = ("[[a.png\u2028]]", "[[\r.png]]", "[[\u3000b.MD |\xa0x\xa0]]", "[[c # d\xa0]]", "[[a.PNG\xa0]]", "[[.png]]", "[[e\t]]")


def equal(spark, folder, texts, name, sources=("s",)):
    """The query's rows are those of its SQL, over a document for each text and source."""
    docs = [(i, t, s) for i, (t, s) in enumerate((t, s) for s in sources for t in texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = plans.QUERIES[name](spark, str(folder)).toPandas(), c.execute(plans.ORACLES[name]).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
    return got


@pytest.mark.parametrize("name", ["a24_unresolved_targets", "f14_links", "f15_link_names", "j10_link_resolution"])
def test_links_end_in_any_blank(spark, tmp_path, name):
    """Unicode's blanks are no part of a link, and a suffix stands at the very end of its name, after any character."""
    assert len(equal(spark, tmp_path, LINKS, name))


@pytest.mark.parametrize("name", ["a25_section_positions", "f19_session_references", "w5_section_numbers"])
def test_sessions_after_a_letter_of_two(spark, tmp_path, name):
    """a letter whose lower case is a letter and a mark is still a letter, before the word and in it."""
    assert len(equal(spark, tmp_path, (*["\n## \u0130session 4\n## Session 5"] * 2, "\n## x\n## SESS\u0130ON 6", "\n## Session 7\u0130"), name))


@pytest.mark.parametrize("name", ["a26_edge_sections", "a27_recurring_sections", "o5_top_edge_sections", "p21_note_assembly", "w4_section_extents", "w5_section_numbers"])
def test_titles_keep_blanks_before_a_separator(spark, tmp_path, name):
    """blanks before a line separator that ends a title are in the title."""
    texts = [f"{x}\n# T {x}\n## Last \t{x}\n##\t{x}\n" for x in ("\u2028", "\x85", "\r", "\x0b", "")] * 3
    assert len(equal(spark, tmp_path, texts, name))


@pytest.mark.parametrize("name", ["f17_region_digests", "j11_ownership"])
def test_digests_of_odd_line_ends(spark, tmp_path, name):
    """a line ends at a line feed only; a vertical tab, and blanks before a line separator, stay."""
    texts = ("a\rb\n", "a \u2028\n b\x0b\n\n", "a\r\r\nb\f \n", "\n\n a\t\n", "\r", "\n## History\na\x0b\n## z")
    assert len(equal(spark, tmp_path, texts, name))


NULLS = (
    "a21_note_counters", "a24_unresolved_targets", "a25_section_positions", "a26_edge_sections", "a27_recurring_sections", "a29_tree_digest", "a46_titles_matching", "f17_region_digests", "f18_front_matter_notes", "f19_session_references",
    "o2_ranked_counters", "o5_top_edge_sections", "p21_note_assembly", "s20_survey_document", "w4_section_extents", "w5_section_numbers", "w6_front_matter", "j11_ownership", "g2_link_graph",
)


@pytest.mark.parametrize("name", NULLS)
def test_files_without_a_path_are_in_no_note(spark, tmp_path, name):
    """A source that is null makes no path: such files have sizes and links, and no keys or headings."""
    assert len(equal(spark, tmp_path, ("\n## Session 1\n", "", None, "[[Note 3]]\n## a\n", *["\n## b\n"] * 4), name, sources=("s", None)))


def test_no_files_have_the_digest_of_nothing(spark):
    """an unknown item leaves the digest unknown, and no rows do not."""
    import hashlib
    from chronoloom.operators.order import streamed_digest

    df = spark.createDataFrame([(1, b"a"), (2, None), (3, b"b")], "k int, b binary")
    assert [streamed_digest(x, "b", "k").first().digest for x in (df, df.filter("k <> 2"), df.limit(0))] == [None, hashlib.sha256(b"ab").hexdigest(), hashlib.sha256(b"").hexdigest()]
