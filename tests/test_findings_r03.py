"""Tests of the third round's findings on notes, vocabularies and the other queries on tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom import plans
from test_oracle import DATA, rows

plans.load()

#: What the SQL leaves open where files share a path, closed by the files' age.
CLOSED = (
    ("ls AS (SELECT path, content, i,", "ls AS (SELECT path, modified, content, i,"), ("(SELECT path, content, lines, unnest", "(SELECT path, modified, content, lines, unnest"), ("any_value(content)", "arg_min(content, modified)"),
    ("cut AS (SELECT path, i, nxt", "cut AS (SELECT path, modified, i, nxt"), ("ORDER BY i) - 1 AS pos", "ORDER BY i, modified) - 1 AS pos"), ("hs AS (SELECT path, i,", "hs AS (SELECT path, modified, i,"),
    ("hd AS (SELECT path, i AS line,", "hd AS (SELECT path, modified, i AS line,"), ("sw AS (SELECT path, line, unnest", "sw AS (SELECT path, modified, line, unnest"), ("FROM (SELECT path, line, string_split(lower", "FROM (SELECT path, modified, line, string_split(lower"),
    ("sd AS (SELECT path, line, k,", "sd AS (SELECT path, modified, line, k,"), ("AS r, before FROM (SELECT path, line, k,", "AS r, before FROM (SELECT path, modified, line, k,"), ("'0123456789'))), k) AS ref", "'0123456789'))), k * 1000000000000 + modified) AS ref"),
    ("arg_min(title, line)", "arg_min(title, line * 1000000000000 + modified)"), ("arg_min(title, idx)", "arg_min(title, (idx + 1) * 1000000000000 + modified)"), ("arg_max(title, idx)", "arg_max(title, (idx + 1) * 1000000000000 - modified)"),
    ("ORDER BY l.i)", "ORDER BY l.i, l.modified)"), ("ORDER BY string_split(path, '/')), lambda", "ORDER BY string_split(path, '/'), encode(path) || '\\x00'::BLOB || unhex(sha256(content))), lambda"),
)
#: Those whose SQL leaves nothing open.
PLAIN = ("a24_unresolved_targets", "a25_section_positions", "a46_titles_matching", "w4_section_extents", "j11_ownership", "a22_shape_drift")
NOTES = (
    *PLAIN, "a21_note_counters", "a26_edge_sections", "a27_recurring_sections", "a29_tree_digest", "f17_region_digests", "f18_front_matter_notes", "f19_session_references", "o2_ranked_counters", "o5_top_edge_sections", "p21_note_assembly",
    "s20_survey_document", "w5_section_numbers", "w6_front_matter", "a23_link_topology", "g2_link_graph",
)


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """Documents whose notes share their paths, six each: some empty, with headings at the same lines."""
    d = str(tmp_path_factory.mktemp("shared"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 120")
    k = F.col("doc_id")
    text = F.when(k % 4 == 1, F.lit("a\n## The session, session 4\nb\n# T\n---\nc")).when(k % 4 == 2, F.lit("a\n## Session 2\nb\n### x")).otherwise(F.col("text"))
    docs.withColumn("text", text).withColumn("doc_id", (k % 20 + F.floor(k / 20) * 930).cast("bigint")).withColumn("source", F.lit("s")).coalesce(1).write.parquet(f"{d}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{glob.glob(d + '/documents.parquet/*.parquet')[0]}'")
    return d, c


@pytest.mark.parametrize("name", NOTES)
def test_files_that_share_a_path_are_one_note(spark, shared, name):
    """The SQL joins by path, so what files of one path hold counts for all of them."""
    d, c = shared
    sql = plans.ORACLES[name]
    for a, b in () if name in PLAIN else CLOSED:
        sql = sql.replace(a, b)
    got, want = plans.QUERIES[name](spark, d).toPandas(), c.execute(sql).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
    assert os.path.basename(d) and len(got)


def test_ownership_moves_no_texts_by_path(spark, shared, monkeypatch):
    """a path's files do not meet in one task with their texts, and a target's reasons are told once a file only at the end."""
    from chronoloom.operators import notes as N

    seen = []
    monkeypatch.setattr(N, "written", lambda df, what, f=N.written: (seen.append(df), f(df, what))[1])
    out = plans.QUERIES["j11_ownership"](spark, shared[0])
    for df in (*seen, out):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan or "AS texts" not in plan
    assert seen


@pytest.mark.parametrize("name", ["s11_diarizer_import", "s10_recogniser_import"])
def test_imports_need_no_file_a_recording(spark, tmp_path, monkeypatch, name):
    """documents are written many to a file and name their recordings themselves."""
    from chronoloom.sources import sessions

    monkeypatch.setattr(sessions, "shared_folder", lambda _, what: f"{tmp_path}/{what}")
    got = plans.QUERIES[name](spark, DATA)
    table = "events" if name.startswith("s11") else "conversations"
    recordings = spark.read.parquet(f"{DATA}/{table}.parquet").select("user_id" if table == "events" else "conv_id").distinct().count()
    files = glob.glob(f"{tmp_path}/*/**/*.json", recursive=True)
    assert got.count() and 0 < len(files) < recordings


def test_approvals_are_combined_before_the_fold(monkeypatch):
    """of each approval a task passes on the one with the greatest number, by kind where numbers are equal, and holds few."""
    import pyarrow as pa
    from chronoloom.streaming import vocabulary as V

    def batch(*rows):
        return pa.RecordBatch.from_pylist([{"approval_id": i, "seq": s, "kind": k, "aliases": [i]} for i, s, k in rows], schema=pa.schema([("approval_id", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("aliases", pa.list_(pa.string()))]))

    told = lambda batches: sorted((r["approval_id"], r["seq"], r["kind"]) for b in V.latest(iter(batches)) for r in b.to_pylist())
    many = [batch(*[("abc"[i % 3], i, "k") for i in range(1000)], ("a", 999, "m"), ("d", None, "k"), ("a", None, "z")) for _ in range(9)]
    assert told(many) == [("a", 999, "m"), ("b", 997, "k"), ("c", 998, "k"), ("d", None, "k")]
    monkeypatch.setattr(V, "ROWS", 2)
    split = told(batch((i, n, "k")) for n in range(3) for i in "abcde")
    assert {i: max(s for j, s, _ in split if j == i) for i, _, _ in split} == dict.fromkeys("abcde", 2)
    assert told([]) == []


def test_replies_are_read_once(spark):
    """a task reads its replies once, not once for each sort of finding."""
    from chronoloom.operators import replies as R

    said = '{"scenes":[1,{"title":"a","summary":"b","turn_ids":["t1","t9",3]}],"entities":[],"questions":"no"}'
    df = spark.createDataFrame([(1, 0, said, ["t01"]), (2, 0, "[", ["t01"]), (3, 0, None, ["t01"]), (4, 0, '{"scenes":[{"title":"a","summary":"b","turn_ids":"t1"}]}', ["t01"])], "session_id long, window_ix int, payload string, turn_ids array<string>")
    out = R.findings(df.repartition(3, "session_id"))
    assert sorted((r.session_id, r.path, r.finding) for r in out.collect()) == [
        (1, "questions", "must be a list of objects"), (1, "scenes[0]", "must be an object"), (1, "scenes[1].turn_ids[1]", "is no turn of the window"), (1, "scenes[1].turn_ids[2]", "must be a turn's id"),
        (2, "", "must be an object"), (3, "", "must be an object"), (4, "scenes[0].turn_ids", "must cite a turn"),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Union" not in plan


def test_all_notes_of_a_folder_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """the executors list and read a collection, whatever its depth; notes that Spark's readers leave out are there too, and a folder holds many."""
    from chronoloom.sources import collections, sessions

    for p, x in {"_draft.md": "# D", "a/.h.md": "h", "a/b/c/d.md": "", "a/b/e.md": "é", "a/b/f.txt": "no", "a/.git/g.md": "no", "a/b/.obsidian/h.md": "no"}.items():
        (tmp_path / "in" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / p).write_text(x)
    got = collections.markdown(spark, f"{tmp_path}/in")
    assert sorted((r.path, r.content) for r in got.collect()) == [("_draft.md", "# D"), ("a/.h.md", "h"), ("a/b/c/d.md", ""), ("a/b/e.md", "é")]
    assert "binaryFile" not in got._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception):
        collections.markdown(spark, f"{tmp_path}/none").collect()
    monkeypatch.setattr(sessions, "shared_folder", lambda _, what, n=iter(range(99)): f"{tmp_path}/{what}{next(n)}")
    assert plans.QUERIES["s6_markdown_scan"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    notes = glob.glob(f"{tmp_path}/notes*/**/*.md", recursive=True)
    assert len({os.path.dirname(p) for p in notes}) < len(notes) / 2


@pytest.mark.parametrize("name", [n for n in NOTES if n[:3] in ("a21", "a22", "a25", "a26", "a27", "a46", "f18", "f19", "p21", "w4_", "w5_", "w6_")])
def test_texts_stay_where_they_are(spark, shared, name):
    """what needs headings, fields or sizes only moves no texts by path."""
    assert "AS texts" not in plans.QUERIES[name](spark, shared[0])._jdf.queryExecution().optimizedPlan().toString()
