"""Sheets as transactions, broken off and started again."""

import json

import pytest

from chronoloom.streaming import sheets

A = lambda q, action="accept", **op: {"question_id": q, "action": action, **({"operation": op} if op else {})}


def put(spark, base, rows):
    data = [(s, json.dumps({"answered_by": who, "answers": answers})) for s, who, answers in rows]
    spark.createDataFrame(data, sheets.SHEETS).coalesce(1).write.mode("append").parquet(f"{base}/in")


LOTS = [
    [(1, "p", [A("q1"), A("q2", "correct", op="revise_entity", entity_id="e1", name="N")]), (2, "p", [A("q1"), A("q1")])],  # the second answers a question twice
    [(1, "r", [A("q2")]), (2, "p", [A("q1"), A("q3", "defer")])],  # the first contradicts another's answer
    [(1, "p", [A("q2", "irrelevant"), A("q4")]), (3, "r", [A("q9")])],
]
WANT = [(1, 1, "p", "q1"), (1, 2, "p", "q2"), (1, 3, "p", "q2"), (1, 4, "p", "q4"), (2, 1, "p", "q1"), (2, 2, "p", "q3"), (3, 1, "r", "q9")]


def rows(store):
    return sorted((r.session_id, r.sequence, r.answered_by, r.question_id) for r in store.read("log", sheets.LOG).collect())


def test_sheets_are_applied_whole_and_in_order(spark, tmp_path):
    base = str(tmp_path)
    store = sheets.Versions(spark, f"{base}/store")
    assert rows(store) == []
    for lot in LOTS:
        put(spark, base, lot)
        sheets.sheet_stream(spark, f"{base}/in", store, f"{base}/c")
    assert rows(store) == WANT
    assert sorted((r.session_id, r.answers) for r in store.read("refused", sheets.REFUSED).collect()) == [(1, 1), (2, 2)]
    sheets.sheet_stream(spark, f"{base}/in", store, f"{base}/c")  # nothing new
    assert rows(store) == WANT


@pytest.mark.parametrize("where", ["written", "committed"])
def test_a_run_that_breaks_off_ends_as_one_run(spark, tmp_path, where):
    """Killed between a version's writing and its commit, or between the commit and the checkpoint: readers see whole versions, and a new start ends with the rows of one run."""
    base = str(tmp_path)

    class Breaking(sheets.Versions):
        def written(self, batch):
            if where == "written" and batch == 1:
                raise RuntimeError("killed")

        def commit(self, batch, tables):
            super().commit(batch, tables)
            if where == "committed" and batch == 1:
                raise RuntimeError("killed")

    plain = sheets.Versions(spark, f"{base}/store")
    put(spark, base, LOTS[0])
    sheets.sheet_stream(spark, f"{base}/in", Breaking(spark, f"{base}/store"), f"{base}/c")
    put(spark, base, LOTS[1])
    with pytest.raises(Exception, match="killed"):
        sheets.sheet_stream(spark, f"{base}/in", Breaking(spark, f"{base}/store"), f"{base}/c")
    assert (tmp_path / "store" / "log" / "version-00000001").exists()
    assert rows(plain) == (WANT[:2] if where == "written" else [x for x in WANT if x[:2] in ((1, 1), (1, 2), (2, 1), (2, 2))])
    put(spark, base, LOTS[2])
    sheets.sheet_stream(spark, f"{base}/in", plain, f"{base}/c")
    assert rows(plain) == WANT
