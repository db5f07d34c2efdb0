"""Findings on replies against the contract of the plug, which tells the first one."""

import json
import random

from chronoloom import plugs
from chronoloom.operators import replies


def test_every_violation_has_its_place(spark):
    known = ["t00001", "t00002", "t10", "t010"]
    ok = {"title": "T", "summary": "S", "turn_ids": ["t1"]}
    rows = {
        "clean": ({"scenes": [ok], "entities": None, "threads": [], "questions": [{"issue": "i", "why_it_matters": "w", "turn_ids": ["t00002"], "confidence": 1, "consequence": "low"}]}, []),
        "list": ([1], [("", "must be an object")]),
        "text": ("no", [("", "must be an object")]),
        "many": (
            {"scenes": [ok, {**ok, "title": "\t", "summary": 3}, 7, {"title": "a", "summary": "b", "turn_ids": []}], "threads": {"a": 1}, "questions": [{"issue": "i", "turn_ids": ["t9", " ", 4, "t2", "t10", "t0010"], "confidence": True, "consequence": "Low"}]},
            [("scenes[1].title", "must be a string with more than space"), ("scenes[1].summary", "must be a string with more than space"), ("scenes[2]", "must be an object"), ("scenes[3].turn_ids", "must cite a turn"), ("threads", "must be a list of objects"),
             ("questions[0].why_it_matters", "must be a string with more than space"), ("questions[0].confidence", "must be a number from 0 to 1"), ("questions[0].consequence", "must be low, medium or high"),
             ("questions[0].turn_ids[0]", "is no turn of the window"), ("questions[0].turn_ids[1]", "must be a turn's id"), ("questions[0].turn_ids[2]", "must be a turn's id"), ("questions[0].turn_ids[5]", "is no turn of the window")],
        ),
    }
    df = spark.createDataFrame([(k, 0, json.dumps(v), known) for k, (v, _) in rows.items()] + [("broken", 0, "{", known), ("null", 0, None, known)], "session_id string, window_ix long, payload string, turn_ids array<string>")
    got = {}
    for r in replies.findings(df).collect():
        got.setdefault(r.session_id, []).append((r.path, r.finding))
    for name, (_, want) in rows.items():
        assert sorted(got.get(name, [])) == sorted(want), name
    assert got["broken"] == got["null"] == [("", "must be an object")]


def test_a_reply_has_findings_where_the_plug_refuses_it(spark):
    rng = random.Random(5)
    some = lambda *xs: rng.choice(xs)
    known = ["t1", "t02", "x"]

    def claim(fields, group):
        c = {f: some("a", "b", "c", "d", "e", "f", " ", 3) for f in fields} | {"turn_ids": some(["t1"], ["t01", "x"], ["t2"], ["t1"], ["x"], [], ["q"], "t1")}
        if group == "questions":
            c |= {"confidence": some(0, 0.5, 1, 0.25, 2, "x", None), "consequence": some("low", "high", "medium", "low", "no")}
        return some(c, c, c, c, c, c, c, c, [1])

    payloads = [{g: some(None, [], [claim(f, g)], [claim(f, g)], [claim(f, g), claim(f, g)], "x" if rng.random() < 0.3 else []) for g, f in plugs.SAID.items()} for _ in range(150)]
    df = spark.createDataFrame([(i, 0, json.dumps(p), known) for i, p in enumerate(payloads)], "session_id long, window_ix long, payload string, turn_ids array<string>")
    bad = {r.session_id for r in replies.findings(df).collect()}
    want = {i for i, p in enumerate(payloads) if plugs.shape_error(p, set(known)) is not None}
    assert bad == want and 20 < len(want) < 140
