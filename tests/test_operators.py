"""Single operators on rows of our own: traps, ties and invariants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronoloom import plugs, streaming
from chronoloom.functions import text as T
from chronoloom.operators import align, attribution, claims, corrections, names, notes, scoring
from chronoloom.operators.clock import numbered
from chronoloom.operators.windows import Budget, plan_windows
from chronoloom.sources import collections, engines, generator, media, sessions, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("label", "candidate", "want"),
    [("The Old Mill", "old mill", True), ("mill", "The old mill by the river", True), ("old mill", "old river mill", False), ("of the", "of the", False), ("ab", "ab", False), ("Mercury", "mercurial", False)],
)
def test_labels(spark, label, candidate, want):
    assert one(spark, T.label_matches("a", "b"), a=label, b=candidate) is want


@pytest.mark.parametrize(("token", "want"), [("Orvel's", "orvel"), ("don't", "do"), ("we’ll", "we"), ("'s", "s"), ("I'm", "i'm"), ("o'er'", "o'er"), ("Brannoc", "brannoc")])
def test_stems(spark, token, want):
    assert one(spark, T.stem("a"), a=token) == want


@pytest.mark.parametrize(("i", "want"), [("turn-00740", "turn-740"), ("turn-100", "turn-100"), ("a000", "a0"), ("none", "none")])
def test_canonical_ids(spark, i, want):
    assert one(spark, T.canonical_id("a"), a=i) == want


@pytest.mark.parametrize(("a", "b", "want"), [("gart", "gort", True), ("gart", "goort", False), ("garthog", "gartok", True), ("garthog", "blatzen", False)])
def test_tolerance_grows_with_length(spark, a, b, want):
    assert one(spark, T.near("a", "b"), a=a, b=b) is want


def test_digits_move_only_when_small(spark):
    assert one(spark, T.vary_digits(F.lit("d20 rolls 19 in 1999"), F.lit(1))) == f"d{1 + (20 + 2) % 24} rolls {1 + (19 + 3) % 24} in 1999"
    assert one(spark, T.vary_digits(F.lit("d20"), F.lit(0))) == "d20"


def test_json_in_a_fence_with_a_line_end_inside(spark):
    text = 'so:\n```json\n{"a": "x\ny"}\n```'
    assert one(spark, F.from_json(T.json_object(F.lit(text)), "a string", {"allowUnquotedControlChars": "true"})["a"]) == "x\ny"
    assert one(spark, T.json_object(F.lit("[1]"))) is None


def test_ids_do_not_truncate(spark):
    df = spark.createDataFrame([(1, 7), (1, 3)], "session_id long, ord long")
    assert [r.id for r in numbered(df, form="t%05d").orderBy("ord").collect()] == ["t00000", "t00001"]
    assert one(spark, F.format_string("t%05d", F.lit(123456))) == "t123456"


SPANS = [(1, 0, 0, 500, "A"), (1, 1, 500, 700, "B"), (1, 2, 650, 950, "A"), (1, 3, 10, 10, "C")]


def spans(spark, data=SPANS):
    return spark.createDataFrame(data, "session_id long, ord long, start_ms long, end_ms long, label string")


@pytest.mark.parametrize("bin_ms", [None, 100, 1000])
def test_total_overlap_beats_longest(spark, bin_ms):
    seg = spark.createDataFrame([(1, 0, 300, 900, "x", None), (1, 1, 5000, 5100, "y", None), (1, 2, 600, 600, "z", None)], "session_id long, ord long, start_ms long, end_ms long, text string, confidence double")
    got = {r.ord: r for r in attribution.attribute(seg, spans(spark), bin_ms=bin_ms).collect()}
    assert (got[0].speaker, got[0].coverage, got[0].purity) == ("A", 1.0, 0.75)  # 450 of 650, clipped to 600
    assert (got[1].speaker, got[1].coverage, got[1].purity) == (None, 0.0, 0.0)
    single = {r.ord: r for r in attribution.longest_single(seg, spans(spark)).collect()}
    assert (single[0].speaker, single[0].overlap_ms) == ("A", 250)


def test_islands_merge_what_touches(spark):
    got = attribution.speech(spans(spark)).first()
    assert (got.sum_ms, got.union_ms, got.islands) == (1000, 950, 1)


def planned(costs, budget, texts):
    """The plan by a plain loop: windows of (id) under the rules stated in windows.py."""
    done, now = [], []
    for i, c in enumerate(costs):
        if c > budget.capacity:
            done += [now] * bool(now) + [[i]]
            now = []
        elif now and sum(costs[j] for j in now) + c > budget.capacity:
            done.append(now)
            tail = now[-budget.overlap :] if budget.overlap else []
            now = [*([] if sum(costs[j] for j in tail) > budget.capacity // 2 else tail), i]
        else:
            now = [*now, i]
    return done + [now] * bool(now)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("overlap", [0, 2, 3])
def test_windows_follow_the_rules(spark, seed, overlap):
    rng = random.Random(seed)
    texts = ["w" * rng.choice([3, 20, 60, 700]) for _ in range(30)]
    df = spark.createDataFrame([(1, i, f"t{i:05d}", "A", x) for i, x in enumerate(texts)], "session_id long, ord long, id string, physical_speaker string, text string")
    budget = Budget(200, 50, overlap)
    costs = [-(-2 * len(f"[t{i:05d}] (A) {x}") // 5) + 1 for i, x in enumerate(texts)]
    got: dict[int, list[int]] = {}
    for r in plan_windows(df, budget).orderBy("window_ix", "pos").collect():
        got.setdefault(r.window_ix, []).append(int(r.id[1:]))
    assert list(got.values()) == planned(costs, budget, texts)
    assert {i for w in got.values() for i in w} == set(range(30))


def test_a_long_session_is_streamed(spark):
    """Many batches of one session's turns beside others, in any order; its texts are not shuffled."""
    n = 60_000
    df = spark.range(n).select(F.lit(5).cast("long").alias("session_id"), F.col("id").alias("ord"), F.format_string("t%06d", "id").alias("id"), F.lit("A").alias("physical_speaker"), F.repeat(F.lit("w"), (F.col("id") * 7919 % 97).cast("int")).alias("text"))
    df = df.unionByName(df.filter("ord < 50").withColumn("session_id", F.lit(None).cast("long"))).unionByName(df.filter("ord < 10").withColumn("session_id", F.lit(-3).cast("long")))
    budget = Budget(400, 50, 3)
    costs = [-(-2 * (14 + i * 7919 % 97) // 5) + 1 for i in range(n)]
    plan = plan_windows(df.repartition(7), budget)
    got: dict = {}
    for r in sorted(plan.collect(), key=lambda r: (str(r.session_id), r.window_ix, r.pos)):
        got.setdefault(r.session_id, {}).setdefault(r.window_ix, []).append(int(r.id[1:]))
    for session, m in ((5, n), (None, 50), (-3, 10)):
        assert [got[session][i] for i in range(len(got[session]))] == planned(costs[:m], budget, None)
    assert "collect_list" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_budget_must_leave_room():
    with pytest.raises(ValueError):
        Budget(100, 100)
    with pytest.raises(ValueError):
        Budget(100, 10, -1)


def turns(spark, data):
    return spark.createDataFrame(data, "session_id long, ord long, id string, text string, start_ms long, end_ms long")


TURNS = [(1, 0, "t1", "Brannoc came to the mill", 0, 900), (1, 1, "t2", "Branoc left", 1000, 1900), (1, 2, "t03", "the mill fell", 2000, 2900)]


def test_evidence_fails_closed(spark):
    c = spark.createDataFrame([(1, "a", ["t1", "t2"]), (1, "b", ["t1", "t9"]), (1, "c", [])], "session_id long, k string, turn_ids array<string>")
    got = {r.k: (r.start_ms, r.end_ms, r.supported) for r in claims.evidence(c, "k", turns(spark, TURNS)).collect()}
    assert got == {"a": (0, 1900, True), "b": (None, None, False), "c": (None, None, False)}
    with pytest.raises(Exception, match="unsupported claim"):
        claims.evidence(c, "k", turns(spark, TURNS), strict=True).collect()


def test_loose_ids_need_one_owner(spark):
    c = spark.createDataFrame([(1, "a", ["t3", "t001", "t2"])], "session_id long, k string, turn_ids array<string>")
    both = turns(spark, [*TURNS, (1, 3, "t01", "again", 3000, 3900)])
    assert [r.resolved for r in claims.resolved_ids(c, "k", both).orderBy("pos").collect()] == ["t03", None, "t2"]


def test_queue_tells_what_it_drops(spark):
    q = spark.createDataFrame([(1, i, f"q{i}", x, c, w) for i, (x, c, w) in enumerate([("A", 0.9, "low"), ("b", 0.5, "high"), ("B", 0.1, "high"), ("c", 0.2, "high"), ("d", 0.5, "medium")])], "session_id long, ord long, question_id string, issue string, confidence double, consequence string")
    got = claims.question_queue(q, 2).orderBy("rank").collect()
    assert [(r.question_id, r.dropped_count) for r in got] == [("q3", 2), ("q1", 2)]
    with pytest.raises(ValueError):
        claims.question_queue(q, 0)


def test_misheard_names_cluster(spark):
    lex = spark.createDataFrame([("came", 5.0), ("to", 6.0), ("the", 7.0), ("mill", 4.0), ("left", 5.0), ("fell", 4.5)], "word string, zipf double")
    got = names.candidates(turns(spark, TURNS), lex, 2.0).collect()
    assert [(r.root, r.stems, r.occurrences, r.grounds) for r in got] == [("brannoc", 2, 2, "spelled 2 ways")]


@pytest.mark.parametrize(("seed", "few"), [(0, 20_000), (1, 0), (2, 5)])
def test_clusters_are_components(spark, monkeypatch, seed, few):
    monkeypatch.setattr(names, "FEW", few)
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(4, 7))) for _ in range(25)})
    stems = spark.createDataFrame([(1, w) for w in words], "session_id long, stem string")
    pairs = names.near_pairs(stems)
    edges = [(r.a, r.b) for r in pairs.collect()]
    root = {w: w for w in words}
    for _ in words:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.stem: r.root for r in names.clusters(stems, pairs).collect()} == root


def test_chains_of_links_are_one_cluster(spark, monkeypatch):
    """Long chains in order, the same words in two sessions, and rounds of contraction only."""
    monkeypatch.setattr(names, "FEW", 0)
    words = [f"w{i:03d}" for i in range(60)]
    stems = spark.createDataFrame([(s, w) for s in (1, 2) for w in words] + [(3, "alone")], "session_id long, stem string")
    links = spark.createDataFrame([(1, a, b) for a, b in zip(words, words[1:])] + [(2, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if i != 29], "session_id long, a string, b string")
    got = {(r.session_id, r.stem): r.root for r in names.clusters(stems, links).collect()}
    assert got == {**{(1, w): "w000" for w in words}, **{(2, w): "w000" if i < 30 else "w030" for i, w in enumerate(words)}, (3, "alone"): "alone"}
    assert {r.root for r in names.clusters(stems, links.limit(0)).collect()} == {*words, "alone"}


def test_stems_drop_one_ending(spark):
    rows = {"Thon's": "thon", "’Tis": "tis", "he'll": "he", "a'll": "a'll", "don't": "do", "n't": "n't", "''x''": "x", "we’ve": "we", "O'Er": "o'er", "it's's": "it's", "": ""}
    df = spark.createDataFrame([(k,) for k in rows], "token string")
    assert {r.token: r.stem for r in df.withColumn("stem", T.stem("token")).collect()} == rows


def test_contamination_steps(spark):
    s = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "session_id long, declared_truth boolean")
    e = spark.createDataFrame([(1, "alpha.cpp"), (1, "big-v2.bin"), (2, "alpha.cpp"), (3, "beta")], "session_id long, value string")
    d = spark.createDataFrame([(i, "alpha.cpp big v2") for i in (1, 2, 3, 4)], "session_id long, provider string")
    assert {r.session_id: r.state for r in scoring.contamination(s, e, d).collect()} == {1: "contaminated", 2: "undetermined", 3: "clean", 4: "declared_truth"}


def test_scores_move_with_single_faults(spark):
    """A baseline and one fault at a time: which figures move, and which do not."""
    base = turns(spark, [(1, i, f"t{i}", x, i * 1000, i * 1000 + 900) for i, x in enumerate(["Orvel opens the gate", "the smith Dara waits", "they cross the frozen river", "Kesh lights the beacon"])])
    target = "session_id long, grp string, ord long, label string, kind string, status string, basis string, anchor_ms long, path string"
    key = [(1, "important_entities", i, n, "person", "verified", "heard", a, f"e{i}") for i, (n, a) in enumerate([("Orvel", 100), ("Dara", 1100), ("Kesh", 3100), ("Mirr", 2100)])]
    key += [(1, "important_events", i, n, "event", "verified", "heard", a, f"v{i}") for i, (n, a) in enumerate([("Orvel opens gate", 200), ("cross frozen river", 2200), ("a song about cheese", 9999)])]
    truth = spark.createDataFrame(key, target)
    excerpt = spark.createDataFrame([(1, 0)], "session_id long, excerpt_start_ms long")

    def figures(t, ents):
        e = spark.createDataFrame([(1, i, n, [], s, z) for i, (n, s, z) in enumerate(ents)], "session_id long, entity_id long, name string, aliases array<string>, start_ms long, end_ms long")
        scenes = t.select("session_id", F.col("ord").alias("scene_id"), "start_ms", "end_ms", F.lit("").alias("title"), F.col("text").alias("summary"))
        basis = scoring.time_basis(t, truth, excerpt)
        c = scoring.entity_capture(scoring.target_outcomes(truth, e, basis)).first()
        p = scoring.plot_capture(truth, scenes, basis).first()
        return c.recall_by_name, c.recall_anchored, p.coverage, p.term_overlap_share

    good = [("Orvel", 0, 900), ("Dara the smith", 1000, 1900), ("Kesh", 3000, 3900)]
    assert figures(base, good) == (0.75, 0.75, 0.6667, 0.6667)
    assert figures(base, [("Orvan", 0, 900), *good[1:]]) == (0.5, 0.5, 0.6667, 0.6667)
    assert figures(base.filter("ord <> 2"), good) == (0.75, 0.75, 0.3333, 0.3333)


def test_anchors_off_the_clock_are_null(spark):
    t = turns(spark, TURNS)
    truth = spark.createDataFrame([(1, "important_entities", 0, "Brannoc", "p", "verified", "heard", 999999, "e0")], "session_id long, grp string, ord long, label string, kind string, status string, basis string, anchor_ms long, path string")
    e = spark.createDataFrame([(1, 0, "Brannoc", [], 0, 900)], "session_id long, entity_id long, name string, aliases array<string>, start_ms long, end_ms long")
    basis = scoring.time_basis(t, truth, spark.createDataFrame([(1, 0)], "session_id long, excerpt_start_ms long"))
    got = scoring.entity_capture(scoring.target_outcomes(truth, e, basis)).first()
    assert (got.recall_by_name, got.recall_anchored) == (1.0, None)


NOTE = "---\ntype: person\ntags:\n - a\nmood:\n---\n# Orvel\nsee [[Dara|her]] [[Gate#inner]] ![[map.PNG]] [[Dr. Kesh]]\n## Session 3\nx\n### Deep\ny\n## Last  \n  - kept indent\n\n"


def test_notes(spark):
    files = spark.createDataFrame([("people/Orvel.md", NOTE), ("Dara.md", "## only"), ("x/Gate.md", ""), ("y/Gate.md", ""), ("Dr. Kesh.md", "---\nnot closed")], "path string, content string")
    n = notes.parse(files)
    o = n.filter("title = 'Orvel'").first()
    assert (o.folder, o.note_type, o.h1) == ("people", "person", "Orvel")
    assert [(f.key, f.shape) for f in o.fields] == [("type", "scalar"), ("tags", "block-list"), ("mood", "empty")]
    assert [(s.title, s.section_ix, s.session_ref, s.line) for s in o.sections] == [("Orvel", -1, None, 7), ("Session 3", 0, 3, 9), ("Deep", 1, None, 11), ("Last", 2, None, 13)]
    t = notes.topology(n).first()
    assert (t.total, t.resolved, t.unresolved, t.ambiguous, t.piped, t.anchored, t.embeds_to_asset) == (3, 2, 0, 1, 1, 1, 1)
    body = {r.title: r.body for r in notes.section_bodies(n).filter("path like 'people%'").collect()}
    assert body["Session 3"] == "x\n### Deep\ny"


def test_region_digest_keeps_indents(spark):
    d = lambda x: one(spark, T.region_digest(F.lit(x)))
    assert d("a\n  b\n") == d("\n\na  \n  b\t\n\n")
    assert d("a\n  b") != d("a\nb")


def test_paths_sort_by_their_parts(spark):
    df = spark.createDataFrame([("a b", 1), ("a/b", 2)], "path string, n int")
    assert [r.n for r in df.orderBy(F.split("path", "/")).collect()] == [2, 1]


def test_flat_series_correlate_to_nothing(spark):
    a = spark.createDataFrame([(1, i, 1.0) for i in range(40)] + [(2, i, float((i * 7919) % 31)) for i in range(60)], "pair long, ix long, level double")
    b = a.withColumn("ix", F.col("ix") - 4)
    got = {r.pair: r for r in align.align(a, b, 8).collect()}
    assert got[1].r == 0.0 and (got[2].lag, round(got[2].r, 6)) == (-4, 1.0)
    assert align.align(a.filter("ix < 10"), b, 2).count() == 0  # too short to compare


def test_vocabulary_absorbs_and_settles(spark):
    a = spark.createDataFrame([("p", "Orvel", ["Orval"], "x", 1), ("p", "Orvil", ["orval"], "y", 2), ("p", "Kesh", [], "x", 3), ("q", "Orvel", [], "y", 4)], "kind string, canonical string, aliases array<string>, approver string, seq long")
    got = {(r.kind, r.canonical): (r.contested, sorted(r.aliases)) for r in corrections.vocabulary(a).collect()}
    assert got == {("p", "Orvil"): (True, ["Orvel", "orval"]), ("p", "Kesh"): (False, []), ("q", "Orvel"): (False, [])}
    more = a.unionByName(spark.createDataFrame([("p", "Orvil", [], "x", 5)], a.schema))
    assert not any(r.contested for r in corrections.vocabulary(more).collect())


def test_sheets_are_refused_whole(spark):
    sheet = {"answered_by": "p", "answers": [{"question_id": "q1", "action": "accept"}, {"question_id": "q2", "action": "defer", "operation": {"op": "revise_entity", "entity_id": "e", "name": "N"}}]}
    a = corrections.parse_sheets(spark.createDataFrame([(1, json.dumps(sheet)), (2, json.dumps({**sheet, "answers": sheet["answers"][:1]}))], "session_id long, payload string"))
    log = spark.createDataFrame([(2, 1, "other", "question:q1")], "session_id long, sequence long, answered_by string, decided string")
    assert [r.finding for r in corrections.sheet_findings(a).collect()] == ["this action carries no operation"]
    assert corrections.accepted(a, log).count() == 0
    assert [r.session_id for r in corrections.accepted(a, log, override=True).collect()] == [2]


def test_old_sessions_are_read_and_unknown_ones_refused(spark, tmp_path):
    turn = {"id": "t1", "start_ms": 0, "end_ms": 5, "text": "x", "confidence": 0.5}
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "0.1", "session_id": "s", "status": "imported", "turns": [turn]}))
    got = sessions.sessions(spark, str(tmp_path)).first()
    assert (got.schema_version, got.turns[0].confidence_kind) == ("0.2", "unstated")
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": "9", "session_id": "z", "turns": []}))
    with pytest.raises(Exception, match="unreadable session version"):
        sessions.sessions(spark, str(tmp_path)).collect()
    assert sessions.sessions(spark, str(tmp_path), strict=False).filter("readable").count() == 1


def test_engine_strings_stop_at_their_depth(spark):
    deep = {"engine": "top"}
    for i in range(9):
        deep = {"model": f"m{i}", "in": [deep]}
    got = {r.value for r in scoring.engine_strings(spark.createDataFrame([(1, json.dumps(deep))], "session_id long, native string")).collect()}
    assert "m8" in got and "top" not in got


def test_collection_of_files(spark, tmp_path):
    for p, x in {"a/One.md": "# One", "a/pic.png": "p", ".obsidian/w.md": "no", "Thumbs.db": "no", "b/Two.md": "[[One]]"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(x)
    assert sorted(r.path for r in collections.markdown(spark, str(tmp_path)).collect()) == ["a/One.md", "b/Two.md"]
    assert [r.name for r in collections.assets(spark, str(tmp_path)).collect()] == ["pic.png"]
    d = notes.tree_digest(collections.files(spark, str(tmp_path)))
    assert d.first().files == 3 and d.first().digest == d.first().digest
    doc = sinks.survey_document(collections.markdown(spark, str(tmp_path)))
    assert doc["notes"] == 2 and doc["link_topology"]["resolved"] == 1


def test_documents_are_whole(tmp_path):
    p = tmp_path / "r.json"
    sinks.write_document(str(p), {"a": None})
    with pytest.raises(TypeError):
        sinks.write_document(str(p), {"a": object()})
    assert json.loads(p.read_text()) == {"a": None}
    assert "not measured" in sinks.render("T", {"a": None})


def test_models_retry_only_what_cannot_be_read(spark):
    def reply(prompt):
        return {"bad": "no json", "cites": '{"scenes": [{"turn_ids": ["t9"]}]}'}.get(prompt, '{"scenes": []}'), 1, 1

    df = spark.createDataFrame([(1, 0, "bad", ["t1"]), (1, 1, "cites", ["t1"]), (1, 2, "ok", ["t1"])], "session_id long, window_ix long, prompt string, turn_ids array<string>")
    got = {r.window_ix: (r.attempts, r.error is None) for r in plugs.analysed(df, plugs.Model(reply)).collect()}
    assert got == {0: (2, False), 1: (1, False), 2: (1, True)}


def test_stream_starts_again_where_it_stopped(spark, tmp_path):
    base = str(tmp_path)
    lot = lambda rows: spark.createDataFrame(rows, streaming.APPROVAL).coalesce(1).write.mode("append").parquet(f"{base}/in")
    lot([("k", "Orvel", [], "x", 5), ("k", "Orvil", [], "y", 6)])
    streaming.approval_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c")
    now = lambda: sorted((r.canonical, r.entry, r.contested, r.approvals) for r in streaming.current_entries(spark, f"{base}/out").collect())
    assert now() == [("Orvel", 5, False, 1), ("Orvil", 6, False, 1)]  # two names of one kind are two entries
    lot([("k", "Orval", ["orvel"], "y", 2), ("k", "Dara", [], "y", 8)])  # an old approval comes late and shares a surface with the first
    streaming.approval_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c")
    assert now() == [("Dara", 8, False, 1), ("Orvel", 5, True, 2), ("Orvil", 6, False, 1)]
    lot([("k", "orvel ", ["Orvil"], "y", 9)])  # a new one settles it, and brings another entry in
    streaming.approval_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c")
    streaming.approval_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c")
    assert now() == [("Dara", 8, False, 1), ("orvel ", 9, False, 4)]


def test_entries_are_components_of_a_chain(spark):
    """Approvals that are joined through others only, by a chain in an order that is hard on least labels, against a plain fold."""
    rng = random.Random(4)
    order = list(range(40))
    rng.shuffle(order)
    rows = [("k", f"n{i}", [f"n{i + 1}"] if i != 20 else [], f"p{i % 3}", seq) for seq, i in enumerate(order)] + [("other", "n1", ["N  2"], "p0", 99)]
    got = {(r.kind, r.entry): r for r in corrections.vocabulary(spark.createDataFrame(rows, "kind string, canonical string, aliases array<string>, approver string, seq long")).collect()}
    want = [{i for i in range(21)}, {i for i in range(21, 40)}]
    assert {(r.kind, r.entry, r.canonical, r.approvals) for r in got.values()} == {("other", 99, "n1", 1)} | {("k", s, f"n{order[s]}", len(w)) for w in want for s in [max(order.index(i) for i in w)]}
    for w in want:
        last = max(order.index(i) for i in w)
        names = {f"n{i}" for i in w} | {f"n{i + 1}" for i in w if i != 20}
        assert set(got["k", last].aliases) == names - {f"n{order[last]}"}
    assert corrections.vocabulary(spark.createDataFrame([], "kind string, canonical string, aliases array<string>, approver string, seq long")).count() == 0


def folded_one_by_one(rows):
    """Approvals folded in order into a plain list of entries: kind and least surface -> canonical name, aliases, contested, approvals."""
    fold = lambda x: " ".join(x.lower().split())
    entries = []
    for kind, canonical, aliases, approver, _ in rows:
        names = {fold(x) for x in (canonical, *aliases)}
        hit = [e for e in entries if e["kind"] == fold(kind) and e["names"] & names]
        entries = [e for e in entries if e not in hit]
        said = {k: v for e in hit for k, v in e["said"].items()}
        said[fold(kind), canonical, tuple(aliases), approver] = canonical
        entries.append({"kind": fold(kind), "names": names.union(*(e["names"] for e in hit)), "said": said})
    return {(e["kind"], min(e["names"])): (frozenset(e["names"]), len(e["said"])) for e in entries}


def entries_now(df):
    fold = lambda x: " ".join(x.lower().split())
    return {(r.kind_key, r.root): (frozenset(fold(x) for x in (r.canonical, *r.aliases)), r.approvals) for r in df.collect()}


def test_equal_numbers_join_no_approvals(spark):
    """Sessions count their own approvals: the same number, kind and approver are no reason to join."""
    a = spark.createDataFrame([("person", "Ann", ["A1"], "x", 1), ("person", "Zed", ["Z1"], "y", 1), ("Person", "ann", [], "y", 1), ("person", None, ["q"], "x", 1), (None, "Ann", [], "x", 1), ("person", "Ida", None, None, None)], streaming.APPROVAL)
    got = {r.root: r for r in corrections.vocabulary(a).collect()}
    assert {k: (r.canonical.lower(), sorted(x.lower() for x in r.aliases), r.contested, r.approvals) for k, r in got.items()} == {"a1": ("ann", ["a1"], False, 2), "z1": ("zed", ["z1"], False, 1), "ida": ("ida", [], False, 1)}
    assert {(r.k, r.s) for r in corrections.surfaces(corrections.vocabulary(a)).collect()} == {("person", s) for s in ("ann", "a1", "zed", "z1", "ida")}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_the_batch_and_a_plain_fold(spark, tmp_path, seed):
    """Random approvals with equal numbers in four lots, the stream started anew for each: entries as the batch finds them by components and as a plain fold does."""
    rng = random.Random(seed)
    name = lambda: rng.choice("ABab") + rng.choice(["el", "EL", "or", " o  r"]) + str(rng.randrange(14))
    rows = [(rng.choice(["person", "Person", "place"]), name(), [name() for _ in range(rng.randrange(3))], rng.choice(["x", "y", None]), rng.randrange(6)) for _ in range(60)]
    base, seen = str(tmp_path), []
    for i in range(0, 60, 15):
        seen += rows[i : i + 15]
        spark.createDataFrame(rows[i : i + 15], streaming.APPROVAL).coalesce(1).write.mode("append").parquet(f"{base}/in")
        streaming.approval_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c")
        now = streaming.current_entries(spark, f"{base}/out")
        assert entries_now(now) == folded_one_by_one(seen)
        key = lambda r: (r.kind_key, r.root)
        assert sorted(now.collect(), key=key) == sorted(corrections.vocabulary(spark.createDataFrame(seen, streaming.APPROVAL)).collect(), key=key)
    # What comes again changes nothing, so nothing leaves the state.
    before = spark.read.parquet(f"{base}/out").count()
    spark.createDataFrame(rows[:10], streaming.APPROVAL).coalesce(1).write.mode("append").parquet(f"{base}/in")
    streaming.approval_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c")
    assert spark.read.parquet(f"{base}/out").count() == before


def test_only_changed_entries_leave_a_batch(spark, tmp_path):
    base = str(tmp_path)
    lot = lambda rows: (spark.createDataFrame(rows, streaming.APPROVAL).coalesce(1).write.mode("append").parquet(f"{base}/in"), streaming.approval_stream(spark, f"{base}/in", f"{base}/out", f"{base}/c"))
    lot([("k", f"n{i}", [], "x", i) for i in range(20)])
    lot([("k", "n3", ["n7"], "y", 1)])
    last = spark.read.parquet(f"{base}/out").filter("version = 2").collect()
    assert sorted((r.root, r.gone) for r in last) == [("n3", False), ("n7", True)]
    assert streaming.current_entries(spark, f"{base}/out").count() == 19


def test_loudness(spark):
    assert one(spark, engines.loudness(F.lit("RMS_level=-20.5\nRMS_level=-inf\nRMS_level=nan"))) == [-20.5, -120.0, -120.0]


def test_empty_notes_are_found(spark, tmp_path):
    (tmp_path / "n" / ".git").mkdir(parents=True)
    for name, text in (("n/a.md", "# A"), ("n/empty.md", ""), ("n/.git/x.md", ""), ("n/b.txt", "")):
        (tmp_path / name).write_text(text)
    assert sorted((r.path, r.content) for r in collections.markdown(spark, f"file://{tmp_path}").collect()) == [("n/a.md", "# A"), ("n/empty.md", "")]


def test_controls_meet_only_what_holds_their_first_token(spark):
    rows = spark.createDataFrame([(1, "the Red Gate fell"), (2, "gate red"), (3, "red red gate")], "i long, text string").withColumn("hay", T.tokens("text"))
    terms = spark.createDataFrame([("red gate",), ("Gate",), ("the",), ("",)], "term string")
    assert sorted((r.i, r.term) for r in scoring.holding(rows, terms).collect()) == [(1, "Gate"), (1, "red gate"), (2, "Gate"), (3, "Gate"), (3, "red gate")]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_no_pair_of_any_length_is_lost(spark, letters):
    """Words of one letter to a dozen and one or two edits of each, in two sessions; no join of all with all in the plan."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(150)}
    for w in list(words):
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(max(1, len(w)))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            words |= {w} - {""}
    rows = [(len(w) % 2, w) for w in words] + [(2, w) for w in words]
    stems = spark.createDataFrame(rows, "session_id long, stem string")
    pairs = names.near_pairs(stems)
    plain = spark.createDataFrame([(s, a, b) for s, a in rows for t, b in rows if s == t and a < b], "session_id long, a string, b string").filter(T.near("a", "b"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, plain.collect())) and pairs.count() > 100
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_s#" in plan


def test_near_pairs_are_all_found(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(120)})
    got = {(r.a, r.b) for r in names.near_pairs(spark.createDataFrame([(1, w) for w in words], "session_id long, stem string")).collect()}
    pairs = spark.createDataFrame([(a, b) for a in words for b in words if a < b], "a string, b string")
    assert got == {(r.a, r.b) for r in pairs.filter(T.near("a", "b")).collect()} and len(got) > 50


def test_merges_across_kinds_are_refused(spark):
    op = lambda **o: {"question_id": "q", "action": "correct", "operation": o}
    sheets = [op(op="merge_entities", entity_id="a", absorbs=["b"]), op(op="merge_entities", entity_id="a", absorbs=["c"]), op(op="merge_entities", entity_id="a", absorbs=["c"], entity_kind="place"), op(op="revise_entity", entity_id="x", name="N"), op(op="merge_entities", entity_id="a", absorbs=["x", "b"])]
    a = corrections.parse_sheets(spark.createDataFrame([(i, json.dumps({"answered_by": "p", "answers": [s]})) for i, s in enumerate(sheets)], "session_id long, payload string"))
    e = spark.createDataFrame([(i, x, k) for i in range(5) for x, k in (("a", "Person"), ("b", "person"), ("c", "place"))], "session_id long, entity_id string, kind string")
    assert {r.session_id: r.finding for r in corrections.operation_findings(a, e).collect()} == {1: "a merge across kinds must say which stays", 3: "no such entity", 4: "no such entity"}
    log = spark.createDataFrame([], "session_id long, sequence long, answered_by string, decided string")
    assert sorted(r.session_id for r in corrections.accepted(a, log, entities=e).collect()) == [0, 2]


GOOD = {"scenes": [{"title": "a", "summary": "b", "turn_ids": ["t01"]}], "entities": None, "questions": [{"issue": "i", "why_it_matters": "w", "turn_ids": ["t1", "t2"], "confidence": 1, "consequence": "low"}]}


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, None), ({"scenes": {}}, "scenes must be a list of objects"), ({"scenes": ["x"]}, "scenes must be a list of objects"), ({"threads": [{"description": " "}]}, "threads must say description"),
        ({"entities": [{"name": "n", "kind": 3}]}, "entities must say kind"), ({"threads": [{"description": "d", "turn_ids": []}]}, "threads must cite turns by their ids"),
        ({"threads": [{"description": "d", "turn_ids": ["t1", 2]}]}, "threads must cite turns by their ids"), ({"threads": [{"description": "d", "turn_ids": ["t9"]}]}, "threads cites a turn outside its window"),
        ({"threads": [{"description": "d", "turn_ids": ["t0007"]}]}, "threads cites a turn outside its window"), ({"questions": [{**GOOD["questions"][0], "confidence": True}]}, "questions need a confidence from 0 to 1"),
        ({"questions": [{**GOOD["questions"][0], "consequence": "dire"}]}, "questions need a known consequence"),
    ],
)
def test_replies_of_the_wrong_shape(change, want):
    assert plugs.shape_error({**GOOD, **change}, {"t1", "t002", "t07", "t7"}) == want


def test_media_that_differ_are_moved_aside(spark, tmp_path):
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    have = {"a.mp3": b"abc", "b/b.mp3": b"x" * 3_000_000, "c.mp3": b"", "d.mp3": b"dd", "e.mp3": b"ee"}
    for p, b in have.items():
        (tmp_path / "m" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / p).write_bytes(b)
    (tmp_path / "out.mp3").write_bytes(b"o")
    said = [("a.mp3", 3, sha(b"abc").upper()), ("b/b.mp3", 2, sha(have["b/b.mp3"])), ("c.mp3", 0, sha(b"other")), ("d.mp3", 2, None), ("e.mp3", None, sha(b"ee")), ("gone.mp3", 1, "0"), ("../out.mp3", 1, "0"), (None, 1, "0")]
    df = spark.createDataFrame(said, "path string, said_bytes long, said_sha256 string")
    for _ in range(2):  # the second run finds what the first moved
        got = {r.path: (r.size_bytes, r.sha256, r.finding, r.kept) for r in media.verified(df, f"file://{tmp_path}/m").collect()}
        assert got == {
            "a.mp3": (3, sha(b"abc"), None, True), "b/b.mp3": (3_000_000, sha(have["b/b.mp3"]), "size differs", False), "c.mp3": (0, sha(b""), "digest differs", False), "d.mp3": (2, sha(b"dd"), "digest not recorded", True),
            "e.mp3": (2, sha(b"ee"), "size not recorded", True), "gone.mp3": (None, None, "missing", False), "../out.mp3": (None, None, "missing", False), None: (None, None, "missing", False),
        }
        assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.is_file()) == ["a.mp3", "c.mp3.quarantine", "d.mp3", "e.mp3"] and (tmp_path / "out.mp3").exists()


def test_words_wrap_whole():
    text = "one two-three " + "x" * 30 + " four five"
    assert sinks.wrap(text, 20, "  ") == ["  one two-three", "  " + "x" * 30, "  four five"]
    assert sinks.wrap("ab cd", 6, "") == ["ab cd"] and sinks.wrap("ab cd", 5, "") == ["ab", "cd"] and sinks.wrap(" ", 9) == []


def test_stamps_are_utc(spark):
    assert one(spark, T.utc_stamp(F.timestamp_micros(F.lit(1_700_000_000_999_999)))) == "2023-11-14T22:13:20+00:00"


def test_generated_session_by_hand(spark):
    """Two beats of half the time each: authored lines first, then the pool in turn, from 7 places further in the second beat, until the beat's time is used."""
    say = lambda *x: [{"speaker": s, "text": t} for s, t in x]
    pool = say(("p", "one 3 two"), ("q", "four"), ("r", ""))
    rows = [(1, 6000, 0, say(("a", "hello there")), pool), (1, 6000, 1, say(("b", "and 99 now")), pool), (2, 1000, 0, [], [])]
    line = "array<struct<speaker:string,text:string>>"
    got = generator.generate(spark.createDataFrame(rows, f"session_id long, target_ms long, beat int, lines {line}, pool {line}"))
    assert sorted((r.session_id, r.id, r.speaker, r.text, r.start_ms, r.end_ms) for r in got.collect()) == [
        (1, "turn-00001", "a", "hello there", 0, 800), (1, "turn-00002", "p", "one 3 two", 1200, 2400), (1, "turn-00003", "q", "four", 2800, 3200),
        (1, "turn-00004", "b", "and 99 now", 3600, 4800), (1, "turn-00005", "q", "four", 5200, 5600),
    ]
