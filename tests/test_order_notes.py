"""Orders, digests and links against plain loops."""

import hashlib
import random

from pyspark.sql import functions as F

from chronoloom.functions import text as T
from chronoloom.operators import notes, order


def test_places_and_digest_of_ranges(spark):
    rng = random.Random(3)
    paths = list({"/".join(rng.choice(["a", "b!", "b", "é", "Z"]) for _ in range(rng.randint(1, 4))) + f"{i % 7}.md" for i in range(200)})
    rows = [(p, f"text {p}", i) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "path string, content string, modified long").repartition(5)
    want = sorted(paths, key=lambda p: [x.encode() for x in p.split("/")])
    placed = order.placed(df.select("path", F.split("path", "/").alias("k")), "k")
    assert {r.path: r.place for r in placed.collect()} == {p: i + 1 for i, p in enumerate(want)}
    sha = hashlib.sha256()
    for p in want:
        sha.update(p.encode() + b"\0" + hashlib.sha256(f"text {p}".encode()).digest())
    got = notes.tree_digest(df).first()
    assert (got.files, got.digest, got.newest) == (len(paths), sha.hexdigest(), len(paths) - 1)
    plan = notes.tree_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    none = notes.tree_digest(df.limit(0)).first()
    assert (none.files, none.digest) == (0, hashlib.sha256(b"").hexdigest())
    assert order.placed(df.select("path").limit(0), "path").count() == 0


def plain_links(text):
    out, i = [], 0
    while (i := text.find("[[", i)) >= 0:
        stop = i + 2
        while stop < len(text) and text[stop] not in "]\n":
            stop += 1
        if stop == i + 2 or text[stop : stop + 2] != "]]":
            i += 1
            continue
        left, bar, shown = text[i + 2 : stop].partition("|")
        target, _, anchor = left.partition("#")
        out.append((target.strip(" "), anchor.strip(" ") or None, shown.strip(" ") or None, i > 0 and text[i - 1] == "!"))
        i = stop + 2
    return out


def test_links_of_any_brackets(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["[[", "]]", "[", "]", "!", "|", "#", "\n", "a", " b", "É.md"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["![[x]]", "a![[x|y|z]]", "[[a#b#c|d]]", "[[a [[b]]", "[[]]", "[[ ]]", "[[a]]]]", "]]", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "path long, content string").withColumn("path", F.col("path").cast("string"))
    want = sorted((str(i), *x) for i, t in enumerate(texts) for x in plain_links(t))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in notes.links(df).select("path", "target", "anchor", "display", "is_embed").collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 100
    arrays = df.select("path", F.explode(T.links("content")).alias("l")).select("path", "l.*").collect()
    assert sorted(map(tuple, arrays), key=key) == sorted(want, key=key)


def test_titles_need_no_content(spark):
    df = spark.createDataFrame([("a/N.md", "[[M]] [[N]] [[x/M.md|s]]"), ("b/M.md", "![[p.png]]"), ("M.md", "")], "path string, content string")
    assert {(r.path, r.basename, r.hits, r.state) for r in notes.resolved(df).collect()} == {("a/N.md", "M", 2, "ambiguous"), ("a/N.md", "N", 1, "resolved"), ("b/M.md", "p", 0, "embed")}
    assert sorted(notes.resolved(df).collect()) == sorted(notes.resolved(notes.parse(df)).select(notes.resolved(df).columns).collect())


def test_session_references_by_words(spark):
    rows = {"Session 12": 12, "the session #7 log": 7, "Sessions 3": None, "xsession 4": None, "session\t 5b": None, "session 5b session 6": 6, "session#8": 8, "SESSION 99999999999999": None, "sessionsession 1": None, "é session 2": 2, "ésession 2": None, "session ## 3": None, "": None}
    df = spark.createDataFrame([(k,) for k in rows], "title string")
    assert {r.title: r.n for r in df.withColumn("n", T.session_reference("title")).collect()} == rows


def test_keys_fold_by_words(spark):
    rows = {"Generated-By": "generated_by", " created \t by": "created_by", "a - b": "a_b", "x": "x", "-x-": "_x_", "": ""}
    df = spark.createDataFrame([(k,) for k in rows], "k string")
    assert {r.k: r.f for r in df.withColumn("f", T.fold_key("k")).collect()} == rows
