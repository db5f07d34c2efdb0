"""SimHash, conversation repair and hard negatives against plain versions."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from chronoloom.llm import repair, simhash, vafile
from test_corpus import docs, none, odd, odd_rows, pairs, sort  # noqa: F401

DATA = "/root/testdata/sf0.001"
U = np.uint64


# ---------------------------------------------------------------------------------------------- SimHash


def test_golay_codewords():
    """Every word is within three bits of its codeword, and words at up to two bits share a near codeword."""
    rng = np.random.default_rng(1)
    code = np.array([(i << 11) | int(simhash._remainder(np.array([i << 11]))[0]) for i in range(4096)])
    assert len(set(code.tolist())) == 4096 and (simhash.decoded(code) == np.arange(4096)).all()
    assert min(bin(int(c)).count("1") for c in code[1:]) == 7
    x = rng.integers(0, 1 << 23, 3000)
    assert (np.bitwise_count(x ^ code[simhash.decoded(x)]) <= 3).all()
    y = x ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    for a, b in zip(simhash.near_codewords(x, 23).tolist(), simhash.near_codewords(y, 23).tolist(), strict=True):
        a, b = set(a) - {-1}, set(b) - {-1}
        assert a & b and len(a) in (1, 6)


def random_prints(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=U)


def flipped(p, most, seed):
    rng = np.random.default_rng(seed)
    q = p.copy()
    for i in range(len(q)):
        for b in rng.choice(64, rng.integers(0, most + 1), replace=False).tolist():
            q[i] ^= U(1) << U(b)
    return q


def test_similar_fingerprints_share_a_key():
    p = random_prints(3000, 2)
    q = flipped(p, 4, 3)
    sets = []
    for x in (p, q):
        key, own = simhash.keys_of(x)
        of = collections.defaultdict(set)
        for k, o in zip(key.tolist(), own.tolist(), strict=True):
            of[o].add(k)
        sets.append(of)
    assert all(sets[0][i] & sets[1][i] for i in range(len(p)))
    assert max(map(len, sets[0].values())) <= 108
    zero = np.zeros(len(p), np.int64)
    fine = [simhash.finer(zero, x)[0].reshape(len(p), -1) for x in (p, q)]
    assert (fine[0] == fine[1]).any(1).all()


def plain_print(text):
    w = brute.lower(text).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, ids):
    """The smallest id that each fingerprint reaches."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    p = np.array(prints, U)
    for i in range(len(p)):
        for j in (np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= 4) + i + 1).tolist():
            root[find(j)] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = pairs(df)
    prints = [plain_print(t) for _, t in rows]
    want = [(d, p - (p >> 63 << 64), c) for (d, _), p, c in zip(rows, prints, linked(prints, [d for d, _ in rows]), strict=True)]
    assert sort(simhash.near_duplicates(df).collect()) == sort(want)


def test_fingerprints_equal_those_of_spark(docs):  # noqa: F811
    """Spark's own hash of strings is the same function with the same seed."""
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.filter("text is not null").select("doc_id", words.alias("w")).filter("size(w) >= 4")
    h = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, 4))))).alias("h")
    counts = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    plain = some.select("doc_id", h).groupBy("doc_id").agg(F.count("*").alias("n"), *counts).collect()
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect()}
    assert len(plain) > 100
    for r in plain:
        p = sum(1 << b for b in range(64) if 2 * r[f"b{b}"] > r.n)
        assert got[r.doc_id] == p - (p >> 63 << 64)


@pytest.mark.parametrize("crowd", [2048, 40, 8])
def test_no_link_is_lost_in_a_crowd(spark, crowd):
    """A dense group of near fingerprints (keys with more members than a task compares are dealt again, then in blocks) beside sparse ones."""
    centre = random_prints(1, 5)
    p = np.unique(np.concatenate([flipped(np.repeat(centre, 400), 5, 6), flipped(random_prints(150, 7), 0, 8), flipped(random_prints(150, 7), 6, 9)]))
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long").repartition(3)
    links = [(r.a, r.b) for r in simhash.links_of(df, crowd=crowd).collect()]
    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
    ids = p.view(np.int64).tolist()
    at = {x: i for i, x in enumerate(ids)}
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [ids[find(i)] for i in range(len(ids))] == linked(p, list(range(len(ids)))) or [find(i) for i in range(len(ids))] == linked(p, list(range(len(ids))))
    assert len(links) < 20 * len(ids)  # never all pairs of a group


# ---------------------------------------------------------------------------------------------- conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [] if k == 0 else [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """All edits of a short conversation, tried one by one."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows if r[1] is not None}
    best = [(10**9, "", [])]

    def go(i, cost, audit, out):
        state = "s" if out == ["s"] else out[-1] if out else ""
        follows = "a" if state == "u" else "u"
        if cost > best[0][0] or len(audit) - i > i + 3:
            return
        if i == len(rows):
            if state in ("", "a"):
                best[0] = min(best[0], (cost, audit, out))
        else:
            go(i + 1, cost + 3, audit + "D", out)
            if faults[i] not in ("b", "d"):
                extra = faults[i] == "t"
                if initials[i] == follows or (initials[i] == "s" and not out):
                    go(i + 1, cost + extra, audit + "K", [*out, initials[i]])
                go(i + 1, cost + 2 + extra, audit + "R", [*out, follows])
        if audit[-2:] != "II":
            go(i, cost + 2, audit + "I", [*out, follows])

    go(0, 0, "", [])
    cost, audit, _ = best[0]
    parts, state, i = [], "", 0
    for e in audit:
        put = "assistant" if state == "u" else "user"
        if e == "I":
            parts.append(f"{put}:")
            state = put[0]
            continue
        if e in "KR":
            role = rows[i][2] if e == "K" else put
            parts.append(f"{role}:{rows[i][3]}")
            state = role[:1]
        i += 1
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest())


def conversation_rows(seed, n=60):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "sage", "Agent"]
    texts = ["Yes.", "No", "Why?", "", None, " \n", "Done! ", "a.b", "x", "Right.\t", "é日。"]
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            out.append((c, None if rng.random() < 0.1 else t * rng.choice([1, 1, 3]), rng.choice(roles), rng.choice(texts)))
    return out + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (900, 5, "user", "Hi."), (900, 5, "user", "Hi."), (900, 5, "user", "Ha."), (900, 5, "assistant", "Hi.")]


def report_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.withColumns({n: F.lit("x") for n in ("gone", "digest", "key", "_n", "signature", "audit", "first", "k", "_copy")})


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations(spark, seed):
    rows = conversation_rows(seed)
    of = collections.defaultdict(list)
    for r in plain_damage(rows):
        of[r[0]].append(r)
    want = [(c, *plain_repair(of[c])) for c in {r[0] for r in rows}]
    got = repair.report(repair.damaged(report_of(spark, rows)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sort(got.collect()) == sort(want)


def test_conversations_of_an_empty_table_and_all_gone(spark):
    assert repair.report(repair.damaged(report_of(spark, []))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert [tuple(r) for r in repair.report(repair.damaged(report_of(spark, [(1, gone, "user", "Hi.")]))).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_are_what_the_digest_says(spark):
    rows = repair.damaged(report_of(spark, conversation_rows(3)))
    text = collections.defaultdict(list)
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position)):
        text[r.conv_id].append(f"{r.role}:{r.text}")
    for r in repair.report(rows).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(text[r.conv_id]).encode()).hexdigest()


def test_shared_prefixes_are_computed_once(monkeypatch):
    calls = []
    plain = repair.step
    monkeypatch.setattr(repair, "step", lambda layer, sign: calls.append(sign) or plain(layer, sign))
    sigs = sorted(["suau", "suaua", "suaUa", "suau-", "ua", "", "uaua"])
    told = list(repair.walk(sigs))
    prefixes = {s[:i] for s in sigs for i in range(1, len(s) + 1)}
    assert len(calls) == len(prefixes)
    for sig, cost, audit in told:
        layers = [repair.ROOT]
        for sign in sig:
            layers.append(plain(layers[-1], sign))
        assert (cost, audit) == repair.answer(layers)


def test_a_conversation_of_many_batches(spark):
    """Longer than an Arrow batch; its rows come in any order."""
    n = 25_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"), F.lit(False).alias("gone"))
    r = repair.report(rows.repartition(5)).first()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (0, 0, 0, 0, 0, 0, "K" * n)
    sha = hashlib.sha256("\n".join(f"{('user', 'assistant')[i % 2]}:t{i}." for i in range(n)).encode()).hexdigest()
    assert r.repaired_sha256 == sha


# ---------------------------------------------------------------------------------------------- hard negatives


def plain_negatives(rows, is_anchor=lambda i: i % 100 == 0):
    """rows (vec_id, label, integers)."""
    out = []
    score = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    for i, (a, label, v) in enumerate(rows):
        if not is_anchor(a):
            continue
        told = [(-score(v, w), b, other) for j, (b, other, w) in enumerate(rows) if j != i]
        for p, b, _ in sorted(t for t in told if t[2] == label)[:5]:
            near = sorted(t for t in told if t[2] != label and -80 * p <= -100 * t[0] <= -100 * p)[:5]
            out += [(a, b, k + 1, c, -p, -s) for k, (s, c, _) in enumerate(near)]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, [x / 256 for x in v], label) for i, label, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)


@pytest.mark.parametrize("case", ["plain", "ties", "huge", "short"])
def test_hard_negatives(spark, monkeypatch, case):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(vafile, "STRIPE_ROWS", 300)
    monkeypatch.setattr(vafile, "FILE_ROWS", 150)
    size = {"plain": 200, "ties": 2, "huge": 1 << 22, "short": 50}[case]
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-size, size + 1, rng.integers(1, 9) if case == "short" else 8).tolist()) for i in range(900)]
    rows += [(100, 1, rows[0][2]), (100, 1, rows[0][2]), (500, 2, rows[7][2])]  # ids that repeat, and a row that repeats
    got = vafile.mined(vafile.labelled(vectors_of(spark, rows)), F.col("vec_id") % 100 == 0)
    assert sort(got.collect()) == sort(plain_negatives(rows))


def test_rows_that_take_no_part(spark):
    bad = [(200, None, 1), (201, [], 1), (300, [float("nan")], 1), (302, [float("inf"), 1.0], 1), (303, [None, 1.0], 1), (304, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(bad, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("x"))
    assert [r.vec_id for r in vafile.labelled(df).collect()] == [201]
    assert vafile.mined(vafile.labelled(df.filter("vec_id = 200")), F.lit(True)).count() == 0
    one = vafile.labelled(spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<double>, label int"))
    assert vafile.mined(one, F.lit(True)).count() == 0
    far = vafile.labelled(spark.createDataFrame([(0, [1e300, -1e300], 1)], "vec_id long, embedding array<double>, label int")).first()
    assert far.v == [vafile.LIMIT, -vafile.LIMIT]


def test_bounds_hold_and_few_are_scored():
    rng = np.random.default_rng(6)
    x = rng.integers(-200, 200, (3000, 16))
    cells = vafile.Cells(x[:500].astype(float), x.min(0), x.max(0))
    codes = cells.codes(x)
    view = vafile.View([], 16, cells, float((np.abs(x).max(0).astype(float) ** 2).sum()))
    a = x[:50].astype(np.int32)
    low, high = view.bounds(a, codes)
    score = a.astype(np.int64) @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert ((high - low) < 0.5 * np.ptp(score)).mean() > 0.99
