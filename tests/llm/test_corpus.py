"""The corpus operators against plain versions, round trips and held-out accuracy."""

import collections
import hashlib
import importlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from chronoloom.llm import ann, common, components, langid, minhash, mixing, packing, partenum, quality, substring, suffix, warc, windows

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and blank texts, copies, near copies, repeated rows and ids, a long text, a periodic one."""
    base, shared = passage(1, 120), passage(2, 60)
    near = base.split()
    near[50] = "changed"
    long = passage(3, 30_000)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 2), (3, " ".join(near), "en", "a", None), (3, " ".join(near), "en", "a", None), (4, None, None, None, None), (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "b", 3), (7, "one", "de", "b", 3), (8, "one", None, "c", 3), (None, base, "en", None, 5), (None, passage(9, 40), "fr", None, 5), (9, shared + " " + passage(4, 50), "en", "a", 9),
        (10, passage(5, 20) + "\n" + shared, "en", "a", 9), (11, "ab " * 90, "en", "a", 9), (12, long, "en", "c", 9), (13, "Zz é ß 日本 " + passage(6, 10), "en", "c", 9), (14, "12 34 !!", "en", "c", 9),
        (7, passage(7, 70), "en", "b", 1), (15, base.upper(), "en", "a", 2), (16, long[:9000], "en", "c", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names clash with what operators use inside."""
    names = ["tag", "spans", "key", "rep", "sketch", "band", "size", "u", "bin", "score", "lang_pred", "n_words", "_tag", "_id", "_d", "_t", "_copies", "_found", "_k", "_rank", "h", "model", "part"]
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sort(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_substring(request, which):
    df = request.getfixturevalue(which)
    assert sort(substring.report(df).collect()) == sort(brute.substring(pairs(df)))


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_substring_text(request, which):
    """The operator's own output: kept words; every column stays."""
    df = request.getfixturevalue(which)
    got = substring.remove(df)
    assert set(df.columns) <= set(got.columns)
    want = collections.Counter(r[3] for r in brute.substring(pairs(df)))
    assert collections.Counter(hashlib.sha256(b" ".join(brute.words(r.text))).hexdigest() for r in got.select("text").collect()) == want


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_suffix(request, which):
    df = request.getfixturevalue(which)
    assert sort(suffix.report(df).collect()) == sort(brute.suffix(pairs(df)))


@pytest.mark.parametrize("k", [3, 8, 13, 16, 50])
def test_suffix_arrays_are_in_the_order_of_bytes(k):
    text = (passage(k, 60) + " ab" * 30 + passage(k + 1, 60)[:300] + "\xff\0" * 40).encode("latin-1")
    n = len(text) - k + 1
    order, new = windows.suffix_array(windows.packed_words(text), np.arange(n, dtype=np.int32), k)
    cut = [text[i : i + k] for i in order.tolist()]
    assert cut == sorted(cut) and sorted(order.tolist()) == list(range(n))
    assert [True, *(x != y for x, y in zip(cut, cut[1:]))] == new.tolist()


def test_levels_are_scanned_and_merge():
    k, texts = 12, [passage(1, 80).encode(), passage(2, 80).encode(), passage(3, 50).encode()]
    levels = []
    for t in texts:
        order, new = windows.suffix_array(windows.packed_words(t), np.arange(len(t) - k + 1, dtype=np.int32), k)
        levels.append(windows.Level(t, order[new], k))
    both = levels[0].merged(levels[1])
    here = [both.buffer[i : i + k] for i in both.where.tolist()]
    assert here == sorted(here) and len(here) == len(levels[0].where) + len(levels[1].where)
    ask = texts[1][40:200] + texts[2] + texts[0][:90]
    at = np.arange(len(ask) - k + 1)
    lo, found = both.find(windows.packed_words(ask), at)
    want = set(here)
    assert found.tolist() == [ask[i : i + k] in want for i in at.tolist()]
    assert all((i == len(here) or here[i] >= ask[a : a + k]) and (i == 0 or here[i - 1] < ask[a : a + k]) for a, i in zip(at.tolist(), lo.tolist()))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_batches_one_after_another_are_one_run(spark, request, tmp_path, which):
    """An index that is opened anew for each of six batches gives what one run gives, and its levels grow geometrically."""
    df = request.getfixturevalue(which)
    rows = pairs(df)
    ids = sorted({d for d, _ in rows if d is not None})
    cuts = [ids[len(ids) * i // 6] for i in range(6)]
    got, sizes = [], []
    for a, z in zip(cuts, [*cuts[1:], None]):
        part = df.filter((F.col("doc_id") >= a) & ((F.col("doc_id") < z) if z is not None else F.lit(True)))
        index = suffix.SuffixIndex(spark, str(tmp_path / "index"))
        got += index.append(part).collect()
        sizes.append([n for _, n in suffix.SuffixIndex(spark, str(tmp_path / "index")).levels])
        assert all(x > y for x, y in zip(sizes[-1], sizes[-1][1:]))
    got += suffix.SuffixIndex(spark, str(tmp_path / "index")).append(df.filter("doc_id is null")).collect()
    assert sort(got) == sort(brute.suffix(rows))
    assert max(map(len, sizes)) < 6 and {len(x) for x in sizes} != {1} or which == "odd"
    with pytest.raises(ValueError, match="not greater"):
        suffix.SuffixIndex(spark, str(tmp_path / "index")).append(df.filter(F.col("doc_id") == ids[0]))


def test_equal_hashes_of_unequal_windows(monkeypatch):
    """With a hash that tells nothing apart, results are still those of the bytes."""
    rows = [(1, b"abcabcabc"), (2, b"xbcabcz"), (3, b"qqq")]
    monkeypatch.setattr(windows, "grams", lambda v, k: np.zeros(max(0, len(v) - k + 1), np.uint64))
    for ordered in (True, False):
        plan = windows.Plan(3, 2, False, 1, ordered)
        text, doc = b"".join(t for _, t in rows), np.array([d for d, _ in rows])
        count = np.array([len(t) - 2 for _, t in rows])
        hit = windows.ordered(text, doc, count, plan)[0] if ordered else windows.unordered(text, count, np.zeros(3, bool), plan)
        all_windows = [(d, t[i : i + 3]) for d, t in rows for i in range(len(t) - 2)]
        every = collections.Counter(w for _, w in all_windows)
        assert hit.tolist() == [any(w in u for e, u in rows if e < d) if ordered else every[w] > 1 for d, w in all_windows]


@pytest.mark.parametrize("words", [True, False])
def test_segments_hold_each_window_once(words):
    text = passage(8, 400).encode()
    units = text.split() if words else text
    got = []
    for at, piece in windows.segments(text, 5, words, 300):
        u = piece.split() if words else piece
        got += [(at + i, tuple(u[i : i + 5])) for i in range(len(u) - 4)]
    assert got == [(i, tuple(units[i : i + 5])) for i in range(len(units) - 4)]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_jaccard_components(request, which):
    df = request.getfixturevalue(which)
    got = partenum.groups(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sort(got) == sort(brute.components(pairs(df)))


def test_jaccard_keeps_one_of_each(odd):
    kept = partenum.kept(odd)
    assert kept.columns == odd.columns
    rows = pairs(odd)
    sets = {brute.shingles(t, 4) for _, t in pairs(kept)}
    for _, t in rows:
        s = brute.shingles(t, 4)
        assert not s or any(100 * len(s & k) >= 85 * len(s | k) for k in sets)
    texts = collections.Counter(t for _, t in pairs(kept) if brute.shingles(t, 4))
    assert max(texts.values()) == 1 and passage(1, 120).upper() not in texts


@pytest.mark.parametrize("share", [80, 85])
@pytest.mark.parametrize("seed", range(3))
def test_near_sets_share_a_signature(seed, share):
    rng = np.random.default_rng(seed)
    near = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, rng.choice([8, 400]))), dtype=np.uint64))
        worst = (100 - share) * 2 * len(a) // (100 + share)
        b = np.unique(np.concatenate((a[int(rng.integers(0, worst + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, worst + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if not len(b):
            continue
        sig, own = partenum.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), share)
        if 100 * both >= share * (len(a) + len(b) - both):
            near += 1
            assert np.intersect1d(sig[own == 0], sig[own == 1]).size
        x, y = partenum.folded([partenum.sketch(a), partenum.sketch(b)])
        assert partenum.bound(x, y) <= len(a) + len(b) - 2 * both
    assert near > 50


@pytest.mark.parametrize("size", [5, 20, 74, 300, 2000])
def test_unlike_sets_share_no_signature(size):
    """Sets without a shingle in common have none, and candidates grow with the sets where each has shingles that many have."""
    rng = np.random.default_rng(size)
    line = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    met = []
    for many in (500, 1000):
        own_part = [rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(many)]
        sets = [np.unique(x) for x in own_part]
        sig, own = partenum.signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), 80)
        assert len(np.unique(sig)) == len(sig)
        sets = [np.unique(np.concatenate((x, line))) for x in own_part]
        sig, own = partenum.signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), 80)
        met.append((len(sig) - len(np.unique(sig))) / many)
    assert met[1] < 1.5 * met[0] + 0.5 and met[1] < 4


def test_salted_joins_lose_nothing(spark):
    left = spark.createDataFrame([(i, 0 if i < 300 else i) for i in range(400)], "v long, k long")
    right = spark.createDataFrame([(i, f"t{i}") for i in range(0, 390)], "k long, t string")
    got = common.salted(left, right, "k", 10)
    assert sort([(r.v, r.k, r.t) for r in got.collect()]) == sort([(r.v, r.k, r.t) for r in left.join(right, "k").select("v", "k", "t").collect()])


def test_thinning_misses_no_id(spark):
    rows = spark.range(5000).withColumn("x", F.when(F.col("id") % 7 > 0, F.col("id")))
    ids = rows.filter("id % 10 = 0").select("id", "x")
    got = common.thinned(rows, ids, ["id", "x"])
    assert {r.id for r in ids.collect()} <= {r.id for r in got.collect()} and got.count() < 700 and got.columns == rows.columns
    marked = common.thinned(rows, ids, ["id", "x"], "m")
    assert marked.count() == 5000 and marked.filter("m").count() == got.count()
    assert common.thinned(rows, ids.limit(0), ["id", "x"]).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 301), (301, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_fingerprints(request, which):
    df = request.getfixturevalue(which)
    got = minhash.edited_report(df).collect()
    rows = pairs(df)
    assert len(got) == len(rows)
    if which != "docs":
        return
    order, by = sorted(rows, key=lambda r: -r[0]), {r.doc_id: r for r in got}
    off = []
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        r = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        s = brute.shingles(t, 5)
        off += [abs(r.near_edited - like(s, brute.shingles(e, 5))), abs(r.near_next - like(s, brute.shingles(after, 5)))]
    assert np.mean(off) < 0.03 and max(off) < 0.2


def test_equal_texts_have_equal_fingerprints(odd):
    by = collections.defaultdict(set)
    for r in minhash.fingerprints(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        by[r.text].add(r.fingerprint)
    a, b = minhash.signatures([b"", b" \n"])
    assert minhash.likeness(a, b) == 1.0 and minhash.likeness(a, minhash.signatures([b"word"])[0]) < 0.01


@pytest.mark.parametrize("words", [300, 2_000, 20_000, 200_000])
def test_unlike_texts_have_unlike_fingerprints(words):
    a, b = minhash.signatures([passage(words, words).encode(), passage(words + 1, words).encode()])
    assert minhash.likeness(a, b) < 0.01
    half = passage(words, words).split()[: words // 2]
    c = minhash.signatures([" ".join([*half, *passage(words + 2, words // 2).split()]).encode()])[0]
    assert abs(minhash.likeness(a, c) - 1 / 3) < 0.15


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_groups_of_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    want = sort(brute.components(pairs(df), 5, 80))
    assert sort(minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()) == want
    assert sort(minhash.edited_report(df, 1e4).select("doc_id", "group_id").collect()) == sort((d, c) for d, _, c in want)


@pytest.mark.parametrize("block", [1024, 7])
def test_no_link_of_a_group_is_lost(spark, monkeypatch, block):
    """Near copies of one text, each with its own edit, against all pairs; repeated and null ids and texts without words among them."""
    monkeypatch.setattr(partenum, "BLOCK", block)
    rng, base = random.Random(5), passage(30, 120).split()
    rows = [(4, ""), (5, " \n"), (6, "\t"), (7, None), (1, " ".join(base)), (2, " ".join(base)), (9, passage(31, 90)), (9, passage(31, 91)), (None, passage(31, 92))]
    for i in range(60):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(120)] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sort(brute.components(rows, 5, 80))
    assert len({c for _, _, c in want}) > 8
    assert sort(minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()) == want
    assert sort(partenum.groups(df, 80, 5).select("doc_id", "n_shingles", "component_id").collect()) == want


def test_rows_without_an_id_spread(spark):
    """Many rows without an id are dealt to several ranges, and their chain stays whole."""
    rows = [(None, passage(i, 30)) for i in range(300)] + [(i, passage(1000 + i, 30)) for i in range(40)]
    got = minhash.edited_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3e3)
    assert got.count() == 340 and got.select(F.spark_partition_id().alias("p"), "doc_id").filter("doc_id is null").select("p").distinct().count() > 3
    texts = {t for _, t in rows}
    edited = collections.Counter(r.edited_sha256 for r in got.collect())
    after = {hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest(): (t, u) for t in texts for u in texts}
    chain = dict(after[e] for e in edited)
    assert len(chain) == 340 and set(chain.values()) == texts


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_packing(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    got = packing.pack(df).collect()
    model = Tokenizer.from_file(packing.vocabulary()[0])
    want = collections.Counter()
    for d, t in pairs(df):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((d, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(seqs) == list(range(len(seqs)))
    if which == "docs":
        assert sum(want_[2] * n for want_, n in want.items()) / (2048 * len(seqs)) > 0.97


def test_encoder_without_ranks_and_odd_space():
    a, b = packing.Encoder(packing.vocabulary()[0]), packing.Encoder(*packing.vocabulary())
    texts = [x.encode() for x in ["a  b", "<|endoftext|> x", " lead", "trail ", "tab\tx", "a\n\nb", "don't 12,3\nx's", "日本 語\nテ", "a\x1cb c", "x y", "", "plain words here"]]
    assert a.encode(texts) == b.encode(texts) == [a.whole(t) for t in texts]


def test_patterns_use_every_piece():
    rng = random.Random(3)
    histogram = {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(200)}
    found = packing.patterns(histogram)
    used = collections.Counter()
    for pattern, n in found:
        assert sum(pattern) <= 2048 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            used[length] += n
    assert used == histogram


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\ny\r\n", "\r\n\r\n", "x" * 300_000, "é日", "<p>a</p>", "WARC/1.1\r\nContent-Length: 3\r\n\r\n", "<p>n</p>"]
    rows = [(i, f"http://h/{i}" if i % 3 else None, h) for i, h in enumerate(html)] + [(0, "again", "<p>a</p>"), (None, "u", "<p>n</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    raw, kept = str(tmp_path / "raw"), str(tmp_path / "kept")
    warc.archive_pages(pages, raw)
    back = warc.read_archive(spark, raw).collect()
    assert collections.Counter((r.page_id, r.payload) for r in back) == collections.Counter((p, (h or "").encode()) for p, _, h in rows)
    warc.deduplicate(spark, raw, kept)
    got = warc.resolve(warc.read_archive(spark, kept)).collect()
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(least.get(h or "", p), p)
    for r, n in collections.Counter(got).items():
        match = [h or "" for p, _, h in rows if p == r.page_id and len((h or "").encode()) == r.payload_bytes]
        assert match and n <= len(match)
        first = least[match[0]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
    assert len(got) == len(rows)
    assert warc.originals(warc.read_archive(spark, raw), least=9).filter("original is null").count() == sum(len((h or "").encode()) < 9 for _, _, h in rows)
    records = warc.read_archive(spark, kept).collect()
    by = {r.record_id: r for r in records}
    assert len(by) == len(rows) and {r.record_type for r in records} == {"response", "revisit"}
    assert all(by[r.refers_to_id].record_type == "response" and by[r.refers_to_id].payload_digest == r.payload_digest for r in records if r.record_type == "revisit")
    fixed = str(tmp_path / "again")
    warc.deduplicate(spark, kept, fixed)  # revisits stay what they are
    assert collections.Counter(r.record_type for r in warc.read_archive(spark, fixed).collect()) == collections.Counter(r.record_type for r in records)


def test_deduplicated_archives_are_deduplicated_again(spark, tmp_path):
    """Every archive comes out again, also those without responses (a file of no bytes is none); revisits keep their payload's size and follow their response to its new id, or to that one's original."""
    raw = tmp_path / "raw"
    raw.mkdir()
    p, q, s = b"<p>a</p>", b"<p>b</p>", b"x"
    of = lambda i, kind, body, refers=None: warc.record(f"<urn:{i}>", kind, f"http://h/{i}", "2020-01-01T00:00:00Z", i, warc.digest(body), body, refers)
    ref = lambda i: (f"<urn:{i}>", f"http://h/{i}", "2020-01-01T00:00:00Z")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    files = {
        "one": [of(1, "response", p), of(2, "response", p), of(3, "response", q)],
        "two": [of(4, "revisit", p, ref(2)), of(5, "revisit", q, ref(3)), of(6, "revisit", q, ref(99))],  # 4 refers to what becomes a revisit of 1; 6 to a response that is nowhere
        "three": [info], "four": [], "five": [of(7, "response", s), of(8, "response", s), of(9, "revisit", s, ref(8))],
    }
    for name, records in files.items():
        (raw / f"{name}.warc.gz").write_bytes(b"".join(__import__("gzip").compress(r) for r in records))
    want = [(1, 8, "response", None), (2, 8, "revisit", 1), (3, 8, "response", None), (4, 8, "revisit", 1), (5, 8, "revisit", 3), (6, None, "revisit", None)]
    source = str(raw)
    for step in range(3):
        target = str(tmp_path / f"pass{step}")
        warc.deduplicate(spark, source, target, least=2)
        records = warc.read_archive(spark, target).collect()
        got = sort((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolve(warc.read_archive(spark, target)).collect())
        assert got == sort([*want, (7, 1, "response", None), (8, 1, "response", None), (9, 1, "revisit", 8)])
        assert len(list((tmp_path / f"pass{step}").glob("*.warc.gz"))) == len(files) - 1
        dates = {r.record_id: r.date for r in records}
        for uri in (str(f) for f in (tmp_path / f"pass{step}").glob("*.warc.gz")):
            for f, _, _ in warc._records(f"file://{uri}"):
                if f.get("warc-refers-to") in dates:
                    assert f["warc-refers-to-date"] == dates[f["warc-refers-to"]]
        source = target


def test_a_record_is_a_gzip_member(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u\r\nv", "é" * i) for i in range(7)], "page_id long, url string, html string").coalesce(1)
    warc.archive_pages(pages, str(tmp_path / "a"), each=3)
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) == 3 and not list((tmp_path / "a").glob("_*"))
    members = 0
    for f in files:
        data = f.read_bytes()
        while data:
            z = zlib.decompressobj(31)
            one = z.decompress(data)
            assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC-Record-ID") == 1 and one.endswith(b"\r\n\r\n")
            members, data = members + 1, z.unused_data
    assert members == 7
    whole = tmp_path / "one" / "x.warc.gz"  # a foreign archive: one gzip member, other records among them
    whole.parent.mkdir()
    other = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole.write_bytes(z.compress(other + b"".join(warc.record(f"<{i}>", "response", "u", "d", i, warc.digest(b"p"), b"p") for i in range(3)) + other) + z.flush())
    assert [(r.page_id, r.at, r.payload) for r in warc.read_archive(spark, str(whole.parent)).collect()] == [(0, 1, b"p"), (1, 2, b"p"), (2, 3, b"p")]
    warc.deduplicate(spark, str(whole.parent), str(tmp_path / "two"))
    got = warc.resolve(warc.read_archive(spark, str(tmp_path / "two"))).collect()
    assert sort((r.page_id, r.record_type, r.refers_to) for r in got) == [(0, "response", None), (1, "revisit", 0), (2, "revisit", 0)]
    cut = tmp_path / "cut" / "x.warc.gz"
    cut.parent.mkdir()
    cut.write_bytes(whole.read_bytes()[:-9])
    with pytest.raises(Exception, match="ends within"):
        warc.read_archive(spark, str(cut.parent)).collect()


def test_warc_of_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    raw, kept = str(tmp_path / "raw"), str(tmp_path / "kept")
    warc.archive_pages(pages, raw)
    warc.deduplicate(spark, raw, kept)
    assert warc.read_archive(spark, raw).count() == 0 and warc.resolve(warc.read_archive(spark, kept)).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, len(brute.words(t))) for d, t in pairs(df))
    size, taken, target, most = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in got:
        size[r.skey] += r.size
        taken[r.skey] += r.size * r.copies
        target[r.skey] = r.target
        most[r.skey] = max(most[r.skey], r.size)
        assert 0 <= r.copies <= 3
    names = sorted(size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(size.values()), set()
    while names:
        level = (total - sum(3 * size[s] for s in stopped)) / max(1, sum(weight[s] for s in names if s not in stopped))
        more = {s for s in names if 3 * size[s] < weight[s] * level} - stopped
        if not more:
            break
        stopped |= more
    for s in names:
        assert target[s] == pytest.approx(3 * size[s] if s in stopped else min(3 * size[s], weight[s] * level))
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    assert sort((r.doc_id, r.copies, r.size) for r in mixing.mix(df).collect()) == sort((r.doc_id, r.copies, r.size) for r in got)
    assert mixing.mixed(df).columns == df.columns


def test_inclusion_follows_the_size(spark):
    """Over many seeds each document is included as often as its probability says, in proportion to its size and certain at 1; taken words stay near the target each time."""
    sizes = [1, 2, 3, 5, 8, 13, 40, 90] * 40 + [400]
    rows = [(i, " ".join(["w"] * n), "en", "a", n) for i, n in enumerate(sizes)] + [(100 + i, "x y z", "en", "b", 3) for i in range(1000, 5000)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    open_, seen, runs = None, collections.Counter(), 8
    for seed in range(runs):
        got = mixing.mix(df, weights=(1, 5), seed=f"s{seed}").filter("skey = '0a'").collect()
        open_ = got[0].target
        assert abs(sum(r.size * r.copies for r in got) - open_) <= max(sizes) / 2
        for r in got:
            seen[r.doc_id] += r.copies
    top = sorted(sizes, reverse=True)
    sure = 0
    while (open_ - sum(top[:sure])) / sum(s * s for s in top[sure:]) * top[sure] >= 1:
        sure += 1
    c = (open_ - sum(top[:sure])) / sum(s * s for s in top[sure:])
    assert 0 < open_ < sum(sizes)
    for s in set(sizes):
        n = sizes.count(s)
        p, got_ = min(1.0, c * s), sum(seen[i] for i, x in enumerate(sizes) if x == s) / (runs * n)
        assert abs(got_ - p) < 4 * (0.25 / (runs * n)) ** 0.5 + 0.03, (s, p, got_)


def test_language(docs, odd, none):
    got = langid.identify(docs).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    x = langid.identify(odd)
    assert x.columns == [c for c in odd.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    for r in x.collect():
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()} == {"und"}


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.score(docs, labels).join(labels, "doc_id").filter(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == bool(r.quality) for r in got]) > 0.85
    x = quality.score(odd, labels.limit(0)).collect()
    assert {r.score for r in x} == {0.5}
    own = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(3, None), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, own).collect())
    assert quality.score(none, labels).count() == 0


def test_interactions_are_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    p = {"w": rng.normal(size=quality.DIM), "v": rng.normal(size=(quality.DIM, quality.RANK)), "u": rng.normal(size=quality.STATS), "s": rng.normal(size=(quality.STATS, quality.RANK)), "b": 0.3, "scale": 1.0}
    word, share, stats = np.array([5, 9, 700]), np.array([0.5, 0.3, 0.2]), rng.normal(size=(1, quality.STATS))
    got, _ = quality.forward(p, np.zeros(3, int), word, share, stats)
    v = np.concatenate((p["v"][word] * share[:, None], p["s"] * stats[0][:, None]))
    want = 0.3 + p["w"][word] @ share + stats[0] @ p["u"] + sum(v[i] @ v[j] for i in range(len(v)) for j in range(i))
    assert got[0] == pytest.approx(want)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)


def nearest(rows, k):
    """Brute force; rows (id, vector)."""
    out = {}
    x = np.array([v for _, v in rows], float)
    for i, v in rows:
        if i % 20 == 0:
            s = [float((row * np.array(v, float)).sum()) for row in x]  # row by row, so that equal vectors have equal scores
            out.setdefault(i, sorted(((-t, j) for t, (j, _) in zip(s, rows) if j != i))[:k])
    return out


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(900, 16)).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(900)] + [(1000 + i, base[7].tolist()) for i in range(200)] + [(2000 + i, (base[i] * 3).tolist()) for i in range(50)]
    bad = [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [1.0] * 15), (None, [1.0] * 16), (5100, [float("inf")] * 16)]
    good = ann.usable(vectors(spark, rows + bad))
    assert good.count() == len(rows)
    queries = good.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = collections.defaultdict(list)
    for r in ann.search(queries, ann.shards(good, shard=300), block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = nearest(rows, ann.K)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.9
    for q in got:
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and q not in {v for v, _ in got[q]}


def test_search_of_few_and_none(spark):
    few = ann.usable(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])]))
    got = ann.search(few.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), ann.shards(few)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (1, 0.5)]
    none_ = ann.usable(vectors(spark, [(0, [0.0, 0.0])]))
    assert ann.search(none_.select(F.col("vec_id").alias("query_id"), "embedding"), ann.shards(none_)).count() == 0


def test_queries_that_repeat_an_id(spark):
    """Twins are each other's candidates: equal rows, and rows of one id with unlike vectors."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (3, [0.5, 0.5])]
    df = ann.usable(vectors(spark, rows))
    got = ann.search(df.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), ann.shards(df)).collect()
    first, other = [(1, 0, 1.0), (2, 3, 0.5), (3, 0, 0.0)], [(1, 3, 1.0), (2, 0, 0.0), (3, 0, 0.0)]
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == sorted(first + first + other)


def test_recall_over_a_whole_table(spark):
    """The registered query against brute force, with its production parameters."""
    where = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in ann.usable(spark.read.parquet(f"{where}/embeddings.parquet")).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = collections.defaultdict(set)
    for r in importlib.import_module("chronoloom.llm.queries").QUERIES["op2_hnsw_search"](spark, where).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        score = x @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[: ann.K]]
        hits, total = hits + len(got[int(ids[q])] & set(best.tolist())), total + len(best)
    assert len(got) == (ids % 20 == 0).sum() and hits / total > 0.97


def plain_recall(x, queries, found, k=20):
    score = queries @ x.T
    want = np.argsort(-score, 1)[:, :k]
    got = np.take_along_axis(found, np.argsort(-np.take_along_axis(score, found, 1), 1)[:, :k], 1)
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(got.tolist(), want.tolist(), strict=True)])


def test_walks_are_as_wide_as_recall_asks():
    """Vectors without any structure, a full shard of them: the hard case; a walk of the least width finds seven tenths."""
    x = np.random.default_rng(1).normal(size=(ann.SHARD, 64))
    graph = ann.Graph.build(ann.lifted(x, float(np.sqrt((x**2).sum(1).max()))))
    width = graph.calibrated(ann.K)
    q = x[::160]
    unit = np.concatenate((q / np.sqrt((q**2).sum(1, keepdims=True)), np.zeros((len(q), 1))), 1).astype(np.float32)
    found = np.concatenate([graph.nearest(unit[i : i + 64], width) for i in range(0, len(q), 64)])
    assert width > ann.SEARCH and plain_recall(x, q, found) >= 0.95


def test_recall_over_several_shards(spark):
    x = np.random.default_rng(2).normal(size=(12_000, 48)).astype(np.float32)
    df = ann.usable(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    index = ann.shards(df, shard=4000)
    assert index.count() == 3
    got = collections.defaultdict(set)
    queries = df.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for r in ann.search(queries, index).collect():
        got[r.query_id].add(r.vec_id)
    x = x.astype(float)
    hits = []
    for i in got:
        s = x @ x[i]
        s[i] = -np.inf
        hits.append(len(got[i] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(got) == 200 and np.mean(hits) >= 0.95


def test_hot_keys_are_attached_whole(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = left.filter("k is not null").groupBy("k").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    got = common.attach(left, right, "k", "n", 3000).collect()
    assert len(got) == 3000
    for r in got:
        assert r.first == (None if r.k is None else 0 if r.k == "hot" else r.id)


def test_ranks_follow_the_order(spark):
    df = spark.createDataFrame([(i % 3, i * 7 % 11) for i in range(50)], "g long, v long")
    whole = common.ranked(df, ["v", "g"], "t").orderBy("_rank").collect()
    assert [r._rank for r in whole] == list(range(50)) and [(r.v, r.g) for r in whole] == sorted((r.v, r.g) for r in whole)
    by = collections.defaultdict(list)
    for r in common.ranked(df, ["g", "v"], "t", within="g").collect():
        by[r.g].append((r._rank, r.v))
    for them in by.values():
        assert [r for r, _ in sorted(them)] == list(range(len(them))) and [v for _, v in sorted(them)] == sorted(v for _, v in them)


def test_pipeline_stages(spark, docs, odd, tmp_path):
    p = importlib.import_module("corpus_pipeline")
    for name, start in (("docs", docs), ("odd", odd.select(*docs.columns))):
        out = start
        for i, (stage, f) in enumerate(p.STAGES):
            out = f(spark, out, DATA)
            if i < len(p.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}-{stage}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{stage}"))
            assert out.count() > 0
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "docs-ngram_jaccard")).collect()}
    assert kept == {r[2] for r in brute.components(pairs(docs))}
    cut = spark.read.parquet(str(tmp_path / "docs-substring_dedup"))
    before = pairs(spark.read.parquet(str(tmp_path / "docs-ngram_jaccard")))
    left = sum(n - gone for _, n, gone, _ in brute.substring(before))
    assert sum(len(brute.words(t)) for _, t in pairs(cut)) == left
    copies = collections.Counter(r.doc_id for r in spark.read.parquet(str(tmp_path / "docs-mix_sources")).collect())
    assert max(copies.values()) <= 3


def test_pipeline_drops_near_copies_from_eight_tenths(spark):
    """A block added, or scattered edits, with a five-word Jaccard between 0.80 and what four words and 0.85 ask for."""
    p = importlib.import_module("corpus_pipeline")
    edited = passage(42, 300).split()
    for i in range(20, 290, 45):
        edited[i] = f"w{i}"
    rows = [(1, passage(41, 100)), (2, passage(41, 100) + " " + passage(43, 20)), (3, passage(42, 300)), (4, " ".join(edited)), (5, passage(44, 100)), (6, passage(44, 100) + " " + passage(45, 30)), (7, "a b c d"), (8, "a b c d"), (9, ""), (10, None)]
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA).repartition(3)
    kept = {r.doc_id for r in dict(p.STAGES)["ngram_jaccard"](spark, df, DATA).collect()}
    assert kept == {r[2] for r in brute.components(rows, 5, 80)} and 2 not in kept and 6 in kept
    assert 2 in {r[2] for r in brute.components(rows)}


def test_rare_languages_are_learned(spark):
    """A language with few documents among many, and one with long texts only, from a sample that is smaller than the table."""
    rng = random.Random(6)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, text("abcdefgh", 40), "en") for i in range(1500)] + [(2000 + i, text("pqrstuvw", 40), "xx") for i in range(8)] + [(3000 + i, text("ijklmno", 8000), "yy") for i in range(8)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), most=60).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)


def test_decisions_equal_plain_ones():
    """The language is that with the most duels won in the best family; margins settle ties."""
    rng = np.random.default_rng(3)
    names = ["de", "en", "es", "fr", "nl", "xx"]
    families = sorted({langid.FAMILY.get(n, n) for n in names})
    pairs_ = [(i, j) for i in range(6) for j in range(i + 1, 6) if langid.FAMILY.get(names[i], names[i]) == langid.FAMILY.get(names[j], names[j])]
    w, bias, x = rng.normal(size=(7, len(families) + len(pairs_))), rng.normal(size=len(families) + len(pairs_)), rng.normal(size=(300, 7))
    got, score = langid.decide({"names": names, "families": families, "pairs": pairs_, "w": w, "b": bias}, x)
    p = lambda m: 1 / (1 + np.exp(-2 * m))
    for i in range(300):
        m = [sum(x[i][k] * w[k][j] for k in range(7)) + bias[j] for j in range(w.shape[1])]
        best = max(range(len(families)), key=lambda f: m[f])
        inside = [n for n in names if langid.FAMILY.get(n, n) == families[best]]
        won, margin = collections.Counter(), collections.Counter()
        for (a, b), q in zip(pairs_, m[len(families) :]):
            won[names[a if p(q) > 0.5 else b]] += 1
            margin[names[a]] += p(q)
            margin[names[b]] += 1 - p(q)
        want = max(inside, key=lambda n: won[n] + margin[n] / 7)
        sure = p(m[best]) / sum(p(v) for v in m[: len(families)])
        assert got[i] == want and score[i] == pytest.approx(sure * (margin[want] / (len(inside) - 1) if len(inside) > 1 else 1))


def test_the_quality_query_equals_sums_over_pairs(spark):
    """Scores of the registered query against the model's formula, every pair of features added up."""
    import pickle

    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "n_chars")
    model = pickle.loads(quality.learn(d, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")))
    got = {r.doc_id: r for r in quality.op8_quality_classifier(spark, DATA).collect()}
    rows = d.collect()
    assert len(got) == len(rows)
    for r in rows[:25]:
        _, word, share, stats = quality.inputs([(r.text or "").encode()], [r.n_chars])
        z = np.clip((stats - model["mean"]) / model["dev"], -6, 6)[0]
        v = np.concatenate((model["scale"] * model["v"][word] * share[:, None], model["s"] * z[:, None]))
        both = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i))
        want = 1 / (1 + np.exp(-(model["b"] + model["scale"] * (model["w"][word] @ share) + z @ model["u"] + both)))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-6) and got[r.doc_id].predicted == int(got[r.doc_id].score >= quality.THRESHOLD)


def test_a_label_of_a_repeated_id_brings_no_more_rows(spark):
    rows = spark.createDataFrame([(1, passage(i, 20), 50) for i in range(500)] + [(3, "junk junk", 9)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.learn(rows, labels, most=40) is not None
    assert all(0 <= r.score <= 1 for r in quality.score(rows, labels, most=40).collect())


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that tells nothing but length apart, ids are still those of the tokenizer."""
    real = packing.word_hashes
    monkeypatch.setattr(packing, "word_hashes", lambda a: (np.zeros(len(real(a)[1]), np.uint64), *real(a)[1:]))
    e = packing.Encoder(*packing.vocabulary())
    texts = [b"the cat sat on the mat", b"internationalisation nternationalisationi", b"dog", b"cat dog", b"internationalisation abcdefghXbcdefghijkl"]
    for t in texts:
        assert e.encode([t]) == [e.whole(t)]
    assert e.encode(texts) == [e.whole(t) for t in texts]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    p = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    q = importlib.import_module("chronoloom.llm.queries")
    assert [k.split("_")[0] for k in q.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(q.ORACLES) <= set(q.QUERIES)
