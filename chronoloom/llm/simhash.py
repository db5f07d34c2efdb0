"""SimHash near duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits (the last one filled up with zeros).  The perfect binary Golay code of length 23 decodes any segment to the one
codeword within three bits; the codewords of a segment and of all its neighbours at one bit are one or six, and two segments that differ in at most two bits have one of them in common (that of
a word between them).  Errors are dealt to segments by pigeonhole.  Of at most four differing bits

* either none falls into some segment, and at most two fall into one of the other two: the key is the equal segment and a codeword of that other one;
* or each segment has one, and at most one segment has two: the key is a codeword of that segment and an equal half of each of the others, in which one bit differs at most.

So a fingerprint has at most 36 + 72 keys of 30 to 35 bits, and similar fingerprints share one.  Keys are rows that Spark shuffles and sorts; a task streams over them and holds the members of one key at most.
A key's fingerprints are compared by their bits, and only a spanning forest of a key's links leaves the task, never all its pairs.  A key with over CROWD members is not compared there:
its members are dealt again by pairs of six interleaved parts of the fingerprint (two of the six are equal where four bits differ), and what is still crowded is compared in pairs of blocks over many
tasks.  Equal fingerprints are one node throughout.  Components follow.

Defined results: a null or empty text, or one without words, has the fingerprint zero and links like any other; a text of fewer words than a shingle is one shingle; a bit set in exactly
half of the hashes is 0; rows that repeat a doc_id are rows of their own; a null doc_id has no number: its row gets its component's smallest doc_id (null where there is none); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, batches_of, documents, lean, lower_ascii, partitions_for, stored, tidy, word_bounds
from .components import components

SHINGLE = 4
SEED = 42
DIFFER = 4
#: First bit and length of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The most members of a key that are compared in the task that meets it, and the side of a block beyond.
CROWD = 2048
PARTS = 6
U = np.uint64

# Fixed value: a generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where((words >> bit) & 1, GENERATOR << (bit - 11), 0)
    return words


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11, and the error of at most three bits of each syndrome."""
    low, high = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)
    errors = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    of = np.zeros(1 << 11, np.int64)
    of[_remainder(np.array(errors))] = errors
    return low, high, of


LOW, HIGH, ERROR = _tables()


def decoded(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    return (words ^ ERROR[LOW[words & 4095] ^ HIGH[words >> 12]]) >> 11


def near_codewords(words: np.ndarray, bits: int) -> np.ndarray:
    """The indices of the codewords of each word and of its neighbours in the first `bits` bits: up to six, -1 filled."""
    flips = np.concatenate(([0], 1 << np.arange(bits)))
    all_ = np.sort(decoded(words[:, None] ^ flips), 1)
    new = np.ones(all_.shape, bool)
    new[:, 1:] = all_[:, 1:] != all_[:, :-1]
    out = np.full((len(words), 6), -1, np.int64)
    r, c = np.nonzero(new)
    out[r, (np.cumsum(new, 1) - 1)[r, c]] = all_[r, c]
    return out


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64), and each key's fingerprint by place."""
    seg = [((prints >> U(a)) & U((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [near_codewords(s, n) for s, (_, n) in zip(seg, SEGMENTS, strict=True)]
    half = [[s & ((1 << n // 2) - 1), s >> n // 2] for s, (_, n) in zip(seg, SEGMENTS, strict=True)]
    keys, kind = [], 0
    for x in range(3):
        for y in range(3):
            if x != y:  # x is equal
                keys.append(np.where(near[y] < 0, -1, (kind << 36) | (seg[x][:, None] << 12) | near[y]))
                kind += 1
        y, z = (i for i in range(3) if i != x)
        for i in range(2):
            for j in range(2):  # x has the two bits
                keys.append(np.where(near[x] < 0, -1, (kind << 36) | (half[y][i][:, None] << 24) | (half[z][j][:, None] << 12) | near[x]))
                kind += 1
    keys = np.concatenate(keys, 1)
    own, at = np.nonzero(keys >= 0)
    return keys[own, at], own


def finer(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of crowded keys' members: a key for every two of six interleaved parts, by the numbers of (key, parts, values)."""
    from .common import mix

    parts = []
    for i in range(PARTS):
        bits = np.arange(i, 64, PARTS, dtype=U)
        v = np.zeros(len(prints), U)
        for at, b in enumerate(bits.tolist()):
            v |= ((prints >> U(b)) & U(1)) << U(at)
        parts.append(v)
    out = []
    base = mix(keys.astype(U) + U(0x632BE59BD9B4E019))
    for i in range(PARTS):
        for j in range(i):
            out.append(mix(base ^ mix((parts[i] << U(11) | parts[j]) * U(64) + U(8 * i + j))) | U(1 << 63))
    return np.stack(out, 1).ravel().astype(np.int64), np.repeat(np.arange(len(prints)), len(out))


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) of every row of docs(doc_id, text, ...)."""

    def run(batches):
        for b in batches:
            for a, z in batches_of(b.column(1)):
                texts = [t or b"" for t in b.column(1).slice(a, z - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(_prints(texts, n, seed).view(np.int64))], names=["doc_id", "fp"])
                del texts
                tidy()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _prints(texts: list[bytes], n: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    a = lower_ascii(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    s, e = word_bounds(a)
    # Words side by side with one blank after each, whatever was between them.
    step = np.zeros(len(a) + 1, np.int8)
    step[s] = 1
    step[e + 1] -= 1
    a[e] = 32
    joined = a[np.cumsum(step[:-1], dtype=np.int8) > 0].tobytes()
    first = np.searchsorted(s, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    count = np.diff(first)
    end = np.cumsum(e - s + 1) - 1
    start = end - (e - s)
    shingles = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), shingles)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(at + n, first[owner + 1]) - 1
    bits = np.zeros((len(texts), 64), np.int64)
    for x in range(0, len(owner), 1 << 16):
        y = min(x + (1 << 16), len(owner))
        h = np.fromiter(map(xxh64_intdigest, [joined[i:j] for i, j in zip(start[at[x:y]].tolist(), end[last[x:y]].tolist(), strict=True)], repeat(seed)), U, y - x)
        runs = np.flatnonzero(np.concatenate(([True], owner[x + 1 : y] != owner[x : y - 1])))
        bits[owner[x + runs]] += np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), runs, axis=0, dtype=np.int64)
    return np.packbits(2 * bits > shingles[:, None], axis=1, bitorder="little").view(U).ravel()


def crowded(prints: DataFrame, sample: int = 20_000, least: int = 20) -> np.ndarray:
    """Keys that `least` of about `sample` fingerprints share (those with the smallest hashes): at most 108 * sample / least.  They are dealt finely at once; what is found is the same without."""
    total = prints.count()
    share = min(1.0, sample / max(total, 1))
    some = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(b.column(0).to_numpy().view(U))[0])], names=["key"])

    often = some.mapInArrow(count, "key bigint").groupBy("key").count().filter(F.col("count") >= max(least, CROWD * share)).select("key")
    return np.sort(often.toPandas()["key"].to_numpy(np.int64))


def keyed(prints: DataFrame, hot: np.ndarray) -> DataFrame:
    """prints(fp) -> key, fp: a row for each key; members of hot keys by finer ones."""
    shared = prints.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        many = shared.value
        for b in batches:
            fps = b.column(0).to_numpy().view(U)
            for x in range(0, len(fps), 4096):
                p = fps[x : x + 4096]
                key, own = keys_of(p)
                p = p[own]
                if len(many):
                    at = np.minimum(np.searchsorted(many, key), len(many) - 1)
                    crowd = many[at] == key
                    if crowd.any():
                        k, i = finer(key[crowd], p[crowd])
                        key, p = np.concatenate((key[~crowd], k)), np.concatenate((p[~crowd], p[crowd][i]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(p.view(np.int64))], names=["key", "fp"])

    return prints.mapInArrow(run, "key bigint, fp bigint")


def forest(p: np.ndarray, differ: int = DIFFER) -> np.ndarray:
    """Links that join what is similar among distinct fingerprints, as few as do (places, two a row)."""
    out = []
    left = np.arange(len(p))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            new, keep = [], np.ones(len(left), bool)
            for f in range(0, len(front), 256):
                rest = np.flatnonzero(keep)
                near = np.bitwise_count(p[front[f : f + 256], None] ^ p[left[rest]]) <= differ
                hit = near.any(0)
                out.append(np.stack([front[f + near.argmax(0)[hit]], left[rest[hit]]], 1))
                new.append(left[rest[hit]])
                keep[rest[hit]] = False
            left, front = left[keep], np.concatenate(new)
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _linked(key: np.ndarray, p: np.ndarray, differ: int) -> np.ndarray:
    """Links of whole keys (sorted): all of small ones, a forest of larger ones."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    out = []
    for n in range(2, 6):
        at = start[size == n]
        for i in range(n):
            for j in range(i):
                x, y = p[at + i], p[at + j]
                ok = np.bitwise_count(x ^ y) <= differ
                out.append(np.stack([x[ok], y[ok]], 1))
    for a, n in zip(start[size > 5].tolist(), size[size > 5].tolist(), strict=True):
        mine = p[a : a + n]
        out.append(mine[forest(mine, differ)])
    both = np.concatenate(out).view(np.int64).reshape(-1, 2) if out else np.zeros((0, 2), np.int64)
    return np.unique(np.stack([both.min(1), both.max(1)], 1), axis=0) if len(both) else both


def met(rows: DataFrame, differ: int = DIFFER, crowd: int = CROWD) -> DataFrame:
    """rows(key, fp), sorted by key in each partition -> kind, a, b: links (0, fp, fp), and the members of keys with over `crowd` (1, key, fp)."""

    def batch(kind: int, a: np.ndarray, b: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["kind", "a", "b"])

    def run(batches):
        key, p, over = np.zeros(0, np.int64), np.zeros(0, U), None  # over: the key that is being passed on
        for b in batches:
            key = np.concatenate((key, b.column(0).to_numpy()))
            p = np.concatenate((p, b.column(1).to_numpy().view(U)))
            if over is not None:
                n = np.searchsorted(key, over, side="right")
                yield batch(1, key[:n], p[:n].view(np.int64))
                key, p = key[n:], p[n:]
            if not len(key):
                continue
            over = None
            done = np.searchsorted(key, key[-1])  # the last key may go on
            if len(key) - done > crowd:
                over = key[-1]
                yield batch(1, key[done:], p[done:].view(np.int64))
                rest = (key[:0], p[:0])
            else:
                rest = (key[done:], p[done:])
            yield from finished(key[:done], p[:done])
            key, p = rest
        yield from finished(key, p)

    def finished(key, p):
        if len(key):
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key))))
            many = size > crowd
            if many.any():
                yield batch(1, key[many], p[many].view(np.int64))
            some = (size > 1) & ~many
            links = _linked(key[some], p[some], differ) if some.any() else np.zeros((0, 2), np.int64)
            if len(links):
                yield batch(0, links[:, 0], links[:, 1])

    return rows.mapInArrow(run, "kind int, a bigint, b bigint")


def in_blocks(members: DataFrame, differ: int = DIFFER, block: int = CROWD) -> DataFrame:
    """Links (a, b) among the members(key, fp) of crowded keys: pairs of blocks of a key are compared, each pair in a group of its own."""
    sizes = stored(members.groupBy("key").agg(F.count("*").alias("n")), "crowded-keys")
    total = members.count()
    dealt = attach(members, sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "key", "n", total)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")

    def compare(t: pa.Table) -> pa.Table:
        p = np.unique(t.column("fp").to_numpy()).view(U)
        links = p[forest(p, differ)].view(np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(links.min(1)), "b": pa.array(links.max(1))})

    return rows.repartition(partitions_for(rows.sparkSession, rows.count(), 200_000), "key", "x", "y").groupBy("key", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def links_of(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """prints(fp), distinct -> a, b: links by which similar fingerprints are connected."""
    spark = prints.sparkSession
    parts = partitions_for(spark, prints.count() * 100.0, 2_000_000)

    def once(rows: DataFrame) -> DataFrame:
        return stored(met(rows.repartition(parts, "key").sortWithinPartitions("key"), crowd=crowd), "met")

    def again(batches):
        for b in batches:
            k, i = finer(b.column(0).to_numpy(), b.column(1).to_numpy().view(U))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b.column(1).to_numpy()[i])], names=["key", "fp"])

    found = once(keyed(prints, crowded(prints)))
    links = found.filter("kind = 0").select("a", "b")
    # Coarse keys that turned out crowded are dealt finely; fine ones (negative) in blocks.
    coarse = found.filter("kind = 1 and a >= 0").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    fine = found.filter("kind = 1 and a < 0").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if coarse.limit(1).count():
        more = once(coarse.mapInArrow(again, "key bigint, fp bigint"))
        links = links.union(more.filter("kind = 0").select("a", "b"))
        fine = fine.union(more.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp")))
    if fine.limit(1).count():
        links = links.union(in_blocks(fine, block=crowd))
    return links.distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of every row of docs(doc_id, text, ...)."""
    lean(docs.sparkSession)
    rows = stored(fingerprints(docs, n), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")), "classes")
    found = stored(components(links_of(classes.select("fp"), crowd).toDF("u", "v")), "components")
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "named")
    least = stored(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("_m")), "least")
    named = attach(named.select("fp", "root", "_n"), least, "root", "_m", named.count()).select("fp", "component_id", "_n")
    return attach(rows, stored(named, "named-classes"), "fp", "_n", rows.count()).select("doc_id", "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", digits.alias("fingerprint"), "component_id")


SQL = None
