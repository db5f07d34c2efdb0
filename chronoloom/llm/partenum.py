"""N-gram Jaccard join by PartEnum signatures.

The shingle domain is partitioned by hash into two parts, and a part again as long as it holds more of a set's shingles than `capacity`.  Of two parts of a partition one is in at
least the same proportion alike in both sets (differences over sizes, summed over the parts, cannot all be above the whole's), and two parts so alike with at most `capacity` shingles
are equal, as one difference would be too many: so enumerating the subsets that fill such parts gives every pair of similar sets a signature in common, and never one of an empty part.

Similar sets share more than one: those of their intersection's parts into which no difference falls.  Of the intersection's c shingles there are c / capacity parts at least and
c (1 / similarity - 1) differences at most, so a set may leave out one signature less than that difference, those of the fewest shingles first (both sets order them alike).

Signatures travel packed to buckets, with the sets' sizes; within a signature only sizes in one band (each at least `similarity` of the other) meet.  Members are compared with the one
of smallest doc_id; parities of the shingles in many parts of the domain (a bit each) differ in at most as many bits as the sets differ in shingles, an exact bound that drops nearly
all false candidates, and the rest is verified on the shingles.  Components follow; where a signature still holds members of several components, the
other pairs across components are compared by the same bound and verified too, in blocks.  Equal sets are one class throughout.

Defined results: a null or empty text, or one without words, has an empty set and is its own component; a shorter text than four words is one shingle; rows that repeat a doc_id
or a text are in one component if they have words; a null doc_id has no number of its own, and gets its component's smallest doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, batches_of, documents, lean, mix, partitions_for, salted, shingle_sets, stored, thinned, tidy
from .components import components
from .windows import pack, unpack

SHINGLE = 4
#: Similarity in hundredths, so that no bound is rounded.
SIMILARITY = 85
#: A sketch has at least so many bits, and a power of two of at least two for each shingle.
LEAST_BITS = 128
BLOCK = 1024
U = np.uint64


def capacity(share: int) -> int:
    """The most shingles that sets can hold for a similarity of `share` hundredths to make them equal."""
    if not 50 < share < 100:
        raise ValueError("similarity must be above 50 and below 100 hundredths")
    return (share - 1) // (100 - share)


def shared_at_least(sizes: np.ndarray, share: int) -> np.ndarray:
    """The fewest signatures that a set has in common with any set similar to it, by its size."""
    cap = capacity(share)
    return np.maximum(1, -(-sizes * (share - cap * (100 - share)) // (100 * cap)))


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bits that two words have in common (of their first 53)."""
    return 53 - np.frexp(((x ^ y) >> U(11)).astype(np.float64))[1]


def signatures(values: np.ndarray, at: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (distinct hashes, sorted within each; `at`: where sets begin), and each one's set.

    A part is a prefix of the hash.  A shingle's part is the first prefix that at most `capacity` of its set's shingles have: one bit longer than the longest that any
    capacity + 1 neighbours around it in order have in common.
    """
    cap, n = capacity(share), len(values)
    own = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    if not n:
        return np.zeros(0, U), own
    depth = np.zeros(n, np.int32)
    if n > cap:
        both = np.where(own[: n - cap] == own[cap:], _common(values[: n - cap], values[cap:]) + 1, 0)
        for j in range(cap + 1):
            np.maximum(depth[j : j + n - cap], both, out=depth[j : j + n - cap])
    new = np.ones(n, bool)
    new[1:] = (own[1:] != own[:-1]) | (depth[1:] != depth[:-1]) | (_common(values[1:], values[:-1]) < depth[1:])
    first = np.flatnonzero(new)
    size, own = np.diff(np.append(first, n)), own[first]
    sig = mix(np.add.reduceat(mix(values + U(0x5851F42D4C957F2D)), first) ^ mix(depth[first].astype(U)))
    order = np.lexsort((sig, size, own))
    sig, own = sig[order], own[order]
    place = np.arange(len(sig)) - np.searchsorted(own, own)
    keep = place >= shared_at_least(np.diff(at), share)[own] - 1
    return sig[keep], own[keep]


def _key(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def described(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, tag, n_shingles, key (64 bits of a digest of the set; null if empty)."""

    def run(batches):
        for b in batches:
            for a, z in batches_of(b.column(1)):
                v, at = shingle_sets([t or b"" for t in b.column(1).slice(a, z - a).to_pylist()], n)
                keys = [_key(v[x:y]) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), b.column(2).slice(a, z - a), pa.array(np.diff(at).astype(np.int64)), pa.array(keys, pa.int64())], names=["doc_id", "tag", "n_shingles", "key"]
                )
                del v, at, keys
                tidy()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tag"))
    return rows.mapInArrow(run, "doc_id bigint, tag bigint, n_shingles bigint, key bigint")


def sketch(values: np.ndarray) -> bytes:
    """Parities of the set's shingles in 2**m parts of the domain."""
    bits = max(LEAST_BITS, 1 << int(2 * len(values) - 1).bit_length())
    part = (mix(values ^ U(0xA5A5A5A5A5A5A5A5)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(part, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(blobs: list[bytes]) -> np.ndarray:
    """Sketches of one length: longer ones are folded by exclusive or, which parities allow."""
    size = min(map(len, blobs))
    out = np.empty((len(blobs), size // 8), U)
    for i, x in enumerate(blobs):
        x = np.frombuffer(x, U)
        while len(x) * 8 > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number of shingles in which sets with these sketches differ."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def dealt(docs: DataFrame, buckets: int, share: int, n: int, sign: Callable) -> DataFrame:
    """Signatures, packed by bucket."""

    def run(batches):
        for b in batches:
            for a, z in batches_of(b.column(1)):
                ids = b.column(0).slice(a, z - a).to_pylist()
                v, at = shingle_sets([t or b"" for t in b.column(1).slice(a, z - a).to_pylist()], n)
                seen: dict[int, int] = {}
                chosen, keys, docs_ = [], [], []
                for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if y == x:
                        continue
                    key = _key(v[x:y])
                    d = ids[i] if ids[i] is not None else (1 << 63) - 1
                    if key in seen:  # a copy in this batch: its signatures are there already
                        docs_[seen[key]] = min(docs_[seen[key]], d)
                        continue
                    seen[key] = len(keys)
                    chosen.append(i)
                    keys.append(key)
                    docs_.append(d)
                if not keys:
                    continue
                if len(chosen) < len(ids):
                    v = np.concatenate([v[at[i] : at[i + 1]] for i in chosen])
                    at = np.concatenate(([0], np.cumsum(np.diff(at)[chosen])))
                sig, own = sign(v, at, share)
                keys, docs_, sizes = np.array(keys, np.int64), np.array(docs_, np.int64), np.diff(at).astype(np.uint32)
                bucket = (sig % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    o = order[bounds[k] : bounds[k + 1]]
                    who, index = np.unique(own[o], return_inverse=True)
                    h = sig[o] >> U(24)
                    rows.append((k, pack([(h >> U(8)).astype(np.uint32), (h & U(255)).astype(np.uint8), index.astype(np.uint16 if len(who) < 65536 else np.uint32), keys[who], docs_[who], sizes[who]])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["bucket", "packed"])
                del v, at, sig, own, keys, docs_, bucket, order, rows, cols
                tidy()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, packed binary")


def _grouped(table: pa.Table, share: int) -> pa.Table:
    """A bucket -> candidates (0, pivot, member) whose sizes allow it, and the members but the pivot of signatures with three or more (1, group, member) that some other's size allows."""
    sig, key, doc, n = [], [], [], []
    for blob in table.column("packed").to_pylist():
        hi, lo, index, keys, docs, sizes = unpack(blob)
        sig.append((hi.astype(U) << U(8)) | lo.astype(U))
        key.append(keys[index])
        doc.append(docs[index])
        n.append(sizes[index])
    sig = np.concatenate(sig)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    again = sig[1:] == sig[:-1]
    alone = ~(np.concatenate((again, [False])) | np.concatenate(([False], again)))
    order, sig = order[~alone], sig[~alone]  # most signatures are one set's alone
    key, doc, n = (np.concatenate(x)[order] for x in (key, doc, n))
    order = np.lexsort((doc, key, sig))
    sig, key, doc, n = sig[order], key[order], doc[order], n[order].astype(np.int64)
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])  # the smallest doc_id of each class
    sig, key, doc, n = sig[keep], key[keep], doc[keep], n[keep]
    order = np.lexsort((key, doc, sig))
    sig, key, n = sig[order], key[order], n[order]
    if not len(key):
        return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    first = np.concatenate(([True], sig[1:] != sig[:-1]))
    at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    near = ~first & (100 * np.minimum(n, n[at]) >= share * np.maximum(n, n[at]))
    pairs = np.unique(np.stack([key[at[near]], key[near]], 1), axis=0)
    sig, key, n = sig[~first], key[~first], n[~first]
    order = np.lexsort((key, n, sig))
    sig, key, n = sig[order], key[order], n[order]
    band = (sig[1:] == sig[:-1]) & (100 * n[:-1] >= share * n[1:])  # in one band with the next larger
    start = np.flatnonzero(np.concatenate(([True], ~band))) if len(key) else np.zeros(0, np.int64)
    members = np.zeros((0, 2), np.int64)
    if len(start):
        # Runs of sizes in which each is in one band with the next; runs with the same members are one group, whose number is the sum of their images.
        size = np.diff(np.append(start, len(key)))
        number = np.add.reduceat(mix(key.astype(U)), start).astype(np.int64)
        big = np.repeat(size >= 2, size)
        members = np.unique(np.stack([np.repeat(number, size)[big], key[big]], 1), axis=0)
    both = np.concatenate((pairs, members))
    return pa.table({"kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(pairs), len(members)])), "a": pa.array(np.ascontiguousarray(both[:, 0])), "b": pa.array(np.ascontiguousarray(both[:, 1]))})


def representatives(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """key, text of one document of each class in keys(key).  Few other texts travel: a bitmap of the ids thins them out first."""
    reps = stored(classes.join(keys, "key", "left_semi").select("key", F.col("rep").alias("doc_id"), F.col("tag").alias("tag")), "representatives")
    at = F.xxhash64("doc_id", "tag")  # joined and deduplicated by this, so that texts are shuffled once
    rows = thinned(docs.withColumn("tag", F.xxhash64("text")), reps, ["doc_id", "tag"]).withColumn("_at", at).withColumnRenamed("doc_id", "_doc").withColumnRenamed("tag", "_tag")
    same = (F.col("at") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    found = rows.join(reps.withColumn("at", at), same).select("_at", "key", F.col("text").cast("binary").alias("text"))
    return found.dropDuplicates(["_at", "key"]).select("key", "text")


def sketches(texts: DataFrame, n: int) -> DataFrame:
    """key, n_shingles, sketch of classes' texts."""

    def run(batches):
        for b in batches:
            for a, z in batches_of(b.column(1)):
                v, at = shingle_sets(b.column(1).slice(a, z - a).to_pylist(), n)
                done = [sketch(v[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.diff(at).astype(np.int64)), pa.array(done, pa.binary())], names=["key", "n_shingles", "sketch"])
                tidy()

    return texts.mapInArrow(run, "key bigint, n_shingles bigint, sketch binary")


def possible(pairs: DataFrame, drawn: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule them out."""

    def test(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, n, m in frames:
            least = np.fromiter((int(bound(*folded([p, q]))) for p, q in zip(x, y, strict=True)), np.int64, len(x))
            yield pd.Series(least * (100 + share) <= (100 - share) * (n + m).to_numpy())

    left, right = (drawn.select(F.col("key").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}")) for c in "ab")
    return salted(salted(pairs, left, "a"), right, "b").filter(F.pandas_udf(test, "boolean")("sa", "sb", "na", "nb")).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, share: int, n: int) -> DataFrame:
    """Pairs (a, b) of classes whose shingle sets are similar, from texts(key, text), of which few others travel: a bitmap of the pairs' keys thins them out first."""
    texts = thinned(texts, stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "paired"), ["key"])
    left, right = (texts.select(F.col("key").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")

    def run(batches):
        for b in batches:
            for u, z in batches_of(b.column(2), 1 << 20):
                pa_, pb, x, y = (b.column(i).slice(u, z - u).to_pylist() for i in range(4))
                texts_ = [*x, *y]
                index = {t: i for i, t in enumerate(dict.fromkeys(texts_))}
                v, at = shingle_sets(list(index), n)
                ok = []
                for p, q in zip(x, y, strict=True):
                    i, j = index[p], index[q]
                    s, t = v[at[i] : at[i + 1]], v[at[j] : at[j + 1]]
                    both = np.intersect1d(s, t, assume_unique=True).size
                    ok.append(100 * both >= share * (len(s) + len(t) - both))
                keep = np.flatnonzero(ok).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([pa_[i] for i in keep], pa.int64()), pa.array([pb[i] for i in keep], pa.int64())], names=["a", "b"])

    joined = salted(salted(pairs, left, "a"), right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def across(members: DataFrame, labels: DataFrame, drawn: DataFrame, share: int) -> DataFrame:
    """Pairs of members of one group but of different components that their sketches don't rule out; large groups are compared block by block."""
    rows = members.join(labels, "b")
    mixed = rows.groupBy("a").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("_n")).filter("r <> s").drop("r", "s")
    mixed = stored(mixed.withColumn("blocks", F.ceil(F.col("_n") / BLOCK).cast("int")), "mixed")
    rows = rows.join(mixed, "a").join(drawn.select(F.col("key").alias("b"), "sketch", "n_shingles"), "b").withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("a", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "b", "root", "sketch", "n_shingles")
    copies = mixed.agg(F.sum(F.col("_n") * F.col("blocks"))).first()[0] or 0  # one number
    rows = rows.repartition(partitions_for(rows.sparkSession, copies, 40_000), "a", "x", "y")

    def compare(t: pa.Table) -> pa.Table:
        key, root, n, own = (t.column(c).to_numpy() for c in ("b", "root", "n_shingles", "own"))
        sketches_ = t.column("sketch").to_pylist()
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        order = np.argsort(n, kind="stable")
        key, root, n, own = key[order], root[order], n[order], own[order]
        sketches_ = [sketches_[i] for i in order.tolist()]
        stops = np.searchsorted(n, n * 100 // share, side="right")
        level = np.array([len(b) for b in sketches_])  # grows with n
        out = []
        # Sketches are folded to the length of the smaller set's, not to the block's least: shorter ones tell large sets apart no more.
        for first, last in zip(*(np.searchsorted(level, np.unique(level), side=e).tolist() for e in ("left", "right")), strict=True):
            s = folded(sketches_[first : stops[last - 1]])
            for i in range(first, last):
                j = np.arange(i + 1, stops[i])
                j = j[(root[j] != root[i]) & ((own[j] != own[i]) | (x == y))]
                if len(j):
                    j = j[bound(s[j - first], s[i - first]) * (100 + share) <= (100 - share) * (n[j] + n[i])]
                    out.append(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])], 1))
        both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(np.ascontiguousarray(both[:, 0])), "b": pa.array(np.ascontiguousarray(both[:, 1]))})

    return rows.groupBy("a", "x", "y").applyInArrow(compare, "a bigint, b bigint").distinct()


def groups(docs: DataFrame, share: int = SIMILARITY, n: int = SHINGLE, sign: Callable = signatures) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, component_id, first (whether it is the row to keep of its component) of every row of docs(doc_id, text, ...); `sign` gives the signatures by which sets meet."""
    spark = docs.sparkSession
    lean(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = stored(described(docs, n), "sets")
    classes = stored(sets.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("f"), F.count("*").alias("_n")).withColumn("tag", F.col("f.tag")).drop("f"), "classes")
    volume = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = partitions_for(spark, volume * 0.35, 700_000)
    grouped = stored(dealt(docs, buckets, share, n, sign).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _grouped(t, share), "kind int, a bigint, b bigint"), "signatures")
    members = grouped.filter("kind = 1").select("a", "b").distinct()
    met = grouped.filter("kind = 0").select(F.col("a").alias("key")).union(grouped.select("b").filter("b is not null")).distinct()
    texts = stored(representatives(docs, classes, met), "texts")
    drawn = stored(sketches(texts, n), "sketches")
    pairs = stored(possible(grouped.filter("kind = 0").select("a", "b").distinct(), drawn, share), "candidates")
    links = stored(verified(pairs, texts, share, n), "links")
    found = stored(components(links.toDF("u", "v")), "components")
    labels = met.select(F.col("key").alias("b")).join(found.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    # What the first members' comparisons have not joined: other pairs of one signature, those refused above left out.
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(across(members, stored(labels, "labels"), drawn, share).join(tried, ["a", "b"], "left_anti"), "further-candidates")
    if more.limit(1).count():
        links = stored(links.union(verified(more, texts, share, n)), "all-links")
        found = stored(components(links.toDF("u", "v")), "all-components")
    named = classes.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = stored(named.select("key", "rep", "tag", "_n", "root"), "named")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "tag")).alias("f"), F.count("*").alias("_m"))
    smallest = smallest.select("root", "component_id", F.col("f.rep").alias("first_id"), F.col("f.tag").alias("first_tag"), "_m")
    named = attach(named.drop("rep", "tag"), stored(smallest, "smallest"), "root", "_m", named.count()).select("key", "component_id", "first_id", "first_tag", "_n")
    out = attach(sets.select("doc_id", "tag", "n_shingles", "key"), stored(named, "named-classes"), "key", "_n", sets.count())
    first = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tag") == F.col("first_tag")))
    return out.select("doc_id", "tag", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), first.alias("first"))


def kept(docs: DataFrame, share: int = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """The rows of docs of which one stays in each component: the smallest doc_id (then the least hash of its text; of rows equal in both, one)."""
    names = docs.columns
    found = stored(groups(docs, share, n), "groups")
    gone = stored(found.filter(~F.col("first")).select(F.col("doc_id").alias("__cl_d"), F.col("tag").alias("__cl_t")).distinct(), "gone")
    tag = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumn("__cl_d", F.col("doc_id").cast("bigint")).withColumn("__cl_t", tag)
    marked = thinned(rows, gone, ["__cl_d", "__cl_t"], mark="__cl_maybe")
    gone = gone.withColumnRenamed("__cl_d", "__cl_gd").withColumnRenamed("__cl_t", "__cl_gt")
    left = marked.filter("__cl_maybe").join(gone, F.col("__cl_d").eqNullSafe(F.col("__cl_gd")) & (F.col("__cl_t") == F.col("__cl_gt")), "left_anti")
    rows = marked.filter("not __cl_maybe").unionByName(left)
    # Repeated rows: few ids have more than one row left, and only those are looked at again.
    twice = stored(found.filter("first and n_shingles > 0").groupBy("doc_id", "tag").count().filter("count > 1").select(F.col("doc_id").alias("__cl_gd"), F.col("tag").alias("__cl_gt")), "repeated")
    if twice.limit(1).count():
        same = F.col("__cl_d").eqNullSafe(F.col("__cl_gd")) & (F.col("__cl_t") == F.col("__cl_gt"))
        rows = rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["__cl_d", "__cl_t"]))
    return rows.select(*names)




def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, md5_number(array_to_string(w[i:i + 3], ' ')) AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY 1),
often AS (SELECT s FROM sh GROUP BY 1 HAVING count(*) > 1),
few AS (SELECT r, s FROM sh SEMI JOIN often USING (s)),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS m FROM few a JOIN few b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * m >= 85 * (p.n + q.n - m)),
both_ AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(r, o) AS (SELECT r, r FROM n UNION SELECT reach.r, y FROM reach JOIN both_ ON x = o)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (r) LEFT JOIN (SELECT reach.r, min(d.doc_id) AS c FROM reach JOIN w d ON d.r = o GROUP BY 1) m USING (r)
"""
