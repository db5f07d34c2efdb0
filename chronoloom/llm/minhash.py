"""Document fingerprints: MinHash with multiply-shift permutations over word shingles.

A signature is the least image of the text's hashed five-word shingles under each of PERMUTATIONS hash functions h -> (a h + b) mod 2**64 with odd a (high bits
of such functions are universal).  Of each least image 16 bits are printed, after a bijection has spread all of its bits (the high bits of a least image alone say how long the text is).

`near_duplicates` joins documents on bands of the signature and verifies Jaccard similarity on the shingles themselves: the members of a band meet in one bucket, each is compared with
the first, and what that leaves between components is compared in blocks (partenum.groups).  The query reports how alike a document is to an edited copy and to its neighbour, and
the group of near duplicates that it is in.

Defined results: words are lower-cased in ASCII; a null text is an empty one; a text of fewer than five words has its whole sequence as one shingle; a text
without words has the fingerprint of the empty set, which is like only itself, and is a group of its own; rows that repeat a doc_id are ordered by a hash of their text; a null doc_id is
the last; an empty table gives an empty result; other columns are ignored.
"""

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, documents, grams, groups_of, lean, lower_ascii, mix, partitions_for, prefix, slices, stored, word_hashes
from .partenum import groups
from .substring import NULL_ID

PERMUTATIONS = 128
BANDS = 32  # of four values each: pairs of similarity 0.8 are missed with probability (1 - 0.8**4)**32 < 1e-7
SHINGLE = 5
SIMILARITY = 80  # hundredths
U = np.uint64
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=U)) | U(1)
_B = mix(np.arange(1, PERMUTATIONS + 1, dtype=U) + U(1 << 32))


def signatures(texts: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """64-bit signature rows of texts; all ones for a text without words."""
    out = np.full((len(texts), PERMUTATIONS), ~U(0))
    for a, b in groups_of(texts, 1 << 18):  # small enough for a processor's cache
        _sign(texts[a:b], n, out[a:b])
    return out


def _sign(texts: list[bytes], n: int, out: np.ndarray) -> None:
    joined = lower_ascii(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    w, s, _ = word_hashes(joined)
    first = np.searchsorted(s, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    count = np.diff(first)
    g = grams(w, n)
    short = np.flatnonzero((count > 0) & (count < n))
    g = np.concatenate((g, slices(prefix(w), first[short], first[short + 1]) ^ mix(count[short].astype(U))))
    long = np.flatnonzero(count >= n)
    if len(long):
        # Each long text's shingles, then a stop, which reduceat's odd slots throw away.
        edges = np.empty(2 * len(long), np.int64)
        edges[::2], edges[1::2] = first[long], first[long + 1] - n + 1
        m = int(edges[-1])
        h = g[: m + 1] if len(g) > m else np.append(g, U(0))
        t = np.empty(m + 1, U)
        for p in range(PERMUTATIONS):
            np.multiply(h[: m + 1], _A[p], out=t)
            t += _B[p]
            out[long, p] = np.minimum.reduceat(t, edges)[::2]
    if len(short):
        out[short] = g[len(g) - len(short) :, None] * _A + _B


def printed(sig: np.ndarray) -> list[str]:
    low = (mix(sig) & U(0xFFFF)).astype(">u2")
    return [base64.b64encode(r.tobytes()).decode() for r in low]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal 16-bit values, less the share expected of unlike ones."""
    same = ((mix(a) ^ mix(b)) & U(0xFFFF) == 0).mean(-1)
    return np.clip((same - 2.0**-16) / (1 - 2.0**-16), 0.0, 1.0)


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint."""

    def sign(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in text:
            yield pd.Series(printed(signatures([x or b"" for x in t], n)), dtype=object)

    return docs.select("doc_id", F.pandas_udf(sign, "string")(F.col("text").cast("binary")).alias("fingerprint"))


REPORT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, group_id bigint"


def _order(ids, tags) -> np.ndarray:
    """Descending doc_id, then ascending tag, as bytes that sort so."""
    ids, tags = np.asarray(ids, np.int64), np.asarray(tags, np.int64)
    out = np.empty((len(ids), 16), np.uint8)
    out[:, :8] = (~(ids.astype(U) ^ U(1 << 63))).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = (tags.astype(U) ^ U(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S16").ravel()


def edited_report(docs: DataFrame, bucket_bytes: float = 64e6) -> DataFrame:
    """Each document against itself with its end replaced by the next one's beginning, and against the next one, and its group of near duplicates.

    Texts are dealt once, by ranges of doc_id and tag, so rows without an id spread too; the first document of each range (one row a range) is added to the range before it.
    Groups travel as small rows that come just before the text that they tell of.
    """
    spark = docs.sparkSession
    lean(spark)
    found = near_duplicates(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "tag", "component_id").distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    total, volume = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = partitions_for(spark, volume or 0, bucket_bytes)
    # About a hundred rows a range, by hash, give the bounds.
    some = rows.select("doc_id", "tag").filter(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 100 * ranges / max(total, 1)))).toPandas()
    keys = np.sort(_order(some["doc_id"], some["tag"]))
    bounds = np.unique(keys[len(keys) * np.arange(1, ranges) // ranges]) if len(keys) else keys

    def place(ids: pd.Series, tags: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _order(ids, tags), side="right").astype(np.int32))

    part = F.pandas_udf(place, "int")("doc_id", "tag")  # 0 has the largest ids
    rows, found = rows.withColumn("part", part), found.withColumn("part", part)
    firsts = rows.groupBy("part").agg(F.max(F.struct("doc_id", F.bitwise_not("tag"))).alias("f")).collect()  # one row a range
    order = sorted((r["part"], r["f"][0], ~r["f"][1]) for r in firsts)
    if not order:
        return spark.createDataFrame([], REPORT)
    added = [(*first[1:], before[0]) for before, first in zip(order, [*order[1:], order[0]], strict=True)]
    ghosts = spark.createDataFrame(added, "g_id bigint, g_tag bigint, g_part int")
    more = rows.join(F.broadcast(ghosts), (F.col("doc_id") == F.col("g_id")) & (F.col("tag") == F.col("g_tag")))
    none = F.lit(None).cast("bigint")
    both = rows.select("doc_id", "text", "tag", "part", F.lit(1).alias("kind"), none.alias("group_id")).unionByName(more.select("doc_id", "text", "tag", F.col("g_part").alias("part"), F.lit(2).alias("kind"), none.alias("group_id")))
    both = both.unionByName(found.select("doc_id", F.lit("").alias("text"), "tag", "part", F.lit(0).alias("kind"), F.col("component_id").alias("group_id")))
    both = both.withColumn("ghost", F.col("kind") == 2).repartition(ranges, "part").sortWithinPartitions("part", "ghost", F.desc("doc_id"), "tag", "kind")

    def run(batches):
        import hashlib

        held, told = None, None  # doc_id, part, ghost, text, signature, group of the row before; the group told last
        for b in batches:
            for a, z in batches_of(b.column(1)):
                them = [] if held is None else [held]
                mine = []
                for d, t, tag, at, kind, group in zip(*(b.column(i).slice(a, z - a).to_pylist() for i in range(6)), strict=True):
                    if kind == 0:
                        told = ((d, tag), group)
                    else:
                        mine.append((d, at, kind == 2, t, told[1] if told is not None and told[0] == (d, tag) else None))
                sig = signatures([x[3].encode("utf-8", "surrogatepass") for x in mine])
                them += [(*x[:4], s, x[4]) for x, s in zip(mine, sig, strict=True)]
                held = them[-1] if them else None
                pairs = [(x, y) for x, y in zip(them, them[1:]) if not x[2] and x[1] == y[1]]
                if not pairs:
                    continue
                edited = []
                for x, y in pairs:
                    half = len(x[3]) // 2
                    edited.append((x[3][: len(x[3]) - half] + y[3][:half]).encode("utf-8", "surrogatepass"))
                es, own, after = signatures(edited), np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if x[0] == NULL_ID else x[0] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(printed(own)), pa.array(printed(es)), pa.array(likeness(own, es)), pa.array(likeness(own, after)),
                     pa.array([x[5] for x, _ in pairs], pa.int64())],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id"],
                )

    return both.select("doc_id", "text", "tag", "part", "kind", "group_id").mapInArrow(run, REPORT)


def bands(values: np.ndarray, at: np.ndarray, share: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of sets of shingles (`at`: where sets begin), and each one's set."""
    full = np.flatnonzero(np.diff(at))
    least = np.empty((PERMUTATIONS, len(full)), U)
    t = np.empty(len(values), U)
    for p in range(PERMUTATIONS if len(full) else 0):
        np.multiply(values, _A[p], out=t)
        t += _B[p]
        least[p] = np.minimum.reduceat(t, at[full])
    rows = PERMUTATIONS // BANDS
    h = mix((least.reshape(BANDS, rows, -1) * _A[:rows, None]).sum(1, dtype=U) + np.arange(BANDS, dtype=U)[:, None])
    return h.T.ravel(), np.repeat(full, BANDS)


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """doc_id, tag, n_shingles, component_id, first: groups of documents linked by a Jaccard similarity of `similarity` hundredths, verified, among those that share a band."""
    return stored(groups(docs, similarity, n, bands), "near-duplicates")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_report(documents(spark, sf_dir))


SQL = None
