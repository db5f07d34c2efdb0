"""Suffix-array dedup on bytes: each byte covered by a `length`-byte string that also starts in a document with a smaller doc_id goes.

Method: a logarithmic index family.  Suffixes are cut at `length` bytes, as only matches of at least that length count, and dealt to buckets by minimiser (windows.py).  In each bucket a new
batch of documents gets its suffix array, in the order of its bytes; equal neighbours settle what repeats within the batch, the rest is scanned against the levels so far, and what is new
becomes a level.  `SuffixIndex` keeps the levels in shared storage; a new level merges with those that are no larger, so n documents lie in O(log n) levels.  `report` treats its table as
the first batch of an index that nobody asks again, so it stores no level.

Defined results: a null or empty text has no bytes; texts under `length` bytes keep everything; rows with one doc_id are not smaller than each other; a null doc_id is neither smaller nor
greater than any, so such rows keep everything and take nothing from others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored
from .substring import keyed, touched
from .windows import U, Level, Plan, covered, dealt, pack, planned, repeated_windows, settle, unpack

LENGTH = 50
GRAM = 8
LEVEL = "bucket int, n bigint, text binary, places binary"


def kept_bytes(base: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of base (substring.keyed)."""
    whole = base.select("doc_id", "tag", "named", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("sha"))

    def drop(batches):
        for b in batches:
            n, runs, sha = [], [], []
            for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                gone = covered(s, len(t), length)
                n.append(int(gone.sum()))
                runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                sha.append(hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["_d", "_t", "n_removed", "n_spans", "kept"]
            )

    changed = touched(base.drop("named"), spans, ["doc_id", "tag", "text"]).mapInArrow(drop, "_d bigint, _t bigint, n_removed bigint, n_spans bigint, kept string").dropDuplicates(["_d", "_t"])
    out = whole.join(changed, (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_t")), "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"),
    )


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    base = keyed(docs)
    return kept_bytes(base, stored(repeated_windows(base.filter("named"), length, min(gram, length), False, True, 7e6), "byte-spans"), length)


class SuffixIndex:
    """The family in shared storage below `path`: batches of rising doc_id are added one after another.

    A manifest, numbered and written last, names the levels that count, so a batch that broke off left nothing; levels that merged are deleted once a newer manifest stands.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._last()

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _last(self) -> dict | None:
        if not self._fs.exists(self._at("")):
            return None
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._at("")) if f.getPath().getName().startswith("manifest-") and self._fs.exists(self._at(f"{f.getPath().getName()}/_SUCCESS")))
        return json.loads(self.spark.read.text(f"{self.path}/{names[-1]}").first()[0]) if names else None

    def _commit(self, state: dict, gone: list[str]) -> None:
        state["number"] += 1
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{state['number']:06d}")
        self.state = state
        for name in gone:
            self._fs.delete(self._at(name), True)

    @property
    def levels(self) -> list[tuple[str, int]]:
        """Folder and suffixes of each level, the oldest and largest first."""
        return [tuple(x) for x in self.state["levels"]] if self.state else []

    def _read(self, names: list[str]) -> DataFrame:
        out = None
        for i, name in enumerate(names):
            x = self.spark.read.schema(LEVEL).parquet(f"{self.path}/{name}").withColumn("level", F.lit(i))
            out = x if out is None else out.unionByName(x)
        return out if out is not None else self.spark.createDataFrame([], LEVEL + ", level int")

    def append(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
        """Adds a batch, all of whose doc_ids must be greater than those before; the rows of `report` for it, judged against all batches so far."""
        base = keyed(docs)
        named = base.filter("named")
        least, most = named.agg(F.min("doc_id"), F.max("doc_id")).first()
        state = self.state
        if state is None:  # the first batch settles buckets and common grams for good
            plan = planned(named, length, min(gram, length), False, True, 7e6)
            state = {"number": 0, "length": length, "gram": plan.m, "buckets": plan.buckets, "hot": plan.hot.tolist(), "most": None, "levels": [], "made": 0}
        if least is not None and state["most"] is not None and least <= state["most"]:
            raise ValueError(f"doc_id {least} is not greater than {state['most']}, which the index holds")
        k = state["length"]
        plan = Plan(k, state["gram"], False, state["buckets"], True, np.array(state["hot"], U))
        light, old = Plan(k, plan.m, False, plan.buckets, True), [x[0] for x in state["levels"]]

        def opened(t: pa.Table) -> list[Level]:
            import zstandard

            undo = zstandard.ZstdDecompressor()
            return [Level(undo.decompress(x), unpack(p)[0], k) for x, p in zip(t.column("text").to_pylist(), t.column("places").to_pylist(), strict=True)]

        def shut(bucket: int, level: Level) -> dict:
            import zstandard

            return {"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(level.where)], pa.int64()), "text": pa.array([zstandard.ZstdCompressor(level=3).compress(level.buffer)], pa.binary()), "places": pa.array([pack([level.where.astype(np.int32)])], pa.binary())}

        def scan(new: pa.Table, levels: pa.Table) -> pa.Table:
            """Spans of the batch's documents, and (doc_id null) the bucket's new level."""
            if not new.num_rows:
                return pa.table({"doc_id": pa.array([], pa.int64()), "tag": pa.array([], pa.int64()), "spans": pa.array([], pa.binary()), "bucket": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "text": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})
            spans, level = settle(new, light, opened(levels), True)
            none = lambda kind: pa.nulls(spans.num_rows, kind)
            out = pa.table({**{c: spans.column(c) for c in spans.column_names}, "bucket": none(pa.int32()), "n": none(pa.int64()), "text": none(pa.binary()), "places": none(pa.binary())})
            if level is None or not len(level.where):
                return out
            more = pa.table({"doc_id": pa.nulls(1, pa.int64()), "tag": pa.nulls(1, pa.int64()), "spans": pa.nulls(1, pa.binary()), **shut(new.column("bucket")[0].as_py(), level)})
            return pa.concat_tables([out, more])

        pair = dealt(named, plan).groupBy("bucket").cogroup(self._read(old).groupBy("bucket"))
        done = stored(pair.applyInArrow(scan, f"doc_id bigint, tag bigint, spans binary, {LEVEL}"), "scanned")
        fresh = done.filter("places is not null").select("bucket", "n", "text", "places")
        size = fresh.agg(F.sum("n")).first()[0] or 0  # one number
        state = {**state, "levels": [list(x) for x in state["levels"]], "most": most if most is not None else state["most"]}
        gone = []
        if size:
            def write(rows: DataFrame, n: int) -> None:
                state["made"] += 1
                name = f"level-{state['made']:06d}"
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
                state["levels"].append([name, n])

            def merge(t: pa.Table) -> pa.Table:
                both = opened(t)
                for other in both[1:]:
                    both[0] = both[0].merged(other)
                return pa.table(shut(t.column("bucket")[0].as_py(), both[0]))

            merged = []
            while state["levels"] and state["levels"][-1][1] <= size:
                name, n = state["levels"].pop()
                merged.append(name)
                size += n
            if merged:
                rows = self._read(merged).drop("level").unionByName(fresh)
                write(rows.repartition(plan.buckets, "bucket").groupBy("bucket").applyInArrow(merge, LEVEL), size)
                gone += merged
            else:
                write(fresh, size)
        self._commit(state, gone)
        return kept_bytes(base, done.filter("places is null").select("doc_id", "tag", "spans"), k)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


SQL = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, md5_number(substr(h, 2 * i - 1, 100)) AS s FROM (SELECT r, doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM b WHERE length(h) >= 100)),
hit AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id),
edge AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM edge) GROUP BY r, g),
gap AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS from_ FROM run),
kept AS (SELECT g.r, string_agg(substr(h, 2 * from_ - 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) - 1) AS k, sum(z - a)::BIGINT AS n, count(*) AS spans FROM gap g JOIN b USING (r) GROUP BY g.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM b LEFT JOIN kept USING (r)
"""
