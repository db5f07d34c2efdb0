"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

Equal vectors are indexed once, with their `k + 1` smallest ids (all that a list of k can hold).  Distinct vectors go to shards by hash; each shard's graph is built in batches with
numpy and stored as a row: vectors, and for each layer its nodes and a flat array of neighbours.  A shard is one task's work and moves once; the queries, in shared storage, are streamed
past it in blocks.  A walk from the top layer down, in lock step for a block, finds each query's candidates; shard results are scored exactly in double precision and merged.  The work is
queries times shards, so shards are as large as a task's memory lets them be (SHARD vectors).

To serve inner products, vectors get one more component that makes their lengths equal (queries get 0 there), so that the graph's distance is Euclidean.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part; a vector whose length differs from the most common one's takes none either;
rows that repeat a vec_id are separate candidates and separate queries, each other's candidates too; a null vec_id takes no part; ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lean, partitions_for, scratch, stored
from .windows import pack, unpack

LINKS = 16
BUILD = 96
#: The width of a walk is this at least, and wider in a shard where it takes more to find RECALL of a sample's nearest vectors.
SEARCH = 200
RECALL = 0.96
SHARD = 32_768
K = 20
OUT = "query_id bigint, twin int, vec_id bigint, score double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    ok = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = ok.filter(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    sizes = ok.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return ok.filter(F.size("embedding") == sizes["n"]) if sizes else ok


class Graph:
    """Layers of flat neighbour arrays over `x` (float32 rows of equal length)."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers  # layer: place of each node in it (or -1), neighbours by place (-1: none)

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, width: int = BUILD, seed: int = 5) -> "Graph":
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(links)).astype(int), 12)
        order = np.argsort(-level, kind="stable")  # tall nodes first: every layer is entered from above
        top = int(level.max(initial=0))
        layers = []
        for l in range(top + 1):
            nodes = order[level[order] >= l]
            place = np.full(n, -1, np.int32)
            place[nodes] = np.arange(len(nodes), dtype=np.int32)
            layers.append((place, nodes.astype(np.int32), np.full((len(nodes), links * (2 if l == 0 else 1)), -1, np.int32)))
        graph = cls(x, layers)
        for l in range(top, -1, -1):
            graph._fill(l, width)
        return graph

    def _fill(self, l: int, width: int) -> None:
        """Insert the nodes of a layer, batch by batch, each batch searching what is there and itself."""
        place, nodes, near = self.layers[l]
        degree = near.shape[1]
        done = 0
        while done < len(nodes):
            size = min(max(1, done), 512, len(nodes) - done)
            batch = nodes[done : done + size]
            q = self.x[batch]
            found = np.full((size, 0), -1, np.int32)
            if done:
                entry = self._descend(q, l, done)
                found, _ = self._search(q, l, entry, min(width, done), limit=done)
            own = np.tile(batch, (size, 1)).astype(np.int32)
            np.fill_diagonal(own, -1)
            if size > width:
                d = self._far(q, own)
                own = np.take_along_axis(own, np.argpartition(d, width, 1)[:, :width], 1)
            chosen = self._select(q, np.concatenate((found, own), 1), degree // 2 if l == 0 else degree)
            at = place[batch]
            near[at, : chosen.shape[1]] = chosen
            self._back(l, batch, chosen)
            done += size

    def _far(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = 2 - 2 * np.einsum("bd,bkd->bk", q, self.x[np.maximum(ids, 0)], optimize=False)
        d[ids < 0] = np.inf
        return d

    def _select(self, q: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
        """Up to m neighbours that are nearer to q than to each other, filled up with the nearest others."""
        d = self._far(q, ids)
        o = np.argsort(d, 1, kind="stable")[:, : max(3 * m, 48)]
        ids, d = np.take_along_axis(ids, o, 1), np.take_along_axis(d, o, 1)
        b, k = ids.shape
        v = self.x[np.maximum(ids, 0)]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        kept, count = np.zeros((b, k), bool), np.zeros(b, int)
        for j in range(k):
            close = np.where(kept[:, :j], between[:, j, :j], np.inf).min(1, initial=np.inf) if j else np.full(b, np.inf)
            take = (ids[:, j] >= 0) & np.isfinite(d[:, j]) & (d[:, j] < close) & (count < m)
            kept[:, j] = take
            count += take
        rank = np.where(kept, 0, 1) * (k + 1) + np.arange(k)
        rank[(ids < 0) | ~np.isfinite(d)] = 3 * k + 3
        o = np.argsort(rank, 1, kind="stable")[:, :m]
        out = np.take_along_axis(ids, o, 1)
        out[np.take_along_axis(rank, o, 1) > 3 * k] = -1
        return out

    def _back(self, l: int, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen back to the batch; full lists are chosen anew."""
        place, _, near = self.layers[l]
        src, dst = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        at = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1]))) if len(dst) else np.zeros(0, int)
        size = np.diff(np.concatenate((at, [len(dst)])))
        if not len(at):
            return
        who = dst[at]
        most = int(size.max())
        new = np.full((len(at), most), -1, np.int32)
        new[np.repeat(np.arange(len(at)), size), np.arange(len(dst)) - np.repeat(at, size)] = src
        old = near[place[who]]
        for a in range(0, len(who), 1024):
            b = slice(a, a + 1024)
            both = np.concatenate((old[b], new[b]), 1)
            s = np.sort(both, 1)
            dup = np.zeros_like(s, bool)
            dup[:, 1:] = s[:, 1:] == s[:, :-1]
            s[dup] = -1
            near[place[who[b]]] = self._select(self.x[who[b]], s, near.shape[1])

    def _descend(self, q: np.ndarray, to: int, limit: int | None = None) -> np.ndarray:
        """Entries into layer `to`: greedy from the top."""
        entry = np.full((len(q), 1), self.layers[-1][1][0], np.int32)
        for l in range(len(self.layers) - 1, to, -1):
            entry, _ = self._search(q, l, entry, 4)
            entry = entry[:, :1]
        return entry

    def _search(self, q: np.ndarray, l: int, entry: np.ndarray, width: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest nodes that a best-first walk finds, for all queries at once, nearest first."""
        place, _, near = self.layers[l]
        b, n = len(q), len(self.x)
        seen = np.zeros((b, n), bool)
        rows = np.arange(b)
        seen[rows[:, None], entry] = True
        ids, d = entry.copy(), self._far(q, entry)
        open_ = np.ones_like(ids, bool)
        active = rows
        while len(active):
            dd = np.where(open_[active], d[active], np.inf)
            pick = dd.argmin(1)
            go = np.isfinite(dd[np.arange(len(active)), pick])
            active, pick = active[go], pick[go]
            if not len(active):
                break
            open_[active, pick] = False
            nodes = ids[active, pick]
            step = near[place[nodes]]
            bad = (step < 0) | seen[active[:, None], np.maximum(step, 0)]
            r, c = np.nonzero(~bad)
            seen[active[r], step[r, c]] = True
            step = np.where(bad, -1, step)
            ds = self._far(q[active], step)
            m = ids.shape[1]
            if m < width:
                grow = min(width, m + step.shape[1]) - m
                ids = np.concatenate((ids, np.full((b, grow), -1, np.int32)), 1)
                d = np.concatenate((d, np.full((b, grow), np.inf, d.dtype)), 1)
                open_ = np.concatenate((open_, np.zeros((b, grow), bool)), 1)
                m += grow
            ai, ad, ao = np.concatenate((ids[active], step), 1), np.concatenate((d[active], ds), 1), np.concatenate((open_[active], ~bad), 1)
            o = np.argpartition(ad, m - 1, 1)[:, :m] if ad.shape[1] > m else np.argsort(ad, 1)
            ids[active], d[active], open_[active] = (np.take_along_axis(x, o, 1) for x in (ai, ad, ao))
        o = np.argsort(d, 1, kind="stable")
        return np.take_along_axis(ids, o, 1), np.take_along_axis(d, o, 1)

    def nearest(self, q: np.ndarray, width: int = SEARCH) -> np.ndarray:
        return self._search(q, 0, self._descend(q, 0), min(width, len(self.x)))[0]

    def calibrated(self, k: int, least: int = SEARCH, recall: float = RECALL, sample: int = 96) -> int:
        """The width of a walk, doubled from `least`, at which `sample` of the vectors find `recall` of their k nearest others."""
        n, width = len(self.x), least
        if n <= width:
            return width
        some = np.random.default_rng(7).choice(n, min(sample, n), replace=False)
        q = self.x[some].copy()
        q[:, -1] = 0
        q /= np.sqrt((q**2).sum(1, keepdims=True))
        score = q @ self.x.T
        score[np.arange(len(some)), some] = -np.inf
        want = np.argpartition(-score, k, 1)[:, :k]
        while width < n:
            found = self.nearest(q, width)
            if np.mean([np.isin(w, f).mean() for w, f in zip(want, found, strict=True)]) >= recall:
                break
            width *= 2
        return min(width, n)

    def flat(self) -> bytes:
        arrays = [np.array([len(self.x), self.x.shape[1], len(self.layers)], np.int64), self.x.view(np.uint32).ravel()]
        for _, nodes, near in self.layers:
            arrays += [nodes, near.ravel()]
        return pack(arrays)

    @classmethod
    def unflat(cls, blob: bytes) -> "Graph":
        head, x, *rest = unpack(blob)
        n, dim, depth = head.tolist()
        layers = []
        for nodes, near in zip(rest[::2], rest[1::2], strict=True):
            place = np.full(n, -1, np.int32)
            place[nodes] = np.arange(len(nodes), dtype=np.int32)
            layers.append((place, nodes, near.reshape(len(nodes), -1)))
        return cls(x.view(np.float32).reshape(n, dim), layers)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled by the longest, with the component that gives them unit length."""
    x = x / longest
    return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))), 1).astype(np.float32)


def shards(rows: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """The index, one row a shard: shard, graph, width of walks, vectors (doubles), ids (each vector's k + 1 smallest, -1 filled)."""
    spark = rows.sparkSession
    lean(spark, 16 << 20)
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)  # limited before the shuffle too
    distinct = stored(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    told = distinct.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    count = max(1, -(-told["n"] // shard))
    longest = float(np.sqrt(told["m"] or 1.0))

    def build(t: pa.Table) -> pa.Table:
        x = np.array(t.column("embedding").to_pylist(), np.float64)
        ids = np.full((len(x), k + 1), -1, np.int64)
        for i, them in enumerate(t.column("ids").to_pylist()):
            ids[i, : len(them)] = them
        graph = Graph.build(lifted(x, longest))
        return pa.table({"shard": t.column("shard")[:1].cast(pa.int32()), "graph": pa.array([graph.flat()]), "width": pa.array([graph.calibrated(k)], pa.int32()), "vectors": pa.array([pack([x.view(np.int64).ravel()])]), "ids": pa.array([pack([ids.ravel()])])})

    keyed = distinct.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(count)).cast("int"))
    built = keyed.repartition(partitions_for(spark, count, 1) if count > 1 else 1, "shard").groupBy("shard").applyInArrow(build, "shard int, graph binary, width int, vectors binary, ids binary")
    return stored(built, "graphs", "none")


def search(queries: DataFrame, index: DataFrame, k: int = K, width: int | None = None, block: int = 512) -> DataFrame:
    """queries(query_id, embedding) -> query_id, rank, vec_id, score: the k best found, other than the query's own row; by walks of each shard's own width, or of `width`."""
    spark = queries.sparkSession
    # Queries that repeat an id are told apart by a number.
    twin = F.row_number().over(Window.partitionBy("query_id").orderBy("embedding")).alias("twin")
    path = scratch(spark, "queries")
    queries.select("query_id", twin, "embedding").write.parquet(path)
    names = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").collect()]  # the files of the queries, as few as the tasks that wrote them

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        for b in batches:
            for blob, own, vectors, kept in zip(*(b.column(c).to_pylist() for c in ("graph", "width", "vectors", "ids")), strict=True):
                graph = Graph.unflat(blob)
                x = unpack(vectors)[0].view(np.float64).reshape(len(graph.x), -1)
                ids = unpack(kept)[0].reshape(len(x), -1)
                step = max(16, min(block, (1 << 23) // len(x)))
                for name in names:
                    fs, at = FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                    with fs.open_input_file(at) as f:
                        for q in pq.ParquetFile(f).iter_batches(batch_size=step):
                            yield _answers(q, graph, x, ids, k, width or own)

    parts = max(1, index.count())
    found = index.repartition(parts).mapInArrow(run, OUT)
    w = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(queries: pa.RecordBatch, graph: Graph, x: np.ndarray, ids: np.ndarray, k: int, width: int) -> pa.RecordBatch:
    """The k best of a shard for each query; of the entry with the query's own vector one row with its id is itself."""
    own, twin = queries.column("query_id").to_numpy(), queries.column("twin").to_numpy()
    q = np.array(queries.column("embedding").to_pylist(), np.float64).reshape(len(own), -1)
    unit = q / np.sqrt((q**2).sum(1, keepdims=True))
    found = graph.nearest(np.concatenate((unit, np.zeros((len(q), 1))), 1).astype(np.float32), width)
    score = np.einsum("bd,bkd->bk", q, x[np.maximum(found, 0)])
    score[found < 0] = -np.inf
    best = np.argsort(-score, 1, kind="stable")[:, : k + 21]
    out = []
    for i in range(len(q)):
        f, s = found[i, best[i]], score[i, best[i]]
        f, s = f[np.isfinite(s)], s[np.isfinite(s)]
        v = ids[f]
        itself = (v == own[i]) & (x[f] == q[i]).all(1)[:, None]
        itself &= np.cumsum(itself, 1) == 1
        v, s, ok = v.ravel(), np.repeat(s, ids.shape[1]), ((v >= 0) & ~itself).ravel()
        v, s = v[ok], s[ok]
        o = np.lexsort((v, -s))[:k]
        out.append((np.full(len(o), own[i]), np.full(len(o), twin[i]), v[o], s[o]))
    a, t, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(t, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "twin", "vec_id", "score"])


def op2_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(usable(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "usable")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search(queries, shards(rows))


SQL = None

