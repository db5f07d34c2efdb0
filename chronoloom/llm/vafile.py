"""Hard-negative mining over a vector-approximation file.

Vectors of integers are quantised: each dimension is cut into CELLS cells, and a row of the file is a byte for each dimension, with the exact vector beside it.  For an anchor, the least and the greatest of its
products with a cell's bounds, looked up and summed over the dimensions, bound its score with the row; only rows whose bounds allow them to enter a list are scored exactly.  The file is sorted by label and cut into
stripes, so that few anchors still fill many tasks and what tasks return grows with anchors times stripes, of which there are STRIPES at most.  A task streams one stripe past one block of anchors, batch by batch, and keeps
the best so far of each list:

1. positives: rows of the anchor's label that may score as high as the fifth best so far; a stripe's parts of other labels are passed over by their labels alone;
2. negatives: rows of other labels whose bounds meet a window of some positive's score, and may score as high as the fifth best in that window so far.

The stripes' lists are merged by Spark.  Bounds of cells come from a bounded sample of rows (SAMPLE) and the exact ends of each dimension; they decide what is scored, never what is found: results are exact.

Defined results: rows without label or vector, or with a null or non-finite component, take no part, nor do rows without vec_id, which could not be named; rows that repeat a vec_id are rows of their own, each an anchor
where its id is one, and ties among them go by label and vector; shorter vectors are filled up with zeros; a component of the quantised vector beyond 2**23 counts as that, so that a hundred times a score fits 64 bits (to 512 dimensions); a positive without a negative in its
window has no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lean, scratch, smallest_hashes, stored

CELLS = 64
SAMPLE = 10_000
STRIPES = 64
#: Rows of a stripe at least and of a file of it about, rows that meet a block of anchors at a time, anchors of a block at most.
STRIPE_ROWS = 8192
FILE_ROWS = 1_000_000
BATCH = 4096
BLOCK = 256
MOST = 5
LIMIT = 1 << 23
#: A negative scores between this share (in hundredths) of the positive's score and all of it.
LOW, HIGH = 80, 100


def labelled(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, v (floor of each component times scale) of the rows that take part."""
    x = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull())
    x = x.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("e"))
    x = x.filter(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    whole = F.transform("e", lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-1e18), F.least(F.lit(1e18), c * scale))))).cast("int"))
    return x.select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    own = np.repeat(np.arange(len(sizes)), sizes)
    out[own, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Cells:
    """Bounds of the cells of each dimension: cell c of dimension j holds edges[j, c] <= x <= edges[j, c + 1] - 1 (the last one its end too)."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int = CELLS):
        inner = np.ceil(np.quantile(sample, np.arange(1, cells) / cells, axis=0).T) if len(sample) else np.zeros((len(least), cells - 1))
        inner = np.clip(inner, least[:, None], most[:, None] + 1)
        self.inner = np.ascontiguousarray(inner).astype(np.int64)
        self.low = np.concatenate((least[:, None], self.inner), 1).astype(np.float64)
        self.high = np.concatenate((self.inner - 1, most[:, None]), 1).astype(np.float64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.inner[j], x[:, j], side="right") for j in range(x.shape[1])], 1).astype(np.uint8) if x.shape[1] else np.zeros(x.shape, np.uint8)

    def bounds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Looked up: the middle of each cell and half its width."""
        j = np.arange(codes.shape[1])
        low, high = self.low[j, codes], self.high[j, codes]
        return (low + high) / 2, (high - low) / 2


class File:
    """A vector-approximation file in shared storage and how to read it: stripes of (vec_id, label, twin, codes, v), sorted by label."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        lean(spark, 16 << 20)
        rows = stored(rows, "vectors")
        told = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        self.n, self.dims = told["n"], max(told["d"] or 0, 1)
        dims = self.dims
        ends = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.min("x").alias("a"), F.max("x").alias("z"), F.count("*").alias("c")).toPandas()  # a row a dimension
        least, most = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        j, short = ends["j"].to_numpy(np.int64), ends["c"].to_numpy() < self.n  # shorter vectors hold zeros there
        least[j], most[j] = np.where(short, np.minimum(ends["a"], 0), ends["a"]), np.where(short, np.maximum(ends["z"], 0), ends["z"])
        some = smallest_hashes(rows, SAMPLE, "vec_id", "v").select("v").toArrow().column(0).combine_chunks()  # SAMPLE rows at most
        self.cells = cells = Cells(_matrix(some, dims).astype(np.float64), least, most)
        #: No sum of products is above this; where it is small, 32-bit floats hold them exactly.
        self.reach = float((np.maximum(np.abs(least), np.abs(most)).astype(np.float64) ** 2).sum())
        self.stripes = stripes = int(max(1, min(STRIPES, -(-self.n // STRIPE_ROWS))))
        files = max(1, -(-self.n // (stripes * FILE_ROWS)))

        def approximate(batches):
            for b in batches:
                x = _matrix(b.column(2), dims)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dims), len(x), [None, pa.py_buffer(cells.codes(x).tobytes())]).cast(pa.binary())
                v = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, np.int32).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), codes, v], names=["vec_id", "label", "row", "stripe", "codes", "v"])

        row = F.xxhash64("vec_id", "label", "v").bitwiseOR(F.lit(1))  # never 0; rows equal in all of it answer alike
        dealt = rows.select("vec_id", "label", "v", row.alias("row"), F.pmod(row, F.lit(stripes)).cast("int").alias("stripe")).mapInArrow(approximate, "vec_id bigint, label bigint, row bigint, stripe int, codes binary, v binary")
        self.path = scratch(spark, "approximations")
        dealt = dealt.repartition(stripes * files, "stripe", F.pmod(F.shiftright("row", 32), F.lit(files)))
        dealt.sortWithinPartitions("stripe", "label", "vec_id", "row").write.partitionBy("stripe").parquet(self.path)
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.path).select("path").collect() if self.n else []  # a path for FILE_ROWS rows
        self.files = sorted(r[0] for r in listed)
        self.rows = spark.read.parquet(self.path) if self.n else None

    def view(self) -> "View":
        return View(self.files, self.dims, self.cells, self.reach)


class View:
    """What a task needs of a file: small, whatever the rows."""

    def __init__(self, files: list[str], dims: int, cells: Cells, reach: float):
        self.files, self.dims, self.cells, self.reach = files, dims, cells, reach
        self.kind = np.float32 if reach < 1 << 23 else np.float64
        self.exact = reach < 1 << 52

    def stripe(self, number: int):
        """Batches of a stripe: vec_id, label, row, codes, exact vectors; in order of labels."""
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        for name in self.files:
            if f"/stripe={number}/" not in name:
                continue
            fs, at = FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
            with fs.open_input_file(at) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=BATCH, columns=["vec_id", "label", "row", "codes", "v"]):
                    get = lambda c: b.column(c).to_numpy()  # noqa: B023, E731
                    yield get(0), get(1), get(2), self._bytes(b.column(3), np.uint8), self._bytes(b.column(4), np.int32)

    def _bytes(self, column: pa.Array, kind) -> np.ndarray:
        buffer, offsets = column.buffers()[2], column.buffers()[1]
        first = np.frombuffer(offsets, np.int32)[column.offset]
        return np.frombuffer(buffer, kind, len(column) * self.dims, first).reshape(-1, self.dims)

    def bounds(self, anchors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each anchor with each row: a cell's bounds times a component are its middle times it, less or more half its width times its size."""
        middle, half = self.cells.bounds(codes)
        a = anchors.astype(self.kind)
        s, w = a @ middle.astype(self.kind).T, np.abs(a) @ half.astype(self.kind).T
        if not self.exact:  # 64-bit floats round here; bounds give way by more than that
            w = w + self.reach * 1e-12
        return s - w, s + w

    def scores(self, anchors: np.ndarray, vectors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Exact scores of pairs (a, r)."""
        out = np.empty(len(a), np.int64)
        for x in range(0, len(a), 1 << 14):
            y = slice(x, x + (1 << 14))
            if self.exact:
                out[y] = np.einsum("ij,ij->i", anchors[a[y]].astype(np.float64), vectors[r[y]].astype(np.float64))
            else:
                out[y] = np.einsum("ij,ij->i", anchors[a[y]].astype(np.int64), vectors[r[y]].astype(np.int64))
        return out


class Lists:
    """The best `MOST` of each of `n` lists so far: by score, then the smaller vec_id, then row."""

    def __init__(self, n: int, floor: np.ndarray):
        self.score, self.ids, self.row = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        self.floor = floor  # what a new member must reach

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        touched = np.unique(at)
        have = self.score.shape[1]
        old = np.repeat(touched, have)
        real = self.row[touched].ravel() != 0
        who = np.concatenate((old[real], at))
        s, i, r = (np.concatenate((x[touched].ravel()[real], y)) for x, y in ((self.score, score), (self.ids, ids), (self.row, row)))
        o = np.lexsort((r, i, -s, who))
        who, s, i, r = who[o], s[o], i[o], r[o]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < MOST
        who, s, i, r, place = who[keep], s[keep], i[keep], r[keep], place[keep]
        if have < MOST and len(place) and place.max() >= have:
            grow = ((0, 0), (0, int(place.max()) + 1 - have))
            self.score, self.ids, self.row = np.pad(self.score, grow), np.pad(self.ids, grow), np.pad(self.row, grow)
        self.row[touched] = 0
        self.score[who, place], self.ids[who, place], self.row[who, place] = s, i, r
        full = (place == MOST - 1)
        self.floor[who[full]] = np.maximum(self.floor[who[full]], s[full])

    def out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, score, vec_id, row of all members."""
        at, place = np.nonzero(self.row)
        return at, self.score[at, place], self.ids[at, place], self.row[at, place]


def blocks(anchors: DataFrame, file: File, spark: SparkSession) -> DataFrame:
    """anchors(anchor, twin, ...) as tiles: every block of anchors with every stripe."""
    n = anchors.count()
    cores = max(spark.sparkContext.defaultParallelism, 1)
    block = int(max(16, min(BLOCK, -(-n * file.stripes // (2 * cores)))))
    count = max(1, -(-n // block))
    tiles = anchors.withColumn("block", F.pmod(F.xxhash64("anchor", "twin"), F.lit(count)).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(file.stripes - 1))))
    return tiles.repartition(min(count * file.stripes, 100_000), "block", "stripe")


def positives(anchors: DataFrame, file: File) -> DataFrame:
    """anchors(anchor, twin, label, row, v) -> anchor, twin, rank, score, vec_id: the best rows of each anchor's label, other than itself."""
    view = file.view()

    def run(t: pa.Table) -> pa.Table:
        label, own, name = (t.column(c).to_numpy() for c in ("label", "row", "anchor"))
        a = np.frombuffer(b"".join(t.column("v").to_pylist()), np.int32).reshape(-1, view.dims)
        lists = Lists(len(a), np.full(len(a), -(1 << 62)))
        seen = np.zeros(len(a), bool)  # of rows equal to an anchor in all, one is itself
        for ids, labels, rows, codes, vectors in view.stripe(t.column("stripe")[0].as_py()):
            for one in np.unique(labels):
                mine, them = np.flatnonzero(label == one), slice(*np.searchsorted(labels, [one, one + 1]))
                if not len(mine):
                    continue
                _, most = view.bounds(a[mine], codes[them])
                x, r = np.nonzero(most >= lists.floor[mine][:, None])
                x, r = mine[x], r + them.start
                same = (rows[r] == own[x]) & (ids[r] == name[x])
                if same.any():
                    itself = np.flatnonzero(same)
                    _, first = np.unique(x[itself], return_index=True)
                    itself = itself[first]
                    itself = itself[~seen[x[itself]]]
                    seen[x[itself]] = True
                    keep = np.ones(len(x), bool)
                    keep[itself] = False
                    x, r = x[keep], r[keep]
                if len(x):
                    s = view.scores(a, vectors, x, r)
                    ok = s >= lists.floor[x]
                    lists.add(x[ok], s[ok], ids[r[ok]], rows[r[ok]])
        at, s, i, r = lists.out()
        return pa.table({"anchor": pa.array(name[at]), "twin": pa.array(t.column("twin").to_numpy()[at]), "score": pa.array(s), "vec_id": pa.array(i), "row": pa.array(r)})

    found = blocks(anchors, file, anchors.sparkSession).groupBy("block", "stripe").applyInArrow(run, "anchor bigint, twin int, score bigint, vec_id bigint, row bigint")
    w = Window.partitionBy("anchor", "twin").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= MOST).select("anchor", "twin", "rank", "score", "vec_id")


def negatives(anchors: DataFrame, file: File, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchors(anchor, twin, label, v, scores: those of its positives by rank) -> anchor, twin, place (in scores), rank, score, vec_id: the best rows of other labels within each window."""
    view = file.view()

    def run(t: pa.Table) -> pa.Table:
        label = t.column("label").to_numpy()
        a = np.frombuffer(b"".join(t.column("v").to_pylist()), np.int32).reshape(-1, view.dims)
        sizes = np.array([len(x) for x in t.column("scores").to_pylist()], np.int64)
        own, score = np.repeat(np.arange(len(a)), sizes), np.array([s for x in t.column("scores").to_pylist() for s in x], np.int64)
        bottom, top = -(-score * low // 100), score * high // 100
        first = np.cumsum(sizes) - sizes
        lists = Lists(len(own), bottom.copy())
        ceiling = np.full(len(a), -np.inf)
        np.maximum.at(ceiling, own, np.where(bottom <= top, top.astype(np.float64), -np.inf))
        for ids, labels, rows, codes, vectors in view.stripe(t.column("stripe")[0].as_py()):
            least, most = view.bounds(a, codes)
            floor = np.full(len(a), np.inf)
            np.minimum.at(floor, own, np.where(bottom <= top, lists.floor.astype(np.float64), np.inf))
            may = (most >= floor[:, None]) & (least <= ceiling[:, None]) & (label[:, None] != labels)
            x, r = np.nonzero(may)
            enter, which = [], []  # candidates, and the windows that their bounds meet
            for k in range(int(sizes.max(initial=0))):
                has = np.flatnonzero(sizes[x] > k)
                w = first[x[has]] + k
                ok = (most[x[has], r[has]] >= lists.floor[w]) & (least[x[has], r[has]] <= top[w])
                enter.append(has[ok])
                which.append(w[ok])
            if not enter or not sum(map(len, enter)):
                continue
            enter, which = np.concatenate(enter), np.concatenate(which)
            some, back = np.unique(enter, return_inverse=True)
            s = view.scores(a, vectors, x[some], r[some])[back]
            ok = (s >= lists.floor[which]) & (s <= top[which])
            if ok.any():
                r = r[enter[ok]]
                lists.add(which[ok], s[ok], ids[r], rows[r])
        at, s, i, r = lists.out()
        name, twin = (t.column(c).to_numpy()[own[at]] for c in ("anchor", "twin"))
        return pa.table({"anchor": pa.array(name), "twin": pa.array(twin), "place": pa.array((at - first[own[at]]).astype(np.int32)), "score": pa.array(s), "vec_id": pa.array(i), "row": pa.array(r)})

    found = blocks(anchors, file, anchors.sparkSession).groupBy("block", "stripe").applyInArrow(run, "anchor bigint, twin int, place int, score bigint, vec_id bigint, row bigint")
    w = Window.partitionBy("anchor", "twin", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= MOST).select("anchor", "twin", "place", "rank", "score", "vec_id")


def mined(rows: DataFrame, anchor) -> DataFrame:
    """rows(vec_id, label, v) and a condition on anchors -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    file = File(rows)
    if not file.n:
        return spark.createDataFrame([], schema)
    twin = F.row_number().over(Window.partitionBy("vec_id").orderBy("row"))  # tells anchors of one id apart
    anchors = stored(file.rows.filter(anchor).select(F.col("vec_id").alias("anchor"), twin.alias("twin"), "label", "row", "v"), "anchors")
    close = stored(positives(anchors, file), "positives")
    of = close.groupBy("anchor", "twin").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("p"))  # MOST at most
    asked = stored(anchors.join(of, ["anchor", "twin"]), "asked")
    far = negatives(asked.select("anchor", "twin", "label", "v", F.col("p.score").alias("scores")), file)
    out = far.join(asked.select("anchor", "twin", "p"), ["anchor", "twin"]).withColumn("q", F.get("p", F.col("place")))
    return out.select(F.col("anchor").alias("anchor_id"), F.col("q.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("q.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(documents(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, F.col("vec_id") % 100 == 0)


SQL = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT * FROM n WHERE rank <= 5
"""
