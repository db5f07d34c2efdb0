"""What the corpus operators share: shared scratch space, skew-safe joins, ranks and text hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot when it holds more than one row in HOT_SHARE, so there are at most HOT_SHARE hot keys: a proven bound.
HOT_SHARE = 1000
#: 64-bit words of the bitmap of ids by which a scan is thinned out: a proven bound of what is broadcast.
BITMAP_WORDS = 1 << 18

_left: dict[str, SparkSession] = {}


def lean(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most `most` bytes from now on (the session's own limit stays if it is lower), so that long texts bound no task's memory by their number."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "67108864b")
    now = int(now[:-1]) if now.endswith("b") and now[:-1].lstrip("-").isdigit() else int(now) if now.lstrip("-").isdigit() else -1
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, in a local temporary folder, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/chronoloom-{os.getuid()}"
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_clean)
    _left[path] = spark
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, so any store will do."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    finally:
        _left.pop(path, None)


def _clean() -> None:
    for path, spark in list(_left.items()):
        try:
            discard(spark, path)
        except Exception:  # the session may be gone at exit; nothing is left to do then
            pass


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write df to shared storage and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, size: float, each: float) -> int:
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1))


def attach(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left with the columns of right (one row a key, `rows` = left rows of that key); a left outer join that no key overloads.

    Keys with over 1/HOT_SHARE of all rows number HOT_SHARE at most and are broadcast; the others shuffle.
    """
    limit = max(1, total // HOT_SHARE)
    names = [c for c in right.columns if c != key]
    hot = right.filter(F.col(rows) > limit).select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot"))
    cold = right.filter(F.col(rows) <= limit).select(F.col(key).alias("_cold_key"), F.struct(*names).alias("_cold"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # Rows that are settled get a null key of their own: null keys match nothing, and a salt spreads them.
    out = out.withColumn("_k", F.when(F.col("_hot_key").isNull(), F.col(key))).withColumn(
        "_salt", F.when(F.col("_k").isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(4096))).otherwise(F.lit(0).cast("bigint"))
    )
    cold = cold.withColumn("_zero", F.lit(0).cast("bigint"))
    out = out.join(cold, (F.col("_k") == F.col("_cold_key")) & (F.col("_salt") == F.col("_zero")), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"_hot.{n}"), F.col(f"_cold.{n}")).alias(n) for n in names])


def thinned(rows: DataFrame, ids: DataFrame, on: list[str], mark: str | None = None) -> DataFrame:
    """rows whose columns `on` may be those of a row of ids (same names and types); with `mark`, all rows and whether they may be.

    A bitmap of the ids' hashes, of 2**24 bits whatever their number, is broadcast (4 MB as rows); none of ids is missed, and a join afterwards drops what passes by chance.
    """
    h = F.xxhash64(*on)
    bit = F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(__cl_h, 20), 64) as int))")
    words = ids.select(h.alias("__cl_h")).groupBy(F.pmod("__cl_h", F.lit(BITMAP_WORDS)).alias("__cl_w")).agg(F.bit_or(bit).alias("__cl_bits"))
    out = rows.withColumn("__cl_h", h).join(F.broadcast(words), F.pmod("__cl_h", F.lit(BITMAP_WORDS)) == F.col("__cl_w"), "left" if mark else "inner")
    found = F.coalesce(F.col("__cl_bits").bitwiseAND(bit) != 0, F.lit(False))
    out = out.withColumn(mark, found) if mark else out.filter(found)
    return out.drop("__cl_h", "__cl_w", "__cl_bits")


def salted(left: DataFrame, right: DataFrame, key: str, each: int = 2048) -> DataFrame:
    """left joined with right (one row a key).  A key with more than `each` rows of left is dealt to several tasks, each with a copy of right's row: a copy for `each` rows at most."""
    hot = stored(left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > each).select(key, F.ceil(F.col("_n") / each).cast("int").alias("_ways")), "hot-keys")
    ways = F.coalesce("_ways", F.lit(1))
    one = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), ways).cast("int")).drop("_ways")
    two = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways")
    return one.join(two, [key, "_salt"]).drop("_salt")


def ranked(df: DataFrame, order: list[str], what: str, within: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds _rank from 0 in `order`: over all rows, or among the rows with the same `within` (the first of `order`).

    One range shuffle; the rows are stored with their place in their partition, and only one count per
    partition (and value of `within` in it) reaches the driver or is broadcast.  No partition holds a whole group.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = df.schema
    at = schema.fieldNames().index(within) if within else None
    done = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out_schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, _part int, _at bigint"

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen, last = TaskContext.get().partitionId(), 0, object()
        for b in batches:
            m = b.num_rows
            if at is None:
                place = np.arange(seen, seen + m)
                seen += m
            else:
                place = np.empty(m, np.int64)
                for i, v in enumerate(b.column(at).to_pylist()):
                    seen = seen + 1 if v == last else 0
                    last = v
                    place[i] = seen
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(m, part, np.int32)), pa.array(place.astype(np.int64))], names=[*b.schema.names, "_part", "_at"])

    kept = stored(done.mapInArrow(number, out_schema), what)
    by = ["_part", *([within] if within else [])]
    counts = kept.groupBy(*by).agg(F.count("*").alias("_n"))
    # At most one row per partition plus one per further value: bounded by partitions, or partitions + values.
    rows = sorted(((r["_part"], r["_n"], r[within] if within else None) for r in counts.collect()), key=lambda r: (r[2] is not None, r[2] if r[2] is not None else 0, r[0]))
    base, sums = [], {}
    for part, m, value in rows:
        base.append((part, value, sums.get(value, 0)))
        sums[value] = sums.get(value, 0) + m
    kind = schema[within].dataType.simpleString() if within else "int"
    table = spark.createDataFrame(base, f"_p int, _v {kind}, _base bigint")
    on = (F.col("_part") == F.col("_p")) & (F.col(within).eqNullSafe(F.col("_v")) if within else F.lit(True))
    return kept.join(F.broadcast(table), on, "inner").withColumn("_rank", F.col("_base") + F.col("_at")).select(*df.columns, "_rank")


def smallest_hashes(df: DataFrame, most: int, *of: str) -> DataFrame:
    """The `most` rows with the smallest hash of some columns (ties by those columns).  A threshold on the hash first leaves about twice as many, so no task sorts more."""
    total = df.count()
    h = F.xxhash64(*of)
    share = min(1.0, (2 * most + 1000) / max(total, 1))
    near = df.withColumn("__cl_h", h).filter(F.pmod(F.col("__cl_h"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return near.orderBy(F.pmod(F.col("__cl_h"), F.lit(1 << 40)), *of).limit(most).drop("__cl_h")


# ---------------------------------------------------------------------------------------------- hashing in numpy

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=_U) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = (n + (1 << 18) - 1) >> 18 << 18
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, _U)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=_U)
    return _pow[0], _pow[1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * base**j (mod 2**64), from which any slice's hash follows."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def slices(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((p[end] - p[start]) * powers(len(p))[1][start])


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    p = prefix(values)
    return mix((p[k:] - p[:n]) * powers(n)[1][:n])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(a: np.ndarray) -> np.ndarray:
    return _LOWER[a]


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; words are what [^\\x20\\x09-\\x0D]+ matches."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = _SPACE[a]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    if not gap[-1]:
        edge = np.concatenate((edge, [len(a)]))
    return edge[::2], edge[1::2]


def word_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in bytes."""
    s, e = word_bounds(a)
    return slices(prefix(TABLE[a]), s, e), s, e


def groups_of(texts: list[bytes | None], limit: int = 1 << 22):
    """Runs of texts, each of about `limit` bytes at most (or one long text)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def tidy() -> None:
    """Give freed memory back to the system, where its C library can."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def batches_of(column, limit: int = 1 << 20):
    """As groups_of, from an Arrow column, whose values are not made Python objects."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def shingle_sets(texts: list[bytes], n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct n-word shingles, text by text and sorted, and where each text's begin.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        joined = lower_ascii(joined)
    w, s, _ = word_hashes(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(s, np.concatenate(([0], ends)))
    count = np.diff(first)
    all_grams = grams(w, n)
    doc = np.repeat(np.arange(len(texts)), count)
    ok = np.zeros(len(w), bool)
    if len(all_grams):
        ok[: len(all_grams)] = doc[: len(all_grams)] == doc[n - 1 :]
    values, owner = all_grams[ok[: len(all_grams)]], doc[ok]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        p = prefix(w)
        values = np.concatenate((values, slices(p, first[short], first[short + 1]) ^ mix(count[short].astype(_U))))
        owner = np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))
