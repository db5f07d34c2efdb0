"""Folders of notes and other files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ASSET_SUFFIXES
from ..operators.notes import IGNORED_FILES, IGNORED_FOLDERS
from .sessions import spread, written

#: Files of a batch of a listing, and bytes of a batch of contents.
BATCH, BYTES = 10_000, 4_000_000


def _below(df: DataFrame, root: str) -> DataFrame:
    """Paths relative to root, without the application's own folders and files.  A path that is not there raises when it is read."""
    tail = F.regexp_replace(F.col("path"), F.lit("^.*?" + root.rstrip("/").split("://")[-1].replace(".", r"\.") + "/"), F.lit(""))
    x = df.withColumn("path", tail)
    parts = F.split("path", "/")
    return x.filter(~F.arrays_overlap(parts, F.array(*[F.lit(f) for f in IGNORED_FOLDERS])) & ~F.element_at(parts, -1).isin(*IGNORED_FILES))


def _uri(spark: SparkSession, root: str) -> str:
    """root as pyarrow's file systems know it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified of all files below root, listed by the executors, a level of folders at a time; the driver holds no listing.  A root that is not there raises."""
    uri = _uri(spark, root)

    def folders(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSelector, FileSystem

        fs, _ = FileSystem.from_uri(uri)
        for b in batches:
            for at in b.column(0).to_pylist():
                found = fs.get_file_info(FileSelector(at))
                for k in range(0, len(found), BATCH):
                    part = found[k : k + BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.path for f in part], pa.string()), pa.array([not f.is_file for f in part], pa.bool_()), pa.array([f.size for f in part], pa.int64()), pa.array([f.mtime and int(f.mtime.timestamp() * 1000) for f in part], pa.int64())],
                        names=["path", "folder", "size", "modified"],
                    )

    from pyarrow.fs import FileSystem

    level, out = spark.createDataFrame([(FileSystem.from_uri(uri)[1],)], "path string"), []
    cores = spark.sparkContext.defaultParallelism
    while True:
        found = written(level.mapInArrow(folders, "path string, folder boolean, size bigint, modified bigint"), "listing")
        out.append(found.filter("not folder").drop("folder"))
        below = found.filter(F.col("folder") & ~F.element_at(F.split("path", "/"), -1).isin(*IGNORED_FOLDERS)).select("path")
        n = below.count()
        if not n:
            return reduce(DataFrame.unionByName, out)
        # Neighbours stay together, at most some thousand folders a task.
        level = below.repartition(max(cores, n // 2000), "path")


def _contents(spark: SparkSession, root: str, files_: DataFrame) -> DataFrame:
    """files(path, modified) with their content, read where the rows are; a batch goes on when it holds a few megabytes."""
    uri = _uri(spark, root)

    def read(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(uri)
        for b in batches:
            held, size = [], 0
            for path, modified in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    held.append((path, f.read(), modified))
                size += len(held[-1][1])
                if size > BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["path", "content", "modified"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["path", "content", "modified"])

    return files_.select("path", "modified").mapInArrow(read, "path string, content binary, modified bigint")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """Path, content, modified of every note below root, empty ones too, and those that Spark's readers take for hidden.  (Symbolic links are not told from files.)"""
    found = _below(_listed(spark, root).filter(F.endswith("path", F.lit(".md"))).select(F.col("path").alias("at"), "path", "modified"), root)
    x = _contents(spark, root, spread(found.select(F.col("at").alias("path"), "modified")))
    return _below(x.select("path", F.col("content").cast("string").alias("content"), "modified"), root)


def assets(spark: SparkSession, root: str) -> DataFrame:
    """Names of attachments; their contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    x = _below(x, root).filter(F.lower("path").rlike(r"\.(" + "|".join(s[1:] for s in ASSET_SUFFIXES) + ")$"))
    return x.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def files(spark: SparkSession, root: str) -> DataFrame:
    """All files below root, for a digest of the tree."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _below(x.select("path", "content", F.unix_millis("modificationTime").alias("modified")), root)
