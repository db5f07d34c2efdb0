"""Recorded media against what an answer key says of them; fetching itself is left to a plug that writes the files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sessions import shared_folder

CHUNK = 1 << 20
ASIDE = ".quarantine"  # what a file's name ends in once it was found to be another


def verified(media: DataFrame, root: str) -> DataFrame:
    """media(path, said_bytes bigint, said_sha256 string) below root -> path, size_bytes, sha256, finding, kept.

    Files are read in chunks, by the tasks.  finding is null where size and digest are as said, else 'missing', 'size differs', 'digest differs' or, where either was never said and
    nothing differs, 'size not recorded' or 'digest not recorded'.  A file that differs is moved aside, under its name and ASIDE, and never taken for the recorded one; a file of
    which nothing is known stays.  A task that runs again finds a file that was moved before where it was moved to.  The result is written once, so nothing is moved twice.
    """
    spark = media.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    base = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def check(batches):
        import hashlib

        from pyarrow import RecordBatch, int64, string
        from pyarrow import array as arr
        from pyarrow.fs import FileSystem, FileType

        fs, at = FileSystem.from_uri(base)
        there = lambda name: fs.get_file_info(name).type == FileType.File
        for b in batches:
            out = []
            for path, size, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = os.path.normpath(f"{at}/{path}") if path is not None else None
                if name is None or not name.startswith(f"{os.path.normpath(at)}/"):
                    out.append((path, None, None, "missing", False))
                    continue
                moved = not there(name) and there(name + ASIDE)
                if not moved and not there(name):
                    out.append((path, None, None, "missing", False))
                    continue
                digest, length = hashlib.sha256(), 0
                with fs.open_input_stream(name + ASIDE if moved else name) as f:
                    while chunk := f.read(CHUNK):
                        digest.update(chunk)
                        length += len(chunk)
                have = digest.hexdigest()
                wrong = "size differs" if size is not None and size != length else "digest differs" if sha and sha.strip().lower() != have else None
                if wrong and not moved:
                    fs.move(name, name + ASIDE)
                unsaid = "size not recorded" if size is None else "digest not recorded" if not (sha or "").strip() else None
                out.append((path, length, have, wrong or unsaid, wrong is None and not moved))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield RecordBatch.from_arrays([arr(cols[0], string()), arr(cols[1], int64()), arr(cols[2], string()), arr(cols[3], string()), arr(list(cols[4]), "bool")], names=["path", "size_bytes", "sha256", "finding", "kept"])

    done = media.select("path", F.col("said_bytes").cast("bigint"), "said_sha256").mapInArrow(check, "path string, size_bytes bigint, sha256 string, finding string, kept boolean")
    path = shared_folder(spark, "media")
    done.write.parquet(path)
    return spark.read.schema(done.schema).parquet(path)
