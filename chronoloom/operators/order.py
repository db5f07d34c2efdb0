"""Places and digests over a whole order, without a task that holds all rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sessions import written

#: The low bits of a row's number hold its place in its partition (monotonically_increasing_id).
BITS = 33


def placed(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """Rows with their place from 1 in an order that no two unlike rows share.

    Ranges of the order are sorted each in its own task and written with each row's place in its range; the rows before a range are counted from one number a range, and those are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", BITS)
    # A row a range: as many as there are shuffle partitions.
    ends = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, m in ends:
        offsets.append((p, before))
        before += m
    table = rows.sparkSession.createDataFrame(offsets, "_p bigint, _before bigint")
    out = numbered.join(F.broadcast(table), part == F.col("_p"))
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << BITS) - 1)) + 1).select(*rows.columns, name)


def streamed_digest(rows: DataFrame, item: str, *order) -> DataFrame:
    """digest: SHA-256 (hex) of the bytes in column `item` of all rows, in order; null if one of them is null.

    Ranges are sorted and then read one after another by one task, which holds a batch at a time: the digest of a sequence can be taken in sequence only.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        sha, known = hashlib.sha256(), True
        for b in batches:
            known = known and not b.column(0).null_count
            for x in b.column(0).to_pylist() if known else ():
                sha.update(x)
        yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest() if known else None], pa.string())], ["digest"])

    # coalesce(1) reads the ranges in their order.
    one = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.col(item).cast("binary").alias("item")).coalesce(1).mapInArrow(run, "digest string")
    return one.agg(F.when(F.count("*") == 0, F.lit(hashlib.sha256().hexdigest())).otherwise(F.max("digest")).alias("digest"))  # no rows may have no task
