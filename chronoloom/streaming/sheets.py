"""T-R1, T-R2: answer sheets as a stream of transactions: a batch of sheets is checked against the log so far, written, and committed by a manifest; readers see committed versions only, whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corrections import accepted, appended, parse_sheets
from ..sources.plugged import listed, opened
from ..sources.sinks import write_document

SHEETS = "session_id bigint, payload string"
LOG = "session_id bigint, sequence bigint, pos int, answered_by string, question_id string, action string, decided array<string>"
REFUSED = "session_id bigint, answers bigint"


class Versions:
    """Tables below a folder, each a list of written versions; the last manifest says which of them count.

    A version is written before the manifest that names it, and a manifest is there whole or not at all, so what a run that broke off has written is never read, and is written over by the next one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> dict:
        fs, at = opened(self.path)
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{at}/manifests").type != FileType.Directory:
            return {"batch": -1, "tables": {}}
        names = listed(f"{self.path}/manifests", ".json")
        if not names:
            return {"batch": -1, "tables": {}}
        fs, at = opened(names[-1])
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in self.last()["tables"].get(table, [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Append the tables' rows as one version; a batch that is committed already changes nothing."""
        last = self.last()
        if batch <= last["batch"]:
            return
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version-{batch:08d}")
        self.written(batch)
        names = {k: [*last["tables"].get(k, []), *([f"{k}/version-{batch:08d}"] if k in tables else [])] for k in {*last["tables"], *tables}}
        write_document(f"{self.path}/manifests/{batch:08d}.json", {"batch": batch, "tables": names})

    def written(self, batch: int) -> None:
        """Called between a version's writing and its commit."""


def decisions(log: DataFrame) -> DataFrame:
    """A row for each key that a log entry decides, as operators.corrections has them."""
    return log.select("session_id", "sequence", "answered_by", F.explode("decided").alias("decided"))


def entries(answers: DataFrame) -> DataFrame:
    o = F.col("operation")
    ids = F.when(o.isNotNull(), F.array_compact(F.concat(F.array(o["entity_id"]), F.coalesce(o["absorbs"], F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(F.concat(F.lit("question:"), F.col("question_id"))), F.transform(ids, lambda e: F.concat(F.lit("entity:"), e)))
    return answers.select("session_id", F.col("pos").cast("int").alias("pos"), "answered_by", "question_id", "action", keys.alias("decided"))


def apply_sheets(store: Versions, batch: DataFrame, number: int, entities: DataFrame | None = None, override: bool = False) -> None:
    """One transaction: sheets without a finding, collision or conflict go to the log, numbered after what each session has there; the others are told as refused.  A session's sheets of one batch count as one."""
    if number <= store.last()["batch"]:
        return
    answers, log = parse_sheets(batch), store.read("log", LOG)
    good = entries(accepted(answers, decisions(log), override, entities))
    fresh = appended(log.select("session_id", "sequence"), good).select(*[c.split()[0] for c in LOG.split(", ")])
    refused = answers.groupBy("session_id").agg(F.count("*").alias("answers")).join(good.select("session_id").distinct(), "session_id", "left_anti")
    store.commit(number, {"log": fresh, "refused": refused})


def sheet_stream(spark: SparkSession, source: str, store: Versions, checkpoint: str, entities: DataFrame | None = None, override: bool = False) -> None:
    """Sheets (session_id, payload) that arrive as Parquet below source, until what is there is applied.  A run that is killed anywhere starts again with its checkpoint and ends as one run would have."""
    rows = spark.readStream.schema(SHEETS).parquet(source)
    q = rows.writeStream.foreachBatch(lambda batch, n: apply_sheets(store, batch, n, entities, override)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
