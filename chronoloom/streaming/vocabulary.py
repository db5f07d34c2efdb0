"""T-R7 as keyed state: approvals arrive in any order and fold into entries, of which only the changed ones leave a batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.corrections import identified

APPROVAL = "kind string, canonical string, aliases array<string>, approver string, seq bigint"
CHANGED = "kind_key string, root string, version bigint, gone boolean, kind string, entry bigint, canonical string, aliases array<string>, contested boolean, approvals bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = -(1 << 62)
#: A task combines this many approvals at a time, and passes on what it holds when that is more.
ROWS = 1 << 16


class Fold(StatefulProcessor):
    """The entries of one kind: a forest over surfaces, in which a surface points to a lesser one of its entry, and at each root the entry's approvals.

    State lies in the store and is read by what a batch touches: its surfaces, their paths to their roots (shortened on the way) and those roots' approvals.  The root of an entry is its least surface, so it does
    not depend on the order in which approvals arrive, nor do the approvals kept (the greatest number of each id); a batch that is done again gives the same rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parents = handle.getMapState("parents", "surface string", "parent string")
        self.entries = handle.getMapState("entries", "root string", "approvals string")
        self.batches = handle.getValueState("batches", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        parents: dict[str, str] = {}
        moved: set[str] = set()
        entries: dict[str, dict] = {}
        changed: set[str] = set()
        gone: set[str] = set()

        def parent(s: str) -> str | None:
            if s not in parents:
                if not self.parents.containsKey((s,)):
                    return None
                parents[s] = self.parents.getValue((s,))[0]
            return parents[s]

        def point(s: str, to: str) -> None:
            if parents.get(s) != to:
                parents[s] = to
                moved.add(s)

        def find(s: str) -> str:
            path = []
            while (up := parent(s)) is not None and up != s:
                path.append(s)
                s = up
            for x in path:
                point(x, s)
            return s

        def entry(root: str) -> dict:
            if root not in entries:
                entries[root] = json.loads(self.entries.getValue((root,))[0]) if self.entries.containsKey((root,)) else {}
            return entries[root]

        for r in rows:
            roots = {find(s) for s in r.surfaces}
            root = min(roots)
            had = entry(root)
            known = had.get(r.approval_id)
            seq = NONE if r.seq is None else r.seq
            if len(roots) == 1 and known is not None and (known[0], known[1]) >= (seq, r.kind):
                continue
            for other in roots:
                if parent(other) is None:
                    point(other, other)
                if other == root:
                    continue
                had.update(entry(other))
                entries[other] = {}
                point(other, root)
                gone.add(other)
                changed.discard(other)
            known = had.get(r.approval_id)
            if known is None or (known[0], known[1]) < (seq, r.kind):
                had[r.approval_id] = [seq, r.kind, r.canonical, list(r.aliases), r.approver, list(r.surfaces)]
            changed.add(root)
            gone.discard(root)
        if not changed:
            return
        n = (self.batches.get()[0] if self.batches.exists() else 0) + 1
        self.batches.update((n,))
        for s in moved:
            self.parents.updateValue((s,), (parents[s],))
        for root in gone:
            if self.entries.containsKey((root,)):
                self.entries.removeKey((root,))
                yield Row(kind_key=key[0], root=root, version=n, gone=True, kind=None, entry=None, canonical=None, aliases=None, contested=None, approvals=None)
        for root in changed:
            self.entries.updateValue((root,), (json.dumps(entries[root]),))
            yield self._row(key[0], root, n, entries[root])

    @staticmethod
    def _row(kind_key: str, root: str, version: int, approvals: dict) -> Row:
        late = sorted(((a[0], i, a) for i, a in approvals.items()), key=lambda x: x[:2], reverse=True)
        seq, _, (_, kind, canonical, _, _, surfaces) = late[0]
        own, names, says = surfaces[0], {}, {}
        for _, _, a in late:
            says.setdefault(a[4], a[5][0])  # an approver's latest name
            for name, folded in zip((a[2], *a[3]), a[5], strict=True):
                names.setdefault(folded, name)
        aliases = [v for f, v in names.items() if f != own]
        return Row(kind_key=kind_key, root=root, version=version, gone=False, kind=kind, entry=None if seq == NONE else seq, canonical=canonical, aliases=aliases, contested=len(set(says.values())) > 1, approvals=len(approvals))

    def close(self) -> None:
        pass


def latest(batches):
    """Of the approvals of one id that a task reads, the one with the greatest number: the fold keeps no other.  What is held is bounded; ids that come again after it was passed on are passed on again."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def combined(parts: list) -> pa.Table:
        t = pa.Table.from_batches(parts)
        order = pa.table({"id": t["approval_id"], "seq": pc.fill_null(t["seq"], NONE), "kind": t["kind"], "at": pa.array(range(len(t)), pa.int64())}).sort_by([("seq", "ascending"), ("kind", "ascending")])
        return t.take(order.group_by("id", use_threads=False).aggregate([("at", "last")])["at_last"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 2 * ROWS:
            t = combined(held)
            held, n = t.combine_chunks().to_batches(), len(t)
            if n > ROWS:
                yield from held
                held, n = [], 0
    if n:
        yield from combined(held).combine_chunks().to_batches()


def approval_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """T-R7, A39: approvals arrive as Parquet below source; entries that they change are appended to target, with a version, and entries that went into another one as gone.

    Runs until what is there is read; with its checkpoint it starts again where it stopped.  A kind is a key of the state, so kinds spread over tasks and one kind's approvals are folded one after another;
    tasks combine what they read before that, so that an approval said many times reaches the fold a few times only.
    """
    rows = identified(spark.readStream.schema(APPROVAL).parquet(source))
    rows = rows.mapInArrow(latest, rows.schema)
    changed = rows.groupBy("kind_key").transformWithState(Fold(), CHANGED, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        # The batch number makes a repeated batch overwrite itself.
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        q = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def current_entries(spark: SparkSession, target: str) -> DataFrame:
    """What the stream knows: the last version of each entry that is not gone; columns as operators.corrections.vocabulary has them."""
    rows = spark.read.schema(CHANGED).parquet(target)
    last = rows.groupBy("kind_key", "root").agg(F.max_by(F.struct("gone", "kind", "entry", "canonical", "aliases", "contested", "approvals"), "version").alias("l")).filter("not l.gone")
    return last.select("kind_key", "root", "l.kind", "l.entry", "l.canonical", "l.aliases", "l.contested", "l.approvals")
