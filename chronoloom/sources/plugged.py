"""Engines as a data source: spark.read.format("engine") runs a recogniser or diariser over the recordings below a path.

An engine is whatever `engine` names as module:attribute: a callable without arguments that gives an object with preflight() and read(uri), which yields a recording's rows.  What engines have left as
artifacts is read by two that are here, `recognised` and `diarised`.

    spark.dataSource.register(EngineSource)
    spark.read.format("engine").option("engine", "recognised").option("kind", "recognised").load(path)

load() and planning call preflight() and list the recordings, so an engine that cannot run, a kind that is not known or a path without recordings fails before any task runs or anything is written.  A recording is a partition
(or `per_task` of them are), so each is read anew where its task is lost.  Rows leave as Arrow batches; a recording's are held a batch at a time.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

KINDS = {
    "recognised": "recording string, ord bigint, start_ms bigint, end_ms bigint, text string, confidence double",
    "diarised": "recording string, ord bigint, start_ms bigint, end_ms bigint, label string",
}
BATCH = 4096


def opened(uri: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(uri) if "://" in uri else (LocalFileSystem(), uri.removeprefix("file:"))


def listed(path: str, suffix: str) -> list[str]:
    """Files below path, hidden ones left out, as URIs like it."""
    from pyarrow.fs import FileSelector, FileType

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    fs, at = opened(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = fs.get_file_info(FileSelector(at, recursive=True)) if fs.get_file_info(at).type == FileType.Directory else [fs.get_file_info(at)]
    names = (f.path for f in found if f.type == FileType.File and f.path.endswith(suffix))
    return sorted(scheme + n for n in names if not any(p.startswith((".", "_")) for p in n[len(at) :].split("/")))


class Artifacts:
    """Reads what an engine has left as JSON."""

    def __init__(self, rows):
        self.rows = rows

    def preflight(self) -> None:
        pass

    def read(self, uri: str) -> Iterator[tuple]:
        fs, at = opened(uri)
        with fs.open_input_stream(at) as f:
            yield from self.rows(json.loads(f.read()))


def _recognised(doc: dict) -> Iterator[tuple]:
    for s in doc.get("transcription") or []:
        p = [t.get("p") or 0.0 for t in s.get("tokens") or [] if not str(t.get("text", "")).startswith("[_")]
        yield s["offsets"]["from"], s["offsets"]["to"], s.get("text"), math.floor(sum(p) / len(p) * 1e6 + 0.5) / 1e6 if p and None not in p else None


def _diarised(doc: dict) -> Iterator[tuple]:
    for s in doc.get("segments") or []:
        yield round(s["start"] * 1000), round(s["end"] * 1000), "SPEAKER_%02d" % s["speaker"]


def engine(name: str):
    """The engine of that name, made anew."""
    own = {"recognised": _recognised, "diarised": _diarised}.get(name)
    if own:
        return Artifacts(own)
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"engine {name!r}: neither one that is here nor module:attribute")
    made = getattr(importlib.import_module(module), attribute)()
    for need in ("preflight", "read"):
        if not callable(getattr(made, need, None)):
            raise TypeError(f"engine {name!r} has no {need}()")
    return made


def planned(options) -> list[str]:
    """The recordings that the options name, once their engine has said that it can run."""
    engine(options.get("engine", "")).preflight()
    if not options.get("path"):
        raise ValueError("the engine source needs a path")
    found = listed(options["path"], options.get("suffix", ""))
    if not found:
        raise FileNotFoundError(f"no recordings below {options['path']}")
    return found


@dataclass
class Recordings(InputPartition):
    uris: list[str]


class EngineReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names = options, [f.name for f in schema]
        self.name = options.get("engine", "")

    def partitions(self) -> list[Recordings]:
        found, each = planned(self.options), int(self.options.get("per_task", "1"))
        return [Recordings(found[i : i + each]) for i in range(0, len(found), each)]

    def read(self, partition: Recordings):
        import pyarrow as pa

        made = engine(self.name)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=self.names)

        for uri in partition.uris:
            rows = []
            for i, row in enumerate(made.read(uri)):
                rows.append((uri, i, *row))
                if len(rows) == BATCH:
                    yield self._typed(batch(rows))
                    rows = []
            if rows:
                yield self._typed(batch(rows))

    def _typed(self, batch):
        """Columns that hold nulls only have their type still."""
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
        want = [kinds[c.split()[1]] for c in KINDS[self.options["kind"]].split(", ")]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(batch.columns, want, strict=True)], names=self.names)


class EngineSource(DataSource):
    """Options: path, engine, kind (recognised or diarised: what its rows are), suffix of recordings, per_task."""

    @classmethod
    def name(cls) -> str:
        return "engine"

    def schema(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"kind {kind!r}: one of {', '.join(KINDS)}")
        planned(self.options)
        return KINDS[kind]

    def reader(self, schema: StructType) -> EngineReader:
        return EngineReader(dict(self.options), schema)
