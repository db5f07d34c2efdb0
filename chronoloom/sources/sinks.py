"""Writers of reports: one small JSON document at a time from the driver, or one a session from the executors."""

from __future__ import annotations

import json
import os
import textwrap
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_document(path: str, payload) -> None:
    """A JSON document that is there whole or not at all, on any file system that pyarrow opens; a path without a scheme is a local one."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    text = json.dumps(payload, ensure_ascii=False, indent=2) + "\n"
    fs, at = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), os.path.abspath(path))
    folder = os.path.dirname(at)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.part-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(text.encode())
    fs.move(part, at)


def write_files(files: DataFrame, root: str) -> None:
    """files(path, content: a string or bytes) as files below root, each there whole or not at all; a path that repeats is written once more.  root is any file system that pyarrow opens."""
    from pyspark import TaskContext

    spark = files.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    uri = fs.makeQualified(p).toString()
    base = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def write(batches):
        from pyarrow import RecordBatch
        from pyarrow.fs import FileSystem

        to, at = FileSystem.from_uri(base)
        task, n, made = TaskContext.get().taskAttemptId(), 0, set()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = f"{at}/{path}"
                folder = os.path.dirname(name)
                if folder not in made:
                    to.create_dir(folder, recursive=True)
                    if len(made) >= 10_000:
                        made.clear()
                    made.add(folder)
                part = f"{folder}/.part-{task}-{n}"
                with to.open_output_stream(part) as f:
                    f.write(content if isinstance(content, bytes) else (content or "").encode())
                to.move(part, name)
                n += 1
        yield RecordBatch.from_pydict({"n": [n]})

    files.select("path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).first()  # one number


def report_rows(df: DataFrame, key: str = "session_id") -> DataFrame:
    """Each row as a JSON document by its session."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("document"))


def write_reports(df: DataFrame, path: str, key: str = "session_id") -> None:
    report_rows(df, key).select("document").write.mode("error").text(path)


def exit_code(verdicts: DataFrame) -> int:
    """2 when something had to be withheld."""
    return 2 if verdicts.filter("state <> 'clean'").limit(1).count() else 0


def survey_parts(rows: DataFrame) -> DataFrame:
    """Rows of operators.notes.survey -> part, document: each part as JSON, put together where its rows meet; entries by their number, the largest first, and then by name.  A part is as long as what it lists."""
    entry = F.struct((-F.col("n")).alias("neg"), "name", "detail")
    g = rows.groupBy("part").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return g.select("part", F.to_json(F.transform("x", lambda e: F.struct(e["name"].alias("name"), e["detail"].alias("detail"), (-e["neg"]).alias("n")))).alias("document"))


def survey_document(files: DataFrame) -> dict:
    """The survey of files (path, content) as one document of eleven parts: eleven rows, which the executors have put together, and nothing else reach the driver."""
    from ..operators import notes as N

    found = {r["part"]: json.loads(r["document"]) for r in survey_parts(N.survey(files)).collect()}
    short = lambda x: [v for v in (x["name"], x["detail"]) if v] + [x["n"]]
    out = {part: [short(x) for x in found.get(part, [])] for part in N.PARTS}
    return {**out, "notes": sum(x[-1] for x in out["notes"]), "link_topology": {x[0]: x[1] for x in out["link_topology"]}, "stubs": [x[0] for x in out["stubs"]], "provenance_signals": sorted(x[0] for x in out["provenance_signals"])}


def wrap(text: str, width: int = 78, indent: str = "    ") -> list[str]:
    """words in lines of less than `width` characters, each indented; a longer word has a line of its own."""
    return textwrap.wrap(text, width - 1, initial_indent=indent, subsequent_indent=indent, break_long_words=False, break_on_hyphens=False)


def render(title: str, values: dict, width: int = 78) -> str:
    """A report as lines of text."""
    lines = [title, "=" * len(title)]
    for name, value in values.items():
        whole = f"{name}: {'not measured' if value is None else value}"
        lines += [whole] if len(whole) < width else [f"{name}:", *wrap(str(value), width)]
    return "\n".join(lines) + "\n"


def write_fingerprint(coarse: DataFrame, fine: DataFrame, coarse_ms: int, fine_ms: int, start_s: float, seconds: float) -> DataFrame:
    """Both series of a recording, in order and to one place, with their frame sizes and the window probed."""
    series = lambda df, n: df.groupBy("recording").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "level"))), lambda x: F.round(x["level"], 1)).alias(n))
    x = series(coarse, "coarse").join(series(fine, "fine"), "recording")
    const = [F.lit(v).alias(n) for n, v in (("coarse_frame_ms", coarse_ms), ("fine_frame_ms", fine_ms), ("fine_probe_start_seconds", start_s), ("fine_probe_seconds", seconds))]
    return x.select("recording", F.to_json(F.struct("coarse", "fine", *const)).alias("document"))
