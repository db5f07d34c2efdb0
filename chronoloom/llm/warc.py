"""WARC archives: written, read back, and deduplicated by revisit records.

An archive holds at most `each` WARC/1.1 records, each a gzip member of its own, so that a record can be read from where it begins.  A task writes an archive under a passing name and
then moves it to a name that follows from its partition and number, so a task that runs again replaces what it left.  Archives are read as a stream by Content-Length, so payloads
may hold anything; one record and a megabyte are held at a time.  They may lie wherever both Spark and pyarrow's file systems reach.

Revisit resolution: headers alone are shuffled by payload digest; the smallest page_id of a digest is the original response.  The decisions, without payloads, go to the task that
streams their archive again and writes it with fresh headers: the others become revisit records without payload, which name the response that they refer to.

Defined results: a null payload is empty; equal payloads under `least` bytes stay responses; rows that repeat the original's page_id and payload are responses
too; a null page_id sorts last; a null url is written as an empty one; an empty table gives an empty result; other columns are not written; records of other types are copied as they are.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, documents, lean, scratch, stored, tidy

END = b"\r\n\r\n"
LEVEL = 3
RECORDS = 20_000
# Fixed values of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, at bigint, record_id string, record_type string, uri string, date string, page_id bigint, payload_digest string, payload_bytes bigint, refers_to_id string, payload binary"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*of: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5('|'.join(of).encode()).hexdigest())}>"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(rid: str, kind: str, uri: str, date: str, page: int | None, sha: str, payload: bytes, refers: tuple[str, str, str] | None = None) -> bytes:
    """A response record, or a revisit of the response `refers` (record id, uri, date)."""
    body = b"" if refers else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    if refers:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2])]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    lines = "\r\n".join(["WARC/1.1", *(f"{k}: {' '.join(v.splitlines())}" for k, v in head)])
    return b"".join((lines.encode("utf-8", "replace"), END, http, body, END))


class Archive:
    """Writes records, a gzip member each; the file has its name once it is closed."""

    def __init__(self, folder: str, name: str):
        from pyarrow.fs import FileSystem

        self.fs, at = FileSystem.from_uri(folder)
        self.passing, self.final = f"{at}/_{uuid.uuid4().hex}", f"{at}/{name}.warc.gz"
        self.out = self.fs.open_output_stream(self.passing, compression=None)

    def add(self, data: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(z.compress(data) + z.flush())

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.passing, self.final)


def located(spark: SparkSession, path: str) -> str:
    """path as a URI with its scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def folder(spark: SparkSession, path: str) -> str:
    """The URI of a folder, made if it was not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return located(spark, path)


def _inflated(uri: str) -> Iterator[bytes]:
    """What the gzip members of an archive hold, some at a time."""
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    with fs.open_input_stream(at, compression=None) as source:
        z, out, size, some = zlib.decompressobj(31), [], 0, False
        while data := source.read(1 << 18):
            some = True
            while data:
                if z.eof:
                    z = zlib.decompressobj(31)
                out.append(z.decompress(data, 1 << 20))
                size += len(out[-1])
                data = z.unused_data if z.eof else z.unconsumed_tail
                if size >= 1 << 20:
                    yield b"".join(out)
                    out, size = [], 0
        yield b"".join(out)
        if some and not z.eof:  # an archive without records is an empty file
            raise ValueError(f"{uri} ends within a gzip member")


def _records(uri: str) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Fields (by lower-case name), head and block of each record of an archive."""
    data, need = bytearray(), 0
    for chunk in _inflated(uri):
        data += chunk
        if len(data) < need:
            continue
        at = 0
        while True:
            while data.startswith(b"\r\n", at):
                at += 2
            stop = data.find(END, at)
            if stop < 0:
                need = len(data) - at + 1
                break
            head = bytes(data[at:stop])
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
            end = stop + len(END) + int(fields["content-length"])
            if len(data) < end:
                need = end - at
                break
            yield fields, head, bytes(data[stop + len(END) : end])
            at = end
        del data[:at]
    if data.strip(b"\r\n"):
        raise ValueError(f"{uri} ends within a record")


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes, str]:
    """A response's payload and its digest, held against the one in its head."""
    start = block.find(END)
    payload = block[start + len(END) :] if start >= 0 else b""
    sha, said = digest(payload), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if said and sha != said:
        raise ValueError(f"record {fields['warc-record-id']}: its payload does not have the digest in its head")
    return payload, sha


def archives(spark: SparkSession, path: str) -> DataFrame:
    """file: the archives below path, dealt to tasks one by one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    return found.repartition(max(1, found.count()))


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The response and revisit records of the archives below path; `at` numbers the records of a file."""
    lean(spark)

    def run(batches):
        names = [f.split()[0] for f in RECORD.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, size = [], 0
                for at, (f, _, block) in enumerate(_records(uri)):
                    kind = f.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    page = f.get("x-page-id")
                    if kind == "response":
                        body, sha = _payload(f, block)
                        n = len(body)
                    else:
                        body, sha, n = None, f.get("warc-payload-digest", "").removeprefix("sha1:"), None
                    rows.append((uri, at, f["warc-record-id"], kind, f.get("warc-target-uri", ""), f.get("warc-date"), int(page) if page else None, sha, n, f.get("warc-refers-to"), body if payload else None))
                    size += 500 + (n or 0) * payload
                    if size > 1 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)
        tidy()

    return archives(spark, path).mapInArrow(run, RECORD)


def originals(headers: DataFrame, least: int = 0) -> DataFrame:
    """Adds `original`, the smallest page_id with the row's digest, and the `first` record that has it (both null where payloads under `least` bytes are not merged)."""
    total = headers.count()
    merged = headers.filter((F.col("payload_bytes") >= least) & (F.col("record_type") == "response"))
    groups = merged.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "uri"))).alias("first"), F.count("*").alias("_n"))
    return attach(headers, stored(groups, "digests"), "payload_digest", "_n", total).drop("_n")


def renewed(head: bytes, fields: dict[str, str]) -> bytes:
    """A record's head with other values of some fields (names by lower case; those it lacks come last)."""
    lines, left = [], dict(fields)
    for line in head.decode("utf-8", "surrogateescape").split("\r\n"):
        name = line.partition(":")[0]
        value = left.pop(name.strip().lower(), None)
        lines.append(line if value is None else f"{name}: {value}")
    names = {"warc-refers-to": "WARC-Refers-To", "warc-refers-to-target-uri": "WARC-Refers-To-Target-URI", "warc-refers-to-date": "WARC-Refers-To-Date", "warc-date": "WARC-Date"}
    return "\r\n".join(lines + [f"{names[k]}: {' '.join(v.splitlines())}" for k, v in left.items()]).encode("utf-8", "surrogateescape")


def decisions(found: DataFrame) -> DataFrame:
    """file, at, to_id, to_uri of the records of originals() that are to be revisits: of responses with an original before them that one, of revisits the response that they refer to or, if that is one of those, its original."""
    again = F.coalesce((F.col("record_type") == "response") & (F.col("original") < F.coalesce("page_id", F.lit((1 << 63) - 1))), F.lit(False))
    responses = found.filter("record_type = 'response'")
    fate = F.when(again, F.struct(F.col("first.record_id").alias("id"), F.col("first.uri").alias("uri"))).otherwise(F.struct(F.col("record_id").alias("id"), "uri"))
    revisits = found.filter("record_type = 'revisit' and refers_to_id is not null").select("file", "at", "refers_to_id")
    wanted = revisits.groupBy("refers_to_id").agg(F.count("*").alias("_n"))
    fates = responses.select("record_id", fate.alias("to")).join(wanted, F.col("record_id") == F.col("refers_to_id")).groupBy("refers_to_id").agg(F.first("to").alias("to"), F.first("_n").alias("_n"))
    old = attach(revisits, stored(fates, "fates"), "refers_to_id", "_n", revisits.count()).filter("to is not null")
    return responses.filter(again).select("file", "at", F.col("first.record_id").alias("to_id"), F.col("first.uri").alias("to_uri")).unionByName(old.select("file", "at", F.col("to.id").alias("to_id"), F.col("to.uri").alias("to_uri")))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0) -> None:
    """Write the archives below source again below target, with revisit records for repeated payloads.

    Every archive that holds anything is written (a file of no bytes is none).  All responses get fresh ids and dates, so revisits that were there before are told the new ones; a revisit whose response is in none of the archives stays as it is.
    """
    found = stored(originals(read_archive(spark, source, False).drop("payload"), least), "headers")
    every = archives(spark, source).select("file", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("to_id"), F.lit(None).cast("string").alias("to_uri"))
    to, date = folder(spark, target), now()

    def rewrite(t: pa.Table) -> pa.Table:
        uri = t.column("file")[0].as_py()
        refers = {i: r for i, *r in zip(*(t.column(c).to_pylist() for c in ("at", "to_id", "to_uri")), strict=True) if i is not None}
        out = Archive(to, f"{hashlib.md5(uri.encode()).hexdigest()[:8]}-{os.path.basename(uri).split('.')[0]}")
        n = 0
        for n, (f, head, block) in enumerate(_records(uri), 1):
            kind, refer = f.get("warc-type"), refers.get(n - 1)
            ref = (record_id(refer[0], "response"), refer[1], date) if refer else None
            if kind == "revisit" and ref:
                said = {"warc-record-id": record_id(f["warc-record-id"], "revisit"), "warc-date": date, "warc-refers-to": ref[0], "warc-refers-to-target-uri": ref[1], "warc-refers-to-date": date}
                out.add(renewed(head, said) + END + block + END)
                continue
            if kind != "response":
                out.add(head + END + block + END)
                continue
            payload, sha = _payload(f, block)
            page, kind = f.get("x-page-id"), "revisit" if ref else "response"
            out.add(record(record_id(f["warc-record-id"], kind), kind, f.get("warc-target-uri", ""), date, int(page) if page else None, sha, payload, ref))
        out.close()
        tidy()
        return pa.table({"file": [uri], "n": [n]})

    files = every.count()
    decisions(found).unionByName(every).repartition(max(1, files), "file").groupBy("file").applyInArrow(rewrite, "file string, n bigint").agg(F.sum("n")).first()  # one number


def resolve(records: DataFrame) -> DataFrame:
    """Revisit records joined to the responses that they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    response = records.filter(F.col("record_type") == "response").groupBy("record_id").agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"))
    revisits = records.filter(F.col("record_type") == "revisit").select("page_id", "payload_digest", "refers_to_id")
    total = revisits.count()
    wanted = revisits.groupBy("refers_to_id").agg(F.count("*").alias("_n"))
    targets = wanted.join(response, wanted.refers_to_id == response.record_id).select("refers_to_id", "_page", "_bytes", "_n")
    found = attach(revisits, stored(targets, "originals"), "refers_to_id", "_n", total)
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.filter(F.col("record_type") == "response").withColumn("refers_to", F.lit(None).cast("bigint")).select(*out).unionByName(
        found.withColumn("record_type", F.lit("revisit")).select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"))
    )


def archive_pages(pages: DataFrame, path: str, each: int = RECORDS) -> None:
    """A response record per row of pages(page_id, url, html) in archives below path."""
    spark = pages.sparkSession
    lean(spark)
    to, date, run_id = folder(spark, path), now(), uuid.uuid4().hex

    def write(batches):
        from pyspark import TaskContext

        part, out, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            for page, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if n % each == 0:
                    if out:
                        out.close()
                    out = Archive(to, f"pages-{part:06d}-{n // each:06d}")
                html = html or b""
                out.add(record(record_id(run_id, str(part), str(n)), "response", url or "", date, page, digest(html), html))
                n += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()  # one number


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, kept = scratch(spark, "warc-raw"), scratch(spark, "warc-deduplicated")
    archive_pages(documents(spark, sf_dir, "pages"), raw)
    deduplicate(spark, raw, kept)
    return resolve(stored(read_archive(spark, kept, False).drop("payload"), "records"))


SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages
), digests AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM hashed
), coded AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM digests
), original AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM coded
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_page < coalesce(page_id, 9223372036854775807) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_page < coalesce(page_id, 9223372036854775807) THEN first_page END AS refers_to
FROM original
"""
