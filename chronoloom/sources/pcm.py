"""Loudness of uncompressed recordings: RIFF/WAVE containers of linear PCM or floats, read through binaryFile; other codecs need a decoder."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOOR = -120.0
# Fixed values of the container: tags of linear PCM, floats, and of a header that names its codec further on.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
FRAMES = "path string, ix bigint, level double, finding string"


class Unreadable(Exception):
    """What is wrong with a container; a finding, not a failure."""


def chunks(data: memoryview) -> dict[bytes, memoryview]:
    """The first chunk of each name in a RIFF/WAVE container."""
    if len(data) < 12 or bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"WAVE":
        raise Unreadable("not a RIFF/WAVE container")
    found, at = {}, 12
    while at + 8 <= len(data):
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise Unreadable(f"chunk {name.decode('latin-1').strip()} ends beyond the file")
        found.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def samples(data: memoryview, decoders: dict[int, Callable[[bytes, int, int], np.ndarray]]) -> tuple[np.ndarray, float, float, int]:
    """Samples (frames by channels, as they are stored), the stored middle and full scale, and the rate: decoded where the codec has a decoder(bytes, channels, bits)."""
    found = chunks(data)
    if b"fmt " not in found or len(found[b"fmt "]) < 16:
        raise Unreadable("no format chunk")
    if b"data" not in found:
        raise Unreadable("no data chunk")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if tag == EXTENSIBLE and len(found[b"fmt "]) >= 26:
        tag = struct.unpack_from("<H", found[b"fmt "], 24)[0]
    if not channels or not rate:
        raise Unreadable("no channels or no rate")
    body = found[b"data"]
    if tag in decoders:
        return np.asarray(decoders[tag](bytes(body), channels, bits), np.float64).reshape(-1, channels), 0.0, 1.0, rate
    kind = {(PCM, 8): "u1", (PCM, 16): "<i2", (PCM, 24): "u1", (PCM, 32): "<i4", (FLOAT, 32): "<f4", (FLOAT, 64): "<f8"}.get((tag, bits))
    if kind is None:
        raise Unreadable(f"codec {tag} of {bits} bits needs a decoder")
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels]
    x = np.frombuffer(body, kind)
    if bits == 24:  # three bytes, the last one signed
        x = x.reshape(-1, 3).astype(np.int32)
        x = (x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16) ^ 0x800000
        x = x - 0x800000
    return x.reshape(-1, channels), 128.0 if (tag, bits) == (PCM, 8) else 0.0, 2.0 ** (bits - 1) if tag == PCM else 1.0, rate


def levels(x: np.ndarray, middle: float, full: float, rate: int, frame_ms: int) -> np.ndarray:
    """RMS of each frame of the mean of all channels, in dB below full scale; silence is FLOOR, and a shorter frame at the end counts.  A million samples are converted at a time."""
    size = max(1, rate * frame_ms // 1000)
    out = []
    step = max(1, (1 << 20) // size) * size
    for a in range(0, len(x), step):
        y = ((x[a : a + step].astype(np.float64) - middle) / full).mean(1)
        at = np.arange(0, len(y), size)
        power = np.add.reduceat(y * y, at) / np.diff(np.append(at, len(y)))
        with np.errstate(divide="ignore"):
            out.append(np.maximum(FLOOR, 10 * np.log10(power)))
    return np.concatenate(out) if out else np.zeros(0)


def preflight(decoders: dict) -> dict:
    """Decoders by codec tag, tried before anything is read or written: a tag must be a number, a decoder must be callable and must take an empty body."""
    for tag, decode in decoders.items():
        if not isinstance(tag, int) or not callable(decode):
            raise ValueError(f"codec {tag!r}: not a decoder")
        try:
            decode(b"", 1, 16)
        except Exception as e:
            raise ValueError(f"codec {tag}: its decoder does not run: {e}") from e
    return dict(decoders)


def loudness(spark: SparkSession, path: str, frame_ms: int = 1000, decoders: dict | None = None) -> DataFrame:
    """Recordings below path -> path, ix, level of each frame, or one row with a finding where a file cannot be read.  Files are read by Spark and measured one by one; a bad one stops nothing."""
    known = preflight(decoders or {})

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    level, finding = levels(*samples(memoryview(content.as_buffer()), known), frame_ms), None
                except Unreadable as e:
                    level, finding = None, str(e)
                n = 1 if level is None else len(level)
                none = pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.arange(n) if level is not None else [None], pa.int64()), none if level is None else pa.array(level), pa.array([finding] * n, pa.string())],
                    names=["path", "ix", "level", "finding"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, FRAMES)
