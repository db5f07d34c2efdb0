"""Loudness of containers and identity of recordings against plain loops."""

import math
import random
import struct
import wave

import numpy as np
import pytest

from chronoloom.operators import align
from chronoloom.sources import pcm


def riff(tag, channels, rate, bits, body, extra=b""):
    form = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    parts = b"".join(n + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for n, x in ((b"fmt ", form), (b"LIST", extra), (b"data", body)))
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def plain_levels(values, channels, rate, frame_ms):
    mono = [sum(values[i : i + channels]) / channels for i in range(0, len(values), channels)]
    size = max(1, rate * frame_ms // 1000)
    out = []
    for i in range(0, len(mono), size):
        part = mono[i : i + size]
        power = sum(v * v for v in part) / len(part)
        out.append(max(-120.0, 10 * math.log10(power)) if power else -120.0)
    return out


def test_frames_equal_a_plain_loop(spark, tmp_path):
    rng = random.Random(2)
    want = {}

    def add(name, data, values, channels, rate):
        (tmp_path / name).write_bytes(data)
        want[name] = plain_levels(values, channels, rate, 50)

    for bits, full in ((16, 2**15), (32, 2**31)):
        ints = [rng.randrange(-full, full) // (1 if i % 400 < 200 else 10**9) for i in range(2 * 1234)]
        add(f"i{bits}.wav", riff(1, 2, 8000, bits, struct.pack(f"<{len(ints)}{'h' if bits == 16 else 'i'}", *ints), b"odd"), [v / full for v in ints], 2, 8000)
    bytes_ = [rng.randrange(256) for _ in range(777)]
    add("u8.wav", riff(1, 1, 1000, 8, bytes(bytes_)), [(v - 128) / 128 for v in bytes_], 1, 1000)
    threes = [rng.randrange(-(2**23), 2**23) for _ in range(900)]
    add("i24.wav", riff(1, 3, 4000, 24, b"".join(v.to_bytes(3, "little", signed=True) for v in threes)), [v / 2**23 for v in threes], 3, 4000)
    floats = [rng.uniform(-1, 1) for _ in range(800)]
    add("f64.wav", riff(3, 1, 4000, 64, struct.pack("<800d", *floats)), floats, 1, 4000)
    with wave.open(str(tmp_path / "std.wav"), "wb") as w:  # written by the standard library
        w.setparams((1, 2, 16000, 0, "NONE", ""))
        ints = [int(20000 * math.sin(i / 9)) for i in range(16000)]
        w.writeframes(struct.pack("<16000h", *ints))
    want["std.wav"] = plain_levels([v / 2**15 for v in ints], 1, 16000, 50)
    add("silent.wav", riff(1, 1, 1000, 16, b"\0" * 200), [0.0] * 100, 1, 1000)
    got = {}
    for r in pcm.loudness(spark, str(tmp_path), 50).orderBy("path", "ix").collect():
        assert r.finding is None
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.level)
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == pytest.approx(want[name], abs=1e-9), name


def test_bad_headers_are_findings_and_decoders_are_tried_first(spark, tmp_path):
    good = riff(1, 1, 1000, 16, b"\1\0" * 300)
    bad = {
        "a.wav": b"", "b.wav": b"OggS" + good[4:], "c.wav": good[:-5], "d.wav": riff(7, 1, 8000, 8, b"\xff" * 8), "e.wav": riff(1, 0, 8000, 16, b""), "f.wav": good[:12], "g.wav": riff(1, 1, 8000, 12, b"12"),
        "h.wav": b"RIFF" + struct.pack("<I", 20) + b"WAVE" + b"data" + struct.pack("<I", 2) + b"\0\0",
    }
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "ok.wav").write_bytes(good)
    rows = {r.path.rsplit("/", 1)[1]: r for r in pcm.loudness(spark, str(tmp_path), 1000).collect()}
    assert {k: r.finding for k, r in rows.items()} == {
        "b.wav": "not a RIFF/WAVE container", "c.wav": "chunk data ends beyond the file", "d.wav": "codec 7 of 8 bits needs a decoder", "e.wav": "no channels or no rate", "f.wav": "no format chunk",
        "g.wav": "codec 1 of 12 bits needs a decoder", "h.wav": "no format chunk", "ok.wav": None,
    }
    with pytest.raises(ValueError, match="codec 7"):
        pcm.loudness(spark, str(tmp_path), 1000, {7: lambda body, channels, bits: 1 / 0})
    with pytest.raises(ValueError, match="not a decoder"):
        pcm.loudness(spark, str(tmp_path), 1000, {"mu": len})
    half = {7: lambda body, channels, bits: np.full(len(body), 0.5)}
    got = {r.path.rsplit("/", 1)[1]: r for r in pcm.loudness(spark, str(tmp_path), 1000, half).collect()}
    assert got["d.wav"].finding is None and got["d.wav"].level == pytest.approx(20 * math.log10(0.5))


def test_lags_by_transforms_equal_plain_correlations():
    rng = np.random.default_rng(1)
    for n, m, holes in ((200, 180, 0.0), (90, 300, 0.2), (40, 40, 0.5)):
        x, y = rng.normal(-40, 9, n), rng.normal(-35, 5, m)
        mx, my = (rng.random(n) >= holes).astype(float), (rng.random(m) >= holes).astype(float)
        lags, frames, r = align.lag_correlations(x * mx, mx, y * my, my, 70)
        for lag, f, got in zip(lags.tolist(), frames.tolist(), r.tolist(), strict=True):
            t = [i for i in range(n) if 0 <= i + lag < m and mx[i] and my[i + lag]]
            assert f == len(t)
            if len(t) > 2:
                assert got == pytest.approx(np.corrcoef(x[t], y[[i + lag for i in t]])[0, 1], abs=1e-9)


def test_coarse_frames_locate_and_fine_ones_decide(spark):
    """Frames of 1 s and 100 ms from one fine series: copies that begin later or earlier, one with the opening cut off, one that is another recording, a silent and a short one."""
    rng = np.random.default_rng(7)
    base = np.repeat(rng.normal(-40, 10, 300), 10) + rng.normal(0, 3, 3000)
    copies = {1: np.concatenate((np.full(137, -90.0), base)), 2: base[84:], 3: base.copy(), 4: rng.normal(-40, 10, 3000), 5: np.full(3000, -120.0), 6: base[:200]}
    want = {1: ("same", 13.7), 2: ("same", -8.4), 3: ("same", 0.0), 4: ("different", None), 5: ("different", None), 6: ("too short", None)}
    rows = lambda k, x: [(k, i, float(v)) for i, v in enumerate(x)]
    df = lambda parts: spark.createDataFrame([r for p in parts for r in p], "pair long, ix long, level double")
    second = lambda x: x[: len(x) // 10 * 10].reshape(-1, 10).mean(1)
    got = align.identity(df(rows(k, second(base)) for k in copies), df(rows(k, base) for k in copies), df(rows(k, second(x)) for k, x in copies.items()), df(rows(k, x) for k, x in copies.items()), 1000.0, 100.0, 60.0, 30.0)
    assert {r.pair: (r.verdict, r.offset_s) for r in got.collect()} == want
