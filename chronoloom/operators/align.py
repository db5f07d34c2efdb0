"""Aligning two recordings by their loudness curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Correlations that locate and decide, frames that make a comparison, and how far copies may be apart.
SAME_R, COARSE_R, LEAST_FRAMES = 0.90, 0.30, 30
COARSE_SECONDS, FINE_SECONDS = 60.0, 3.0


def lagged(reference: DataFrame, candidate: DataFrame, most: int, key: str = "pair") -> DataFrame:
    """Frames (pair, ix, level) that meet at each lag from -most to most."""
    r = reference.select(key, F.col("ix").alias("ref_ix"), F.col("level").alias("x")).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("ix", F.col("ref_ix") + F.col("lag"))
    return r.join(candidate.select(key, "ix", F.col("level").alias("y")), [key, "ix"]).select(key, "lag", "x", "y")


def correlations(met: DataFrame, key: str = "pair") -> DataFrame:
    """Pearson's r per lag; 0 where a side is empty or flat.

    From sums of products, one pre-aggregated pass; a side is flat if its least and largest level are equal, which also keeps rounding out.
    """
    n = F.count("*").cast("double")
    s = {c: F.sum(e) for c, e in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))}
    g = met.groupBy(key, "lag").agg(F.count("*").alias("frames"), n.alias("n"), *[v.alias(f"s{k}") for k, v in s.items()], ((F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))).alias("flat"))
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = F.sqrt(F.greatest(F.lit(0.0), (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))))
    return g.select(key, "lag", "frames", F.when(F.col("flat"), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(top, bottom), F.lit(0.0))).alias("r"))


def best_lags(correlated: DataFrame, key: str = "pair", least: int = LEAST_FRAMES, places: int = 9) -> DataFrame:
    """The lag of the largest correlation over enough frames; ties go to the lowest lag."""
    ok = correlated.filter((F.col("frames") >= least) & (F.col("r") > -1)).withColumn("r", F.round("r", places))
    return ok.groupBy(key).agg(F.max_by(F.struct("lag", "r", "frames"), F.struct("r", -F.col("lag"))).alias("b")).select(key, "b.lag", "b.r", "b.frames")


def align(reference: DataFrame, candidate: DataFrame, most: int, key: str = "pair") -> DataFrame:
    return best_lags(correlations(lagged(reference, candidate, most, key), key), key)


def verdicts(coarse: DataFrame, fine: DataFrame, coarse_ms: float, fine_ms: float, probe_start_s: float, key: str = "pair") -> DataFrame:
    """Whether two recordings are one, and how far apart: the coarse pass locates, the fine one decides.  coarse(pair, lag, r, frames), fine likewise, measured from a window that begins
    FINE_SECONDS before the probe, or at zero."""
    x = coarse.join(fine.select(key, F.col("lag").alias("f_lag"), F.col("r").alias("f_r"), F.col("frames").alias("f_frames")), key, "left")
    lag_s = F.col("lag") * coarse_ms / 1000.0
    start = probe_start_s + lag_s
    head = start - F.greatest(F.lit(0.0), start - FINE_SECONDS)
    offset = lag_s - head + F.col("f_lag") * fine_ms / 1000.0
    comparable = F.col("f_frames") >= LEAST_FRAMES
    verdict = F.when(F.col("frames") < LEAST_FRAMES, "too short").when(F.col("r") < COARSE_R, "different").when(~F.coalesce(comparable, F.lit(False)), "too short").when(F.col("f_r") >= SAME_R, "same").otherwise("different")
    return x.select(key, verdict.alias("verdict"), F.when(verdict == "same", F.round(offset, 3)).alias("offset_s"))


def _series(pdf: pd.DataFrame, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels by place from `start`, and which places have one."""
    x, there = np.zeros(n), np.zeros(n)
    at = pdf["ix"].to_numpy(np.int64) - start
    x[at], there[at] = pdf["level"].to_numpy(np.float64), 1.0
    return x, there


def lag_correlations(x: np.ndarray, mx: np.ndarray, y: np.ndarray, my: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lags, frames that meet and Pearson's r at each lag from -most to most, by Fourier transforms; `mx` and `my` mark the frames that are there.  The frame at t + lag of y meets that at t of x."""
    n = 1 << int(len(x) + len(y)).bit_length()
    c = x[mx > 0].mean() if mx.any() else 0.0, y[my > 0].mean() if my.any() else 0.0  # centred, so that little is lost to rounding
    x, y = (x - c[0]) * mx, (y - c[1]) * my
    fx, fy = ({k: np.fft.rfft(v, n) for k, v in (("m", m), ("s", s), ("q", s * s))} for s, m in ((x, mx), (y, my)))
    lags = np.arange(-most, most + 1)
    lags = lags[(lags < len(y)) & (-lags < len(x))]
    met = lambda a, b: np.fft.irfft(np.conj(fx[a]) * fy[b], n)[lags % n]
    count = np.rint(met("m", "m"))
    k = np.maximum(count, 1)
    sx, sy = met("s", "m"), met("m", "s")
    vx, vy, xy = met("q", "m") - sx * sx / k, met("m", "q") - sy * sy / k, met("s", "s") - sx * sy / k
    tiny = 1e-9 * max(1.0, float((x * x).sum()) / max(1.0, float(mx.sum())), float((y * y).sum()) / max(1.0, float(my.sum()))) * k
    flat = (vx <= tiny) | (vy <= tiny)
    return lags, count.astype(np.int64), np.where(flat, 0.0, xy / np.sqrt(np.where(flat, 1.0, vx * vy)))


def align_long(reference: DataFrame, candidate: DataFrame, most: int, key: str = "pair", least: int = LEAST_FRAMES, places: int = 6) -> DataFrame:
    """A43 for long recordings: as align, but a pair's frames meet in one group and all lags are worked out at once by Fourier transforms, in n log n; a group is as large as a recording's frames."""
    kind = reference.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, lag bigint, r double, frames bigint"

    def best(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: [], "lag": [], "r": [], "frames": []})
        start = int(min(a["ix"].min(), b["ix"].min()))
        (x, mx), (y, my) = (_series(p, start, int(p["ix"].max()) - start + 1) for p in (a, b))
        lags, frames, r = lag_correlations(x, mx, y, my, most)
        r = np.where((frames >= least) & (r > -1), np.round(r, places), -2.0)
        i = int(r.argmax()) if len(r) else 0  # the lowest lag of equal ones
        if not len(r) or r[i] < -1:
            return pd.DataFrame({key: [], "lag": [], "r": [], "frames": []})
        return pd.DataFrame({key: [k[0]], "lag": [int(lags[i])], "r": [float(r[i])], "frames": [int(frames[i])]})

    # Columns of their own, as both sides may come from one table.
    two = [df.filter("ix is not null and level is not null").select(F.col(key).alias(k), F.col("ix").alias("ix"), F.col("level").alias("level")) for df, k in ((reference, key), (candidate, "_other"))]
    return two[0].groupBy(key).cogroup(two[1].groupBy("_other")).applyInPandas(best, schema)


def identity(ref_coarse: DataFrame, ref_fine: DataFrame, coarse: DataFrame, fine: DataFrame, coarse_ms: float, fine_ms: float, probe_start_s: float, probe_s: float, key: str = "pair") -> DataFrame:
    """A45 from frames (pair, ix, level; ix counts from a recording's start): the coarse series locate the candidate, and its lag says which of the candidate's fine frames are laid beside the reference's probe.

    The window begins FINE_SECONDS before the probe's place, or at zero, and is longer than the probe by twice that; lags up to twice FINE_SECONDS are tried, so that the expected one is not at the edge.
    """
    found = align_long(ref_coarse, coarse, max(1, round(COARSE_SECONDS * 1000 / coarse_ms)), key)
    located = found.filter((F.col("frames") >= LEAST_FRAMES) & (F.col("r") >= COARSE_R))
    first = F.round(F.greatest(F.lit(0.0), probe_start_s + F.col("lag") * (coarse_ms / 1000.0) - FINE_SECONDS) * 1000 / fine_ms).cast("bigint")
    length = round((probe_s + 2 * FINE_SECONDS) * 1000 / fine_ms)
    window = fine.join(located.select(key, first.alias("_first")), key).filter((F.col("ix") >= F.col("_first")) & (F.col("ix") < F.col("_first") + length)).select(key, (F.col("ix") - F.col("_first")).alias("ix"), "level")
    begin = round(probe_start_s * 1000 / fine_ms)
    probe = ref_fine.filter((F.col("ix") >= begin) & (F.col("ix") < begin + round(probe_s * 1000 / fine_ms))).select(key, (F.col("ix") - begin).alias("ix"), "level")
    decided = align_long(probe.join(located.select(key), key, "left_semi"), window, round(2 * FINE_SECONDS * 1000 / fine_ms), key)
    out = verdicts(found, decided, coarse_ms, fine_ms, probe_start_s, key)
    every = ref_coarse.select(key).distinct().join(out, key, "left")  # recordings that share too few frames for any lag
    return every.withColumn("verdict", F.coalesce("verdict", F.lit("too short")))
