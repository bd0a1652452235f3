"""Spectral features of chunks: an Arrow UDF over whole batches (numpy's real FFT), as Spark has no FFT."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessitura.config import Frame

FIELDS = ("n_frames", "flatness_mean", "flatness_max", "centroid_mean", "centroid_median", "rolloff_mean", "flux_mean", "flux_max", "band_low", "band_mid", "band_high", "active_frac")


def describe(samples: np.ndarray, rate: int, cfg: Frame) -> np.ndarray:
    """FIELDS of one chunk. Frames without power have zero features but still count for the next frame's flux."""
    n = (len(samples) - cfg.size) // cfg.hop + 1
    if n < 1 or cfg.size & (cfg.size - 1):
        return np.zeros(len(FIELDS))
    x = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64), cfg.size)[:: cfg.hop]
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(cfg.size) / (cfg.size - 1)))
    mag = np.abs(np.fft.rfft(x * hann, axis=1))
    p = mag**2
    total = p.sum(axis=1)
    on = total >= 1e-10
    bin_hz = rate / cfg.size
    k = np.arange(p.shape[1])
    flat = np.minimum(np.exp(np.log(p + 1e-10).mean(axis=1)) / (p.mean(axis=1) + 1e-10), 1)
    centroid = (p * k).sum(axis=1) / (total + 1e-10) * bin_hz
    reached = np.cumsum(p, axis=1) >= cfg.rolloff * total[:, None]
    rolloff = np.where(reached.any(axis=1), reached.argmax(axis=1), p.shape[1] - 1) * bin_hz
    flux = np.concatenate([[0.0], ((mag[1:] - mag[:-1]) ** 2).sum(axis=1)])
    top = p.shape[1] - 1
    lo, mid = min(int(cfg.low_hz / bin_hz), top), min(int(cfg.mid_hz / bin_hz), top)
    bands = [p[:, a:b].sum(axis=1) / (total + 1e-10) for a, b in ((0, lo + 1), (lo + 1, mid + 1), (mid + 1, top + 1))]
    flat, centroid, rolloff, flux, *bands = (np.where(on, v, 0.0) for v in (flat, centroid, rolloff, flux, *bands))
    live = np.sqrt((x * x).mean(axis=1)) >= cfg.active_rms
    return np.array([n, flat.mean(), flat.max(), centroid.mean(), np.median(centroid), rolloff.mean(), flux.mean(), flux.max(), *(b.mean() for b in bands), live.mean()])


def spectral_features(rate: int, cfg: Frame = Frame()):
    """A function of an array column: struct of FIELDS. Null or short arrays give zeros."""

    @F.arrow_udf("struct<" + ", ".join(f"{f}: double" for f in FIELDS) + ">")
    def run(column: pa.Array) -> pa.Array:
        rows = [describe(np.asarray(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else np.zeros(0), rate, cfg) for v in column]
        table = np.array(rows).reshape(-1, len(FIELDS))
        return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(FIELDS))], list(FIELDS))

    return run
