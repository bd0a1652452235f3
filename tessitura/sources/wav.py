"""WAV files through Spark's binaryFile reader: headers, samples, chunks; and a writer of PCM-16."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def header(raw: bytes) -> tuple[int, int, int, int, int, int] | None:
    """(format, channels, rate, bits, data offset, data bytes), or None if it is no WAV that can be read."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(raw):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if kind == EXTENSIBLE and size >= 40:
                kind = struct.unpack_from("<H", raw, at + 32)[0]
            fmt = kind, channels, rate, bits
        elif name == b"data":
            return (*fmt, at + 8, size) if fmt and fmt[1] and fmt[2] else None
        at += 8 + size + size % 2
    return None


def decode(raw: bytes) -> tuple[int, np.ndarray] | None:
    """(rate, mono float32): PCM of 8, 16, 24, 32 bits or float of 32, 64, mean over channels. None if unreadable, short or empty."""
    if (h := header(raw)) is None:
        return None
    kind, channels, rate, bits, at, size = h
    body = raw[at : at + size]
    step = bits // 8 * channels
    if not step or len(body) < size or not size or size % step:
        return None
    if kind == PCM and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif kind == PCM and bits in (16, 32):
        x = np.frombuffer(body, f"<i{bits // 8}").astype(np.float64) / 2.0 ** (bits - 1)
    elif kind == PCM and bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) ^ 0x800000) - 0x800000) / 2.0**23
    elif kind == FLOAT and bits in (32, 64):
        x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
    else:
        return None
    return rate, x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def encode(samples: np.ndarray, rate: int) -> bytes:
    """PCM-16, mono: samples times 32767, cut towards zero, held within the range."""
    x = np.clip(np.trunc(np.asarray(samples, dtype=np.float64) * 32767), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(x)) + x


def files(spark: SparkSession, folder: str, glob: str = "*.wav") -> DataFrame:
    """(path, modificationTime, length, content) of files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


@F.arrow_udf(T.StructType([T.StructField("sample_rate", T.IntegerType()), T.StructField("duration_sec", T.DoubleType()), T.StructField("channels", T.IntegerType())]))
def _info(content: pa.Array) -> pa.Array:
    out = []
    for raw in content.to_pylist():
        h = header(raw or b"")
        frame = h[3] // 8 * h[1] if h else 0
        out.append({"sample_rate": h[2], "duration_sec": round(h[5] / frame / h[2], 4), "channels": h[1]} if frame else None)
    return pa.array(out, pa.struct([("sample_rate", pa.int32()), ("duration_sec", pa.float64()), ("channels", pa.int32())]))


def audio_info(content: Column) -> Column:
    """struct(sample_rate, duration_sec to four decimals, channels) of file headers; null where it is no WAV."""
    return _info(content)


def signals(content: DataFrame, strict: bool = False) -> DataFrame:
    """(path, sample_rate, samples) of the readable files of `files()`, a batch at a time; unreadable() has the others.

    strict: an unreadable file, one cut short or one without a frame, ends the job with an error that names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (got := decode(raw or b"")) is None:
                    if strict:
                        raise ValueError(f"{path} cannot be read")
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([got[0]], pa.int32()), pa.array([got[1]], pa.list_(pa.float32()))], ["path", "sample_rate", "samples"])

    return content.select("path", "content").mapInArrow(run, "path string, sample_rate int, samples array<float>")


@F.arrow_udf(T.BooleanType())
def _readable(content: pa.Array) -> pa.Array:
    return pa.array([decode(raw or b"") is not None for raw in content.to_pylist()], pa.bool_())


def unreadable(content: DataFrame) -> DataFrame:
    """(path) of the files that signals() leaves out."""
    return content.filter(~_readable("content")).select("path")


@F.arrow_udf(T.BinaryType())
def wav_bytes(samples: pa.Array, rate: pa.Array) -> pa.Array:
    """PCM-16 files as binary values; a table of them is what a sink should keep."""
    return pa.array([encode(np.array(x if x is not None else [], dtype=np.float64), r) for x, r in zip(samples.to_pylist(), rate.to_pylist(), strict=True)], pa.binary())
