"""Bloom filters of a bounded number of bits over long hashes, as arrays for Python tasks and as tables for joins: a first sieve, never the answer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
#: Filters have 8 bits a key, 2 MB at least and 64 MB at most, whatever the data: more keys make a filter less selective, never wrong.
BITS, MOST_BITS = 1 << 24, 1 << 29
CHUNK_BYTES, CHUNK_WORDS = 1 << 16, 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bits_for(keys: int, least: int = BITS) -> int:
    return min(MOST_BITS, max(least, 1 << (8 * keys).bit_length()))


def _places(h: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    h = h.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, HASHES + 1):
            x = (h + np.uint64(i) * _STEP) * np.uint64(0xC4CEB9FE1A85EC53)
            yield ((x ^ (x >> np.uint64(29))) % np.uint64(n_bits)).astype(np.int64)


def add(raw: np.ndarray, h: np.ndarray) -> None:
    for at in _places(h, 8 * len(raw)):
        np.bitwise_or.at(raw, at >> 3, (1 << (at & 7)).astype(np.uint8))


def may_hold(raw: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for at in _places(h, 8 * len(raw)):
        out &= ((raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def build(hashes: DataFrame, n_bits: int = BITS) -> np.ndarray:
    """The filter of the only column of hashes (long). Tasks send chunks with bits set; equal chunks are joined before they reach the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(n_bits // 8, dtype=np.uint8)
        for b in batches:
            add(raw, b.column(0).drop_null().to_numpy(zero_copy_only=False))
        own = [(i, c.tobytes()) for i in range(0, len(raw), CHUNK_BYTES) if (c := raw[i : i + CHUNK_BYTES]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([c for _, c in own], pa.binary())], ["at", "bits"])

    def either(part: pa.Table) -> pa.Table:
        bits = reduce(np.bitwise_or, (np.frombuffer(x, dtype=np.uint8) for x in part.column("bits").to_pylist()))
        return pa.table({"at": part.column("at")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    whole = np.zeros(n_bits // 8, dtype=np.uint8)
    for r in hashes.mapInArrow(fill, "at long, bits binary").groupBy("at").applyInArrow(either, "at long, bits binary").toLocalIterator():
        whole[r["at"] : r["at"] + len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)
    return whole


@dataclass(frozen=True)
class Sieve:
    """A filter as a table for joins: chunk (long), words (CHUNK_WORDS longs); chunks 0 to n_bits / 64 / CHUNK_WORDS - 1, all of them."""

    chunks: DataFrame
    n_bits: int


def sieve(keys: DataFrame) -> Sieve:
    """The filter of the only column of keys (long) with one hash and 16 bits a key, made by DataFrame functions. keys is read twice."""
    n_bits = bits_for(2 * keys.count(), 1 << 18)
    place = F.col("h").bitwiseAND(F.lit(n_bits - 1))
    own = keys.toDF("h").select(F.shiftright(place, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = keys.sparkSession.range(n_bits >> 6).join(own.groupBy("id").agg(F.bit_or("bit").alias("bits")), "id", "left")
    chunks = words.groupBy(F.floor(F.col("id") / CHUNK_WORDS).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w"))
    return Sieve(chunks.select("chunk", F.col("w.bits").alias("words")), n_bits)


def mark(rows: DataFrame, h: Column, held: Sieve, into: str) -> DataFrame:
    """Add boolean column `into`: whether the filter may hold h (long); false is certain. No Python worker is needed."""
    place = h.bitwiseAND(F.lit(held.n_bits - 1))
    chunks = F.broadcast(held.chunks.toDF("__chunk", "__words"))  # n_bits / 8 bytes, MOST_BITS / 8 at most
    bit = F.getbit(F.get("__words", F.pmod(F.shiftright(place, 6), F.lit(CHUNK_WORDS)).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.join(chunks, F.floor(place / (64 * CHUNK_WORDS)) == F.col("__chunk"), "left").withColumn(into, F.coalesce(bit, F.lit(False))).drop("__chunk", "__words")
