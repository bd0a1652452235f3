"""Structured Streaming: fixed and sliding chunks, sessions, per-file accumulators, and the scene history as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessitura.config import SCENES, Adaptive


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", key: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """Counts and sums by window of event time; overlapping if slide is given."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need a time with a zone
    return timed.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """Runs of a key's events with gaps below `gap`: start, stop, count, mean and maximum, emitted when the watermark passes."""
    s = F.session_window(ts, gap)
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    out = timed.withWatermark(ts, late).groupBy(s.alias("s"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n", "mean", "peak")


def dominant_scene(chunks: DataFrame, key: str = "path", cfg: Adaptive = Adaptive()) -> DataFrame:
    """(path, idx, scene, dominant) of a stream (path long, idx long, scene string): the last cfg.history labels are a key's state.

    Chunks of a micro-batch are taken in order of idx; a chunk sees only labels before it. State is a handful of labels a key.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("idx")
        out = []
        for scene in rows["scene"]:
            best = next((s for s in SCENES if seen and seen.count(s) >= cfg.dominance * len(seen)), "UNKNOWN")
            out.append(best)
            seen = [*seen, scene][-cfg.history :]
        state.update((seen,))
        yield pd.DataFrame({"path": rows["path"], "idx": rows["idx"], "scene": rows["scene"], "dominant": out})

    return chunks.select(F.col(key).alias("path"), "idx", "scene").groupBy("path").applyInPandasWithState(step, "path long, idx long, scene string, dominant string", "labels array<string>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a query over all that a bounded source has, into a table in memory: for tests and small checks."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
