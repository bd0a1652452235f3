"""Voice-activity segments as windows and islands, packing of segments as a fold, chunking of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.config import Pack, Vad
from tessitura.functions.numeric import d


def active(rms: Column, zcr: Column, cfg: Vad = Vad()) -> Column:
    return (rms >= cfg.energy) & (zcr < cfg.zcr_max)


def segments(frames: DataFrame, raw: str = "raw", key: str = "path", frame: str = "frame", cfg: Vad = Vad()) -> DataFrame:
    """(key, first, stop, raw_frames): runs of activity held over cfg.hangover frames, merged over short gaps, short ones dropped.

    All windows share one partitioning and order, so there is one shuffle.
    """
    w = Window.partitionBy(key).orderBy(frame)
    held = F.max(F.col(raw).cast("int")).over(w.rowsBetween(-cfg.hangover, 0))
    on = frames.withColumn("held", held).filter("held = 1")
    gap = F.col(frame) - F.lag(frame).over(w) - 1
    # A gap of at most min_silence_frames joins what stands on both sides.
    new = F.coalesce(gap > cfg.min_silence_frames, F.lit(True)).cast("int")
    runs = on.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    out = runs.groupBy(key, "run").agg(F.min(frame).alias("first"), (F.max(frame) + 1).alias("stop"), F.sum(F.col(raw).cast("long")).alias("raw_frames"))
    return out.filter(F.col("stop") - F.col("first") >= cfg.min_speech_frames).drop("run")


def to_seconds(segs: DataFrame, n_frames: Column, cfg: Vad = Vad()) -> DataFrame:
    """Add start_sec, end_sec (within the signal), speech_ratio, frame_count."""
    hop, size = cfg.hop_ms / 1000, cfg.frame_ms / 1000
    length = F.col("stop") - F.col("first")
    end = F.least((F.col("stop") - 1) * d(hop) + d(size), (n_frames - 1) * d(hop) + d(size))
    return segs.withColumns({"start_sec": F.col("first") * d(hop), "end_sec": end, "speech_ratio": F.col("raw_frames") / length.cast("double"), "frame_count": length.cast("int")})


def pack(segs: DataFrame, key: str = "path", duration: str = "duration", cfg: Pack = Pack()) -> DataFrame:
    """(key, win, start_sec, end_sec, speech_ratio, frame_count): padded segments merged greedily up to a width, short windows extended.

    Whether a segment joins depends on how wide the window has grown, so windows cannot express it: a fold over the sorted
    array does, one file at a time.
    """
    a, b = F.col("s.start_sec"), F.col("s.end_sec")
    item = F.struct(F.greatest(d(0), a - d(cfg.pre_pad)).alias("ps"), F.least(F.col(duration), b + d(cfg.post_pad)).alias("pe"), (b - a).alias("speech"))
    per = segs.select(key, duration, F.struct("start_sec", "end_sec").alias("s")).groupBy(key, duration).agg(F.sort_array(F.collect_list(item)).alias("segs"))
    window = "array<struct<s: double, e: double, speech: double>>"
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, x: Column) -> Column:
        fresh = F.array(F.struct(x["ps"].alias("s"), x["pe"].alias("e"), x["speech"].alias("speech")))
        w = last(acc)
        joins = (F.size(acc) > 0) & (x["ps"] <= w["e"] + d(cfg.gap)) & (x["pe"] - w["s"] <= d(cfg.max_window))
        grown = F.array(F.struct(w["s"].alias("s"), F.greatest(w["e"], x["pe"]).alias("e"), (w["speech"] + x["speech"]).alias("speech")))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(F.concat(acc, fresh))

    folded = per.withColumn("wins", F.aggregate("segs", F.array().cast(window), lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(x["ps"].alias("s"), x["pe"].alias("e"), x["speech"].alias("speech")))).otherwise(step(acc, x))))
    one = folded.select(key, duration, F.posexplode("wins").alias("win", "w")).select(key, duration, "win", "w.*")
    missing = d(cfg.min_window) - (F.col("e") - F.col("s"))
    post = F.least(F.col(duration) - F.col("e"), missing / 2)
    pre = F.least(F.col("s"), missing - post)
    post2 = F.least(F.col(duration) - F.col("e"), missing - pre)
    short = missing > 0
    start = F.when(short, F.greatest(d(0), F.col("s") - pre)).otherwise(F.col("s"))
    end = F.when(short, F.least(F.col(duration), F.col("e") + post2)).otherwise(F.col("e"))
    wide = one.withColumns({"start_sec": start, "end_sec": end}).withColumn("width", F.col("end_sec") - F.col("start_sec"))
    return wide.select(key, "win", "start_sec", "end_sec", F.when(F.col("width") > 0, F.col("speech") / F.col("width")).otherwise(d(0)).alias("speech_ratio"), F.floor(F.col("width") * 1000 / 10).cast("int").alias("frame_count"))
