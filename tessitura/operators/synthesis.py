"""Labelled evaluation sets built from pools of signals: seven classes, each with its source, corruption and parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import arrays
from tessitura.functions.numeric import d
from tessitura.operators import splits

#: Whether a class should be transcribed.
CLASSES = {"clean_speech": "yes", "speech_in_noise": "yes", "speech_in_reverb": "yes", "music": "no", "stationary_noise": "no", "clipped_or_distorted": "no", "low_utility": "no"}


def uniform(seed: int, key: Column, low: float, high: float) -> Column:
    """A number between low and high from a hash, at six decimals, the same on every run."""
    return F.round(d(low) + d(high - low) * (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003)) / d(1_000_003)), 6)


def paired(left: DataFrame, right: DataFrame, seed: int, key: str = "path") -> DataFrame:
    """Each row of left with one of right (other_path, other_samples), by a hash of its key: an equi-join on right's numbers."""
    numbered = splits.rank_rows(right.withColumn("__h", splits.order_key(seed, F.col(key))), [F.col("__h"), F.col(key).cast("string")], "__n")
    n = right.count()
    if not n:
        raise ValueError("an empty pool has nothing to pair with")
    other = numbered.select(F.col("__n"), F.col(key).alias("other_path"), F.col("samples").alias("other_samples"))
    return left.withColumn("__n", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n))).join(other, "__n").drop("__n")


def build(speech: DataFrame, noise: DataFrame, rirs: DataFrame, music: DataFrame, seed: int, length: int, rate: int = 16000) -> DataFrame:
    """Label rows with samples: (path, label, should_transcribe, source, corruption_source, snr_db, generation_seed, duration_sec, samples).

    Pools have path and samples. Every row of a pool gives one row of each class that it serves; draw quotas with
    splits.per_class. All classes are expressions over arrays; pairing is the only join.
    """
    x, o = F.col("samples"), F.col("other_samples")
    fit = lambda c: arrays.trim_or_tile(c, length)
    none = F.lit(None).cast("string")
    snr = uniform(seed, F.col("path"), 0, 20)

    def rows(df: DataFrame, label: str, samples: Column, corruption: Column = none, snr_db: Column = F.lit(None).cast("double")) -> DataFrame:
        out = df.select(F.concat_ws("/", F.lit(label), F.col("path").cast("string")).alias("path"), F.lit(label).alias("label"), F.lit(CLASSES[label]).alias("should_transcribe"), F.col("path").cast("string").alias("source"), corruption.cast("string").alias("corruption_source"), snr_db.alias("snr_db"), F.lit(seed).cast("long").alias("generation_seed"), samples.cast("array<double>").alias("samples"))
        return out.withColumn("duration_sec", F.round(F.size("samples") / d(rate), 4))

    noisy, rooms = paired(speech, noise, seed + 1000), paired(speech, rirs, seed + 2000)
    parts = [
        rows(speech, "clean_speech", fit(x)),
        rows(noisy, "speech_in_noise", arrays.mix_at_snr(fit(x), fit(o), snr), F.col("other_path"), snr),
        rows(rooms, "speech_in_reverb", arrays.convolve(fit(x), o), F.col("other_path")),
        rows(music, "music", fit(x)),
        rows(noise, "stationary_noise", fit(x)),
        rows(speech, "clipped_or_distorted", arrays.clip(fit(x), 0.05)),
        rows(speech, "low_utility", arrays.low_utility(fit(x), length // 10)),
    ]
    return reduce(DataFrame.unionByName, parts)


def authoritative(pool: DataFrame, evaluation: DataFrame, quotas: dict[str, dict[str, int]], seed: int, source: str = "source", label: str = "label", key: str = "path") -> DataFrame:
    """Rows with a split: sources of the evaluation set are excluded, the others dealt to splits, each split filled by quotas of classes.

    The plan is checked before it is used: sources of splits are disjoint, and every quota is met.
    """
    left = splits.exclude(pool, evaluation, source)
    names = list(quotas)
    dealt = left.join(splits.partition(left, source, names, seed), source)
    parts = [splits.per_class(dealt.filter(F.col("split") == s), key, label, quotas[s], seed + 1000 * (i + 1)) for i, s in enumerate(names)]
    out = reduce(DataFrame.unionByName, parts)
    splits.assert_disjoint(splits.overlap(out, names, {"source": F.col(source), "path": F.col(key)}))
    return out


def first_of_source(rows: DataFrame, source: str = "source", key: str = "path") -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(source).orderBy(key))).filter("__k = 1").drop("__k")
