"""Views over the driver's tables that stand for chunks, files, frames, transcripts and runs, in Spark and in SQL text alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.numeric import d

#: Multipliers and offsets of the integer recipe that gives every gate reason and every scene. Fixed values.
RECIPE = ((7919, 31, 1), (104729, 37, 2), (1299709, 41, 3), (15485863, 43, 5), (32452843, 47, 7), (49979687, 53, 11), (67867967, 59, 13), (86028121, 61, 17), (982451653, 67, 19), (613651349, 71, 23))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _u(i: int) -> Column:
    a, b, c = RECIPE[i]
    return F.expr(f"cast((event_id * {a}L + user_id * {b}L + {c}L) % 997 as double) / cast(997 as double)")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (user), idx (place in time), event_id and the twelve metrics of each chunk (event)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    e = e.withColumn("idx", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    e = e.withColumns({f"u{i}": _u(i) for i in range(10)})
    c = F.col
    total = c("u6") + c("u7") + c("u8") + d(1e-9)
    return e.select(
        c("user_id").alias("path"), "idx", "event_id",
        (d(0.02) * c("u0") * c("u0")).alias("rms"), (d(0.5) + d(0.45) * c("u1")).alias("silence_ratio"), (d(0.055) * c("u2")).alias("clipping_ratio"),
        (d(800) * c("u5")).alias("zcr"), c("u4").alias("flatness"), (d(6000) * c("u9")).alias("centroid_hz"), (d(8000) * c("u1")).alias("rolloff_hz"), (d(500) * c("u2")).alias("flux"),
        (c("u6") / total).alias("band_low"), (c("u7") / total).alias("band_mid"), (c("u8") / total).alias("band_high"), c("u3").alias("active_frac"),
    )


def _u_sql(i: int) -> str:
    a, b, c = RECIPE[i]
    return f"((event_id * {a} + user_id * {b} + {c}) % 997)::DOUBLE / 997::DOUBLE AS u{i}"


METRICS_SQL = f"""
u AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, {", ".join(map(_u_sql, range(10)))} FROM events),
m AS (SELECT user_id AS path, idx, event_id, 2e-2 * u0 * u0 AS rms, 5e-1 + 4.5e-1 * u1 AS silence_ratio, 5.5e-2 * u2 AS clipping_ratio,
  8e2 * u5 AS zcr, u4 AS flatness, 6e3 * u9 AS centroid_hz, 8e3 * u1 AS rolloff_hz, 5e2 * u2 AS flux,
  u6 / (u6 + u7 + u8 + 1e-9) AS band_low, u7 / (u6 + u7 + u8 + 1e-9) AS band_mid, u8 / (u6 + u7 + u8 + 1e-9) AS band_high, u3 AS active_frac FROM u)"""


def gate_sql(rms="3e-3", border="1e-3", silence="9e-1", flat="9e-1", warn="7.2e-1", mid="1e-1") -> tuple[str, str]:
    """(decision, reason) as CASE expressions."""
    tests = [(f"rms < {border}", "FAIL", "rms_too_low"), (f"silence_ratio > {silence}", "FAIL", "high_silence_ratio"), ("clipping_ratio > 5e-2", "FAIL", "high_clipping_ratio"), ("active_frac < 1e-1", "FAIL", "low_active_frame_fraction"), (f"flatness > {flat}", "FAIL", "stationary_noise_like"), (f"flatness > {warn} AND zcr > 4e2", "FAIL", "stationary_noise_like"), (f"band_mid < {mid}", "FAIL", "weak_mid_band_speech_presence"), ("band_high > 7e-1", "FAIL", "excessive_high_band_energy"), (f"rms < {rms}", "BORDERLINE", "borderline_low_energy"), (f"flatness > {warn}", "BORDERLINE", "borderline_noisy_speech")]
    return tuple("CASE " + " ".join(f"WHEN {t[0]} THEN '{t[k]}'" for t in tests) + f" ELSE '{e}' END" for k, e in ((1, "PASS"), (2, "ok")))


def scene_sql(low="1.8e-1", high="8e-2") -> tuple[str, str]:
    """(label, confidence) as CASE expressions."""
    soft = lambda v, t, s, sign: f"least(1e0, greatest(0e0, 5e-1 + 5e-1 * tanh(3e0 * ({sign} * ({v} - {t}) / {s}))))"
    voiced = "centroid_hz BETWEEN 2e2 AND 5e3 AND band_mid >= 4e-1"
    cases = [
        ("rms < 3e-3 OR active_frac < 1.5e-1", "SILENCE", soft("rms", "3e-3", "3e-3", -1)),
        ("flatness = 0 AND centroid_hz = 0 AND band_mid = 0", "UNKNOWN", "0e0"),
        ("flatness >= 6.5e-1", "NOISE", soft("flatness", "6.5e-1", "(1 - 6.5e-1)", 1)),
        (f"flatness < 4.5e-1 AND band_low >= {low} AND band_high >= {high}", "MUSIC", f"cbrt({soft('flatness', '4.5e-1', '4.5e-1', -1)} * {soft('band_low', low, low, 1)} * {soft('band_high', high, high, 1)})"),
        (f"{voiced} AND flatness < 4e-1", "SPEECH", soft("band_mid", "4e-1", "(1 - 4e-1)", 1)),
        (voiced, "MIXED", soft("flatness", "4e-1", "(6.5e-1 - 4e-1)", 1)),
    ]
    label = "CASE " + " ".join(f"WHEN {t} THEN '{x}'" for t, x, _ in cases) + " ELSE 'UNKNOWN' END"
    return label, "CASE " + " ".join(f"WHEN {t} THEN {x}" for t, _, x in cases) + " ELSE 0e0 END"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, label, should_transcribe of each file (user): language and quality of the document with its number; no quality, no verdict."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("path")).distinct()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("label"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("should_transcribe"))
    return users.join(docs, "path", "left").join(marks, "path", "left").select("path", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("should_transcribe", F.lit("")).alias("should_transcribe"))


FILES_SQL = """
files AS (SELECT path, coalesce(lang, '') AS label, CASE WHEN quality = 1 THEN 'yes' WHEN quality IS NOT NULL THEN 'no' ELSE '' END AS should_transcribe
  FROM (SELECT DISTINCT user_id AS path FROM events) LEFT JOIN documents ON doc_id = path LEFT JOIN labels ON labels.doc_id = path)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, target and a made-up probability of each labelled document, from its number alone."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))
    p = F.expr("cast((doc_id * 7919L + 31L) % 997 as double) / cast(997 as double)")
    q = F.when(F.col("quality") == 1, F.sqrt(p)).otherwise(p * p)
    return marks.join(docs, "doc_id").select("doc_id", "label", (F.col("quality") == 1).alias("target"), q.alias("probability"))


PREDICTIONS_SQL = """
p AS (SELECT doc_id, lang AS label, quality = 1 AS target,
  CASE WHEN quality = 1 THEN sqrt(((doc_id * 7919 + 31) % 997)::DOUBLE / 997::DOUBLE) ELSE (((doc_id * 7919 + 31) % 997)::DOUBLE / 997::DOUBLE) * (((doc_id * 7919 + 31) % 997)::DOUBLE / 997::DOUBLE) END AS probability
  FROM labels JOIN documents USING (doc_id))"""
