"""Named queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.config import STRICT_MUSIC, Frame
from tessitura.functions import arrays, text
from tessitura.functions.numeric import d, logistic, ratio
from tessitura.operators import diagnostics, ensemble, gate, metrics, segment, spectral, splits
from tessitura.plans import views
from tessitura.plans.views import FILES_SQL, METRICS_SQL, PREDICTIONS_SQL, gate_sql, scene_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DEC, WHY = gate_sql()
LABEL, CONF = scene_sql()
STRICT, _ = scene_sql("2.5e-1", "1.2e-1")
RMS6 = ", ".join(f"avg(round({m}, 6)) AS mean_{m}, max(round({m}, 6)) AS max_{m}" for m in gate.METRICS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums of doubles depend on their order in the last places."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Signals: one array a row.

SIG = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"


@query(f"""
WITH s AS ({SIG})
SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms,
  len(list_filter(x, lambda v: abs(v) < 0.005::FLOAT::DOUBLE)) / len(x)::DOUBLE AS silence_ratio,
  len(list_filter(x, lambda v: abs(v) >= 0.99::FLOAT::DOUBLE)) / len(x)::DOUBLE AS clipping_ratio,
  len(list_filter(range(2, len(x) + 1), lambda i: (x[i - 1] >= 0) <> (x[i] >= 0))) * 16000::DOUBLE / len(x) AS zcr
FROM s""")
def signal_time_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.rms(x), 6).alias("rms"), arrays.silence_ratio(x).alias("silence_ratio"), arrays.clipping_ratio(x).alias("clipping_ratio"), arrays.zero_crossing_rate(x, 16000).alias("zcr"))


@query(f"""
WITH s AS ({SIG}), c AS (SELECT vec_id, x, unnest(range(0, len(x), 16)) AS start FROM s)
SELECT vec_id, (start / 16)::INTEGER AS idx, start::INTEGER AS start, len(x[start + 1:start + 24])::INTEGER AS n,
  round(list_sum(x[start + 1:start + 24]), 6) AS total FROM c""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks; the last are shorter."""
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.inline(arrays.chunks(F.col("embedding"), 24, 16)))
    return c.select("vec_id", "idx", "start", F.size("samples").alias("n"), F.round(arrays.total(F.col("samples")), 6).alias("total"))


@query(f"""
WITH s AS ({SIG}), f AS (SELECT vec_id, x, unnest(range(0, len(x) - 20 + 1, 10)) AS start FROM s)
SELECT vec_id, (start / 10)::INTEGER AS frame, round(sqrt(list_sum(list_transform(x[start + 1:start + 20], lambda v: v * v)) / 20), 6) AS rms,
  len(list_filter(range(2, 21), lambda i: (x[start + i - 1] >= 0) <> (x[start + i] >= 0))) * 16000::DOUBLE / 20 AS zcr FROM f""")
def signal_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames with energy and zero crossings, as voice activity needs them."""
    f = table(spark, sf_dir, "embeddings").select("vec_id", F.inline(arrays.frames(F.col("embedding"), 20, 10)))
    return f.select("vec_id", "frame", F.round(arrays.rms(F.col("samples")), 6).alias("rms"), arrays.zero_crossing_rate(F.col("samples"), 16000).alias("zcr"))


@query(f"""
WITH s AS ({SIG}), m AS (SELECT vec_id, list_transform(range(0, 32), lambda i: (x[2 * i + 1] + x[2 * i + 2]) / 2) AS mono, x FROM s),
l AS (SELECT vec_id, mono, x, list_transform(range(0, 22), lambda i: i * (16000::DOUBLE / 11025::DOUBLE)) AS spot FROM m)
SELECT vec_id, round(list_sum(mono), 6) AS mono_sum,
  round(list_sum(list_transform(spot, lambda a: mono[floor(a)::INT + 1] * (1 - (a - floor(a))) + mono[least(floor(a)::INT + 1, 31) + 1] * (a - floor(a)))), 6) AS linear_sum,
  round(list_sum(list_transform(range(0, 22), lambda i: x[i * 3 + 1])), 6) AS strided_sum,
  round(2 * list_sum(x), 6) AS repeated_sum,
  round(list_sum(list_transform(range(0, floor(64 / (16000::DOUBLE / 11025::DOUBLE))::INT), lambda i: x[least(floor(i * (16000::DOUBLE / 11025::DOUBLE))::INT, 63) + 1])), 6) AS nearest_sum
FROM l""")
def signal_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downmix of interleaved stereo; linear, strided, repeated and nearest resampling."""
    x = F.col("embedding")
    t = table(spark, sf_dir, "embeddings").withColumn("mono", arrays.downmix(x, 2))
    s = lambda c, n: F.round(arrays.total(c), 6).alias(n)
    return t.select("vec_id", s(F.col("mono"), "mono_sum"), s(arrays.resample_linear(F.col("mono"), 16000, 11025), "linear_sum"), s(arrays.resample_nearest(x, 48000, 16000), "strided_sum"), s(arrays.resample_nearest(x, 16000, 32000), "repeated_sum"), s(arrays.resample_nearest(x, 16000, 11025), "nearest_sum"))


@query(f"""
WITH s AS ({SIG}), q AS (SELECT a.vec_id, a.x AS s, b.x AS n FROM s a JOIN s b ON b.vec_id = a.vec_id + 1),
e AS (SELECT *, sqrt(list_sum(list_transform(s, lambda v: v * v)) / 64) AS es, sqrt(list_sum(list_transform(n, lambda v: v * v)) / 64) AS en FROM q),
x AS (SELECT vec_id, s, list_transform(range(1, 65), lambda i: s[i] + n[i] * (es / pow(10e0, 5e0 / 2e1) / (en + 1e-9))) AS mixed,
  list_transform(s, lambda v: greatest(-1e-1, least(1e-1, v))) AS clipped, list_transform(s, lambda v: greatest(-1e0, least(1e0, v / 2e-1)) * 2e-1) AS driven FROM e)
SELECT vec_id, round(list_sum(mixed) / greatest(1, list_max(list_transform(mixed, lambda v: abs(v)))), 6) AS mixed_sum,
  round(list_sum(clipped) / list_max(list_transform(clipped, lambda v: abs(v))), 6) AS clipped_sum, round(list_sum(driven), 6) AS driven_sum,
  round(5e-2 * list_sum(s[49:64]), 6) AS low_sum, round(list_sum(s) + list_sum(s[1:36]), 6) AS tiled_sum, round(list_sum(s), 6) AS padded_sum FROM x""")
def signal_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing at 5 dB with the next vector as noise, clipping, driving, low utility, tiling, padding."""
    t = table(spark, sf_dir, "embeddings")
    n = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("noise"))
    x = F.col("embedding")
    s = lambda c, n: F.round(arrays.total(c), 6).alias(n)
    return t.join(n, "vec_id").select("vec_id", s(arrays.mix_at_snr(x, F.col("noise"), d(5)), "mixed_sum"), s(arrays.clip(x, 0.1), "clipped_sum"), s(arrays.drive(x, 0.2), "driven_sum"), s(arrays.low_utility(x, 16), "low_sum"), s(arrays.trim_or_tile(x, 100), "tiled_sum"), s(arrays.zero_pad(x.cast("array<double>"), 80), "padded_sum"))


@query(f"""
WITH s AS ({SIG}), h AS (SELECT vec_id, x, x[1:8] AS h FROM s),
y AS (SELECT vec_id, list_transform(range(1, 65), lambda i: list_sum(list_transform(range(1, least(i, 8) + 1), lambda k: x[i - k + 1] * h[k]))) AS y FROM h)
SELECT vec_id, round(list_sum(y) / CASE WHEN list_max(list_transform(y, lambda v: abs(v))) > 1e-6 THEN list_max(list_transform(y, lambda v: abs(v))) ELSE 1 END, 6) AS reverb_sum FROM y""")
def signal_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector convolved with its own first eight samples, at peak 1."""
    x = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.total(arrays.convolve(x, F.slice(x, 1, 8))), 6).alias("reverb_sum"))


_BINS = "f.k * 500::DOUBLE"


@query(f"""
WITH s AS ({SIG}), fr AS (SELECT vec_id, x, unnest([0, 16, 32]) AS start FROM s),
w AS (SELECT vec_id, start // 16 AS frame, list_transform(range(0, 32), lambda i: x[start + i + 1] * 5e-1 * (1 - cos(2 * pi() * i / 31))) AS y,
  sqrt(list_sum(list_transform(x[start + 1:start + 32], lambda v: v * v)) / 32) AS rms FROM fr),
k AS (SELECT unnest(range(0, 17)) AS k),
f AS (SELECT vec_id, frame, rms, k, sqrt(pow(list_sum(list_transform(range(0, 32), lambda i: y[i + 1] * cos(2 * pi() * k * i / 32))), 2)
  + pow(list_sum(list_transform(range(0, 32), lambda i: y[i + 1] * sin(2 * pi() * k * i / 32))), 2)) AS mag FROM w, k),
g AS (SELECT *, mag * mag AS p, lag(mag) OVER (PARTITION BY vec_id, k ORDER BY frame) AS prev,
  sum(mag * mag) OVER (PARTITION BY vec_id, frame ORDER BY k) AS run, sum(mag * mag) OVER (PARTITION BY vec_id, frame) AS tp FROM f),
a AS (SELECT vec_id, frame, any_value(rms) AS rms, least(1, exp(avg(ln(p + 1e-10))) / (avg(p) + 1e-10)) AS flatness, sum(k * p) / (any_value(tp) + 1e-10) * 500 AS centroid,
  min(CASE WHEN run >= 8.5e-1 * tp - 1e-15 THEN k END) * 500::DOUBLE AS rolloff, coalesce(sum(pow(mag - prev, 2)), 0) AS flux,
  sum(CASE WHEN k <= 1 THEN p ELSE 0 END) / (any_value(tp) + 1e-10) AS lo, sum(CASE WHEN k > 1 AND k <= 8 THEN p ELSE 0 END) / (any_value(tp) + 1e-10) AS mi,
  sum(CASE WHEN k > 8 THEN p ELSE 0 END) / (any_value(tp) + 1e-10) AS hi FROM g GROUP BY vec_id, frame)
SELECT vec_id, count(*)::DOUBLE AS n_frames, round(avg(flatness), 6) AS flatness_mean, round(max(flatness), 6) AS flatness_max, round(avg(centroid), 6) AS centroid_mean,
  round(median(centroid), 6) AS centroid_median, round(avg(rolloff), 6) AS rolloff_mean, round(avg(flux), 6) AS flux_mean, round(max(flux), 6) AS flux_max,
  round(avg(lo), 6) AS band_low, round(avg(mi), 6) AS band_mid, round(avg(hi), 6) AS band_high, round(avg((rms >= 5e-3)::INT), 6) AS active_frac
FROM a GROUP BY vec_id""")
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32 samples every 16: window, transform, features, and their means over the vector."""
    f = table(spark, sf_dir, "embeddings").select("vec_id", spectral.spectral_features(16000, Frame(size=32, hop=16))("embedding").alias("s"))
    return rounded(f.select("vec_id", "s.*"))


# Gate, scenes, policies: chunk metrics.


@query(f"WITH {METRICS_SQL} SELECT path, idx, {DEC} AS decision, {WHY} AS reason FROM m")
def signal_gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate(views.metrics(spark, sf_dir)).select("path", "idx", "decision", "reason")


@query(f"""WITH {METRICS_SQL}, g AS (SELECT *, {DEC} AS decision FROM m)
SELECT path, {", ".join(f"round(mean_{x}, 6) AS mean_{x}, round(max_{x}, 6) AS max_{x}" for x in gate.METRICS)}, round(p, 6) AS gate_pass_frac, round(b, 6) AS gate_borderline_frac, round(f, 6) AS gate_fail_frac
FROM (SELECT path, {RMS6}, avg((decision = 'PASS')::INT) AS p, avg((decision = 'BORDERLINE')::INT) AS b, avg((decision = 'FAIL')::INT) AS f FROM g GROUP BY path)""")
def file_feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.file_features(gate.gate(views.metrics(spark, sf_dir))))


@query(f"""WITH {METRICS_SQL}, g AS (SELECT *, {DEC} AS decision FROM m)
SELECT path, count(*) AS n_chunks, CASE WHEN bool_or(decision = 'PASS') THEN 'PASS' WHEN bool_or(decision = 'BORDERLINE') THEN 'BORDERLINE' ELSE 'FAIL' END AS file_decision FROM g GROUP BY path""")
def file_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate(views.metrics(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n_chunks"), gate.file_decision(F.col("decision")).alias("file_decision"))


@query(f"WITH {METRICS_SQL} SELECT path, idx, {LABEL} AS scene, round({CONF}, 6) AS scene_confidence FROM m")
def scene_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.scenes(views.metrics(spark, sf_dir)).select("path", "idx", "scene", "scene_confidence"))


_DOM = "CASE " + " ".join(f"WHEN seen > 0 AND n_{s} >= 6e-1 * seen THEN '{s}'" for s in gate.SCENES) + " ELSE 'UNKNOWN' END"
_HIST = f"""s AS (SELECT *, {LABEL} AS scene FROM m),
h AS (SELECT *, count(scene) OVER w AS seen, {", ".join(f"count(*) FILTER (WHERE scene = '{s}') OVER w AS n_{s}" for s in gate.SCENES)} FROM s WINDOW w AS (PARTITION BY path ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
dm AS (SELECT *, {_DOM} AS dominant FROM h)"""


@query(f"WITH {METRICS_SQL}, {_HIST} SELECT path, idx, scene, dominant FROM dm")
def scene_dominant_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gate.scenes(views.metrics(spark, sf_dir))
    return s.withColumn("dominant", gate.dominant(F.col("scene"), "path", "idx")).select("path", "idx", "scene", "dominant")


_ADEC, _AWHY = gate_sql("CASE WHEN dominant = 'NOISE' THEN 3e-3 * 1.5e0 ELSE 3e-3 END", "CASE WHEN dominant = 'NOISE' THEN 3e-3 * 1.5e0 * 3.3e-1 ELSE 1e-3 END", "9e-1", "CASE WHEN dominant = 'NOISE' THEN 7e-1 ELSE 9e-1 END", "CASE WHEN dominant = 'NOISE' THEN 7e-1 * 8.5e-1 ELSE 7.2e-1 END")


@query(f"""WITH {METRICS_SQL}, {_HIST}, a AS (SELECT path, idx, scene, dominant, {_ADEC} AS decision, {_AWHY} AS reason FROM dm)
SELECT *, decision IN ('PASS', 'BORDERLINE') AND scene NOT IN ('MUSIC', 'SILENCE') AS admitted FROM a""")
def adaptive_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.adaptive_gate(views.metrics(spark, sf_dir)).select("path", "idx", "scene", "dominant", "decision", "reason", "admitted")


_FSCENE = lambda c: "CASE " + " ".join(f"WHEN bool_or({c} = '{s}') THEN '{s}'" for s in gate.PRIORITY) + " ELSE 'UNKNOWN' END"
_POLICY = f"""pc AS (SELECT path, {DEC} AS decision, {LABEL} AS scene, {CONF} AS conf, {STRICT} AS strict FROM m),
pf AS (SELECT path, CASE WHEN bool_or(decision = 'PASS') THEN 'PASS' WHEN bool_or(decision = 'BORDERLINE') THEN 'BORDERLINE' ELSE 'FAIL' END AS gate,
  coalesce(max(conf) FILTER (WHERE scene = 'MUSIC'), 0) AS music, {_FSCENE("scene")} AS file_scene, {_FSCENE("strict")} AS strict_scene FROM pc GROUP BY path),
pa AS (SELECT path, gate <> 'FAIL' AS a, gate <> 'FAIL' AND music < 7e-1 AS b, gate <> 'FAIL' AND music < 7e-1 AND file_scene <> 'SILENCE' AS c, gate <> 'FAIL' AND strict_scene <> 'MUSIC' AS d FROM pf),
pl AS (SELECT path, 'A' AS policy, a AS accepted FROM pa UNION ALL SELECT path, 'B', b FROM pa UNION ALL SELECT path, 'C', c FROM pa UNION ALL SELECT path, 'D', d FROM pa)"""


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, policy, accepted): one classification pass, unpivoted after the aggregate."""
    rows = gate.scenes(gate.scenes(gate.gate(views.metrics(spark, sf_dir))), STRICT_MUSIC, "strict")
    per = rows.groupBy("path").agg(gate.file_decision(F.col("decision")).alias("gate"), F.coalesce(F.max(F.when(F.col("scene") == "MUSIC", F.col("scene_confidence"))), d(0)).alias("music"), gate.file_scene(F.col("scene")).alias("file_scene"), gate.file_scene(F.col("strict")).alias("strict_scene"))
    a, b = F.col("gate") != "FAIL", F.col("music") < 0.7
    flags = per.select("path", a.alias("A"), (a & b).alias("B"), (a & b & (F.col("file_scene") != "SILENCE")).alias("C"), (a & (F.col("strict_scene") != "MUSIC")).alias("D"))
    return flags.unpivot("path", list("ABCD"), "policy", "accepted")


@query(f"WITH {METRICS_SQL}, {_POLICY} SELECT path, policy, accepted FROM pl")
def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policies(spark, sf_dir)


@query(f"""WITH {METRICS_SQL}, {_POLICY}, {FILES_SQL}
SELECT policy, count(*) FILTER (WHERE accepted) AS n_accept, count(*) FILTER (WHERE NOT accepted) AS n_reject,
  count(*) FILTER (WHERE accepted AND should_transcribe = 'no') AS n_fa, count(*) FILTER (WHERE NOT accepted AND should_transcribe = 'yes') AS n_fr,
  round(count(*) FILTER (WHERE accepted AND should_transcribe = 'no') / greatest(count(*) FILTER (WHERE should_transcribe = 'no'), 1)::DOUBLE, 6) AS far_admit,
  round(count(*) FILTER (WHERE NOT accepted AND should_transcribe = 'yes') / greatest(count(*) FILTER (WHERE should_transcribe = 'yes'), 1)::DOUBLE, 6) AS frr
FROM pl JOIN files USING (path) GROUP BY policy""")
def policy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _policies(spark, sf_dir).join(views.files(spark, sf_dir), "path")
    c, yes, no = F.col("accepted"), F.col("should_transcribe") == "yes", F.col("should_transcribe") == "no"
    one = F.lit(1)
    out = rows.groupBy("policy").agg(F.count_if(c).alias("n_accept"), F.count_if(~c).alias("n_reject"), F.count_if(c & no).alias("n_fa"), F.count_if(~c & yes).alias("n_fr"), ratio(F.count_if(c & no), F.greatest(F.count_if(no), one)).alias("far_admit"), ratio(F.count_if(~c & yes), F.greatest(F.count_if(yes), one)).alias("frr"))
    return rounded(out)


_ENS = ensemble.small_ensemble(6)
_XS = ["rms", "silence_ratio", "flatness", "band_low", "band_mid", "active_frac"]
_RAW = ensemble.duck_sql(_ENS, [f"({x} * 5e1)" if x == "rms" else x for x in _XS])


def _features() -> list:
    return [F.col(x) * d(50) if x == "rms" else F.col(x) for x in _XS]


@query(f"WITH {METRICS_SQL}, r AS (SELECT path, idx, {_RAW} AS raw FROM m) SELECT path, idx, round(raw, 9) + 0e0 AS raw_score, round(1 / (1 + exp(-raw)), 9) AS probability, 1 / (1 + exp(-raw)) >= 5e-1 AS admitted FROM r")
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boosted ensemble over chunk features, by the vectorised form."""
    r = views.metrics(spark, sf_dir).select("path", "idx", ensemble.score_arrow(_ENS)(F.array(*_features())).alias("raw"))
    return r.select("path", "idx", (F.round("raw", 9) + d(0)).alias("raw_score"), F.round(logistic(F.col("raw")), 9).alias("probability"), (logistic(F.col("raw")) >= 0.5).alias("admitted"))


@query(ORACLES["ensemble_score"])
def ensemble_score_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by CASE trees and a fold."""
    r = views.metrics(spark, sf_dir).select("path", "idx", ensemble.score_sql(_ENS, _features()).alias("raw"))
    return r.select("path", "idx", (F.round("raw", 9) + d(0)).alias("raw_score"), F.round(logistic(F.col("raw")), 9).alias("probability"), (logistic(F.col("raw")) >= 0.5).alias("admitted"))


@query(f"""WITH {METRICS_SQL}, r AS (SELECT path, {DEC} <> 'FAIL' AS ok, 1 / (1 + exp(-({_RAW}))) AS pr FROM m),
f AS (SELECT path, bool_or(ok) AS rule, max(pr) >= 6e-1 AS learned FROM r GROUP BY path),
x AS (SELECT path, policy, rule, learned, CASE policy WHEN 'rule' THEN rule WHEN 'learned' THEN learned ELSE rule AND learned END AS admitted FROM f, (VALUES ('rule'), ('learned'), ('hybrid')) v(policy))
SELECT path, policy, admitted, CASE WHEN admitted THEN 'none' WHEN policy = 'rule' THEN 'rule_rejected' WHEN policy = 'learned' THEN 'learned_below_threshold' WHEN NOT rule THEN 'hybrid_rule_rejected' ELSE 'hybrid_learned_rejected' END AS rejection FROM x""")
def admission_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.gate(views.metrics(spark, sf_dir)).withColumn("pr", logistic(ensemble.score_sql(_ENS, _features())))
    f = rows.groupBy("path").agg(F.bool_or(F.col("decision") != "FAIL").alias("rule"), (F.max("pr") >= 0.6).alias("learned"))
    x = f.withColumn("policy", F.explode(F.array(*map(F.lit, ("rule", "learned", "hybrid")))))
    return x.withColumn("a", gate.admission(F.col("policy"), F.col("rule"), F.col("learned"))).select("path", "policy", "a.admitted", "a.rejection")


# Segments.

_RAWF = f"fr AS (SELECT path, idx AS frame, rms * 2 >= 5e-3 AND zcr * 4 < 3e3 AND idx % 97 < 60 AS raw FROM m)"
_VAD = f"""{_RAWF},
hd AS (SELECT *, max(raw::INT) OVER (PARTITION BY path ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS held FROM fr),
ga AS (SELECT *, frame - lag(frame) OVER (PARTITION BY path ORDER BY frame) - 1 AS gap FROM hd WHERE held = 1),
ru AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY frame) AS run FROM ga),
sg AS (SELECT path, min(frame) AS first, max(frame) + 1 AS stop, sum(raw::INT)::BIGINT AS raw_frames FROM ru GROUP BY path, run HAVING max(frame) + 1 - min(frame) >= 20)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    return m.select("path", F.col("idx").alias("frame"), (segment.active(F.col("rms") * 2, F.col("zcr") * 4) & (F.col("idx") % 97 < 60)).alias("raw"))


@query(f"WITH {METRICS_SQL}, {_VAD} SELECT * FROM sg")
def vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments(_frames(spark, sf_dir)).select("path", "first", "stop", "raw_frames")


@query(f"""WITH RECURSIVE {METRICS_SQL}, {_VAD},
du AS (SELECT path, (max(frame) + 1) * 1e-2 AS duration FROM fr GROUP BY path),
sp AS (SELECT sg.path, du.duration, row_number() OVER (PARTITION BY sg.path ORDER BY first) AS k, greatest(0e0, first * 1e-2 - 2e-1) AS ps, least(duration, stop * 1e-2 + 3e-1) AS pe, stop * 1e-2 - first * 1e-2 AS speech FROM sg JOIN du USING (path)),
pk AS (SELECT path, duration, k, 0 AS win, ps AS s, pe AS e, speech FROM sp WHERE k = 1
  UNION ALL SELECT n.path, n.duration, n.k, CASE WHEN n.ps <= pk.e + 6e-1 AND n.pe - pk.s <= 7e0 THEN pk.win ELSE pk.win + 1 END,
    CASE WHEN n.ps <= pk.e + 6e-1 AND n.pe - pk.s <= 7e0 THEN pk.s ELSE n.ps END, CASE WHEN n.ps <= pk.e + 6e-1 AND n.pe - pk.s <= 7e0 THEN greatest(pk.e, n.pe) ELSE n.pe END,
    CASE WHEN n.ps <= pk.e + 6e-1 AND n.pe - pk.s <= 7e0 THEN pk.speech + n.speech ELSE n.speech END FROM pk JOIN sp n ON n.path = pk.path AND n.k = pk.k + 1),
wi AS (SELECT path, duration, win, max_by(s, k) AS s, max_by(e, k) AS e, max_by(speech, k) AS speech FROM pk GROUP BY path, duration, win),
ex AS (SELECT *, 1.5e0 - (e - s) AS miss, least(duration - e, (1.5e0 - (e - s)) / 2) AS post FROM wi),
ey AS (SELECT *, least(s, miss - post) AS pre FROM ex),
ez AS (SELECT path, win, speech, CASE WHEN miss > 0 THEN greatest(0e0, s - pre) ELSE s END AS start_sec, CASE WHEN miss > 0 THEN least(duration, e + least(duration - e, miss - pre)) ELSE e END AS end_sec FROM ey)
SELECT path, win, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, round(CASE WHEN end_sec > start_sec THEN speech / (end_sec - start_sec) ELSE 0 END, 6) AS speech_ratio FROM ez""")
def vad_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments padded, merged greedily and extended; the signal's length is its frames times 10 ms."""
    frames = _frames(spark, sf_dir)
    length = frames.groupBy("path").agg(((F.max("frame") + 1) * d(0.01)).alias("duration"))
    segs = segment.segments(frames).join(length, "path").select("path", "duration", (F.col("first") * d(0.01)).alias("start_sec"), (F.col("stop") * d(0.01)).alias("end_sec"))
    return rounded(segment.pack(segs).drop("frame_count"))


@query(f"""WITH {METRICS_SQL}, {_VAD}, {FILES_SQL},
v AS (SELECT path, sum(stop - first) * 1e-2 AS kept, count(*) AS segs FROM sg GROUP BY path),
a AS (SELECT path, count(*) * 1e-2 AS audio FROM fr GROUP BY path)
SELECT coalesce(label, 'TOTAL') AS label, count(*) AS n_files, sum(greatest(1, ceil(audio / 5e-1)))::BIGINT AS n_fixed, coalesce(sum(segs), 0)::BIGINT AS n_segments,
  round(sum(audio), 6) AS audio_sec, round(coalesce(sum(kept), 0), 6) AS vad_sec, round(100 * (sum(audio) - coalesce(sum(kept), 0)) / sum(audio), 6) AS removed_pct
FROM files JOIN a USING (path) LEFT JOIN v USING (path) GROUP BY ROLLUP (label)""")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed chunks against segments, by label and in total."""
    frames = _frames(spark, sf_dir)
    audio = frames.groupBy("path").agg((F.count("*") * d(0.01)).alias("audio"))
    kept = segment.segments(frames).groupBy("path").agg((F.sum(F.col("stop") - F.col("first")) * d(0.01)).alias("kept"), F.count("*").alias("segs"))
    rows = views.files(spark, sf_dir).join(audio, "path").join(kept, "path", "left")
    out = rows.rollup("label").agg(F.count("*").alias("n_files"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("audio") / d(0.5)))).cast("long").alias("n_fixed"), F.coalesce(F.sum("segs"), F.lit(0)).cast("long").alias("n_segments"), F.sum("audio").alias("audio_sec"), F.coalesce(F.sum("kept"), d(0)).alias("vad_sec"))
    return rounded(out.withColumn("removed_pct", 100 * (F.col("audio_sec") - F.col("vad_sec")) / F.col("audio_sec")).withColumn("label", F.coalesce("label", F.lit("TOTAL"))))


@query(f"""WITH {METRICS_SQL} SELECT path, idx // 5 AS chunk, count(*) AS n, min(idx) AS first, round(avg(rms), 6) AS mean_rms FROM m GROUP BY path, idx // 5""")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed chunks of an ordered stream."""
    m = views.metrics(spark, sf_dir).withColumn("chunk", F.floor(F.col("idx") / 5).cast("long"))
    return rounded(m.groupBy("path", "chunk").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.avg("rms").alias("mean_rms")))


# Metrics and sweeps.

_RATES = """round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 4) AS far, round(coalesce(fn / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS frr, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall, round(coalesce(2 * (tp / nullif(tp + fp, 0)::DOUBLE) * (tp / nullif(tp + fn, 0)::DOUBLE) / nullif((tp / nullif(tp + fp, 0)::DOUBLE) + (tp / nullif(tp + fn, 0)::DOUBLE), 0), 0), 4) AS f1"""
_COUNTS = lambda said: f"count(*) FILTER (WHERE target AND {said}) AS tp, count(*) FILTER (WHERE NOT target AND {said}) AS fp, count(*) FILTER (WHERE NOT target AND NOT ({said})) AS tn, count(*) FILTER (WHERE target AND NOT ({said})) AS fn"
_STEPS = [round(0.1 * i, 1) for i in range(1, 10)]
_SWEEP = f"t AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _STEPS)}]) AS threshold), w AS (SELECT threshold, {_COUNTS('probability >= threshold')} FROM p, t GROUP BY threshold), sw AS (SELECT threshold, tp, fp, tn, fn, {_RATES} FROM w)"


@query(f"WITH {PREDICTIONS_SQL}, w AS (SELECT coalesce(label, 'ALL') AS label, {_COUNTS('probability >= 3e-1')} FROM p GROUP BY GROUPING SETS ((), (label))) SELECT label, tp, fp, tn, fn, {_RATES} FROM w")
def confusion_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.confusion(views.predictions(spark, sf_dir), F.col("target"), F.col("probability") >= 0.3, "label")
    return out.withColumn("label", F.coalesce("label", F.lit("ALL")))


@query(f"WITH {PREDICTIONS_SQL}, {_SWEEP} SELECT * FROM sw")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(views.predictions(spark, sf_dir), F.col("target"), F.col("probability"), _STEPS)


@query(f"WITH {PREDICTIONS_SQL}, {_SWEEP} SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1(threshold_sweep(spark, sf_dir))


@query(f"WITH {PREDICTIONS_SQL}, {_SWEEP} SELECT * FROM sw ORDER BY frr <= round(5e-2 + 2e-2, 4) DESC, CASE WHEN frr <= round(5e-2 + 2e-2, 4) THEN -f1 ELSE frr END, threshold LIMIT 1")
def conservative_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.conservative(threshold_sweep(spark, sf_dir), 0.05)


def _grid_values(name: str) -> str:
    from tessitura import config

    return ", ".join(f"{v}::DOUBLE" for v in getattr(config, name))


_CDEC, _ = gate_sql("g_rms", "1e-3", "g_silence", "g_flatness", "g_warn", "g_mid")
_GRID = f"""gr AS (SELECT row_number() OVER (ORDER BY ri, fi, mi, si) - 1 AS config, g_rms, g_flatness, g_mid, g_silence, round(g_flatness * 8e-1, 4) AS g_warn FROM
  (SELECT unnest([{_grid_values("GRID_RMS")}]) AS g_rms, unnest(range(6)) AS ri), (SELECT unnest([{_grid_values("GRID_FLATNESS")}]) AS g_flatness, unnest(range(7)) AS fi),
  (SELECT unnest([{_grid_values("GRID_BAND_MID")}]) AS g_mid, unnest(range(6)) AS mi), (SELECT unnest([{_grid_values("GRID_SILENCE")}]) AS g_silence, unnest(range(4)) AS si)),
gc AS (SELECT config, path, {_CDEC} AS dec FROM m, gr), gf AS (SELECT config, path, bool_or(dec = 'PASS') AS pass, bool_or(dec = 'BORDERLINE') AS border FROM gc GROUP BY config, path),
gs AS (SELECT config, count(*) FILTER (WHERE pass) AS n_pass, count(*) FILTER (WHERE NOT pass AND border) AS n_borderline, count(*) FILTER (WHERE NOT pass AND NOT border) AS n_fail,
  count(*) FILTER (WHERE pass AND should_transcribe = 'no') AS n_fa, count(*) FILTER (WHERE NOT pass AND NOT border AND should_transcribe = 'yes') AS n_fr,
  count(*) FILTER (WHERE should_transcribe = 'no') AS nn, count(*) FILTER (WHERE should_transcribe = 'yes') AS ny, count(*) AS n FROM gf JOIN files USING (path) GROUP BY config),
gx AS (SELECT config, g_rms, g_flatness, g_mid, g_silence, n_pass, n_borderline, n_fail, n_fa, n_fr, n_fa / greatest(nn, 1)::DOUBLE AS far, n_fr / greatest(ny, 1)::DOUBLE AS frr,
  (n_pass + n_borderline) / greatest(n, 1)::DOUBLE AS accept_rate, n_fa / greatest(nn, 1)::DOUBLE + 5e-1 * (n_fr / greatest(ny, 1)::DOUBLE) AS cost FROM gs JOIN gr USING (config))"""
_GX = "config::INTEGER AS config, g_rms, g_flatness, g_mid, g_silence, n_pass, n_borderline, n_fail, n_fa, n_fr, round(far, 6) AS far, round(frr, 6) AS frr, round(accept_rate, 6) AS accept_rate, round(cost, 6) AS cost"


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibrate(views.metrics(spark, sf_dir), views.files(spark, sf_dir))


@query(f"WITH {METRICS_SQL}, {FILES_SQL}, {_GRID} SELECT {_GX} FROM gx")
def gate_grid_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,008 configurations; chunks are reduced to cells of the grid before they meet it."""
    return rounded(_calibrated(spark, sf_dir))


@query(f"WITH {METRICS_SQL}, {FILES_SQL}, {_GRID} SELECT {_GX} FROM gx ORDER BY gx.cost, gx.config LIMIT 10")
def grid_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_calibrated(spark, sf_dir).orderBy("cost", "config").limit(10))


@query(f"""WITH {METRICS_SQL}, {FILES_SQL}, {_GRID}, be AS (SELECT * FROM gx ORDER BY cost, config LIMIT 1), ba AS (SELECT * FROM gx WHERE g_rms = 3e-3 AND g_flatness = 9e-1 AND g_mid = 1e-1 AND g_silence = 9e-1)
SELECT be.config::INTEGER AS config, round(be.far - ba.far, 6) AS far_delta, round(be.frr - ba.frr, 6) AS frr_delta, round(be.cost - ba.cost, 6) AS cost_delta FROM be, ba""")
def calibration_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best configuration against the default one, in one pass over the 1,008 rows."""
    c = F.col
    base = (c("g_rms") == 0.003) & (c("g_flatness") == 0.90) & (c("g_mid") == 0.10) & (c("g_silence") == 0.90)
    cols = ("far", "frr", "cost")
    one = _calibrated(spark, sf_dir).agg(F.min_by(F.struct("config", *cols), F.struct("cost", "config")).alias("best"), *[F.max(F.when(base, c(x))).alias(f"base_{x}") for x in cols])
    return rounded(one.select(c("best.config").alias("config"), *[(c(f"best.{x}") - c(f"base_{x}")).alias(f"{x}_delta") for x in cols]))


_SDEC, _ = gate_sql("r", "r * 3.3e-1", "9.5e-1", "f", "f * 8e-1")
_TWO = f"""rg AS (SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in metrics.SWEEP_RMS)}]) AS r, unnest(range(6)) AS ri), fg AS (SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in metrics.SWEEP_FLATNESS)}]) AS f, unnest(range(8)) AS fi),
x AS (SELECT ri * 8 + fi AS cell, r AS rms_min, f AS flatness_max, {_SDEC} AS dec FROM m, rg, fg),
y AS (SELECT cell, rms_min, flatness_max, count(*) AS n, count(*) FILTER (WHERE dec = 'PASS') AS np, count(*) FILTER (WHERE dec = 'BORDERLINE') AS nb FROM x GROUP BY ALL),
z AS (SELECT cell::INTEGER AS cell, rms_min, flatness_max, round((np + nb) / n::DOUBLE, 6) AS accept_rate, round(np / n::DOUBLE, 6) AS pass_share, round(nb / n::DOUBLE, 6) AS border_share, round((n - np - nb) / n::DOUBLE, 6) AS fail_share,
  round(5e-2 * ((np + nb) / n::DOUBLE / 9e-1), 6) AS estim_rtf, round(greatest(0, 1 - (np + nb) / n::DOUBLE / 9e-1) * 100, 6) AS saved_pct, CASE WHEN (np + nb) / n::DOUBLE < 2.5e-1 THEN 'low_accept' ELSE 'ok' END AS flag FROM y)"""


@query(f"WITH {METRICS_SQL}, {_TWO} SELECT * FROM z")
def rms_flatness_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.two_way_sweep(views.metrics(spark, sf_dir), 0.05, 0.9, 0.25))


@query(f"WITH {METRICS_SQL}, {_TWO} SELECT * FROM z WHERE flag = 'ok' ORDER BY saved_pct DESC, cell LIMIT 1")
def recommended_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recommended(rounded(metrics.two_way_sweep(views.metrics(spark, sf_dir), 0.05, 0.9, 0.25)))


# Transcripts.

_NORM = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_'']+', ' ', 'g'))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, ref, hyp): the words of a turn against those of the next, by number of the turn."""
    c = table(spark, sf_dir, "conversations").withColumn("w", text.words(text.normalise(F.coalesce("text", F.lit("")))))
    a = c.select("conv_id", "turn", "role", F.col("w").alias("ref"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("hyp"))
    return a.join(b, ["conv_id", "turn"])


# Rows of the distance table one after the other; a row's least sums to the left come from its values less their places.
_ALIGN = """q AS (SELECT a.conv_id, a.turn, a.role, a.w AS ref, b.w AS hyp FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
r AS (SELECT conv_id, turn, role, ref, hyp, 0::BIGINT AS i, range(0, len(hyp) + 1) AS line FROM q
  UNION ALL SELECT conv_id, turn, role, ref, hyp, i + 1, list_transform(range(1, len(less) + 1), lambda k: list_min(less[1:k]) + k)
  FROM (SELECT *, list_concat([i], list_transform(range(1, len(hyp) + 1), lambda j: least(line[j + 1] + 1, line[j] + (hyp[j] <> ref[i + 1])::BIGINT) - j - 1)) AS less FROM r WHERE i < len(ref))),
e AS (SELECT conv_id, turn, role, len(ref) AS n_ref, CASE WHEN len(ref) = 0 THEN 0 ELSE line[len(line)] END AS errors FROM r WHERE i = len(ref))"""
_PAIR = f"""n AS (SELECT conv_id, turn, role, {_NORM("coalesce(text, '')")} AS t FROM conversations),
c AS (SELECT conv_id, turn, role, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM n),
{_ALIGN}"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_pairs with n_ref and the kinds of errors; a pair without reference words has none."""
    p = _pairs(spark, sf_dir).withColumn("a", text.alignment("ref", "hyp")).withColumn("n_ref", F.size("ref"))
    return p.withColumn("errors", F.when(F.col("n_ref") > 0, F.col("a.substitutions") + F.col("a.deletions") + F.col("a.insertions")).otherwise(0))


@query(f"WITH RECURSIVE {_PAIR} SELECT conv_id, turn, n_ref::INTEGER AS n_ref, errors::INTEGER AS errors, CASE WHEN n_ref = 0 THEN 0 ELSE round(errors / n_ref::DOUBLE, 6) END AS wer, n_ref = 0 AS skipped FROM e")
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of whole turns; without reference words a pair is skipped."""
    n = F.col("n_ref")
    return rounded(_errors(spark, sf_dir).select("conv_id", "turn", "n_ref", "errors", ratio(F.col("errors"), n).alias("wer"), (n == 0).alias("skipped")))


@query(f"""WITH RECURSIVE {_PAIR} SELECT role, count(*) FILTER (WHERE n_ref > 0) AS scored, count(*) FILTER (WHERE n_ref = 0) AS skipped, sum(n_ref)::BIGINT AS n_ref, sum(errors)::BIGINT AS errors,
  CASE WHEN sum(n_ref) = 0 THEN 0 ELSE round(sum(errors) / sum(n_ref)::DOUBLE, 6) END AS wer FROM e GROUP BY role""")
def wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report by role: pairs scored and skipped, errors summed over words summed."""
    n, e = F.sum("n_ref").cast("long"), F.sum("errors").cast("long")
    out = _errors(spark, sf_dir).groupBy("role").agg(F.count_if(F.col("n_ref") > 0).alias("scored"), F.count_if(F.col("n_ref") == 0).alias("skipped"), n.alias("n_ref"), e.alias("errors"), ratio(e, n).alias("wer"))
    return rounded(out)


@query(f"SELECT conv_id, turn, {_NORM('text')} AS norm FROM conversations")
def wer_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts of all turns; null stays null."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalise(F.col("text")).alias("norm"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations WHERE text <> '' GROUP BY conv_id""")
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("text <> ''")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("transcript"))


@query("""WITH r AS (SELECT conv_id AS idx, text FROM conversations WHERE turn = 0), h AS (SELECT conv_id + 5 AS idx, text FROM conversations WHERE turn = 1)
SELECT idx, coalesce(r.text, '') AS ref, coalesce(h.text, '') AS hyp FROM r FULL JOIN h USING (idx)""")
def ref_hyp_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and hypotheses by chunk number, missing ones empty."""
    c = table(spark, sf_dir, "conversations")
    r = c.filter("turn = 0").select(F.col("conv_id").alias("idx"), F.col("text").alias("ref"))
    h = c.filter("turn = 1").select((F.col("conv_id") + 5).alias("idx"), F.col("text").alias("hyp"))
    return r.join(h, "idx", "full").select("idx", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp"))


# Identities, splits, leaks.

_H = lambda seed, k: f"sha256('{seed}:' || {k}::VARCHAR)"


@query(f"WITH d AS (SELECT source, row_number() OVER (ORDER BY {_H(17, 'source')}, source) - 1 AS k FROM (SELECT DISTINCT source FROM documents)) SELECT source, ['train', 'validation', 'test'][k % 3 + 1] AS split FROM d")
def deterministic_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.partition(table(spark, sf_dir, "documents"), "source", ["train", "validation", "test"], 17)


@query(f"""WITH d AS (SELECT source, row_number() OVER (ORDER BY {_H(42, 'source')}, source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN k < floor(n * 6e-1) THEN 'train' ELSE 'eval' END AS split FROM documents JOIN d USING (source)""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.6, 42)


@query(f"""WITH s AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM documents),
l AS (SELECT DISTINCT split, dimension, value FROM (SELECT split, 'source' AS dimension, source AS value FROM s UNION ALL SELECT split, 'content', sha256(text) FROM s UNION ALL SELECT split, 'prefix', left(text, 12) FROM s UNION ALL SELECT split, 'path', doc_id::VARCHAR FROM s) WHERE value IS NOT NULL),
n AS (SELECT * FROM (VALUES ('test', 'train'), ('test', 'validation'), ('train', 'validation')) v(left_split, right_split), (VALUES ('source'), ('content'), ('prefix'), ('path')) x(dimension)),
o AS (SELECT a.split AS left_split, b.split AS right_split, dimension, value FROM l a JOIN l b USING (dimension, value) WHERE a.split < b.split)
SELECT left_split, right_split, dimension, count(value) AS n, coalesce(array_to_string(list_sort(list(value) FILTER (WHERE value IS NOT NULL))[1:5], '|'), '') AS examples FROM n LEFT JOIN o USING (left_split, right_split, dimension) GROUP BY ALL""")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that splits share, by dimension, with the first five."""
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "validation").otherwise("test"))
    dims = {"source": F.col("source"), "content": F.sha2("text", 256), "prefix": F.substr("text", F.lit(1), F.lit(12)), "path": F.col("doc_id")}
    return splits.overlap(docs, ["train", "validation", "test"], dims).withColumn("examples", F.array_join("examples", "|"))


@query("""SELECT doc_id, left(sha256('{"corruption_source":"","duration_sec":' || coalesce(((n_chars / 8::DOUBLE)::DOUBLE)::VARCHAR, 'null') || ',"generation_params":{' || CASE WHEN doc_id % 2 = 0 THEN '"doc":"' || doc_id || '","kind":"text"' ELSE '' END
  || '},"label":"' || coalesce(lang, '') || '","rir_id":"","sample_rate":16000,"snr_db":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE (doc_id % 40)::DOUBLE::VARCHAR END || ',"source":"' || coalesce(source, '') || '"}'), 24) AS stable_id FROM documents""")
def example_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of all documents as examples of eight fields, nulls among them."""
    k, none = F.col("doc_id"), F.lit(None)
    params = F.when(k % 2 == 0, F.create_map(F.lit("kind"), F.lit("text"), F.lit("doc"), k.cast("string")))
    json = text.example_json(F.col("lang"), F.col("source"), none.cast("string"), F.when(k % 3 != 0, (k % 40).cast("double")), none.cast("string"), params, F.col("n_chars") / d(8), F.lit(16000))
    return table(spark, sf_dir, "documents").select("doc_id", text.example_id(json).alias("stable_id"))


@query(f"SELECT doc_id FROM documents ORDER BY {_H(7, 'doc_id')}, doc_id LIMIT 25")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 25 rows by a seeded hash."""
    return splits.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25, 7)


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H(11, 'doc_id')}, doc_id) AS k FROM documents WHERE lang IN ('en', 'de', 'fr')) WHERE k <= CASE lang WHEN 'en' THEN 12 WHEN 'de' THEN 6 ELSE 4 END")
def class_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: a quota of each class."""
    return splits.per_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", {"en": 12, "de": 6, "fr": 4}, 11)


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0)")
def exclusion_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources that an evaluation set does not use; the set is a tenth of the sources or so."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.exclude(docs, docs.filter("doc_id % 50 = 0"), "source").select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existence_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.existing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH p AS (SELECT 1 AS pool, source AS id, doc_id AS n FROM documents UNION ALL SELECT 2, url, page_id FROM pages UNION ALL SELECT 3, source, doc_id + 1000000 FROM documents)
SELECT id, pool, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pool, n) AS k FROM p) WHERE k = 1""")
def pool_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools put together; of equal identities the first stays."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    one = docs.select(F.lit(1).alias("pool"), F.col("source").alias("id"), F.col("doc_id").alias("n"))
    two = pages.select(F.lit(2).alias("pool"), F.col("url").alias("id"), F.col("page_id").alias("n"))
    three = docs.select(F.lit(3).alias("pool"), F.col("source").alias("id"), (F.col("doc_id") + 1000000).alias("n"))
    return splits.first_by(one.unionByName(two).unionByName(three), ["id"], ["pool", "n"])


@query("SELECT DISTINCT a.source FROM documents a WHERE a.lang = 'en' AND a.source IN (SELECT source FROM documents WHERE lang = 'de')")
def source_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter("lang = 'en'").select("source").intersect(docs.filter("lang = 'de'").select("source"))


@query("SELECT doc_id, lang, k FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 5")
def first_n_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the first five of each label."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter("k <= 5")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, count(DISTINCT sha256(text)) AS n_texts, sum(n_chars)::BIGINT AS chars, round(sum(n_chars) / 3600::DOUBLE, 6) AS hours FROM documents GROUP BY source")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, classes, distinct identities and totals of each split."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    return rounded(rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs"), F.countDistinct("h").alias("n_texts"), F.sum("n_chars").alias("chars"), (F.sum("n_chars") / d(3600)).alias("hours")))


@query("""WITH p AS (SELECT page_id, '/mnt/' || regexp_replace(url, '^[a-z]+://', '') AS q FROM pages),
f AS (SELECT page_id, list_reduce(list_concat([[]::VARCHAR[]], list_transform(list_filter(string_split(q, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])),
  lambda a, b: CASE WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END) AS parts FROM p),
c AS (SELECT page_id, '/' || array_to_string(parts, '/') AS clean FROM f)
SELECT page_id, CASE WHEN instr(clean, 'data/raw/') > 0 THEN substr(clean, instr(clean, 'data/raw/')) WHEN starts_with(clean, '/mnt/') THEN 'data/raw/' || substr(clean, 6) END AS source_id FROM c""")
def canonical_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths under a physical root named by their logical root; null where `..` leads out of it."""
    q = F.concat(F.lit("/mnt/"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_source(q, {"/mnt": "data/raw"}).alias("source_id"))


@query("""WITH f AS (SELECT p_partkey AS id, 'models/ggml-' || replace(lower(p_name), ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '-q5_1' WHEN 1 THEN '-q8_0' ELSE '' END || CASE p_partkey % 2 WHEN 0 THEN '__opt__' ELSE '' END || '.bin' AS f FROM part)
SELECT id, regexp_replace(regexp_replace(regexp_extract(f, '[^/]*$'), '^ggml-', ''), '\\.bin$', '') AS model, nullif(regexp_extract(f, '__(std|opt|prof)__', 1), '') AS build, coalesce(nullif(regexp_extract(f, '(q\\d+[_k]?\\d*)', 1), ''), 'f16') AS quant FROM f""")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("models/ggml-"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.when(k % 3 == 0, "-q5_1").when(k % 3 == 1, "-q8_0").otherwise(""), F.when(k % 2 == 0, "__opt__").otherwise(""), F.lit(".bin"))
    f = table(spark, sf_dir, "part").select(k.alias("id"), name.alias("f"))
    return f.select("id", text.model_name(F.col("f")).alias("model"), text.build_label(F.col("f")).alias("build"), text.quantisation(F.col("f")).alias("quant"))


# Diagnostics.

_FEATS = ["rms", "flatness", "silence_ratio", "active_frac"]
_LONG = "lg AS (SELECT decision, unnest(['rms', 'flatness', 'silence_ratio', 'active_frac']) AS feature, unnest([rms, flatness, silence_ratio, active_frac]) AS v FROM g)"


@query(f"""WITH {METRICS_SQL}, g AS (SELECT *, {DEC} AS decision FROM m), {_LONG}
SELECT decision, feature, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 1e-1), 6) AS p10, round(quantile_cont(v, 5e-1), 6) AS p50, round(quantile_cont(v, 9e-1), 6) AS p90, round(max(v), 6) AS peak FROM lg GROUP BY decision, feature""")
def feature_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.feature_stats(gate.gate(views.metrics(spark, sf_dir)), "decision", _FEATS))


@query(f"""WITH {METRICS_SQL}, g AS (SELECT *, {DEC} AS decision FROM m), {_LONG},
q AS (SELECT feature, feature IN ('flatness', 'silence_ratio') AS worse, quantile_cont(v, 9e-1) FILTER (WHERE decision = 'PASS') AS ph, quantile_cont(v, 1e-1) FILTER (WHERE decision = 'PASS') AS pl, quantile_cont(v, 1e-1) FILTER (WHERE decision = 'FAIL') AS fl, quantile_cont(v, 9e-1) FILTER (WHERE decision = 'FAIL') AS fh FROM lg GROUP BY feature)
SELECT feature, round(CASE WHEN worse THEN (ph + fl) / 2 ELSE (pl + fh) / 2 END, 6) AS suggested, round(avg(CASE WHEN worse THEN v > fl ELSE v < fh END::INT), 6) AS overlap FROM lg JOIN q USING (feature) WHERE decision = 'PASS' GROUP BY feature, worse, ph, pl, fl, fh""")
def threshold_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.guidance(gate.gate(views.metrics(spark, sf_dir)), {"rms": False, "flatness": True, "silence_ratio": True, "active_frac": False}))


_XT = ", ".join(f"count(*) FILTER (WHERE decision = '{x}') AS n_{x.lower()}" for x in ("PASS", "BORDERLINE", "FAIL"))


@query(f"WITH {METRICS_SQL}, g AS (SELECT {LABEL} AS scene, {DEC} AS decision FROM m) SELECT scene, {_XT}, count(*) AS n FROM g GROUP BY scene")
def scene_gate_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.crosstab(gate.gate(gate.scenes(views.metrics(spark, sf_dir))), "scene", "decision", ("PASS", "BORDERLINE", "FAIL"))


@query(f"""WITH {METRICS_SQL}, {_POLICY}, {FILES_SQL} SELECT label, {", ".join(f"count(*) FILTER (WHERE file_scene = '{s}') AS n_{s.lower()}" for s in gate.SCENES)}, count(*) AS n FROM pf JOIN files USING (path) GROUP BY label""")
def label_scene_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = gate.scenes(views.metrics(spark, sf_dir)).groupBy("path").agg(gate.file_scene(F.col("scene")).alias("file_scene"))
    return diagnostics.crosstab(per.join(views.files(spark, sf_dir), "path"), "label", "file_scene", gate.SCENES)


_INFER = "CASE WHEN decision = 'FAIL' OR scene IN ('MUSIC', 'SILENCE') THEN 0 ELSE 1e2 + idx % 50 END"


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.gate(gate.scenes(views.metrics(spark, sf_dir)))
    return rows.withColumn("infer_ms", F.when((F.col("decision") == "FAIL") | F.col("scene").isin("MUSIC", "SILENCE"), d(0)).otherwise(d(100) + F.col("idx") % 50))


_INF = f"{METRICS_SQL}, gg AS (SELECT *, {LABEL} AS scene, {DEC} AS decision FROM m), g AS (SELECT *, {_INFER} AS infer_ms FROM gg)"


@query(f"WITH {_INF} SELECT scene, count(*) AS n, round(avg(rms), 6) AS mean_rms, round(avg(flatness), 6) AS mean_flatness, count(*) FILTER (WHERE infer_ms = 0) AS no_asr FROM g GROUP BY scene")
def scene_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.scene_report(_inferred(spark, sf_dir)))


@query(f"WITH {_INF} SELECT count(*) FILTER (WHERE scene IN ('MUSIC', 'SILENCE', 'NOISE')) AS n, round(count(*) FILTER (WHERE scene IN ('MUSIC', 'SILENCE', 'NOISE') AND infer_ms = 0) / count(*) FILTER (WHERE scene IN ('MUSIC', 'SILENCE', 'NOISE'))::DOUBLE, 6) AS suppressed FROM g")
def adaptive_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.suppression(_inferred(spark, sf_dir)))


@query(f"WITH {_INF} SELECT path, count(*) AS total, {_XT}, round(count(*) * 5e0, 6) AS audio_sec, round(sum(infer_ms), 6) AS infer_ms, round(count(*) FILTER (WHERE decision <> 'FAIL') / count(*)::DOUBLE, 6) AS accept_rate, round(sum(infer_ms) / 1000 / (count(*) * 5e0), 6) AS rtf FROM g GROUP BY path")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.run_summary(_inferred(spark, sf_dir), "path", d(5), F.col("infer_ms")))


@query(f"WITH {_INF} SELECT scene, round(avg(infer_ms), 6) AS mean, round(quantile_cont(infer_ms, 5e-1), 6) AS p50, round(quantile_cont(infer_ms, 9.5e-1), 6) AS p95, min(infer_ms) AS lo, max(infer_ms) AS hi FROM g WHERE infer_ms > 0 GROUP BY scene")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _inferred(spark, sf_dir).filter("infer_ms > 0")
    p = F.percentile("infer_ms", F.array(d(0.5), d(0.95)))
    return rounded(g.groupBy("scene").agg(F.avg("infer_ms").alias("mean"), p[0].alias("p50"), p[1].alias("p95"), F.min("infer_ms").alias("lo"), F.max("infer_ms").alias("hi")))


@query(f"""WITH {METRICS_SQL}, {FILES_SQL}, g AS (SELECT path, {DEC} AS decision FROM m), fd AS (SELECT path, CASE WHEN bool_or(decision = 'PASS') THEN 'PASS' WHEN bool_or(decision = 'BORDERLINE') THEN 'BORDERLINE' ELSE 'FAIL' END AS dec FROM g GROUP BY path),
x AS (SELECT * FROM fd JOIN files USING (path))
SELECT section, item, round(value, 6) AS value FROM (
SELECT 'total' AS section, 'n' AS item, count(*)::DOUBLE AS value FROM x UNION ALL SELECT 'total', 'errors', 0e0 UNION ALL
SELECT 'total', 'pass', count(*) FILTER (WHERE dec = 'PASS') FROM x UNION ALL SELECT 'total', 'borderline', count(*) FILTER (WHERE dec = 'BORDERLINE') FROM x UNION ALL SELECT 'total', 'fail', count(*) FILTER (WHERE dec = 'FAIL') FROM x UNION ALL
SELECT 'rate', 'far_pass_only', count(*) FILTER (WHERE dec = 'PASS' AND should_transcribe = 'no') / greatest(count(*) FILTER (WHERE should_transcribe = 'no'), 1)::DOUBLE FROM x UNION ALL
SELECT 'rate', 'frr', count(*) FILTER (WHERE dec = 'FAIL' AND should_transcribe = 'yes') / greatest(count(*) FILTER (WHERE should_transcribe = 'yes'), 1)::DOUBLE FROM x UNION ALL
SELECT 'label', label || ':' || lower(dec), count(*) FROM x GROUP BY label, dec)""")
def baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = gate.gate(views.metrics(spark, sf_dir)).groupBy("path").agg(gate.file_decision(F.col("decision")).alias("file_decision"))
    return rounded(diagnostics.baseline_report(per.join(views.files(spark, sf_dir), "path")))


@query(f"""WITH {METRICS_SQL}, g AS (SELECT path, {DEC} AS decision, {WHY} AS reason FROM m), f AS (SELECT path FROM g GROUP BY path HAVING NOT bool_or(decision = 'PASS'))
SELECT reason, count(*) AS n FROM g JOIN f USING (path) GROUP BY reason""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of the chunks of files that do not pass: one shuffle by file serves the verdict and the chunks."""
    g = gate.gate(views.metrics(spark, sf_dir)).select("path", "decision", "reason")
    g = g.withColumn("passes", F.bool_or(F.col("decision") == "PASS").over(Window.partitionBy("path")))
    return g.filter("not passes").groupBy("reason").agg(F.count("*").alias("n"))


_RUNS = "rn AS (SELECT l_returnflag AS model, l_linenumber AS threads, avg(l_extendedprice) / 1e5 / l_linenumber AS rtf FROM lineitem GROUP BY l_returnflag, l_linenumber)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("threads")).agg((F.avg(F.col("l_extendedprice").cast("double")) / d(1e5) / F.first("l_linenumber")).alias("rtf"))


@query(f"WITH {_RUNS}, b AS (SELECT *, first_value(rtf) OVER (PARTITION BY model ORDER BY threads) AS base_rtf, min(threads) OVER (PARTITION BY model) AS t0, count(*) OVER (PARTITION BY model) AS c FROM rn) SELECT model, threads, round(rtf, 6) AS rtf, round(base_rtf, 6) AS base_rtf, round(base_rtf / rtf, 6) AS speedup, round(base_rtf / rtf / (threads / t0::DOUBLE), 6) AS efficiency FROM b WHERE c > 1")
def group_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.scaling(_runs(spark, sf_dir), ["model"], "threads", "rtf"))


@query(f"WITH {_RUNS} SELECT model, threads, round(rtf, 6) AS rtf, round(rtf / min(rtf) OVER (PARTITION BY threads), 6) AS relative FROM rn")
def relative_to_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.relative_to_best(_runs(spark, sf_dir), ["threads"], "rtf"))


_MODES = "mt AS (SELECT 'M' || l_linenumber AS mode, count(*) AS n_files, sum(l_quantity)::DOUBLE AS audio_sec, sum(l_quantity * (1 - l_discount))::DOUBLE AS asr_sec, sum(l_extendedprice)::DOUBLE / 1e3 AS infer_ms, avg(l_tax)::DOUBLE AS wer FROM lineitem GROUP BY l_linenumber)"


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda c: F.col(c).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("mode")).agg(F.count("*").alias("n_files"), F.sum(x("l_quantity")).alias("audio_sec"), F.sum(x("l_quantity") * (1 - x("l_discount"))).alias("asr_sec"), (F.sum(x("l_extendedprice")) / d(1e3)).alias("infer_ms"), F.avg(x("l_tax")).alias("wer"))


@query(f"WITH {_MODES} SELECT mode, n_files, round(audio_sec, 3) AS audio_sec, round(asr_sec, 3) AS asr_sec, round(infer_ms, 3) AS infer_ms, round(wer, 6) AS wer, round((1 - asr_sec / audio_sec) * 100, 6) AS removed_pct, round(infer_ms / (audio_sec * 1000), 6) AS rtf FROM mt")
def mode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    t = _modes(spark, sf_dir).withColumns({"removed_pct": (1 - c("asr_sec") / c("audio_sec")) * 100, "rtf": c("infer_ms") / (c("audio_sec") * 1000)})
    return t.select("mode", "n_files", *[F.round(x, 3).alias(x) for x in ("audio_sec", "asr_sec", "infer_ms")], *[F.round(x, 6).alias(x) for x in ("wer", "removed_pct", "rtf")])


@query(f"""WITH {_MODES}, b AS (SELECT * FROM mt WHERE mode = 'M1'), o AS (SELECT * FROM mt WHERE mode IN ('M2', 'M3'))
SELECT o.mode, round(b.asr_sec - o.asr_sec, 3) AS saved_sec, round((b.asr_sec - o.asr_sec) / b.asr_sec * 100, 6) AS saved_pct, round((o.infer_ms - b.infer_ms) / b.infer_ms * 100, 6) AS infer_pct, round(o.wer - b.wer, 6) AS wer_delta FROM o, b""")
def mode_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.mode_deltas(_modes(spark, sf_dir), "M1", ["M2", "M3"])
    return out.select("mode", F.round("saved_sec", 3).alias("saved_sec"), *[F.round(x, 6).alias(x) for x in ("saved_pct", "infer_pct", "wer_delta")])


@query("""SELECT o_orderpriority AS priority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean_on, round(avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 4) AS mean_off,
  round(100 * (avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F')) / (avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') + 1e-9), 6) AS saved_pct FROM orders GROUP BY o_orderpriority""")
def bench_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean with the gate on against off."""
    v = F.col("o_totalprice").cast("double")
    on, off = F.avg(F.when(F.col("o_orderstatus") == "F", v)), F.avg(F.when(F.col("o_orderstatus") != "F", v))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(on.alias("on"), off.alias("off"))
    return g.select("priority", F.round("on", 4).alias("mean_on"), F.round("off", 4).alias("mean_off"), F.round(100 * (F.col("off") - F.col("on")) / (F.col("off") + d(1e-9)), 6).alias("saved_pct"))


@query(f"""WITH {METRICS_SQL}, b AS (SELECT path, idx, rms + CASE WHEN idx % 10 = 0 THEN 1e-4 ELSE 0 END AS rms, flatness FROM m WHERE idx % 7 <> 3),
j AS (SELECT coalesce(m.path, b.path) || '/' || coalesce(m.idx, b.idx) AS id, abs(m.rms - b.rms) AS d1, abs(m.flatness - b.flatness) AS d2 FROM m FULL JOIN b ON m.path = b.path AND m.idx = b.idx),
l AS (SELECT id, 'rms' AS metric, d1 AS diff FROM j UNION ALL SELECT id, 'flatness', d2 FROM j)
SELECT metric, count(diff) AS n, count(*) FILTER (WHERE diff IS NULL) AS missing, round(max(diff), 9) AS max_diff, round(avg(diff), 9) AS mean_diff FROM l GROUP BY metric""")
def parity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two implementations' chunks by place: differences and what is missing on one side."""
    m = views.metrics(spark, sf_dir).select("path", "idx", "rms", "flatness")
    b = m.filter("idx % 7 <> 3").withColumn("rms", F.col("rms") + F.when(F.col("idx") % 10 == 0, d(1e-4)).otherwise(d(0)))
    return rounded(diagnostics.parity(m, b, ["path", "idx"], ["rms", "flatness"]).drop("worst"), 9)


@query("""SELECT event_id, list_last(list_filter(string_split('event=' || event_type || chr(9) || 'user=' || user_id || chr(9) || 'noise' || chr(9) || 'note=a=' || event_id, chr(9)), lambda x: starts_with(x, 'event=')))[7:] AS event, user_id::VARCHAR AS user, 'a=' || event_id AS note FROM events""")
def log_kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key=value tokens of log lines: the first `=` splits, tokens without are dropped."""
    line = F.concat(F.lit("event="), F.col("event_type"), F.lit("\tuser="), F.col("user_id").cast("string"), F.lit("\tnoise\tnote=a="), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", text.key_values(line).alias("kv"))
    return e.select("event_id", *[F.try_element_at("kv", F.lit(k)).alias(k) for k in ("event", "user", "note")])


@query("""WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events)
SELECT event_type, key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || key)) AS n_values, min(json_extract_string(props, '$.' || key)) AS least FROM k GROUP BY event_type, key""")
def json_bench_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON documents flattened by a given schema of their kind, a map of texts: every key of every document."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("least"))


@query(f"""WITH {PREDICTIONS_SQL} SELECT doc_id, label, target::INT AS target, round(probability, 9) AS probability, probability >= 3e-1 AS said, (probability >= 3e-1) = target AS correct FROM p""")
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir)
    said = F.col("probability") >= 0.3
    return p.select("doc_id", "label", F.col("target").cast("int").alias("target"), F.round("probability", 9).alias("probability"), said.alias("said"), (said == F.col("target")).alias("correct"))


@query("SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of event time, as the streaming form computes them."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOURS AS stop, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM s GROUP BY user_id, k""")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps: the native analogue of held and merged activity."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.session_window("ts", "4 hours").alias("s"), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n", F.round("mean", 6).alias("mean"), "peak")


_ADMIT = f"""r AS (SELECT path, {DEC} <> 'FAIL' AS ok, 1 / (1 + exp(-({_RAW}))) AS pr FROM m),
f AS (SELECT path, should_transcribe = 'yes' AS target, bool_or(ok) AS rule, max(pr) >= 6e-1 AS learned FROM r JOIN files USING (path) WHERE should_transcribe <> '' GROUP BY path, should_transcribe),
x AS (SELECT target, policy, CASE policy WHEN 'rule' THEN rule WHEN 'learned' THEN learned ELSE rule AND learned END AS said FROM f, (VALUES ('rule'), ('learned'), ('hybrid')) v(policy))"""


@query(f"""WITH {METRICS_SQL}, {FILES_SQL}, {_ADMIT}, w AS (SELECT policy, {_COUNTS('said')} FROM x GROUP BY policy),
y AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS pr, tp / greatest(tp + fn, 1)::DOUBLE AS re FROM w)
SELECT policy, tp, fp, tn, fn, round(fp / greatest(fp + tn, 1)::DOUBLE, 6) AS far_admit, round(fn / greatest(tp + fn, 1)::DOUBLE, 6) AS frr, round(2 * pr * re / greatest(pr + re, 1e-15), 6) AS f1, round(100 * (tn + fn) / greatest(tp + fp + tn + fn, 1)::DOUBLE, 6) AS calls_avoided_pct FROM y""")
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule, learned and hybrid admission against the files' verdicts, and the share of calls that each avoids."""
    rows = gate.gate(views.metrics(spark, sf_dir)).withColumn("pr", logistic(ensemble.score_sql(_ENS, _features())))
    per = rows.groupBy("path").agg(F.bool_or(F.col("decision") != "FAIL").alias("rule"), (F.max("pr") >= 0.6).alias("learned"))
    f = per.join(views.files(spark, sf_dir).filter("should_transcribe <> ''"), "path")
    x = f.withColumn("policy", F.explode(F.array(*map(F.lit, ("rule", "learned", "hybrid")))))
    said = gate.admission(F.col("policy"), F.col("rule"), F.col("learned"))["admitted"]
    w = x.withColumn("said", said).groupBy("policy").agg(*metrics.counts(F.col("should_transcribe") == "yes", F.col("said")))
    c, one = F.col, F.lit(1)
    p, q = ratio(c("tp"), F.greatest(c("tp") + c("fp"), one)), ratio(c("tp"), F.greatest(c("tp") + c("fn"), one))
    n = c("tp") + c("fp") + c("tn") + c("fn")
    return rounded(w.select("policy", "tp", "fp", "tn", "fn", ratio(c("fp"), F.greatest(c("fp") + c("tn"), one)).alias("far_admit"), ratio(c("fn"), F.greatest(c("tp") + c("fn"), one)).alias("frr"), (2 * p * q / F.greatest(p + q, d(1e-15))).alias("f1"), (100 * ratio(c("tn") + c("fn"), F.greatest(n, one))).alias("calls_avoided_pct")))


@query("""SELECT l.doc_id, d.lang AS label, l.quality AS target, d.doc_id IS NOT NULL AND d.doc_id % 5 <> 0 AS found FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their saved rows, and which are missing (here: every fifth), in one outer join."""
    saved = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), (F.col("doc_id") % 5 != 0).alias("kept"))
    out = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target")).join(saved, "doc_id", "left")
    return out.select("doc_id", "label", "target", F.coalesce("kept", F.lit(False)).alias("found"))


@query("""SELECT lang AS dataset, count(*) AS n_files, count(n_chars) AS n_read, count(*) FILTER (WHERE n_chars IS NULL) AS n_unreadable, round(sum(n_chars) / 16000 / 3600::DOUBLE, 9) AS hours, count(DISTINCT n_chars % 3) AS n_rates FROM documents GROUP BY lang""")
def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, readable ones, hours and distinct rates of each manifest."""
    n = F.col("n_chars")
    out = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("n_files"), F.count(n).alias("n_read"), F.count_if(n.isNull()).alias("n_unreadable"), (F.sum(n) / d(16000) / d(3600)).alias("hours"), F.countDistinct(n % 3).alias("n_rates"))
    return rounded(out, 9)


@query(f"""WITH {METRICS_SQL}, g AS (SELECT ({DEC} = 'PASS')::INT::DOUBLE AS y, * FROM m), c AS (SELECT {", ".join(f"abs(corr({x}, y)) AS {x}" for x in gate.METRICS)} FROM g),
l AS (SELECT unnest([{", ".join(f"'{x}'" for x in gate.METRICS)}]) AS feature, unnest([{", ".join(gate.METRICS)}]) AS weight FROM c)
SELECT feature, round(weight, 6) AS weight FROM l ORDER BY l.weight DESC, feature LIMIT 10""")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the ten features that go most with passing, by correlation, in one aggregate."""
    g = gate.gate(views.metrics(spark, sf_dir)).withColumn("y", (F.col("decision") == "PASS").cast("double"))
    one = g.agg(*[F.abs(F.corr(x, "y")).alias(x) for x in gate.METRICS])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("weight")) for x in gate.METRICS])).alias("x")).select("x.*")
    return rounded(long.orderBy(F.desc("weight"), "feature").limit(10))
