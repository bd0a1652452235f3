"""The rule gate, scenes, adaptive thresholds and admission as CASE expressions and windows over chunk metrics."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.config import METRICS, REASONS, SCENES, Adaptive, Gate, Scene
from tessitura.functions.numeric import all_of, d, is_finite, round6, soft_confidence

Thresholds = dict[str, Column]


def thresholds(cfg: Gate = Gate()) -> Thresholds:
    return {f.name: d(getattr(cfg, f.name)) for f in fields(cfg)}


def decide(t: Thresholds | None = None, metric=F.col) -> Column:
    """struct(decision, reason): the first test that holds. Thresholds may be columns, so that one plan serves many configurations."""
    t = t or thresholds()
    m = metric
    tests = [
        (m("rms") < t["rms_borderline_min"], "FAIL", "rms_too_low"),
        (m("silence_ratio") > t["max_silence_ratio"], "FAIL", "high_silence_ratio"),
        (m("clipping_ratio") > t["max_clipping_ratio"], "FAIL", "high_clipping_ratio"),
        (m("active_frac") < t["min_active_frac"], "FAIL", "low_active_frame_fraction"),
        (m("flatness") > t["flatness_max"], "FAIL", "stationary_noise_like"),
        ((m("flatness") > t["flatness_warn"]) & (m("zcr") > t["zcr_max_noise"]), "FAIL", "stationary_noise_like"),
        (m("band_mid") < t["min_band_mid"], "FAIL", "weak_mid_band_speech_presence"),
        (m("band_high") > t["max_band_high"], "FAIL", "excessive_high_band_energy"),
        (m("rms") < t["rms_min"], "BORDERLINE", "borderline_low_energy"),
        (m("flatness") > t["flatness_warn"], "BORDERLINE", "borderline_noisy_speech"),
    ]
    out = None
    for test, decision, reason in tests:
        said = F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
        out = F.when(test, said) if out is None else out.when(test, said)
    return out.otherwise(F.struct(F.lit("PASS").alias("decision"), F.lit("ok").alias("reason")))


def gate(chunks: DataFrame, t: Thresholds | None = None, enabled: bool = True) -> DataFrame:
    """Add decision and reason. A gate that is off passes everything, for the reason gate_disabled."""
    if not enabled:
        return chunks.withColumns({"decision": F.lit("PASS"), "reason": F.lit("gate_disabled")})
    return chunks.withColumn("__g", decide(t)).withColumns({"decision": F.col("__g.decision"), "reason": F.col("__g.reason")}).drop("__g")


def lenient(t_rms: Column, t_flatness: Column, silence: float = 0.95) -> tuple[Thresholds, object]:
    """Thresholds and metric reader of re-simulation over stored records: derived limits, and defaults for metrics that a record lacks."""
    t = thresholds(replace(Gate(), max_silence_ratio=silence)) | {"rms_min": t_rms, "rms_borderline_min": t_rms * d(0.33), "flatness_max": t_flatness, "flatness_warn": t_flatness * d(0.80)}
    missing = {"active_frac": 1.0, "band_mid": 1.0}
    return t, lambda m: F.coalesce(F.col(m), d(missing.get(m, 0.0)))


def finite_only(chunks: DataFrame, metrics=METRICS) -> tuple[DataFrame, DataFrame]:
    """(rows whose metrics are all finite, the others). NaN compares as larger than any number, so it must not reach a test."""
    ok = all_of([is_finite(F.col(m)) for m in metrics])
    return chunks.filter(ok), chunks.filter(~ok)


def scene(cfg: Scene = Scene()) -> Column:
    """struct(label, confidence, feature)."""
    c = F.col
    silent = c("rms") < cfg.silence_rms_max
    said = lambda label, confidence, feature: F.struct(F.lit(label).alias("label"), confidence.alias("confidence"), (feature if isinstance(feature, Column) else F.lit(feature)).alias("feature"))
    low, high = soft_confidence(c("band_low"), cfg.music_band_low_min, cfg.music_band_low_min, 1), soft_confidence(c("band_high"), cfg.music_band_high_min, cfg.music_band_high_min, 1)
    tonal = soft_confidence(c("flatness"), cfg.music_flatness_max, cfg.music_flatness_max, -1)
    voiced = c("centroid_hz").between(cfg.speech_centroid_min, cfg.speech_centroid_max) & (c("band_mid") >= cfg.speech_band_mid_min)
    return (
        F.when(silent | (c("active_frac") < cfg.silence_active_max), said("SILENCE", soft_confidence(c("rms"), cfg.silence_rms_max, cfg.silence_rms_max, -1), F.when(silent, "rms").otherwise("active_frac")))
        .when((c("flatness") == 0) & (c("centroid_hz") == 0) & (c("band_mid") == 0), said("UNKNOWN", d(0), "no_spectral_features"))
        .when(c("flatness") >= cfg.noise_flatness_min, said("NOISE", soft_confidence(c("flatness"), cfg.noise_flatness_min, 1 - cfg.noise_flatness_min, 1), "flatness"))
        .when((c("flatness") < cfg.music_flatness_max) & (c("band_low") >= cfg.music_band_low_min) & (c("band_high") >= cfg.music_band_high_min), said("MUSIC", F.cbrt(tonal * low * high), "band_energy_low+high"))
        .when(voiced & (c("flatness") < cfg.mixed_flatness_min), said("SPEECH", soft_confidence(c("band_mid"), cfg.speech_band_mid_min, 1 - cfg.speech_band_mid_min, 1), "band_mid+centroid"))
        .when(voiced, said("MIXED", soft_confidence(c("flatness"), cfg.mixed_flatness_min, cfg.noise_flatness_min - cfg.mixed_flatness_min, 1), "flatness_elevated"))
        .otherwise(said("UNKNOWN", d(0), "no_clear_pattern"))
    )


def scenes(chunks: DataFrame, cfg: Scene = Scene(), prefix: str = "scene") -> DataFrame:
    """Add scene, scene_confidence, scene_feature (under another prefix: the same with it)."""
    return chunks.withColumn("__s", scene(cfg)).withColumns({prefix: F.col("__s.label"), f"{prefix}_confidence": F.col("__s.confidence"), f"{prefix}_feature": F.col("__s.feature")}).drop("__s")


def dominant(label: Column, key: str, order: str, cfg: Adaptive = Adaptive()) -> Column:
    """The scene with a share of at least cfg.dominance of the up to cfg.history chunks before; UNKNOWN if none."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-cfg.history, -1)
    seen = F.count(label).over(w)
    out = F.lit("UNKNOWN")
    for s in reversed(SCENES):
        n = F.count(F.when(label == s, 1)).over(w)
        out = F.when((seen > 0) & (n >= d(cfg.dominance) * seen), s).otherwise(out)
    return out


def adapted(dominant_scene: Column, base: Gate = Gate(), cfg: Adaptive = Adaptive()) -> Thresholds:
    """Thresholds after a dominant scene: stricter in noise. They are columns, so nothing is evaluated twice."""
    noisy = dominant_scene == "NOISE"
    rms = d(base.rms_min * cfg.rms_factor)
    t = thresholds(base)
    t["rms_min"] = F.when(noisy, rms).otherwise(d(base.rms_min))
    t["rms_borderline_min"] = F.when(noisy, rms * d(cfg.borderline_share)).otherwise(d(base.rms_borderline_min))
    if cfg.flatness_cap < base.flatness_max:
        t["flatness_max"] = F.when(noisy, d(cfg.flatness_cap)).otherwise(d(base.flatness_max))
        t["flatness_warn"] = F.when(noisy, d(cfg.flatness_cap) * d(cfg.warn_share)).otherwise(d(base.flatness_warn))
    return t


def adaptive_gate(chunks: DataFrame, key: str = "path", order: str = "idx", cfg: Adaptive = Adaptive()) -> DataFrame:
    """Add scene, dominant, decision, reason, admitted: labels do not depend on thresholds, so one window over them replaces the controller's state."""
    with_scene = scenes(chunks).withColumn("dominant", dominant(F.col("scene"), key, order, cfg))
    judged = gate(with_scene, adapted(F.col("dominant"), cfg=cfg))
    return judged.withColumn("admitted", F.col("decision").isin("PASS", "BORDERLINE") & ~F.col("scene").isin(*cfg.skip))


def file_decision(decision: Column) -> Column:
    """Aggregate: PASS if any chunk passes, else BORDERLINE if any is, else FAIL."""
    return F.when(F.bool_or(decision == "PASS"), "PASS").when(F.bool_or(decision == "BORDERLINE"), "BORDERLINE").otherwise("FAIL")


PRIORITY = ("SPEECH", "MIXED", "UNKNOWN", "MUSIC", "NOISE", "SILENCE")


def file_scene(label: Column) -> Column:
    """Aggregate: the first scene of PRIORITY that any chunk has; UNKNOWN without chunks."""
    out = None
    for s in PRIORITY:
        out = F.when(F.bool_or(label == s), s) if out is None else out.when(F.bool_or(label == s), s)
    return out.otherwise("UNKNOWN")


def file_features(judged: DataFrame, key: str = "path") -> DataFrame:
    """Means and maxima of metrics rounded to six decimals, and shares of decisions: partial sums before the only shuffle."""
    m = [F.avg(round6(F.col(c))).alias(f"mean_{c}") for c in METRICS] + [F.max(round6(F.col(c))).alias(f"max_{c}") for c in METRICS]
    s = [F.avg((F.col("decision") == x).cast("double")).alias(f"gate_{x.lower()}_frac") for x in ("PASS", "BORDERLINE", "FAIL")]
    return judged.groupBy(key).agg(*m, *s)


def admission(policy: Column, rule: Column, learned: Column) -> Column:
    """struct(admitted, rejection): rule, learned or hybrid; hybrid names the rule first. No rejection is none."""
    ok = F.when(policy == "rule", rule).when(policy == "learned", learned).otherwise(rule & learned)
    why = (
        F.when(ok, "none")
        .when(policy == "rule", "rule_rejected")
        .when(policy == "learned", "learned_below_threshold")
        .when(~rule, "hybrid_rule_rejected")
        .otherwise("hybrid_learned_rejected")
    )
    return F.struct(ok.alias("admitted"), why.alias("rejection"))


def describe(reason: Column) -> Column:
    """What a reason means; empty for one that is not known, or null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), reason), F.lit(""))


def admit_once(files: DataFrame, admitted: Column, samples: Column, transcribe: Callable[[Column], Column], enabled: bool = True) -> DataFrame:
    """Add ran (boolean) and result: transcribe(samples) of each admitted file, once, and null of the others, which never reach it.

    An admitted file without samples is an error. Files with a null verdict are not admitted.
    """
    said = F.coalesce(admitted, F.lit(False)) if enabled else F.lit(False)
    checked = F.when(F.size(samples) > 0, samples).otherwise(F.raise_error(F.lit("an admitted file has no samples")).cast("array<double>"))
    ran = files.filter(said).withColumns({"ran": F.lit(True), "result": transcribe(checked)})
    rest = files.filter(~said).withColumns({"ran": F.lit(False), "result": F.lit(None).cast(ran.schema["result"].dataType)})
    return ran.unionByName(rest)


def parse_policy(policy: str, threshold: str) -> tuple[str, float]:
    """Checked before a plan is built: a known policy, a finite number in [0, 1] and nothing after it."""
    if policy not in ("rule", "learned", "hybrid"):
        raise ValueError(f"unknown policy {policy!r}")
    value = float(threshold) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", threshold, re.ASCII) else -1.0
    if not 0 <= value <= 1:
        raise ValueError(f"threshold {threshold!r} is not within 0 and 1")
    return policy, value


def check_compatible(policy: str, vad: bool, chunk_ms: int, hop_ms: int, gate_enabled: bool, base: Gate = Gate()) -> None:
    """Learned policies were fitted on fixed chunks of 5 s with the default gate; anything else is refused."""
    if policy != "rule" and (vad or (chunk_ms, hop_ms) != (5000, 0) or not gate_enabled or base != Gate()):
        raise ValueError(f"policy {policy} needs fixed chunks of 5000 ms, no overlap, and the default gate")
