"""Thresholds and sizes. Values that results depend on are fixed and stand here together."""

from __future__ import annotations

from dataclasses import dataclass

SCENES = ("SILENCE", "NOISE", "MUSIC", "SPEECH", "MIXED", "UNKNOWN")
METRICS = ("rms", "silence_ratio", "clipping_ratio", "zcr", "flatness", "centroid_hz", "rolloff_hz", "flux", "band_low", "band_mid", "band_high", "active_frac")
DECISIONS = ("PASS", "BORDERLINE", "FAIL")
#: Reasons of the gate, in the order of its tests, and what they mean.
REASONS = {
    "rms_too_low": "energy below the floor",
    "high_silence_ratio": "mostly silent samples",
    "high_clipping_ratio": "many clipped samples",
    "low_active_frame_fraction": "few active frames",
    "stationary_noise_like": "flat spectrum, as of steady noise",
    "weak_mid_band_speech_presence": "little energy between 500 and 4000 Hz",
    "excessive_high_band_energy": "most energy above 4000 Hz",
    "borderline_low_energy": "energy just above the floor",
    "borderline_noisy_speech": "flatter spectrum than clean speech",
    "ok": "all tests passed",
    "gate_disabled": "the gate was off",
    "low_rms": "older logs: borderline_low_energy",
    "high_spectral_flatness": "older logs: stationary_noise_like",
    "elevated_flatness": "older logs: borderline_noisy_speech",
}


@dataclass(frozen=True)
class Gate:
    rms_min: float = 0.003
    rms_borderline_min: float = 0.001
    max_silence_ratio: float = 0.90
    max_clipping_ratio: float = 0.05
    zcr_max_noise: float = 400.0
    min_active_frac: float = 0.10
    flatness_max: float = 0.90
    flatness_warn: float = 0.72
    min_band_mid: float = 0.10
    max_band_high: float = 0.70
    silence_thresh: float = 0.005
    clipping_thresh: float = 0.99


@dataclass(frozen=True)
class Frame:
    size: int = 512
    hop: int = 256
    rolloff: float = 0.85
    active_rms: float = 0.005
    low_hz: float = 500.0
    mid_hz: float = 4000.0


@dataclass(frozen=True)
class Scene:
    silence_rms_max: float = 0.003
    silence_active_max: float = 0.15
    noise_flatness_min: float = 0.65
    music_flatness_max: float = 0.45
    music_band_low_min: float = 0.18
    music_band_high_min: float = 0.08
    speech_centroid_min: float = 200.0
    speech_centroid_max: float = 5000.0
    speech_band_mid_min: float = 0.40
    mixed_flatness_min: float = 0.40


STRICT_MUSIC = Scene(music_band_low_min=0.25, music_band_high_min=0.12)
MUSIC_CONFIDENCE = 0.7


@dataclass(frozen=True)
class Adaptive:
    history: int = 5
    dominance: float = 0.60
    rms_factor: float = 1.5
    borderline_share: float = 0.33
    flatness_cap: float = 0.70
    warn_share: float = 0.85
    skip: tuple[str, ...] = ("MUSIC", "SILENCE")


@dataclass(frozen=True)
class Vad:
    frame_ms: int = 20
    hop_ms: int = 10
    energy: float = 0.005
    zcr_max: float = 3000.0
    hangover: int = 8
    min_speech_frames: int = 20
    min_silence_frames: int = 10


@dataclass(frozen=True)
class Pack:
    pre_pad: float = 0.2
    post_pad: float = 0.3
    gap: float = 0.6
    min_window: float = 1.5
    max_window: float = 7.0


#: Values of the calibration grid and of the two-way sweep.
GRID_RMS = (0.001, 0.002, 0.003, 0.005, 0.008, 0.010)
GRID_FLATNESS = (0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
GRID_BAND_MID = (0.05, 0.08, 0.10, 0.12, 0.15, 0.20)
GRID_SILENCE = (0.80, 0.85, 0.90, 0.95)
GRID_ALPHA = 0.5
