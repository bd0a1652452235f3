"""Schemas of the tables that readers and writers exchange."""

from __future__ import annotations

from pyspark.sql import types as T

from tessitura.config import METRICS


def _struct(text: str) -> T.StructType:
    """`name type, ...` without a session: simple types, and array<type> of them."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType()), "map": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


_METRICS = ", ".join(f"{m} double" for m in METRICS)
SIGNAL = _struct("path string, sample_rate int, samples array<float>")
CHUNK = _struct(f"path string, idx int, start_sec double, end_sec double, duration_sec double, {_METRICS}, decision string, reason string")
VAD_SEGMENT = _struct("path string, seg int, start_sec double, end_sec double, speech_ratio float, frame_count int")
LABEL = _struct("path string, label string, should_transcribe string, synthetic boolean, source string, source_type string, base_utterance_id string, corruption_source string, snr_db double, rir_id string, generation_seed long, generation_params map, duration_sec double, sample_rate int")
MANIFEST = _struct("path string, dataset string, split string, source_type string, sample_rate int, duration_sec double, channels int, speaker_id string, chapter_id string, utterance_id string, transcript string, musan_subset string, rir_type string, room_id string, environment string")
PREDICTION = _struct("stable_example_id string, path string, label string, should_transcribe string, target int, probability double, threshold double, binary_prediction int, correct boolean")
TREE_NODE = _struct("tree int, node int, left int, right int, feature int, threshold double, value double")
BENCH_CHUNK = _struct(f"idx int, start_sec double, end_sec double, dur_sec double, decision string, reason string, {_METRICS}, centroid double, rolloff double, active_frame_frac double, scene string, infer_ms double, transcript string")
BENCH = T.StructType([
    T.StructField("config", _struct("input string, model string, chunk_ms int, hop_ms int, n_threads int, gate_enabled boolean, quality_policy string, quality_threshold double")),
    T.StructField("chunks", T.ArrayType(BENCH_CHUNK)),
    T.StructField("summary", _struct("total_chunks int, passed int, borderline int, failed int, accept_rate double, audio_sec double, total_infer_ms double, rtf double")),
])
