import json

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessitura import schemas
from tessitura.operators import gate
from tessitura.plans import views
from tessitura.sources import tables, wav
from tessitura.streaming import stateful

SF = "/root/testdata/sf0.001"


def test_wav_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, 800).astype(np.float32)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.wav").write_bytes(wav.encode(x, 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVE")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no")
    f = wav.files(spark, str(tmp_path))
    assert f.count() == 2  # Spark skips files without a byte
    rows = wav.signals(f).collect()
    assert len(rows) == 1 and rows[0].sample_rate == 8000 and np.abs(np.array(rows[0].samples) - x).max() < 2 / 32767
    info = {r.path.rsplit("/", 1)[-1]: r.i for r in f.select("path", wav.audio_info(F.col("content")).alias("i")).collect()}
    assert (info["a.wav"].sample_rate, info["a.wav"].duration_sec, info["a.wav"].channels) == (8000, 0.1, 1) and info["bad.wav"] is None
    again = spark.createDataFrame([([0.5, -2.0, 2.0], 16000)], "s array<double>, r int").select(wav.wav_bytes("s", "r").alias("b")).first().b
    assert wav.decode(bytes(again))[1].tolist() == pytest.approx([0.49997, -1.0, 0.99997], abs=1e-4)


@pytest.mark.parametrize(("kind", "bits", "values"), [(1, 8, [0, 128, 255]), (1, 24, None), (1, 32, [2**30, -(2**31), 0]), (3, 32, [0.5, -0.25, 0.0]), (3, 64, [0.5, -0.25, 0.0])])
def test_wav_formats(kind, bits, values):
    import struct

    dtype = {(1, 8): "u1", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}.get((kind, bits))
    body = np.array(values, dtype=dtype).tobytes() if dtype else b"".join(int(v).to_bytes(3, "little", signed=True) for v in (2**22, -(2**23), 0))
    want = {8: [-1.0, 0.0, 127 / 128], 24: [0.5, -1.0, 0.0], 32: [0.5, -1.0, 0.0]}[bits] if kind == 1 else [0.5, -0.25, 0.0]
    raw = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, 1, 16000, 0, 0, bits) + b"data" + struct.pack("<I", len(body)) + body
    assert wav.decode(raw)[1].tolist() == pytest.approx(want)
    assert wav.decode(raw[:-1]) is None


def test_stereo_is_the_mean():
    import struct

    body = np.array([1000, 3000, -500, 500], dtype="<i2").tobytes()
    raw = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 0, 0, 16) + b"data" + struct.pack("<I", len(body)) + body
    assert (wav.decode(raw)[1] * 32768).tolist() == [2000, 0]


def test_manifests_logs_and_benches(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "a.wav", "sr": 8000}\n\n{"path": null}\n{"path": "b.wav", "sample_rate": 16000, "sr": 1}\n')
    m = tables.manifest(tables.jsonl(spark, str(tmp_path / "m.jsonl"), "path string, sr int, sample_rate int"))
    assert {(r.path, r.sample_rate) for r in m.collect()} == {("a.wav", 8000), ("b.wav", 16000)}
    (tmp_path / "run.log").write_text("event=chunk\tidx=0\ttext=a=b\nevent=run_end\tnoise\trtf=0.5\n")
    logs = [r.fields for r in tables.log_lines(spark, str(tmp_path / "run.log")).collect()]
    assert logs == [{"event": "chunk", "idx": "0", "text": "a=b"}, {"event": "run_end", "rtf": "0.5"}]
    doc = {"config": {"model": "m", "n_threads": 2}, "chunks": [{"idx": 0, "centroid": 5.0, "infer_ms": 1.0}, {"idx": 1, "centroid_hz": 6.0}], "summary": {"rtf": 0.1}}
    (tmp_path / "bench").mkdir()
    (tmp_path / "bench" / "x.json").write_text(json.dumps(doc, indent=1))
    b = tables.bench(spark, str(tmp_path / "bench"))
    assert b.first().config.n_threads == 2 and [r.centroid_hz for r in tables.bench_chunks(b).orderBy("idx").collect()] == [5.0, 6.0]
    ref = spark.createDataFrame([(0, "plain"), (1, "7\tseven"), (2, "x\tbad"), (3, " ")], "line_no int, value string")
    assert {(r.idx, r.text) for r in tables.reference_texts(ref).collect()} == {(0, "plain"), (7, "seven")}
    tr = spark.createDataFrame([("1-2-3 HELLO THERE",), ("broken",)], ["value"])
    r = tables.transcripts(tr).select("*", *tables.utterance_parts(F.col("utterance_id"))).first()
    assert (r.transcript, r.speaker_id, r.chapter_id) == ("HELLO THERE", "1", "2")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", None)], "i int, t string, n string")
    line = df.select(tables.log_line([("event", F.lit("chunk")), ("text", F.col("t"))]).alias("value"))
    tables.write_text(line, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first().value == "event=chunk\ttext=a b"
    tables.write_json(df, str(tmp_path / "json"))
    assert '"n":null' in spark.read.text(str(tmp_path / "json")).first().value
    with pytest.raises(Exception, match="exist"):
        tables.write_json(df, str(tmp_path / "json"))
    tables.write_tsv(df.drop("t"), str(tmp_path / "tsv"))
    assert spark.createDataFrame([], schemas.LABEL).columns[0] == "path" and len(schemas.CHUNK) == 19


def _stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_type", "value")
    # A late marker moves the watermark past all windows, so that append mode emits them.
    end = e.agg(F.max("ts")).first()[0]
    mark = spark.createDataFrame([(-1, end, "mark", 0.0)], "user_id long, ts timestamp, event_type string, value double").withColumn("ts", F.col("ts") + F.expr("interval 3 days"))
    path = str(tmp_path / "events")
    e.coalesce(1).write.parquet(path)
    mark.coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = stateful.drain(stateful.windowed(src, "6 hours"), "w", "complete").filter("event_type <> 'mark'")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    want = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")
    assert {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in got.collect()} == {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in want.collect()}
    s = stateful.drain(stateful.sessions(src, "4 hours", late="40 days"), "s", "complete").filter("user_id >= 0")
    batch = e.groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id").count()
    assert s.count() == batch.count() and s.agg(F.sum("n")).first()[0] == e.count()


def test_history_as_state(spark, tmp_path):
    m = gate.scenes(views.metrics(spark, SF)).select("path", "idx", "scene")
    want = {(r.path, r.idx): r.dominant for r in m.withColumn("dominant", gate.dominant(F.col("scene"), "path", "idx")).collect()}
    path = str(tmp_path / "chunks")
    for part in range(3):  # three micro-batches, each later in every file
        m.filter(F.least(F.floor(F.col("idx") / 3), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.path, r.idx): r.dominant for r in stateful.drain(stateful.dominant_scene(src), "h", "append").collect()}
    assert got == want


def test_broken_and_missing_sources_are_errors(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('\n{"path": "a"}\n  \n')
    assert [r.path for r in tables.required(tables.jsonl(spark, str(good), "path string"), "good").collect()] == ["a"]
    (tmp_path / "broken.jsonl").write_text('{"path": "a"}\n{"path": \n')
    with pytest.raises(Py4JJavaError, match="FAILED_READ_FILE"):
        tables.jsonl(spark, str(tmp_path / "broken.jsonl"), "path string").collect()
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="none.jsonl"):
        tables.required(tables.jsonl(spark, str(tmp_path / "none.jsonl"), "path string"), "none.jsonl")


def test_unreadable_files_are_told(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode(np.zeros(8, dtype=np.float32), 8000))
    (tmp_path / "cut.wav").write_bytes(wav.encode(np.zeros(8, dtype=np.float32), 8000)[:-2])
    (tmp_path / "none.wav").write_bytes(wav.encode(np.zeros(0, dtype=np.float32), 8000))
    f = wav.files(spark, str(tmp_path))
    name = lambda rows: sorted(r.path.rsplit("/", 1)[-1] for r in rows.collect())
    assert name(wav.signals(f)) == ["a.wav"] and name(wav.unreadable(f)) == ["cut.wav", "none.wav"]
    with pytest.raises(PySparkException, match="cannot be read"):
        wav.signals(f, strict=True).collect()
    assert len(wav.signals(f.filter("path like '%/a.wav'"), strict=True).collect()) == 1


def test_hypotheses(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"chunks": [{"idx": 0, "transcript": "old"}, {"idx": 0, "transcript": "new"}, {"idx": 1}, {"transcript": "lost"}]}')
    got = tables.hypotheses(tables.bench(spark, str(tmp_path / "b.json"))).collect()
    assert sorted((r.file, r.idx, r.text) for r in got) == [("b.json", -1, "lost"), ("b.json", 0, "new"), ("b.json", 1, "")]
