import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessitura.config import METRICS, Adaptive, Frame, Gate
from tessitura.functions import arrays, text
from tessitura.functions.numeric import logistic
from tessitura.operators import diagnostics, ensemble, gate, metrics, segment, spectral, splits
from tessitura.plans import views

SF = "/root/testdata/sf0.001"


def _one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


# Kernels.


def test_kernels_on_short_and_empty_arrays(spark):
    df = spark.createDataFrame([([],), ([0.5],), ([1.0, -1.0, 0.0, 0.25, -0.25],)], "x array<double>")
    x = F.col("x")
    rows = df.select(arrays.rms(x).alias("r"), arrays.zero_crossing_rate(x, 10).alias("z"), arrays.clipping_ratio(x).alias("c"), arrays.silence_ratio(x).alias("s"), arrays.chunks(x, 2).alias("k"), arrays.frames(x, 2, 1).alias("f"), arrays.trim_or_tile(x, 7).alias("t"), arrays.zero_pad(x, 6).alias("p"), arrays.resample_linear(x, 16000, 8000).alias("l"), arrays.downmix(x, 2).alias("m")).collect()
    assert [r.r for r in rows] == [0, 0.5, pytest.approx(math.sqrt((1 + 1 + 0.0625 * 2) / 5))]
    assert [r.z for r in rows] == [0, 0, pytest.approx(3 * 10 / 5)]
    assert [len(r.k) for r in rows] == [0, 1, 3] and [len(r.f) for r in rows] == [0, 0, 4]
    assert [len(r.t) for r in rows] == [0, 7, 7] and [len(r.p) for r in rows] == [6, 6, 6]
    assert rows[2].l == [1.0, 0.0] and rows[2].m == [0.0, 0.125] and rows[2].c == 0.4


def test_mixing_reaches_the_ratio(spark):
    rng = np.random.default_rng(0)
    s, n = (0.1 * rng.standard_normal(500)).tolist(), rng.standard_normal(500).tolist()
    got = _one(spark, s=s, n=n).select(arrays.mix_at_snr(F.col("s"), F.col("n"), F.lit(10.0)).alias("m")).first().m
    noise = np.array(got) - np.array(s)
    assert 20 * math.log10(np.sqrt(np.mean(np.square(s))) / np.sqrt(np.mean(noise**2))) == pytest.approx(10, abs=1e-4)
    quiet = _one(spark, s=[0.0] * 4, n=[1.0] * 4).select(arrays.mix_with_headroom(F.col("s"), F.col("n"), F.lit(0.0)).alias("m")).first().m
    assert quiet == [0.0] * 4


def test_convolution_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x, h = rng.standard_normal(40), rng.standard_normal(7)
    got = _one(spark, x=x.tolist(), h=h.tolist()).select(arrays.convolve(F.col("x"), F.col("h")).alias("y")).first().y
    want = np.convolve(x, h)[:40]
    assert np.allclose(got, want / np.abs(want).max())


def test_convolution_is_computed_once(spark):
    """It stood inside the division of each value by the peak, so work grew with the cube of the length."""
    df = spark.createDataFrame([([1.0, -2.0, 0.5],), ([],), ([0.0, 0.0],), (None,)], "x array<double>").select(arrays.convolve(F.col("x"), F.slice("x", 1, 2)).alias("y"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r.y for r in df.collect()] == [pytest.approx([1 / 4.5, -4 / 4.5, 1.0]), [], [0.0, 0.0], None]


def test_mixes_and_clips_are_computed_once(spark):
    s, n = F.col("s"), F.col("n")
    df = spark.createDataFrame([([3.0, -0.5], [1.0, 1.0])], "s array<double>, n array<double>")
    out = {"zip_with(": [arrays.mix_at_snr(s, n, F.lit(0.0)), arrays.mix_with_headroom(s, n, F.lit(0.0))], "greatest(-": [arrays.clip(s, 0.1)]}
    for part, columns in out.items():
        for c in columns:
            assert df.select(c.alias("y"))._jdf.queryExecution().optimizedPlan().toString().count(part) == 1
    gain = math.sqrt(9.25 / 2)
    both = [3 + gain, gain - 0.5]
    got = df.select(*out["zip_with("], *out["greatest(-"]).first()
    assert got[0] == pytest.approx([1.0, both[1] / both[0]]) and got[1] == pytest.approx([0.95, 0.95 * both[1] / both[0]]) and got[2] == [1.0, -1.0]


def _sine(f, seconds, a=0.3, rate=16000):
    return a * np.sin(2 * np.pi * f * np.arange(int(seconds * rate)) / rate)


def test_spectra_of_known_signals(spark):
    noise = 0.3 * np.random.default_rng(2).uniform(-1, 1, 16000)
    rows = [(1, np.zeros(16000).tolist()), (2, _sine(1000, 1).tolist()), (3, noise.tolist()), (4, [0.1] * 100), (5, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>").select("id", spectral.spectral_features(16000)("x").alias("s"))
    s = {r.id: r.s for r in df.collect()}
    assert s[1].flatness_mean == 0 and s[1].active_frac == 0 and s[1].n_frames == 61
    assert abs(s[2].centroid_mean - 1000) < 20 and s[2].band_mid > 0.99 and s[2].flatness_mean < 0.1
    assert s[3].flatness_mean > 0.5 and s[3].active_frac > 0.99
    assert s[4].n_frames == 0 and s[5].n_frames == 0
    assert (spectral.describe(_sine(500, 1), 16000, Frame(size=500)) == 0).all()


# Gate, scenes, adaptation.


def _chunk(**over):
    base = dict(rms=0.05, silence_ratio=0.1, clipping_ratio=0.0, zcr=300.0, flatness=0.2, centroid_hz=1500.0, rolloff_hz=3000.0, flux=1.0, band_low=0.1, band_mid=0.85, band_high=0.05, active_frac=0.75)
    return base | over


def test_gate_reasons_in_order(spark):
    cases = [(dict(rms=0.0005), "FAIL", "rms_too_low"), (dict(rms=0.001, silence_ratio=0.5), "BORDERLINE", "borderline_low_energy"), (dict(silence_ratio=0.9), "PASS", "ok"), (dict(silence_ratio=0.91), "FAIL", "high_silence_ratio"), (dict(clipping_ratio=0.06), "FAIL", "high_clipping_ratio"), (dict(active_frac=0.05), "FAIL", "low_active_frame_fraction"), (dict(flatness=0.91), "FAIL", "stationary_noise_like"), (dict(flatness=0.73, zcr=401.0), "FAIL", "stationary_noise_like"), (dict(flatness=0.73), "BORDERLINE", "borderline_noisy_speech"), (dict(band_mid=0.09), "FAIL", "weak_mid_band_speech_presence"), (dict(band_high=0.71), "FAIL", "excessive_high_band_energy")]
    df = spark.createDataFrame([(i, *_chunk(**c).values()) for i, (c, _, _) in enumerate(cases)], ["i", *_chunk()])
    got = {r.i: (r.decision, r.reason) for r in gate.gate(df).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(cases)}
    assert {(r.decision, r.reason) for r in gate.gate(df, enabled=False).collect()} == {("PASS", "gate_disabled")}


def test_rows_that_are_not_finite_are_set_apart(spark):
    df = spark.createDataFrame([(1, *_chunk().values()), (2, *_chunk(rms=float("nan")).values()), (3, *_chunk(flux=float("inf")).values())], ["i", *_chunk()])
    good, bad = gate.finite_only(df)
    assert [r.i for r in good.collect()] == [1] and {r.i for r in bad.collect()} == {2, 3}


def test_scenes(spark):
    cases = [(dict(rms=0.0005), "SILENCE"), (dict(flatness=0.0, centroid_hz=0.0, band_mid=0.0), "UNKNOWN"), (dict(flatness=0.82), "NOISE"), (dict(band_low=0.3, band_high=0.2), "MUSIC"), (dict(), "SPEECH"), (dict(flatness=0.5), "MIXED"), (dict(centroid_hz=7000.0), "UNKNOWN")]
    df = spark.createDataFrame([(i, *_chunk(**c).values()) for i, (c, _) in enumerate(cases)], ["i", *_chunk()])
    rows = {r.i: r for r in gate.scenes(df).collect()}
    assert [rows[i].scene for i in range(len(cases))] == [s for _, s in cases]
    assert all(0 <= r.scene_confidence <= 1 for r in rows.values()) and rows[1].scene_feature == "no_spectral_features"


def test_window_equals_the_controller(spark):
    """The window over labels against a queue of the last five, chunk by chunk."""
    rows = gate.adaptive_gate(views.metrics(spark, SF)).select("path", "idx", "scene", "dominant", "decision", "rms", "flatness").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.path, r.idx)):
        seen = by.setdefault(r.path, [])
        want = next((s for s in gate.SCENES if seen and seen.count(s) >= Adaptive().dominance * len(seen)), "UNKNOWN")
        assert r.dominant == want
        if want == "NOISE" and r.decision == "PASS":
            assert r.rms >= 0.0045 and r.flatness <= 0.595
        by[r.path] = [*seen, r.scene][-5:]


def test_file_features(spark):
    rows = [(1, *[float(f + i) for i in range(12)], d) for f, d in ((1, "PASS"), (3, "BORDERLINE"), (5, "FAIL"))]
    got = gate.file_features(spark.createDataFrame(rows, ["path", *METRICS, "decision"])).first()
    assert [got[f"mean_{m}"] for m in METRICS] == [3.0 + i for i in range(12)] and [got[f"max_{m}"] for m in METRICS] == [5.0 + i for i in range(12)]
    assert got.gate_pass_frac == got.gate_fail_frac == pytest.approx(1 / 3)


def test_admission_and_parsing(spark):
    df = spark.createDataFrame([(p, r, x) for p in ("rule", "learned", "hybrid") for r in (True, False) for x in (True, False)], "p string, r boolean, x boolean")
    got = {(r.p, r.r, r.x): (r.a.admitted, r.a.rejection) for r in df.withColumn("a", gate.admission(F.col("p"), F.col("r"), F.col("x"))).collect()}
    assert [k for k, v in got.items() if k[0] == "hybrid" and v[0]] == [("hybrid", True, True)]
    assert got["hybrid", False, False][1] == "hybrid_rule_rejected" and got["hybrid", True, False][1] == "hybrid_learned_rejected"
    assert got["rule", False, True] == (False, "rule_rejected") and got["learned", True, False] == (False, "learned_below_threshold")
    assert gate.parse_policy("rule", "0.3") == ("rule", 0.3)
    for bad in ("-0.01", "1.01", "nan", "0.3x"):
        with pytest.raises(ValueError):
            gate.parse_policy("learned", bad)
    with pytest.raises(ValueError):
        gate.check_compatible("learned", True, 5000, 0, True)
    gate.check_compatible("rule", True, 100, 10, False)


# Segments.


def _segments(raw, hang=8, gap=10, least=20):
    held, hold = [], 0
    for r in raw:
        hold = hang + 1 if r else max(0, hold - 1)
        held.append(hold > 0)
    runs, start = [], None
    for i, h in enumerate([*held, False]):
        if h and start is None:
            start = i
        elif not h and start is not None:
            runs.append([start, i])
            start = None
    merged = []
    for a, b in runs:
        if merged and a - merged[-1][1] <= gap:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [(a, b, sum(raw[a:b])) for a, b in merged if b - a >= least]


def test_segments_equal_the_loop(spark):
    rng = np.random.default_rng(5)
    raws = {}
    for p in range(40):
        on, out = False, []
        while len(out) < 300:
            out += [on] * int(rng.integers(1, 40))
            on = not on
        raws[p] = [bool(x and rng.random() < 0.9) for x in out[:300]]
    raws[40], raws[41] = [False] * 300, [True] * 300
    df = spark.createDataFrame([(p, i, r) for p, x in raws.items() for i, r in enumerate(x)], "path int, frame int, raw boolean")
    got = {p: [] for p in raws}
    for r in segment.segments(df).orderBy("path", "first").collect():
        got[r.path].append((r.first, r.stop, r.raw_frames))
    assert got == {p: _segments(x) for p, x in raws.items()}


def _pack(segs, dur, pre=0.2, post=0.3, gap=0.6, least=1.5, most=7.0):
    wins = []
    for a, b in segs:
        s, e = max(0.0, a - pre), min(dur, b + post)
        if wins and s <= wins[-1][1] + gap and e - wins[-1][0] <= most:
            wins[-1][1] = max(wins[-1][1], e)
            wins[-1][2] += b - a
        else:
            wins.append([s, e, b - a])
    out = []
    for s, e, speech in wins:
        if (miss := least - (e - s)) > 0:
            q = min(dur - e, miss / 2)
            p = min(s, miss - q)
            s, e = max(0.0, s - p), min(dur, e + min(dur - e, miss - p))
        out.append((s, e, speech / (e - s) if e > s else 0.0))
    return out


def test_packing_equals_the_loop(spark):
    rng = np.random.default_rng(6)
    files = {}
    for p in range(60):
        at = np.cumsum(rng.uniform(0.05, 1.5, 2 * int(rng.integers(1, 12))))
        files[p] = [(float(a), float(b)) for a, b in zip(at[::2], at[1::2])], float(at[-1] + rng.uniform(0, 1))
    df = spark.createDataFrame([(p, d, a, b) for p, (s, d) in files.items() for a, b in s], "path int, duration double, start_sec double, end_sec double")
    got = {p: [] for p in files}
    for r in segment.pack(df).orderBy("path", "win").collect():
        got[r.path].append((r.start_sec, r.end_sec, r.speech_ratio))
    for p, (s, d) in files.items():
        assert np.allclose(got[p], _pack(s, d))


# Scoring.


def test_ensembles(spark):
    tree = ((1, 2, 0, 1.5, 0.0), (-1, -1, 0, 0.0, -2.0), (-1, -1, 0, 0.0, 3.0))
    e = ensemble.Ensemble((tree,), 0.0, 1.0, 1)
    df = spark.createDataFrame([(1.0,), (2.0,), (1.5,)], ["x"])
    assert [r[0] for r in df.select(ensemble.score_sql(e, [F.col("x")])).collect()] == [-2, 3, -2]
    assert [r[0] for r in df.select(ensemble.score_arrow(e)(F.array("x"))).collect()] == [-2, 3, -2]
    leafs = ensemble.Ensemble((((-1, -1, 0, 0.0, 2.0),), ((-1, -1, 0, 0.0, -1.0),)), 0.5, 0.1, 1)
    assert df.select(ensemble.score_arrow(leafs)(F.array("x"))).first()[0] == pytest.approx(0.6)
    for bad in (((1, 3, 0, 0.0, 0.0), *tree[1:]), ((0, 2, 0, 0.0, 0.0), *tree[1:]), ((1, 2, 9, 0.0, 0.0), *tree[1:]), ((-1, 2, 0, 0.0, 0.0),)):
        with pytest.raises(ValueError):
            ensemble.Ensemble((bad,), 0.0, 1.0, 1)
    with pytest.raises(Exception, match="finite"):
        df.select(ensemble.score_arrow(e)(F.array(F.col("x") / 0 if False else F.lit(float("nan"))))).collect()
    p = spark.createDataFrame([(0.0,), (math.log(3),), (1000.0,), (-1000.0,), (-1.7736113904814736,)], ["r"]).select(logistic(F.col("r"))).collect()
    assert [r[0] for r in p] == pytest.approx([0.5, 0.75, 1.0, 0.0, 0.14509379193850144])


def test_logistic_is_a_half_where_a_sum_misses_zero(spark):
    p = spark.createDataFrame([(-5.6e-17,), (5.6e-17,), (-1.2e-16,), (-705.0,), (-720.0,), (None,)], "r double").select(logistic(F.col("r"))).collect()
    assert [r[0] for r in p[:3]] == [0.5] * 3 and p[3][0] == pytest.approx(math.exp(-705), rel=1e-12) and p[4][0] == math.exp(-720) and p[5][0] is None


# Metrics.


@pytest.mark.parametrize(("tp", "fp", "tn", "fn", "far", "frr", "f1"), [(957, 416, 284, 43, 0.5943, 0.0430, 0.8066), (986, 157, 543, 14, 0.2243, 0.0140, 0.9202), (944, 127, 573, 56, 0.1814, 0.0560, 0.9116), (334, 263, 437, 266, 0.3757, 0.4433, 0.5581), (979, 153, 547, 21, 0.2186, 0.0210, 0.9184), (0, 0, 0, 0, 0, 0, 0)])
def test_published_confusions(spark, tp, fp, tn, fn, far, frr, f1):
    r = metrics.rates(spark.createDataFrame([(tp, fp, tn, fn)], "tp long, fp long, tn long, fn long")).first()
    assert (r.far, r.frr, r.f1) == (far, frr, f1)


def test_sweep_and_points(spark):
    df = spark.createDataFrame([(True, 0.45), (False, 0.45)], "y boolean, p double")
    s = metrics.sweep(df, F.col("y"), F.col("p"), [0.4, 0.5])
    rows = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in s.collect()}
    assert rows == {0.4: (1, 1, 0, 0), 0.5: (0, 0, 1, 1)}
    assert metrics.best_f1(s).first().threshold == 0.4
    assert metrics.conservative(s, 0.0).first().threshold == 0.4
    assert metrics.sweep(df.limit(0), F.col("y"), F.col("p"), [0.5]).count() in (0, 1)


def test_grid_has_1008_rows_and_keeps_files_without_chunks(spark):
    files = spark.createDataFrame([(-5, "", "yes")], "path long, label string, should_transcribe string").unionByName(views.files(spark, SF))
    out = metrics.calibrate(views.metrics(spark, SF), files)
    n = files.count()
    assert out.count() == 1008 and out.filter(F.col("n_pass") + F.col("n_borderline") + F.col("n_fail") != n).count() == 0


# Text, splits, reports.


def test_word_errors(spark):
    pairs = [("a b c", "a x c", 1), ("", "a b", 2), ("a b", "", 2), ("a b c d", "b c d e", 2), ("a", "a", 0), ("", "", 0)]
    df = spark.createDataFrame(pairs, "r string, h string, n int").select("n", text.words(F.col("r")).alias("r"), text.words(F.col("h")).alias("h"))
    for r in df.select("n", text.word_errors_sql(F.col("r"), F.col("h")).alias("e"), text.alignment("r", "h").alias("a")).collect():
        assert r.e == r.n == r.a.substitutions + r.a.deletions + r.a.insertions
    assert text.align_counts(list("abc"), list("axc")) == (2, 1, 0, 0)
    norm = _one(spark, t="  Héllo, WORLD!  it's\t_ok_ ").select(text.normalise(F.col("t")).alias("t")).first().t
    assert norm == "héllo world it's _ok_"


def _peak(f):
    """What f returns, and the MB that Python and numpy held at most for it."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _aligned(ref, hyp):
    """(matches, substitutions, deletions, insertions) by a whole table and the way back through it."""
    t = [[max(i, j) if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    i, j, out = len(ref), len(hyp), [0, 0, 0, 0]
    while i or j:
        steps = [i and j and ref[i - 1] == hyp[j - 1] and t[i][j] == t[i - 1][j - 1], i and j and t[i][j] == t[i - 1][j - 1] + 1, i and t[i][j] == t[i - 1][j] + 1]
        kind = next((k for k, s in enumerate(steps) if s), 3)
        i, j = i - (kind < 3), j - (kind != 2)
        out[kind] += 1
    return tuple(out)


def test_alignment_of_a_batch_is_bounded():
    rng = np.random.default_rng(4)
    draw = lambda most, kinds: None if rng.random() < 0.02 else [None if w == 0 else f"w{w}" for w in rng.integers(0, kinds, rng.integers(0, most))]
    pairs = [(draw(most, kinds), draw(most, kinds)) for most, kinds in ((3, 2), (12, 3), (70, 5), (40, 200)) for _ in range(60)]
    arrow = [pa.array(column, pa.list_(pa.string())) for column in zip(*pairs, strict=True)]
    got = [tuple(r.values()) for r in text.alignment.func(*arrow).to_pylist()]
    assert got == [_aligned(r or [], h or []) for r, h in pairs]
    assert [tuple(r.values()) for r in text.alignment.func(*(c[50:90] for c in arrow)).to_pylist()] == got[50:90]
    words = pa.ListArray.from_arrays(pa.array(range(0, 300_001, 100), pa.int32()), pa.array([f"w{i % 977}" for i in range(300_000)]))
    out, mb = _peak(lambda: text.alignment.func(words, words))
    assert out.field(0).to_pylist() == [100] * 3000 and mb < 10


def test_alignment_of_long_texts_is_bounded():
    ref = [f"w{i}" for i in range(3000)]
    got, mb = _peak(lambda: text.align_counts(ref, ref[:1000] + ["x"] * 5 + ref[1010:] + ["y"] * 7))
    assert got == (2990, 5, 5, 7) and mb < 10


def test_paths_and_lines(spark):
    paths = ["/a/./b//c", "/a/../../b", "a/../../b", "./data/raw/x/../y", "/mnt/disk/sub/z", "/else/z"]
    df = spark.createDataFrame([(p,) for p in paths], ["p"])
    got = df.select(text.clean_path(F.col("p")).alias("c"), text.canonical_source(F.col("p"), {"/mnt/disk": "data/raw", "/mnt/disk/sub": "data/raw/s"}).alias("s")).collect()
    assert [r.c for r in got] == ["/a/b/c", "/b", "../b", "data/raw/y", "/mnt/disk/sub/z", "/else/z"]
    assert [r.s for r in got[3:]] == ["data/raw/y", "data/raw/s/z", None]
    kv = _one(spark, v="a=1\tb\tc=x=y\ta=2").select(text.key_values(F.col("v")).alias("m")).first().m
    assert kv == {"a": "2", "c": "x=y"}


def test_splits(spark):
    ids = spark.createDataFrame([(f"s{i % 11}", i) for i in range(110)], "source string, n int")
    one = {r.source: r.split for r in splits.partition(ids, "source", ["a", "b", "c"], 17).collect()}
    assert one == {r.source: r.split for r in splits.partition(ids.repartition(7), "source", ["a", "b", "c"], 17).collect()}
    sizes = [list(one.values()).count(s) for s in "abc"]
    assert len(one) == 11 and max(sizes) - min(sizes) <= 1
    g = splits.grouped_split(ids, "source", 0.6, 42)
    assert g.count() == 110 and g.groupBy("source").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    with pytest.raises(ValueError):
        splits.sample(ids, "n", 111, 1)
    both = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", None)], "split string, v string")
    report = splits.overlap(both, ["a", "b", "c"], {"v": F.col("v")})
    assert {(r.left_split, r.right_split): (r.n, r.examples) for r in report.collect()} == {("a", "b"): (1, ["x"]), ("a", "c"): (0, []), ("b", "c"): (0, [])}
    with pytest.raises(ValueError):
        splits.assert_disjoint(report)
    splits.assert_disjoint(report.filter("n = 0"))


def test_reports_leave_errors_out(spark):
    rows = [("l", "yes", "FAIL"), ("l", "no", "PASS"), ("l", "no", "BORDERLINE"), ("m", "no", "ERROR")]
    got = {(r.section, r.item): r.value for r in diagnostics.baseline_report(spark.createDataFrame(rows, "label string, should_transcribe string, file_decision string")).collect()}
    assert got["total", "n"] == 3 and got["total", "errors"] == 1 and got["rate", "far_pass_only"] == 0.5 and got["rate", "frr"] == 1 and got["label", "l:pass"] == 1
    s = diagnostics.scaling(spark.createDataFrame([("a", 1, 2.0), ("a", 4, 1.0), ("b", 1, 1.0)], "m string, t int, r double"), ["m"], "t", "r")
    assert {(r.m, r.t): (r.speedup, r.efficiency) for r in s.collect()} == {("a", 1): (1, 1), ("a", 4): (2, 0.5)}
    assert Gate().flatness_warn == 0.72


def test_example_json_equals_pythons(spark):
    """Null fields, characters beyond ASCII and beyond the first plane, and maps in any order."""
    import hashlib
    import json

    rows = [("speech", "data/raw/a.wav", None, 5.0, None, {"b": "2", "a": "1"}, 1.5, 16000), (None, "é/日本/\U0001f600\"\\\n", "x", None, "r1", None, None, None)]
    df = spark.createDataFrame(rows, "label string, source string, corruption_source string, snr_db double, rir_id string, generation_params map<string,string>, duration_sec double, sample_rate int")
    got = df.select(text.example_json(*map(F.col, df.columns)).alias("j")).withColumn("i", text.example_id(F.col("j"))).collect()
    for r, g in zip(rows, got, strict=True):
        want = dict(zip(df.columns, r, strict=True))
        want |= {k: want[k] or "" for k in ("label", "source", "corruption_source", "rir_id")} | {"generation_params": want["generation_params"] or {}}
        want = json.dumps(want, sort_keys=True, separators=(",", ":"))
        assert g.j == want and g.i == hashlib.sha256(want.encode()).hexdigest()[:24]
