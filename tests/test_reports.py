"""Edges of the operators behind plans/reports.py."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessitura.functions import arrays, text
from tessitura.operators import gate, metrics, splits


def test_eval_chunks(spark):
    x = spark.createDataFrame([([float(i) for i in range(n)],) for n in (0, 4, 5, 10, 13, 15)], "x array<double>")
    got = x.select(F.transform(arrays.eval_chunks(F.col("x"), 0.01, 1000), lambda c: F.size(c["samples"])).alias("a"), F.transform(arrays.eval_chunks(F.col("x"), 0.01, 1000, True), lambda c: F.size(c["samples"])).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [([], []), ([4], []), ([5], [5]), ([10], [10]), ([10, 3], [10]), ([10, 5], [10, 5])]
    whole = x.select(arrays.eval_chunks(F.col("x"), 0.0, 1000).alias("c")).collect()
    assert [len(r.c[0].samples) for r in whole] == [0, 4, 5, 10, 13, 15]
    with pytest.raises(ValueError):
        arrays.eval_chunks(F.col("x"), 0.0, 1000, True)


@pytest.mark.parametrize("start, stop, want", [(-1.0, 0.35, [0, 1, 2]), (0.29, 0.5, [2, 3, 4]), (0.7, 9.0, [7, 8, 9]), (0.5, 0.5, []), (2.0, 3.0, []), (0.8, 0.2, [])])
def test_slice_seconds(spark, start, stop, want):
    df = spark.createDataFrame([([float(i) for i in range(10)], start, stop)], "x array<double>, a double, b double")
    assert df.select(arrays.slice_seconds(F.col("x"), F.col("a"), F.col("b"), 10).alias("s")).first().s == want


def test_sign_change_rate(spark):
    rows = [[], [1.0], [0.0, 1.0, 0.0, -1.0], [1.0, 1.0, -1.0]]
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>")
    assert [r.v for r in df.select(arrays.sign_change_rate(F.col("x"), 12).alias("v")).collect()] == [0, 0, 9, 4]


def test_plain_words_are_those_of_str_split(spark):
    texts = ["", "  ", "A b\tC\nd", "x\x0by\x0cz\x1c1\x1f2\x85\xa03　4 five", "don't, stop!", "ÀÉ ß"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, t string")
    got = [r.w for r in df.orderBy("i").select(text.plain_words(F.col("t")).alias("w")).collect()]
    assert got == [t.lower().split() for t in texts] + [[]]


def test_portable_and_inputs(spark):
    rows = [(None, ""), ("", ""), ("white_noise", "white_noise"), ("/repo/a/../b.wav", "b.wav"), ("a/b.wav", "a/b.wav"), ("../x/data/raw/c.wav", "data/raw/c.wav"), ("/mnt/c.wav", "data/raw/c.wav"), ("/etc/c", None)]
    df = spark.createDataFrame(rows, "v string, want string").select("want", text.portable(F.col("v"), "/repo", {"/mnt": "data/raw"}).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    pairs = spark.createDataFrame([("/mnt/b", "/mnt/a"), ("/mnt/a", "/mnt/./a"), ("", "pink"), (None, None)], "s string, c string")
    got = [r.x for r in pairs.select(text.input_identities(F.col("s"), F.col("c"), {"/mnt": "data/raw"}).alias("x")).collect()]
    assert got == [["data/raw/a", "data/raw/b"], ["data/raw/a"], [], []]


def test_lookup_and_same_order(spark):
    a = spark.createDataFrame([("u1",), ("u2",), (None,)], "k string")
    t = spark.createDataFrame([("u1", "hello"), ("u3", "no")], "k string, v string")
    assert sorted((r.k or "", r.v) for r in splits.lookup(a, "k", t, "v").collect()) == [("", ""), ("u1", "hello"), ("u2", "")]
    left = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "i int, k string")
    assert splits.same_order(left, left, "i", "k").first().asDict() == {"n_left": 3, "n_right": 3, "n_different": 0, "equal": True}
    right = spark.createDataFrame([(0, "b"), (1, "b")], "i int, k string")  # a null key and a missing row differ
    assert splits.same_order(left, right, "i", "k").first().asDict() == {"n_left": 3, "n_right": 2, "n_different": 2, "equal": False}
    assert splits.same_order(left.limit(0), left.limit(0), "i", "k").first().equal


def test_document_and_its_check(spark):
    rows = spark.createDataFrame([("music", False, 0.4), ("music", False, 0.1), ("clean_speech", True, 0.2), ("clean_speech", True, 0.9), (None, True, 0.5)], "label string, truth boolean, p double")
    args = (rows, F.col("label"), F.col("truth"), F.col("p"), 0.3)
    doc = metrics.document(*args)
    got = {(r.kind, r.label): (r.tp, r.fp, r.tn, r.fn, r.music_fa, r.clean_speech_fr) for r in doc.collect()}
    assert got[("selected", None)] == (2, 1, 1, 1, 1, 1) and got[("default", None)] == (2, 0, 2, 1, 0, 1)
    assert got[("selected", "music")] == (0, 1, 1, 0, 1, 0) and len(got) == 6
    metrics.check_document(doc, *args)
    with pytest.raises(ValueError):
        metrics.check_document(doc.withColumn("tp", F.col("tp") + 1), *args)
    with pytest.raises(ValueError):
        metrics.check_document(doc, *args[:4], 0.45)


def test_policy_report_is_not_guarded(spark):
    one = spark.createDataFrame([(0, 0, 3, 0, 0, 3), (2, 1, 1, 0, 2, 4)], "tp long, fp long, tn long, fn long, calls long, ungated long")
    a, b = metrics.policy_report(one).collect()
    assert math.isnan(a.frr) and math.isnan(a.f1) and a.far == 0 and a.avoided_pct == 100
    assert (b.far, b.frr, b.avoided_pct) == (0.5, 0, 50) and abs(b.f1 - 0.8) < 1e-12


@pytest.mark.parametrize("skip, want", [(True, (2, 1, 1, 0, 4, 1, 0.25)), (False, (2, 2, 0, 1, 6, 3, 0.5))])
def test_wer_report(spark, skip, want):
    rows = spark.createDataFrame([("g", "a b c d", "a b c", 4, 1), ("g", "x y", None, 2, 2), ("g", "", "z", 0, 0), ("h", None, "", 0, 0)], "g string, ref string, hyp string, n_ref int, errors int")
    got = {r.g: tuple(r)[1:] for r in metrics.wer_report(rows, "g", skip).collect()}
    assert got == {"g": want, "h": (0, 0, 0, 0, 0, 0, 0.0)}


def test_admit_once(spark):
    rows = spark.createDataFrame([(1, True, [1.0]), (2, False, []), (3, None, [2.0]), (4, True, [1.0, 2.0])], "i int, ok boolean, x array<double>")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def say(x):
        calls.add(1)
        return f"{len(x)} samples"

    got = {r.i: (r.ran, r.result) for r in gate.admit_once(rows, F.col("ok"), F.col("x"), say).collect()}
    assert got == {1: (True, "1 samples"), 2: (False, None), 3: (False, None), 4: (True, "2 samples")} and calls.value == 2
    assert not gate.admit_once(rows, F.col("ok"), F.col("x"), say, enabled=False).filter("ran").collect()
    with pytest.raises(PySparkException, match="no samples"):
        gate.admit_once(rows, F.col("i") == 2, F.col("x"), say).collect()


@pytest.mark.parametrize("value", [" 0.5", "0.5\n", "0_1", "nan", "inf", "1.5", "-0.1", "", "0.5x"])
def test_policy_thresholds_are_whole_numbers_of_text(value):
    with pytest.raises(ValueError):
        gate.parse_policy("rule", value)


def test_policy_threshold():
    assert gate.parse_policy("hybrid", "5e-1") == ("hybrid", 0.5) and gate.parse_policy("rule", "1.") == ("rule", 1.0)


def test_describe(spark):
    rows = spark.createDataFrame([("ok",), ("low_rms",), ("unheard",), (None,)], "r string")
    got = [r.m for r in rows.select(gate.describe(F.col("r")).alias("m")).collect()]
    assert got[0] and got[1] and got[2:] == ["", ""]
