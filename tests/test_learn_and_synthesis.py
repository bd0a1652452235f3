import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import ensemble, learn, synthesis


def test_exported_trees_score_alike(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(300, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.7).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, y int")
    model = learn.gbt(df, ["a", "b", "c"], "y", trees=5)
    e = learn.export(model, 3)
    learn.to_table(spark, e).write.parquet(str(tmp_path / "trees"))
    e = learn.from_table(spark.read.parquet(str(tmp_path / "trees")), 0.0, 1.0, 3)
    both = model.transform(learn.assemble(df, ["a", "b", "c"], "y")).withColumn("raw", ensemble.score_arrow(e)(F.array("a", "b", "c")))
    for r in both.select("probability", "raw").collect():
        assert 1 / (1 + np.exp(-r.raw)) == pytest.approx(r.probability[1], abs=1e-9)
    assert learn.importance(model, ["a", "b", "c"])[0][0] == "a"
    for other in (learn.logistic(df, ["a", "b", "c"], "y"), learn.forest(df, ["a", "b", "c"], "y", trees=5)):
        out = other.transform(learn.assemble(df, ["a", "b", "c"], "y"))
        assert out.filter("prediction = label").count() > 270


def _pool(spark, name, n, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"{name}{i}", rng.uniform(-0.5, 0.5, 40).tolist()) for i in range(n)], "path string, samples array<double>")


def test_seven_classes(spark):
    speech, noise, rirs, music = (_pool(spark, n, k, i) for i, (n, k) in enumerate([("s", 6), ("n", 4), ("r", 3), ("m", 2)]))
    out = synthesis.build(speech, noise, rirs, music, 7, 64)
    rows = out.collect()
    assert {r.label for r in rows} == set(synthesis.CLASSES) and len(rows) == 6 * 5 + 4 + 2
    assert all(len(r.samples) == 64 and r.duration_sec == 0.004 and max(map(abs, r.samples)) <= 1 + 1e-9 for r in rows)
    assert all((r.snr_db is not None) == (r.label == "speech_in_noise") for r in rows)
    again = {r.path: r.samples for r in synthesis.build(speech.repartition(3), noise, rirs, music, 7, 64).collect()}
    assert again == {r.path: r.samples for r in rows}
    with pytest.raises(ValueError):
        synthesis.build(speech, noise.limit(0), rirs, music, 7, 64)


def test_authoritative_splits(spark):
    pool = spark.createDataFrame([(f"p{i}", f"s{i % 30}", "x" if i % 2 else "y") for i in range(240)], "path string, source string, label string")
    held = spark.createDataFrame([("s1",), ("s2",)], ["source"])
    out = synthesis.authoritative(pool, held, {"train": {"x": 10, "y": 12}, "test": {"x": 5, "y": 5}}, 17).cache()
    assert out.count() == 32 and out.filter(F.col("source").isin("s1", "s2")).count() == 0
    assert out.groupBy("source").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    with pytest.raises(ValueError):
        synthesis.authoritative(pool, held, {"train": {"x": 10_000}, "test": {"x": 1}}, 17)
