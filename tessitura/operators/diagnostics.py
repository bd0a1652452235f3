"""Reports: percentiles, guidance, crosstabs, summaries of runs, comparisons of benchmarks, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.config import DECISIONS, SCENES
from tessitura.functions.numeric import d, ratio


def feature_stats(rows: DataFrame, by: str, features: list[str]) -> DataFrame:
    """(by, feature, n, mean, p10, p50, p90, peak): percentiles are exact, interpolated."""
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("x")).select(by, "x.*")
    q = F.percentile("v", F.array(d(0.1), d(0.5), d(0.9)))
    out = long.groupBy(by, "feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), q.alias("q"), F.max("v").alias("peak"))
    return out.select(by, "feature", "n", "mean", *(F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))), "peak")


def guidance(rows: DataFrame, features: dict[str, bool], decision: str = "decision") -> DataFrame:
    """(feature, suggested, overlap): between the nearer tails of PASS and FAIL; features say whether higher is worse."""
    long = rows.select(decision, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("worse"), F.col(f).alias("v")) for f, w in features.items()])).alias("x")).select(F.col(decision).alias("decision"), "x.*")
    tail = lambda said, p: F.percentile(F.when(F.col("decision") == said, F.col("v")), d(p))
    limits = long.groupBy("feature", "worse").agg(tail("PASS", 0.9).alias("ph"), tail("PASS", 0.1).alias("pl"), tail("FAIL", 0.1).alias("fl"), tail("FAIL", 0.9).alias("fh"))
    limits = limits.select("feature", F.when(F.col("worse"), (F.col("ph") + F.col("fl")) / 2).otherwise((F.col("pl") + F.col("fh")) / 2).alias("suggested"), F.when(F.col("worse"), F.col("fl")).otherwise(F.col("fh")).alias("limit"))
    beyond = F.when(F.col("worse"), F.col("v") > F.col("limit")).otherwise(F.col("v") < F.col("limit"))
    met = long.filter("decision = 'PASS'").join(F.broadcast(limits), "feature")  # one row a feature
    return met.groupBy("feature", "suggested").agg((F.count_if(beyond) / F.count("*")).alias("overlap"))


def crosstab(rows: DataFrame, by: str, what: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of each value as columns; values are given, so there is no extra pass to find them."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(what) == v).alias(f"n_{v.lower()}") for v in values], F.count("*").alias("n"))


def scene_report(rows: DataFrame) -> DataFrame:
    """Per scene: chunks, means, chunks without recognition, share suppressed."""
    return rows.groupBy("scene").agg(F.count("*").alias("n"), F.avg("rms").alias("mean_rms"), F.avg("flatness").alias("mean_flatness"), F.count_if(F.col("infer_ms") == 0).alias("no_asr"))


def suppression(rows: DataFrame) -> DataFrame:
    """Share of MUSIC, SILENCE and NOISE chunks that were not sent to recognition."""
    noisy = F.col("scene").isin("MUSIC", "SILENCE", "NOISE")
    return rows.agg(F.count_if(noisy).alias("n"), ratio(F.count_if(noisy & (F.col("infer_ms") == 0)), F.count_if(noisy)).alias("suppressed"))


def run_summary(rows: DataFrame, by: str, seconds: Column, infer_ms: Column) -> DataFrame:
    """Counts of decisions, accept rate, audio and real-time factor; rates over nothing are 0."""
    c = {x: F.count_if(F.col("decision") == x) for x in DECISIONS}
    out = rows.groupBy(by).agg(F.count("*").alias("total"), *[c[x].alias(f"n_{x.lower()}") for x in DECISIONS], F.sum(seconds).alias("audio_sec"), F.sum(infer_ms).alias("infer_ms"))
    return out.withColumns({"accept_rate": ratio(F.col("n_pass") + F.col("n_borderline"), F.col("total")), "rtf": ratio(F.col("infer_ms") / 1000, F.col("audio_sec"))})


def scaling(rows: DataFrame, group: list[str], threads: str, rtf: str) -> DataFrame:
    """Speed-up and efficiency against the fewest threads of a group; groups of one are left out."""
    w = Window.partitionBy(*group).orderBy(threads)
    whole = Window.partitionBy(*group)
    out = rows.withColumns({"base_rtf": F.first(rtf).over(w), "base_threads": F.first(threads).over(w), "members": F.count("*").over(whole)}).filter("members > 1")
    out = out.withColumn("speedup", ratio(F.col("base_rtf"), F.col(rtf)))
    return out.withColumn("efficiency", ratio(F.col("speedup"), F.col(threads) / F.col("base_threads"))).drop("members", "base_threads")


def relative_to_best(rows: DataFrame, group: list[str], rtf: str) -> DataFrame:
    return rows.withColumn("relative", ratio(F.col(rtf), F.min(rtf).over(Window.partitionBy(*group))))


def mode_deltas(totals: DataFrame, base: str, others: list[str]) -> DataFrame:
    """Against mode `base`: seconds saved and their percentage, inference change in percent, change of error rate."""
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    cols = ("asr_sec", "infer_ms", "wer")
    one = totals.agg(*[pick(m, c).alias(f"{c}_{i}") for i, m in enumerate([base, *others]) for c in cols])
    items = F.array(*[F.struct(F.lit(m).alias("mode"), *[F.col(f"{c}_{i}").alias(c) for c in cols]) for i, m in enumerate(others, 1)])
    x = one.select(*[f"{c}_0" for c in cols], F.explode(items).alias("o")).select("*", "o.*")
    saved = F.col("asr_sec_0") - F.col("asr_sec")
    return x.select("mode", saved.alias("saved_sec"), (ratio(saved, F.col("asr_sec_0")) * 100).alias("saved_pct"), (ratio(F.col("infer_ms") - F.col("infer_ms_0"), F.col("infer_ms_0")) * 100).alias("infer_pct"), (F.col("wer") - F.col("wer_0")).alias("wer_delta"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(metric, n, missing, max_diff, mean_diff, worst key as text) of two tables joined on keys; rows on one side only are missing."""
    both = a.select(*keys, *[F.col(m).alias(f"a_{m}") for m in metrics]).join(b.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics]), keys, "full")
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    long = both.select(name.alias("id"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")).alias("diff")) for m in metrics])).alias("x")).select("id", "x.*")
    # Of equal differences the least id.
    return long.groupBy("metric").agg(F.count("diff").alias("n"), F.count_if(F.col("diff").isNull()).alias("missing"), F.max("diff").alias("max_diff"), F.avg("diff").alias("mean_diff"), F.min_by("id", F.struct(-F.col("diff"), F.col("id"))).alias("worst"))


def baseline_report(files: DataFrame) -> DataFrame:
    """Long report (section, item, value) over files (label, should_transcribe, file_decision): totals, by label and verdict, false accepts (PASS only) and rejects. ERROR rows are left out of all but their own count."""
    c = F.col
    ok = c("file_decision") != "ERROR"
    n = lambda t: F.count_if(ok & t).cast("double")
    yes, no = c("should_transcribe") == "yes", c("should_transcribe") == "no"
    total = [("total", "n", n(F.lit(True))), ("total", "errors", F.count_if(~ok).cast("double")), *[("total", x.lower(), n(c("file_decision") == x)) for x in DECISIONS], ("rate", "far_pass_only", ratio(n(no & (c("file_decision") == "PASS")), F.greatest(n(no), d(1)))), ("rate", "frr", ratio(n(yes & (c("file_decision") == "FAIL")), F.greatest(n(yes), d(1))))]
    one = files.agg(*[v.alias(f"v{i}") for i, (_, _, v) in enumerate(total)]).select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("item"), F.col(f"v{i}").alias("value")) for i, (s, k, _) in enumerate(total)])).alias("x")).select("x.*")
    by = files.filter(ok).groupBy("label", "file_decision").agg(F.count("*").cast("double").alias("value")).select(F.lit("label").alias("section"), F.concat_ws(":", "label", F.lower("file_decision")).alias("item"), "value")
    return one.unionByName(by)


def scene_columns() -> tuple[str, ...]:
    return SCENES
