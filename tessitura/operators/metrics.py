"""Confusion metrics, threshold sweeps, operating points and grid calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.config import GRID_ALPHA, GRID_BAND_MID, GRID_FLATNESS, GRID_RMS, GRID_SILENCE, Gate
from tessitura.functions.numeric import d, ratio
from tessitura.operators import gate


def counts(truth: Column, said: Column) -> list[Column]:
    """tp, fp, tn, fn as aggregates of two booleans."""
    return [F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(~truth & ~said).alias("tn"), F.count_if(truth & ~said).alias("fn")]


def rates(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Add far, frr, precision, recall, f1 to tp, fp, tn, fn. A rate over nothing is 0. digits None: not rounded."""
    c = F.col
    r = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    p, q = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    return df.withColumns({"far": r(ratio(c("fp"), c("fp") + c("tn"))), "frr": r(ratio(c("fn"), c("tp") + c("fn"))), "precision": r(p), "recall": r(q), "f1": r(ratio(2 * p * q, p + q))})


def confusion(rows: DataFrame, truth: Column, said: Column, by: str | None = None, digits: int | None = 4) -> DataFrame:
    """One row, or with `by` the whole and each group at once (grouping sets; `by` null is the whole)."""
    if by is None:
        return rates(rows.agg(*counts(truth, said)), digits)
    return rates(rows.groupingSets([[], [by]], by).agg(*counts(truth, said)), digits)


def sweep(rows: DataFrame, truth: Column, probability: Column, steps: list[float]) -> DataFrame:
    """Confusion at each threshold (said: probability >= threshold). Rows are counted once per step of the grid, then summed up."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in steps], "threshold double")
    # How many thresholds a probability reaches is its cell: at most len(steps) + 1 cells meet the grid, not all rows.
    reach = sum((probability >= d(t)).cast("int") for t in steps)
    cells = rows.groupBy(truth.alias("truth"), reach.alias("reach")).agg(F.count("*").alias("n"))
    ranked = grid.withColumn("place", F.row_number().over(Window.orderBy("threshold")))
    met = cells.join(F.broadcast(ranked), F.lit(True))
    said = F.col("reach") >= F.col("place")
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    out = met.groupBy("threshold").agg(some(F.col("truth") & said).alias("tp"), some(~F.col("truth") & said).alias("fp"), some(~F.col("truth") & ~said).alias("tn"), some(F.col("truth") & ~said).alias("fn"))
    return rates(out)


def best_f1(swept: DataFrame) -> DataFrame:
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def conservative(swept: DataFrame, rule_frr: Column | float, slack: float = 0.02) -> DataFrame:
    """Best F1 among thresholds that miss at most slack more than the rule; if none do, the least missing."""
    limit = F.round((rule_frr if isinstance(rule_frr, Column) else d(rule_frr)) + d(slack), 4)
    ok = F.col("frr") <= limit
    return swept.orderBy(F.desc(ok), F.when(ok, -F.col("f1")).otherwise(F.col("frr")), "threshold").limit(1)


def calibration_grid(spark: SparkSession, rms=GRID_RMS, flatness=GRID_FLATNESS, mid=GRID_BAND_MID, silence=GRID_SILENCE) -> DataFrame:
    rows = [(i, *map(float, v), round(v[1] * 0.80, 4)) for i, v in enumerate(product(rms, flatness, mid, silence))]
    return spark.createDataFrame(rows, "config int, g_rms double, g_flatness double, g_mid double, g_silence double, g_warn double")


def _cell(value: Column, limits: list[float]) -> Column:
    """Number of limits below the value, twice, plus one if it equals a limit: comparisons with any limit depend on nothing else."""
    below = sum((value > d(x)).cast("int") for x in limits)
    return (2 * below + F.coalesce(F.expr("false") if not limits else F.exists(F.array(*[d(x) for x in limits]), lambda x: x == value), F.lit(False)).cast("int")).cast("int")


def _levels(number: np.ndarray, limits: np.ndarray, block: int = 2048) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of files (should_transcribe, cells): how many each configuration passes, finds borderline, falsely accepts, and keeps of those to transcribe; one table a task."""
    k_rms, k_flat, k_warn, k_mid, k_sil = (limits[:, i] + 1 for i in range(5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(number)), dtype=np.int64)
        for b in batches:
            yes, no = (np.array([x == w for x in b.column(0).to_pylist()], dtype=bool) for w in ("yes", "no"))
            cells = b.column(1)
            at = cells.offsets.to_numpy() - cells.offsets[0].as_py()
            flat = cells.flatten()
            rms, flatness, mid, sil, loud = (flat.field(i).to_numpy(zero_copy_only=False)[:, None] for i in range(5))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + block, "right")) - 1)
                s = slice(at[i], at[j])
                fail = (sil[s] > k_sil) | (flatness[s] > k_flat) | ((flatness[s] > k_warn) & loud[s]) | (mid[s] < k_mid)
                weak = (rms[s] < k_rms) | (flatness[s] > k_warn)
                level = np.maximum.reduceat(np.where(fail, 0, np.where(weak, 1, 2)).astype(np.int8), at[i:j] - at[i])
                total += [(level == 2).sum(0), (level == 1).sum(0), ((level == 2) & no[i:j, None]).sum(0), ((level > 0) & yes[i:j, None]).sum(0)]
                i = j
        yield pa.RecordBatch.from_arrays([pa.array(number), *map(pa.array, total)], ["config", "n_pass", "n_borderline", "n_fa", "yes_kept"])

    return run


def calibrate(chunks: DataFrame, files: DataFrame, grid: DataFrame | None = None, base: Gate = Gate(), alpha: float = GRID_ALPHA) -> DataFrame:
    """(config, thresholds, n_pass, n_borderline, n_fail, n_fa, n_fr, far, frr, accept_rate, cost) for each configuration.

    chunks: metrics with path; files: (path, should_transcribe). A false accept is a PASS of a file that should not be
    transcribed, a false reject a FAIL of one that should. Files without chunks fail. Only what comparisons with the grid's
    limits can tell apart is kept of a chunk (its cell), so the grid meets distinct cells of files instead of all chunks.
    """
    spark = chunks.sparkSession
    grid = calibration_grid(spark) if grid is None else grid
    rows = grid.collect()
    rms, flat, warn, mid, sil = (sorted({r[c] for r in rows}) for c in ("g_rms", "g_flatness", "g_warn", "g_mid", "g_silence"))
    c = F.col
    hard = (c("rms") < base.rms_borderline_min) | (c("clipping_ratio") > base.max_clipping_ratio) | (c("active_frac") < base.min_active_frac) | (c("band_high") > base.max_band_high)
    cell = chunks.select("path", hard.alias("hard"), _cell(c("rms"), rms).alias("c_rms"), _cell(c("flatness"), sorted({*flat, *warn})).alias("c_flat"), _cell(c("band_mid"), mid).alias("c_mid"), _cell(c("silence_ratio"), sil).alias("c_sil"), (c("zcr") > base.zcr_max_noise).alias("loud"))
    flats = sorted({*flat, *warn})
    place = lambda limits, x: 2 * limits.index(x)  # noqa: E731  cell of a value just at x is place + 1
    number = np.array([r["config"] for r in rows], dtype=np.int32)
    limits = np.array([(place(rms, r["g_rms"]), place(flats, r["g_flatness"]), place(flats, r["g_warn"]), place(mid, r["g_mid"]), place(sil, r["g_silence"])) for r in rows], dtype=np.int64).reshape(-1, 5)
    names = ("c_rms", "c_flat", "c_mid", "c_sil", "loud")
    # A file's distinct cells, of which there are only so many: one shuffle by file, and no row for a configuration and a file.
    sets = cell.filter("not hard").groupBy("path").agg(F.collect_set(F.struct(*names)).alias("cells")).join(files, "path").select("should_transcribe", "cells")
    totals = sets.mapInArrow(_levels(number, limits), "config int, n_pass long, n_borderline long, n_fa long, yes_kept long")
    # Files whose every chunk fails for any configuration, or that have none, are FAIL in all.
    n = files.agg(F.count("*").alias("n"), F.count_if(c("should_transcribe") == "yes").alias("yes"), F.count_if(c("should_transcribe") == "no").alias("no"))
    found = totals.groupBy("config").agg(*[F.sum(x).alias(x) for x in ("n_pass", "n_borderline", "n_fa", "yes_kept")])
    zero = {x: 0 for x in ("n_pass", "n_borderline", "n_fa", "yes_kept")}
    out = grid.join(found, "config", "left").fillna(zero).join(F.broadcast(n), F.lit(True))
    far, frr = ratio(c("n_fa"), F.greatest(c("no"), F.lit(1))), ratio(c("yes") - c("yes_kept"), F.greatest(c("yes"), F.lit(1)))
    return out.select("config", "g_rms", "g_flatness", "g_mid", "g_silence", "n_pass", "n_borderline", (c("n") - c("n_pass") - c("n_borderline")).alias("n_fail"), "n_fa", (c("yes") - c("yes_kept")).alias("n_fr"), far.alias("far"), frr.alias("frr"), ratio(c("n_pass") + c("n_borderline"), F.greatest(c("n"), F.lit(1))).alias("accept_rate"), (far + d(alpha) * frr).alias("cost"))


SWEEP_RMS = (0.0005, 0.001, 0.002, 0.003, 0.005, 0.010)
SWEEP_FLATNESS = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def two_way_sweep(chunks: DataFrame, rtf: float, baseline_accept: float, least_accept: float = 0.85) -> DataFrame:
    """(rms_min, flatness_max, accept_rate, pass, borderline, fail shares, estim_rtf, saved_pct, flag): 48 cells in one pass over chunks.

    All cells are aggregates of one row, so chunks are neither multiplied nor shuffled.
    """
    cells = list(product(SWEEP_RMS, SWEEP_FLATNESS))
    aggs = [F.count("*").alias("total")]
    for i, (r, f) in enumerate(cells):
        t, metric = gate.lenient(d(r), d(f))
        said = gate.decide(t, metric)["decision"]
        aggs += [F.count_if(said == "PASS").alias(f"p{i}"), F.count_if(said == "BORDERLINE").alias(f"b{i}")]
    one = chunks.agg(*aggs)
    items = F.array(*[F.struct(F.lit(i).alias("cell"), d(r).alias("rms_min"), d(f).alias("flatness_max"), F.col(f"p{i}").alias("n_pass"), F.col(f"b{i}").alias("n_border")) for i, (r, f) in enumerate(cells)])
    c = F.col
    parted = one.select("total", F.explode(items).alias("x")).select("total", "x.*")
    accept = ratio(c("n_pass") + c("n_border"), c("total"))
    kept = accept / d(max(baseline_accept, 1e-9))
    return parted.select("cell", "rms_min", "flatness_max", accept.alias("accept_rate"), ratio(c("n_pass"), c("total")).alias("pass_share"), ratio(c("n_border"), c("total")).alias("border_share"), ratio(c("total") - c("n_pass") - c("n_border"), c("total")).alias("fail_share"), (d(rtf) * kept).alias("estim_rtf"), (F.greatest(d(0), 1 - kept) * 100).alias("saved_pct"), F.when(accept < least_accept, "low_accept").otherwise("ok").alias("flag"))


def recommended(swept: DataFrame) -> DataFrame:
    """The cell that saves most among those that are ok; of equals the first."""
    return swept.filter("flag = 'ok'").orderBy(F.desc("saved_pct"), "cell").limit(1)


_TOTALS = ("tp", "fp", "tn", "fn", "music_fa", "clean_speech_fr")


def document(rows: DataFrame, label: Column, truth: Column, probability: Column, selected: float) -> DataFrame:
    """The metrics of one split at the selected threshold and, to compare, at 0.5: kind, threshold, label (null: all), counts and rates.

    music_fa counts admitted music, clean_speech_fr clean speech that is not. Rows are counted once; the thresholds meet the counts.
    """
    cells = rows.groupBy(label.alias("label"), truth.alias("truth"), (probability >= d(selected)).alias("a"), (probability >= d(0.5)).alias("b")).agg(F.count("*").alias("n"))
    one = lambda kind, at, said: F.struct(F.lit(kind).alias("kind"), d(at).alias("threshold"), F.col(said).alias("said"))
    kinds = F.array(one("selected", selected, "a"), one("default", 0.5, "b"))
    c = cells.select("label", "truth", "n", F.inline(kinds))
    t, y = F.col("truth"), F.col("said")
    tests = (t & y, ~t & y, ~t & ~y, t & ~y, (F.col("label") == "music") & y, (F.col("label") == "clean_speech") & ~y)
    sums = [F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long").alias(name) for name, test in zip(_TOTALS, tests, strict=True)]
    by = ["kind", "threshold", "label"]
    grouped = c.groupingSets([by[:2], by], *by).agg(*sums, F.grouping("label").alias("whole"))
    return rates(grouped.filter("whole = 1 or label is not null").drop("whole"))


def check_document(doc: DataFrame, rows: DataFrame, label: Column, truth: Column, probability: Column, selected: float) -> None:
    """Raise unless doc is what document() gives for these rows. Compares a row a label."""
    due = document(rows, label, truth, probability, selected)
    doc = doc.select(*due.columns)
    if bad := doc.exceptAll(due).unionByName(due.exceptAll(doc)).limit(5).collect():
        raise ValueError(f"metrics do not agree with the rows at {selected}: {bad}")


def bare_ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: over zero, not a number or infinite."""
    return F.when(b != 0, a.cast("double") / b).when(a > 0, d(float("inf"))).when(a < 0, d(float("-inf"))).otherwise(d(float("nan")))


def policy_report(counted: DataFrame) -> DataFrame:
    """Add far, frr, f1 and avoided_pct to tp, fp, tn, fn, calls and ungated, none guarded against empty classes."""
    c = F.col
    p, q = bare_ratio(c("tp"), c("tp") + c("fp")), bare_ratio(c("tp"), c("tp") + c("fn"))
    return counted.withColumns({"far": bare_ratio(c("fp"), c("fp") + c("tn")), "frr": bare_ratio(c("fn"), c("tp") + c("fn")), "f1": bare_ratio(2 * p * q, p + q), "avoided_pct": bare_ratio(c("ungated") - c("calls"), c("ungated")) * 100})


def wer_report(pairs: DataFrame, by: str, skip_empty: bool = False) -> DataFrame:
    """Of ref and hyp texts with n_ref and errors, by group: n_refs, n_scored, n_skipped, n_empty_hyp, n_ref, errors, wer.

    Pairs without a reference do not count. An empty hypothesis is skipped, or else scored as such. Nothing scored: wer 0.
    """
    ref, empty = F.coalesce("ref", F.lit("")) != "", F.coalesce("hyp", F.lit("")) == ""
    skipped = ref & empty & F.lit(skip_empty)
    scored = ref & ~skipped
    some = lambda c: F.coalesce(F.sum(F.when(scored, F.col(c))), F.lit(0)).cast("long")
    counted = [F.count_if(ref).alias("n_refs"), F.count_if(scored).alias("n_scored"), F.count_if(skipped).alias("n_skipped"), F.count_if(scored & empty).alias("n_empty_hyp")]
    return pairs.groupBy(by).agg(*counted, some("n_ref").alias("n_ref"), some("errors").alias("errors"), ratio(some("errors"), some("n_ref")).alias("wer"))
