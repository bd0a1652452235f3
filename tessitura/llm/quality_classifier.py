"""Quality classifier from weak labels: EM over overlapping labellers gives posterior labels, which train hashed linear scorers.

Two heads share the features: quality, from heuristics about the text; and toxicity, from an insult list and from human
labels where there are any. The fit reads a bounded sample; every document is labelled and scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bytescan, votes
from tessitura.llm.common import store, table
from tessitura.llm.quality_rules import STATS, rules, scan

BITS = 20
#: Rows that the scorers are fitted on, at most about so many.
FIT_ROWS = 10_000
#: Common insults. Fixed values; the scorer learns others from labels.
INSULTS = "idiot idiots moron morons stupid imbecile loser losers clown scum trash dumb fool pathetic worthless".split()
_STEPS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, text numbers, STATS' hits on insults) of a slice, features once a text.

    A word, a word's shape (its last byte, whether it begins with a capital, its length), and each statistic's share of words
    or characters in steps.
    """
    low = bytescan.TO_LOWER[data]
    w = bytescan.Words(low, offsets)
    doc = w.doc()
    letters = np.flatnonzero(np.isin(low, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)) | (low >= 0x80))
    # Words without the signs around them: from their first to their last letter.
    i = np.searchsorted(letters, w.starts)
    j = np.searchsorted(letters, w.ends) - 1
    has = i <= j
    starts = np.where(has, letters[np.minimum(i, len(letters) - 1)], w.starts) if len(letters) else w.starts
    ends = np.where(has, letters[np.maximum(j, 0)] + 1, w.ends) if len(letters) else w.ends
    bare = bytescan.ranges(low, starts, ends)
    shape = data[w.ends - 1].astype(np.uint64) if len(w.ends) else np.zeros(0, np.uint64)
    capital = (data[w.starts] >= 65) & (data[w.starts] <= 90) if len(w.starts) else np.zeros(0, bool)
    shape = bytescan.mix(shape * np.uint64(64) + capital.astype(np.uint64) * np.uint64(32) + np.minimum((w.ends - w.starts) // 4, 31).astype(np.uint64) + np.uint64(1 << 40))
    s = scan(data, offsets)
    share = [s[x] / np.maximum(s["n_lines" if x == "n_dup_lines" else "n_letters" if x == "n_upper" else "n_words"], 1) for x in STATS]
    steps = [bytescan.mix(np.searchsorted(_STEPS, v).astype(np.uint64) + np.uint64((k + 2) << 41)) for k, v in enumerate(share)]
    texts = np.arange(len(offsets) - 1)
    h = np.concatenate([bare, shape, *steps])
    d = np.concatenate([doc, doc, *[texts] * len(steps)])
    keys = np.unique((d.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), (keys >> np.uint64(BITS)).astype(np.int64), bytescan.sums(np.isin(bare, _insults()).astype(np.int64), w.first)


def _insults() -> np.ndarray:
    raw = [x.encode() for x in INSULTS]
    offsets = np.cumsum([0, *map(len, raw)])
    return bytescan.ranges(np.frombuffer(b"".join(raw), np.uint8), offsets[:-1], offsets[1:])


class Ftrl:
    """Logistic regression by FTRL-proximal over sets of feature numbers; most weights stay zero."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, target: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35)))
        g = p - target
        self.bias -= 0.05 * g
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g

    def fit(self, rows: list[np.ndarray], targets: np.ndarray, rounds: int = 4, seed: int = 5) -> tuple[np.ndarray, float]:
        order = np.random.default_rng(seed)
        for _ in range(rounds if rows else 0):
            for i in order.permutation(len(rows)):
                self.learn(rows[i], float(targets[i]))
        return self.weights().astype(np.float32), self.bias


def _describe():
    @F.arrow_udf("struct<" + ", ".join(f"{s}: bigint" for s in STATS) + ", insults: bigint>")
    def run(text: pa.Array) -> pa.Array:
        parts = [(scan(d, o), features(d, o)[2]) for _, _, d, o in bytescan.slices(text)]
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
        return pa.StructArray.from_arrays([*(join([p[0][s] for p in parts]) for s in STATS), join([p[1] for p in parts])], [*STATS, "insults"])

    return run


def _features_of():
    @F.arrow_udf("binary")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for i, j, d, o in bytescan.slices(text):
            number, doc, _ = features(d, o)
            at = np.searchsorted(doc, np.arange(j - i + 1))
            out += [number[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.array(out, pa.binary())

    return run


def quality_votes(s: str = "stats") -> dict[str, Column]:
    """The rules, and two more labellers that overlap them: half of all words repeated, and fewer than 50 words."""
    n, r = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return rules(s) | {
        "mostly_repeats": F.when(2 * r > n, -1).when(10 * r < n, 1).otherwise(0),
        "brief": F.when(n < 50, -1).when(n >= 100, 1).otherwise(0),
    }


def toxic_votes(s: str = "stats", label: str = "toxic_label") -> dict[str, Column]:
    """Votes on a text being free of toxicity: the insult list, and a human label, where there is one."""
    return {
        "insults": F.when(F.col(f"{s}.insults") >= 2, -1).when(F.col(f"{s}.insults") == 0, 1).otherwise(0),
        "label": F.when(F.col(label) == 1, -1).when(F.col(label) == 0, 1).otherwise(0),
    }


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labels: DataFrame | None = None, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, weak_quality (posterior of the labellers), quality_score, toxic_score, kept; one row per row of docs.

    labels: (doc_id, toxic 0 or 1), a labeller of toxicity that abstains elsewhere; of several labels of an id the largest
    counts. kept: quality_score at least, toxic_score below threshold, and the text has a word. Null text counts as empty and
    is not kept. The scorers are fitted on about fit_rows rows, picked by a hash of id and text; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = own.withColumn("stats", _describe()("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("pick"), "stats")
    if labels is None:
        rows = rows.withColumn("toxic_label", F.lit(None).cast("int"))
    else:
        # One label an id on the right, so that a document's row stays one row; a null id has no label.
        given = labels.select(F.col("doc_id"), F.col("toxic").alias("toxic_label")).groupBy("doc_id").agg(F.max("toxic_label").alias("toxic_label"))
        rows = rows.join(given, "doc_id", "left")
    rows = store(rows, "weak")
    labelled, _ = votes.label(rows, list(quality_votes().values()), "weak_quality")
    labelled, _ = votes.label(labelled, list(toxic_votes().values()), "weak_clean")

    total = max(1, rows.count())
    limit = int(min(1.0, fit_rows / total) * (1 << 30))
    pick = F.pmod("pick", F.lit(1 << 30)) < limit if limit < 1 << 30 else F.lit(True)
    sample = own.withColumn("pick", F.xxhash64("doc_id", "text")).filter(pick).select("pick", _features_of()("text").alias("f"))
    fit_on = labelled.filter(pick).select("pick", "weak_quality", "weak_clean").dropDuplicates(["pick"]).join(sample.dropDuplicates(["pick"]), "pick").orderBy("pick").collect()
    f = [np.frombuffer(r["f"], np.int32) for r in fit_on]
    good, good_bias = Ftrl().fit(f, np.array([r["weak_quality"] for r in fit_on]))
    clean, clean_bias = Ftrl().fit(f, np.array([r["weak_clean"] for r in fit_on]))
    heads = spark.sparkContext.broadcast((good, good_bias, clean, clean_bias))  # two times 2**BITS weights

    @F.arrow_udf("struct<quality: double, clean: double>")
    def score(column: pa.Array) -> pa.Array:
        good, good_bias, clean, clean_bias = heads.value
        out = [[], []]
        for i, j, d, o in bytescan.slices(column):
            number, doc, _ = features(d, o)
            for k, (w, b) in enumerate(((good, good_bias), (clean, clean_bias))):
                x = np.bincount(doc, w[number], minlength=j - i) + b
                out[k].append(1 / (1 + np.exp(-np.clip(x, -35, 35))))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0)) for x in out], ["quality", "clean"])

    weak = labelled.select("pick", "doc_id", "weak_quality", (F.col("stats.n_words") > 0).alias("has")).dropDuplicates(["pick"]).drop("doc_id")
    scored = own.withColumn("pick", F.xxhash64("doc_id", "text")).withColumn("s", score("text")).select("doc_id", "pick", F.col("s.quality").alias("quality_score"), (1 - F.col("s.clean")).alias("toxic_score"))
    return scored.join(weak, "pick", "left").select("doc_id", "weak_quality", "quality_score", "toxic_score", (F.col("has") & (F.col("quality_score") >= threshold) & (F.col("toxic_score") < threshold)).alias("kept"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, fitted with the labels of toxicity."""
    return classify(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels").select("doc_id", "toxic"))
