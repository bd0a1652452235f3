"""Weak supervision: votes of rules, aggregated by pattern, and expectation-maximisation of the rules' accuracies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vote pattern is a number in base 3; 20 rules fit a long with room to spare, and at most 3**rules patterns exist.
MOST_RULES = 12


@dataclass(frozen=True)
class LabelModel:
    """prior of good; right[j] = (P(votes good | good and voting), P(votes bad | bad and voting)) of rule j."""

    prior: float
    right: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes) for rows of votes 1, 0 (abstains) or -1. A row without votes gets the prior."""
        good, bad = np.log(self.prior), np.log(1 - self.prior)
        g, b = self.right[:, 0], self.right[:, 1]
        odds = good - bad + (votes == 1) @ (np.log(g) - np.log(1 - b)) + (votes == -1) @ (np.log(1 - g) - np.log(b))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.8) -> LabelModel:
    """EM over distinct vote patterns and their counts.

    A rule's two accuracies stay where agreeing with the class is likelier than not agreeing, so that classes keep their
    meaning; abstaining says nothing about the class. Without rows, the starting values hold.
    """
    n = votes.shape[1]
    model = LabelModel(prior, np.tile([0.98, 0.25], (n, 1)))
    for _ in range(rounds if len(votes) else 0):
        p = model.posterior(votes)
        good, bad = p * counts, (1 - p) * counts
        up, down = votes == 1, votes == -1
        g = (good @ up + 9.5) / (good @ (up | down) + 10)
        b = (bad @ down + 1.0) / (bad @ (up | down) + 4)
        b = np.maximum(b, np.minimum(0.9, 1.5 * (1 - g)))
        new = LabelModel(float(np.clip((good.sum() + 8) / (counts.sum() + 10), 0.05, 0.98)), np.clip(np.stack([g, b], 1), 0.02, 0.995))
        if np.abs(new.right - model.right).max() < 1e-9 and abs(new.prior - model.prior) < 1e-9:
            break
        model = new
    return model


def pattern(votes: list[Column]) -> Column:
    """The votes' pattern as a number: digits vote + 1 in base 3."""
    if len(votes) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(0)
    for v in votes:
        out = out * 3 + (v + 1)
    return out.cast("int")


def unpack(patterns: list[int], n: int) -> np.ndarray:
    digits = np.array(patterns, dtype=np.int64).reshape(-1, 1) // 3 ** np.arange(n - 1, -1, -1)
    return digits % 3 - 1


def label(rows: DataFrame, votes: list[Column], into: str) -> tuple[DataFrame, LabelModel]:
    """Add the posterior of good as column `into`. Only patterns and counts reach the driver: at most 3**len(votes) rows."""
    marked = rows.withColumn("__pattern", pattern(votes))
    found = marked.groupBy("__pattern").count().collect()
    table = unpack([r[0] for r in found], len(votes))
    model = fit(table, np.array([r[1] for r in found], dtype=float))
    p = model.posterior(table) if len(found) else []
    lookup = rows.sparkSession.createDataFrame(pa.table({"__pattern": pa.array([r[0] for r in found], pa.int32()), into: pa.array(p, pa.float64())}))
    return marked.join(F.broadcast(lookup), "__pattern", "left").drop("__pattern"), model
