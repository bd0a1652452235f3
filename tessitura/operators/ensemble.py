"""Scoring of boosted trees given as tables: a vectorised Arrow form, and a pure-SQL form that keeps the order of trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.numeric import d

#: (left, right, feature, threshold, value); a leaf has left and right -1.
Node = tuple[int, int, int, float, float]


@dataclass(frozen=True)
class Ensemble:
    trees: tuple[tuple[Node, ...], ...]
    init: float
    rate: float
    n_features: int

    def __post_init__(self):
        for t in self.trees:
            seen, todo = set(), [0]
            while todo:
                i = todo.pop()
                if not 0 <= i < len(t) or i in seen:
                    raise ValueError("a tree refers to a node that is missing or met twice")
                seen.add(i)
                left, right, feature, threshold, value = t[i]
                if left < 0 or right < 0:
                    if (left, right) != (-1, -1) or not np.isfinite(value):
                        raise ValueError("a leaf has one child or no finite value")
                    continue
                if not 0 <= feature < self.n_features or not np.isfinite(threshold):
                    raise ValueError("a split has no such feature or no finite threshold")
                todo += [left, right]


def small_ensemble(n_features: int, n_trees: int = 12, init: float = 0.35, rate: float = 0.1) -> Ensemble:
    """A hand-made ensemble of depth 2 for tests and queries; the scorer takes any other."""
    trees = []
    for t in range(n_trees):
        f, g, h = t % n_features, (3 * t + 1) % n_features, (5 * t + 2) % n_features
        cut = lambda k: 0.125 * (1 + (t + k) % 7)
        leaf = lambda k: ((7 * t + 3 * k) % 11 - 5) / 4
        trees.append(((1, 2, f, cut(0), 0.0), (3, 4, g, cut(1), 0.0), (5, 6, h, cut(2), 0.0), *((-1, -1, 0, 0.0, leaf(k)) for k in range(4))))
    return Ensemble(tuple(trees), init, rate, n_features)


def _case(tree: tuple[Node, ...], x: list[Column], i: int = 0) -> Column:
    left, right, feature, threshold, value = tree[i]
    return d(value) if left < 0 else F.when(x[feature] <= threshold, _case(tree, x, left)).otherwise(_case(tree, x, right))


def score_sql(e: Ensemble, x: list[Column]) -> Column:
    """init + rate * leaf of each tree in turn; at a threshold a value goes left."""
    return F.aggregate(F.array(*[_case(t, x) for t in e.trees]), d(e.init), lambda a, v: a + d(e.rate) * v)


def score_arrow(e: Ensemble):
    """The same of an array<double> column, vectorised over a batch. Rows of another width or with values that are not finite raise."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.float64())
        lengths = np.diff(column.offsets.to_numpy())
        x = column.flatten().to_numpy(zero_copy_only=False)
        if column.null_count or (lengths != e.n_features).any() or not np.isfinite(x).all():
            raise ValueError(f"features must be {e.n_features} finite numbers")
        x = x.reshape(-1, e.n_features)
        out = np.full(len(x), e.init)
        rows = np.arange(len(x))
        for t in e.trees:
            left, right, feature, threshold, value = (np.array(c) for c in zip(*t, strict=True))
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := left[at] >= 0).any():
                go = x[rows, feature[at]] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += e.rate * value[at]
        return pa.array(out)

    return run


def duck_sql(e: Ensemble, x: list[str]) -> str:
    """The score as SQL text."""

    def case(t, i=0):
        left, right, f, threshold, value = t[i]
        return f"{value!r}::DOUBLE" if left < 0 else f"CASE WHEN {x[f]} <= {threshold!r}::DOUBLE THEN {case(t, left)} ELSE {case(t, right)} END"

    out = f"{e.init!r}::DOUBLE"
    for t in e.trees:
        out = f"({out} + {e.rate!r}::DOUBLE * {case(t)})"
    return out
