"""Model fitting with Spark ML: boosted trees, logistic regression and a random forest, and the export of trees to a table.

Spark bins split candidates, so a fit is an analogue of other libraries' fits, not their numbers.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators.ensemble import Ensemble, Node


def assemble(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows).withColumn("label", F.col(label).cast("double"))


def gbt(rows: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42):
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(assemble(rows, features, label))


def logistic(rows: DataFrame, features: list[str], label: str, c: float = 1.0):
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", regParam=1 / c / max(1, rows.count()))]
    return Pipeline(stages=stages).fit(assemble(rows, features, label))


def forest(rows: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 6, least: int = 3, seed: int = 42):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed).fit(assemble(rows, features, label))


def importance(model, features: list[str], n: int = 10) -> list[tuple[str, float]]:
    """The n most important features, ties by name."""
    weights = model.featureImportances.toArray().tolist()
    return sorted(zip(features, weights, strict=True), key=lambda x: (-x[1], x[0]))[:n]


def export(model, n_features: int) -> Ensemble:
    """A fitted boosted model as an Ensemble whose raw score is the log odds (twice the model's margin)."""
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[Node] = []

        def add(node, weight=weight, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append((-1, -1, 0, 0.0, 0.0))
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, -1, 0, 0.0, 2 * weight * node.prediction())
            else:
                left, right = add(node.leftChild()), add(node.rightChild())
                nodes[at] = (left, right, node.split().featureIndex(), float(node.split().threshold()), 0.0)
            return at

        add(tree._java_obj.rootNode())
        trees.append(tuple(nodes))
    return Ensemble(tuple(trees), 0.0, 1.0, n_features)


def to_table(spark, e: Ensemble) -> DataFrame:
    """(tree, node, left, right, feature, threshold, value), to keep as Parquet."""
    rows = [(i, j, *n) for i, t in enumerate(e.trees) for j, n in enumerate(t)]
    return spark.createDataFrame(rows, "tree int, node int, left int, right int, feature int, threshold double, value double")


def from_table(nodes: DataFrame, init: float, rate: float, n_features: int) -> Ensemble:
    """The ensemble of a table; it is checked as it is built. A model's table is small: hundreds of trees of a few nodes."""
    trees: dict[int, list[Node]] = {}
    for r in nodes.orderBy("tree", "node").collect():
        trees.setdefault(r["tree"], []).append(tuple(r)[2:])
    return Ensemble(tuple(map(tuple, trees.values())), init, rate, n_features)
