"""Gradient-boosted trees: trained by Spark, scored by column expressions or in tasks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def fit(rows: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7):
    """A boosted model of columns features (array<double>) and label (0 or 1); None without both labels."""
    kinds = rows.groupBy("label").count().collect()
    if len(kinds) < 2:
        return None
    data = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, seed=seed, cacheNodeIds=False).fit(data)


def tables(model, spark) -> list[tuple[float, np.ndarray]]:
    """Weight and nodes (feature, threshold, left, right, value) of every tree, read from the saved model."""
    at = f"{shared_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(at)
    out = []
    found: dict[int, dict[int, tuple]] = {}
    for r in spark.read.parquet(f"{at}/data").collect():  # a few hundred nodes
        d = r["nodeData"] if "nodeData" in r else r
        split = d["split"]
        cut = split["leftCategoriesOrThreshold"]
        found.setdefault(r["treeID"], {})[d["id"]] = (
            split["featureIndex"], cut[0] if len(cut) else 0.0, d["leftChild"], d["rightChild"], d["prediction"],
        )
    for k, weight in enumerate(model.treeWeights):
        nodes = found[k]
        out.append((float(weight), np.array([nodes[i] for i in sorted(nodes)], float)))
    return out


def margin(x: np.ndarray, forest: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Half the log-odds of each row of ``x``, as the trainer defines them."""
    total = np.zeros(len(x))
    for weight, nodes in forest:
        at = np.zeros(len(x), int)
        while True:
            inner = nodes[at, 2] >= 0
            if not inner.any():
                break
            f = np.maximum(nodes[at, 0].astype(int), 0)
            left = x[np.arange(len(x)), f] <= nodes[at, 1]
            at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]), at).astype(int)
        total += weight * nodes[at, 4]
    return total
