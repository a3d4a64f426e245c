"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Edges that one task joins up by itself (16 bytes each); larger graphs spread labels by joins.
LOCAL_EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the smallest node of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _local(batches):
    parts = [(p["a"].to_numpy(), p["b"].to_numpy()) for p in batches]
    if parts:
        node, label = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pd.DataFrame({"node": node, "label": label})


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, label (smallest node of its component) for every node of edges (a long, b long); loops may occur."""
    edges = durable(edges.select("a", "b").distinct())
    if edges.count() <= local_edges:
        return edges.repartition(1).mapInPandas(_local, "node long, label long")
    both = durable(edges.union(edges.select("b", "a")).filter("a <> b"))
    label = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        done = durable(step.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")))
        if done.filter("label <> next").isEmpty():
            return done.select("node", "label")
        label = done.select("node", F.col("next").alias("label"))
