"""Connected components by contraction, for the pair operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is its smallest node.

    Each round sends every node to the smallest of itself and its neighbours and joins the edges' ends; loops and
    repeats go, so a star is done in one round and any graph in a number of rounds near the logarithm of its size.
    Null ends and loops are no edges.
    """
    left = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    labels = None
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")))
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            labels = labels.join(step, labels.component == step.u, "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = cut(labels)
        ends = left.join(step, "u").select(F.col("to").alias("x"), "v")
        ends = ends.join(step, ends.v == step.u).select(F.least("x", "to").alias("u"), F.greatest("x", "to").alias("v"))
        left = cut(ends.where("u <> v").distinct())
        if left.isEmpty():
            return labels
