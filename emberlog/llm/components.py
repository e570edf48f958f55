"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b), longs, written tables -> (node, label): equal labels mean connected.

    Each round every node takes the least of itself and its neighbours, in a hashed order, as
    label, and the graph shrinks to the labels that edges still join. The hashed order makes the
    expected number of rounds logarithmic, whatever the shape. Each round's labels and edges are
    written tables, so a hub's rows are split by adaptive joins; nothing comes to the driver.
    """
    layers: list[DataFrame] = []
    while not layers or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b").alias("h"), "b"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        labels = both.groupBy("a").agg(least.alias("least"))
        labels = labels.select(F.col("a").alias("node"), F.least("least", own)["b"].alias("label"))
        labels = materialize(labels, f"{name}-labels")
        layers.append(labels)
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        joined = edges.join(left, "a").join(right, "b").where("la <> lb")
        edges = joined.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        edges = materialize(edges, f"{name}-edges")
    found = layers[0]
    for layer in layers[1:]:
        up = layer.select(F.col("node").alias("label"), F.col("label").alias("above"))
        found = found.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return found
