"""Connected components of an undirected graph of numbered nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.sources.store import cut


#: edges that one task joins in memory (16 bytes each)
JOINED = 1 << 20


def _stars(batches):
    """(a, b): for each component of a task's edges its smallest node a, with every node b, itself included."""
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([p[0] for p in parts] + [p[1] for p in parts]), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes[label]), pa.array(nodes)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, for the nodes of edges (a, b).

    Edges are dealt by ranges of their lesser node to tasks of about JOINED edges, which replace them by the stars of what they
    join; for a small graph that is all.  Where numbers are places, as those of cells are, few nodes are in the stars of
    several tasks.  Such a node ties the stars' centres together, and the graph of these ties, where it is much smaller, is
    joined the same way; else by rounds that hook each node's label onto the least label around it and jump the pointers."""
    edges = cut(edges.select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).where("a <> b"))
    return _joined(edges, edges.count())


def _joined(edges: DataFrame, count: int) -> DataFrame:
    tasks = -(-count // JOINED)
    if tasks <= 1:
        return edges.coalesce(1).mapInArrow(_stars, "a bigint, b bigint").select(F.col("b").alias("node"), F.col("a").alias("label"))
    stars = cut(edges.repartitionByRange(tasks, "a", "b").mapInArrow(_stars, "a bigint, b bigint"))
    ends = stars.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("_n"))
    ends = cut(ends)
    # of a node in three tasks or more, all centres are tied to the least one
    several = ends.where("_n > 2").select("b", "low")
    ties = ends.where("_n = 2 AND low <> high").select(F.col("low").alias("a"), F.col("high").alias("b"))
    ties = cut(ties.unionByName(stars.join(several.hint("merge"), "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct())
    left = ties.count()
    named = ends.select(F.col("b").alias("node"), F.col("low").alias("centre"))
    if not left:
        return named.withColumnRenamed("centre", "label")
    met = cut(_joined(ties, left) if left <= max(JOINED, count // 4) else _rounds(ties))
    found = named.join(met.select(F.col("node").alias("centre"), "label").hint("merge"), "centre", "left")
    return found.select("node", F.coalesce("label", "centre").alias("label"))


def _rounds(edges: DataFrame) -> DataFrame:
    """components() by hooking and pointer jumping (label of the label), for graphs of any kind: the number of rounds grows with the
    logarithm of a component's diameter.  A round is cut to the shared folder; sums of labels tell when nothing moves."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    total = None
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
        # a whole tree follows when one of its nodes sees a lower label
        # (a table of its own, so that Spark can split a large tree's rows in the join)
        lower = cut(hooked.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("to")))
        moved = labels.join(lower, labels["label"] == lower["root"]).select("node", F.col("to").alias("label"))
        jump = moved.select(F.col("node").alias("root"), F.col("label").alias("far"))
        labels = cut(moved.join(jump, moved["label"] == jump["root"], "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
