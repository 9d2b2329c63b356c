"""Connected components of an edge table, by repeated smallest labels and label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import written

#: Each round at least halves the longest chain of labels; this many rounds cover any graph that fits on disk.
MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of (a, b) edges: label is the smallest node that edges reach.

    Nodes without an edge don't appear; self-edges and repeated edges are
    harmless; null ends are dropped. Each round takes the smallest label among
    a node and its neighbours (partial minima, so that a node with very many
    edges is no hot group), then the label of that label. Labels are a written
    table, so each join's other side can be split where a key is hot.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower")), "lower")
        target = lower.select(F.col("node").alias("t"), F.col("lower").alias("jump"))
        jumped = lower.join(target, lower["lower"] == target["t"], "left").select("node", "label", F.least("lower", F.coalesce("jump", "lower")).alias("new"))
        done = written(jumped, "labels")
        labels = done.select("node", F.col("new").alias("label"))
        if done.where(F.col("new") != F.col("label")).isEmpty():
            return labels
    raise RuntimeError("components did not settle")
