"""Operators on trees given as edges (uid, parent, label): closure, leaves, cuts and purity."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in the folder that the session names; a temporary one only where driver and executors are one process."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="mentionflow-"))
    return df.checkpoint()


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.filter("parent is not null").select(F.col("parent").alias("uid")).distinct(), "uid", "left_anti")


def leaf_paths(tree: DataFrame) -> DataFrame:
    """node, via, leaf, height: for each leaf each node on its way to the root; via is the child of node on that way, null at the leaf; height counts the steps. A cycle in the edges is an error."""
    up = tree.select("uid", "parent")
    now = _checkpointed(leaves(tree).select(F.col("uid").alias("node"), F.lit(None).cast(tree.schema["uid"].dataType).alias("via"), F.col("uid").alias("leaf"), F.lit(0).alias("height")))
    out, n, height = now, tree.count(), 0
    while True:
        height += 1
        if height > n:
            raise ValueError("the edges have a cycle")
        now = _checkpointed(now.join(up, now["node"] == up["uid"]).filter("parent is not null").select(F.col("parent").alias("node"), F.col("uid").alias("via"), "leaf", (F.col("height") + 1).alias("height")))
        if now.isEmpty():
            return out
        out = out.unionByName(now)


def purity(tree: DataFrame) -> DataFrame:
    """One row: over pairs of leaves of one label, the mean share of that label among the leaves of their lowest common ancestor."""
    paths = leaf_paths(tree).join(tree.select(F.col("uid").alias("leaf"), "label"), "leaf")
    inner = paths.filter("via is not null").groupBy("node", "via", "label").agg(F.count("*").cast("double").alias("c"))
    each = inner.groupBy("node", "label").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"), F.sum("c").alias("n"))
    total = inner.groupBy("node").agg(F.sum("c").alias("size"))
    weighted = each.join(total, "node").agg(F.sum(F.col("pairs") * F.col("n") / F.col("size")).alias("hit"), F.sum("pairs").alias("pairs"))
    return weighted.select(F.round(F.col("hit") / F.col("pairs"), 6).alias("purity"))


def child_means(paths: DataFrame, vectors: DataFrame, leaf: str = "uid", vector: str = "embedding") -> DataFrame:
    """node, via, pos, value: the mean vector of the leaves under each child (via) of each inner node."""
    parts = vectors.select(F.col(leaf).alias("leaf"), F.posexplode(vector).alias("pos", "x"))
    return paths.filter("via is not null").join(parts, "leaf").groupBy("node", "via", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroids(paths: DataFrame, vectors: DataFrame, leaf: str = "uid", vector: str = "embedding") -> DataFrame:
    """node, pos, value: the mean vector of the leaves under each node, the leaf itself at a leaf."""
    parts = vectors.select(F.col(leaf).alias("leaf"), F.posexplode(vector).alias("pos", "x"))
    return paths.join(parts, "leaf").groupBy("node", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def scores(paths: DataFrame, vectors: DataFrame, dot_product: bool = False, leaf: str = "uid", vector: str = "embedding") -> DataFrame:
    """node, score: the cosine (or inner product) of the mean vectors of a node's two children; a node with one child has no score, a zero mean gives 0."""
    means = child_means(paths, vectors, leaf, vector)
    sides = means.groupBy("node", "pos").agg(F.min_by("value", "via").alias("a"), F.max_by("value", "via").alias("b"), F.count("*").alias("k")).filter("k = 2")
    product, sizes = F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))
    return sides.groupBy("node").agg((product if dot_product else F.when(sizes > 0, product / sizes).otherwise(0.0)).alias("score"))


def cut(paths: DataFrame, node_scores: DataFrame, threshold: float) -> DataFrame:
    """leaf, cluster_id: the topmost node on the leaf's way with a score of threshold or more, else the leaf itself."""
    scored = paths.join(node_scores, "node", "left").filter((F.col("score") >= threshold) | F.col("via").isNull())
    return scored.groupBy("leaf").agg(F.max_by("node", "height").alias("cluster_id"))
