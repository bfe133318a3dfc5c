"""Linking of mentions: exact strings, oracles, thresholded similarity, and the roots of link forests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import dense_ids, running_sum
from .trees import _checkpointed

#: Rows multiplied at once on either side. Groups that rows are dealt into by seq, more only where a group would have more than LARGEST rows.
BLOCK, GROUPS, LARGEST = 1024, 16, 65_536


def string_match(df: DataFrame, seq: str = "seq", mention: str = "mention") -> DataFrame:
    return dense_ids(df, [mention], seq, "cluster_id").select(seq, "cluster_id")


def oracle_within_document(df: DataFrame, seq: str = "seq", entity: str = "entity_id", document: str = "document_id") -> DataFrame:
    return dense_ids(df, [entity, document], seq, "cluster_id").select(seq, "cluster_id")


def oracle_within_document_compat(df: DataFrame, seq: str = "seq", entity: str = "entity_id", document: str = "document_id") -> DataFrame:
    """The running form: for each row the number of distinct keys strictly before it."""
    first = df.withColumn("_new", (F.row_number().over(Window.partitionBy(entity, document).orderBy(seq)) == 1).cast("long"))
    return running_sum(first, seq, F.col("_new"), "_n").select(seq, (F.col("_n") - F.col("_new")).alias("cluster_id"))


def roots(parents: DataFrame, seq: str = "seq", parent: str = "parent") -> DataFrame:
    """seq, cluster_id: the root of each row under parent (null or itself at a root). Pointers are doubled until they rest."""
    now = _checkpointed(parents.select(F.col(seq).alias("n"), F.coalesce(parent, seq).alias("r")))
    while True:
        up = now.select(F.col("n").alias("r"), F.col("r").alias("further"))
        after = _checkpointed(now.join(up, "r").select("n", F.col("further").alias("r"), (F.col("further") != F.col("r")).alias("moved")))
        if after.filter("moved").isEmpty():
            return after.select(F.col("n").alias(seq), F.col("r").alias("cluster_id"))
        now = after.select("n", "r")


def _vector(df: DataFrame, vector: str) -> Column:
    """Single floats are half as large to send; matrix() makes doubles of them."""
    return F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.transform(vector, lambda x: x.cast("double"))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def block_pairs(df: DataFrame, seq: str, vector: str, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """x, y, b, seq, v and keep: each row once for each pair x <= y of groups that its own group b belongs to. Groups are ranges of seq, so that all of x comes before y.

    There are GROUPS groups, fewer for a few blocks of rows: so copies grow as the rows do. Beyond GROUPS x LARGEST rows groups keep LARGEST rows, which bounds a task's memory. Rows with a null vector take no part.
    """
    df = df.filter(F.col(vector).isNotNull())
    n = df.count()
    groups = max(1, -(-n // LARGEST), min(GROUPS, -(-n // block)))
    share = [i / groups for i in range(1, groups)]
    found = df.agg(F.percentile_approx(seq, share, 100 * groups).alias("q")).first()["q"] if share else None
    bounds = F.array(*map(F.lit, sorted(set(found)))) if found else F.array().cast("array<long>")
    own = df.select(F.col(seq).alias("seq"), _vector(df, vector).alias("v"), *keep).withColumn("b", F.size(F.filter(bounds, lambda q: q < F.col("seq"))))
    met = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda o: F.struct(F.least(o, F.col("b")).alias("x"), F.greatest(o, F.col("b")).alias("y")))
    return own.withColumn("p", F.explode(met)).select("p.x", "p.y", "b", "seq", "v", *keep)


def band_pairs(df: DataFrame, seq: str, vector: str, limit: int, block: int = BLOCK) -> DataFrame:
    """x, y, b, seq, v: blocks of consecutive seq, each with the limit rows before it, which have another b. So rows are copied once at most."""
    wide = max(block, limit, 1)
    own = df.filter(F.col(vector).isNotNull()).select(F.col(seq).alias("seq"), _vector(df, vector).alias("v")).withColumn("b", F.floor(F.col("seq") / wide).cast("long"))
    after = F.col("seq") >= (F.col("b") + 1) * wide - limit
    met = F.array_compact(F.array(F.col("b"), F.when(after, F.col("b") + 1)))
    return own.withColumn("x", F.explode(met)).select("x", F.col("x").alias("y"), "b", "seq", "v")


def backward_links(df: DataFrame, threshold: float, seq: str = "seq", vector: str = "embedding", limit: int | None = None, block: int = BLOCK, best: bool = True) -> DataFrame:
    """seq, parent, best: the latest earlier row within limit whose inner product is above threshold, and the greatest such product below it or above.

    parent is null for a row that starts a cluster. best is the greatest product with an eligible earlier row, null for the first; with best false it is null, and a row is
    done with in a pair of groups once it has a parent there. Rows meet in pairs of groups, of which block rows a side are multiplied at a time; one row a side leaves each pair of groups. With
    a limit each block meets only the rows before it that the limit reaches; without, all pairs of groups meet. Rows with a null vector take no part.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        late, early = pdf[pdf["b"] == y], (pdf[pdf["b"] == x] if limit is None else pdf).sort_values("seq", ascending=False)
        if not len(late) or not len(early):
            return pd.DataFrame({"seq": [], "parent": [], "best": []})
        i, k, a, b = late["seq"].to_numpy(), early["seq"].to_numpy(), matrix(late["v"]), matrix(early["v"])
        parent, most = np.full(len(i), -1, np.int64), np.full(len(i), -np.inf)
        for first in range(0, len(i), block):
            todo = np.arange(first, min(first + block, len(i)))
            for at in range(0, len(k), block):  # from the latest
                part = k[at : at + block]
                ok = None
                if x == y:
                    ok = part[None, :] < i[todo][:, None]
                    if limit is not None:
                        ok &= part[None, :] >= i[todo][:, None] - limit
                    if not ok.any():
                        continue
                s = a[todo] @ b[at : at + block].T
                if ok is not None:
                    s = np.where(ok, s, -np.inf)
                if best:
                    most[todo] = np.maximum(most[todo], s.max(axis=1))
                above = s > threshold
                hit = above.argmax(axis=1)
                has = above[np.arange(len(todo)), hit]
                parent[todo] = np.where(has & (parent[todo] < 0), part[hit], parent[todo])
                if not best:
                    todo = todo[~has]
                    if not len(todo):
                        break
        return pd.DataFrame({"seq": i, "parent": parent, "best": most})

    pairs = block_pairs(df, seq, vector, block) if limit is None else band_pairs(df, seq, vector, limit, block)
    found = pairs.groupBy("x", "y").applyInPandas(compare, "seq long, parent long, best double")
    merged = found.groupBy("seq").agg(F.max("parent").alias("parent"), F.max("best").alias("best"))
    return merged.select(F.col("seq").alias(seq), F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"), F.when(F.col("best") > float("-inf"), F.col("best")).alias("best"))


def backward_cluster(df: DataFrame, threshold: float, seq: str = "seq", vector: str = "embedding", limit: int | None = None) -> DataFrame:
    """seq, cluster_id: the first mention of the chain of latest qualifying links. Not the nearest link, nor connected components."""
    return roots(backward_links(df, threshold, seq, vector, limit, best=False), seq)


def bisect(count_at, target: int, n: int, steps: int = 100, tolerance: float | None = None) -> tuple[float, int, bool]:
    """Threshold in [0, 1], clusters there, and whether they are within tolerance (n / 1000) of the target; count_at(t) must not fall as t rises."""
    near = n / 1000 if tolerance is None else tolerance
    low, high, t, clusters = 0.0, 1.0, 0.5, 0
    for _ in range(steps):
        t = (low + high) / 2
        clusters = count_at(t)
        if abs(clusters - target) <= near:
            return t, clusters, True
        if t in (low, high):
            break
        low, high = (t, high) if clusters < target else (low, t)
    return t, clusters, False


def threshold_curve(links: DataFrame, target: int, steps: int = 100, tolerance: float | None = None) -> tuple[float, int, bool]:
    """bisect() over the curve of best scores: a row starts a cluster at t if its best is null or not above t.

    links is written once; each pass over it counts the rows in 1024 equal parts of the interval, which serves ten steps.
    """
    own = _checkpointed(links.select("best"))
    held: dict[float, int] = {}

    def counted(low: float, high: float) -> None:
        place = F.ceil((F.col("best") - low) / (high - low) * 1024)
        part = F.when(F.col("best").isNull(), -1).otherwise(F.greatest(F.least(place, F.lit(1025)), F.lit(0)))
        found = {r["p"]: r["n"] for r in own.groupBy(part.cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
        total = found.get(-1, 0)
        for k in range(1025):
            total += found.get(k, 0)
            held[low + k * (high - low) / 1024] = total

    def count_at(t: float) -> int:
        if t not in held:
            # The interval that the search is in: t is its middle.
            half = min(abs(t - x) for x in (0.0, 1.0, *held))
            counted(t - half, t + half)
        return held[t]

    return bisect(count_at, target, own.count(), steps, tolerance)


def find_threshold(df: DataFrame, target: int | None = None, steps: int = 100, seq: str = "seq", vector: str = "embedding", entity: str = "entity_id", limit: int | None = None) -> DataFrame:
    """One row: threshold, n_clusters, met, target. target is the number of distinct entities unless given."""
    if target is None:
        target = df.agg(F.countDistinct(entity)).first()[0]
    t, clusters, met = threshold_curve(backward_links(df, 0.0, seq, vector, limit), target, steps)
    return df.sparkSession.createDataFrame([(t, clusters, met, target)], "threshold double, n_clusters long, met boolean, target long")


def bigram_weights(strings: DataFrame, mention: str = "mention", vocabulary: DataFrame | None = None) -> DataFrame:
    """mention, term, w: character bigrams of distinct lower-cased strings, counts over their L2 norm. With a vocabulary (term) others are dropped first."""
    text = F.regexp_replace(F.lower(mention), r"\s+", " ")
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    counts = strings.select(mention).distinct().filter(F.length(text) > 1).select(mention, F.explode(grams).alias("term")).groupBy(mention, "term").agg(F.count("*").cast("double").alias("c"))
    if vocabulary is not None:
        counts = counts.join(vocabulary.select("term"), "term", "left_semi").select(mention, "term", "c")
    norm = counts.groupBy(mention).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return counts.join(norm, mention).select(mention, "term", (F.col("c") / F.col("n")).alias("w"))


def similar_strings(weights: DataFrame, threshold: float, mention: str = "mention") -> DataFrame:
    """a, b, score of distinct strings (both directions, each with itself) whose rounded cosine is above threshold; weights: unit vectors.

    A string is found by its rarest terms only, as many as leave the others together too small to reach the threshold; so common terms pair strings only where
    they must. Candidates' cosines are then computed from whole vectors. With a threshold of 0 or less all common terms pair.
    """
    own = _checkpointed(weights.select(F.col(mention).alias("m"), "term", "w"))
    often = own.groupBy("term").agg(F.count("*").alias("often"))
    w = Window.partitionBy("m").orderBy("often", "term")
    ranked = own.join(often, "term").withColumn("rest", F.sum(F.col("w") * F.col("w")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    probe = _checkpointed(ranked.filter(F.col("rest") >= max(0.0, threshold - 1e-6) ** 2 - 1e-9).select("m", "term"))
    pairs = probe.select(F.col("m").alias("a"), "term").join(probe.select(F.col("m").alias("b"), "term"), "term").filter("a <= b").select("a", "b").distinct()
    whole = own.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))
    left, right = whole.select(F.col("m").alias("a"), F.col("v").alias("va")), whole.select(F.col("m").alias("b"), F.map_from_entries("v").alias("vb"))
    product = F.aggregate("va", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at(F.col("vb"), x["term"]), F.lit(0.0)))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", F.round(product, 9).alias("score")).filter(F.col("score") > threshold)
    return found.unionByName(found.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def overwrite_cluster(df: DataFrame, similar: DataFrame, seq: str = "seq", mention: str = "mention") -> DataFrame:
    """seq, cluster_id of the sequential overwrite: a row takes the root of the latest row, itself or any other, that it is similar to.

    Each row is an event for every string like its own; a row's parent is the latest event of its own string before it. So pairs of rows are never made.
    """
    rows = df.select(F.col(seq).alias("seq"), F.col(mention).alias("m"))
    events = rows.join(similar.select(F.col("a").alias("m"), F.col("b").alias("to")), "m").select(F.col("to").alias("m"), "seq", (F.col("m") == F.col("to")).alias("own"))
    w = Window.partitionBy("m").orderBy("seq")
    linked = events.withColumn("parent", F.max("seq").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("last", F.max("seq").over(Window.partitionBy("m"))).filter("own")
    alone = rows.join(linked.select("seq"), "seq", "left_anti").select("seq", F.lit(None).cast("long").alias("parent"), F.col("seq").alias("last"))
    whole = linked.select("seq", "parent", "last").unionByName(alone)
    root = roots(whole)
    return whole.select(F.col("seq").alias("s"), F.col("last").alias("seq")).join(root, "seq").select(F.col("s").alias(seq), "cluster_id")


def bigram_vocabulary(strings: DataFrame, mention: str = "mention") -> DataFrame:
    """term: the character bigrams of the strings, as a model table for bigram_weights()."""
    return bigram_weights(strings, mention).select("term").distinct()


def overwrite_pairs(df: DataFrame, pairs: DataFrame, seq: str = "seq") -> DataFrame:
    """seq, cluster_id of the sequential overwrite over pairs (seq, earlier) of similar rows: a row takes the root of the latest row that it is similar to."""
    rows = df.select(F.col(seq).alias("seq"))
    one, two = pairs.select(F.col(seq).alias("a"), F.col("earlier").alias("b")), pairs.select(F.col("earlier").alias("a"), F.col(seq).alias("b"))
    # A row may count as similar to itself: that changes nothing.
    similar = one.unionByName(two).unionByName(rows.select(F.col("seq").alias("a"), F.col("seq").alias("b")))
    return overwrite_cluster(rows.withColumn("_own", F.col("seq")), similar, "seq", "_own").withColumnRenamed("seq", seq)
