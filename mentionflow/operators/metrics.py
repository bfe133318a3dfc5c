"""Coreference metrics over an assignment table (true_id, pred_id), a row for each mention."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ceaf import best_assignment
from .trees import _checkpointed


def contingency(df: DataFrame) -> DataFrame:
    return df.groupBy("true_id", "pred_id").agg(F.count("*").alias("n"))


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = contingency(df)
    side = lambda c: n.groupBy(c).agg(F.sum("n").alias("size"), F.count("*").alias("parts"))
    return n, side("true_id"), side("pred_id")


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def muc(df: DataFrame) -> DataFrame:
    """One row: precision, recall, f1; 0 where nothing can be linked."""
    _, true, pred = _sides(df)
    sides = pred.select("size", "parts", F.lit(True).alias("pred")).unionByName(true.select("size", "parts", F.lit(False).alias("pred")))
    ratio = lambda own: F.coalesce(F.sum(F.when(own, F.col("size") - F.col("parts"))), F.lit(0)) / (F.coalesce(F.sum(F.when(own, F.col("size") - 1)), F.lit(0)) + F.lit(1e-13))
    both = sides.agg(ratio(F.col("pred")).alias("precision"), ratio(~F.col("pred")).alias("recall"))
    return both.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(_f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


def b_cubed(df: DataFrame) -> DataFrame:
    n, true, pred = _sides(df)
    whole = n.join(true.select("true_id", F.col("size").alias("t")), "true_id").join(pred.select("pred_id", F.col("size").alias("p")), "pred_id")
    found = whole.agg((F.sum(F.col("n") * F.col("n") / F.col("p")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("t")) / F.sum("n")).alias("recall"))
    return found.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(_f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


def phi4(df: DataFrame) -> DataFrame:
    n, true, pred = _sides(df)
    whole = n.join(true.select("true_id", F.col("size").alias("t")), "true_id").join(pred.select("pred_id", F.col("size").alias("p")), "pred_id")
    return whole.select("true_id", "pred_id", F.round(2 * F.col("n") / (F.col("t") + F.col("p")), 6).alias("phi4"))


def conflated_divided(df: DataFrame) -> DataFrame:
    _, true, pred = _sides(df)
    sides = pred.select((F.col("parts") - 1).alias("conflated"), F.lit(0).alias("divided")).unionByName(true.select(F.lit(0).cast("long").alias("conflated"), (F.col("parts") - 1).alias("divided")))
    return sides.agg(F.sum("conflated").alias("conflated"), F.sum("divided").alias("divided"))


def most_mixed(df: DataFrame, by: str, other: str, seq: str = "seq") -> DataFrame:
    """One row: the group of by with most distinct values of other, ties to the one first seen."""
    found = df.groupBy(by).agg(F.countDistinct(other).alias("parts"), F.min(seq).alias("first_seq"), F.count("*").alias("size"))
    return found.orderBy(F.desc("parts"), "first_seq").limit(1)


def median_cluster_size(df: DataFrame, by: str = "pred_id") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("size")).agg(F.expr("percentile(size, 0.5)").alias("median_size"))


def trailing(df: DataFrame, by: str, seq: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(seq)) - 1)


def overlap_components(n: DataFrame) -> DataFrame:
    """n (true_id, pred_id, ...) with component: the least true_id that is reached over shared clusters. Rounds are as many as the longest such way."""
    now = _checkpointed(n.withColumn("component", F.col("true_id")))
    while True:
        by_pred = now.groupBy("pred_id").agg(F.min("component").alias("least"))
        over = now.join(by_pred, "pred_id")
        by_true = over.groupBy("true_id").agg(F.min("least").alias("lowest"))
        after = _checkpointed(over.join(by_true, "true_id").withColumn("moved", F.col("lowest") != F.col("component")))
        if after.filter("moved").isEmpty():
            return after.select(*n.columns, "component")
        now = after.select(*n.columns, F.col("lowest").alias("component"))


def ceaf_e(df: DataFrame, compat: bool = False) -> DataFrame:
    """One row: precision (over predicted clusters), recall (over true ones), f1 of the best one-to-one assignment by phi4. compat swaps the two divisors.

    Clusters that share no mention score 0, so each component of the overlap graph is assigned by itself, in one task.
    """
    n, true, pred = _sides(df)
    whole = n.join(true.select("true_id", F.col("size").alias("t")), "true_id").join(pred.select("pred_id", F.col("size").alias("p")), "pred_id")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        (r, rows), (c, cols) = pd.factorize(pdf["true_id"]), pd.factorize(pdf["pred_id"])
        score = np.zeros((len(rows), len(cols)))
        score[r, c] = 2 * pdf["n"] / (pdf["t"] + pdf["p"])
        return pd.DataFrame({"best": [best_assignment(score)], "rows": [len(rows)], "cols": [len(cols)]})

    best = overlap_components(whole).groupBy("component").applyInPandas(assign, "best double, rows long, cols long")
    sums = best.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("best", "rows", "cols")))
    ratio = lambda by: F.when(F.col(by) > 0, F.col("best") / F.col(by)).otherwise(0.0)
    both = sums.select(ratio("rows" if compat else "cols").alias("precision"), ratio("cols" if compat else "rows").alias("recall"))
    return both.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(_f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


def coref_scores(df: DataFrame) -> DataFrame:
    """One row: cluster counts, the median predicted size, precision, recall and f1 of each metric, and the mean of the three f1."""
    parts = [metric(df).select(*(F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1"))) for name, metric in (("muc", muc), ("b_cubed", b_cubed), ("ceaf_e", ceaf_e))]
    sizes = df.agg(F.countDistinct("true_id").alias("n_true"), F.countDistinct("pred_id").alias("n_pred"))
    for part in (median_cluster_size(df), *parts):  # one row each
        sizes = sizes.join(F.broadcast(part))
    return sizes.withColumn("mean_f1", F.round((F.col("muc_f1") + F.col("b_cubed_f1") + F.col("ceaf_e_f1")) / 3, 6))


def allowed(assigned: DataFrame, test: DataFrame, train: DataFrame, choice: str, seq: str = "seq", entity: str = "entity_id") -> DataFrame:
    """The assignments of those test mentions whose entity train has (choice seen) or has not (unseen); mentions are known by seq."""
    from .corpus import split_seen

    if choice not in ("seen", "unseen"):
        raise ValueError("choice must be seen or unseen")
    return assigned.join(split_seen(test, train, entity, choice == "seen").select(seq), seq, "left_semi")


def mixed_samples(df: DataFrame, mentions: DataFrame, seq: str = "seq") -> DataFrame:
    """kind, seq, entity_id and contexts of up to five mentions of the most split true cluster, and of up to five entities of the most conflated predicted one; nothing where none is mixed."""
    from .mentions import samples

    whole = df.join(mentions, seq)
    out = []
    for kind, by, other, distinct in (("split", "true_id", "pred_id", None), ("conflated", "pred_id", "true_id", "entity_id")):
        top = most_mixed(df, by, other, seq).first()
        some = samples(whole, by, top[by], 5, seq, distinct) if top and top["parts"] > 1 else whole.limit(0)
        out.append(some.select(F.lit(kind).alias("kind"), seq, "entity_id", "left_context", "mention", "right_context"))
    return out[0].unionByName(out[1])
