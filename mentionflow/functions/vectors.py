"""Vector expressions and centroids. Components are read as doubles; a zero vector stays zero under every norm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NORMS = ("l2", "l_inf", "none")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def sim_l2(a: Column, b: Column) -> Column:
    return 1 / (1 + F.sqrt(squared_distance(a, b)))


def sim_sql2(a: Column, b: Column) -> Column:
    return 1 / (1 + squared_distance(a, b))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def centroids(df: DataFrame, by: str, vector: str = "embedding", norm: str = "l2") -> DataFrame:
    """by, pos, value: the mean of each component over the group, divided by the norm of the means (none: by nothing). Components are numbered from 0."""
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {NORMS}")
    mean = df.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
    if norm == "none":
        return mean
    size = F.sqrt(F.sum(F.col("value") * F.col("value"))) if norm == "l2" else F.max(F.abs("value"))
    return mean.join(mean.groupBy(by).agg(size.alias("_size")), by).select(by, "pos", F.when(F.col("_size") > 0, F.col("value") / F.col("_size")).otherwise(0.0).alias("value"))


def register(spark: SparkSession) -> None:
    """Makes vec_dot, vec_sim_l2 and vec_sim_sql2 known to the session's SQL."""
    pair = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    gap = "aggregate(zip_with(a, b, (x, y) -> x - y), 0D, (s, x) -> s + x * x)"
    for name, body in (("vec_dot", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"), ("vec_sim_l2", f"1 / (1 + sqrt({gap}))"), ("vec_sim_sql2", f"1 / (1 + {gap})")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({pair}) RETURNS DOUBLE RETURN {body}")
