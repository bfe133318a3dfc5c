"""Ordered computations without a single global window: rows are dealt into key ranges, and each range starts from the totals before it."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, more where there would be more than RANGES of them.
ROWS, RANGES = 500_000, 1 << 16


def _below(key: Column, bounds: Column) -> Column:
    """How many of the ascending bounds, RANGES at most, are below the key, by binary search."""
    state = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left = F.get(bounds, middle) < key
        return F.when(s["lo"] >= s["hi"], s).otherwise(state(F.when(left, middle + 1).otherwise(s["lo"]), F.when(left, s["hi"]).otherwise(middle)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ceil(log2(RANGES)))), state(F.lit(0), F.size(bounds)), halve)["lo"]


def with_range(df: DataFrame, key: str, tie: str | None = None, rows: int = ROWS) -> DataFrame:
    """df with _range: the range of a numeric key. Bounds are approximate quantiles, about rows rows apart; null keys go to range 0.

    A key that several quantiles fall on is cut by quantiles of tie, a numeric column, of its own rows.
    """
    n = df.count()
    cuts = min(n // rows, RANGES - 1)
    if not cuts:
        return df.withColumn("_range", F.lit(0).cast("long"))
    spark = df.sparkSession
    share = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = df.agg(F.percentile_approx(key, share, 100 * (cuts + 1)).alias("q")).first()["q"] or []
    kind = df.schema[key].dataType.simpleString()
    bounds = spark.createDataFrame([(sorted(set(found)),)], f"_bounds array<{kind}>")
    dealt = df.join(F.broadcast(bounds)).withColumn("_range", F.coalesce(_below(F.col(key), F.col("_bounds")), F.lit(0)).cast("long") * RANGES).drop("_bounds")  # one row
    often = {b: found.count(b) for b in set(found)}
    hot = [b for b, m in often.items() if m > 1]
    if tie is None or not hot:
        return dealt
    inner = df.filter(F.col(key).isin(*hot)).groupBy(key).agg(F.percentile_approx(tie, share, 100 * (cuts + 1)).alias("_ties"))  # fewer rows than cuts
    cut = dealt.join(F.broadcast(inner), key, "left")
    return cut.withColumn("_range", F.col("_range") + F.when(F.col("_ties").isNotNull(), _below(F.col(tie), F.col("_ties")) + 1).otherwise(0)).drop("_ties")


def running_sum(df: DataFrame, key: str, value: Column, out: str, ties: tuple[str, ...] = (), rows: int = ROWS, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of value over the rows up to and with each, in the order of key and then ties; of each combination of by for itself."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    tie = ties[0] if ties and df.schema[ties[0]].dataType.simpleString() in numeric else None
    dealt = with_range(df, key, tie, rows).withColumn("_value", value)
    totals = dealt.groupBy(*by, "_range").agg(F.sum("_value").alias("_total"))
    before = totals.select(*by, "_range", (F.sum("_total").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_total")).alias("_before"))  # a row for each range
    w = Window.partitionBy(*by, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_sum", F.sum("_value").over(w))
    for c in by:
        before = before.withColumnRenamed(c, f"_by_{c}")
    on = F.col("_range") == F.col("_of_range")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = summed.join(F.broadcast(before.withColumnRenamed("_range", "_of_range")), on)
    return joined.withColumn(out, F.col("_sum") + F.col("_before")).drop("_range", "_of_range", "_value", "_sum", "_before", *(f"_by_{c}" for c in by))


def row_number(df: DataFrame, key: str, out: str, ties: tuple[str, ...] = (), rows: int = ROWS, by: tuple[str, ...] = ()) -> DataFrame:
    """df with 0, 1, 2 ... in the order of key and then ties."""
    return running_sum(df, key, F.lit(1), out, ties, rows, by).withColumn(out, F.col(out) - 1)


def dense_ids(df: DataFrame, keys: list[str], seq: str, out: str) -> DataFrame:
    """df with an id for each combination of keys, numbered from 0 by first appearance in seq. Null is a key like others."""
    first = df.groupBy(*keys).agg(F.min(seq).alias("_first"))
    ids = row_number(first, "_first", out).drop("_first")
    own = ids.select(out, *(F.col(k).alias(f"_key_{k}") for k in keys))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(own, on).drop(*(f"_key_{k}" for k in keys)).select(*df.columns, out)
