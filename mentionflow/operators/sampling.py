"""Deterministic samplers: chance comes from md5 of a seed and the row's key, so that a lost executor's rows come out the same again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import row_number


def draw(seed: int, *keys: str) -> Column:
    """A whole number from 0 to 2**60 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), 1, 15), 16, 10).cast("long")


def shard(df: DataFrame, rank: int, world: int, seq: str = "seq") -> DataFrame:
    return df.filter(F.pmod(F.col(seq), F.lit(world)) == rank)


def chunk_shuffle(df: DataFrame, chunk: int = 32768, seed: int = 1234, seq: str = "seq") -> DataFrame:
    """df with chunk and place: rows keep their chunk of the order, of chunk rows each but the last, and are shuffled within it."""
    dealt = row_number(df, seq, "_at").withColumn("chunk", F.floor(F.col("_at") / chunk).cast("long")).drop("_at").withColumn("_draw", draw(seed, seq))
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("chunk").orderBy("_draw", seq)) - 1).drop("_draw")


def triplets(df: DataFrame, seed: int = 1234, entity: str = "entity_id", seq: str = "seq") -> DataFrame:
    """entity, anchor, positive, negative (seq): for each entity with two mentions or more two of them, and one of the entity that a shuffle puts next (after the last: the first).

    Each entity gives its three numbers by aggregates, so that a frequent entity is never gathered. With a single entity there are no rows; null entities take no part.
    """
    own = df.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.struct(draw(seed, seq).alias("d"), F.col(seq).alias("s")).alias("m"))
    ends = own.groupBy("entity").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    ranked = row_number(ends.withColumn("_at", draw(seed, "entity")), "_at", "n", ("entity",))
    last = ranked.agg(F.max("n").alias("last"))  # one row
    following = ranked.select(F.col("n").alias("next"), F.col("a.s").alias("negative"))
    turned = ranked.join(F.broadcast(last)).withColumn("next", F.when(F.col("n") == F.col("last"), 0).otherwise(F.col("n") + 1))
    return turned.filter("a.s <> b.s and last > 0").join(following, "next").select("entity", F.col("a.s").alias("anchor"), F.col("b.s").alias("positive"), "negative")


def context_window(left: Column, mention: Column, right: Column, size: int) -> list[Column]:
    """left, mention and right tokens of a window of size tokens, two of them for the sequence's ends and two for the marks around the mention.

    Room that one side doesn't need goes to the other. A side without room is empty.
    """
    room = F.lit(size) - F.size(mention) - 4
    half = F.greatest(F.floor(room / 2), F.lit(0)).cast("int")
    spare_left, spare_right = F.greatest(half - F.size(left), F.lit(0)), F.greatest(half - F.size(right), F.lit(0))
    n_left, n_right = F.least(F.size(left), half + spare_right), F.least(F.size(right), half + spare_left)
    tail = F.slice(left, F.size(left) - n_left + 1, n_left)
    return [F.when(n_left > 0, tail).otherwise(F.array().cast("array<string>")).alias("left"), mention.alias("mention"), F.slice(right, F.lit(1), n_right).alias("right")]
