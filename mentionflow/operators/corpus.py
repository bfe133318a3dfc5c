"""Corpus operators over mentions: counts, vocabularies, splits, spans of activity and joins by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import dense_ids, row_number, running_sum

# The topics of the development and training splits.
DEV_TOPICS = (2, 5, 12, 18, 21, 23, 34, 35)
LAST_TRAIN_TOPIC = 35


def entity_counts(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    return df.groupBy(entity).agg(F.count("*").alias("count"))


def entity_vocab(df: DataFrame, entity: str = "entity_id", seq: str = "seq") -> DataFrame:
    """entity, count, idx: most frequent first, ties by first appearance; row 0 is the padding entry."""
    found = df.groupBy(F.col(entity).cast("string").alias("entity")).agg(F.count("*").alias("count"), F.min(seq).alias("first"))
    ranked = row_number(found.withColumn("less", -F.col("count")), "less", "idx", ("first",))
    pad = df.sparkSession.createDataFrame([("[PAD]", 0, 0)], "entity string, count long, idx long")
    return ranked.select("entity", "count", (F.col("idx") + 1).alias("idx")).unionByName(pad)


def unique_entities(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One row: distinct entities and those with one mention."""
    return entity_counts(df, entity).agg(F.count("*").alias("n_unique"), F.coalesce(F.sum((F.col("count") == 1).cast("long")), F.lit(0)).alias("n_singleton"))


def entity_spans(df: DataFrame, entity: str = "entity_id", seq: str = "seq") -> DataFrame:
    return df.groupBy(entity).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))


def max_active(df: DataFrame, entity: str = "entity_id", seq: str = "seq") -> DataFrame:
    """One row: the most entities that are between their first and last mention at one time, both ends included."""
    spans = entity_spans(df, entity, seq)
    steps = spans.select(F.explode(F.array(F.struct(F.col("first_seq").alias("at"), F.lit(1).alias("d")), F.struct((F.col("last_seq") + 1).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    by_time = steps.groupBy("s.at").agg(F.sum("s.d").alias("delta"))
    return running_sum(by_time, "at", F.col("delta"), "active").agg(F.coalesce(F.max("active"), F.lit(0)).alias("max_active"))


def split_seen(df: DataFrame, train: DataFrame, entity: str = "entity_id", seen: bool = True) -> DataFrame:
    """Rows of df whose entity is (or isn't) in train."""
    return df.join(train.select(entity).distinct(), entity, "left_semi" if seen else "left_anti")


def percent_overlap(df: DataFrame, train: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One row: entities of train that df has too, entities of train, and their ratio."""
    known = train.select(entity).distinct()
    both = known.join(df.select(entity).distinct().withColumn("hit", F.lit(1)), entity, "left")
    return both.agg(F.count("hit").alias("n_seen"), F.count("*").alias("n_train")).withColumn("overlap", F.round(F.col("n_seen") / F.col("n_train"), 6))


def unseen_entities(df: DataFrame, train: DataFrame, entity: str = "entity_id") -> DataFrame:
    return df.select(entity).subtract(train.select(entity))


def topic_split(topic: Column) -> Column:
    return F.when(topic.isin(*DEV_TOPICS), "dev").when(topic.between(1, LAST_TRAIN_TOPIC), "train").otherwise("test")


def date_split(df: DataFrame, date: str = "date", seq: str = "seq") -> DataFrame:
    """df with split: the first six tenths by date (ties by seq) train, the next two dev, the rest test."""
    n = df.count()
    train, dev = n * 6 // 10, n * 2 // 10
    timed = df.withColumn("_at", F.unix_micros(F.col(date).cast("timestamp")))
    ranked = row_number(timed, "_at", "_n", (seq,))
    return ranked.withColumn("split", F.when(F.col("_n") < train, "train").when(F.col("_n") < train + dev, "dev").otherwise("test")).drop("_at", "_n")


def sectionize(df: DataFrame, marker: Column, group: str, seq: str = "seq") -> DataFrame:
    """Rows that are no markers, with the last marker before them in their group and their index within that section."""
    w = Window.partitionBy(group).orderBy(seq)
    marked = df.withColumn("section", F.last(marker, ignorenulls=True).over(w)).withColumn("_marker", marker)
    within = Window.partitionBy(group, "section").orderBy(seq)
    return marked.filter("_marker is null").withColumn("mention_index", F.row_number().over(within) - 1).drop("_marker")


def entity_encode(df: DataFrame, vocab: DataFrame, entity: str = "entity_id", seq: str = "seq") -> DataFrame:
    """df with idx: the vocabulary's, or the next free numbers by first appearance for entities that it lacks."""
    known = vocab.select(F.col("entity").alias("_e"), F.col("idx").alias("_idx"))
    free = (vocab.agg(F.max("idx")).first()[0] or 0) + 1
    joined = df.withColumn("_e", F.col(entity).cast("string")).join(known, "_e", "left")
    fresh = joined.filter("_idx is null")
    added = dense_ids(fresh, ["_e"], seq, "_new").select("_e", "_new").distinct()
    return joined.join(added, "_e", "left").withColumn("idx", F.coalesce("_idx", F.col("_new") + free)).drop("_e", "_idx", "_new")


def span_split_chars(text: Column, start: Column, end: Column) -> list[Column]:
    """left_context, mention, right_context by character offsets from 0, the end excluded."""
    return [F.substring(text, F.lit(1), start).alias("left_context"), F.substring(text, start + 1, end - start).alias("mention"), F.substring(text, end + 1, F.length(text)).alias("right_context")]


def span_split_tokens(text: Column, start: Column, end: Column) -> list[Column]:
    """The same by white-space tokens from 0, the end included, joined by single spaces."""
    t = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return [F.array_join(F.slice(t, F.lit(1), start), " ").alias("left_context"), F.array_join(F.slice(t, start + 1, end - start + 1), " ").alias("mention"), F.array_join(F.slice(t, end + 2, F.greatest(F.size(t), F.lit(1))), " ").alias("right_context")]


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"([{}_%])", r"\\$1")
