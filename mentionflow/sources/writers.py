"""Writers of the corpus formats: folders of part files, ordered where the format has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assignments(df: DataFrame, path: str, seq: str = "seq") -> None:
    """true_id, pred_id, seq as CSV, sorted by seq over the part files."""
    df.select("true_id", "pred_id", seq).orderBy(seq).write.csv(path)


def embeddings_tsv(df: DataFrame, path: str, uid: str = "uid", entity: str = "entity_id", vector: str = "embedding") -> None:
    line = F.concat_ws("\t", F.col(uid).cast("string"), F.col(entity).cast("string"), F.array_join(F.transform(vector, lambda x: x.cast("string")), "\t"))
    df.select(line.alias("value")).write.text(path)


def mentions(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines, a folder for each split."""
    df.write.partitionBy(split).json(path)


def vocabulary(df: DataFrame, path: str) -> None:
    """entity,count lines in the order of idx. A vocabulary is read by position, so it goes into one file; its rows are a corpus's entities, not its mentions."""
    df.select("idx", F.concat_ws(",", "entity", F.col("count").cast("string")).alias("value")).coalesce(1).sortWithinPartitions("idx").select("value").write.text(path)


def dendrogram(df: DataFrame, path: str) -> None:
    df.select("uid", "parent", "label").write.option("sep", "\t").option("nullValue", "None").csv(path)


def seen_unseen(df: DataFrame, train: DataFrame, path: str, entity: str = "entity_id") -> None:
    """JSON lines of the rows whose entity train has (path.seen) and of the others (path.unseen)."""
    from mentionflow.operators.corpus import split_seen

    for name, seen in (("seen", True), ("unseen", False)):
        split_seen(df, train, entity, seen).write.json(f"{path}.{name}")


def tree_cut(leaves: DataFrame, metadata: DataFrame, path: str, leaf: str = "leaf", entity: str = "entity_id") -> None:
    """entity, cluster and leaf of each leaf as CSV, sorted by leaf; clusters are numbered from 0, in the order of a hash. metadata: leaf and entity."""
    from mentionflow.operators.ordered import row_number

    first = leaves.groupBy("cluster_id").agg(F.min(leaf).alias("_first"))
    number = row_number(first.withColumn("_key", F.xxhash64("_first")), "_key", "cluster", ("_first",)).select("cluster_id", "cluster")
    leaves.join(number, "cluster_id").join(metadata, leaf).select(entity, "cluster", leaf).orderBy(leaf).write.csv(path)


def node_table(table: DataFrame, labels: DataFrame, path: str) -> None:
    """A hierarchy's node table as a dendrogram: uid, parent, label, with one root over the roots of all blocks; labels: block, seq, label."""
    name = lambda c: F.concat_ws("/", "block", c)
    own = table.join(labels, ["block", "seq"], "left").select(name("node").alias("uid"), F.when(F.col("parent").isNull(), F.lit("-1")).otherwise(name("parent")).alias("parent"), F.when(F.col("seq").isNotNull(), F.col("label").cast("string")).alias("label"))
    top = table.sparkSession.createDataFrame([("-1", None, None)], "uid string, parent string, label string")
    dendrogram(own.unionByName(top), path)


def entities(vocab: DataFrame, path: str) -> None:
    """vocabulary() of a vocabulary to which entities were added as they were met: these have no count, which is written as 0."""
    vocabulary(vocab.withColumn("count", F.coalesce("count", F.lit(0))), path)


def model(df: DataFrame, path: str) -> None:
    """A model table, in place of a pickled object."""
    df.write.parquet(path)


def metrics(df: DataFrame, path: str) -> None:
    """A training's history, a row for each epoch, as JSON lines."""
    df.orderBy("epoch").write.mode("append").json(path)


def score_line(scores: DataFrame) -> str:
    """The eleven columns of a coref_scores() row: three metrics' precision, recall and f1, the number of predicted clusters and the mean f1, with three decimals, parted by tabs."""
    r = scores.first()
    names = [f"{m}_{c}" for m in ("muc", "b_cubed", "ceaf_e") for c in ("precision", "recall", "f1")]
    return "\t".join(f"{r[n]:.3f}" for n in (*names, "n_pred", "mean_f1"))
