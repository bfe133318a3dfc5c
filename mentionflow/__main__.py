"""Command lines over files: python -m mentionflow COMMAND --help. Mentions are JSON lines, embeddings TSV, clusters CSV (true_id, pred_id, seq), trees TSV, models Parquet.

Outputs are folders of part files. A session's settings come from spark-submit or spark-defaults; a cluster's session must name spark.checkpoint.dir.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow.functions.vectors import l2_normalize
from mentionflow.operators import corpus, hierarchy, linking, mentions, metrics, ordered, sampling, text, training, trees
from mentionflow.sources import corpora, readers, writers
from mentionflow.streaming import strategies

Command = Callable[[SparkSession, argparse.Namespace], None]
COMMANDS: dict[str, tuple[Command, list[tuple[str, dict]]]] = {}
IN, OUT = ("--input", {"required": True}), ("--output", {"required": True})
THRESHOLD, SEED = ("--threshold", {"type": float}), ("--seed", {"type": int, "default": 1234})


def command(name: str, *arguments: tuple[str, dict]):
    def add(run: Command) -> Command:
        COMMANDS[name] = (run, list(arguments))
        return run

    return add


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Embeddings with seq from 0 in the order of lines."""
    return ordered.row_number(readers.embeddings_tsv(spark, path).withColumn("_at", F.monotonically_increasing_id()), "_at", "seq").drop("_at")


def write_clusters(entities: DataFrame, clusters: DataFrame, path: str, entity: str = "entity_id") -> None:
    writers.assignments(entities.select("seq", F.col(entity).alias("true_id")).join(clusters.select("seq", F.col("cluster_id").alias("pred_id")), "seq"), path)


@command("string_match", IN, OUT)
def string_match(spark, a):
    df = readers.numbered_mentions(spark, a.input)
    write_clusters(df, linking.string_match(df), a.output)


@command("oracle_wd", IN, OUT, ("--compat", {"action": "store_true"}))
def oracle_wd(spark, a):
    df = readers.numbered_mentions(spark, a.input)
    write_clusters(df, (linking.oracle_within_document_compat if a.compat else linking.oracle_within_document)(df), a.output)


@command("fit_vectorizer", IN, OUT)
def fit_vectorizer(spark, a):
    df = readers.numbered_mentions(spark, a.input)
    writers.model(linking.bigram_vocabulary(df), f"{a.output}/bigram")
    writers.model(text.fit_idf(df.withColumn("context", mentions.context()), "context"), f"{a.output}/context")


def searched(count_at: Callable[[float], int], df: DataFrame, threshold: float | None, n: int) -> float:
    """The threshold given, or the one that makes as many clusters as there are entities."""
    if threshold is not None:
        return threshold
    found, clusters, met = linking.bisect(count_at, df.agg(F.countDistinct("entity_id")).first()[0], n)
    print(f"threshold {found} clusters {clusters} met {met}")
    return found


@command("baseline", IN, OUT, THRESHOLD, ("--vectorizer", {"required": True}))
def baseline(spark, a):
    df = trees._checkpointed(readers.numbered_mentions(spark, a.input).withColumn("context", mentions.context()))
    bigrams, idf = (readers.model(spark, f"{a.vectorizer}/{x}") for x in ("bigram", "context"))

    def clusters(t: float) -> DataFrame:
        similar = text.feature_score(df, t, bigrams=bigrams, idf=idf)
        one = lambda m, c: F.concat_ws("\1", F.coalesce(m, F.lit("\2")), F.coalesce(c, F.lit("\2")))
        named = similar.select(one(F.col("mention_a"), F.col("context_a")).alias("a"), one(F.col("mention_b"), F.col("context_b")).alias("b"))
        return linking.overwrite_cluster(df.withColumn("name", one(F.col("mention"), F.col("context"))), named, mention="name")

    t = searched(lambda t: clusters(max(t, 0.2)).select("cluster_id").distinct().count(), df, a.threshold, df.count())
    write_clusters(df, clusters(max(t, 0.2)), a.output)


@command("combo", IN, OUT, THRESHOLD, ("--vectorizer", {}), ("--embeddings", {"required": True}), ("--weight", {"type": float, "default": 0.5}))
def combo(spark, a):
    df = trees._checkpointed(readers.numbered_mentions(spark, a.input).join(numbered(spark, a.embeddings).select("seq", "embedding"), "seq"))
    cluster = lambda t: linking.overwrite_pairs(df, text.combo_score(df, t, a.weight))
    t = searched(lambda t: cluster(t).select("cluster_id").distinct().count(), df, a.threshold, df.count())
    write_clusters(df, cluster(t), a.output)


@command("nn_thresh", IN, OUT, THRESHOLD, ("--limit", {"type": int}), ("--strategy", {"default": "backwards", "choices": strategies.STRATEGIES}), ("--dot_prod", {"action": "store_true"}))
def nn_thresh(spark, a):
    df = numbered(spark, a.input)
    df = trees._checkpointed(df if a.dot_prod else df.withColumn("embedding", l2_normalize(F.col("embedding"))))
    if a.strategy == "backwards":
        t = a.threshold if a.threshold is not None else linking.find_threshold(df, limit=a.limit).first()["threshold"]
        found = linking.backward_cluster(df, t, limit=a.limit)
    else:
        cluster = lambda t: strategies.link(df, a.strategy, t, a.limit)
        t = searched(lambda t: cluster(t).select("cluster_id").distinct().count(), df, a.threshold, df.count())
        found = cluster(t)
    write_clusters(df, found, a.output)


@command("cluster_hierarchy", IN, OUT, THRESHOLD, ("--limit", {"type": int}), ("--strategy", {"default": "similarity", "choices": hierarchy.PRUNINGS}), ("--pruning_threshold", {"type": float}), ("--tree", {}))
def cluster_hierarchy(spark, a):
    df = numbered(spark, a.input)
    table = trees._checkpointed(hierarchy.build(df, limit=a.limit, pruning=a.strategy, pruning_threshold=a.pruning_threshold))
    t = searched(lambda t: hierarchy.flat(table, t).select("cluster_id").distinct().count(), df, a.threshold, df.count())
    write_clusters(df, hierarchy.flat(table, t), a.output)
    if a.tree:
        writers.node_table(table, df.select(F.lit("0").alias("block"), "seq", F.col("entity_id").alias("label")), a.tree)


@command("cut_tree", ("--tree", {"required": True}), ("--embeddings", {"required": True}), OUT, ("--threshold", {"type": float, "required": True}), ("--dot_prod", {"action": "store_true"}))
def cut_tree(spark, a):
    tree = readers.dendrogram(spark, a.tree)
    paths = trees.leaf_paths(tree)
    vectors = readers.embeddings_tsv(spark, a.embeddings)
    found = trees.cut(paths, trees.scores(paths, vectors, a.dot_prod), a.threshold)
    writers.tree_cut(found, vectors.select(F.col("uid").alias("leaf"), "entity_id"), a.output)


@command("dendrogram_purity", ("--tree", {"required": True}), ("--pubtator", {}), ("--cluster_by", {"default": "entity_id", "choices": ("entity_id", "semantic_type")}))
def dendrogram_purity(spark, a):
    tree = readers.dendrogram(spark, a.tree)
    if a.pubtator:
        facts = corpora.metadata(readers.pubtator(spark, a.pubtator)).select("uid", F.col(a.cluster_by).cast("string").alias("label"))
        tree = tree.drop("label").join(facts, "uid", "left")
    print(trees.purity(tree).first()["purity"])


@command("eval_clusters", IN, ("--train", {}), ("--test", {}), ("--choice", {"choices": ("seen", "unseen")}))
def eval_clusters(spark, a):
    df = readers.assignments(spark, a.input)
    if a.train and a.test:
        df = metrics.allowed(df, readers.numbered_mentions(spark, a.test), readers.mentions(spark, a.train), a.choice)
    scores = trees._checkpointed(metrics.coref_scores(trees._checkpointed(df)))
    r = scores.first()
    print(f"True clusters: {r['n_true']}\nMedian size: {metrics.median_cluster_size(df, 'true_id').first()['median_size']}\nPred clusters: {r['n_pred']}")
    print(writers.score_line(scores))


@command("error_analysis", ("--dataset", {"required": True}), ("--clusters", {"required": True}))
def error_analysis(spark, a):
    df, own = trees._checkpointed(readers.assignments(spark, a.clusters)), readers.numbered_mentions(spark, a.dataset)
    counts = metrics.conflated_divided(df).first()
    print(f"Conflated Entities: {counts['conflated']}\nSplit Entities: {counts['divided']}")
    for r in metrics.mixed_samples(df, own).select("kind", "entity_id", mentions.pretty().alias("shown")).collect():  # ten rows at most
        print(r["shown"] if r["kind"] == "split" else f"{(r['entity_id'] or '').replace('_', ' ')} & {r['shown']} \\\\")


@command("max_active", IN)
def max_active(spark, a):
    print(corpus.max_active(readers.numbered_mentions(spark, a.input)).first()["max_active"])


@command("unique_entities", IN)
def unique_entities(spark, a):
    r = corpus.unique_entities(readers.mentions(spark, a.input)).first()
    print(f"Unique: {r['n_unique']}\nSingletons: {r['n_singleton']}")


@command("split_unseen", ("--train", {"required": True}), ("--eval", {"required": True}))
def split_unseen(spark, a):
    train, df = readers.mentions(spark, a.train), readers.mentions(spark, a.eval)
    writers.seen_unseen(df, train, a.eval)
    print(f"Percent Overlap: {corpus.percent_overlap(df, train).first()['overlap']:.4f}")


WINDOWS = {"mention": training.encoded, "plain": training.plain_window, "quota": training.quota_window}


def encoder_of(spark: SparkSession, path: str | None, **options) -> Callable[[], training.Encoder]:
    if not path:
        return training.hashed_encoder(training.first_weights(), **options)
    rows = sorted(readers.model(spark, f"{path}/weights").collect(), key=lambda r: r["row"])  # a model's size
    return training.hashed_encoder(np.array([r["w"] for r in rows]), **options)


def save_encoder(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    writers.model(spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(weights)], "row int, w array<double>"), f"{path}/weights")


def _encode(spark, a, window: str, **options):
    df = readers.numbered_mentions(spark, a.input)
    made = WINDOWS[window](df, a.max_length)
    writers.embeddings_tsv(training.embed(made, encoder_of(spark, a.model, **options), "seq"), a.output, "seq")


MODEL = ("--model", {"help": "a folder that train_me has written; without it, hashed tokens are projected at random"})


@command("embed", IN, OUT, MODEL, ("--max_length", {"type": int, "default": 512}))
def embed(spark, a):
    _encode(spark, a, "plain", masked=True, normalise=False)


@command("encode_mentions", IN, OUT, MODEL, ("--max_length", {"type": int, "default": 128}))
def encode_mentions(spark, a):
    _encode(spark, a, "mention")


@command("encode_quota", IN, OUT, MODEL, ("--max_length", {"type": int, "default": 256}))
def encode_quota(spark, a):
    _encode(spark, a, "quota")


@command("pretokenize", IN, OUT, ("--max_length", {"type": int, "default": 128}))
def pretokenize(spark, a):
    writers.model(training.encoded(readers.numbered_mentions(spark, a.input), a.max_length), a.output)


@command("train_me", ("--train", {"required": True}), ("--dev", {"required": True}), ("--output_dir", {"required": True}), ("--epochs", {"type": int, "default": 10}), ("--margin", {"type": float, "default": 1.0}), ("--lr", {"type": float, "default": 3e-2}), ("--max_length", {"type": int, "default": 128}), SEED)
def train_me(spark, a):
    sets = []
    for path in (a.train, a.dev):
        df = trees._checkpointed(training.encoded(readers.numbered_mentions(spark, path), a.max_length))
        sets.append(trees._checkpointed(training.token_triplets(df, sampling.triplets(df, a.seed))))
    weights, history = training.train_mentions(*sets, training.first_weights(seed=a.seed), a.epochs, a.margin, a.lr)
    save_encoder(spark, weights, a.output_dir)
    writers.metrics(history, f"{a.output_dir}/metrics")


@command("train_el", ("--train", {"required": True}), ("--dev", {"required": True}), ("--test", {"required": True}), ("--output_dir", {"required": True}), ("--epochs", {"type": int, "default": 10}), ("--lr", {"type": float, "default": 3e-2}), ("--max_length", {"type": int, "default": 128}), ("--margin", {"type": float, "default": 1.0}), ("--negatives", {"type": int, "default": 64}), SEED)
def train_el(spark, a):
    """The encoder is trained by triplets; an entity's vector is its training mentions' mean. Dev mentions are scored against their entity and weighted negatives; test mentions are embedded."""
    train_me(spark, a)
    factory = encoder_of(spark, a.output_dir)
    train = trees._checkpointed(training.embed(training.encoded(readers.numbered_mentions(spark, a.train), a.max_length), factory, "seq"))
    vocab = trees._checkpointed(corpus.entity_vocab(train))
    coded = corpus.entity_encode(train, vocab)
    table = coded.groupBy("idx").agg(F.array(*(F.avg(F.col("embedding")[i]) for i in range(training.first_weights(8).shape[1]))).alias("embedding"))
    dev = trees._checkpointed(corpus.entity_encode(training.embed(training.encoded(readers.numbered_mentions(spark, a.dev), a.max_length), factory, "seq"), vocab))
    gold = dev.select("seq", F.lit(0).alias("rank"), "idx")
    others = training.weighted_negatives(dev, vocab, a.negatives, a.seed).select("seq", "rank", F.col("negative").alias("idx"))
    print(training.linking_report(training.link_scores(dev, table, gold.unionByName(others))).first())
    made = training.embed(training.encoded(readers.numbered_mentions(spark, a.test), a.max_length), factory, "seq")
    writers.embeddings_tsv(made, f"{a.output_dir}/test", "seq")


def _write_corpus(df: DataFrame, prefix: str, order: str | None = None) -> None:
    """Mentions by split, and the vocabulary of the training split's entities."""
    df = trees._checkpointed(df)
    writers.mentions(df.orderBy(order) if order else df, f"{prefix}/mentions")
    own = df.filter("split = 'train'").withColumn("seq", F.monotonically_increasing_id() if order is None else F.col(order))
    writers.vocabulary(corpus.entity_vocab(own), f"{prefix}/entity_vocab")


PREFIX = ("--prefix", {"required": True})


@command("preprocess_kilt", ("--train", {"required": True}), ("--dev", {"required": True}), PREFIX)
def preprocess_kilt(spark, a):
    both = [readers.kilt(spark, path).withColumn("split", F.lit(name)) for name, path in (("train", a.train), ("dev", a.dev))]
    _write_corpus(both[0].unionByName(both[1]), a.prefix)
    print(f"Unseen Dev Entities: {corpus.unseen_entities(both[1], both[0]).count()}")


@command("preprocess_medmentions", ("--pubtator_file", {"required": True}), PREFIX, ("--train", {}), ("--dev", {}), ("--test", {}), ("--dates", {"help": "CSV of pmid and date, like 2001/02/03 04:05; makes the split by date"}))
def preprocess_medmentions(spark, a):
    df = readers.pubtator(spark, a.pubtator_file).withColumn("type", F.split("types", ",")).drop("types")
    if a.dates:
        dates = spark.read.schema("pmid string, date string").csv(a.dates)
        documents = corpora.dated(df.select("pmid").distinct(), dates).withColumn("_seq", F.xxhash64("pmid"))
        split = ordered.row_number(corpus.date_split(documents, "date", "_seq").withColumn("_at", F.unix_micros("date")), "_at", "document_index", ("_seq",)).drop("_seq", "_at", "date")
        df = df.join(split.withColumnRenamed("date_text", "date"), "pmid")
    else:
        df = mentions.routed(df, {n: readers.id_list(spark, getattr(a, n)) for n in ("train", "dev", "test")})
    _write_corpus(df, a.prefix)


@command("preprocess_aida", IN, PREFIX)
def preprocess_aida(spark, a):
    lines = trees._checkpointed(corpora.token_lines(spark, a.input))
    _write_corpus(mentions.sections(corpora.token_mentions(lines), lines), a.prefix)


@command("preprocess_ecbplus", IN, ("--gold", {"required": True}), PREFIX)
def preprocess_ecbplus(spark, a):
    _write_corpus(mentions.event_mentions(corpora.event_xml(spark, a.input), corpora.gold_sentences(spark, a.gold)), a.prefix)


@command("preprocess_zeshel", IN, PREFIX)
def preprocess_zeshel(spark, a):
    documents = trees._checkpointed(corpora.page_documents(spark, f"{a.input}/documents"))
    links = trees._checkpointed(corpora.page_links(spark, f"{a.input}/mentions"))
    for name in [r["file"] for r in links.select("file").distinct().collect()]:  # a few files
        own = links.filter(F.col("file") == name)
        mentions.with_pages(own, documents).orderBy("mention_index").write.json(f"{a.prefix}/{name}")
        if name == "train":
            counted = mentions.category_counts(own).join(documents.select("document_id", F.col("title").alias("entity")), "document_id")
            writers.vocabulary(ordered.row_number(counted.withColumn("_less", -F.col("count")), "_less", "idx", ("entity",)).select("entity", "count", (F.col("idx") + 1).alias("idx")).unionByName(spark.createDataFrame([("[PAD]", 0, 0)], "entity string, count long, idx long")), f"{a.prefix}/entity_vocab")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mentionflow", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)
    args = parser.parse_args(argv)
    COMMANDS[args.command][0](spark or SparkSession.builder.appName(f"mentionflow {args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
