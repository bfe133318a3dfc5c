"""What encoders need: marked windows of tokens, negatives, losses, and training of a hashed linear encoder by distributed gradients.

An encoder is any function from lists of tokens and masks to vectors, built once for each task by a factory. The one here hashes tokens and projects their sum,
so that training and encoding work without a pretrained model; another one takes its place by its factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import chunk_shuffle, context_window, shard

# The marks around a mention, the ends of a sequence, padding.
MENTION_START, MENTION_END, FIRST, LAST, PAD = "[E_START]", "[E_END]", "[CLS]", "[SEP]", "[PAD]"
Encoder = Callable[[list[list[str]], list[list[bool]]], np.ndarray]


def simple_tokens(text: Column) -> Column:
    """Lower-cased words and single other characters. Any other expression that gives an array of strings will do in its place."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))


def _marked(parts: list[Column], size: int | None) -> list[Column]:
    left, mention, right = parts
    one = lambda *x: F.array(*map(F.lit, x))
    whole = F.concat(one(FIRST), left, mention, right, one(LAST))
    n, start = F.size(whole), F.size(left) + 1
    padded = F.concat(whole, F.array_repeat(F.lit(PAD), F.greatest(F.lit(size) - n, F.lit(0)))) if size else whole
    return [padded.alias("tokens"), F.transform(padded, lambda _, i: (i < n).cast("int")).alias("attention"), F.transform(padded, lambda _, i: (i >= start) & (i < start + F.size(mention))).alias("mask")]


def encoded(df: DataFrame, size: int = 128, tokens: Callable[[Column], Column] = simple_tokens) -> DataFrame:
    """df with tokens, attention and mask: a window of size tokens around the marked mention, padded; mask is true at the mention and its marks.

    Room that one side does not need goes to the other. A mention longer than the window is cut at its end.
    """
    cut = F.slice(tokens(F.col("mention")), F.lit(1), F.lit(size - 4))
    made = df.select("*", tokens(F.col("left_context")).alias("_l"), cut.alias("_m"), tokens(F.col("right_context")).alias("_r"))
    window = context_window(F.col("_l"), F.col("_m"), F.col("_r"), size)
    kept = made.select("*", *(c.alias(n) for c, n in zip(window, ("_a", "_b", "_c"), strict=True)))
    marked = F.concat(F.array(F.lit(MENTION_START)), F.col("_b"), F.array(F.lit(MENTION_END)))
    return kept.select(*df.columns, *_marked([F.col("_a"), marked, F.col("_c")], size))


def plain_window(df: DataFrame, size: int = 512, tokens: Callable[[Column], Column] = simple_tokens) -> DataFrame:
    """df with tokens, attention and mask: the same without marks or padding; the whole text if it fits."""
    made = df.select("*", tokens(F.col("left_context")).alias("_l"), F.slice(tokens(F.col("mention")), F.lit(1), F.lit(size - 2)).alias("_m"), tokens(F.col("right_context")).alias("_r"))
    over = F.size("_l") + F.size("_m") + F.size("_r") + 2 > size
    half = F.floor((F.lit(size) - F.size("_m")) / 2).cast("int") - 1
    spare_l, spare_r = F.greatest(half - F.size("_l"), F.lit(0)), F.greatest(half - F.size("_r"), F.lit(0))
    n_l = F.greatest(F.when(over, F.least(F.size("_l"), half + F.when(spare_l > 0, 0).otherwise(spare_r))).otherwise(F.size("_l")), F.lit(0))
    n_r = F.greatest(F.when(over, F.least(F.size("_r"), half + spare_l)).otherwise(F.size("_r")), F.lit(0))
    kept = made.withColumn("_a", F.slice("_l", F.size("_l") - n_l + 1, n_l)).withColumn("_c", F.slice("_r", F.lit(1), n_r))
    return kept.select(*df.columns, *_marked([F.col("_a"), F.col("_m"), F.col("_c")], None))


def quota_window(df: DataFrame, size: int = 256, tokens: Callable[[Column], Column] = simple_tokens) -> DataFrame:
    """df with tokens, attention and mask: the marked mention between quotas of its contexts, padded. What one side lacks goes to the other."""
    made = df.select("*", tokens(F.col("left_context")).alias("_l"), F.slice(tokens(F.col("mention")), F.lit(1), F.lit(size - 6)).alias("_t"), tokens(F.col("right_context")).alias("_r"))
    made = made.withColumn("_m", F.concat(F.array(F.lit(MENTION_START)), F.col("_t"), F.array(F.lit(MENTION_END))))
    left = F.floor((F.lit(size) - F.size("_m")) / 2).cast("int") - 1
    right = F.lit(size) - F.size("_m") - left - 2
    n_l = F.least(F.size("_l"), left + F.greatest(right - F.size("_r"), F.lit(0)))
    n_r = F.least(F.size("_r"), right + F.greatest(left - F.size("_l"), F.lit(0)))
    kept = made.withColumn("_a", F.slice("_l", F.size("_l") - n_l + 1, n_l)).withColumn("_c", F.slice("_r", F.lit(1), n_r))
    return kept.select(*df.columns, *_marked([F.col("_a"), F.col("_m"), F.col("_c")], size))


def _slot(token: str, features: int) -> int:
    return int(pd.util.hash_array(np.array([token], object), categorize=False)[0] % np.uint64(features))


class HashedEncoder:
    """The mean, over the mask or over all tokens but padding, of hashed one-hot tokens, projected; unit length unless normalise is false."""

    def __init__(self, weights: np.ndarray, masked: bool = False, normalise: bool = True):
        self.weights, self.masked, self.normalise = weights, masked, normalise
        self.slots: dict[str, int] = {}

    def rows(self, tokens: list[list[str]], masks: list[list[bool]]) -> np.ndarray:
        out = np.zeros((len(tokens), len(self.weights)))
        for i, (words, mask) in enumerate(zip(tokens, masks, strict=True)):
            used = [w for w, m in zip(words, mask, strict=True) if w != PAD and (m or not self.masked)]
            for w in used:
                if w not in self.slots:
                    self.slots[w] = _slot(w, len(self.weights))
                out[i, self.slots[w]] += 1 / len(used)
        return out

    def __call__(self, tokens: list[list[str]], masks: list[list[bool]]) -> np.ndarray:
        v = self.rows(tokens, masks) @ self.weights
        if self.normalise:
            size = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(size > 0, size, 1)
        return v


def first_weights(features: int = 4096, dim: int = 64, seed: int = 1234) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(features, dim)) / np.sqrt(dim)


def hashed_encoder(weights: np.ndarray, **options) -> Callable[[], Encoder]:
    return lambda: HashedEncoder(weights, **options)


def embed(df: DataFrame, factory: Callable[[], Encoder], uid: str = "uid", entity: str = "entity_id", at_once: int = 256) -> DataFrame:
    """uid, entity, embedding of rows that have tokens and mask. The encoder is built once for each task."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (uid, entity))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for pdf in batches:
            for at in range(0, len(pdf), at_once):
                part = pdf.iloc[at : at + at_once]
                v = encoder([list(t) for t in part["tokens"]], [list(m) for m in part["mask"]])
                yield pd.DataFrame({uid: part[uid], entity: part[entity], "embedding": list(v.astype(np.float64))})

    return df.select(uid, entity, "tokens", "mask").mapInPandas(run, f"{kinds}, embedding array<double>")


def streamed(df: DataFrame, rank: int, world: int, chunk: int = 32768, seed: int = 1234, seq: str = "seq") -> DataFrame:
    """A worker's share of the rows, shuffled within chunks, in the order that it reads them: sort by chunk and place."""
    return chunk_shuffle(shard(df, rank, world, seq), chunk, seed, seq)


def _draw_weighted(u: np.ndarray, gold: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row places in ids, drawn by the row's numbers u in [0, 1) without replacement, likelier by counts, ids equal to gold excepted; and which of them are there.

    ids ascend. A draw is a point on a line of all counts from which the row's excluded stretches have been cut, so none is ever thrown away.
    """
    n, k = u.shape
    ends = np.cumsum(counts)
    starts, total = ends - counts, int(counts.sum())
    # The stretches cut out of each row's line, in the line's order; those not yet in use lie behind its end.
    cut, size = np.full((n, k + 1), total, np.int64), np.zeros((n, k + 1), np.int64)
    at = np.searchsorted(ids, gold)
    own = ids[np.minimum(at, len(ids) - 1)] == gold
    cut[own, 0], size[own, 0] = starts[at[own]], counts[at[own]]
    left = total - size[:, 0]
    found, there = np.zeros((n, k), np.int64), np.zeros((n, k), bool)
    for j in range(k):
        there[:, j] = left > 0
        r = np.minimum((u[:, j] * left).astype(np.int64), np.maximum(left - 1, 0))
        for i in range(j + 1):
            r += np.where(r >= cut[:, i], size[:, i], 0)
        found[:, j] = np.minimum(np.searchsorted(ends, r, side="right"), len(ids) - 1)
        cut[:, j + 1], size[:, j + 1] = np.where(there[:, j], starts[found[:, j]], total), np.where(there[:, j], counts[found[:, j]], 0)
        left = left - size[:, j + 1]
        order = cut[:, : j + 2].argsort(axis=1, kind="stable")
        cut[:, : j + 2], size[:, : j + 2] = np.take_along_axis(cut[:, : j + 2], order, 1), np.take_along_axis(size[:, : j + 2], order, 1)
    return found, there


def weighted_negatives(rows: DataFrame, vocab: DataFrame, k: int, seed: int = 1234, key: str = "seq", gold: str = "idx", block: int = 4096) -> DataFrame:
    """key, rank, negative: for each row k entities without replacement, likelier by their count, a row's own entity and those of count 0 excepted; all, if there are fewer.

    Draw by draw an entity's chance is its count over the counts left. The numbers that a row draws by are hashes of its key and the rank: so a row draws the same again after a loss.
    vocab (idx, count), 16 bytes an entity, is sent to each executor once; the rows stay where they are, are drawn for block at a time, and the work is rows x k.
    """
    known = vocab.filter("count > 0 and idx is not null").groupBy("idx").agg(F.sum("count").cast("long").alias("count")).select(F.col("idx").cast("long").alias("idx"), "count").toArrow()
    ids, counts = (known.column(c).to_numpy() for c in ("idx", "count"))
    order = ids.argsort()
    sent = rows.sparkSession.sparkContext.broadcast((ids[order], counts[order]))
    draws = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.col(key), j), F.lit(1 << 52)) + 0.5) / float(1 << 52))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = sent.value
        for whole in batches:
            for first in range(0, whole.num_rows if len(ids) else 0, block):
                batch = whole.slice(first, block)
                # A row without an entity of its own excepts none.
                own = pc.fill_null(batch.column(1), int(ids[0]) - 1).to_numpy(zero_copy_only=False)
                found, there = _draw_weighted(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k), own, ids, counts)
                row, rank = there.nonzero()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(rank.astype(np.int32) + 1), pa.array(ids[found[there]])], names=[key, "rank", "negative"])

    return rows.select(F.col(key), F.col(gold).cast("long").alias("_g"), draws.alias("_u")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, rank int, negative long")


def uniform_negatives(rows: DataFrame, entities: int, k: int, seed: int = 1234, key: str = "seq", gold: str = "idx") -> DataFrame:
    """key, rank, negative: k numbers below entities for each row, with replacement; a row's own entity becomes 0, the padding."""
    drawn = rows.select(F.col(key).alias("_r"), F.col(gold).alias("_g"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    at = F.pmod(F.xxhash64(F.lit(seed), "_r", "rank"), F.lit(entities))
    return drawn.select(F.col("_r").alias(key), "rank", F.when(at.eqNullSafe(F.col("_g")), 0).otherwise(at).alias("negative"))


def batch_negatives(rows: DataFrame, batch: str = "batch", key: str = "seq", gold: str = "idx") -> DataFrame:
    """key, other, negative: each row of a batch beside each: the other's entity, 0 where it is the row's own."""
    own = rows.select(batch, F.col(key).alias("_r"), F.col(gold).alias("_g"))
    other = rows.select(F.col(batch).alias("_b"), F.col(key).alias("other"), F.col(gold).alias("_o"))
    both = own.join(other, F.col(batch) == F.col("_b"))
    return both.select(F.col("_r").alias(key), "other", F.when(F.col("_o").eqNullSafe(F.col("_g")), 0).otherwise(F.col("_o")).alias("negative"))


def link_scores(contexts: DataFrame, entities: DataFrame, candidates: DataFrame, scale: float = 1.0, key: str = "seq") -> DataFrame:
    """key, scores: scale x cosine of a row's embedding with its candidates' (key, rank, idx), in the order of rank; padding (idx 0) scores -1e32. rank 0 is the gold entity."""
    from mentionflow.functions.vectors import dot, l2_normalize

    own = contexts.select(key, l2_normalize(F.col("embedding")).alias("_v"))
    table = entities.select("idx", l2_normalize(F.col("embedding")).alias("_e"))
    each = candidates.join(own, key).join(table, "idx", "left")
    score = F.when((F.col("idx") == 0) | F.col("_e").isNull(), F.lit(-1e32)).otherwise(F.lit(scale) * dot(F.col("_v"), F.col("_e")))
    return each.select(key, F.struct("rank", score.alias("s")).alias("x")).groupBy(key).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]).alias("scores"))


def nll(scores: Column) -> Column:
    """-log softmax of the first score."""
    most = F.array_max(scores)
    return F.log(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - most))) + most - F.get(scores, F.lit(0))


def hinge(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.lit(margin) - positive + negative)


def first_wins(scores: Column) -> Column:
    """Whether the first score is the greatest, ties to the first."""
    return F.get(scores, F.lit(0)) >= F.array_max(scores)


def linking_report(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """One row: n, accuracy and mean loss; null for no rows."""
    return scored.agg(F.count("*").alias("n"), F.avg(first_wins(F.col(scores)).cast("double")).alias("accuracy"), F.avg(nll(F.col(scores))).alias("loss"))


def _grad(weights: np.ndarray, rows: list[np.ndarray], margin: float) -> tuple[float, np.ndarray]:
    """Sum of the triplets' hinge losses over cosines, and its gradient."""
    units, sizes = [], []
    for x in rows:
        v = x @ weights
        n = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        units.append(v / n)
        sizes.append(n)
    a, p, q = units
    loss = np.maximum(0, margin - (a * p).sum(1) + (a * q).sum(1))
    on = (loss > 0)[:, None]
    out = np.zeros_like(weights)
    for x, u, n, g in zip(rows, units, sizes, (q - p, -a, a), strict=True):
        g = np.where(on, g, 0)
        out += x.T @ ((g - u * (g * u).sum(1, keepdims=True)) / n)
    return float(loss.sum()), out


def train_mentions(train: DataFrame, dev: DataFrame, weights: np.ndarray, epochs: int = 10, margin: float = 1.0, rate: float = 3e-2) -> tuple[np.ndarray, DataFrame]:
    """The weights with the least dev loss, and a row for each epoch (epoch, train_loss, dev_loss).

    train and dev: anchor, positive and negative, each an array of tokens. Each epoch is one step of Adam along the mean gradient over all triplets, which tasks sum up: what they send has the
    weights' size, whatever their rows. Without triplets the weights stay as they are.
    """
    spark = train.sparkSession

    def summed(df: DataFrame, weights: np.ndarray) -> tuple[float, int, np.ndarray]:
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encoder = HashedEncoder(sent.value)
            loss, n, grad = 0.0, 0, np.zeros_like(sent.value)
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    rows = [encoder.rows([list(t) for t in part[c]], [[True] * len(t) for t in part[c]]) for c in ("anchor", "positive", "negative")]
                    more, g = _grad(sent.value, rows, margin)
                    loss, n, grad = loss + more, n + len(part), grad + g
            if n:
                yield pd.DataFrame({"loss": [loss], "n": [n], "grad": [grad.tobytes()]})

        loss, n, grad = 0.0, 0, np.zeros_like(weights)
        for r in df.select("anchor", "positive", "negative").mapInPandas(run, "loss double, n long, grad binary").toLocalIterator():
            loss, n, grad = loss + r["loss"], n + r["n"], grad + np.frombuffer(r["grad"]).reshape(weights.shape)
        sent.unpersist()
        return loss, n, grad

    best, least, history = weights, np.inf, []
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for epoch in range(1, epochs + 1):
        loss, n, grad = summed(train, weights)
        if not n:
            break
        m, v = 0.9 * m + 0.1 * grad / n, 0.999 * v + 0.001 * (grad / n) ** 2
        weights = weights - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        dev_loss, dev_n, _ = summed(dev, weights)
        mean = dev_loss / dev_n if dev_n else loss / n
        history.append((epoch, loss / n, mean))
        if mean < least:
            best, least = weights, mean
    return best, spark.createDataFrame(history, "epoch int, train_loss double, dev_loss double")


def token_triplets(df: DataFrame, triplets: DataFrame, seq: str = "seq") -> DataFrame:
    """anchor, positive, negative as tokens of sampling.triplets() over df (seq, tokens)."""
    out = triplets
    for c in ("anchor", "positive", "negative"):
        out = out.withColumnRenamed(c, f"_{c}").join(df.select(F.col(seq).alias(f"_{c}"), F.col("tokens").alias(c)), f"_{c}")
    return out.select("entity", "anchor", "positive", "negative")
