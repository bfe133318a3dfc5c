"""Word weights and scores of mentions by their own strings, their contexts and their vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import BLOCK, bigram_weights, block_pairs, matrix, similar_strings

WORD = r"[\p{L}\p{N}_]{2,}"


#: A vocabulary of so many terms at most is sent to the tasks; the rows then stay where they are.
TERMS = 100_000


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("t")


def _counted(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of lists of words; and for each pair of a list and a word in it the list's number, the word's place and its count."""
    coded = words.flatten().dictionary_encode()
    rows, n = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    pairs, counts = np.unique(rows * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary.cast(pa.string()), pairs // n, pairs % n, counts


def fit_idf(df: DataFrame, text: str, max_features: int | None = 10_000) -> DataFrame:
    """term, idf: ln((1 + n) / (1 + df)) + 1 for each term of the rows' texts.

    Terms are lower-cased words of two characters or more. max_features keeps those most frequent in all texts, ties to the lesser term. n counts all
    rows, those with null or wordless texts too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, _, at, c = _counted(batch.column(0))
            many = np.bincount(at, c, len(terms)).astype(np.int64), np.bincount(at, minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([terms, *map(pa.array, many)], names=["term", "all", "df"])

    terms = df.select(_words(text)).mapInArrow(run, "term string, all long, df long").groupBy("term").agg(F.sum("all").alias("all"), F.sum("df").alias("df"))
    if max_features is not None:
        terms = terms.orderBy(F.desc("all"), "term").limit(max_features)
    rows = df.agg(F.count("*").alias("n"))  # one row
    return terms.join(F.broadcast(rows)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_weights(df: DataFrame, key: str, text: str, idf: DataFrame) -> DataFrame:
    """key, term, w: count times idf over the text's L2 norm; terms that idf lacks don't count. Rows of one key count as one text, those without a key not at all; a wordless text gives no rows.

    A text's weights need no other row: each is weighed where it is. Only rows that share their key, and all where idf has more than TERMS terms, are counted by key and term.
    """
    df = df.filter(F.col(key).isNotNull()).select(key, text)
    small = idf.select("term", F.col("idf").cast("double").alias("idf")).limit(TERMS + 1).toArrow()
    if small.num_rows > TERMS:
        return _joined_weights(df, key, text, idf)
    shared = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    repeated = not shared.isEmpty()
    known, values = small.column("term").combine_chunks().cast(pa.string()), small.column("idf").to_numpy()
    sent = df.sparkSession.sparkContext.broadcast((known, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = sent.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                terms, rows, at, c = _counted(batch.column(1))
                place = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
                kept = place[at] >= 0
                rows, at, c = rows[kept], at[kept], c[kept]
                w = c * values[place[at]]
                w /= np.sqrt(np.bincount(rows, w * w, batch.num_rows))[rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), terms.take(pa.array(at)), pa.array(w)], names=[key, "term", "w"])

    alone = df.join(shared, key, "left_anti") if repeated else df
    out = alone.select(key, _words(text)).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, term string, w double")
    return out.unionByName(_joined_weights(df.join(shared, key, "left_semi"), key, text, idf)) if repeated else out


def _joined_weights(df: DataFrame, key: str, text: str, idf: DataFrame) -> DataFrame:
    counts = df.select(key, F.explode(_words(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c"))
    raw = counts.join(idf, "term").select(key, "term", (F.col("c") * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("l")).alias("w"))


def feature_score(df: DataFrame, threshold: float, weights: tuple[float, float] = (0.8, 0.2), mention: str = "mention", context: str = "context", bigrams: DataFrame | None = None, idf: DataFrame | None = None) -> DataFrame:
    """mention_a, context_a, mention_b, context_b, score: distinct (mention, context) pairs whose weighted cosine is above threshold.

    The score is weights[0] times the mentions' bigram cosine plus weights[1] times the contexts' word cosine. Both directions, each with itself. As no
    cosine is above 1, each side's own bound follows from threshold, so that only strings alike enough by themselves are paired; where the contexts' bound is below 0, theirs is
    computed for the pairs that the mentions make. threshold must be so high that the mentions' bound is 0 or more: below, pairs without a common bigram would count.
    bigrams and idf are fitted vocabularies; without them they are fitted on df.
    """
    own, other = weights
    low_m, low_c = (threshold - other) / own, (threshold - own) / other
    if low_m < 0:
        raise ValueError("threshold is too low for the weights")
    # A hair below the bounds: the cosines are rounded, and the score decides.
    names = similar_strings(bigram_weights(df, mention, bigrams), low_m - 1e-6, mention).withColumnRenamed("score", "m")
    idf = fit_idf(df, context) if idf is None else idf
    words = tfidf_weights(df.select(F.col(context), F.col(context).alias("_text")).distinct(), context, "_text", idf)
    pairs = df.select(mention, context).distinct()
    left = pairs.select(F.col(mention).alias("a"), F.col(context).alias("context_a"))
    right = pairs.select(F.col(mention).alias("b"), F.col(context).alias("context_b"))
    if low_c >= 0:
        texts = similar_strings(words, low_c - 1e-6, context).withColumnRenamed("score", "c")
        near = texts.select(F.col("a").alias("context_a"), F.col("b").alias("context_b"), "c")
        found = left.join(names, "a").join(near, "context_a").join(right, ["b", "context_b"])
    else:
        whole = words.groupBy(context).agg(F.collect_list(F.struct("term", "w")).alias("v"))
        side = lambda c, v: whole.select(F.col(context).alias(c), F.map_from_entries("v").alias(v))
        each = left.join(names, "a").join(right, "b").join(side("context_a", "va"), "context_a", "left").join(side("context_b", "vb"), "context_b", "left")
        product = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.element_at(F.col("vb"), x["key"]), F.lit(0.0)))
        found = each.withColumn("c", F.round(F.coalesce(product, F.lit(0.0)), 9))
    return found.withColumn("score", F.round(own * F.col("m") + other * F.col("c"), 6)).filter(F.col("score") > threshold).select(F.col("a").alias("mention_a"), "context_a", F.col("b").alias("mention_b"), "context_b", "score")


def _bigram_counts(strings: list[str | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, column and count of each string's bigrams, ids being added to; and one over each string's length as a vector, 0 without bigrams."""
    known: dict[str | None, tuple[list[int], list[int]]] = {}
    rows, columns, counts, over = [], [], [], np.zeros(len(strings))
    for i, s in enumerate(strings):
        if s not in known:
            c = Counter(ids.setdefault(g, len(ids)) for g in _grams(s))
            known[s] = list(c), list(c.values())
        own, n = known[s]
        rows += [i] * len(own)
        columns += own
        counts += n
        over[i] = 1 / sqrt(sum(x * x for x in n)) if n else 0
    return np.array(rows, np.int32), np.array(columns, np.int32), np.array(counts, np.float32), over


def _dense(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, n: int, place: np.ndarray, width: int) -> np.ndarray:
    """n rows of the counts of the bigrams that have a place. Single floats hold such whole numbers, and the sums of their products, exactly."""
    at = place[columns]
    out = np.zeros((n, width), np.float32)
    out[rows[at >= 0], at[at >= 0]] = counts[at >= 0]
    return out


def _grams(s: str | None) -> list[str]:
    s = s or ""
    return [s[i : i + 2] for i in range(len(s) - 1)]


def combo_score(df: DataFrame, threshold: float, weight: float = 0.5, seq: str = "seq", mention: str = "mention", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """seq, earlier, score: pairs of rows whose weight x bigram cosine + (1 - weight) x inner product is above threshold.

    Rows meet in pairs of groups, scored as matrices of block rows a side; seq should be unique. Vectors aren't normalised. A null mention has no bigrams; rows with a null vector take no part.
    """
    named = df.withColumn("m", F.regexp_replace(F.lower(mention), r"\s+", " "))
    dealt = block_pairs(named, seq, vector, block, ("m",))

    def sides(pdf: pd.DataFrame, ids: dict[str, int]) -> list[tuple]:
        parts = [pdf.iloc[at : at + block] for at in range(0, len(pdf), block)]
        return [(p["seq"].to_numpy(), matrix(p["v"]), *_bigram_counts(p["m"].tolist(), ids)) for p in parts]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        ids: dict[str, int] = {}
        late, early = sides(pdf[pdf["b"] == y], ids), sides(pdf[pdf["b"] == x], ids)
        seqs, earlier, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, a, rows, columns, counts, over in late:
            # Bigrams that none of these rows has add nothing.
            own = np.unique(columns)
            place = np.full(len(ids), -1, np.int32)
            place[own] = np.arange(len(own))
            names = _dense(rows, columns, counts, len(i), place, len(own))
            for k, b, *others, under in early:
                if x == y and i.max() <= k.min():
                    continue
                shared = names @ _dense(*others, len(k), place, len(own)).T
                score = weight * (shared * over[:, None] * under[None, :]) + (1 - weight) * (a @ b.T)
                near = score > threshold - 1e-6  # rounding comes to less
                r, c = np.nonzero(near & (i[:, None] > k[None, :]) if x == y else near)
                found = np.round(score[r, c], 6)
                kept = found > threshold
                seqs.append(i[r[kept]])
                earlier.append(k[c[kept]])
                scores.append(found[kept])
        return pd.DataFrame({"seq": np.concatenate(seqs), "earlier": np.concatenate(earlier), "score": np.concatenate(scores)})

    return dealt.groupBy("x", "y").applyInPandas(compare, "seq long, earlier long, score double").select(F.col("seq").alias(seq), "earlier", "score")
