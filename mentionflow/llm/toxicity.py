"""Toxicity by class-conditional Kneser-Ney models.

Two word models, of toxic and of ordinary texts, are compared by the log-likelihood ratio that each word gives in its
place: bigrams back off to continuation counts, and those to the word's spelling, a character model whose long
contexts are of the class and whose short ones are shared by both classes. So a rare or unknown expression is judged
by what it has in common with others.

A text's score comes from its length-normalised ratio, over the whole text and over its most toxic window of WINDOW
words, from its strongest word, from what its words' ratios have above CLEAR together, and from its length, by a logistic curve fitted on documents that the
word models haven't seen.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, freeing, held_out, learns, materialize, parts, with_row

WORD = re.compile(r"\w+")
WINDOW, DISCOUNT = 3, 0.75
#: Log ratio that words of ordinary texts seldom have.
CLEAR = 2.5
#: Labelled documents of a class that the models learn from, about; the least by a hash of their keys are taken. This bounds the models.
SAMPLE = 16384
#: Words, and pairs of them, that came fewer times in both classes together are judged as unknown ones, by their spelling or by backing off. One
#: occurrence says nothing of a class: with it counted, held-out ordinary documents with a word that one toxic document had are called toxic.
CUTOFF = 2
#: Weight of the squared coefficients in the curve's loss.
RIDGE = 0.1
LONG = 32
#: So that a text without any ratio is never called toxic by an unfitted curve.
MOST_PRIOR = 0.25
CLASSES = (0, 1)
FEATURES = 5
#: Stands before a text's first word, and equals none.
START = "\2"
#: Distinct pairs that a task counts before it sends them on.
HELD = 400_000
#: Words that a worker remembers the spelling's ratio of.
MEMO = 200_000


def words_of(text: str | None) -> list[str]:
    """Longer words than LONG characters come as stretches of LONG that share a quarter with the next, so all of them is read."""
    words = WORD.findall(text.lower()) if text else []
    if words and max(map(len, words)) > LONG:
        step = LONG * 3 // 4
        words = [x for w in words for x in ([w] if len(w) <= LONG else [w[i : i + LONG] for i in range(0, len(w) - LONG + step, step)])]
    return words


def hashed(words: list[str]) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = words
    return pd.util.hash_array(out, categorize=False).view(np.int64)


def grams_of(w: str) -> list[str]:
    """The 5-character contexts of a word's characters and of its end."""
    x = f"\1\1\1\1{w}\2"
    return [x[i - 4 : i + 1] for i in range(4, len(x))]


class Spelling:
    """Character model of a class: contexts of 4 and of 2 characters are the class's, shorter ones are shared."""

    def __init__(self, long: dict[int, dict[str, int]]):
        """long: for each class, how often its distinct words have each 5 characters, as grams_of() gives them."""
        self.long = long
        self.mid = {c: Counter() for c in CLASSES}
        shared: Counter = Counter()
        for c in CLASSES:
            for g in long[c]:  # continuation counts: of distinct longer grams
                self.mid[c][g[2:]] += 1
        for g in {g for c in CLASSES for g in self.mid[c]}:
            shared[g[1:]] += 1
        self.sums = [{c: self._sums(t[c]) for c in CLASSES} for t in (self.long, self.mid)]
        self.shared, self.shared_sums = shared, self._sums(shared)
        last = Counter(g[-1] for g in shared)
        n = sum(last.values()) or 1
        self.last = {ch: v / n for ch, v in last.items()}
        self.ratios = [{g: self._ratio(g, k) for g in t[0].keys() | t[1].keys()} for k, t in enumerate((self.long, self.mid))]
        self.gaps = [{h: self._gap(h, k) for h in set(self.sums[k][0]) | set(self.sums[k][1])} for k in (0, 1)]

    @staticmethod
    def _sums(counts: Counter) -> dict[str, tuple[int, int]]:
        total, kinds = Counter(), Counter()
        for g, v in counts.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        return {h: (total[h], kinds[h]) for h in total}

    def _base(self, g: str) -> float:
        low = 0.9 * self.last.get(g[-1], 0) + 1e-5
        if (s := self.shared_sums.get(g[-2])) is None:
            return low
        return (max(self.shared.get(g[-2:], 0) - DISCOUNT, 0) + DISCOUNT * s[1] * low) / s[0]

    def probability(self, g: str, c: int, level: int = 0) -> float:
        """Of the last character of g after the others; g has 5 characters at level 0, 3 at level 1."""
        if level == 2:
            return self._base(g)
        lower = self.probability(g[2:] if level == 0 else g, c, level + 1)
        if (s := self.sums[level][c].get(g[:-1])) is None:
            return lower
        return (max((self.long, self.mid)[level][c].get(g, 0) - DISCOUNT, 0) + DISCOUNT * s[1] * lower) / s[0]

    def _ratio(self, g: str, level: int) -> float:
        return math.log(self.probability(g, 1, level) / self.probability(g, 0, level))

    def _gap(self, h: str, level: int) -> float:
        """Log ratio of what the classes leave to the backoff after h."""
        left = [math.log(DISCOUNT * s[1] / s[0]) if (s := self.sums[level][c].get(h)) else 0.0 for c in CLASSES]
        return left[1] - left[0]

    def word(self, w: str, c: int) -> float:
        return math.exp(sum(math.log(self.probability(g, c)) for g in grams_of(w)))

    def ratios_only(self) -> Spelling:
        """Without the counts, which log_ratio() doesn't need."""
        out = copy.copy(self)
        del out.long, out.mid, out.sums, out.shared, out.shared_sums, out.last
        return out

    def log_ratio(self, w: str) -> float:
        out = 0.0
        long, mid = self.ratios
        for g in grams_of(w):
            v = long.get(g)
            if v is None:
                m = mid.get(g[2:])
                v = self.gaps[0].get(g[:-1], 0.0) + (m if m is not None else self.gaps[1].get(g[2:-1], 0.0))
            out += v
        return out


class Model:
    """Log ratios of the known words and of the known pairs of them, by the words' 64-bit hashes.

    words: hash, single (in any place), gap (what the word leaves to the backoff after it); pairs: hash of the first word, of the
    second, ratio. unknown: the log ratio of what the classes leave to the spelling.
    """

    def __init__(self, spelling: Spelling, unknown: float, words: tuple[np.ndarray, ...], pairs: tuple[np.ndarray, ...]):
        self.spelling, self.unknown = spelling, unknown
        hashes, first = np.unique(words[0], return_index=True)
        self.hashes = hashes
        self.single, self.gap = (np.concatenate([[0.0], x[first]]) for x in words[1:])
        keys = self._ids(pairs[0]) * len(self.single) + self._ids(pairs[1])
        self.keys, first = np.unique(keys, return_index=True)
        self.pairs = pairs[2][first].astype(np.float32)
        self.memo: dict[str, float] = {}
        self.weights = np.zeros(FEATURES + 1)
        self.prior = 0.0

    def scorer(self) -> Model:
        """What scoring needs, for the workers."""
        out = copy.copy(self)
        out.spelling, out.memo = self.spelling.ratios_only(), {}
        return out

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """From 1 on; 0 for unknown words."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def rare(self, w: str) -> float:
        v = self.memo.get(w)
        if v is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            v = self.memo[w] = self.unknown + self.spelling.log_ratio(w)
        return v

    def features(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the mean ratio, that of its most toxic window and its greatest one, the logarithms of 1 and the excess over CLEAR and of 1 and its words; zeros without words."""
        out = np.zeros((len(texts), FEATURES))
        sizes = np.array([len(x) for x in texts], np.int64)
        flat = [w for x in texts for w in x]
        if not flat:
            return out
        column = np.empty(len(flat), object)
        column[:] = flat
        codes, uniques = pd.factorize(column)
        known = self._ids(hashed(uniques))
        once = self.single[known]
        for i in np.flatnonzero(known == 0).tolist():
            once[i] = self.rare(uniques[i])
        ids = known[codes]
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        ratio = once[codes]
        before = np.concatenate([[0], ids[:-1]])
        before[starts] = 0
        if len(self.keys):
            key = before * len(self.single) + ids
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ratio = np.where((self.keys[at] == key) & (before > 0) & (ids > 0), self.pairs[at], ratio + self.gap[before])
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        out[some, 0] = (sums[starts + sizes[some]] - sums[starts]) / sizes[some]
        # Windows of WINDOW words; the first ones of a text reach back to its start only.
        ends = np.arange(1, len(flat) + 1)
        first = np.maximum(ends - WINDOW, np.repeat(starts, sizes[some]))
        out[some, 1] = np.maximum.reduceat((sums[ends] - sums[first]) / np.minimum(WINDOW, np.repeat(sizes[some], sizes[some])), starts)
        out[some, 2] = np.maximum.reduceat(ratio, starts)
        out[some, 3] = np.log1p(np.add.reduceat(np.maximum(ratio - CLEAR, 0), starts))
        out[some, 4] = np.log1p(sizes[some])
        return out

    def fit(self, features: np.ndarray, labels: np.ndarray, share: float) -> None:
        """share: of toxic ones among all labels; the sample's classes are weighted to it. Texts without words get the share, at most MOST_PRIOR."""
        self.prior = min(share, MOST_PRIOR)
        if len(set(labels.tolist())) < 2:
            # Nothing to fit the curve on: the prior, and the mean ratio as it is.
            self.weights[:2] = math.log(self.prior / (1 - self.prior)), 1.0
            return
        x = np.hstack([np.ones((len(features), 1)), features])
        weight = np.where(labels == 1, share / (labels == 1).sum(), (1 - share) / (labels == 0).sum()) * len(labels)
        w = np.zeros(x.shape[1])

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float(weight @ (np.logaddexp(0, z) - labels * z) + RIDGE / 2 * w @ w)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + RIDGE * np.eye(x.shape[1]), x.T @ (weight * (labels - p)) - RIDGE * w)
            now = loss(w)
            while loss(w + step) > now and np.abs(step).max() > 1e-9:
                step /= 2  # Newton's step may be too long where the classes are nearly parted
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        f = self.features(texts)
        return np.where(f[:, -1] > 0, 1 / (1 + np.exp(-np.clip(self.weights[0] + f @ self.weights[1:], -30, 30))), self.prior)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair (a word and the word before it), n0, n1 from toxic, text: its counts in each class. Sent in order, which makes the shuffle small."""
    seen: dict[int, Counter] = {c: Counter() for c in CLASSES}

    def sent() -> Iterator[pa.RecordBatch]:
        for c, found in seen.items():
            pairs = sorted(found)
            for at in range(0, len(pairs), 10_000):
                part = pairs[at : at + 10_000]
                n, none = pa.array([found[x] for x in part], pa.int64()), pa.array(np.zeros(len(part), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), none if c else n, n if c else none], ["pair", "n0", "n1"])
            found.clear()

    for batch in batches:
        for c, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(t.as_py())
            seen[c].update(map("%s %s".__mod__, zip([START, *words], words, strict=False)))
            if len(seen[0]) + len(seen[1]) > HELD:
                yield from sent()
    yield from sent()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, n0, n1 from w, k0, k1: how many of each class's words have the characters."""
    for batch in batches:
        seen: dict[int, Counter] = {c: Counter() for c in CLASSES}
        for w, *k in zip(*(batch.column(x).to_pylist() for x in ("w", "k0", "k1")), strict=True):
            grams = grams_of(w)
            for c in CLASSES:
                if k[c]:
                    seen[c].update(grams)
        grams = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *(pa.array([seen[c][g] for g in grams], pa.int64()) for c in CLASSES)], ["g", "n0", "n1"])


def _arrays(df: DataFrame) -> tuple[np.ndarray, ...]:
    found = df.toArrow()
    return tuple(found.column(x).to_numpy() for x in df.columns)


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model of labelled documents, about sample of each class or all if there are fewer; None without both classes.

    Keys labelled twice count as toxic if any label says so; other labels than 0 and 1, and null ones, are left out. Rows
    with crc32(key) modulo 5 = 0 are not learned from; those with 1 fit the curve, the others the word models. Pairs of words and their
    spelling are counted by Spark; the driver holds the model only: words and pairs that reach CUTOFF, and character n-grams.
    """
    known = labels.filter(learns(F.col(key)) & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    part = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30))
    limits = [min(1 << 30, (sample << 30) // counts[c]) for c in CLASSES]
    known = known.filter(part < F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0]))
    texts = documents.select(key, text).join(F.broadcast(known), key).select("toxic", F.col(text).alias("t"), (bucket_of(F.col(key), 5) == 1).alias("fits"))
    pairs = materialize(texts.filter("not fits").select("toxic", "t").mapInArrow(freeing(_pairs), "pair string, n0 long, n1 long").groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    v, w = F.substring_index("pair", " ", 1), F.substring_index("pair", " ", -1)
    some = lambda x: F.sum((F.col(x) > 0).cast("long"))
    # k: continuation counts; s and t: how many words, and how many distinct ones, come after.
    after = pairs.groupBy(v.alias("w")).agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"), some("n0").alias("t0"), some("n1").alias("t1"))
    words = materialize(pairs.groupBy(w.alias("w")).agg(some("n0").alias("k0"), some("n1").alias("k1")).join(after, "w", "left").na.fill(0, ["s0", "s1", "t0", "t1"]))
    sums = words.agg(*(x for c in CLASSES for x in (F.sum(f"k{c}").alias(f"total{c}"), some(f"k{c}").alias(f"kinds{c}")))).first()
    total = [sums[f"total{c}"] or 0 for c in CLASSES]
    left = [DISCOUNT * sums[f"kinds{c}"] / total[c] if total[c] else 1.0 for c in CLASSES]
    long: dict[int, dict[str, int]] = {c: {} for c in CLASSES}
    for r in words.select("w", "k0", "k1").mapInArrow(freeing(_grams), "g string, n0 long, n1 long").groupBy("g").agg(F.sum("n0"), F.sum("n1")).toLocalIterator():
        for c in CLASSES:
            if r[1 + c]:
                long[c][r[0]] = r[1 + c]
    spelling = Spelling(long)
    sent = documents.sparkSession.sparkContext.broadcast((spelling, total, left))

    def singles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spelling, total, left = sent.value
        for pdf in batches:
            p = [np.maximum(pdf[f"k{c}"] - DISCOUNT, 0) / max(1, total[c]) + left[c] * np.array([spelling.word(w, c) for w in pdf["w"]]) for c in CLASSES]
            rest = [np.where(pdf[f"s{c}"] > 0, DISCOUNT * pdf[f"t{c}"] / np.maximum(pdf[f"s{c}"], 1), 1.0) for c in CLASSES]
            out = {"h": hashed(pdf["w"].tolist()), "single": np.log(p[1] / p[0]), "gap": np.log(rest[1] / rest[0])}
            yield pd.DataFrame(out | {f"{x}{c}": y[c] for x, y in (("p", p), ("rest", rest)) for c in CLASSES} | {f"s{c}": pdf[f"s{c}"] for c in CLASSES})

    shape = "h long, single double, gap double, p0 double, p1 double, rest0 float, rest1 float, s0 float, s1 float"
    h, single, gap, *parts = _arrays(words.filter(F.col("k0") + F.col("k1") >= CUTOFF).mapInPandas(freeing(singles), shape))
    order = np.argsort(h)
    table = documents.sparkSession.sparkContext.broadcast((h[order], [x[order] for x in parts]))

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, (p0, p1, rest0, rest1, s0, s1) = table.value
        for pdf in batches:
            both = [hashed([x[k] for x in pdf["pair"].str.split(" ")]) for k in (0, 1)]
            at = [np.minimum(np.searchsorted(h, x), max(0, len(h) - 1)) for x in both]
            known = (h[at[0]] == both[0]) & (h[at[1]] == both[1]) if len(h) else np.zeros(len(pdf), bool)
            v, w = at[0][known], at[1][known]
            p = [np.maximum(pdf[n][known] - DISCOUNT, 0) / np.maximum(s[v], 1) + rest[v] * p[w] for n, s, rest, p in (("n0", s0, rest0, p0), ("n1", s1, rest1, p1))]
            yield pd.DataFrame({"v": both[0][known], "w": both[1][known], "ratio": np.log(p[1] / p[0])})

    model = Model(spelling, math.log(left[1] / left[0]), (h, single, gap), _arrays(pairs.filter(F.col("n0") + F.col("n1") >= CUTOFF).mapInPandas(freeing(ratios), "v long, w long, ratio float")))
    table.unpersist()
    shared = documents.sparkSession.sparkContext.broadcast(model.scorer())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                f = shared.value.features([words_of(x.as_py()) for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in f.T)], ["toxic", *(f"f{i}" for i in range(FEATURES))])

    names = [f"f{i}" for i in range(FEATURES)]
    c, *found = _arrays(texts.filter("fits").select("toxic", "t").mapInArrow(freeing(measure), ", ".join(["toxic int", *(f"{x} double" for x in names)])).orderBy("toxic", *names))
    model.fit(np.stack(found, axis=1), c, counts[1] / (counts[0] + counts[1]))
    sent.unpersist()
    shared.unpersist()
    return model


def score(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """key, score of each row: near 1 for a toxic text. A null text counts as empty; one without words gets the labels' prior. Without a model all scores are 0.

    One row comes out for each row that goes in; with whole its columns come too, as the struct own, else other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.scorer() if model else None)
    given, schema = with_row(df, key, text, "score double", whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for texts, before in parts(batch, key, text, whole, 512):
                made = own.scores([words_of(x.as_py()) for x in texts]) if own else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*before, pa.array(made, pa.float64())], schema.names)

    return given.mapInArrow(freeing(run), schema)


def op6(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: a row for each document; all scores are 0 without labels of both classes."""
    found = score(documents, learn(documents, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
