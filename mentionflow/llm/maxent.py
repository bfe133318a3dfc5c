"""Scoring texts with a hashed maximum-entropy language model.

p(token | history) = p(class | history) * p(leaf | class, history) * p(token | leaf). Both factors are softmaxes over WIDTH outcomes with four
features of the history: the word before (a row of its own), that word with the hashed one before it (an n-gram), and the leaves of
both words (the second is a skip). The most frequent words are classes of their own; others fall into classes by their last two bytes. Within a
class the OWN most frequent words are leaves of their own, the others fall into leaves by their first byte. Within a leaf a token has its add-one
share, with one place for all unknown tokens.

All weights are learned from all learning tokens that use them. The rows of leaves are few, so tasks tally the whole corpus for them first: how often two
leaves stand before a token, and what comes after each. The other rows are sharded by the word before, so the model grows with the corpus: each distinct word
and n-gram has its rows, in one shard. All tokens are dealt to the shards as packed arrays; a shard's task improves its rows by a gradient update in
numpy batches of distinct histories, then scores all its tokens. The sums go back to the documents. A shard has about SHARD tokens: a word too
frequent for one is split by the leaf before it, and a pair of them by document. What such words' and pairs' rows learn from is tallied too, so each
part has the rows of all. As each token is the word before another, its shard also knows its count.

Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, give_back, held_out, learns, materialize

WIDTH, HEADS, OWN = 64, 32, 48
LEAVES = WIDTH * WIDTH
#: Tokens of a shard, more where there would be more than SHARDS of them; characters and texts of a batch of documents; bytes tokenised at once.
SHARD, SHARDS, BATCH_CHARS, BATCH_TEXTS, SLICE = 1 << 20, 1 << 19, 4_000_000, 1 << 14, 1 << 17
#: Gradient sweeps over the leaf rows, which one over the word and n-gram rows follows; what expected counts are raised by, which damps rare rows; the longest step.
SWEEPS, RATE, DAMP, STEP, GROUPS = 2, 0.7, (1.0, 1.0, 3.0), 3.0, 512
#: Places of a class's tally: pairs of a leaf of it and any leaf before that, then the class's part of five tables. Tasks that sum expected counts.
PAIRS, BLOCK, SUMMING = WIDTH * LEAVES, WIDTH * LEAVES + 5 * LEAVES, 12
#: Distinct tokens that a task holds before it sends them on.
HELD = 1 << 21
SPACES = b" \t\n\x0b\x0c\r"
#: END stands after each text and START before it; no word's hash is either.
END, START = np.uint64(1), np.uint64(2)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and place among the tail leaves of each word of the bytes."""
    data = _LOWER[data]
    gap = np.concatenate([[True], _IS_SPACE[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.int32)
    sizes = ends - starts
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begin)
    value = _BYTE[data] * _POWER[place & 0xFFFF]
    if int(sizes.max()) > len(_POWER):
        value *= 2 * (place >> 16).astype(np.uint64) + np.uint64(1)
    value[gap[1:-1]] = 0
    h = np.add.reduceat(value, starts)
    h = mixed(h + sizes.astype(np.uint64))
    h[h <= START] += np.uint64(2)
    last = data[ends - 1].astype(np.uint64)
    before = np.where(sizes > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    kind = (mixed(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(WIDTH - HEADS)).astype(np.int32)
    tail = (mixed(data[starts].astype(np.uint64) + np.uint64(7)) % np.uint64(WIDTH - OWN)).astype(np.int32)
    return starts, h, (HEADS + kind) * WIDTH + OWN + tail


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail leaves of all tokens of the texts, an END after each, and how many tokens each text has."""
    hashes, tails, sizes = [], [], []
    whole = [(t or "").encode("utf-8", "replace") for t in texts]
    at = 0
    while at < len(whole):
        upto, room = at + 1, SLICE - len(whole[at])
        while upto < len(whole) and len(whole[upto]) <= room:
            room -= len(whole[upto]) + 1
            upto += 1
        part = whole[at:upto]
        if len(part) == 1 and len(part[0]) > SLICE:
            pieces = list(_cut(part[0]))
            found = [_words(np.frombuffer(x, np.uint8)) for x in pieces]
            h, k = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
            n = np.array([len(h)])
        else:
            length = np.array([len(x) for x in part])
            begins = np.cumsum(length + 1) - length - 1
            starts, h, k = _words(np.frombuffer(b" ".join(part), np.uint8))
            n = np.diff(np.concatenate([np.searchsorted(starts, begins), [len(starts)]]))
        ends = np.cumsum(n)
        hashes.append(np.insert(h, ends, END))
        tails.append(np.insert(k, ends, 0))
        sizes.append(n + 1)
        at = upto
    if not sizes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(tails), np.concatenate(sizes)


def _cut(data: bytes) -> Iterator[bytes]:
    """Pieces of about SLICE bytes, cut at white space where there is some."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[at:end]
        at = end


class Vocabulary:
    """What all tasks know: the leaf of each word that has its own, the counts of words too frequent for one shard, and the leaves' totals."""

    def __init__(self, words: list[tuple[int, int, int]], often: list[tuple[int, int, int, int]], leaf_mass: dict[int, tuple[int, int]], ends: int, texts: int, tokens: int):
        """words: hash, count and tail leaf of the most frequent words to learn, in order; often: hash, number among all texts, count and tail leaf of words too frequent for a shard.

        leaf_mass: count and number of all words by tail leaf; ends: of texts to learn from; texts, tokens: of all.
        """
        self.shards, self.tokens = shards_for(tokens), max(1, tokens)
        self.mass, self.kinds = np.zeros(LEAVES), np.zeros(LEAVES)
        for leaf, (c, v) in leaf_mass.items():
            self.mass[leaf], self.kinds[leaf] = c, v
        self.n, self.v = int(self.mass.sum()) + ends, int(self.kinds.sum()) + (ends > 0)
        self.ends = ends
        own, used = {int(END): 0}, np.zeros(WIDTH, int)
        self.mass[0], self.kinds[0] = ends, 1
        for h, c, tail in words:
            k = tail // WIDTH
            leaf = len(own) * WIDTH if len(own) < HEADS else k * WIDTH + used[k] if used[k] < OWN else None
            if leaf is None:
                continue
            used[k] += len(own) >= HEADS
            own[h] = leaf
            self.mass[leaf], self.kinds[leaf] = c, 1
            self.mass[tail] -= c
            self.kinds[tail] -= 1
        self.own, self.leaf = _sorted(own)
        often = [*often, (int(START), texts, 0, 1)]  # START's leaf 1 is no word's
        self.often, at = _sorted({x[0]: i for i, x in enumerate(often)})
        self.often_all, self.often_count, tails = (np.array([x[k] for x in often], np.int64)[at] for k in (1, 2, 3))
        some = np.flatnonzero((self.shards > 1) & (2 * self.often_all * self.shards > self.tokens))
        #: Words that are split, their leaves; the split pairs of them and a leaf, and in how many parts.
        self.split, self.split_leaf = self.often[some], self.leaves(self.often[some], tails[some])
        self.pairs, self.pair_parts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The leaf tables of both softmaxes; the steps of split words' rows and the counts of split pairs, each for both softmaxes.
        self.rows = np.zeros((4, LEAVES, WIDTH), np.float32)
        self.word_steps, self.pair_counts = (np.zeros((0, 1 + WIDTH, WIDTH), np.float32) for _ in range(2))
        #: log10 of a word's share in its leaf, less that of its count and one; a leaf of one word gives it all.
        self.single = np.zeros(LEAVES, bool)
        self.single[list(own.values())] = True
        self.lower = np.where(self.single, 0.0, -np.log10(np.maximum(self.mass, 0) + self.kinds + 1))
        m = self.mass.reshape(WIDTH, WIDTH)
        p = (m.sum(1) + 1) / (m.sum(1) + 1).sum()
        # Each class's leaves: those of no word at all keep the tail's place for unknown ones.
        possible = np.zeros((WIDTH, WIDTH), bool)
        possible[HEADS:, OWN:] = True
        possible |= self.single.reshape(WIDTH, WIDTH)
        empty = ~possible.any(1)
        q = np.where(possible, m + 1, 0) + empty[:, None]
        with np.errstate(divide="ignore"):
            self.class_prior = np.log(np.where(empty, 0, p) / np.where(empty, 0, p).sum()).astype(np.float32)[None]
            self.leaf_prior = np.maximum(np.log(q / q.sum(1, keepdims=True)), -1e4).astype(np.float32)
        self.class_prior = np.maximum(self.class_prior, -1e4)

    def leaves(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        return np.where(self.own[at] == hashes, self.leaf[at], tails).astype(np.int32)

    def frequent(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words too frequent for one shard how many there are in all texts, else 0, and their counts, else -1."""
        at = np.minimum(np.searchsorted(self.often, hashes), len(self.often) - 1)
        found = self.often[at] == hashes
        return np.where(found, self.often_all[at], 0), np.where(found, self.often_count[at], -1)


    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of split words, else -1."""
        return _found(self.split, hashes)

    def pair(self, place: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The numbers of split pairs of a split word's number and the leaf before it, else -1."""
        out = np.full(len(place), -1, np.int32)
        some = np.flatnonzero(place >= 0)
        out[some] = _found(self.pairs, place[some].astype(np.int64) * LEAVES + leaf[some])
        return out


def _found(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def shards_for(tokens: int) -> int:
    return max(1, min(SHARDS, -(-tokens // SHARD)))


def _sorted(found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter(found, np.uint64, len(found))
    order = np.argsort(keys)
    return keys[order], np.fromiter(found.values(), np.int64, len(found))[order]


def softmax_scores(a: np.ndarray, b: np.ndarray, s: np.ndarray, t: np.ndarray, prior: np.ndarray, base: np.ndarray, target: np.ndarray, learn: np.ndarray, rows: np.ndarray | None = None, given: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """Natural log p(target) of each example, after training on those with learn.

    a: the row of the word before; (a, b): the n-gram's; s and t: rows below 1 << 16 of the hashed leaf tables; base: the row of prior, one for each s.
    Rows s and t are trained on the distinct pairs of them, unless rows are given; with these fixed, the rows of a and of (a, b) are, and examples are
    scored. A step is the gradient over the expected count, damped. given, for words and pairs whose examples are not all here: each example's number in
    steps of a's row or -1, these steps; its number in counts of (a, b) or -1, these counts.
    """
    n = len(a)
    out = np.zeros(n, np.float64)
    order = np.lexsort((target, b, a)) if n < 1 << 10 else np.argsort((a * LEAVES + b) * WIDTH + target)
    a, b, s, t, base, target, learn = (x[order] for x in (a, b, s, t, base, target, learn))
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    group = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [n]])))
    ga, gs, gt, gbase = a[new], s[new], t[new], base[new]
    weight = learn.astype(np.float32)
    left, right = _leaf_rows(gs, gt, gbase, prior, group, target, weight) if rows is None else rows
    of_word, steps, of_pair, counts = given or (np.full(n, -1), None, np.full(n, -1), None)
    of_word, of_pair = of_word[order][new], of_pair[order][new]
    # Batches of distinct histories, which no word before is parted by.
    word = np.flatnonzero(np.concatenate([[True], ga[1:] != ga[:-1]]))
    cuts = [0]
    for w in word[1:].tolist():
        if w - cuts[-1] >= GROUPS:
            cuts.append(w)
    cuts.append(len(new))
    upto = np.concatenate([new, [n]])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        first, last = upto[lo], upto[hi]
        own, k = group[first:last] - lo, target[first:last]
        seen = np.bincount(own * WIDTH + k, weight[first:last], (hi - lo) * WIDTH).astype(np.float32).reshape(-1, WIDTH)
        known, pairs = of_word[lo:hi], np.flatnonzero(of_pair[lo:hi] >= 0)
        z = prior[gbase[lo:hi]] + left[gs[lo:hi]] + right[gt[lo:hi]]
        starts = np.flatnonzero(np.concatenate([[True], ga[lo + 1 : hi] != ga[lo : hi - 1]]))
        times = np.diff(np.concatenate([starts, [hi - lo]]))
        if seen.any() or (known >= 0).any():
            place = np.repeat(np.arange(len(starts)), times)[own]
            sums = np.bincount(place * WIDTH + k, weight[first:last], len(starts) * WIDTH).astype(np.float32).reshape(-1, WIDTH)
            if pairs.size:
                seen[pairs] = counts[of_pair[lo:hi][pairs]]
            e = _expected(z, seen.sum(1, keepdims=True))
            step = _step(sums, np.add.reduceat(e, starts, axis=0), DAMP[1])
            split = np.flatnonzero(known[starts] >= 0)
            if split.size:
                step[split] = steps[known[starts][split]]
            z += np.repeat(step, times, axis=0)
            z += _step(seen, e, DAMP[2])
        out[order[first:last]] = (z[own, k] - np.log(np.exp(z).sum(1))[own]).astype(np.float64)
    return out


def _expected(z: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of each row total times the softmax. Steps are bounded, so exp() can't overflow."""
    p = np.exp(z)
    p *= total / p.sum(1, keepdims=True)
    return p


def _step(seen: np.ndarray, expected: np.ndarray, damp: float) -> np.ndarray:
    out = seen - expected
    out /= expected + damp
    return np.clip(out, -STEP, STEP, out=out)


def _leaf_rows(s: np.ndarray, t: np.ndarray, base: np.ndarray, prior: np.ndarray, group: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed tables of the leaf features, trained on the distinct pairs of their rows."""
    pairs, first, back = np.unique(s.astype(np.int64) << 16 | t, return_index=True, return_inverse=True)
    total = np.bincount(back[group], weight, len(pairs)).astype(np.float32)
    some = np.flatnonzero(total)
    ps, pt, pb, total = s[first[some]], t[first[some]], base[first[some]], total[some, None]
    rows = [int(own.max(initial=0)) + 1 for own in (s, t)]
    seen = [np.bincount(own[group] * WIDTH + target, weight, n * WIDTH).astype(np.float32).reshape(-1, WIDTH) for own, n in zip((s, t), rows, strict=True)]
    left, right = (np.zeros((n, WIDTH), np.float32) for n in rows)
    for _ in range(SWEEPS):
        expected = _leaf_expected(ps, pt, pb, total, prior, left, right)
        for table, own, e in zip((left, right), seen, expected, strict=True):
            table += RATE * _step(own, e, DAMP[0])
    return left, right


def _leaf_expected(ps: np.ndarray, pt: np.ndarray, pb: np.ndarray, total: np.ndarray, prior: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The expected counts of the rows of both tables, from distinct pairs of rows, in order, and how often each came."""
    expected = np.zeros_like(left), np.zeros_like(right)
    for at in range(0, len(ps), GROUPS):
        part = slice(at, at + GROUPS)
        e = _expected(prior[pb[part]] + left[ps[part]] + right[pt[part]], total[part])
        order = np.argsort(pt[part], kind="stable")
        for into, own, x in zip(expected, (ps[part], pt[part][order]), (e, e[order]), strict=True):
            ids, starts = np.unique(own, return_index=True)
            into[ids] += np.add.reduceat(x, starts, axis=0)
    return expected


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts, compressed."""
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (np.diff(keys, prepend=0).astype("<u4"), counts.astype("<u8"))]
    return np.int64(len(keys)).tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    flat = np.frombuffer(pa.decompress(data[8:], 12 * n, "zstd", asbytes=True), np.uint8)
    deltas, counts = (np.ascontiguousarray(x.reshape(-1, n).T).view(kind).ravel() for x, kind in ((flat[: 4 * n], "<u4"), (flat[4 * n :], "<u8")))
    return np.cumsum(deltas, dtype=np.int64), counts.astype(np.int64)


def _tallied(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
    """part, data: what comes after the leaves of each class, and at WIDTH and on after each split word, by the leaf before it; all tokens of the task together."""
    pairs, tables, tokens = np.zeros(LEAVES * LEAVES, np.uint32), np.zeros((5, LEAVES * WIDTH), np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    span = LEAVES * (LEAVES + 1)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def sent() -> Iterator[pa.RecordBatch]:
        keys, n = merged()
        held.clear()
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] // span != keys[:-1] // span]))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            yield row(WIDTH + int(keys[i] // span), keys[i:j] % span, n[i:j])

    def blocks() -> Iterator[pa.RecordBatch]:
        for c in range(WIDTH):
            block = np.concatenate([pairs[c * PAIRS : (c + 1) * PAIRS], tables[:, c * LEAVES : (c + 1) * LEAVES].ravel()])
            keys = np.flatnonzero(block)
            if keys.size:
                yield row(c, keys, block[keys])

    def row(part: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(keys, n)], pa.binary())], ["part", "data"])

    for batch in _batches(batches):
        h, tails, sizes = tokens_of(batch.column(1).to_pylist())
        if tokens + len(h) >= 1 << 32:
            yield from blocks()
            pairs[:], tables[:], tokens = 0, 0, 0
        tokens += len(h)
        begins = np.cumsum(sizes) - sizes
        leaf = known.leaves(h, tails).astype(np.int64)
        one, word = np.concatenate([[1], leaf[:-1]]), np.concatenate([[0], known.place(h[:-1])])
        one[begins], word[begins] = 1, known.place(np.array([START]))[0]
        two = np.concatenate([[1], one[:-1]])
        two[begins] = 1
        learn = np.repeat(batch.column(3).to_numpy(zero_copy_only=False).astype(bool), sizes)
        some = np.flatnonzero(word >= 0)
        if some.size:
            held.append(np.unique((word[some] * LEAVES + two[some]) * (LEAVES + 1) + np.where(learn[some], leaf[some], LEAVES), return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held[:] = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield from sent()
        one, two, leaf = one[learn], two[learn], leaf[learn]
        if not len(leaf):
            continue
        keys = np.sort((one * LEAVES + two).astype(np.int32))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        pairs[keys[at]] += np.diff(np.concatenate([at, [len(keys)]])).astype(np.uint32)
        kind = leaf // WIDTH
        inner = np.flatnonzero(kind >= HEADS)
        c, d, x = one[inner] // WIDTH, two[inner] // WIDTH, leaf[inner]
        for table, found in zip(tables, (one * WIDTH + kind, two * WIDTH + kind, c * LEAVES + d * WIDTH + x // WIDTH, c * LEAVES + x, d * LEAVES + x), strict=True):
            table += np.bincount(found, minlength=len(table))
    yield from blocks()
    if held:
        yield from sent()


def _totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tallies of one part, added."""
    total = None
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if total is None:
                total = np.zeros(BLOCK if part < WIDTH else LEAVES * (LEAVES + 1), np.int64)
            keys, n = _unpacked(data.as_py())
            total[keys] += n
    keys = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(keys, total[keys])], pa.binary())], ["part", "data"])


def _leaf_sums(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
    """data: of the task's classes the expected counts of the four leaf tables, and those seen."""
    out = np.zeros((8, LEAVES, WIDTH), np.float32)
    for batch in batches:
        for c, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys, n = _unpacked(data.as_py())
            block = np.zeros(BLOCK, np.int64)
            block[keys] = n
            after, before, both, after_in, before_in = block[PAIRS:].reshape(5, LEAVES)
            own = slice(c * WIDTH, (c + 1) * WIDTH)
            for table, found in zip(out[4:], (after, before, after_in, before_in), strict=True):
                table[own] += found.reshape(WIDTH, WIDTH)
            at = np.flatnonzero(block[:PAIRS])
            total = block[at, None].astype(np.float32)
            sums = [*_leaf_expected(c * WIDTH + at // LEAVES, at % LEAVES, np.zeros(len(at), np.int64), total, known.class_prior, *known.rows[:2])]
            both = both.reshape(WIDTH, WIDTH).T  # by class of the target, then of the second leaf
            k, d = np.nonzero(both)
            sums += _leaf_expected(c * WIDTH + k, d * WIDTH + k, k, both[k, d, None].astype(np.float32), known.leaf_prior, *known.rows[2:])
            out[:4] += np.stack(sums)
    yield pa.RecordBatch.from_arrays([pa.array([pa.compress(out.tobytes(), "zstd", asbytes=True)], pa.binary())], ["data"])


def _split_rows(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
    """word, leaf, parts, data: the steps of a split word's rows, with leaf -1; the counts after each pair of it and a leaf that is split too."""
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            word = part - WIDTH
            own = int(known.split_leaf[word])
            keys, n = _unpacked(data.as_py())
            b, x = keys // (LEAVES + 1), keys % (LEAVES + 1)
            parts = -(-np.bincount(b, n, LEAVES).astype(np.int64) * known.shards // known.tokens)
            learn = x < LEAVES
            b, x, n = b[learn], x[learn], n[learn]
            seen = np.bincount(b * WIDTH + x // WIDTH, n, LEAVES * WIDTH).reshape(LEAVES, WIDTH)
            e = _expected(known.class_prior + known.rows[0][own] + known.rows[1], seen.sum(1, keepdims=True))
            steps = np.zeros((1 + WIDTH, WIDTH))
            steps[0] = _step(seen.sum(0), e.sum(0), DAMP[1])
            inner = x // WIDTH >= HEADS
            totals = np.bincount((x // WIDTH * WIDTH + b // WIDTH)[inner], n[inner], LEAVES).reshape(WIDTH, WIDTH)
            after = np.bincount(x[inner], n[inner], LEAVES).reshape(WIDTH, WIDTH)
            for k in range(HEADS, WIDTH):
                e = _expected(known.leaf_prior[k] + known.rows[2][own // WIDTH * WIDTH + k] + known.rows[3][k::WIDTH], totals[k][:, None])
                steps[1 + k] = _step(after[k], e.sum(0), DAMP[1])
            rows = [(-1, 0, steps)]
            for leaf in np.flatnonzero(parts > 1).tolist():
                here = b == leaf
                rows.append((leaf, int(parts[leaf]), np.concatenate([seen[leaf][None], np.bincount(x[here & inner], n[here & inner], LEAVES).reshape(WIDTH, WIDTH)])))
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                arrays = [pa.array([word] * len(some), pa.int32()), pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([r[2].astype(np.float32).tobytes() for r in some], pa.binary())], ["word", "leaf", "parts", "data"])


#: A packed run of examples: per distinct word before its hash, leaf and number of examples; per example the other leaves, the text's place and whether it's learned from.
_RUN = np.dtype([("h", "<u8"), ("leaf", "<u2"), ("n", "<u4")])
_EXAMPLE = np.dtype([("two", "<u2"), ("target", "<u2"), ("text", "<u2")])


def deal(texts: list[str | None], learn: np.ndarray, salts: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """The number of tokens of each text, and for each shard its packed examples. salts part the split pairs."""
    h, tails, sizes = tokens_of(texts)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    uniques, first, codes = np.unique(h, return_index=True, return_inverse=True)
    uniques = np.append(uniques, START)
    leaf = np.append(known.leaves(uniques[:-1], tails[first]), 1).astype(np.int64)
    often = known.frequent(uniques)[0]
    parts = np.maximum(1, -(-2 * often * known.shards // known.tokens)).astype(np.uint64)
    one = np.concatenate([[0], codes[:-1]])
    one[begins] = len(uniques) - 1
    two = np.concatenate([[0], one[:-1]])
    two[begins] = len(uniques) - 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    name = uniques.copy()
    where = mixed(name)[one]
    split = np.flatnonzero(parts[one] > 1)
    if split.size:
        x, y = one[split], two[split]
        sub = mixed(leaf[y].astype(np.uint64) ^ np.uint64(0x5BF03635)) % parts[x]
        pair = known.pair(known.place(uniques)[x], leaf[y])
        salt = mixed(salts[text[split]]) % np.append(known.pair_parts, 1)[pair].astype(np.uint64)
        where[split] = mixed(uniques[x] + sub * np.uint64(0x9E3779B97F4A7C15) + salt * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    shard = (where % np.uint64(known.shards)).astype(np.int64)
    order = np.argsort(shard * len(uniques) + one)
    shard, one = shard[order], one[order]
    made = np.empty(len(order), _EXAMPLE)
    made["two"], made["target"] = leaf[two[order]], leaf[codes[order]]
    text = text[order]
    made["text"] = text << 1 | learn[text]
    run = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (one[1:] != one[:-1])]))
    runs = np.empty(len(run), _RUN)
    runs["h"], runs["leaf"], runs["n"] = uniques[one[run]], leaf[one[run]], np.diff(np.concatenate([run, [len(order)]]))
    shards = shard[run]
    at = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
    out = []
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(run)], strict=True):
        a, b = run[i], run[j] if j < len(run) else len(order)
        out.append((int(shards[i]), b"".join((np.int64(j - i).tobytes(), runs[i:j].tobytes(), made[a:b].tobytes()))))
    return sizes, out


def judge(blobs: list[bytes], known: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """Empties the list of packed runs of a shard, and gives for each the places of its texts and, for each, known tokens, their log10 of count and one, and the model's log10 (without END's own counts)."""
    runs, examples, sizes = [], [], []
    for x in blobs:
        u = int(np.frombuffer(x, np.int64, 1)[0])
        runs.append(np.frombuffer(x, _RUN, u, 8))
        examples.append(np.frombuffer(x, _EXAMPLE, -1, 8 + u * _RUN.itemsize))
        sizes.append(len(examples[-1]))
    runs, examples = np.concatenate(runs), np.concatenate(examples)
    blobs.clear()
    names, codes = np.unique(runs["h"], return_inverse=True)
    times = runs["n"].astype(np.int64)
    one, leaf_one = np.repeat(codes, times), np.repeat(runs["leaf"].astype(np.int32), times)
    learn = (examples["text"] & 1).astype(bool)
    count = np.bincount(one, learn, len(names))
    often = known.frequent(names)[1]
    count = np.where(often >= 0, often, count)
    isword = names != START
    log_count = np.where(isword, np.log10(count + 1), 0.0)
    target, two = examples["target"].astype(np.int32), examples["two"].astype(np.int32)
    kind, place = target // WIDTH, target % WIDTH
    zero = np.zeros(len(one), np.int8)
    word = known.place(names).astype(np.int32)[one]
    pair = known.pair(word, two)
    ln = softmax_scores(one, two, leaf_one, two, known.class_prior, zero, kind, learn, known.rows[:2], (word, known.word_steps[:, 0], pair, known.pair_counts[:, 0]))
    some = np.flatnonzero(kind >= HEADS)
    if some.size:
        k = kind[some]
        given = [y for x, own in ((word, known.word_steps), (pair, known.pair_counts)) for y in (np.where(x[some] >= 0, x[some] * WIDTH + k, -1), own[:, 1:].reshape(-1, WIDTH))]
        ln[some] += softmax_scores(one[some] * WIDTH + k, two[some], leaf_one[some] // WIDTH * WIDTH + k, two[some] // WIDTH * WIDTH + k, known.leaf_prior, k, place[some], learn[some], known.rows[2:], tuple(given))
    score = ln / np.log(10) + np.where(known.single[leaf_one] | ~isword[one], 0.0, log_count[one] + known.lower[leaf_one])
    each = np.stack([((count > 0) & isword)[one].astype(np.float64), log_count[one], score])
    out, at = [], 0
    for n in sizes:
        text = (examples["text"][at : at + n] >> 1).astype(np.int64)
        places, back = np.unique(text, return_inverse=True)
        out.append((places.astype(np.uint16), np.stack([np.bincount(back, x, len(places)) for x in each[:, at : at + n]])))
        at += n
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller batches, by the third column's sizes: of BATCH_CHARS characters, or of one row."""
    for batch in batches:
        sizes = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            upto = min(int(np.searchsorted(sizes, before + BATCH_CHARS, "right")), at + BATCH_TEXTS)
            yield batch.slice(at, max(1, upto - at))
            at += max(1, upto - at)


def _added(h: np.ndarray, k: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct h with its k and the sums of its numbers."""
    uniques, first, back = np.unique(h, return_index=True, return_inverse=True)
    return uniques, k[first], *(np.bincount(back, x, len(uniques)).astype(np.int64) for x in numbers)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, tail, n, c: tokens of some batches, how many there are and how many to learn from."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        return _added(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def sent() -> Iterator[pa.RecordBatch]:
        h, *rest = merged()
        held.clear()
        for at in range(0, len(h), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (h.view(np.int64), *rest)], ["h", "tail", "n", "c"])

    for batch in _batches(batches):
        h, k, sizes = tokens_of(batch.column(1).to_pylist())
        learn = np.repeat(batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        held.append(_added(h, k, np.ones(len(h), np.int64), learn))
        if sum(len(x[0]) for x in held) > HELD:
            held[:] = [merged()]
            if len(held[0][0]) > HELD // 2:
                yield from sent()
    if held:
        yield from sent()


def learned(own: DataFrame) -> Vocabulary:
    """The vocabulary of rows (key, text, chars, learns), with the rows that many shards use."""
    counts = materialize(own.mapInArrow(freeing(_counted), "h long, tail int, n long, c long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.first("tail").alias("tail")))
    end = counts.filter(F.col("h") == int(END)).first()
    words = counts.filter(F.col("h") != int(END))
    tokens = (words.agg(F.sum("n")).first()[0] or 0) + (end["n"] if end else 0)
    mass = {r["tail"]: (r["c"], r["v"]) for r in words.filter("c > 0").groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    # Words with leaves of their own are among the LEAVES most frequent ones; those too frequent for a shard are at most twice as many as shards.
    top = words.filter("c > 0").orderBy(F.desc("c"), "h").limit(LEAVES).collect()
    often = words.filter(F.col("n") * 2 * shards_for(tokens) >= tokens).collect()
    name = lambda r: r["h"] & (2**64 - 1)
    known = Vocabulary([(name(r), r["c"], r["tail"]) for r in top], [(name(r), r["n"], r["c"], r["tail"]) for r in often], mass, end["c"] if end else 0, end["n"] if end else 0, tokens)
    _train_shared(own, known)
    return known


def _train_shared(own: DataFrame, known: Vocabulary) -> None:
    """The rows that many shards use, from all learning tokens: of leaves, of split words and split pairs. The driver gets SUMMING sums of the leaf
    tables a sweep, and the rows of split words and pairs, of which there are at most some for each shard."""

    def mapped(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch], Vocabulary], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        sent = own.sparkSession.sparkContext.broadcast(known)
        return df.mapInArrow(freeing(lambda batches: task(batches, sent.value)), schema)

    totals = materialize(mapped(own, _tallied, "part int, data binary").groupBy("part").applyInArrow(_totalled, "part int, data binary"))
    blocks = totals.filter(F.col("part") < WIDTH).repartition(SUMMING)
    for _ in range(SWEEPS):
        sums = np.zeros((8, LEAVES, WIDTH))
        for r in mapped(blocks, _leaf_sums, "data binary").collect():
            sums += np.frombuffer(pa.decompress(r["data"], 4 * sums.size, "zstd", asbytes=True), np.float32).reshape(sums.shape)
        known.rows = (known.rows + RATE * _step(sums[4:], sums[:4], DAMP[0])).astype(np.float32)
    if not len(known.split):
        return
    found = mapped(totals.filter(F.col("part") >= WIDTH), _split_rows, "word int, leaf int, parts long, data binary").collect()
    rows = {(r["word"], r["leaf"]): np.frombuffer(r["data"], np.float32).reshape(1 + WIDTH, WIDTH) for r in found}
    none = np.zeros((1 + WIDTH, WIDTH), np.float32)
    known.word_steps = np.stack([rows.get((w, -1), none) for w in range(len(known.split))])
    split = sorted((r["word"], r["leaf"], r["parts"]) for r in found if r["leaf"] >= 0)
    if split:
        known.pairs, known.pair_parts = np.array([w * LEAVES + x for w, x, _ in split], np.int64), np.array([n for *_, n in split], np.int64)
        known.pair_counts = np.stack([rows[w, x] for w, x, _ in split])


def score(df: DataFrame, learning: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score of each row.

    learning: a condition on df's columns for the texts to learn from. A null text counts as empty, which has END as its only token. base_score
    is the add-one unigram model's log10 probability, score the maximum-entropy model's. Without learning texts all tokens are
    unknown. Rows stay as many as they are, repeated ones too; an empty table gives an empty result. df is read three times; a text is held whole by a task.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.coalesce(learning, F.lit(False)).alias("learns"), F.xxhash64(key).alias("salt"))
    known = learned(own)
    sent = spark.sparkContext.broadcast(known)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, at, names = sent.value, TaskContext.get().partitionId() << 32, ["batch", "shard", "data"]
        for batch in _batches(batches):
            sizes, blobs = deal(batch.column(1).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(4).to_numpy().view(np.uint64), known)
            sink = pa.BufferOutputStream()
            meta = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["key", "n"])
            with pa.ipc.new_stream(sink, meta.schema) as writer:
                writer.write_batch(meta)
            rows = [(-1 - at % known.shards, sink.getvalue().to_pybytes()), *blobs]
            for i in range(0, len(rows), 64):
                part = rows[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int64()), pa.array([x for x, _ in part], pa.int64()), pa.array([x for _, x in part], pa.binary())], names)
            at += 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group is a shard's examples, or the descriptions of some batches, which pass."""
        ids, blobs = [], []
        for batch in batches:
            if batch.num_rows and batch.column(1)[0].as_py() < 0:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([True] * batch.num_rows), batch.column(2)], ["batch", "meta", "data"])
                continue
            ids += batch.column(0).to_pylist()
            blobs += batch.column(2).to_pylist()
        if not ids:
            return
        order = sorted(range(len(ids)), key=ids.__getitem__)
        blobs = [blobs[i] for i in order]
        give_back()
        made = judge(blobs, sent.value)
        give_back()
        data = [b"".join((np.int64(len(p)).tobytes(), p.tobytes(), x.tobytes())) for p, x in made]
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in order], pa.int64()), pa.array([False] * len(ids)), pa.array(data, pa.binary())], ["batch", "meta", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, meta, parts = sent.value, None, []
        for batch in batches:
            for m, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if m:
                    meta = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]
                else:
                    n = int(np.frombuffer(data, np.int64, 1)[0])
                    parts.append((np.frombuffer(data, np.uint16, n, 8), np.frombuffer(data, np.float64, 3 * n, 8 + 2 * n).reshape(3, n)))
        size = meta.column(1).to_numpy()
        sums = np.zeros((3, len(size)))
        for places, x in sorted(parts, key=lambda p: p[1][2].sum()):
            sums[:, places] += x
        n_known = np.rint(sums[0]).astype(np.int64) + (known.ends > 0)
        base = sums[1] + np.log10(known.ends + 1) - size * np.log10(known.n + known.v + 1)
        yield pa.RecordBatch.from_arrays([meta.column(0), meta.column(1), pa.array(n_known), pa.array(np.full(len(size), known.n)), pa.array(base), pa.array(sums[2])], ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    shuffled = own.mapInArrow(freeing(dealt), "batch long, shard long, data binary").groupBy("shard").applyInArrow(scored, "batch long, meta boolean, data binary")
    result = shuffled.groupBy("batch").applyInArrow(summed, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return result.withColumnRenamed("key", key)


def op7(documents: DataFrame) -> DataFrame:
    """The contract's columns: every document is scored, learning from those whose crc32(doc_id) modulo 7 is not 2."""
    found = score(documents.select("doc_id", "text"), learns(F.col("doc_id"), 7, 2))
    return found.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
