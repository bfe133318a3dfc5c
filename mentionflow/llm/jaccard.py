"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents with the same set of word shingles are one class, whatever their keys are. Classes that share a band of MinHash values are linked into
candidate components. Within a component, pairs are compared incrementally, STEP values at a time: a pair is dropped
when the posterior probability that its similarity reaches the threshold (uniform prior, binomial agreement of MinHash
values) falls below TOLERANCE. The rest are verified exactly, on their shingle sets. Large components are cut into blocks,
each pair of blocks a task's row group of bounded size; links are counted, not listed, so a group of near copies yields a
row for each document and block pair instead of all its pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import common_join, freeing, materialize

SHINGLE, THRESHOLD = 5, 0.8
#: 40 bands of 6 values: a pair at similarity 0.8 shares none with probability 6e-6, at 0.85 with 2e-9.
BANDS, ROWS, STEP, TOLERANCE = 40, 6, 24, 1e-6
BLOCK = 512
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of SHINGLE lower-cased words; all its words if it has fewer."""
    parts = [WORD.findall(t.lower()) if t else [] for t in texts]
    flat = [w for p in parts for w in p]
    if not flat:
        return [np.zeros(0, np.uint64)] * len(texts)
    codes, uniques = pd.factorize(np.array(flat, object))
    h = _mixed(pd.util.hash_array(uniques))[codes]
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled[: max(0, n - SHINGLE + 1)] = (rolled[: max(0, n - SHINGLE + 1)] ^ h[k : n - SHINGLE + 1 + k]) * _MIX if n >= SHINGLE else 0
    rolled = _mixed(rolled)
    out, at = [], 0
    for p in parts:
        if len(p) >= SHINGLE:
            out.append(np.unique(rolled[at : at + len(p) - SHINGLE + 1]))
        elif p:
            x = np.array([len(p)], np.uint64)
            for k in range(len(p)):
                x = (x ^ h[at + k]) * _MIX
            out.append(_mixed(x))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(p)
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    a, b = _hashes()
    best = np.full(len(a), 2**32 - 1, np.uint64)
    x = (shingles & np.uint64(0xFFFFFFFF))[:, None]
    for at in range(0, len(x), 512):
        best = np.minimum(best, ((x[at : at + 512] * a + b) >> np.uint64(32)).min(axis=0))
    return best.astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    x = np.arange(BANDS, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        x = _mixed((x ^ column.astype(np.uint64)) * _MIX)
    return x.view(np.int64)


@cache
def least_agreement(threshold: float) -> list[tuple[int, int]]:
    """(n, m): of n compared values at least m must agree, else the posterior P(similarity >= threshold) is under TOLERANCE.

    With a uniform prior that posterior is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, 0
        while m <= n and (total := total + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < TOLERANCE:
            m += 1
        out.append((n, m))
    return out


def links(sig_a: np.ndarray, sets_a: list[np.ndarray], sig_b: np.ndarray, sets_b: list[np.ndarray], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) whose exact similarity is threshold or more; i < j if a and b are the same block."""
    size_b = np.array([len(x) for x in sets_b])
    values, codes = np.unique(np.concatenate(sets_b), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size_b)[:-1]])
    mark = np.zeros(len(values) + 1, np.int32)
    out_i, out_j = [], []
    for i, s in enumerate(sets_a):
        fits = (np.minimum(size_b, len(s)) >= threshold * np.maximum(size_b, len(s)) - 1e-9) & (size_b > 0)
        if same:
            fits[: i + 1] = False
        j = np.flatnonzero(fits)
        agree = np.zeros(len(j), np.int64)
        before = 0
        for n, m in least_agreement(threshold):
            if not len(j):
                break
            agree += (sig_b[j, before:n] == sig_a[i, before:n]).sum(axis=1)
            alive = agree >= m
            j, agree, before = j[alive], agree[alive], n
        if not len(j):
            continue
        at = np.searchsorted(values, s)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == s)]
        mark[at] = 1
        common = np.array([mark[codes[starts[k] : starts[k] + size_b[k]]].sum() for k in j])
        mark[at] = 0
        real = common >= threshold * (len(s) + size_b[j] - common) - 1e-9
        out_j.append(j[real])
        out_i.append(np.full(real.sum(), i))
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its connected component) of each node of the edges a, b.

    Each round links every node to the least node among its neighbours and itself, then replaces the edges by those between the
    roots so found, until none is left; the steps are then followed back. Rounds shrink the graph by half at least, and hot nodes are aggregated before the shuffle.
    """
    steps, now = [], materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not now.isEmpty():
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        steps.append(least)
        up = lambda c: least.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: B023, E731
        now = materialize(now.join(up("a"), "a").join(up("b"), "b").filter("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = _rooted(steps[-1])
    for step in reversed(steps[:-1]):
        roots = found.select(F.col("node").alias("up"), F.col("root"))
        found = materialize(_rooted(step).withColumnRenamed("root", "up").join(roots, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    return found


def _rooted(step: DataFrame) -> DataFrame:
    """node, root of the forest node -> up: pointers are doubled until they rest."""
    now = step.select("node", F.col("up").alias("root"))
    while True:
        on = now.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(on, "root", "left").select("node", F.coalesce("further", "root").alias("root"), (F.coalesce("further", "root") != F.col("root")).alias("moved")))
        if after.filter("moved").isEmpty():
            return after.select("node", "root")
        now = after.select("node", "root")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = shingle_sets(part.column(2).to_pylist())
            keys = [band_keys(minhash(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["row", "key", "mark", "keys"])


def numbered(df: DataFrame) -> DataFrame:
    """own (a struct of df's columns), row (a number that no other row has)."""
    return materialize(df.select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("row")))


def linked(rows: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """row, key, mark, class_id, n_links, group_id, root: one row for each of rows, as numbered() gives them.

    mark: a digest of the row's shingles, null without a word. Rows with one mark are a class, known by its least row whatever their keys are; root is the
    least such number in the row's group, its own row without a word. Keys only name what is found, so they may repeat or be null.
    """
    kind = rows.schema["own"].dataType[key].dataType.simpleString()
    read = rows.select("row", F.col("own")[key].alias("key"), F.col("own")[text].alias("text"))
    sketched = materialize(read.mapInArrow(freeing(_sketch), f"row long, key {kind}, mark string, keys array<bigint>"))
    classes = materialize(sketched.filter("mark is not null").groupBy("mark").agg(F.min("row").alias("id"), F.min("key").alias("class"), F.count("*").alias("copies"), F.first("keys").alias("keys")))
    bands = classes.select("id", F.explode("keys").alias("band"))
    shared = bands.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most").select("band", "least")
    edges = bands.join(shared, "band").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    counted = verified(read.select(F.col("row").alias("id"), "text"), classes, components(edges), threshold)
    found = counted.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(counted.select(F.col("id").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "id")
    whole = materialize(classes.select("mark", "id", "class", "copies").join(found, "id", "left").join(group, "id", "left").withColumn("root", F.coalesce("root", "id")))
    names = whole.groupBy("root").agg(F.min("class").alias("group"))
    classes_of = materialize(whole.join(names, "root"))
    return (
        common_join(sketched.select("row", "key", "mark"), classes_of, "mark", "copies", sketched.count())
        .select("row", "key", "mark", F.coalesce("class", "key").alias("class_id"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("group", "key").alias("group_id"), F.coalesce("root", "row").alias("root"))
    )


def join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id, n_links, group_id: one row for each row of df.

    class_id is the least key among rows with the same shingles; n_links the number of other rows with a similarity of threshold or more
    (copies included); group_id the least class_id that the row is linked to through any number of links, its own if it has none. Rows without a word,
    null or empty, are alike to none: their class and group are their own key. Rows with a null key are compared too, but give a name to nothing: class_id
    and group_id are null where all keys are. Keys may repeat: rows are compared by their texts, so texts under one key have their own links,
    though their classes have one name.
    """
    found = linked(numbered(df.select(key, text)), key, text, threshold)
    return found.select(F.col("key").alias(key), "class_id", "n_links", "group_id")


def verified(texts: DataFrame, classes: DataFrame, candidate: DataFrame, threshold: float) -> DataFrame:
    """id, n (rows linked to it, by block pair), peer (a class in the same local group): the exact links within candidate components. texts: id, text."""
    sizes = candidate.groupBy("root").agg(F.count("*").alias("size"))
    member = candidate.join(sizes, "root").select(F.col("node").alias("id"), "root", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    copies = classes.select("id", "copies")
    member = member.join(copies, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    known = texts.join(member, "id")
    # A block meets each block of its component once: the pair is named by the smaller and the larger number. Small components share a group by hash.
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    dealt = known.select("id", "copies", "text", "root", "block", F.explode(met).alias("pair"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        sets = shingle_sets(pdf["text"].tolist())
        sig = np.array([minhash(s) for s in sets])
        ids, copies, block = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": [], "peer": []}).astype("int64")
        i, j = links(sig[a], [sets[k] for k in a], sig[b], [sets[k] for k in b], x == y, threshold)
        i, j = a[i], b[j]
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        # Each row's least index in its local group.
        peer = np.arange(len(ids))
        while True:
            was = peer.copy()
            np.minimum.at(peer, i, peer[j])
            np.minimum.at(peer, j, peer[i])
            peer = peer[peer]
            if (was == peer).all():
                break
        some = n > 0
        return pd.DataFrame({"id": ids[some], "n": n[some].astype("int64"), "peer": ids[peer[some]]})

    flat = dealt.select("id", "copies", "text", "root", "block", "pair.x", "pair.y")
    return materialize(flat.groupBy("root", "x", "y").applyInPandas(compare, "id long, n long, peer long"))


def distinct(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without near-duplicates: one row of each group stays, that with the least key (null keys last); rows without a word all stay.

    Rows are judged one by one: a row that goes takes no other row of its key along.
    """
    rows = numbered(df)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark", "row")).alias("first")
    stays = linked(rows, key, text, threshold).groupBy("root").agg(first).select("first.row")
    return rows.join(stays, "row", "left_semi").select("own.*")


def op8(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and group_id of each document; see join()."""
    return join(documents.select("doc_id", "text"))
