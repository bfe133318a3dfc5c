"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are turned by an orthogonal matrix that gathers their energy in the first components, then cut into segments: 1, 4 and 16 of equal
length, then the first half and the first three quarters of the components each by itself and the rest as one. With a segment's mean m and
deviation s over its n components, the part of the inner product that it gives is at most n * (m m' + s s') (Cauchy-Schwarz on the
centred parts); the sum over segments bounds the score from above, which bounds the distance from below. Pairs whose bound falls under
a score that the query is known to reach k times are dropped, coarse to fine; the survivors' scores are computed exactly, from the vectors as they are.

Queries and candidates are dealt into blocks, and each pair of blocks is a task's group: memory is bounded by the blocks, and work is queries x
candidates at worst, as exact search over unstructured vectors needs. The matrix, and the first scores that queries reach, come from
SAMPLE candidates; they decide on speed, not on results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES, CANDIDATES, SAMPLE, ROWS, CHUNK = 4096, 8192, 4096, 512, 2048
#: Share of pairs left from which on whole blocks are multiplied, being faster than single pairs; pairs that aren't left don't count then either.
DENSE = 0.1


def cuts(d: int) -> list[np.ndarray]:
    """Where the segments of each level start."""
    even = [np.unique(np.linspace(0, d, min(s, d) + 1).astype(int))[:-1] for s in (1, 4, 16)]
    lead = [np.arange(min(d, -(-d * part // 4) + 1)) for part in (2, 3)]
    return [*even, *lead]


def segment_statistics(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means and deviations of the segments, times the root of their sizes: products of two such rows bound the inner product."""
    sizes = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / sizes
    long = sizes > 1  # a segment of one component has no deviation
    square = np.add.reduceat(x * x, starts, axis=1)[:, long] / sizes[long]
    return np.hstack([mean * np.sqrt(sizes), np.sqrt(np.maximum(square - mean[:, long] ** 2, 0) * sizes[long])])


def rotation(x: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose first columns are the directions of most energy."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by doubles where these can hold them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    least = np.iinfo(np.int64).min
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), least)


def seeds(ids: np.ndarray, x: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """For each query a score that k candidates of other ids reach."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(ids), ROWS):
        scores = products(x[at : at + ROWS], sample[1])
        scores[ids[at : at + ROWS, None] == sample[0][None, :]] = np.iinfo(np.int64).min
        out.append(kth_best(scores, k))
    return np.concatenate(out)


def best_pairs(ids: np.ndarray, x: np.ndarray, floor: np.ndarray, other: np.ndarray, y: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best pairs as rows (query's row, score, id), ties to the smaller id, and how many pairs were left after each level."""
    floor, best, left = floor.copy(), np.zeros((0, 3), np.int64), np.zeros(len(cuts(x.shape[1])), np.int64)
    rotated = x @ turn
    own = [segment_statistics(rotated, c) for c in cuts(x.shape[1])]
    length = np.linalg.norm(rotated, axis=1)
    for start in range(0, len(other), CHUNK):
        z = y[start : start + CHUNK]
        turned = z @ turn
        stats = [segment_statistics(turned, c) for c in cuts(x.shape[1])]
        slack = 1e-9 * length * np.linalg.norm(turned, axis=1).max(initial=0) + 1e-6
        found = [best]
        for at in range(0, len(ids), ROWS):
            rows = slice(at, at + ROWS)
            bar = (floor[rows] - slack[rows])[:, None]
            alive = np.ones((len(ids[rows]), len(z)), bool)
            q = c = None  # the surviving pairs, once they are few
            for level, (a, b) in enumerate(zip(own, stats, strict=True)):
                if q is None:
                    alive &= a[rows] @ b.T >= bar
                    left[level] += (n := np.count_nonzero(alive))
                    if n < DENSE * alive.size:
                        q, c = np.nonzero(alive)
                else:
                    keep = np.einsum("ij,ij->i", a[rows][q], b[c]) >= bar[q, 0]
                    q, c = q[keep], c[keep]
                    left[level] += len(q)
            if q is None:
                scores = products(x[rows], z)
                alive &= (scores >= floor[rows][:, None]) & (ids[rows][:, None] != other[start : start + CHUNK][None, :])
                q, c = np.nonzero(alive)
                scores = scores[q, c]
            else:
                scores = np.einsum("ij,ij->i", x[rows][q], z[c])
                keep = (scores >= floor[rows][q]) & (ids[rows][q] != other[start + c])
                q, c, scores = q[keep], c[keep], scores[keep]
            found.append(np.stack([q + at, scores, other[start + c]], axis=1))
        b = np.concatenate(found)
        b = b[np.lexsort((b[:, 2], -b[:, 1], b[:, 0]))]
        rank = np.arange(len(b)) - np.searchsorted(b[:, 0], b[:, 0])
        best, last = b[rank < k], b[rank == k - 1]
        floor[last[:, 0]] = np.maximum(floor[last[:, 0]], last[:, 1])
    return best, left


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def quantised(vector: Column, factor: float = 64.0) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long"))


def _matrix(vectors: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with vectors of another id, ties to the smaller id.

    vectors and queries: an id (long) and a vector (array of long) column, in this order; other columns are not read. Rows with a null id or
    vector, or an empty vector, take no part, and a query meets the vectors of its own length only. Queries need not be among the vectors. A query with fewer than k
    candidates gets them all; an empty side gives no rows. A vec_id repeated with the same vector counts once for each row; a query's id with several vectors gets
    one list, the best of theirs. Sums must stay under 2^63.
    """
    shape = lambda df: df.select(F.col(df.columns[0]).alias("id"), F.col(df.columns[1]).alias("v")).dropna().filter("size(v) > 0").withColumn("d", F.size("v"))
    others, own = shape(vectors), shape(queries).dropDuplicates()
    spark = vectors.sparkSession
    sample: dict[int, tuple[list, list]] = {}
    for r in others.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect():
        ids, rows = sample.setdefault(r["d"], ([], []))
        ids.append(r["id"])
        rows.append(r["v"])
    held = {d: (np.array(ids, np.int64), np.array(rows, np.int64)) for d, (ids, rows) in sample.items()}
    sent = spark.sparkContext.broadcast((held, {d: rotation(x.astype(np.float64)) for d, (_, x) in held.items()}))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            floor = np.full(len(ids), np.iinfo(np.int64).min)
            for d in np.unique(sizes).tolist():
                if d in sent.value[0]:
                    at = np.flatnonzero(sizes == d)
                    floor[at] = seeds(ids[at], _matrix(batch.column(1).take(pa.array(at)), d), sent.value[0][d], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], ["id", "v", "d", "floor"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows and right.num_rows:
            d = left.column("d")[0].as_py()
            turn = sent.value[1].get(d)
            ids, other = (t.column("id").to_numpy() for t in (left, right))
            best, _ = best_pairs(ids, _matrix(left.column("v"), d), left.column("floor").to_numpy(), other, _matrix(right.column("v"), d), np.eye(d) if turn is None else turn, k)
            made = [ids[best[:, 0]], best[:, 2], best[:, 1]]
        made = made or [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": made[0], "vec_id": made[1], "score": made[2]})

    n, m = own.count(), others.count()
    x, y = -(-n // block) or 1, -(-m // candidates) or 1
    place = lambda parts, *of: F.pmod(F.xxhash64(*of), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = own.mapInArrow(seeded, "id long, v array<bigint>, d int, floor long").withColumn("x", place(x, "id", "v")).withColumn("y", every(y))
    # Copies of one row are dealt over the blocks too.
    right = others.withColumn("row", F.monotonically_increasing_id()).withColumn("y", place(y, "id", "row")).drop("row").withColumn("x", every(x))
    best = left.groupBy("d", "x", "y").cogroup(right.groupBy("d", "x", "y")).applyInArrow(compare, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: the 20 best of each query among all usable rows but its own."""
    good = embeddings.filter(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("v"))
    return search(good, good.filter(F.col("vec_id") % 20 == 0), 20)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) rank, vec_id, score FROM r WHERE rank <= 20"""
