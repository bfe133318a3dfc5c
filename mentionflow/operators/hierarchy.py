"""Incremental hierarchical clustering of a stream of vectors, and its tree as a table.

A stream is worked through in order by one task; streams (blocks) run side by side. A point joins the tree beside its nearest active
node or an ancestor of it (rotation); then a subtree elsewhere may move beside the new node (graft); beyond a limit of active
nodes, two active siblings are folded into their parent, so the search stays bounded.
"""

from __future__ import annotations

from bisect import bisect_left
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMS = ("dot", "l2", "sql2")
NORMS = ("l2", "l_inf", "none")
PRUNINGS = ("similarity", "least_recent", "combined")
NODE_TABLE = "block string, node long, parent long, active boolean, seq long, score double, n_leaves long"


class Hierarchy:
    """Nodes have ids in the order in which they appear, points among inner nodes. parent is -1 at the root."""

    def __init__(self, sim: str = "dot", norm: str = "l2", rotate_cap: int = 100, graft_cap: int = 100, limit: int | None = None, pruning: str = "least_recent", pruning_threshold: float | None = None, compat: bool = False):
        """compat: a graft compares pairs with those that may not join scored 0, so that a joinable pair below 0 is passed over."""
        if sim not in SIMS or norm not in NORMS or pruning not in PRUNINGS:
            raise ValueError(f"sim, norm and pruning must be among {SIMS}, {NORMS} and {PRUNINGS}")
        if pruning == "combined" and pruning_threshold is None:
            raise ValueError("combined pruning needs pruning_threshold")
        if limit is not None and limit < 2:
            raise ValueError("limit must be 2 or more")
        self.sim, self.norm, self.rotate_cap, self.graft_cap = sim, norm, rotate_cap, graft_cap
        self.limit, self.pruning, self.pruning_threshold, self.compat = limit, pruning, pruning_threshold, compat
        # None where it isn't known yet: a node whose sum isn't known has none above it whose sum is. Below active nodes no sum is looked at again.
        self.sums: list[np.ndarray | None] = []
        self.centroids: list[np.ndarray | None] = []
        self.linkages: list[float | None] = []
        self.counts: list[int] = []
        self.parents: list[int] = []
        self.children: list[list[int]] = []
        self.first_used: list[int] = []
        self.seqs: list[int | None] = []
        self.foldable: set[int] = set()  # parents of two active nodes
        self.active: dict[int, np.ndarray] = {}  # centroid of each active node
        self.ids: list[int] = []  # the active nodes, ascending, and their centroids as the first rows of a matrix
        self.matrix = np.empty((0, 0))
        self.step = 0

    def _node(self, total: np.ndarray, count: int, seq: int | None) -> int:
        for column, x in ((self.sums, total), (self.counts, count), (self.parents, -1), (self.children, []), (self.first_used, self.step), (self.seqs, seq), (self.centroids, None), (self.linkages, None)):
            column.append(x)
        return len(self.sums) - 1

    def _activate(self, node: int, centroid: np.ndarray) -> None:
        n, at = len(self.ids), bisect_left(self.ids, node)
        if n == len(self.matrix):
            grown = np.empty((max(64, 2 * n), len(centroid)))
            if n:
                grown[:n] = self.matrix
            self.matrix = grown
        self.matrix[at + 1 : n + 1] = self.matrix[at:n]
        self.matrix[at] = centroid
        self.ids.insert(at, node)
        self.active[node] = centroid

    def _deactivate(self, node: int) -> None:
        n, at = len(self.ids), bisect_left(self.ids, node)
        self.matrix[at : n - 1] = self.matrix[at + 1 : n]
        del self.ids[at], self.active[node]

    def total(self, node: int) -> np.ndarray:
        if self.sums[node] is None:
            todo = [node]
            for k in todo:  # grows: each node before its children
                todo += [c for c in self.children[k] if self.sums[c] is None]
            for k in reversed(todo):
                a, b = self.children[k]
                self.sums[k] = self.sums[a] + self.sums[b]
        return self.sums[node]

    def centroid(self, node: int) -> np.ndarray:
        found = self.centroids[node]
        if found is None:
            found = self.centroids[node] = self._unit(self.total(node) / self.counts[node])
        return found

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each row of a with each of b."""
        if self.sim == "dot":
            return a @ b.T
        gap = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        return 1 / (1 + (np.sqrt(gap) if self.sim == "l2" else gap))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> float:
        return float(a.dot(b)) if self.sim == "dot" else float(self.likeness(a[None], b[None])[0, 0])

    def linkage(self, node: int) -> float:
        """The likeness of the children's centroids; minus infinity at a leaf."""
        found = self.linkages[node]
        if found is None:
            pair = [self.centroid(c) for c in self.children[node]]
            found = self.linkages[node] = self._pair(*pair) if pair else -np.inf
        return found

    def nearest(self, vector: np.ndarray, without: set[int]) -> int | None:
        rows = [i for i, k in enumerate(self.ids) if k not in without]
        if not rows:
            return None
        return self.ids[rows[int(self.likeness(vector[None], self.matrix[rows] if without else self.matrix[: len(rows)])[0].argmax())]]

    def upward(self, node: int) -> list[int]:
        out = [node]
        while (node := self.parents[node]) >= 0:
            out.append(node)
        return out

    def _refresh(self, node: int) -> None:
        """Counts from node to the root; sums, centroids and linkages are found again where they are asked for. No node over active ones is active."""
        counts, children, parents = self.counts, self.children, self.parents
        known = True
        while node >= 0:
            a, b = children[node]
            counts[node] = counts[a] + counts[b]
            if known:
                known = self.sums[node] is not None or self.linkages[node] is not None or self.centroids[node] is not None
                self.sums[node] = self.centroids[node] = self.linkages[node] = None
            node = parents[node]

    def _mark(self, node: int) -> None:
        if node >= 0:
            (self.foldable.add if all(c in self.active for c in self.children[node]) else self.foldable.discard)(node)

    def _join(self, old: int, new: int) -> int:
        """A new node over old and new takes old's place. A parent that new leaves goes, and its other child takes that one's place."""
        left = self.parents[new]
        if left >= 0:
            other, above = next(c for c in self.children[left] if c != new), self.parents[left]
            self.parents[other], self.children[left], self.parents[left] = above, [], -2
            self.sums[left] = self.centroids[left] = self.linkages[left] = None
            self.foldable.discard(left)
            if above >= 0:
                self.children[above] = [other if c == left else c for c in self.children[above]]
                self._refresh(above)
                self._mark(above)
        above = self.parents[old]
        top = self._node(self.total(old) + self.total(new), self.counts[old] + self.counts[new], None)
        self.children[top], self.parents[top] = [old, new], above
        if above >= 0:
            self.children[above] = [top if c == old else c for c in self.children[above]]
        self.parents[old] = self.parents[new] = top
        self._refresh(above)
        self._mark(top)
        self._mark(above)
        return top

    def insert(self, seq: int, vector: np.ndarray) -> None:
        vector = vector.astype(float)
        near = self.nearest(self._unit(vector), set())
        leaf = self._node(vector, 1, seq)
        self._activate(leaf, self.centroid(leaf))
        if near is not None:
            at, score = near, self._pair(self.active[leaf], self.active[near])
            while (up := self.parents[at]) >= 0 and score < self.linkage(up) and self.counts[up] < self.rotate_cap:
                at = up
            self.graft(self._join(at, leaf))
            while self.limit is not None and len(self.active) > self.limit and self.prune():
                pass
        self.step += 1

    def _unit(self, vector: np.ndarray) -> np.ndarray:
        size = sqrt(vector.dot(vector)) if self.norm == "l2" else np.abs(vector).max(initial=0) if self.norm == "l_inf" else 1
        return vector / size if size else vector

    def graft(self, node: int) -> None:
        if self.parents[node] < 0:
            return
        sibling = next(c for c in self.children[self.parents[node]] if c != node)
        other = self.nearest(self.centroid(node), self.below(node) | {sibling})
        if other is None:
            return
        one, two = self.upward(node), self.upward(other)
        shared = set(one) & set(two)
        one = [k for k in one if k not in shared and self.counts[k] < self.graft_cap]
        two = [k for k in two if k not in shared and self.counts[k] < self.graft_cap]
        if not one or not two:
            return
        s = self.likeness(*(np.concatenate([self.centroid(k) for k in side]).reshape(len(side), -1) for side in (one, two)))
        bar = np.maximum.outer([self.linkage(self.parents[k]) for k in one], [self.linkage(self.parents[k]) for k in two])
        same = np.equal.outer([self.parents[k] for k in one], [self.parents[k] for k in two])  # siblings already
        free = (s > bar) & ~same
        a, b = np.unravel_index(int(np.where(free, s, 0 if self.compat else -np.inf).argmax()), s.shape)
        if free[a, b]:
            self._join(one[a], two[b])

    def below(self, node: int) -> set[int]:
        out, todo = set(), [node]
        while todo:
            k = todo.pop()
            out.add(k)
            if k not in self.active:
                todo += self.children[k]
        return out

    def prune(self) -> bool:
        """Folds one pair of active siblings into their parent."""
        pairs = sorted(self.foldable)
        if not pairs:
            return False
        links = np.array([self.linkage(p) for p in pairs])
        like = self.pruning == "similarity" or self.pruning == "combined" and links.max() > self.pruning_threshold
        victim = pairs[int(links.argmax() if like else np.argmin([self.first_used[p] for p in pairs]))]
        self.linkage(victim)  # kept from here on
        middle = self.centroid(victim)
        for c in self.children[victim]:
            self._deactivate(c)
            self.sums[c] = self.centroids[c] = None
        self._activate(victim, middle)
        self.counts[victim], self.centroids[victim] = 1, None
        self.foldable.discard(victim)
        if self.parents[victim] >= 0:
            self._refresh(self.parents[victim])
            self._mark(self.parents[victim])
        return True

    def table(self, block: str | None) -> pd.DataFrame:
        """NODE_TABLE's rows: seq at points only, score (linkage) at inner nodes only; n_leaves counts all points below."""
        ids = [k for k, p in enumerate(self.parents) if p != -2]
        leaves, down = {}, [k for k in ids if self.parents[k] == -1]
        for k in down:  # grows: each node before its children
            down += self.children[k]
        for k in reversed(down):
            leaves[k] = sum(leaves[c] for c in self.children[k]) if self.children[k] else 1
        return pd.DataFrame({
            "block": [block] * len(ids), "node": ids, "parent": pd.array([self.parents[k] if self.parents[k] >= 0 else None for k in ids], dtype="Int64"), "active": [k in self.active for k in ids],
            "seq": pd.array([self.seqs[k] for k in ids], dtype="Int64"), "score": [self.linkage(k) if self.children[k] else None for k in ids], "n_leaves": [leaves[k] for k in ids],
        })


def build(df: DataFrame, seq: str = "seq", vector: str = "embedding", block: str | None = None, **options) -> DataFrame:
    """The node table of each block's tree; without a block column all rows are one stream. Rows with a null vector take no part; options are Hierarchy's.

    The folded sum of a pruned pair stays that of all its points, with a count of 1, as its direction is what the scores use.
    """
    Hierarchy(**options)  # wrong options fail here
    own = df.filter(F.col(vector).isNotNull()).select((F.col(block) if block else F.lit(0)).cast("string").alias("block"), F.col(seq).alias("seq"), F.transform(vector, lambda x: x.cast("double")).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, pdf = Hierarchy(**options), pdf.sort_values("seq")
        for s, v in zip(pdf["seq"], pdf["v"], strict=True):
            tree.insert(int(s), np.asarray(v))
        return tree.table(pdf["block"].iloc[0])

    return own.groupBy("block").applyInPandas(run, NODE_TABLE)


def flat(table: DataFrame, threshold: float) -> DataFrame:
    """block, seq, cluster_id (block/node): the topmost node over each point whose score is threshold or more, else the point's own node. Each block's tree is walked by one task, as it was built."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf["block"].iloc[0]
        score = dict(zip(pdf["node"].tolist(), pdf["score"].tolist(), strict=True))
        below: dict[int, list[int]] = {}
        todo = []
        for node, parent in zip(pdf["node"].tolist(), pdf["parent"].tolist(), strict=True):
            if pd.isna(parent):
                todo.append((node, None))
            else:
                below.setdefault(int(parent), []).append(node)
        named = {}
        while todo:
            node, top = todo.pop()
            if top is None and score[node] is not None and score[node] >= threshold:
                top = node
            named[node] = node if top is None else top
            todo += [(c, top) for c in below.get(node, ())]
        points = pdf[pdf["seq"].notna()]
        return pd.DataFrame({"block": points["block"], "seq": points["seq"].astype("int64"), "cluster_id": [f"{block}/{named[n]}" for n in points["node"]]})

    return table.groupBy("block").applyInPandas(run, "block string, seq long, cluster_id string")
