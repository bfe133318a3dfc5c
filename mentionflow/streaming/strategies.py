"""Bounded-memory linking: each arrival links to active earlier mentions above a threshold, then one of them may be evicted.

The kernel keeps active mentions only, so its state is limit x dimensions. The label of an arrival is final at once: that
of the latest mention it links to, or its own. Batch and streaming share the kernel; order is the seq column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("backwards", "diversity", "cache", "diversity_cache")
NEVER = 0


class Linker:
    """limit: for backwards the number of predecessors seen; for the others the active count at which one earlier mention goes, 2 or more."""

    def __init__(self, strategy: str, threshold: float, limit: int | None = None):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if limit is not None and limit < (1 if strategy == "backwards" else 2):
            raise ValueError("limit is too small for the strategy")
        self.strategy, self.threshold, self.limit = strategy, threshold, limit
        self.seqs: list[int] = []
        self.vectors: list[np.ndarray] = []
        self.labels: list[int] = []
        self.used: list[int] = []
        self.step = 0

    def arrive(self, seq: int, vector: np.ndarray) -> tuple[int | None, int]:
        """The mention linked to (None for none) and the label."""
        if self.strategy == "backwards" and self.limit is not None:
            stale = sum(s < seq - self.limit for s in self.seqs)
            for part in (self.seqs, self.vectors, self.labels, self.used):
                del part[:stale]
        scores = np.array([v @ vector for v in self.vectors])
        linked = np.flatnonzero(scores > self.threshold)
        own = float(vector @ vector) > self.threshold
        for k in linked:
            self.used[k] = self.step
        latest = int(linked[-1]) if len(linked) else None
        out = (self.seqs[latest], self.labels[latest]) if latest is not None else (None, seq)
        if self.strategy != "backwards" and self.limit is not None and len(self.seqs) + 1 >= self.limit and self.seqs:
            similar = self.strategy == "diversity" or self.strategy == "diversity_cache" and len(linked)
            victim = int(scores.argmax()) if similar else int(np.argmin(self.used))
            for part in (self.seqs, self.vectors, self.labels, self.used):
                del part[victim]
        self.seqs.append(seq)
        self.vectors.append(vector)
        self.labels.append(out[1])
        self.used.append(self.step if own else NEVER)
        self.step += 1
        return out


def link(df: DataFrame, strategy: str, threshold: float, limit: int | None = None, seq: str = "seq", vector: str = "embedding", block: str | None = None) -> DataFrame:
    """block, seq, link_to, cluster_id. A block is one stream, worked through in order by one task; without a block column all rows are one stream. Rows with a null vector take no part."""
    own = df.filter(F.col(vector).isNotNull()).select((F.col(block) if block else F.lit(0)).cast("string").alias("block"), F.col(seq).alias("seq"), F.transform(vector, lambda x: x.cast("double")).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        linker = Linker(strategy, threshold, limit)
        pdf = pdf.sort_values("seq")
        got = [linker.arrive(int(s), np.asarray(v)) for s, v in zip(pdf["seq"], pdf["v"], strict=True)]
        return pd.DataFrame({"block": pdf["block"], "seq": pdf["seq"], "link_to": pd.array([a for a, _ in got], dtype="Int64"), "cluster_id": [b for _, b in got]})

    return own.groupBy("block").applyInPandas(run, "block string, seq long, link_to long, cluster_id long")


def link_stream(stream: DataFrame, strategy: str, threshold: float, limit: int, seq: str = "seq", vector: str = "embedding", block: str = "block") -> DataFrame:
    """The same over a stream, with the kernel's active mentions as state; rows are sorted by seq within each micro-batch, those with a null vector are left out."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    own = stream.filter(F.col(vector).isNotNull()).select(F.col(block).cast("string").alias("block"), F.col(seq).alias("seq"), F.transform(vector, lambda x: x.cast("double")).alias("v"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        linker = Linker(strategy, threshold, limit)
        if state.exists:
            seqs, flat, labels, used, step = state.get
            linker.seqs, linker.labels, linker.used, linker.step = list(seqs), list(labels), list(used), step
            linker.vectors = list(np.array(flat).reshape(len(seqs), -1)) if seqs else []
        pdf = pd.concat(list(parts)).sort_values("seq")
        got = [linker.arrive(int(s), np.asarray(v)) for s, v in zip(pdf["seq"], pdf["v"], strict=True)]
        state.update((linker.seqs, [float(x) for v in linker.vectors for x in v], linker.labels, linker.used, linker.step))
        yield pd.DataFrame({"block": key[0], "seq": pdf["seq"], "link_to": pd.array([a for a, _ in got], dtype="Int64"), "cluster_id": [b for _, b in got]})

    state = "seqs array<bigint>, vectors array<double>, labels array<bigint>, used array<bigint>, step bigint"
    return own.groupBy("block").applyInPandasWithState(run, "block string, seq long, link_to long, cluster_id long", state, "append", GroupStateTimeout.NoTimeout)
