"""Language identification by cross-parsing entropy.

A suffix automaton of each language's reference text yields longest matches: a text is parsed greedily into phrases,
each the longest stretch that occurs in the reference. The language needing the fewest phrases wins, after
normalisation by reference size and text length: phrases * log2(reference) / characters.

Texts are lower-cased; what is no letter becomes one space, and a space stands at either end. They are parsed whole, in blocks of BLOCK characters, so
that numpy advances thousands of blocks by one character at once. A block is parsed as if a phrase began there; then the parse that really comes from the
block before is followed until both are in one state, from where on they are the same. So phrases span blocks, and counts are those of one parse.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, held_out, kept, learns, parts, with_row

BLOCK, LOCKSTEP = 1024, 4096
SPACE, OTHER = 0, 1


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def normalise(text: str) -> str:
    """Lower case, each run of characters that are no letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return step


class Parser:
    """references: a normalised text per language."""

    def __init__(self, references: dict[str, str]):
        self.names = sorted(references)
        alphabet = sorted(set("".join(references.values())) - {" "})
        self.width = len(alphabet) + 2
        self.code = np.where(_letters(), OTHER, SPACE).astype(np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(2, self.width)
        tables, starts, base = [], [], 0
        for name in self.names:
            steps = suffix_automaton(self.code[code_points(f" {references[name]} ")])
            # Where a state has no such step, the phrase ends (lowest bit) and the next begins with this character. A character that
            # the reference lacks is a phrase of its own: its state, the last one, has no step at all.
            dead = len(steps)
            root = np.full(self.width, ((base + dead) << 1) | 1, np.int64)
            for c, to in steps[0].items():
                root[c] = ((base + to) << 1) | 1
            grid = np.tile(root, (dead + 1, 1))
            grid[0] = root & ~1
            for i, step in enumerate(steps):
                for c, to in step.items():
                    grid[i, c] = (base + to) << 1
            tables.append(grid)
            starts.append(base)
            base += dead + 1
        self.steps = np.concatenate(tables).ravel().astype(np.int32) if tables else np.zeros(0, np.int32)
        self.starts = np.array(starts, np.int32)
        self.bits = np.log2([max(2, len(references[n])) for n in self.names])

    def coded(self, text: str) -> np.ndarray:
        codes = self.code[code_points(text.lower())]
        codes = np.concatenate([[SPACE], codes, [SPACE]])
        gap = codes == SPACE
        return codes[~(gap & np.concatenate([[False], gap[:-1]]))]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases for each coded text and language."""
        cuts = [(i, at) for i, x in enumerate(texts) for at in range(0, len(x), BLOCK)]
        text, sizes = np.array([i for i, _ in cuts]), np.array([min(BLOCK, len(texts[i]) - at) for i, at in cuts])
        inner = np.array([at > 0 for _, at in cuts])
        count, ends = np.zeros((len(cuts), len(self.names)), np.int64), np.zeros((len(cuts), len(self.names)), np.int32)
        assumed = np.tile(self.starts, (len(cuts), 1))
        for rows in self._parts(sizes, np.arange(len(cuts))):
            grid = self._grid(texts, cuts, rows, sizes)
            state, n = self._run(grid, sizes[rows], assumed[rows].T.copy())
            count[rows], ends[rows] = n.T, state.T
        while True:
            real = assumed.copy()
            real[1:][inner[1:]] = ends[:-1][inner[1:]]
            wrong = np.flatnonzero((real != assumed).any(1))
            if not wrong.size:
                break
            for rows in self._parts(sizes, wrong):
                grid = self._grid(texts, cuts, rows, sizes)
                more, last, met = self._follow(grid, sizes[rows], assumed[rows].T.copy(), real[rows].T.copy())
                count[rows] += more.T
                ends[rows] = np.where(met.T, ends[rows], last.T)
            assumed = real
        out = np.ones((len(texts), len(self.names)), np.int64)
        np.add.at(out, text, count)
        return out

    @staticmethod
    def _parts(sizes: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of LOCKSTEP blocks, longest first."""
        for first in range(0, len(rows), LOCKSTEP):
            part = rows[first : first + LOCKSTEP]
            yield part[np.argsort(-sizes[part], kind="stable")]

    @staticmethod
    def _grid(texts: list[np.ndarray], cuts: list[tuple[int, int]], rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row for each character of the blocks, a column for each block."""
        grid = np.zeros((len(rows), sizes[rows[0]]), np.int32)
        for k, r in enumerate(rows.tolist()):
            i, at = cuts[r]
            grid[k, : sizes[r]] = texts[i][at : at + BLOCK]
        return np.ascontiguousarray(grid.T)

    def _run(self, grid: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the blocks, and how many phrases ended in them."""
        ends = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        for t in range(sizes[0]):
            n = active[t]
            got = self.steps.take(state[:, :n] * self.width + grid[t, :n])
            ends[:, :n] += got & 1
            state[:, :n] = got >> 1
        return state, ends

    def _follow(self, grid: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many phrases more end from states b than from a until both meet, the last states from b, and whether they met."""
        lanes = np.flatnonzero((a != b).ravel())
        blocks = lanes % a.shape[1]
        more, last, met = np.zeros(a.size, np.int64), b.ravel().copy(), (a == b).ravel()
        x, y = a.ravel()[lanes].copy(), last[lanes].copy()
        for t in range(sizes[0]):
            if not lanes.size:
                break
            c = grid[t, blocks]
            x, y = self.steps.take(x * self.width + c), self.steps.take(y * self.width + c)
            more[lanes] += (y & 1) - (x & 1)
            x, y = x >> 1, y >> 1
            last[lanes] = y
            met[lanes] = x == y
            go = (x != y) & (sizes[blocks] > t + 1)
            lanes, blocks, x, y = lanes[go], blocks[go], x[go], y[go]
        return more.reshape(a.shape), last.reshape(a.shape), met.reshape(a.shape)

    def costs(self, texts: list[np.ndarray]) -> np.ndarray:
        size = np.array([max(1, len(x)) for x in texts])
        return self.phrases(texts) * self.bits / size[:, None]


def references(documents: DataFrame, key: str, text: str, lang: str, rows: int, chars: int) -> dict[str, str]:
    """A normalised reference text for each language, of whole documents.

    They are taken from at most rows documents per language: among those of at most chars characters the key with the least hash in each of rows hash
    buckets, so no group of documents meets in one task. In the order of these hashes, documents are taken as long as they fit into chars characters
    together; so the driver gets rows x chars characters a language at most. A language that has longer documents only is learned from the shortest.
    """
    spread = F.xxhash64(F.col(key))
    known = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).withColumn("_n", F.length(text))
    fits = F.col("_n") <= chars
    bucket = F.when(fits, F.pmod(spread, F.lit(rows))).otherwise(-1)
    least = known.groupBy(F.col(lang).alias("l"), bucket.alias("bucket")).agg(F.min(F.when(fits, spread)).alias("h"), F.min(F.struct("_n", spread.alias("h"))).alias("short")).collect()
    if not least:
        return {}
    some = {r["l"] for r in least if r["bucket"] >= 0}
    chosen = [(r["l"], r["h"] if r["bucket"] >= 0 else r["short"]["h"]) for r in least if r["bucket"] >= 0 or r["l"] not in some]
    wanted = documents.sparkSession.createDataFrame(chosen, "l string, h long")
    own = known.filter(fits | ~F.col(lang).isin(*some) if some else F.lit(True)).select(spread.alias("h"), F.col(lang).alias("l"), F.col(text).alias("t"))
    found = own.join(F.broadcast(wanted), ["l", "h"]).groupBy("l", "h").agg(F.min_by("t", F.struct(F.length("t"), F.xxhash64("t"))).alias("t"))
    whole: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for r in sorted(found.collect(), key=lambda r: (r["l"], r["h"])):
        x = normalise(r["t"])
        own, room = whole.setdefault(r["l"], []), left.get(r["l"], chars)
        if x and x not in own and (len(x) <= room or not own):
            own.append(x)
            left[r["l"]] = room - len(x) - 1
    return {name: " ".join(texts) for name, texts in whole.items() if texts}


def identify(df: DataFrame, refs: dict[str, str], key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """key, lang_pred, score, cost, n_letters, phrase_rate of each row.

    A text that is null or has no letter is `und` with score 0; so is every text if no reference was learned. Ties go to
    the language first in alphabetical order. score is the runner-up's cost over the sum of both: 0.5 for a tie, 1 for the only
    language. cost is the winner's: the more the stranger the text. phrase_rate is the winner's phrases a character: 1 for a text of
    unknown characters, over 0.5 where not even pairs of characters are known. Both are null for `und`. One row
    comes out for each row that goes in; with whole its columns come too, as the struct own, else other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(refs)
    given, schema = with_row(df, key, text, "lang_pred string, score double, cost double, n_letters long, phrase_rate double", whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("language", *sorted(shared.value.items())), lambda: Parser(shared.value))
        for batch in batches:
            for texts, before in parts(batch, key, text, whole, 2048):
                codes = [own.coded(x.as_py() or "") for x in texts]
                letters = np.array([int((x != SPACE).sum()) for x in codes], np.int64)
                names, score = np.full(len(codes), "und", object), np.zeros(len(codes))
                cost, rate = np.full(len(codes), np.nan), np.full(len(codes), np.nan)
                some = np.flatnonzero(letters)
                if some.size and own.names:
                    costs = own.costs([codes[i] for i in some])
                    best = costs.argmin(1)
                    names[some] = np.array(own.names, object)[best]
                    rate[some] = costs.min(1) / own.bits[best]
                    ranked = np.sort(costs, axis=1)
                    cost[some] = ranked[:, 0]
                    score[some] = ranked[:, 1] / (ranked[:, 0] + ranked[:, 1]) if len(own.names) > 1 else 1.0
                yield pa.RecordBatch.from_arrays([*before, pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(cost, from_pandas=True), pa.array(letters), pa.array(rate, from_pandas=True)], schema.names)

    return given.mapInArrow(freeing(run, keeps=True), schema)


def learn(documents: DataFrame, rows: int = 64, chars: int = 32_000) -> dict[str, str]:
    """References from the documents that may be learned from: crc32 of doc_id modulo 5 is not 0."""
    return references(documents.filter(learns(F.col("doc_id"))), "doc_id", "text", "lang", rows, chars)


def op1(documents: DataFrame) -> DataFrame:
    """The contract's columns and the cost: a row for each document."""
    found = identify(documents, learn(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cost")
