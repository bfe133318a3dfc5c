"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document of n ids fills n div SIZE sequences by itself; its remainder is packed. The histogram of remainders, in units of UNIT ids
rounded up, is the demand of a cutting-stock problem: a linear program over patterns (sets of lengths that fit one sequence), solved by
column generation with an unbounded-knapsack dynamic program as pricing. Patterns are rounded down, then up where demand
allows; each length's documents are ranked and assigned to the slots of the patterns in order. What rounding leaves, a number
bounded by the number of lengths, is packed best-fit. The histogram has at most SIZE / UNIT rows whatever the input.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, kept, materialize

SIZE, UNIT, END = 2048, 4, 1
#: Parts that each length class is ranked in, at least; rows of all classes for one more part.
SALTS, SALT_ROWS = 32, 10_000_000
#: Words that a worker remembers, twice: the latest, and those before.
MEMO = 150_000
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-įĲ-ɏ]+")


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in own else next(rest) for b in range(256)}


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)


class WordBpe:
    """Ids of a tokenizer file whose pre-tokens never hold white space, word by word with a memory."""

    def __init__(self, blob: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.words: tuple[dict, dict] = ({}, {})
        self.pieces: tuple[dict, dict] = ({}, {})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.words[0].get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self._word(words[i])
        return b"".join(found)

    def _turned(self, which: str) -> tuple[dict, dict]:
        both = {}, getattr(self, which)[0]
        setattr(self, which, both)
        return both

    def _word(self, word: str) -> bytes:
        new, old = self.words
        made = old.get(word) or new.get(word)
        if made is None:
            if word.isascii() and word.isalpha():
                made = self._piece(word.lower())
            else:
                made = self._made(word)
        if len(word) <= 64:
            if len(new) >= MEMO:
                new, old = self._turned("words")
            new[word] = made
        return made

    def _made(self, word: str) -> bytes:
        if not word:
            return b""
        if word.isascii():
            if not word.isprintable() or "<|" in word:
                return self._whole(word)
            return b"".join(map(self._piece, PLAIN.findall(word.lower())))
        if not LATIN.fullmatch(word) or "<|" in word or not unicodedata.is_normalized("NFC", word):
            return self._whole(word)
        low = word.lower()
        return b"".join(map(self._piece, PLAIN.findall(low) if low.isascii() else PIECE.findall(low)))

    def _whole(self, word: str) -> bytes:
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        new, old = self.pieces
        made = new.get(piece)
        if made is not None:
            return made
        made = old.get(piece)
        if made is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin1").translate(self.letters)
            made = _packed([t.id for t in self.tokenize(letters)])
        if len(piece) <= 64:
            if len(new) >= MEMO:
                new, old = self._turned("pieces")
            new[piece] = made
        return made


def _tokenizer(blob: str) -> WordBpe:
    return kept(("words", blob), lambda: WordBpe(blob))


def pieces(df: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """key, tokens, crcs: the number of a text's ids, END included, and the crc32 of each piece of size ids and of the remainder.

    A null text counts as empty. tokenizer_file is read by the driver alone and sent to the executors (2 MB).
    """
    with open(tokenizer_file) as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())
    end, kind = np.array([END], "<u4").tobytes(), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(blob.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                tokens, crcs = [], []
                for x in part.column(1):
                    ids = memoryview(own.encode(x.as_py() or "") + end)
                    tokens.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[at : at + 4 * size]) for at in range(0, len(ids), 4 * size)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], [key, "tokens", "crcs"])
        own.forget()

    return df.select(key, text).mapInArrow(freeing(run, keeps=True), f"`{key}` {kind}, tokens long, crcs array<bigint>")


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of lengths 1..capacity, each used any number of times (values[0] is unused), and how often each is used."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        v = best[c - 1 :: -1][:c] + values[1 : c + 1]
        took[c] = v.argmax() + 1
        best[c] = v[took[c] - 1]
        if best[c - 1] >= best[c]:
            best[c], took[c] = best[c - 1], 0
    uses, c = np.zeros(capacity + 1, int), capacity
    while c > 0:
        if took[c]:
            uses[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return best[capacity], uses


def first_basis(lengths: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """A column for each length: the longest pieces that are left, filled up longest first, as often as they last.

    Each pattern uses a length up, which later ones lack: so the columns are independent, and their uses are the demand's.
    """
    left, columns, open_ = need.copy(), np.zeros((len(lengths), len(lengths))), np.ones(len(lengths), bool)
    for at in range(len(lengths) - 1, -1, -1):
        while open_[at]:
            if left[at] <= 0:  # used up together with another
                columns[at, at], open_[at] = 1, False
                break
            p, room, i = np.zeros(len(lengths)), capacity, at
            while i >= 0 and room >= lengths[0]:
                i = min(i, int(np.searchsorted(lengths, room, "right")) - 1)
                while i >= 0 and not (open_[i] and left[i] > 0):
                    i -= 1
                if i < 0:
                    break
                p[i] = min(room // lengths[i], max(1, np.floor(left[i])))
                room -= int(p[i]) * lengths[i]
                i -= 1
            used = np.flatnonzero(p)
            times = left[used] / p[used]
            end = used[times.argmin()]
            left[used] -= times.min() * p[used]
            left[end], open_[end], columns[:, end] = 0, False, p
    return columns


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination; the matrices are a few hundred wide and mostly triangular."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        at = i + int(np.abs(work[i:, i]).argmax())
        work[[i, at]] = work[[at, i]]
        work[i] /= work[i, i]
        rows = np.flatnonzero(work[:, i])
        rows = rows[rows != i]
        work[rows] -= work[rows, i][:, None] * work[i]
    return work[:, n:].copy()


def generate(demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each. demand[l]: pieces of length l; demand[0] is unused.

    It ends at the optimum, or when the objective is within gap of the best bound that pricing has given. Ties in the ratio test go to the lengths in turn,
    so that it doesn't cycle.
    """
    lengths = np.flatnonzero(demand)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    n = len(lengths)
    need = demand[lengths].astype(float)
    columns = first_basis(lengths, need, capacity)
    inverse = inverted(columns)
    x = np.maximum(inverse @ need, 0)
    bound = 0.0
    for turn in itertools.count():
        duals = inverse.sum(axis=0)
        values = np.zeros(capacity + 1)
        values[lengths] = np.maximum(duals, 0)
        best, uses = knapsack(values, capacity)
        bound = max(bound, float(need @ values[lengths]) / best)
        if best <= 1 + 1e-9 or x.sum() <= (1 + gap) * bound:
            break
        column = uses[lengths].astype(float)
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-10, x / step, np.inf)
        ties = np.flatnonzero(ratio <= ratio.min() * (1 + 1e-12))
        out = int(ties[turn % len(ties)])
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if turn % 200 == 199:
            inverse = inverted(columns)
        x = np.maximum(inverse @ need, 0)
    out = []
    for j in np.flatnonzero(x > 1e-9):
        full = np.zeros(capacity + 1, int)
        full[lengths] = np.rint(columns[:, j]).astype(int)
        out.append((full, float(x[j])))
    return out


def rounded(demand: np.ndarray, patterns: list[tuple[np.ndarray, float]]) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole uses of the patterns within the demand, and the demand that is left: rounded down, then one more each by largest fraction."""
    left, times = demand.copy(), []
    for p, x in patterns:
        k = int(x + 1e-9)
        used = p > 0
        k = min(k, int((left[used] // p[used]).min()))
        left -= k * p
        times.append(k)
    for j in sorted(range(len(patterns)), key=lambda j: times[j] - patterns[j][1]):
        used = patterns[j][0] > 0
        if (left[used] >= patterns[j][0][used]).all():
            left -= patterns[j][0]
            times[j] += 1
    return [(p, k) for (p, _), k in zip(patterns, times, strict=True) if k], left


def best_fit(lengths: list[int], size: int) -> list[int]:
    """A bin for each length, longest first into the fullest bin that has room."""
    bins: dict[int, list[int]] = {}  # room -> bins
    out, n = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = min((r for r in bins if r >= lengths[i]), default=None)
        if room is None:
            b, room, n = n, size, n + 1
        else:
            b = bins[room].pop()
            if not bins[room]:
                del bins[room]
        out[i] = b
        if room > lengths[i]:
            bins.setdefault(room - lengths[i], []).append(b)
    return out


def pack(df: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    Every text has at least one id (END), so every row has a piece, also null and empty texts and repeated rows. Documents of one length class
    are ranked by key, then by tokens and checksum; rows equal in all have interchangeable places. Ranks are counted in parts of each
    class, the more the more rows, so no class, however common, is ranked in one task, nor are copies of one row. An empty table gives an empty result.
    """
    spark = df.sparkSession
    counted = pieces(df, tokenizer_file, key, text, size)
    rest = F.col("tokens") % size
    parted = counted.select(F.col(key).alias("key"), "tokens", "crcs", rest.cast("int").alias("rest"), F.floor(F.col("tokens") / size).alias("whole"), F.ceil(rest / unit).cast("int").alias("class")).withColumn("draw", F.xxhash64(F.monotonically_increasing_id(), "key"))
    parted = materialize(parted)
    salts = max(SALTS, -(-parted.count() // SALT_ROWS))
    parted = parted.withColumn("salt", F.pmod("draw", F.lit(salts)).cast("int"))
    groups = parted.groupBy("class", "salt").agg(F.count("*").alias("n"), F.sum("whole").alias("w")).orderBy("class", "salt").collect()
    capacity = size // unit
    demand = np.zeros(capacity + 1, np.int64)
    offsets, before = [], 0
    for r in groups:
        offsets.append((r["class"], r["salt"], int(demand[r["class"]]), before))
        demand[r["class"]] += r["n"]
        before += int(r["w"])
    demand[0] = 0
    uses, left = rounded(demand, generate(demand, capacity))
    slots, taken, sequences = [], np.zeros(capacity + 1, np.int64), 0
    for p, k in uses:
        for c in np.flatnonzero(p).tolist():
            slots.append((c, int(taken[c]), int(taken[c] + k * p[c]), sequences, int(p[c])))
            taken[c] += k * p[c]
        sequences += k
    slots += [(c, int(taken[c]), 2**62, -1, 1) for c in range(1, capacity + 1) if left[c]]
    starts = spark.createDataFrame(offsets, "class int, salt int, first long, whole_before long")
    table = spark.createDataFrame(slots, "class int, low long, high long, first_sequence long, each long")
    w = Window.partitionBy("class", "salt").orderBy("key", "tokens", F.col("crcs")[0])
    ranked = (
        parted.withColumn("rank", F.row_number().over(w)).withColumn("wholes", F.coalesce(F.sum("whole").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(starts), ["class", "salt"])
        .select("key", "tokens", "crcs", "rest", "whole", "class", (F.col("first") + F.col("rank") - 1).alias("rank"), (F.col("whole_before") + F.col("wholes")).alias("wholes"))
    )
    ranked = materialize(ranked)
    held = ranked.filter("rest > 0").join(F.broadcast(table), (ranked["class"] == table["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(table["class"])
    loose = held.filter("first_sequence < 0").select("class", "rank", "rest").orderBy("class", "rank").collect()  # what rounding left
    bins = best_fit([r["rest"] for r in loose], size)
    places = spark.createDataFrame([(r["class"], r["rank"], sequences + b) for r, b in zip(loose, bins, strict=True)], "class int, rank long, bin long")
    sequences += max(bins, default=-1) + 1
    seated = held.join(F.broadcast(places), ["class", "rank"], "left").withColumn("sequence_id", F.when(F.col("first_sequence") < 0, F.col("bin")).otherwise(F.col("first_sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("crcs", -1)
    remainders = seated.select("key", (F.col("whole") * size).alias("start"), F.col("rest").cast("long").alias("length"), last.alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum("rest").over(within), F.lit(0)).alias("offset"))
    many = ranked.filter("whole > 0").select("key", "tokens", "wholes", F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int"))).alias("i", "crc"))
    wholes = many.select("key", (F.col("i") * F.lit(size).cast("long")).alias("start"), F.lit(size).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.lit(sequences) + F.col("wholes") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return remainders.unionByName(wholes).withColumnRenamed("key", key)


def op9(documents: DataFrame, tokenizer_file: str) -> DataFrame:
    """The contract's columns: the pieces of every document."""
    return pack(documents.select("doc_id", "text"), tokenizer_file)
