"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are cut at safe boundaries first: before a space that stands between two non-space characters, where every
match of the pattern must end. Where each space of a text is such a place, its words are encoded on their own and
their ids remembered, up to MEMO words. Other long texts are cut into chunks there; a stretch without such a place
(one huge word, a run of white space) is cut into the pattern's matches, and a huge match is merged with a heap, in
n log n steps.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Words (and characters of a word) that an encoder remembers, twice: the latest, and those before.
MEMO, MEMO_CHARS = 200_000, 64
#: Characters from which on a text is cut, without a safe place the pattern is applied outside tiktoken, and bytes from which a match is merged by heap.
CHUNK, LOOSE, LONG_MATCH = 1 << 15, 1 << 17, 1 << 11
_ENCODERS: dict[tuple[int, str], ByteBpe] = {}


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


class ByteBpe:
    """blob: the bytes of a rank file."""

    def __init__(self, blob: bytes, pattern: str):
        import tiktoken

        self.ranks = read_ranks(blob)
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def cached(cls, blob: bytes, pattern: str) -> ByteBpe:
        key = (hash(blob), pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(blob, pattern)
        return _ENCODERS[key]

    def chunks(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > CHUNK:
            found = SAFE.search(text, start + CHUNK)
            end = found.start() if found else len(text)
            yield text[start:end]
            start = end
        yield text[start:]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, *words = text.split(" ")
        found = list(map(self.memo.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    x = self._word(words[i])
                    if x is None:  # a space that is no safe place
                        return self.ids(text).astype("<u4").tobytes()
                    found[i] = x
        if first[-1:].isspace() or not first and words:
            return self.ids(text).astype("<u4").tobytes()
        return self.ids(first).astype("<u4").tobytes() + b"".join(found)

    def _word(self, word: str) -> bytes | None:
        """The ids of a space and the word; None if the word is empty or has white space at an end."""
        made = self.before.get(word)
        if made is None:
            if not word or word[0].isspace() or word[-1].isspace():
                return None
            if len(word) > MEMO_CHARS:
                return self.ids(f" {word}").astype("<u4").tobytes()
            made = array("I", self.encoding._core_bpe.encode_ordinary(f" {word}")).tobytes()
        if len(self.memo) >= MEMO:
            self.memo, self.before = {}, self.memo
        self.memo[word] = made
        return made

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= CHUNK:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([self._loose(x) if len(x) > LOOSE else self.encoding.encode_to_numpy(x, disallowed_special=()) for x in self.chunks(text)]).astype(np.uint32)

    def _loose(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for match in self.pattern.finditer(text):
            raw = match[0].encode()
            ids += self.merge(raw) if len(raw) > LONG_MATCH else self.encoding._core_bpe.encode_single_piece(raw)
        return np.array(ids, np.uint32)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one match: the pair of lowest rank merges first, the leftmost among equals."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        n, ranks = len(raw), self.ranks
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != k:
                continue
            end[i], alive[j] = k, 0
            if k < n:
                back[k] = i
                if (r := ranks.get(raw[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (p := back[i]) >= 0 and (r := ranks.get(raw[p:k])) is not None:
                heapq.heappush(heap, (r, p, i, k))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[raw[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _mapped(df: DataFrame, column: str, out: str, make) -> DataFrame:
    """df with a binary column out, made of a column; a column of that name is replaced."""
    kept = df.drop(out) if out != column else df
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])
    at, shape = kept.columns.index(column), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = pa.array([convert(x.as_py()) for x in part.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*shape, out])

    return kept.mapInArrow(run, schema)


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ids: the text's token ids as little-endian unsigned 32-bit integers, in a binary column.

    A null text counts as an empty one, which has no ids. Rows stay as they are otherwise, repeated ones too; a column
    named like ids is replaced. rank_file is read by the driver alone and sent to the executors (under 2 MB).
    """
    with open(rank_file, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        own = ByteBpe.cached(blob.value, pattern)
        return lambda x: own.encode(x or "")

    return _mapped(df, text, ids, make)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds decoded: the raw bytes that the ids stand for, valid UTF-8 or not. Null ids give empty bytes; an unknown id is an error."""
    with open(rank_file, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        own = ByteBpe.cached(blob.value, pattern)
        return lambda x: own.decode(np.frombuffer(x or b"", "<u4"))

    return _mapped(df, ids, decoded, make)


def op3(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    coded = encode(documents.select("doc_id", "text"), rank_file, pattern).drop("text")
    hashed = coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(hashed, rank_file, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
