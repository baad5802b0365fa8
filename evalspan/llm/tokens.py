"""Encoding of a whole corpus with a byte-level BPE of a public tokenizer.

A text is split into pre-tokens by the tokenizer's pattern; a pre-token that is a token stands for itself, and any
other is merged by rank. The merge queue has one bucket per rank that holds positions in a linked list of parts; a
three-level bitmap over the ranks finds the lowest one in use by find-first-set, and entries whose parts have changed
since are skipped. A merge costs the same however long the pre-token is, so a line of a million letters is no special
case. Results are kept per worker for pre-tokens met again.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary lies; a parameter of every function here. The driver reads it and sends it to the workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers, and the longest that it remembers, in characters.
REMEMBERED, LONGEST = 300_000, 200


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the lowest rank."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        heappush(bucket, at)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = a << 6 | (m & -m).bit_length() - 1
        w = self.low[b]
        rank = b << 6 | (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            self.low[b] &= w - 1
            if not self.low[b]:
                self.mid[a] &= m - 1
                if not self.mid[a]:
                    self.top &= self.top - 1
        return rank, at


class Encoder(dict):
    """Maps a pre-token to its ids; ``encode`` maps a text."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.split = regex.compile(pattern).findall

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token by merging the pair of lowest rank, the leftmost first, until none is left."""
        get, queue, n = self.ranks.get, self.queue, len(piece)
        whole = get(piece)
        if whole is not None:
            return (whole,)
        end = list(range(1, n + 1))  # of the part that begins here; 0 where none begins any more
        before = list(range(-1, n - 1))
        push = queue.push
        pairs: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]
        pairs.append(None)
        for i, rank in enumerate(pairs):
            if rank is not None:
                push(rank, i)
        while (found := queue.pop()) is not None:
            rank, i = found
            if not end[i] or pairs[i] != rank:
                continue  # stale: one of its parts has changed since
            j = end[i]
            k = end[j]
            end[j], end[i] = 0, k
            if k < n:
                before[k] = i
                pairs[i] = r = get(piece[i : end[k]])
                if r is not None:
                    push(r, i)
            else:
                pairs[i] = None
            if i:
                h = before[i]
                pairs[h] = r = get(piece[h:k])
                if r is not None:
                    push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(ids)

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.merge(word.encode("utf-8", "replace"))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty list for an empty or null text. Special tokens' strings are ordinary text."""
        if not text:
            return []
        return list(itertools.chain.from_iterable(map(self.__getitem__, self.split(text))))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary.id_ not in _ENCODERS:
        _ENCODERS[vocabulary.id_] = Encoder(vocabulary.handle.value)
    return _ENCODERS[vocabulary.id_]


class _Shared:
    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.handle = spark.sparkContext.broadcast(data)
        self.id_ = hashlib.sha256(data).hexdigest()


def encode(df: DataFrame, text: str, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """All other columns of ``df`` and the ids of its texts in place of the text column.

    Null, empty and very long texts have a defined result (see ``Encoder.encode``); an empty table stays empty.
    """
    shared = _Shared(df.sparkSession, vocabulary)
    keep = [f for f in df.schema.fields if f.name != text]
    out = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            flat, ends = [], [0]
            for value in batch.column(text):
                flat.extend(encoder.encode(value.as_py()))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, "int32")))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), lists], [f.name for f in out])

    return df.select(*[f.name for f in keep], text).mapInArrow(run, out)


def count_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY, tokens: str = "tokens") -> DataFrame:
    """Like ``encode`` with the number of ids only."""
    shared = _Shared(df.sparkSession, vocabulary)
    keep = [f for f in df.schema.fields if f.name != text]
    out = T.StructType([*keep, T.StructField(tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            sizes = []
            for value in batch.column(text):
                found = encoder.split(value.as_py() or "")
                sizes.append(sum(map(len, map(encoder.__getitem__, found))))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(sizes, pa.int64())], [f.name for f in out])

    return df.select(*[f.name for f in keep], text).mapInArrow(run, out)
