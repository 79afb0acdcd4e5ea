"""Byte-level BPE by a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from plazaflow.llm.common import batches, texts

#: A leaf word has 256 bits, a rank's low byte; Python's integers find the first set bit of one in one operation.
#: A worker keeps at most so many pre-tokens' ids, and only of pre-tokens up to so many characters.
CACHED, CACHED_CHARS = 700_000, 48


class RankQueue:
    """Positions by merge rank. Two levels of bitmaps say which ranks hold any; find-first-set gives the next rank."""

    def __init__(self, ranks: int):
        self.leaves = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        buckets = self.buckets
        if rank in buckets:
            heappush(buckets[rank], position)
        else:
            buckets[rank] = [position]
            k = rank >> 8
            self.leaves[k] |= 1 << (rank & 255)
            self.top |= 1 << k

    def pop(self) -> tuple[int, int]:
        """The least rank that holds positions, and the leftmost of them; not to be called while `top` is 0."""
        top = self.top
        k = (top & -top).bit_length() - 1
        leaf = self.leaves[k]
        rank = (k << 8) + (leaf & -leaf).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.leaves[k] = leaf = leaf & (leaf - 1)
        if not leaf:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Codec:
    """Encodes and decodes by a table of ranks, {bytes: id}; an id is its token's merge rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.find = regex.compile(pattern).findall
        self.cache = _Cache(self)
        self.queue = RankQueue(len(ranks))  # empty again after every pre-token

    def pair(self, a: int, b: int) -> int:
        """Rank of two neighbouring tokens' merger, -1 if there is none."""
        key = a << 20 | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        return self._queue(ids)

    def _queue(self, ids: list[int]) -> list[int]:
        """Linked positions; an entry is stale when its pair is no longer the one that was queued."""
        n, pair, known = len(ids), self.pair, self.pairs.get
        queue = self.queue
        push, pop = queue.push, queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = ids[0]
        for i in range(1, n):
            rank = known(left << 20 | (right := ids[i]))
            if rank is None:
                rank = pair(left, right)
            if rank >= 0:
                push(rank, i - 1)
            left = right
        while queue.top:
            rank, i = pop()
            if (a := ids[i]) < 0 or (j := after[i]) >= n or pair(a, ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := pair(rank, ids[k])) >= 0:
                    push(new, i)
            if (h := before[i]) >= 0 and (new := pair(ids[h], rank)) >= 0:
                push(new, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> array:
        ids = array("I")
        ids.frombytes(b"".join(map(self.cache.__getitem__, self.find(text))))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Cache(dict):
    """Pre-token to its ids as native unsigned 32-bit integers."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.codec.encode_piece(piece.encode())).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and vocabulary; a path that starts with 'files:' was shipped by SparkContext.addFile."""
    path = SparkFiles.get(path[6:]) if path.startswith("files:") else path
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def shipped(spark: SparkSession, path: str) -> str:
    """The driver's file at `path`, as encode() takes it, sent to all executors."""
    spark.sparkContext.addFile(path)
    return "files:" + os.path.basename(path)


def little(ids: array) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    if array("I", [1]).tobytes()[0] != 1:
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """(doc_id, ids array<bigint>, decoded binary), or with `digest` the ids' number and the SHA-256 of either.

    Every match of `pattern` in a whole text is encoded on its own by the ranks in the file at `path`, which every
    executor must be able to open, or which 'files:NAME' fetches from SparkContext.addFile; then the ids are decoded.
    A map without any shuffle: rows come out as they go in, repeated rows and null ids too; a null text counts as empty
    and has no ids. Other columns are dropped, whatever their names.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "doc_id bigint, ids array<bigint>, decoded binary"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches(source, "text"):
            rows = []
            for text in texts(batch.column("text")):
                ids = own.encode(text)
                data = own.decode(ids)
                rows.append((len(ids), sha(little(ids)), sha(data)) if digest else (ids.tolist(), data))
            kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int64()), pa.binary()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
