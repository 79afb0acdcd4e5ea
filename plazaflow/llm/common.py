"""Helpers that the corpus operators share: tables, checkpoints, Arrow batches as bytes, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plazaflow.plans.storage import folder as shared_folder  # noqa: F401
from plazaflow.plans.storage import kept as cut
from plazaflow.plans.storage import remove  # noqa: F401

#: Odd multipliers of the polynomial and mixing hashes below.
BASE = 0x9FB21C651E98DF25
MIX = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no frame has such a column in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[Column], name: str, key: str | None = None, size: str | None = None) -> DataFrame:
    """df with each row's place, from 0, in an order: among all rows, or those of its key (null is a key too), and, if `size`
    names a column, with how many these are.

    Rows are dealt out by ranges of (key, order), sorted and numbered there; only sizes of (range, key) meet, so neither a
    key nor the whole is ever gathered. The row's place in df's own partitions is the last part of the order, so that rows
    alike in all else are divided too. What is numbered is written, as ranges must not differ between uses; df must be such
    a written table itself, as it is read twice.
    """
    tie, at, part, first, before = (unused(n, df) for n in ("_tie", "_at", "_part", "_first", "_before"))
    by = ([F.col(key)] if key else []) + order + [F.col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn(part, F.shiftright(at, 33)).drop(tie))
    groups = [key] if key else []
    sizes = dealt.groupBy(part, *groups).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    own, total = unused("_own", df), size or unused("_size", df)
    sizes = sizes.withColumns({total: F.sum(before).over(Window.partitionBy(*groups)), before: F.coalesce(F.sum(before).over(earlier), F.lit(0))})
    sizes = sizes.select(F.col(part).alias(own), first, before, total, *(F.col(g).alias(own + g) for g in groups))
    same = F.col(part) == F.col(own)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(own + g))
    placed = dealt.join(F.broadcast(sizes) if not key else sizes, same)
    return placed.select(*df.columns, (F.col(at) - F.col(first) + F.col(before)).alias(name), *([size] if size else []))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where labels may not be learned from: crc32 of the id's digits leaves 1 modulo 3; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column in one array, and where each row starts (one more entry than rows)."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def batches(source: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts hold about `most` bytes; a longer text is a slice of its own."""
    for batch in source:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


def power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: What each byte value stands for in polynomial hashes.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of `width` 64-bit values, by doubling: as many array operations as bits in width."""
    with np.errstate(over="ignore"):
        done, length, part, n = None, 0, values, 1
        while True:
            if width & n:
                done = part if done is None else done[: max(0, len(done) - n)] * power(BASE, n) + part[length:][: max(0, len(done) - n)]
                length += n
            n *= 2
            if n > width:
                return done[: max(0, len(values) - width + 1)]
            half = n // 2
            part = part[: max(0, len(part) - half)] * power(BASE, half) + part[half:]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of `width` entries."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the i and its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        found = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * power(base, len(p))])
            found.append(p[:n])
    return found[0], found[1]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range, by one running sum whatever the ranges' lengths; equal bytes have equal hashes."""
    up, down = _powers(1 << max(16, int(len(data) + 1).bit_length()))
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(BYTE[data] * up[: len(data)])]
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
