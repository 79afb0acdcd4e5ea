"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints that differ in at most RADIUS bits are found without a miss (Pagh's covering masks): bit i of a fingerprint
gets a non-zero vector m(i) of RADIUS + 1 bits, and table v, for every non-zero v, looks only at the bits with an odd
product m(i) . v. Any RADIUS differing bits span less than the whole space, so some v is orthogonal to all of them, and in
table v the two fingerprints look alike. A table looks at about half of the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import batches, cut, utf8
from plazaflow.llm.graph import components, least_of

RADIUS, SHINGLE, SEED, BITS = 4, 4, 42, 64
#: Larger buckets are not compared as they are: a second family of masks over the bits not yet looked at divides them.
BUCKET = 2048
#: Bytes of text that are looked at together.
SLICE = 2 << 20
#: With so few free bits a mask could look at none of them; a bucket has at most two to their number then.
FEW = 16


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Covering masks over the given bit positions."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << bit for k, bit in enumerate(bits) if ((k % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


ALL_BITS = list(range(BITS))
MASKS = masks(ALL_BITS)


def _words(raw: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all rows, a space after each; where they start and end there; the number of words of each row."""
    rows = len(starts) - 1
    data = np.insert(raw, starts[1:], 32)  # a row's last word ends there
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    row = np.searchsorted(starts[1:] + np.arange(rows), ends, "left")
    data[ends] = 32
    blank[ends] = False
    packed = data[~blank]
    stop = np.flatnonzero(packed == 32)
    return packed.tobytes(), np.r_[0, stop[:-1] + 1] if len(stop) else stop, stop, np.bincount(row, minlength=rows)


def fingerprints(column: pa.Array) -> np.ndarray:
    """Fingerprint of each text: a bit is 1 where more than half of the shingles' XXH64 have it; 0 for no word at all."""
    raw, at = utf8(column)
    packed, start, stop, words = _words(raw, at)
    out = np.zeros(len(words), np.uint64)
    full = words > 0
    if not full.any():
        return out
    words = words[full]
    first = np.r_[0, np.cumsum(words)[:-1]]
    shingles = np.maximum(words - SHINGLE + 1, 1)
    begin = np.r_[0, np.cumsum(shingles)[:-1]]
    head = np.arange(shingles.sum()) - np.repeat(begin - first, shingles)
    tail = head + np.repeat(np.minimum(words, SHINGLE), shingles) - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(packed)
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(start[head].tolist(), stop[tail].tolist())), np.uint64, len(head))
    found = np.zeros(len(words), np.uint64)
    for bit in range(BITS):
        ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), begin).astype(np.int64)
        found |= (2 * ones > shingles).astype(np.uint64) << np.uint64(bit)
    out[full] = found
    return out


def with_fingerprint(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp bigint) of every row, and further bigint columns; a null text counts as empty."""
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *more, "text")
    names = [c for c in read.columns if c != "text"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text", SLICE):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fingerprints(batch.column("text")).view(np.int64))], [*names, "fp"])

    return read.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "fp"]))


def _forest(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what is within the radius, at most one fewer than fingerprints: a breadth-first search."""
    rest, queue = np.arange(1, len(fp)), [0]
    while queue or len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        i = queue.pop()
        near = np.bitwise_count(fp[rest] ^ fp[i]) <= radius
        if near.any():
            for j in (hits := rest[near]):
                yield i, j
            queue += hits.tolist()
            rest = rest[~near]


def bucket_links(fp: np.ndarray, free: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links that connect a bucket's distinct fingerprints, which agree in all bits but the free ones."""
    if len(fp) <= BUCKET or len(free) <= FEW:
        yield from _forest(fp, radius)
        return
    for mask in masks(free, radius):
        left = [bit for bit in free if not mask >> bit & 1]
        for group in _groups(fp & np.uint64(mask)):
            yield from ((group[i], group[j]) for i, j in bucket_links(fp[group], left, radius))


def _groups(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of each key that occurs more than once."""
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1], True])
    for k in np.flatnonzero(np.diff(edge) > 1):
        yield order[edge[k] : edge[k + 1]]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of fingerprints within RADIUS, enough of them to connect all that links connect. `distinct` has fp, once each.

    Every fingerprint goes to one bucket a table, by the bits that the table looks at: 31 rows of 17 bytes each. Exact
    copies share a fingerprint, so a bucket grows with different near copies only; large ones are divided again.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("at").to_numpy(), b.column("fp").to_numpy()) for b in source]
        if not parts:
            return
        at, fp = (np.concatenate(x) for x in zip(*parts))
        fp = fp.view(np.uint64)
        looked = np.array(MASKS, np.uint64)[at]
        pairs: list[tuple[int, int]] = []
        for v in range(len(MASKS)):
            own = np.flatnonzero(at == v)
            free = [bit for bit in ALL_BITS if not MASKS[v] >> bit & 1]
            for group in _groups(fp[own] & looked[own]):
                group = own[group]
                pairs += [(group[i], group[j]) for i, j in bucket_links(fp[group], free)]
        if pairs:
            i, j = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[i], fp[j]).view(np.int64)), pa.array(np.maximum(fp[i], fp[j]).view(np.int64))], ["a", "b"])

    signed = [m - (1 << BITS) if m >> BITS - 1 else m for m in MASKS]
    tables = F.array(*(F.struct(F.lit(v).cast("tinyint").alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(signed)))
    rows = distinct.select("fp", F.explode(tables).alias("t")).select(F.xxhash64("t.at", "t.key").alias("key"), "t.at", "fp")
    return rows.repartition("key").select("at", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def _reached(marked: DataFrame) -> DataFrame:
    """marked (doc_id, fp, ...) with component_id. Rows that share an id are one vertex."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    shared = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    same = marked.join(shared.select("doc_id", "a"), "doc_id").select("a", F.col("fp").alias("b"))
    roots = components(links(distinct.select("fp")).unionByName(same))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return marked.join(least_of(classes, "root", "first", "component_id").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most RADIUS differing bits reach from each document.

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id reaches like any other row, and its own
    component may be null where no row of it has an id. Rows that share an id are one vertex; repeated rows come out as
    they go in. Columns other than doc_id and text are ignored. Links run between distinct fingerprints, so a group of
    copies counts once whatever its size.
    """
    return _reached(cut(with_fingerprint(docs))).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """near_duplicates() with the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs, one row of each group, whole: that with the smallest doc_id (rows without an id only where a group has none),
    of rows that share it the one whose text has the least hash, and of rows that repeat id and text one of them.

    Columns may have any names. docs is shuffled once, by id and text; what is joined is an id and a hash a group.
    """
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_key").alias("t"))
    marked = with_fingerprint(docs, text_key.alias("text_key"))
    keep = _reached(cut(marked)).groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.i").alias("doc_id"), F.col("p.t").alias("text_key")).distinct()
    columns, keys = docs.columns, ["n", "i", "t"]
    at = lambda i, t: [i.isNull().alias("n"), F.coalesce(i, F.lit(0)).alias("i"), t.alias("t")]
    once = docs.select(*at(F.col("doc_id"), text_key), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")).groupBy(*keys).agg(F.first("row").alias("row"))
    return once.join(keep.select(*at(F.col("doc_id"), F.col("text_key"))), keys, "left_semi").select(*(F.col(f"row.`{c}`") for c in columns))
