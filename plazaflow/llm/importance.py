"""Importance resampling towards a target distribution, over hashed word features, in two Arrow passes.

A text's features are its runs of ORDER or fewer words, each hashed into one of BUCKETS buckets. The first pass counts the
features of every partition with np.bincount, one vector of BUCKETS numbers each; treeReduce merges the vectors, so neither
the driver nor a task meets more than a few of them at once. What the target's texts hold more often than the corpus gains,
the rest loses: a bucket's gain is the smoothed logarithm of the two shares, in thousandths. The second pass sends the gains
to every executor (8 bytes a bucket) and sums them by document with np.bincount's weights. Scores add Gumbel noise drawn from
the document's id, so that the highest scores are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plazaflow.llm.common import batches, cut, numbered, utf8

#: Buckets of features; words in the longest feature; least words of a document that may be drawn; percent of those to draw.
BUCKETS, ORDER, LEAST, PERCENT = 10_000, 1, 20, 10
#: What the noise of an id is drawn from, beside the id.
SEED = "2024"
#: Bytes of text that are looked at together, and features longer than this, which are hashed one by one.
SLICE, WIDE = 1 << 20, 40


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC32 of many byte ranges, byte by byte for all of them at once; those longer than WIDE one by one."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(np.minimum(size, WIDE + 1).astype(np.uint8), kind="stable")[::-1]  # longest first
    at, left = start[order], size[order]
    wide = int(np.count_nonzero(left > WIDE))
    for k in order[:wide]:
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]])
    order, at, left = order[wide:], at[wide:], left[wide:]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    n = len(order)
    for k in range(int(left[0]) if n else 0):
        n = np.searchsorted(-left[:n], -k, "left")  # those with a byte k
        now = state[:n]
        state[:n] = CRC[(now ^ data[at[:n] + k]) & 255] ^ (now >> np.uint32(8))
    out[order] = ~state
    return out


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case, and row, start and size of every word: digits, letters and all beyond ASCII."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    inside = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True  # words don't run from one text into the next
    begins = inside & edge[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & edge[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(start, starts)))
    return low, row, start, end - start


def joined(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, one space after each, and where each starts: runs of words are then ranges of bytes."""
    first = np.r_[0, np.cumsum(size + 1)]
    out = np.full(int(first[-1]), 32, np.uint8)
    if len(start):
        place = np.arange(int(size.sum())) + np.repeat(np.arange(len(start)), size)
        out[place] = low[np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))]
    return out, first


def features(column: pa.Array, buckets: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of a batch of texts, repeats included, and each row's number of words."""
    raw, starts = utf8(column)
    low, row, start, size = words(raw, starts)
    n_words = np.bincount(row, minlength=len(starts) - 1)
    rows, found = [row], [crc32s(low, start, size) % np.uint32(buckets)]
    if order > 1:
        low, first = joined(low, start, size)
        for n in range(2, order + 1):
            at = np.flatnonzero(row[n - 1 :] == row[: max(0, len(row) - n + 1)])
            rows.append(row[at])
            found.append(crc32s(low, first[at], first[at + n] - 1 - first[at]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), n_words


def counts(df: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of all texts fall in each bucket. Null texts hold none."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches(source, "text", SLICE):
            total += np.bincount(features(batch.column("text"), buckets, order)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = df.select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    partitions = vectors.getNumPartitions()
    if not partitions:
        return np.zeros(buckets, np.int64)
    depth = 2
    while 50**depth < partitions:  # so that some fifty vectors meet in a task, and in the driver
        depth += 1
    return vectors.treeReduce(lambda a, b: a + b, depth)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths: log of the target's smoothed share over the corpus's, rounded down."""
    buckets = len(corpus)
    return np.floor(1000 * np.log((target + 1) * float(corpus.sum() + buckets) / ((corpus + 1) * float(target.sum() + buckets))))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id's digits (none for a null id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER, seed: str = SEED, whole: bool = True) -> DataFrame:
    """docs with n_words, n_features, weight and score (long): whole rows, or doc_id alone.

    Both distributions are counted over all texts of both tables; null and empty texts hold no feature and weigh nothing;
    repeated rows count as often as they stand. Columns of docs with one of these names are replaced.
    """
    won = gains(counts(docs, buckets, order), counts(target, buckets, order))
    sent = docs.sparkSession.sparkContext.broadcast(won)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text", SLICE):
            row, bucket, n_words = features(batch.column("text"), buckets, order)
            n = batch.num_rows
            weight = np.bincount(row, sent.value[bucket], n).astype(np.int64)
            added = [pa.array(x.astype(np.int64)) for x in (n_words, np.bincount(row, minlength=n), weight)]
            held = [batch.column(k) for k in range(batch.num_columns) if whole or batch.schema.names[k] != "text"]
            names = [c for c in batch.schema.names if whole or c != "text"]
            yield pa.RecordBatch.from_arrays(held + added, names + ["n_words", "n_features", "weight"])

    own = {"n_words", "n_features", "weight", "score"}
    base = docs.select(*(c for c in docs.columns if c.lower() not in own)) if whole else docs.select("doc_id", "text")
    kept_fields = [f for f in base.schema.fields if whole or f.name != "text"]
    schema = StructType([*kept_fields, *(StructField(name, LongType()) for name in ("n_words", "n_features", "weight"))])
    return base.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, **how) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: rank numbers the drawn ones from 1, others have none.

    Of the rows with `least` words, `percent` of a hundred (rounded down) are drawn, highest scores first, ties to the
    smaller id (a null id before all); repeated rows are drawn one by one. Ranks come from a sort of ranges over four numbers
    a row, never from one task.
    """
    found = cut(scored(docs, target, whole=False, **how))
    fit = found.where(F.col("n_words") >= least)
    most = percent * fit.count() // 100
    places = numbered(fit, [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "_place")
    rank = F.when(F.col("_place") < most, F.col("_place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return places.select(*columns, rank.alias("rank")).unionByName(found.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, **how) -> DataFrame:
    """The drawn rows whole, with n_words, n_features, weight and score. Only the last drawn row's score and id reach the
    driver, so texts are not shuffled; rows that share that score and id are drawn together."""
    last = ranked(docs, target, percent, least, **how).where("rank is not null").select("rank", "score", "doc_id").orderBy(F.col("rank").desc()).limit(1).collect()
    rows = scored(docs, target, **how)
    if not last:
        return rows.limit(0)
    at, id_ = last[0].score, last[0].doc_id
    before = F.col("doc_id").isNull() if id_ is None else F.col("doc_id").isNull() | (F.col("doc_id") <= id_)
    return rows.where((F.col("n_words") >= least) & ((F.col("score") > at) | (F.col("score") == at) & before))
