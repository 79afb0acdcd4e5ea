"""An index over a published feed: bitmaps of the plans that hold three letters, a category, a source.

Plans are numbered, and SIZE of them are a bucket. A posting is a key, a bucket and a bitmap of those of the bucket's plans that
have the key, so no row grows with the feed. A search intersects the postings of all its keys bucket by bucket, reads the
buckets of the feed in which a bit is left, and tests the plans there as a scan does: letters in common are needed, but not
enough. Words of under three letters, zones and days say nothing beforehand. Facets of the whole feed are sums of bits.

A bucket's postings are made in one task: each plan's runs of letters become numbers, once each, and the numbers of a bucket's
plans are sorted. Work is linear in the texts but for that sort; a task holds the runs of SIZE plans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaflow.functions import text
from plazaflow.operators.discover import State, filtered, with_rank

#: Plans in a bucket, at most as many as one of Spark's bitmaps has bits, 32,768.
SIZE = 1 << 12
#: Letters of a run; three code points of 21 bits are a number.
GRAM = 3
POINT = 21
#: Numbers from here on stand for the keys that aren't runs of letters.
OTHER = 1 << 63
#: Stands for a plan without a place in the feed.
NONE = np.iinfo(np.int64).max
#: Buckets named to the scan one by one; more of them are named by their range.
NAMED = 2_000
#: Plans whose texts are Python objects at once, and postings that are made at once.
TOGETHER, MADE = 200, 2048
POSTINGS = "key string, _bucket bigint, bits binary, first bigint"


@dataclass(frozen=True)
class Index:
    """The folders of an index: the feed in order of buckets, and its postings, in each file in order of keys."""

    feed: DataFrame
    postings: DataFrame


def grams(blob: str) -> np.ndarray:
    """All runs of three characters of a text, each once, as numbers."""
    points = np.frombuffer(blob.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(points[:-2] << 2 * POINT | points[1:-1] << POINT | points[2:])


def _named(numbers: np.ndarray, others: list[str]) -> list[str]:
    """Keys of numbers in order: runs of letters, then others."""
    runs = numbers[: np.searchsorted(numbers, np.uint64(OTHER))]
    points = np.stack([runs >> 2 * POINT, runs >> POINT & (1 << POINT) - 1, runs & (1 << POINT) - 1], axis=1)
    letters = points.astype("<u4").tobytes().decode("utf-32-le")
    return [f"text:{letters[i : i + GRAM]}" for i in range(0, len(letters), GRAM)] + [others[int(n) - OTHER] for n in numbers[len(runs) :]]


def _postings(bucket: int, size: int, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """A bucket's postings, in order of keys; size: plans in a bucket."""
    others: dict[str, int] = {}
    numbers, bits, firsts = [], [], np.full(size, NONE)
    for r in rows:
        own = np.array(sorted({OTHER + others.setdefault(k, len(others)) for k in r["keys"]}), np.uint64)
        runs = grams(r["blob"])
        numbers += [runs, own]
        bits.append(np.full(len(runs) + len(own), r["_bit"], np.uint16))
        firsts[r["_bit"]] = NONE if r["_ord"] is None else r["_ord"]
    number, bit = np.concatenate(numbers), np.concatenate(bits)
    order = np.argsort(number, kind="stable")
    number, bit = number[order], bit[order]
    starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, int)
    ends, width, names = np.append(starts[1:], len(number)), -(-size // 8), list(others)
    for k in range(0, len(starts), MADE):
        begin, end = starts[k : k + MADE], ends[k : k + MADE]
        flags, of = np.zeros((len(begin), 8 * width), bool), bit[begin[0] : end[-1]]
        flags[np.repeat(np.arange(len(begin)), end - begin), of] = True
        offsets = np.arange(len(begin) + 1, dtype=np.int32) * np.int32(width)
        packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(flags, axis=1, bitorder="little"))])
        first = np.minimum.reduceat(firsts[of], begin - begin[0])
        columns = [pa.array(_named(number[begin], names), pa.string()), pa.array(np.full(len(begin), bucket)), packed, pa.array(first, mask=first == NONE)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "_bucket", "bits", "first"])


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull()), lambda v: F.concat(F.lit(f"{tag}:"), v))


def keys_of_plans(related: bool) -> Column:
    """A plan's keys but for its runs of letters."""
    sources = F.concat(F.array("fuente"), F.coalesce("fuentes_relacionadas", F.array().cast("array<string>"))) if related else F.array("fuente")
    free = F.when(F.col("is_free"), F.array(F.lit("free"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_distinct(_tagged("any", sources)), _tagged("source", F.array("fuente")), F.array_distinct(_tagged("category", F.col("categories"))), free)


def build(view: DataFrame, folder: str) -> Index:
    """Writes the index of a view (discover.view_events) and opens it. Plans are numbered by id, from a sort of ranges."""
    placed = with_rank(view, [F.col("id")], "_number").withColumn("_number", F.col("_number").cast("bigint") - 1)
    placed = placed.withColumns({"_bucket": F.floor(F.col("_number") / SIZE), "_bit": F.col("_number") % SIZE}).drop("_number")
    placed.sortWithinPartitions("_bucket", "_bit").write.parquet(f"{folder}/feed")  # ranges of the rank, which are ranges of buckets
    feed = view.sparkSession.read.parquet(f"{folder}/feed")
    each = feed.select("_bucket", "_bit", "_ord", keys_of_plans("fuentes_relacionadas" in view.columns).alias("keys"), F.coalesce("search_blob", F.lit("")).alias("blob"))
    size = SIZE

    def run(batches):
        rows = (r for b in batches for at in range(0, b.num_rows, TOGETHER) for r in b.slice(at, TOGETHER).to_pylist())
        for bucket, own in groupby(rows, lambda r: r["_bucket"]):
            yield from _postings(bucket, size, own)

    postings = each.repartition("_bucket").sortWithinPartitions("_bucket", "_bit").mapInArrow(run, POSTINGS)
    postings.repartition("key").sortWithinPartitions("key", "_bucket").write.parquet(f"{folder}/postings")
    return load(view.sparkSession, folder)


def load(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/feed"), spark.read.parquet(f"{folder}/postings"))


def keys_of_search(state: State) -> list[str]:
    """Keys that every plan of a search has. Few: a query's length bounds them."""
    words = [w for w in _folded(state.query).split() if len(w) >= GRAM]
    found = [f"text:{w[i : i + GRAM]}" for w in words for i in range(len(w) - GRAM + 1)]
    found += [f"any:{state.source}"] * bool(state.source) + [f"category:{state.category}"] * bool(state.category) + ["free"] * bool(state.free_only)
    return list(dict.fromkeys(found))


def _folded(query: str) -> str:
    """fold_search() of a reader's words, in the driver."""
    table = str.maketrans(text.MARKED + text.MARKED.upper(), text.PLAIN + text.PLAIN.upper())
    return query.lower().translate(table)


def candidates(index: Index, keys: list[str]) -> DataFrame:
    """(_bucket, bits) of the plans that have all keys, where there are any."""
    met = index.postings.where(F.col("key").isin(*keys)).groupBy("_bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    own = met.withColumn("bits", F.substring("bits", 1, -(-SIZE // 8)))  # Spark's bitmaps are longer than a bucket's
    return own.where((F.col("n") == len(keys)) & (F.bitmap_count("bits") > 0)).select("_bucket", "bits")


def matching(index: Index, state: State) -> DataFrame:
    """discover.filtered() of the feed, read through the index: the same rows."""
    keys = keys_of_search(state)
    if not keys:
        return filtered(index.feed, state).drop("_bucket", "_bit")
    left = candidates(index, keys)
    named = [r[0] for r in left.select("_bucket").limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        part = index.feed.where(F.col("_bucket").isin(*named) if named else F.lit(False))
    else:
        low, high = left.agg(F.min("_bucket"), F.max("_bucket")).first()
        part = index.feed.where(F.col("_bucket").between(low, high))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)) % 2 == 1
    return filtered(part.join(left, "_bucket").where(bit), state).drop("_bucket", "_bit", "bits")


def facets(index: Index) -> DataFrame:
    """discover.facets() of the whole feed, from postings alone."""
    tag, value = F.substring_index("key", ":", 1), F.expr("substring(key, locate(':', key) + 1)")
    found = index.postings.where(F.startswith("key", F.lit("category:")) | F.startswith("key", F.lit("source:")))
    return found.groupBy(tag.alias("facet"), value.alias("value")).agg(F.sum(F.bitmap_count("bits")).alias("n"), F.min("first").alias("first"))
