"""Substring dedup by sliding spans of sentences.

A sentence ends at . ! or ? before white space, or at a line's end. From every sentence a span slides over the following
ones, and to every sentence one over those before: as few as are needed for SENTENCES sentences and WORDS words. So a
repeated passage yields the same spans wherever it stands, up to its last sentence. Spans are hashed (128 bits) and met
globally; a sentence goes if any span that covers it has stood before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import batches, utf8

#: A span has so many sentences and words at least; a sentence of LONG words or more is also a span by itself.
SENTENCES, WORDS, LONG = 2, 12, 30


def split(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Sentences of all rows: row, first byte, byte after the white space that follows, words; and their words with single
    spaces between, with where each sentence starts and ends there. White space before a text's first word belongs to it."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts[:-1]] = True
    ink = ~blank
    word = np.flatnonzero(ink & (np.r_[True, blank[:-1]] | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    stop = np.flatnonzero(ink & (np.r_[blank[1:], True] | edge[1:])) + 1 if len(raw) else word
    row = np.searchsorted(starts, word, "right") - 1
    lines = np.r_[0, np.cumsum(raw == 10)]
    last = raw[stop - 1] if len(stop) else raw[:0]
    if len(word):
        ends = np.r_[True, (row[1:] != row[:-1]) | np.isin(last[:-1], (46, 33, 63)) | (lines[word[1:]] > lines[stop[:-1]])]
    else:
        ends = np.zeros(0, bool)
    first = np.flatnonzero(ends)  # words that start a sentence
    head = word[first].copy()
    opening = np.r_[True, row[first][1:] != row[first][:-1]] if len(first) else ends
    head[opening] = starts[row[first][opening]]
    tail = np.where(np.r_[opening[1:], True], starts[row[first] + 1], np.r_[head[1:], 0]) if len(head) else head
    length = stop - word
    at = np.r_[0, np.cumsum(length + 1)]
    packed = np.full(at[-1], 32, np.uint8)
    packed[np.arange(length.sum()) + np.repeat(np.arange(len(word)), length)] = raw[np.repeat(word - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())] if len(word) else 0
    words = np.diff(np.r_[first, len(word)])
    return row[first], head, tail, words, packed.tobytes(), at[first], at[np.r_[first[1:], len(word)]] - 1 if len(first) else first


def span_ends(row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of each span, each span once."""
    n = len(row)
    if not n:
        return row, row
    total = np.r_[0, np.cumsum(words)]
    i = np.arange(n)
    last = np.maximum(np.searchsorted(total, total[:-1] + WORDS, "left") - 1, i + SENTENCES - 1)
    first = np.minimum(np.searchsorted(total, total[1:] - WORDS, "right") - 1, i - SENTENCES + 1)
    on = last < n
    on[on] = row[last[on]] == row[i[on]]
    back = first >= 0
    back[back] = row[first[back]] == row[i[back]]
    long = np.flatnonzero(words >= LONG)
    code = np.unique(np.r_[i[on] * n + last[on], first[back] * n + i[back], long * n + long])
    return code // n, code % n


def _past_head(fresh: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which rows of sorted runs, told by their first rows, stand at another place than the run's first."""
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return np.logical_or.reduce([x != x[head] for x in place])


#: Spans that a worker holds before it settles which of them have stood before among these.
HELD = 1 << 19
SPANS = "doc_id bigint, text_key bigint, first bigint, n bigint, h1 bigint, h2 bigint, later boolean"


def spans(docs: DataFrame) -> DataFrame:
    """Every span: the document's key, its first sentence's number, its length in sentences, its words' hash, and `later`.

    A worker settles HELD spans at a time: of those with one hash only the first goes on as it is. The others are later ones
    for certain, whatever stands elsewhere; they are marked so and give their documents' number for a hash, those of one
    document that touch as one. So however often a span stands, few rows of it meet.
    """

    def settled(held: list[np.ndarray]) -> pa.RecordBatch:
        doc, key, first, n, h1, h2 = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((first, key, doc, h2, h1))
        doc, key, first, n, h1, h2 = (x[order] for x in (doc, key, first, n, h1, h2))
        fresh = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        d, k, a, e = (x[_past_head(fresh, doc, key, first)] for x in (doc, key, first, first + n))
        order = np.lexsort((e, a, k, d))
        d, k, a, e = (x[order] for x in (d, k, a, e))
        if len(d):  # runs of spans that overlap or touch
            other = np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]
            base = np.cumsum(other) * (int(e.max()) + 1)
            far = np.maximum.accumulate(e + base)
            head = np.flatnonzero(np.r_[True, (a + base)[1:] > far[:-1]])
            end = far[np.r_[head[1:], len(d)] - 1] - base[head]
            d, k, a, e = d[head], k[head], a[head], end
        columns = [np.r_[doc[fresh], d], np.r_[key[fresh], k], np.r_[first[fresh], a], np.r_[n[fresh], e - a], np.r_[h1[fresh], d], np.r_[h2[fresh], k]]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(np.arange(len(columns[0])) >= fresh.sum())], SPANS.replace(" bigint", "").replace(" boolean", "").split(", "))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches(source, "text"):
            row, _, _, words, packed, start, end = split(*utf8(batch.column("text")))
            a, b = span_ends(row, words)
            view, digest = memoryview(packed), xxhash.xxh3_128_digest
            h = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(start[a].tolist(), end[b].tolist())]), np.int64).reshape(-1, 2)
            number = np.arange(len(row)) - np.searchsorted(row, row, "left")
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False)[row[a]].astype(np.int64) for c in ("doc_id", "text_key"))
            held.append((doc, key, number[a], b - a + 1, h[:, 0], h[:, 1]))
            if sum(len(x[0]) for x in held) >= HELD:
                yield settled(held)
        if sum(len(x[0]) for x in held):
            yield settled(held)

    return docs.where("doc_id is not null").mapInArrow(run, SPANS)


def later_ones(spans: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, n) of spans that have stood before: one shuffle by hash, then a pass over sorted rows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # hash and place of the first row of the run that the last batch ended in
        for batch in source:
            if not batch.num_rows:
                continue
            h1, h2, *place = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "text_key", "first"))
            marked = batch.column("later").to_numpy(zero_copy_only=False).astype(bool)
            fresh = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            again = _past_head(fresh, *place)
            if head is not None and head[:2] == (h1[0], h2[0]):
                own = int(np.flatnonzero(np.r_[fresh[1:], True])[0]) + 1
                again[:own] = np.logical_or.reduce([x[:own] != y for x, y in zip(place, head[2:])])
            else:
                own = 0
            k = int(np.flatnonzero(fresh)[-1])
            if k >= own:
                head = (h1[k], h2[k], *(x[k] for x in place))
            yield batch.select(["doc_id", "text_key", "first", "n"]).filter(pa.array(again | marked))

    rows = spans.repartition("h1", "h2").sortWithinPartitions("later", "h1", "h2", "doc_id", "text_key", "first")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, first bigint, n bigint")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, gone array<bigint>): numbers of the sentences that a non-first span covers. docs: keyed()."""
    runs = later_ones(spans(docs)).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    return runs.select("doc_id", "text_key", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))).alias("gone"))


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int, int, int]]:
    """Of each row: what stays, bytes before, bytes gone, runs gone, sentences, sentences gone."""
    raw, starts = utf8(batch.column("text"))
    row, head, tail, *_ = split(raw, starts)
    low, high = np.searchsorted(row, np.arange(batch.num_rows), "left"), np.searchsorted(row, np.arange(batch.num_rows), "right")
    data = raw.tobytes()
    for k, gone in enumerate(batch.column("gone").to_pylist()):
        size, number = int(starts[k + 1] - starts[k]), int(high[k] - low[k])
        if not gone:
            yield data[starts[k] : starts[k + 1]], size, 0, 0, number, 0
            continue
        drop = np.zeros(number, bool)
        drop[gone] = True
        rest = b"".join(data[a:b] for a, b in zip(head[low[k] : high[k]][~drop].tolist(), tail[low[k] : high[k]][~drop].tolist()))
        yield rest, size, size - len(rest), int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum()), number, int(drop.sum())


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, text) without repeated sentences, or with `digest` (doc_id, n_bytes, n_removed, n_spans, n_sentences,
    n_removed_sentences, kept_sha256): one row per row of docs.

    The first span is the one in the smallest doc_id, then by the text's hash, then by place; later ones lose their
    sentences, within one document too. Rows with a null id are left whole and not compared; rows that repeat an id and
    text are one document and come out alike; a null text counts as empty. Other columns are dropped.
    """
    base = keyed(docs)
    gone = removals(base).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    joined = base.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left").select("doc_id", "text", "gone")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            rows = list(_kept(batch))
            ids = batch.column("doc_id").cast(pa.int64())
            if digest:
                numbers = [pa.array(list(c), pa.int64()) for c in list(zip(*rows))[1:]]
                hashes = pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows])
                yield pa.RecordBatch.from_arrays([ids, *numbers, hashes], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_sentences", "n_removed_sentences", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[0].decode() for r in rows])], ["doc_id", "text"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, n_sentences bigint, n_removed_sentences bigint, kept_sha256 string" if digest else "doc_id bigint, text string")
