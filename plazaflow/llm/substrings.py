"""Substring dedup by suffix sorting with difference covers.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Sorting all suffixes
of a corpus would move many times the corpus, and nearly all of them differ from any other early on. So the work goes in
rounds, of which the first two only put aside what cannot repeat:

1. Every string of LENGTH bytes has WINDOW grams of GRAM bytes; the one with the least hash is its anchor, and equal
   strings have equal anchors at equal places. Groups of documents send each anchor's hash, cut to 40 bits and the
   bucket's, once a group, to the hash's bucket; buckets answer with those that stand in two documents or more.
2. Around each such anchor a group cuts the context: the bytes that strings with this anchor can cover. Equal contexts of a
   group are one class, owned by the smallest id. Classes go to the anchor's bucket.
3. A bucket joins classes, takes the contexts of anchors that have more than one class, but for those that no other of their
   anchor agrees with over half a string on either side of it (meeting()), sorts all their suffixes by the
   difference-cover algorithm (suffixes.py: sampled triples, recursion on names, merge) and compares adjacent prefixes of
   LENGTH bytes. A run of equal ones is one string; its first document is the smallest owner in the run. What each
   occurrence loses goes back to its group.

Anchors that stand very often, as at the borders of a passage that many documents share, could have as many contexts in one
bucket: each of their strings is then sent as a context of its own, to a bucket by the string's hash, once a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import BYTE, MIX, mixed, range_hashes, rolling, sliding_min, utf8
from plazaflow.llm.suffixes import equal_runs, suffix_order

#: Bytes of a string and of a gram in it; grams of a string.
LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
#: Bytes of a context that no text's end has cut.
WHOLE = 2 * LENGTH - GRAM
#: Bytes of text in a group of documents and in a bucket, about; fewest of either.
GROUP_BYTES, BUCKET_BYTES, FEWEST = 16 << 20, 12 << 20, 24
#: An anchor that stands more often than this has its strings sent one by one.
HOT = 2048
#: Bytes that are looked at together, and that are sorted together: what is made of them has to fit a core's cache.
SLICE, SORTED = 1 << 16, 1 << 16

HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)


class Group:
    """The rows of one group in a fixed order: by id, then by text. Rows without an id come last and are not compared."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = rows.column("doc_id")
        self.known = len(self.ids) - self.ids.null_count
        self.doc = self.ids.fill_null(0).to_numpy().astype(np.int64)
        column = rows.column("text")
        self.raw, self.starts = utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)

    def slices(self) -> Iterator[tuple[int, int]]:
        """Ranges of rows with an id that hold about SLICE bytes."""
        part = self.starts[1 : self.known + 1] // SLICE
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if self.known else np.zeros(0, np.int64)
        yield from zip(edge[:-1], edge[1:])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and hash of every anchor."""
        found = [self._anchors(a, b) for a, b in self.slices()]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def _anchors(self, a: int, b: int):
        base, starts = self.starts[a], self.starts[a : b + 1] - self.starts[a]
        data = self.raw[base : base + starts[-1]]
        h = mixed(rolling(BYTE[data], GRAM))
        least = sliding_min((h & HIGH) | np.arange(len(h), dtype=np.uint64), WINDOW)
        size = np.diff(starts)
        whole = np.zeros(len(least) + 1, np.int64)  # strings that lie in one row
        fits = size >= LENGTH
        whole[starts[:-1][fits]] += 1
        np.add.at(whole, np.minimum(starts[1:][fits] - LENGTH + 1, len(least)), -1)
        least = least[np.cumsum(whole)[:-1] > 0]
        at = (least[np.r_[True, least[1:] != least[:-1]]] & LOW).astype(np.int64) if len(least) else np.zeros(0, np.int64)
        return np.searchsorted(starts, at, "right") - 1 + a, at + base, mixed(h[at])  # least hashes are small: spread over buckets anew


def _cut(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits after the bucket's, 40 of them."""
    return (h << np.uint64(bits)) >> np.uint64(24)


def _pack5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


@cache
def _packer() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A worker's own: to make them anew for each of many short values takes longer than to use them."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    """Numbers or text, compressed: what moves between stages is mostly these."""
    return _packer()[0].compress(np.ascontiguousarray(x).tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_packer()[1].decompress(data), kind)


def _deltas(x: np.ndarray) -> np.ndarray:
    """Differences, which compress better; np.cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


HASHES = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("hashes", pa.binary()), ("times", pa.binary())])
ANSWER = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("hot", pa.binary())])
CLASSES = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("hash", pa.binary()), ("owner", pa.binary()), ("size", pa.binary()), ("text", pa.binary()), ("klass", pa.binary()), ("of_owner", pa.binary()), ("place", pa.binary())])
LOST = pa.schema([("grp", pa.int64()), ("place", pa.binary()), ("mask", pa.binary())])
DDL = {pa.int64(): "bigint", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def _by_bucket(h: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted hashes."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(h) else np.zeros(0, np.int64)
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(bucket[a]), slice(a, b)


def anchor_hashes(rows: pa.Table, bits: int) -> pa.Table:
    """Round 1, a group: each anchor's cut hash once; times is how often it stands (logarithm), plus 128 if in two documents."""
    if not rows.num_rows:
        return _table([], HASHES)
    group = Group(rows)
    row, _, h = group.anchors()
    order = np.lexsort((row, h))
    h, doc = h[order], group.doc[row[order]]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(h)] - 1
    several = doc[first] != doc[last] if len(h) else np.zeros(0, bool)
    times = (np.ceil(np.log2(last - first + 1)).astype(np.uint8) + 128 * several).astype(np.uint8)
    grp = int(rows.column("grp")[0].as_py())
    return _table([{"bucket": b, "grp": grp, "hashes": _pack5(_cut(h[first][s], bits)), "times": _packed(times[s])} for b, s in _by_bucket(h[first], bits)], HASHES)


def repeated(rows: pa.Table) -> pa.Table:
    """Round 1, a bucket: for each group those of its hashes that stand in two documents or more, and which stand very often."""
    if not rows.num_rows:
        return _table([], ANSWER)
    blobs = [_unpack5(x.as_py()) for x in rows.column("hashes")]
    times = np.concatenate([_unpacked(x.as_py(), np.uint8) for x in rows.column("times")])
    x = np.concatenate(blobs)
    order = np.argsort(x)
    edge = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
    number = np.diff(np.r_[edge, len(x)])
    some = (number > 1) | (np.maximum.reduceat(times[order] >> 7, edge) > 0)
    hot = np.add.reduceat(2.0 ** (times[order] & 127), edge) > HOT
    back_some, back_hot = np.empty(len(x), bool), np.empty(len(x), bool)
    back_some[order], back_hot[order] = np.repeat(some, number), np.repeat(hot, number)
    out, at = [], 0
    for blob, grp, bucket in zip(blobs, rows.column("grp").to_pylist(), rows.column("bucket").to_pylist()):
        own = slice(at, at + len(blob))
        at += len(blob)
        if back_some[own].any():
            good = back_some[own]
            out.append({"grp": grp, "bucket": bucket, "hashes": _pack5(blob[good]), "hot": _packed(back_hot[own][good])})
    return _table(out, ANSWER)


def context_classes(rows: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """Round 2, a group: classes of contexts around anchors that repeat, with every occurrence's place."""
    if not rows.num_rows or not answers.num_rows:
        return _table([], CLASSES)
    group = Group(rows)
    row, at, h = group.anchors()
    known = np.concatenate([np.uint64(b << 40) | _unpack5(x.as_py()) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("hashes"))])
    hot = np.concatenate([_unpacked(x.as_py(), bool) for x in answers.column("hot")])
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    short = h >> np.uint64(24 - bits)
    found = np.minimum(np.searchsorted(known, short), len(known) - 1)
    good = known[found] == short
    row, at, h, hot = row[good], at[good], h[good], hot[found[good]]
    low, high = np.maximum(at - WINDOW + 1, group.starts[row]), np.minimum(at + LENGTH, group.starts[row + 1])
    if hot.any():  # each string by itself
        strings = np.where(hot, high - low - LENGTH + 1, 1)
        place = np.repeat(low, strings) + np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        alone = np.repeat(hot, strings)
        row, h, high = np.repeat(row, strings), np.repeat(h, strings), np.where(alone, place + LENGTH, np.repeat(high, strings))
        low = place
        each = np.unique(np.flatnonzero(alone))
        _, once = np.unique(low[each], return_index=True)  # two anchors may share a string
        keep = ~alone
        keep[each[once]] = True
        row, h, low, high, alone = row[keep], h[keep], low[keep], high[keep], alone[keep]
    else:
        alone = hot
    context = np.empty(len(low), np.uint64)
    part = group.starts[row] // SLICE
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
    for own in map(slice, edge[:-1], edge[1:]):  # sums over a slice at a time: rows ascend
        a, b = low[own].min(), high[own].max()
        context[own] = range_hashes(group.raw[a:b], low[own] - a, high[own] - a)
    h = np.where(alone, mixed(context ^ np.uint64(MIX)), h)
    doc = group.doc[row]
    order = np.lexsort((doc, context, h))
    h, context, doc, low, high = h[order], context[order], doc[order], low[order], high[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (context[1:] != context[:-1])]
    klass = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    owner = doc[head]
    of_owner = doc == owner[klass]
    size = high[head] - low[head]
    grp = int(rows.column("grp")[0].as_py())
    out = []
    for bucket, s in _by_bucket(h[head], bits):
        texts = np.repeat(low[head][s], size[s]) + np.arange(size[s].sum()) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        occ = slice(head[s.start], head[s.stop] if s.stop < len(head) else len(h))
        out.append(
            {
                "bucket": bucket,
                "grp": grp,
                "hash": _packed(_deltas(h[head][s])),
                "owner": _packed(owner[s]),
                "size": _packed(size[s].astype(np.uint8)),
                "text": _packed(group.raw[texts]),
                "klass": _packed(_deltas((klass[occ] - s.start).astype(np.uint32))),
                "of_owner": _packed(of_owner[occ]),
                "place": _packed(low[occ].astype(np.uint32)),
            }
        )
    return _table(out, CLASSES)


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries that hold about `most` bytes."""
    part = np.cumsum(size) // most
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    yield from zip(edge[:-1], edge[1:])


def _masks(owner: np.ndarray, size: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each context the strings (bits by their place) that a context with a smaller owner has too.

    data: all contexts' bytes; a zero is put after each, which no string crosses.
    """
    number = len(owner)
    moved = start + np.arange(number)
    text = np.zeros(int(size.sum()) + number, np.int64)
    inner = np.repeat(moved, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[inner] = data[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)].astype(np.int64) + 2
    text[text == 0] = 1
    order = suffix_order(text, LENGTH, 258)
    of = np.repeat(np.arange(number), size + 1)
    place = np.arange(len(text)) - moved[of]
    order = order[place[order] <= size[of[order]] - LENGTH]
    if not len(order):
        return np.zeros(number, np.uint64)
    run = equal_runs((text - 2).astype(np.uint8), order, LENGTH)
    edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    least = np.minimum.reduceat(owner[of[order]], edge)[run]
    lost = order[least < owner[of[order]]]
    out = np.zeros(number, np.uint64)
    np.bitwise_or.at(out, of[lost], np.uint64(1) << place[lost].astype(np.uint64))
    return out


def meeting(h: np.ndarray, size: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Of classes, sorted by anchor, those that may share a string with another of their anchor.

    Of the WINDOW - 1 bytes that a string has beside its anchor, half at least stand on one side. So a whole context, whose
    anchor is in its middle, is put aside where no other of the anchor has the same bytes there, on either side. Nothing is
    put aside where a context was cut by a text's end: it doesn't say where its anchor is.
    """
    anchor = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
    number = np.bincount(anchor)
    cut = np.zeros(len(number), bool)
    cut[anchor[size < WHOLE]] = True
    some = number[anchor] > 1
    look = np.flatnonzero(some & ~cut[anchor])
    out = some & cut[anchor]
    if not len(look):
        return out
    half = WINDOW // 2
    for low, high in ((WINDOW - 1 - half, WINDOW - 1 + GRAM), (WINDOW - 1, WINDOW - 1 + GRAM + half)):
        side = np.zeros(len(look), np.uint64)
        for a, b in _runs(size[look], SLICE):
            own = start[look[a:b]]
            all_ = data[own[:, None] + np.arange(low, high)].ravel()
            at = np.arange(b - a) * (high - low)
            side[a:b] = range_hashes(all_, at, at + high - low)
        order = np.lexsort((side, anchor[look]))
        of, x = anchor[look][order], side[order]
        same = (of[1:] == of[:-1]) & (x[1:] == x[:-1])
        out[look[order[np.r_[False, same] | np.r_[same, False]]]] = True
    return out


def lost_strings(rows: pa.Table) -> pa.Table:
    """Round 3, a bucket: for each group the places of occurrences that lose strings, and which (bits by their place)."""
    if not rows.num_rows:
        return _table([], LOST)
    get = lambda name, kind: [_unpacked(x.as_py(), kind) for x in rows.column(name)]
    hashes = [np.cumsum(x, dtype=np.uint64) for x in get("hash", np.uint64)]
    h, owner, size = np.concatenate(hashes), np.concatenate(get("owner", np.int64)), np.concatenate(get("size", np.uint8)).astype(np.int64)
    data = np.concatenate(get("text", np.uint8))
    start = np.cumsum(size) - size
    context = np.concatenate([range_hashes(data[start[a] : start[b - 1] + size[b - 1]], start[a:b] - start[a], start[a:b] - start[a] + size[a:b]) for a, b in _runs(size, SLICE)])
    order = np.lexsort((owner, context, h))
    fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (context[order][1:] != context[order][:-1])]
    head = order[np.flatnonzero(fresh)]  # of each class the entry with the smallest owner
    klass = np.empty(len(h), np.int64)
    klass[order] = np.cumsum(fresh) - 1
    mask = np.zeros(len(head), np.uint64)
    many = np.flatnonzero(meeting(h[head], size[head], start[head], data))
    if len(many):
        total = np.cumsum(size[head[many]] + 1)
        ends = np.flatnonzero(np.r_[h[head[many]][1:] != h[head[many]][:-1], True])
        part = (total // SORTED)[ends[np.searchsorted(ends, np.arange(len(many)))]]  # an anchor's classes are sorted together
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for a, b in zip(edge[:-1], edge[1:]):
            own = head[many[a:b]]
            n = size[own]
            at = np.cumsum(n) - n
            mask[many[a:b]] = _masks(owner[own], n, at, data[np.repeat(start[own], n) + np.arange(n.sum()) - np.repeat(at, n)])
    every = (np.uint64(1) << (size - LENGTH + 1).astype(np.uint64)) - np.uint64(1)
    out, base = [], 0
    for grp, own, k, of_owner, place in zip(rows.column("grp").to_pylist(), hashes, get("klass", np.uint32), get("of_owner", bool), get("place", np.uint32)):
        entry = base + np.cumsum(k, dtype=np.uint32).astype(np.int64)
        base += len(own)
        first = of_owner & (owner[entry] == owner[head[klass[entry]]])
        gone = np.where(first, mask[klass[entry]], every[entry])
        if gone.any():
            out.append({"grp": grp, "place": _packed(place[gone > 0]), "mask": _packed(gone[gone > 0])})
    return _table(out, LOST)


def covered(rows: pa.Table, lost: pa.Table) -> tuple[Group, np.ndarray]:
    """The last round, a group: its rows and which of their bytes go."""
    group = Group(rows)
    begins = np.zeros(len(group.raw), bool)
    for place, mask in zip(lost.column("place"), lost.column("mask")):
        place, mask = _unpacked(place.as_py(), np.uint32).astype(np.int64), _unpacked(mask.as_py(), np.uint64)
        for k in range(WINDOW):
            begins[place[(mask >> np.uint64(k)) & np.uint64(1) > 0] + k] = True
    count = np.cumsum(begins, dtype=np.int32)
    gone = count > 0
    gone[LENGTH:] = count[LENGTH:] > count[:-LENGTH]
    return group, gone


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """Rows of one id share a group; rows without an id are spread by their text."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.pmod(key, F.lit(groups)).alias("grp"))


def sized(docs: DataFrame) -> tuple[int, int]:
    """Numbers of groups and of bits of a bucket's number, in proportion to the bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(FEWEST, -(-total // GROUP_BYTES)), min(24, max(FEWEST, -(-total // BUCKET_BYTES)).bit_length())


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, kept binary), or with `digest` (doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per row of docs.

    Texts are UTF-8 bytes, a null text is empty, and matches never cross rows. Strings are judged on the input, not on what
    is left, and only against smaller ids: rows that repeat an id never lose anything to one another. Rows with a null id
    stay whole and take nothing away. Other columns are dropped, whatever their names.
    """
    groups, bits = sized(docs)
    own = grouped(docs, groups)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] if digest else [("doc_id", pa.int64()), ("kept", pa.binary())])

    def first(rows: pa.Table) -> pa.Table:
        return anchor_hashes(rows, bits)

    def second(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        return context_classes(rows, answers, bits)

    def last(key, rows: pa.Table, lost: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], schema)
        group, gone = covered(rows, lost)
        data, out = group.raw, []
        for k, doc in enumerate(group.ids.to_pylist()):
            a, b = group.starts[k], group.starts[k + 1]
            bad = gone[a:b]
            kept = data[a:b][~bad].tobytes()
            if digest:
                out.append({"doc_id": doc, "n_bytes": int(b - a), "n_removed": int(bad.sum()), "n_spans": int(bad[:1].sum()) + int((bad[1:] & ~bad[:-1]).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            else:
                out.append({"doc_id": doc, "kept": kept})
        return _table(out, schema)

    hashes = own.groupBy("grp").applyInArrow(first, _ddl(HASHES))
    answers = hashes.groupBy("bucket").applyInArrow(repeated, _ddl(ANSWER))
    classes = own.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(second, _ddl(CLASSES))
    lost = classes.groupBy("bucket").applyInArrow(lost_strings, _ddl(LOST))
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" if digest else "doc_id bigint, kept binary"
    return own.groupBy("grp").cogroup(lost.groupBy("grp")).applyInArrow(last, ddl)
