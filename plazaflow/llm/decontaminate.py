"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words inside a sentence; neighbouring ones are one name) and
units after a number give way to typed placeholders, their values kept as slots; all other words are lower-cased. Windows
of WINDOW template tokens are joined by hash between documents and benchmark items. On one alignment of a document with an
item, a value in the item must always meet the same value in the document: a question asked again with other numbers or
names stays consistent, a chance likeness of templates does not.

Whether a capitalised word is a name can't always be told, so texts are read in several ways, and windows meet only within
one reading: USUAL as above; OPENED with capitalised words that open a sentence as names too; SPELLED with all names as plain
words, which finds copies in lower case; LOWERED, for copies in lower case with other names, where an item's names, wherever they
stand, may meet any words of a document, up to NAMES in a window. Items without a window of enough words in the usual reading, such as lists of numbers,
are read as EXACT: every word and number stands for itself, so their windows must agree in all values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plazaflow.llm.common import BASE, batches, cut, mixed, power, range_hashes, unused, utf8

#: Template tokens in a window; words among them that must not be placeholders; share of an item's windows that makes a leak.
WINDOW, LITERALS, SHARE = 5, 3, 0.5
#: Benchmark windows up to this number go to every executor (8 bytes each) and sift the documents' windows before the join.
SIFTED = 1_000_000
#: Words for units, after a number.
UNITS = "mm cm m km kg g mg lb lbs oz l ml mi mile miles foot feet inch inches meter meters metre metres gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent degree degrees mph kph".split()
WORD, NUMBER, NAME, UNIT = range(4)
READINGS = USUAL, OPENED, SPELLED, EXACT, LOWERED = range(5)
#: Names in a window in the reading LOWERED.
NAMES = WINDOW - LITERALS
#: Scripts without spaces, whose letters are words each (first and last code point): Thai and Lao, Myanmar, Khmer, kana, Chinese
#: characters, kana of half width, rarer Chinese characters; and signs among them that are no letters.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
SIGNS = [(0x2000, 0x2BFF), (0x3000, 0x3040), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
SLICE = 1 << 20
#: Bits of a hash that a table of what is looked for is read by, before the sorted hashes are.
SIFT_BITS = 20


def word_hash(word: str) -> int:
    return int(range_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([len(word.encode())]))[0])


@lru_cache(1)
def _unit_hashes() -> np.ndarray:
    return np.sort(np.array([word_hash(u) for u in UNITS], np.uint64))


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Sift:
    """Whether hashes are among those looked for: a table of their first bits turns most away."""

    def __init__(self, among: np.ndarray):
        self.among = among
        self.table = np.zeros(1 << SIFT_BITS, bool)
        self.table[among >> np.uint64(64 - SIFT_BITS)] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        """Where among the values those looked for stand."""
        near = np.flatnonzero(self.table[values >> np.uint64(64 - SIFT_BITS)])
        return near[_within(values[near], self.among)]


def letters_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of characters of three and four bytes: where they begin, their number of bytes, and their code points."""
    three, four = np.flatnonzero((raw[:-2] & 0xF0) == 0xE0) if len(raw) > 2 else np.zeros(0, int), np.flatnonzero((raw[:-3] & 0xF8) == 0xF0) if len(raw) > 3 else np.zeros(0, int)
    low = lambda at: (raw[at] & 63).astype(np.int64)
    codes = ((raw[three] & 15).astype(np.int64) << 12) | (low(three + 1) << 6) | low(three + 2)
    more = ((raw[four] & 7).astype(np.int64) << 18) | (low(four + 1) << 12) | (low(four + 2) << 6) | low(four + 3)
    return np.r_[three, four], np.r_[np.full(len(three), 3), np.full(len(four), 4)], np.r_[codes, more]


def _in_ranges(codes: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    found = np.zeros(len(codes), bool)
    for first, last in ranges:
        found |= (codes >= first) & (codes <= last)
    return found


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: row, the word's hash, and whether it is its row's first, a number, capitalised, the first of a sentence."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    before = np.r_[np.uint8(0), raw[:-1]] if len(raw) else raw
    capital = (raw >= 65) & (raw <= 90)
    accent = (before == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)  # capitals of Latin-1, in two bytes
    low[accent] += 32
    if len(raw):
        capital[:-1] |= accent[1:]
    digit = (raw >= 48) & (raw <= 57)
    letter = ((low >= 97) & (low <= 122)) | (raw >= 0x80)
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts[:-1]] = True  # texts don't run into one another
    if len(raw) > 1:  # punctuation and signs beyond ASCII; letters of scripts without spaces are words each
        at, size, codes = letters_of(raw)
        for k in range(3):
            letter[at[_in_ranges(codes, SIGNS)] + k] = False
        alone = _in_ranges(codes, UNSPACED)
        edge[at[alone]] = edge[(at + size)[alone]] = True
        lead = np.flatnonzero((raw[:-1] == 0xC2))
        letter[lead] = letter[lead + 1] = False
    inside = letter | digit
    prior = np.r_[False, inside[:-1]] if len(raw) else inside
    start = np.flatnonzero(inside & (~prior | edge[:-1]))
    following = np.r_[inside[1:], False] if len(raw) else inside
    end = np.flatnonzero(inside & (~following | edge[1:])) + 1
    own = range_hashes(low, start, end)
    row = np.searchsorted(starts, start, "right") - 1
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    stops = np.r_[0, np.cumsum((raw == 46) | (raw == 33) | (raw == 63) | (raw == 58) | (raw == 10))]
    last_end = np.r_[0, end[:-1]] if len(end) else end
    opens = first | (stops[start] > stops[last_end])  # at the start of a sentence
    small = ~capital[np.minimum(start + 1 + (raw[start] == 0xC3), max(len(raw) - 1, 0))] & (end - start > 1) if len(start) else np.zeros(0, bool)
    number = digit[start] if len(start) else np.zeros(0, bool)
    proper = (capital[start] & small & ~number) if len(start) else number
    return row, own, first, number, proper, opens


def template(raw: np.ndarray, starts: np.ndarray, reading: int = USUAL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of all rows: row, kind, token's hash (of its kind for a placeholder), and the word's own hash."""
    return _read(*words(raw, starts), reading)


def _read(row, own, first, number, proper, opens, reading):
    name = proper & ~opens if reading == USUAL else proper if reading in (OPENED, LOWERED) else np.zeros(len(row), bool)
    kind = np.where(number, NUMBER, np.where(name, NAME, WORD))
    if reading == EXACT:
        return row, np.full(len(row), WORD), own, own
    after_number = np.r_[False, number[:-1]] & ~first if len(number) else number
    kind[after_number & (kind == WORD) & _within(own, _unit_hashes())] = UNIT
    again = np.r_[False, name[:-1]] & name & ~first if len(name) else name
    keep = ~again if reading != LOWERED else np.ones(len(row), bool)  # there, each word of a name stands for one
    tokens = np.where(kind == WORD, own, mixed(kind.astype(np.uint64) + np.uint64(1 << 40)))
    return row[keep], kind[keep], tokens[keep], own[keep]


NAME_TOKEN = mixed(np.array([NAME + (1 << 40)], np.uint64))[0]


def _windows(row, kind, tokens, width, reading, named: bool = False):
    """Runs of `width` tokens of one row that have enough words (widths below WINDOW need one): (which of their words stand for names,
    places, hashes). named: any of the words do, up to NAMES, in all ways."""
    n = len(tokens) - width + 1
    if n <= 0:
        return
    h, literals = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(BASE) + tokens[k : k + n]
            literals += kind[k : k + n] == WORD
        salt = np.uint64(width) + np.uint64(reading << 8)
        whole = row[width - 1 :] == row[:n]
        least = LITERALS if width == WINDOW else 1
        turned = [(NAME_TOKEN - tokens[k : k + n]) * power(BASE, width - 1 - k) for k in range(width)] if named else []
        for size in range(NAMES + 1 if named else 1):
            enough = whole & (literals >= least + size)
            for wild in combinations(range(width), size):
                at = np.flatnonzero(enough if not wild else reduce(np.logical_and, (kind[k : k + n] == WORD for k in wild), enough))
                own = h[at]
                for k in wild:
                    own = own + turned[k][at]
                yield wild, at, mixed(own + salt)


ROWS = "row_key bigint, text_key bigint, reading int, width int, at bigint, h bigint, slots array<bigint>"


def _emit(rows, row_key, text_key, at, first, h, kind, own, width, reading, wild=()):
    place = at - first[rows[at]]
    named = np.isin(np.arange(width), wild)
    slots = [[int(x) for x in own[i : i + width][(kind[i : i + width] != WORD) | named].view(np.int64)] for i in at]
    return pa.RecordBatch.from_arrays(
        [pa.array(row_key[rows[at]], pa.int64()), pa.array(text_key[rows[at]], pa.int64()), pa.array(np.full(len(at), reading), pa.int32()), pa.array(np.full(len(at), width), pa.int32()), pa.array(place, pa.int64()), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.int64()))],
        ["row_key", "text_key", "reading", "width", "at", "h", "slots"],
    )


def windows(df: DataFrame, key: str, looked: dict[int, list[int]] | None = None, among: np.ndarray | None = None) -> DataFrame:
    """(row_key, text_key, reading, width, at, h, slots) of every window of each text; text_key tells apart texts that share an id.

    For documents, `looked` says which widths of window to look for in which reading, and only those whose hash is in
    `among` are given, if there is such. For items (no `looked`) a text shorter than a window is one window, and readings
    that change nothing are left out. OPENED and LOWERED have whole windows only: a name and few words would meet chance likenesses.
    EXACT is for items that have no window in the usual reading, so every item with a letter or digit has a window.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sift = None if among is None else Sift(among)
        for batch in batches(source, "text", SLICE):
            keys = batch.column("row_key").to_pandas().astype("Int64")
            null = keys.isna().to_numpy()
            keys, text_keys = keys.fillna(0).to_numpy(np.int64), batch.column("text_key").to_numpy(zero_copy_only=False)
            raw, starts = utf8(batch.column("text"))
            found = words(raw, starts)
            rows, proper, opens = found[0], found[4], found[5]
            named = {OPENED: proper & opens, SPELLED: proper & ~opens, LOWERED: proper}
            held = np.zeros(len(starts) - 1, bool)  # rows with a window in the usual reading
            for reading in READINGS if looked is None else sorted(looked):
                free = looked is not None and reading == LOWERED  # any words may be names there
                row, kind, tokens, own = _read(*found, SPELLED if free else reading)
                count = np.bincount(row, minlength=len(starts) - 1)
                first = np.r_[0, np.cumsum(count)[:-1]]
                useful = None
                if looked is None and reading != USUAL:
                    useful = ~held if reading == EXACT else np.bincount(rows[named[reading]], minlength=len(starts) - 1) > 0
                for width in sorted({min(WINDOW, int(c)) for c in count if c}) if looked is None else looked[reading]:
                    if reading in (OPENED, LOWERED) and width < WINDOW:
                        continue
                    for wild, at, h in _windows(row, kind, tokens, width, reading, free):
                        if looked is None and width < WINDOW:
                            own_width = count[row[at]] == width
                            at, h = at[own_width], h[own_width]
                        if useful is not None:
                            at, h = at[useful[row[at]]], h[useful[row[at]]]
                        if reading == USUAL:
                            held[row[at]] = True
                        if sift is not None:
                            good = sift.places(h)
                            at, h = at[good], h[good]
                        if len(at):
                            out = _emit(row, keys, text_keys, at, first, h, kind, own, width, reading, wild)
                            if null.any():
                                out = out.set_column(0, "row_key", pa.array(np.where(null[row[at]], None, out.column(0).to_pandas()), pa.int64()))
                            yield out

    return df.select(F.col(key).cast("bigint").alias("row_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").mapInArrow(run, ROWS)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, item_windows, coverage, n_changed): documents that hold at least `share` of an
    item's template windows on consistent alignments, in the first reading that does; n_changed counts slot values that differ from the item's.

    Benchmark windows are unique by item and place. Up to SIFTED of them, their hashes sift the documents' windows in the
    map; beyond, all windows of the widths that items have go into the join: same result. Documents first meet items only in
    each item's rarest windows, so many that a leak must hold one of them; so a window that many items share makes no
    pairs of all of them with all documents that hold it. The pairs found are then held against all windows. The join runs
    on window hashes, so a passage in very many documents is a skewed key on one side with few rows on the other, which
    Spark splits or broadcasts by size; groups are one document's matches with one item. Null or empty texts match nothing;
    a null doc_id is reported as null; repeated rows are reported once; items with a null id or without a letter or digit
    are left out, and of items with one id and unequal texts each counts by itself. Other columns are ignored.
    """
    items = windows(benchmark.select("item_id", "text").where("item_id is not null").dropDuplicates(), "item_id")
    items = cut(items.select(F.col("row_key").alias("item_id"), F.col("text_key").alias("item_key"), F.col("at").alias("item_at"), "reading", "width", "h", F.col("slots").alias("item_slots")))
    number = Window.partitionBy("item_id", "item_key", "reading")
    often = items.groupBy("reading", "h").agg(F.count(F.lit(1)).alias("often"))
    sized = items.join(often, ["reading", "h"]).withColumns({"item_windows": F.count(F.lit(1)).over(number), "rank": F.row_number().over(number.orderBy("often", "item_at"))})
    sized = cut(sized.withColumn("rare", F.col("rank") <= F.col("item_windows") - F.ceil(share * F.col("item_windows")) + 1).drop("often", "rank", "width"))
    looked: dict[int, list[int]] = {}
    for r in items.select("reading", "width").distinct().sort("reading", "width").collect():  # at most WINDOW a reading
        looked.setdefault(r.reading, []).append(r.width)
    head = items.select("h").distinct().limit(SIFTED + 1).toPandas().h.to_numpy(np.int64)
    among = np.sort(head.view(np.uint64)) if len(head) <= SIFTED else None
    found = cut(windows(docs.select("doc_id", "text"), "doc_id", looked, among).withColumnRenamed("row_key", "doc_id").drop("width").distinct())
    held = found.select(F.struct("doc_id", "text_key").alias("d"), "reading", "h", "at", "slots")
    pairs_met = held.select("d", "reading", "h").join(sized.where("rare").select("reading", "h", "item_id", "item_key"), ["reading", "h"]).drop("h").distinct()
    met = pairs_met.join(sized.drop("rare"), ["reading", "item_id", "item_key"]).join(held, ["d", "reading", "h"]).select("d.*", "*").drop("d")
    pairs = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    aligned = met.groupBy("doc_id", "text_key", "item_id", "item_key", "reading", "item_windows", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    consistent = aligned.where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs"))
    changed = F.size(F.filter("pairs", lambda p: p["i"] != p["d"]))
    whole = consistent.groupBy("doc_id", "text_key", "item_id", "item_key", "reading", "item_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_windows"), F.max(changed).cast("bigint").alias("n_changed"))
    whole = whole.withColumn("coverage", F.round(F.col("n_windows") / F.col("item_windows"), 6)).where(F.col("n_windows") >= share * F.col("item_windows"))
    first = F.min(F.struct("reading", "n_windows", "item_windows", "coverage", "n_changed")).alias("first")
    return whole.groupBy("doc_id", "text_key", "item_id", "item_key").agg(first).select("doc_id", "text_key", "item_id", "first.n_windows", "first.item_windows", "first.coverage", "first.n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text leaks an item; rows and columns stay as they are, whatever the columns' names."""
    bad = leaks(docs, benchmark).select("doc_id", "text_key").distinct()
    doc, key = unused("_leak_doc", docs), unused("_leak_text", docs)
    bad = bad.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key)), "left_anti")
