"""Resampling, sharding and the manifest, held against plain Python and, as queries, against their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plazaflow.llm import catalog, importance, merkle, sharding
from plazaflow.llm.common import cut, numbered, table

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int, _at int, slot string, SHARD string, weight string"
ODD = [
    (1, None, "en", "b", 0, 1, "x", "y", "z"),
    (2, "", None, None, None, 2, None, None, None),
    (None, "Ünder the Sea\nWE go 12 times, ok? " * 30, "de", "a", 5, 3, "", "", ""),
    (5, "one two\nthree\n\n" * 9, "en", "a", 9, 4, "", "", ""),
    (5, "one two\nthree\n\n" * 9, "en", "a", 9, 4, "", "", ""),
    (7, "x" * 70_000 + " 今天天气很好 " + "y" * 41, "zh", "é", 1, 5, "", "", ""),
    (-3, "-", "-", "", -1, 6, "", "", ""),
    (9, "- a:b" * 2000, "1:-", "", 7, 7, "", "", ""),
] + [(100 + k, f"word{k} of {k % 7} and so on " * (k % 9), "en", f"s{k % 3}", k, k, "", "", "") for k in range(120)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCUMENTS).repartition(5)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "word3 and the sea, 12 TIMES"), (2, None), (None, ""), (4, "so on 今天天气很好")], "item_id long, text string")


# 11


def plain_features(text, buckets, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def plain_ranks(docs, items, buckets=10_000, order=1, percent=10, least=20):
    s, t = Counter(), Counter()
    read = [(d, *plain_features(text, buckets, order)) for d, text in docs]
    for _, _, found in read:
        s.update(found)
    for text in items:
        t.update(plain_features(text, buckets, order)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for d, words, found in read:
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = place + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


@pytest.mark.parametrize("buckets, order, percent", [(10_000, 1, 10), (97, 3, 50), (10_000, 2, 100)])
def test_importance_matches_plain_counts(spark, sf_dir, odd, target, buckets, order, percent):
    for docs, items in ((odd, target), (table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))):
        own = importance.ranked(docs, items, percent, buckets=buckets, order=order)
        assert sorted(repr(tuple(r)) for r in own.collect()) == plain_ranks([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()], buckets, order, percent)


def test_resampled_rows_are_whole(odd, target):
    drawn = {(r.doc_id, r.score) for r in importance.ranked(odd, target, 30).where("rank is not null").collect()}
    rows = importance.resample(odd, target, 30)
    assert rows.columns == [c for c in odd.columns if c != "weight"] + ["n_words", "n_features", "weight", "score"]
    assert {(r.doc_id, r.score) for r in rows.collect()} == drawn and drawn
    assert not importance.resample(odd.limit(0), target).count() and not importance.ranked(odd.limit(0), target.limit(0)).count()
    assert not importance.resample(odd.where("doc_id < 3"), target).count()


def test_checksums_of_many_words():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    size = np.array([0, 1, 2, 3, 40, 41, 200, 7, 39, 0, 1000] * 3)
    start = np.arange(len(size)) * 100
    assert importance.crc32s(data, start, size).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(start, size)]


def test_words_of_texts_that_touch():
    raw, starts = np.frombuffer(b"abCd efghi", np.uint8), np.array([0, 2, 2, 4, 10])
    low, row, start, size = importance.words(raw, starts)
    assert (bytes(low), row.tolist(), start.tolist(), size.tolist()) == (b"abcd efghi", [0, 2, 3], [0, 2, 5], [2, 2, 5])


# 12


def plain_map(sizes, shards=16):
    at = {s: s % shards for s in range(4096)}
    share, kept, free = -(-sum(sizes.values()) // shards), [0] * shards, []
    for k in range(shards):
        upto = 0
        for nth, s in enumerate(sorted((s for s in sizes if s % shards == k), key=lambda s: (-sizes[s], s))):
            upto += sizes[s]
            if upto > share and nth:
                free.append(s)
            else:
                kept[k] += sizes[s]
    for s in sorted(free, key=lambda s: (-sizes[s], s)):
        at[s] = kept.index(min(kept))
        kept[at[s]] += sizes[s]
    return at, kept


def cell(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:4], 16)


def test_shards_match_plain_maps(spark, sf_dir, odd, tmp_path):
    for k, docs in enumerate((odd, table(spark, sf_dir, "documents"))):
        sizes, want = defaultdict(int), []
        for r in docs.collect():
            data = (r.text or "").encode()
            want.append((r.doc_id, len(data) + 1, zlib.crc32(data)))
            sizes[cell(r.doc_id) >> 4] += len(data) + 1
        at, loads = plain_map(sizes)
        own = sharding.report(docs, f"{tmp_path}/{k}").collect()
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in own)
        places = defaultdict(list)
        for r in own:
            assert (r.shard, r.law, r.grown_shard) == (at[cell(r.doc_id) >> 4], "bytes", None)
            places[r.shard].append((r.slot, cell(r.doc_id), r.doc_id is not None, r.doc_id or 0))
        for rows in places.values():
            assert [p[0] for p in sorted(rows)] == list(range(len(rows))) and [p[1:] for p in sorted(rows)] == sorted(p[1:] for p in rows)
        if k:
            assert max(loads) - min(loads) < 0.05 * sum(loads) / 16
    assert not sharding.report(odd.limit(0), f"{tmp_path}/none").count()


def test_many_copies_of_a_row_are_numbered_apart(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    docs = spark.createDataFrame([(3, "same")] * 60 + [(4, None)] * 8 + [(k, "own") for k in range(10, 40)], "doc_id long, text string").repartition(6)
    own = sharding.report(docs, f"{tmp_path}/m").collect()
    places = defaultdict(list)
    for r in own:
        places[r.shard].append(r.slot)
    assert len(own) == 98 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_maps_are_versions_that_move_little(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    sizes, folder = cut(sharding.slot_bytes(docs)), f"{tmp_path}/maps"
    first = sharding.first_map(spark)
    sharding.store(first, folder)
    sharding.store(sharding.rebalanced(first, sizes), folder)
    with pytest.raises(Exception):
        sharding.store(first, folder)
    even = cut(sharding.load(spark, folder))
    sharding.store(sharding.grown(even, sizes), folder)
    read = lambda v: {r.slot: r.shard for r in sharding.load(spark, folder, v).collect()}
    one, two, three = read(1), read(2), read(None)
    bytes_ = {r.slot: r["bytes"] for r in sizes.collect()}
    load = lambda m: Counter({k: sum(b for s, b in bytes_.items() if m[s] == k) for k in set(m.values())})
    assert len(one) == len(two) == len(three) == sharding.SLOTS
    assert max(load(one).values()) > 1.2 * max(load(two).values())
    assert sum(bytes_.get(s, 0) for s in one if one[s] != two[s]) < 0.5 * sum(bytes_.values())
    assert {three[s] for s in two if three[s] != two[s]} == {16}
    assert abs(load(three)[16] - sum(bytes_.values()) / 17) < 0.5 * sum(bytes_.values()) / 17
    again = {r.slot: r.shard for r in sharding.rebalanced(even, sizes).collect()}
    assert sum(again[s] != two[s] for s in two) < 60  # even shards stay nearly as they are
    sharding.write_shards(docs, even, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and all(two[cell(r.doc_id) >> 4] == r.shard for r in back.select("doc_id", "shard").collect())


# 13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """Root, and for each leaf the siblings left and right at each level."""
    paths, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for k, path in enumerate(paths):
            a = at[k] // arity * arity
            path.append((now[a : at[k]], now[at[k] + 1 : a + arity]))
            at[k] //= arity
        now = [H(*now[i : i + arity]) for i in range(0, len(now), arity)]
    return now[0], paths


def plain_manifest(rows, arity=3):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = defaultdict(list)
    for r in rows:
        key = [enc(v) for v in (r.doc_id, r.source, r.lang, r.n_chars)]
        own = H(*key, enc(r.text))
        bad = H(*key, enc(r.text and r.text.replace("\n", ""))) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else own
        sources[r.source].append((r.doc_id is not None, r.doc_id or 0, own, bad, r.doc_id))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])], arity) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order], arity) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for (_, _, own, bad, doc_id), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1]):
            folded = bad
            for left, right in path + top:
                folded = H(*left, folded, *right)
            out.append((doc_id, own, trees[s][0], root, H(*(x for left, right in path + top for x in left + right)), folded, folded == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_matches_plain_trees(spark, sf_dir, odd, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3**height)
    for docs in (odd, table(spark, sf_dir, "documents"), odd.where("doc_id = 7"), odd.where("source = 's1'")):
        own = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.report(docs).collect()]
        assert sorted(map(repr, own)) == plain_manifest(docs.collect())
    assert not merkle.report(odd.limit(0)).count()


def test_a_level_of_a_block_in_duckdb():
    leaves = [H(str(k)) for k in range(7)]
    with merkle._levels(pa.table({"i": list(range(7)), "hash": leaves}), 2) as con:
        assert con.sql("SELECT sha256(run) FROM run1").fetchall() == [(plain_tree(leaves, 3)[0],)]


def test_numbered_places(spark):
    df = cut(spark.range(500).select((F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, F.lit("k")).alias("key")))
    rows = numbered(df, [F.col("v").desc()], "place", "key", "n").collect()
    for key, n in (("k", 333), (None, 167)):
        own = sorted((r.place, -r.v) for r in rows if r.key == key)
        assert [p for p, _ in own] == list(range(n)) and [v for _, v in own] == sorted(v for _, v in own) and {r.n for r in rows if r.key == key} == {n}


# queries


@pytest.mark.parametrize("name", ["op11_importance", "op12_sharding", "op13_merkle"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    own = catalog.QUERIES[name](spark, sf_dir)
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(own.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in own.collect())
