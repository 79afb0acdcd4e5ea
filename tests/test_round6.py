"""Findings of the fifth review."""

from __future__ import annotations

import pytest

from plazaflow import catalog, catalog_operators
from plazaflow.functions import text
from plazaflow.operators import index, resolve
from plazaflow.plans import fixtures, storage


def test_postings_are_the_runs_of_each_plan(spark, tmp_path, monkeypatch):
    """a bucket's bitmaps have its plans' bits only, each key of a bucket is there once, long texts and all letters too."""
    monkeypatch.setattr(index, "SIZE", 8)
    texts = ["", "ab", "abc", "ñandú 🎭🎪 x", "abcabcabc", None, "🎭🎪🎭", "x" * 50_000 + "ßyz", "la noche", "de las noches", "abd"]
    rows = [(f"p{k:02}", k, t, "fever" if k % 2 else "timeout", ["Cine"] if k % 3 else [], k == 4) for k, t in enumerate(texts)]
    view = spark.createDataFrame(rows, "id string, _ord long, search_blob string, fuente string, categories array<string>, is_free boolean")
    built = index.build(view, f"{tmp_path}/index")
    want = {}
    for n, (_, place, blob, source, categories, free) in enumerate(rows):
        blob = blob or ""
        for key in {f"text:{blob[i : i + 3]}" for i in range(len(blob) - 2)} | {f"any:{source}", f"source:{source}"} | {f"category:{c}" for c in categories} | ({"free"} if free else set()):
            bits, first = want.get((key, n // 8), (0, place))
            want[key, n // 8] = bits | 1 << n % 8, min(first, place)
    got = built.postings.collect()
    assert len(got) == len(want) and max(len(r.bits) for r in got) == 1
    assert {(r.key, r._bucket): (r.bits[0], r.first) for r in got} == want


def test_nothing_to_show_is_an_empty_text(spark, monkeypatch):
    """as its SQL has it; the function gives null, as feeds need it."""
    texts = ["", "  \n", None, "uno", "dos " * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(catalog, "table", lambda s, d, name: rows)
    got = {r.doc_id: r.capped for r in catalog.cap_text(spark, "").collect()}
    assert [got[k] for k in range(4)] == ["", "", None, "uno"] and got[4].endswith("dos…")
    assert [r.c for r in rows.where("doc_id < 2").select(text.cap_text("text", 120).alias("c")).collect()] == [None, None]


@pytest.mark.parametrize("given, wanted", [("ßheit, eine lange", "ẞheit, eine lange"), ("und so. ßa es: ßb", "Und so. ẞa es: ẞb"), ("große straßen da", "Große straßen da")])
def test_sharp_s_rises_as_one_letter(spark, monkeypatch, given, wanted):
    """a title that begins with it, too."""
    monkeypatch.setattr(catalog_operators, "raw_plans", lambda s, d: s.createDataFrame([(1, given)], "_ord long, titulo string"))
    assert catalog_operators.smart_title(spark, "").first().title == wanted


def test_records_of_a_merge_are_stored_in_compressed_columns(spark, sf_dir, tmp_path, monkeypatch):
    """exact and same-day merges keep no whole records as they are in memory."""
    checkpoints = []
    kept = resolve.kept
    monkeypatch.setattr(resolve, "kept", lambda df: checkpoints.append(df.columns) or kept(df))
    merged = resolve.merge_same_day(resolve.merge_exact(fixtures.plans(spark, sf_dir)))
    assert merged.count() and checkpoints and not any("contenido" in c for c in checkpoints)


def test_what_is_stored_comes_back(spark):
    rows = spark.sql("SELECT id AS k, IF(id % 2 = 0, 'é', NULL) AS t, map('a', CAST(NULL AS STRING)) AS m, array(struct(id AS i, CAST(NULL AS STRING) AS s)) AS l FROM range(50)")
    for df in (rows, rows.limit(0)):
        assert sorted(map(str, storage.stored(df).collect())) == sorted(map(str, df.collect()))
