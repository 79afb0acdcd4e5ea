"""Findings of the fourth review."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plazaflow import catalog
from plazaflow.llm import substrings
from plazaflow.operators import merging
from plazaflow.plans import fixtures

SMALL = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conditions_stay_behind_the_dealing(spark):
    """what a condition is made of is worked out in the many tasks, not in the few that read the file."""
    dealt = fixtures.dealt(fixtures.table(spark, SMALL, "part").select("p_partkey", "p_name").coalesce(1), "p_partkey")
    plan = planned(dealt.where(F.upper("p_name").rlike("A")))
    assert plan.index("upper(") < plan.index("RepartitionByExpression")
    assert dealt.count() == fixtures.table(spark, SMALL, "part").count()


def test_objects_of_a_page_are_found_once(spark):
    """F17."""
    assert planned(catalog.QUERIES["page_markup"](spark, SMALL)).count("ld\\+json[^>]*>(.*?)") == 1


def test_contexts_without_a_like_one_are_not_sorted():
    """of an anchor's contexts only those go to the suffix sort that agree with another over half a string on a side."""
    rng = np.random.default_rng(1)
    width, middle = substrings.WHOLE, rng.integers(0, 256, substrings.GRAM, np.uint8)
    left = substrings.WINDOW - 1

    def context() -> np.ndarray:
        x = rng.integers(0, 256, width, np.uint8)
        x[left : left + substrings.GRAM] = middle
        return x

    for at in range(substrings.WINDOW):  # a shared string at each place, among contexts that share the anchor only
        one, other = context(), context()
        other[at : at + substrings.LENGTH] = one[at : at + substrings.LENGTH]
        data = np.concatenate([context(), one, context(), other, context()])
        size = np.full(5, width)
        found = substrings.meeting(np.zeros(5, np.uint64), size, np.arange(5) * width, data)
        assert found.tolist() == [False, True, False, True, False]
    cut = np.array([width, width, substrings.LENGTH])  # beside a context that a text's end has cut, nothing is put aside
    assert substrings.meeting(np.zeros(3, np.uint64), cut, np.cumsum(cut) - cut, data).tolist() == [True] * 3
    assert not substrings.meeting(np.arange(5, dtype=np.uint64), size, np.arange(5) * width, data).any()


def test_records_of_a_batch_become_objects_a_few_at_a_time(monkeypatch):
    """what Python holds doesn't grow with a batch."""
    made = []

    class Batch:
        def __init__(self, rows: pa.RecordBatch):
            self.rows, self.num_rows = rows, rows.num_rows

        def slice(self, at: int, n: int) -> Batch:
            return Batch(self.rows.slice(at, n))

        def to_pylist(self) -> list[dict]:
            made.append(self.num_rows)
            return self.rows.to_pylist()

    rows = pa.RecordBatch.from_pylist([{"k": k, "m": [("a", str(k))]} for k in range(1001)], pa.schema([("k", pa.int64()), ("m", pa.map_(pa.string(), pa.string()))]))
    assert [(r["k"], r["m"]) for r in merging.rows_of(iter([Batch(rows)]), ["m"])] == [(k, {"a": str(k)}) for k in range(1001)]
    assert max(made) <= merging.TOGETHER


def test_a_held_text_is_cleaned_once(monkeypatch):
    """of many texts, those that can't be longer than the held one aren't cleaned, nor is that one again."""
    cleaned = []
    clean = merging.clean
    monkeypatch.setattr(merging, "clean", lambda x: cleaned.append(x) or clean(x))
    values = {"contenido": "uno  dos"}
    for other in (None, "", "x", "tres y  cuatro", "uno", "   cinco     ", "tres  y cuatro", "tres y cuatro y más"):
        merging._longest(values, "contenido", other, None)
    assert values["contenido"] == "tres y cuatro y más"
    assert len(cleaned) == 4
