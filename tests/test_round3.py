"""Findings of the third review: lists of many values, narrow files, ends of ranges."""

import json
import time

from pyspark.sql import functions as F

from plazaflow import catalog  # noqa: F401  registers the queries in their order
from plazaflow.functions import arrays, dates, text
from plazaflow.plans import fixtures


def only(spark, column):
    return spark.range(1, numPartitions=1).select(column.alias("c")).first()[0]


def test_lists_of_many_values_take_no_square_of_them(spark):
    """values are cleaned once each, not once for each other value."""
    began = time.time()
    many = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.lit(" Día  "), (i % 1500).cast("string")))
    got = only(spark, arrays.distinct_text(F.concat(many, F.transform(many, F.upper))))
    assert got == [f"Día {i}" for i in range(1500)]
    times = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (i % 250).cast("int")).cast("string"), F.lit("T1"), (i % 3).cast("string")))
    days = only(spark, arrays.session_values(times))
    assert len(days) == 250 and days[0] == "2024-01-01"
    assert len(only(spark, text.lines(F.array_join(many, "\n")))) == 2000
    assert time.time() - began < 30


def test_links_and_sessions_keep_their_order(spark):
    link = lambda s, u, k, p: F.struct(F.lit(s).alias("fuente"), F.lit(u).alias("url"), F.lit(k).alias("kind"), F.lit(p).cast("double").alias("precio"), F.lit(None).cast("string").alias("moneda"), F.lit(None).cast("boolean").alias("es_gratis"))
    got = only(spark, arrays.merge_links(F.array(link("b", "u", "", None), link("a", "u", "detalle", 1.0), link("B", "U/", "compra", 2.0))))
    assert [(x.fuente, x.url, x.kind, x.precio) for x in got] == [("b", "u", "compra", 2.0), ("a", "u", "detalle", 1.0)]
    session = lambda d, t, h: F.struct(F.lit(d).alias("fecha"), F.lit(t).cast("string").alias("datetime"), F.lit(h).alias("tiene_hora"))
    got = only(spark, arrays.union_sessions(F.array(session("b", None, False), session("a", None, False)), F.array(session("b", None, True))))
    assert [(x.fecha, x.tiene_hora) for x in got] == [("a", False), ("b", True)]


def test_white_space_of_any_kind_is_one_space(spark):
    assert only(spark, text.clean_text(F.lit("\u00a0a\u2003 b\t\r\n c  d e\u3000"))) == "a b c d e"


def test_narrow_files_are_many_tasks(spark, tmp_path, monkeypatch):
    """A file of few bytes but very many rows isn't one task."""
    monkeypatch.setattr(fixtures, "ROWS", 100)
    spark.range(5_000, numPartitions=1).write.parquet(f"{tmp_path}/t")
    assert fixtures.dealt(spark.read.parquet(f"{tmp_path}/t"), "id").rdd.getNumPartitions() == 50


def test_years_of_five_digits_have_no_sign(spark):
    """F8."""
    assert only(spark, dates.epoch_iso(F.lit(253_474_963_321))) == "10002-04-21T00:02:01Z"


def test_a_tie_within_a_second_is_none(spark, tmp_path):
    """the later of two versions of one second is the fresher one."""
    from plazaflow.catalog_operators import freshest_feed

    spark.sql("SELECT 'view' AS event_type, TIMESTAMP_NTZ '2024-01-30 23:59:59.2' AS ts UNION ALL SELECT 'click', TIMESTAMP_NTZ '2024-01-30 23:59:59.7'").write.parquet(f"{tmp_path}/events.parquet")
    got = freshest_feed(spark, str(tmp_path)).first()
    assert (got.disk, got.committed, got.use) == ("2024-01-30T23:59:59", "2024-01-30T23:59:59", "committed")


def test_sharp_s_is_shouted_as_one_letter(spark, monkeypatch):
    """as SQL's upper() has it, so that a title of twelve characters stays one."""
    from plazaflow import catalog_operators

    monkeypatch.setattr(catalog_operators, "raw_plans", lambda s, d: s.createDataFrame([(1, "Und ßsch von"), (2, "Eine lange ßtraße")], "_ord long, titulo string"))
    got = {r.doc_id: r.title for r in catalog_operators.smart_title(spark, "").collect()}
    assert got[1] == "UND ẞSCH VON" and got[2] == "Eine lange ßtraße"


def test_every_named_reference_is_found(spark):
    """names are looked up in short maps."""
    from html.entities import html5

    names = [n for n in html5 if n.endswith(";")]
    got = spark.createDataFrame([(n, f"&{n}") for n in names], "n string, t string").select("n", text.unescape("t").alias("c")).collect()
    assert {r.n: r.c for r in got} == {n: html5[n] for n in names}
    assert len(text.NAMED) > 0 and max(len(m) for m in json.loads(text.NAMED)) < 12


def test_long_texts_are_cleaned_once_a_record(spark, sf_dir):
    """Summary, description and content come from one cleaned text, not from one each."""
    plan = fixtures.plans(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_about#" in plan and "_body#" in plan
