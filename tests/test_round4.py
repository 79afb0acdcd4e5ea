"""Findings of the third review that projections to larger tables gave."""

from pyspark.sql import functions as F

from plazaflow.functions import markup, numbers
from plazaflow.operators import discover, enrich, joins, resolve
from plazaflow.plans import dims
from plazaflow.sources import page_sources


def test_pairs_of_one_frequent_name_are_many_tasks(spark, monkeypatch):
    """a head's pairs are dealt out by cells of rows, and none is lost or doubled."""
    monkeypatch.setattr(joins, "CELL", 16, raising=False)
    monkeypatch.setattr(joins, "PAIRS", 5_000, raising=False)
    names = ["a"] * 200 + ["ab"] * 150 + ["abc", "b", "", "ba", None]
    df = spark.createDataFrame(list(enumerate(names)), "id long, place string")
    pairs = joins.prefix_pairs(df, "id", "place")
    got = [tuple(r) for r in pairs.collect()]
    assert sorted(got) == sorted((i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and a is not None and b is not None and b.startswith(a))
    per_task = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(per_task) < len(got) / 6


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_titles_are_found_once(spark):
    """a title's slug is made once, and rows that meet several times come from one reading."""
    df = spark.createDataFrame([(1, "d", "Gran concierto de jazz"), (2, "d", "Concierto jazz"), (3, "d", "Gran concierto de jazz")], "id long, day string, titulo string")
    p = df.select("id", "day", resolve.title_tokens("titulo").alias("tokens"))
    assert planned(p).count("[^a-z0-9]+") == 1
    met = joins.containment_pairs(p.where("tokens is not null"), "id", "day", "tokens")
    assert "[^a-z0-9]+" not in planned(met)
    assert sorted(map(tuple, met.collect())) == [(1, 3), (3, 1)]


def test_rules_that_may_hit_are_found_in_one_reading(spark):
    """nothing that a rule's expression finds is turned away before it."""
    said = [w for p, _ in dims.RULES for w in enrich.stems(p) or []] + ["festival de music", "obra de arte", "jam session", "jam \x0bsession", "ted", "ia", "dj", "spa", "yoga medit", "parque infantil", "cuentos cuento", "recital poes", "1ciudad21distritos"]
    texts = [a + w + b for w in said for a in ("", "Ya, ", "ñ", "́", "3", "_", "—") for b in ("", ".", "́", "s", " x")]
    df = spark.createDataFrame([(t.lower(),) for t in texts] + [(None,)], "low string").withColumn("bits", enrich.possible_rules(F.col("low")))
    lost = df.select(*(F.count_if(F.col("low").rlike(f"(?U){p}") & (F.col("bits").bitwiseAND(1 << k) == 0)).alias(f"r{k}") for k, (p, _) in enumerate(dims.RULES)), F.count_if(F.col("bits") > 0).alias("some"), F.count_if(F.col("low").isNull() & (F.col("bits") != 0)).alias("none")).first().asDict()
    assert lost.pop("some") > len(said) and set(lost.values()) == {0}
    plan = planned(enrich.classify(spark.createDataFrame([("t", "un texto")], "titulo string, descripcion string")))
    assert "bits(" in plan and "contains(_weak" not in plan.lower()


def test_days_are_asked_before_texts(spark):
    """a reader's day leaves few plans whose texts are searched."""
    flags = ["is_today", "is_tomorrow", "is_week", "is_weekend", "is_month", "ongoing"]
    view = spark.range(3).select(F.concat(F.lit("jazz "), F.col("id").cast("string")).alias("search_blob"), *((F.col("id") > 0).alias(c) for c in flags))
    view = view.localCheckpoint()
    found = discover.filtered(view, discover.State(query="jazz 2", date_filter="week"))
    condition = next(x for x in planned(found).splitlines() if "Filter" in x)
    assert condition.index("is_week") < condition.index("search_blob") and condition.count("search_blob") == 1
    assert found.count() == 1


def test_ranked_rows_are_made_once(spark):
    """finding the ranges doesn't work out the rows a second time."""
    made = spark.sparkContext.accumulator(0)

    def counting(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    got = discover.with_rank(spark.range(500, numPartitions=4).mapInPandas(counting, "id long"), [F.col("id").desc()]).collect()
    assert {r.id: r.rank for r in got} == {k: 500 - k for k in range(500)}
    assert made.value == 500


def test_links_and_prices_of_a_page_are_found_once(spark):
    """F16: the purchase link isn't looked for again at each link and use, nor a text cleaned for each pattern."""
    df = spark.createDataFrame([("https://c/a/cine-club", "<a href='/x'>Otra</a><a href='/entradas/cine'>Comprar entradas</a>", "Reducida 1 €. General: 12 €")], "url string, html string, t string")
    linked = df.withColumn("_links", markup.links("html"))
    found = linked.select(page_sources._bought().alias("c"))
    assert found.first().c == "https://c/entradas/cine"
    assert planned(found).count("comprar entradas") == 1
    price = df.select(numbers.ranked_price("t").alias("c"))
    assert price.first().c == 12.0
    assert planned(price).count("lower(trim(") == 2  # for the patterns, and for the least price
