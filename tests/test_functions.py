"""Scalar functions: golden cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plazaflow.functions import arrays, dates, markup, numbers, text, urls

def today():
    return F.lit("2024-01-15").cast("date")


@pytest.fixture(scope="module")
def value(spark):
    def run(*columns):
        row = spark.range(1, numPartitions=1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run


def lit(x):
    return F.lit(x)


def test_text(value):
    got = value(
        text.clean_text(lit(" a  b\n c ")),
        text.clean_text(F.lit(None).cast("string")),
        text.slugify(lit("Café — Ñandú €5 ß!")),
        text.slugify(lit("")),
        text.fold_search(lit("MÚSICA Ñ straße")),
        text.web_text(lit("Tom &amp;amp; Jerry &#233; &#xf1; &eacute;&Eacute; &#bad;")),
        text.cap_text(lit("one two three four"), 12),
        text.cap_text(lit("abcdefghijklmnop"), 5),
        text.smart_title(lit("DINOLANDIA: EL MUNDO PERDIDO")),
        text.smart_title(lit("Already Fine Title")),
        text.unless_title(lit("Gran concierto..."), lit("Gran Concierto.")),
        text.summary(lit("T"), lit(None), lit("  d  "), lit("c")),
        text.strip_html(lit("<p>a<br>b</p><script>x</script>&nbsp;c")),
        text.strip_markdown(lit("# T\n- [a](http://b) **c** ![i](u)")),
        text.slice_between(lit("x Fecha: 3 Hora: 4"), "Fecha:", "Hora:"),
        text.camel_words(lit("http://x/DanzaBaile")),
        text.camel_words(lit("none")),
        text.lines(lit("a\n\n a \nb\nb\na")),
        text.collapse_paragraphs(F.array(lit("short"), lit("a short text"), lit("Short"))),
        text.price_label(lit(1234.5), lit(False), lit("fever")),
        text.price_label(lit(12.0), lit(None).cast("boolean"), lit("x")),
        text.price_label(lit(0.0), lit(None).cast("boolean"), lit("x")),
        text.source_label(lit("fever")),
        text.source_label(lit(None).cast("string")),
        text.location_label(lit("A"), lit("B")),
        text.institution_name(lit("Sala (12)")),
    )
    assert got == (
        "a b c", "", "cafe-nandu-5", "madrid-item", "musica n straße", "Tom & Jerry é ñ éÉ &#bad;", "one two…", "abcd…", "Dinolandia: El mundo perdido", "Already Fine Title", None, "d", "a b c", "T a c", "3",
        "Danza Baile", "Cultura", ["a", "b", "a"], ["a short text"], "desde 1234,50\u00a0€", "12\u00a0€", "Gratis", "Fever", "Fuente", "A · B", "Sala",
    )


def test_parse_temporal(value):
    def parsed(x):
        t = value(dates.parse_temporal(lit(x)))
        return t and (t.iso, t.has_time)

    assert parsed("2024-01-20") == ("2024-01-20T00:00:00+01:00", False)
    assert parsed("2024-07-20T21:00:00") == ("2024-07-20T21:00:00+02:00", True)
    assert parsed("2024-01-20T22:59:00Z") == ("2024-01-20T23:59:00+01:00", False)
    assert parsed("2024-07-20T21:00:00+00:00") == ("2024-07-20T23:00:00+02:00", True)
    assert parsed("2024-01-20 10:00") == ("2024-01-20T10:00:00+01:00", True)
    assert parsed("20240120") == ("2024-01-20T00:00:00+01:00", False)
    assert [parsed(x) for x in ("20/01/2024", "2024", "", "2024-02-30", "10:00")] == [None] * 5


def test_sessions(value):
    days = F.array(*map(lit, ["2024-01-16", "2024-01-16T20:00", "2024-01-16T20:00", "bad"]))
    s = dates.sessions(days, lit(None), lit(None))
    assert [(x.iso, x.has_time) for x in value(s)] == [("2024-01-16T20:00:00+01:00", True)]
    none = F.array().cast("array<string>")
    span = dates.sessions(none, lit("2024-01-01"), lit("2024-03-01"))
    start, end = dates.ordered_ends(dates.parse_temporal(lit("2024-01-01")), dates.parse_temporal(lit("2024-03-01")), span)
    assert value(dates.plan_mode(start, end, span), dates.temporal_status(start, end, today()), dates.next_relevant(start, end, span, today())["d"], dates.effective_end(end)) == ("rango", "en_curso", dt.date(2024, 3, 1), "2024-03-01T23:59:59+01:00")
    late, early = dates.ordered_ends(dates.parse_temporal(lit("2024-03-01")), dates.parse_temporal(lit("2024-01-01")), span)
    assert value(early["d"]) == dt.date(2024, 3, 1)


def test_date_texts(value):
    day = lambda x: F.lit(x).cast("date")
    assert [str(d) for d in value(dates.weekly(day("2026-01-01"), day("2026-01-31"), lit("MO,WE"), lit(2), lit("")))] == ["2026-01-12", "2026-01-14", "2026-01-26", "2026-01-28"]
    span = value(dates.spanish_range(lit("Del 3 al 12 de enero de 2026")))
    assert (str(span.first), str(span.last)) == ("2026-01-03", "2026-01-12")
    span = value(dates.spanish_range(lit("del 28 de dic. de 2025 al 4 de enero de 2026")))
    assert (str(span.first), str(span.last)) == ("2025-12-28", "2026-01-04")
    assert value(dates.date_label(lit("12 JUL 2026")), dates.duration_minutes(lit("2 horas")), dates.duration_minutes(lit("90 min"))) == ("2026-07-12", 120, 90)
    assert tuple(value(dates.dmy_fields(lit("3/2/2026 19:30 90 min")))) == ("2026-02-03T19:30:00", "2026-02-03T21:00:00")
    assert tuple(value(dates.time_range(lit("de 9.30 a 14:00")))) == ("09:30", "14:00")
    assert tuple(value(dates.overnight(lit("2026-02-03"), lit("23:30"), lit("02:00")))) == ("2026-02-03T23:30:00", "2026-02-04T02:00:00")
    assert value(dates.body_sessions(lit("3 de marzo: 19:30 h, 4 de marzo: 20.00 h"), lit(2026))) == ["2026-03-03T19:30:00", "2026-03-04T20:00:00"]
    assert value(dates.epoch_iso(lit(0)), dates.daypart(F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))) == ("1970-01-01T00:00:00Z", "afternoon")
    assert value(dates.long_date(F.lit("2026-07-17 10:00:00").cast("timestamp_ntz"))) == "viernes, 17 de julio de 2026"


def test_upcoming(value):
    r = dict.fromkeys(["vigente_hasta", "fecha_fin", "datetime_inicio", "fecha_inicio"], lit(None).cast("string"))
    r["vigente_hasta"] = lit("2024-01-15T21:00:00+01:00")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    assert value(dates.is_upcoming(r, at("2024-01-15 23:30:00")), dates.is_upcoming(r, at("2024-01-16 00:30:00"))) == (True, False)


def test_numbers(value):
    assert value(numbers.least_price(lit("Desde 12,50 € / reducida 9 €")), numbers.least_price(lit("Entrada libre")), numbers.least_price(lit("nada"))) == (9.0, 0.0, None)
    assert tuple(value(numbers.text_price(lit("Gratis"), lit(0), lit("")))) == (0.0, "EUR")
    assert tuple(value(numbers.text_price(lit(""), lit(1), lit("")))) == (0.0, "EUR")
    assert tuple(value(numbers.text_price(lit("12,5 euros"), lit(0), lit("")))) == (12.5, "EUR")
    assert tuple(value(numbers.clean_coordinates(lit(40.41), lit(-3.70), lit("Madrid"), lit(None).cast("string")))) == (None, None)
    assert tuple(value(numbers.clean_coordinates(lit(40.41), lit(-3.70), lit("Sala Sol"), lit(None).cast("string")))) == (40.41, -3.7)
    assert value(numbers.as_float(lit("1d")), numbers.as_float(lit(" 2.5 ")), numbers.as_float(lit("x"))) == (None, 2.5, None)


def test_urls(value):
    nothing = F.lit(None).cast("string")
    assert value(urls.plan_source_id(lit("plan:x:abc"), [nothing], lit("T"), [nothing])) == "abc"
    assert value(urls.plan_source_id(lit("evento"), [lit("http://h/a/B/?q=1")], lit("Un Título"), [lit("2024-01-01T10:00")])) == "evento::B::un-titulo::2024-01-01"
    assert value(urls.normalize_url(lit("/a/b?x#y"), "https://h"), urls.join_url(lit("c.png"), lit("https://h/a/b")), urls.join_url(lit("//c/d"), lit("https://h"))) == ("https://h/a/b/", "https://h/a/c.png", "https://c/d")
    assert value(urls.web_url(lit("mailto:x")), urls.web_url(lit(" HTTPS://x "))) == (None, "HTTPS://x")


def test_arrays(value):
    words = F.array(*map(lit, ["A", " a ", "b", "", "B", "c"]))
    assert value(arrays.distinct_text(words), arrays.session_values(F.array(lit("2024-01-01T10:00"), lit("2024-01-01T12:00")))) == (["A", "b", "c"], ["2024-01-01"])
    link = lambda kind, price: F.struct(lit("fever").alias("fuente"), lit("http://x/").alias("url"), lit(kind).alias("kind"), lit(price).cast("double").alias("precio"), lit(None).cast("string").alias("moneda"), lit(None).cast("boolean").alias("es_gratis"))
    (one,) = value(arrays.merge_links(F.array(link("detalle", None), link("compra", 3.0))))
    assert (one.kind, one.precio) == ("compra", 3.0)
    assert value(arrays.keyword_labels(lit("tech and salsa"), [("T", ["tech"]), ("B", ["salsa", "dance"]), ("X", ["zzz"])], ["C"])) == ["C", "T", "B"]


def test_markup(value):
    page = """<html><head><title>A &amp; B</title><meta property="og:image" content="http://i/a.jpg">
    <script type="application/ld+json">{"@graph":[{"@type":"Event","name":"E"},{"@type":"Place"}]}</script></head>
    <body><h1>One</h1><a href='/x'>Go <b>now</b></a><img src="http://i/b.png" width="10" height="20" alt="cartel"><img src="http://i/favicon.ico"></body></html>"""
    h = lit(page)
    assert value(markup.page_title(h), markup.headings(h), F.get_json_object(markup.ld_of_type(h, ["Event"]), "$.name")) == ("A & B", ["One"], "E")
    assert [tuple(a) for a in value(markup.links(h))] == [("/x", "Go now")]
    assert value(markup.best_image(markup.image_candidates(h)), markup.best_image(markup.image_candidates(h), ["cartel"])) == ("http://i/a.jpg", "http://i/b.png")
    assert value(markup.json_strings(lit('{"a":["x",{"b":"y"}],"c":1,"d":"z"}'))) == ["x", "y", "z"]
    assert value(markup.real_image(lit("http://images.unsplash.com/x")), markup.real_image(lit("http://a"))) == (None, "http://a")


def test_active_filters():
    """P14."""
    from plazaflow.operators import predicates

    assert not predicates.has_active_filters() and not predicates.has_active_filters(date_filter="all")
    assert all(predicates.has_active_filters(**{k: v}) for k, v in {"query": "x", "source": "s", "category": "c", "zone": "z", "free_only": True, "date_filter": "week"}.items())


def test_sql_functions(spark):
    """Functions in SQL are the columns' own expressions: operators, literals and lambdas in them survive."""
    from plazaflow.functions import dates, markup, sql, text

    sql.register(spark)
    rows = spark.createDataFrame([("  Él dijo: '3 <= 4' \\ y  más ",), ("2024-03-31T01:30:00Z",), ("20240203",), (None,), ("<a href='x?a=1&amp;b=(2)'>y</a><h1>T</h1>",)], "t string")
    own = rows.select(text.clean_text("t").alias("a"), text.slugify("t").alias("b"), dates.parse_temporal("t").alias("c"), text.strip_html("t").alias("d"), text.smart_title("t").alias("e")).collect()
    assert spark.sql("SELECT clean_text(t) AS a, slugify(t) AS b, parse_temporal(t) AS c, strip_html(t) AS d, smart_title(t) AS e FROM {r}", r=rows).collect() == own
    found = spark.sql("SELECT l.pos, l.href, l.text FROM {r}, LATERAL page_links(t) AS l", r=rows).collect()
    assert found == rows.select(F.posexplode(markup.links("t")).alias("pos", "l")).select("pos", "l.href", "l.text").collect() and len(found) == 1
