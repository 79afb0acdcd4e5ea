"""Adapters on small payloads."""

import json

import pytest
from pyspark.sql import functions as F

from plazaflow.operators.normalize import normalize_plans
from plazaflow.plans import dims
from plazaflow.sources import ADAPTERS, extract, page_sources, read_payload

TODAY = "2026-01-10"


def page(event=None, body=""):
    ld = f'<script type="application/ld+json">{json.dumps(event)}</script>' if event else ""
    return f"<html><head><title>Página</title>{ld}</head><body><h1>Título de página</h1>{body}<a href='/entradas/x'>Comprar entradas</a></body></html>"


EVENT = {"@type": "Event", "name": "Ópera &amp; Co", "startDate": "2026-02-01T20:00", "endDate": "2026-02-02", "url": "https://h/e/uno", "location": {"name": "Teatro", "address": {"streetAddress": "Calle 1", "addressLocality": "Madrid"}}, "offers": [{"price": "12", "priceCurrency": "EUR"}, {"price": "9.5"}]}
POST = {"id": "1", "link": "https://g/p", "date_gmt": "2026-01-05T10:00:00", "title": {"rendered": "Una &amp; dos"}, "excerpt": {"rendered": "<p>Resumen</p>"}, "content": {"rendered": "<p>Cuerpo</p>"}, "_embedded": {"wp:term": [[{"taxonomy": "category", "name": "Cultura"}, {"taxonomy": "post_tag", "name": "Etiqueta"}]]}}

JSON = {
    "datos_madrid": ({"@graph": [{"id": "1", "@type": "x/DanzaBaile", "title": "Baile", "price": "Gratis", "dtstart": "2026-01-12 19:00:00.0", "dtend": "2026-01-25 21:00:00.0", "recurrence": {"days": "MO,WE", "frequency": "WEEKLY", "interval": 1}, "event-location": "Centro"}]}, {"precio": "0.0", "categorias": ["Danza Baile"], "fechas_disponibles": [f"2026-01-{d}T19:00:00" for d in (12, 14, 19, 21)]}),
    "fever": ([{"category": c, "plans": [{"id": "9", "name": "Plan", "price_info": {"amount": 5.0, "currency": "EUR", "hide": False}, "location": {"name": "Aquí", "is_hidden": False}}]} for c in ("B", "A")], {"titulo": "Plan", "precio": "5.0", "categorias": ["A", "B"]}),
    "wegow": ({"events": [{"id": "1", "slug": "s", "title": "Show en Madrid", "enabled": True, "cancelation_status": 0, "min_price": "7", "city": {"name": "Madrid"}, "description": "Gran festival"}, {"id": "2", "slug": "t", "title": "Show en Sevilla", "enabled": True}]}, {"precio": "7.0", "categorias": ["Festivales", "Musica"], "lugar": "Madrid"}),
    "ticketmaster": ({"events": [{"id": str(k), "title": "Obra", "url": "https://www.ticketmaster.es/x", "dates": {"startDate": d}, "venue": {"name": "V"}} for k, d in enumerate(["2026-02-01T20:00", "2026-02-02T20:00"])]}, {"fechas_disponibles": ["2026-02-01T20:00", "2026-02-02T20:00"], "url_compra": "https://www.ticketmaster.es/x"}),
    "meetup": ({"edges": [{"node": {"id": "1", "title": "Tech and salsa", "dateTime": "2026-01-12T19:00:00+01:00", "venue": {"name": "Bar", "city": "Madrid", "lat": 40.4}}}, {"node": {"id": "2", "title": "Far", "venue": {"lat": 10.0}}}]}, {"categorias": ["Comunidad", "Tecnología", "Baile"], "fecha_inicio": "2026-01-12T19:00:00+01:00"}),
    "rockthesport": ({"items": [{"eventId": "7", "name": "Carrera", "sport": "trail", "city": "Madrid", "eventStartDate": "2026-03-01T09:00:00", "price": "20"}]}, {"categorias": ["Deportes", "Trail"], "precio": "20.0"}),
    "matadero": ({"data": [{"id": "1", "attributes": {"title": "Expo", "path": {"alias": "/expo"}, "field_price": {"processed": "<p>Entrada libre</p>"}, "field_place": {"processed": "Nave 16"}}, "relationships": {"field_category": {"data": [{"type": "c", "id": "5"}]}}}, {"id": "2", "attributes": {"title": "Expo", "langcode": "en"}}], "included": [{"type": "c", "id": "5", "attributes": {"name": "Arte"}}]}, {"precio": "0.0", "categorias": ["Arte"], "latitud": "40.3925"}),
    "teatros_canal": ({"events": [{"id": "1", "title": "Danza", "start_date": "2026-02-01 00:00:00", "end_date": "2026-02-03 23:59:59", "detail": "<p>Lugar: Sala Roja. Duración: 60 min. Entrada general: 18 €</p>", "categories": [{"name": "Portada"}, {"name": "Danza"}]}]}, {"fecha_inicio": "2026-02-01", "precio": "18.0", "lugar": "Sala Roja", "categorias": ["Danza"]}),
    "gacetin_madrid": (POST, {"titulo": "Una & dos", "categorias": ["Cultura"], "etiquetas": ["Etiqueta"], "fecha_publicacion": "2026-01-05T10:00:00Z"}),
    "espacio_fundacion_telefonica": ({**POST, "html": page(EVENT)}, {"precio": "0.0", "fecha_inicio": "2026-02-01T20:00"}),
    "museo_reina_sofia": ({"results": [{"url": {"path": "/expo"}, "title": "Expo", "price": "4 €", "processedDates": [{"value": 1769940000}]}]}, {"precio": "4.0", "fecha_inicio": "2026-02-01T10:00:00Z"}),
    "madrid_secreto": ([{"id": "1", "titulo": "Secreto"}], {"titulo": "Secreto"}),
}
PAGES = {
    "esmadrid": ([("https://h/e/uno", page(EVENT), c) for c in ("B", "A")], {"titulo": "Ópera & Co", "precio": "9.5", "categorias": ["A", "B"], "direccion": "Calle 1, Madrid", "url_compra": "https://h/entradas/x"}),
    "eventbrite": ([("https://h", page({"itemListElement": [{"item": EVENT}]}), "Música")], {"titulo": "Ópera & Co", "url": "https://h/e/uno/", "categorias": ["Música"]}),
    "ifema_madrid": ([("https://h", page(EVENT))], {"url": "https://h/e/uno", "lugar": "Teatro"}),
    "fundacion_mapfre": ([("https://h/m/dos", page(EVENT))], {"id": "dos", "precio": "9.5"}),
    "circulo_bellas_artes": ([("https://h/a/cine-club", page(body="<p>Del 03/02/2026 al 05/02/2026. General: 7 €</p><p>Mié 03/02, 19:30</p>"))], {"fecha_inicio": "2026-02-03", "fecha_fin": "2026-02-05", "precio": "7.0"}),
    "casa_mexico": ([("https://h/c/expo", page(body="<p>Del 3 al 9 de febrero de 2026</p><p>Entrada libre</p>"), "Exposiciones")], {"fecha_inicio": "2026-02-03", "fecha_fin": "2026-02-09", "precio": "0.0", "categorias": ["Exposiciones"]}),
    "biblioteca_nacional": ([("https://h/b/uno", page(body="<p>3 de febrero: 18:00 h</p>"), "Del 3 al 9 de febrero de 2026", None)], {"fecha_inicio": "2026-02-03", "fechas_disponibles": ["2026-02-03T18:00:00"], "precio": "0.0"}),
    "fundacion_canal": ([("https://h/f/uno", page(body="<p>3/2/2026 19:30 90 min. 5 €</p>"), "Conciertos")], {"fecha_inicio": "2026-02-03T19:30:00", "fecha_fin": "2026-02-03T21:00:00", "precio": "5.0"}),
    "sala_el_sol": ([("https://h/s/uno", page(body="<p>Fecha: hoy Hora: 23:30 - 02:00 Entradas: 12 € Tipo: Rock</p>"), "Grupo", 3, 2, 1, 2026)], {"titulo": "Grupo", "fecha_inicio": "2026-02-03T23:30:00", "fecha_fin": "2026-02-04T02:00:00", "precio": "12.0"}),
    "timeout": ([("https://t/n", page({"@type": "NewsArticle", "headline": "Titular", "datePublished": "2026-01-05T10:00:00Z", "articleSection": "Ocio"}, "<article><p>" + "palabra " * 20 + "</p></article>"))], {"titulo": "Titular", "categorias": ["Ocio"], "fecha_publicacion": "2026-01-05T10:00:00Z"}),
}


def test_every_source_has_an_adapter():
    assert set(ADAPTERS) == {*dims.PLAN_SOURCES, *dims.NEWS_SOURCES} == {*JSON, *PAGES}


def held(records, expected):
    assert len(records) == 1
    assert {k: records[0][k] for k in expected} == expected


@pytest.mark.parametrize("name", JSON)
def test_json_source(spark, tmp_path, name):
    payload, expected = JSON[name]
    for k, document in enumerate(payload if isinstance(payload, list) else [payload]):
        (tmp_path / f"{k}.json").write_text(json.dumps(document))
    records = extract(read_payload(spark, name, str(tmp_path)), name)
    held(records.collect(), expected | {"fuente": name})


@pytest.mark.parametrize("name", PAGES)
def test_page_source(spark, name):
    from plazaflow.sources.registry import SCHEMAS

    rows, expected = PAGES[name]
    records = extract(spark.createDataFrame(rows, SCHEMAS[name]), name)
    held(records.collect(), expected | {"fuente": name})


def test_markdown_news_and_years(spark):
    text = "Title: Algo\nURL Source: https://t/algo\nPublished Time: 2026-01-05\nMarkdown Content:\n# Hola [tú](x)"
    (r,) = extract(spark.createDataFrame([("https://proxy", text)], "url string, html string"), "timeout").collect()
    assert (r.titulo, r.url, r.contenido) == ("Algo", "https://t/algo", "Hola tú")
    cards = spark.createDataFrame([(1, 20, 11), (2, 5, 12), (3, 7, 1), (4, 9, 2)], "position long, day int, month int")
    got = page_sources.with_years(cards, F.lit("2025-11-15").cast("date")).orderBy("position").collect()
    assert [r.year for r in got] == [2025, 2025, 2026, 2026]


def test_records_normalize(spark):
    from plazaflow.sources.registry import SCHEMAS

    raw = extract(spark.createDataFrame(PAGES["esmadrid"][0], SCHEMAS["esmadrid"]), "esmadrid")
    (r,) = normalize_plans(raw, F.lit(TODAY).cast("date"), "2026-01-10T00:00:00Z").collect()
    assert (r.id, r.modo_fecha, r.estado_temporal, r.datetime_inicio) == ("plan:esmadrid:uno", "rango", "proximo", "2026-02-01T20:00:00+01:00")
