"""Adapters for saved pages, rows of (url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.functions import arrays, dates, markup, numbers, text, urls
from plazaflow.operators.enrich import shared_purchase_urls
from plazaflow.operators.joins import first_year
from plazaflow.operators.predicates import in_scope, is_live
from plazaflow.sources.registry import adapter, records

TICKETS = ["comprar entradas", "entradas", "comprar", "reservar", "inscripción"]


def _get(event: Column, path: str) -> Column:
    return F.get_json_object(event, f"$.{path}")


def _event(event: Column) -> dict[str, Column]:
    """Fields of a JSON-LD event."""
    offers = F.coalesce(F.from_json(_get(event, "offers"), "array<string>"), F.array(_get(event, "offers")))
    prices = F.transform(offers, lambda o: F.coalesce(F.get_json_object(o, "$.price"), F.get_json_object(o, "$.lowPrice")))
    money = numbers.offers_price(prices, F.transform(offers, lambda o: F.get_json_object(o, "$.priceCurrency")))
    street = [F.nullif(_get(event, f"location.address.{k}"), F.lit("")) for k in ("streetAddress", "postalCode", "addressLocality")]
    return {
        "titulo": text.web_text(_get(event, "name")),
        "descripcion": text.strip_html(_get(event, "description")),
        "precio": money["precio"],
        "moneda": money["moneda"],
        "lugar": text.web_text(_get(event, "location.name")),
        "direccion": F.nullif(F.concat_ws(", ", *street), F.lit("")),
        "latitud": _get(event, "location.geo.latitude"),
        "longitud": _get(event, "location.geo.longitude"),
        "fecha_inicio": dates.to_local_iso(_get(event, "startDate")),
        "fecha_fin": dates.to_local_iso(_get(event, "endDate")),
        "imagen": F.coalesce(_get(event, "image[0]"), _get(event, "image.url"), _get(event, "image")),
    }


def _pages(payload: DataFrame) -> DataFrame:
    return payload.withColumns({"_event": markup.ld_of_type("html", ["Event", "ExhibitionEvent", "MusicEvent", "TheaterEvent", "BusinessEvent"]), "_links": markup.links("html"), "_text": text.strip_html("html"), "_lines": text.lines(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", ""), r"(?i)</?(p|div|li|h[1-6]|br|tr|section|article)\b[^>]*>", "\n"))})


def _lines_text() -> Column:
    return F.transform("_lines", text.strip_html)


def _bought(words: list[str] = TICKETS, hosts: list[str] = ()) -> Column:
    joined = text.let(markup.purchase_link("_links", words, hosts), lambda link: urls.join_url(link, "url"))
    return text.let(joined, urls.web_url)


@adapter("esmadrid", "html", "url string, html string, category string")
def city_guide(payload: DataFrame) -> DataFrame:
    """C2, G5, G8, J1, M6. Pages found under categories; an address that several plans sell at is no plan's."""
    cats = payload.groupBy("url").agg(F.array_sort(F.collect_set("category")).alias("categorias"), F.first("html").alias("html"))
    df = _pages(cats)
    out = records(df.where("_event is not null"), id=urls.last_segment("url"), url=F.col("url"), **_event(F.col("_event")), categorias=F.col("categorias"), url_compra=_bought())
    return shared_purchase_urls(out.withColumns({"fuente": F.lit("esmadrid"), "metadata": F.create_map().cast("map<string,string>")}))


@adapter("eventbrite", "html", "url string, html string, category string")
def ticket_lists(payload: DataFrame) -> DataFrame:
    """C4, G10, J1, M6. Listing pages with item lists; the first of an address counts; placeholder pictures don't."""
    each = payload.select("category", F.explode(markup.ld_objects("html")).alias("e")).withColumn("_ord", F.monotonically_increasing_id())
    each = each.withColumn("u", _get(F.col("e"), "url")).where("u is not null")
    first = each.groupBy("u").agg(F.min("_ord").alias("_ord"), F.min_by("e", "_ord").alias("e"), F.min_by("category", "_ord").alias("category"))
    fields = _event(F.col("e"))
    return records(first, id=F.regexp_extract("u", r"(\d+)(?:\?|$)", 1), url=urls.normalize_url("u"), url_compra=F.col("u"), **{k: v for k, v in fields.items() if k != "imagen"}, imagen=markup.first_real_image(F.array(fields["imagen"])), categorias=F.array("category"))


@adapter("ifema_madrid", "html")
def fairs(payload: DataFrame) -> DataFrame:
    """C18, J1, G9, P5. Calendar pages with an event's data for each card; the last card of an address counts."""
    each = payload.select(F.explode(markup.ld_objects("html")).alias("e")).withColumn("_ord", F.monotonically_increasing_id()).withColumn("u", _get(F.col("e"), "url")).where("u is not null")
    last = each.groupBy("u").agg(F.min("_ord").alias("_first"), F.max_by("e", "_ord").alias("e")).withColumnRenamed("_first", "_ord")
    fields = _event(F.col("e"))
    here = in_scope(_get(F.col("e"), "location.address.addressLocality"), fields["titulo"], F.concat_ws(" ", fields["lugar"], fields["direccion"], F.lit("ifema madrid")), [])
    return records(last.where(here), id=urls.last_segment("u"), url=F.col("u"), url_articulo=F.col("u"), **fields, categorias=F.array(F.lit("Ferias y Congresos")))


@adapter("fundacion_mapfre", "html")
def exhibitions(payload: DataFrame) -> DataFrame:
    """C17, J1, M6, H7. Exhibition pages with their event data."""
    df = _pages(payload).where("_event is not null")
    return records(df, id=urls.last_segment("url"), url=F.col("url"), url_articulo=F.col("url"), **_event(F.col("_event")), url_compra=_bought(), categorias=F.array(F.lit("Exposiciones")))


@adapter("circulo_bellas_artes", "html")
def arts_circle(payload: DataFrame) -> DataFrame:
    """C11, T22-T24, T34, M5, M14, D18, D26, U7. Detail pages read line by line."""
    df = _pages(payload).withColumns({"_title": text.pick_title(markup.headings("html"), F.coalesce(markup.page_title("html"), F.lit("")), ["agenda", "menú"]), "_plain": _lines_text()})
    core = text.between_lines("_plain", F.col("_title"), ["compartir", "newsletter", "también te puede interesar"])
    df = df.withColumns({"_core": core, "_days": dates.dmy_pair("_text"), "_point": numbers.map_link_point("html")})
    sessions = dates.section_sessions(F.array_join("_core", " "), F.substring(F.col("_days.first"), 1, 4).try_cast("int"))
    return records(df, id=urls.last_segment("url"), titulo=F.col("_title"), descripcion=text.paragraphs_text("_core"), precio=numbers.ranked_price("_text"), moneda=F.lit("EUR"), lugar=F.lit("Círculo de Bellas Artes"), direccion=F.lit("Calle de Alcalá, 42, Madrid"), latitud=F.col("_point.lat"), longitud=F.col("_point.lon"), fecha_inicio=F.col("_days.first"), fecha_fin=F.col("_days.last"), fechas_disponibles=sessions, url=urls.normalize_url("url"), url_compra=text.let(_bought(), lambda bought: F.when(urls.specific_purchase(bought, "url", ["actividad", "evento"]), bought)), imagen=markup.best_image(markup.image_candidates("html")), categorias=F.array(F.lit("Cultura")))


@adapter("casa_mexico", "html", "url string, html string, category string")
def culture_house(payload: DataFrame) -> DataFrame:
    """C12, A18, D14, D20, M4, T31. Pages found under categories, with dates in Spanish."""
    one = payload.withColumn("_k", F.monotonically_increasing_id()).groupBy("url").agg(F.min("_k").alias("_ord"), F.min_by("html", "_k").alias("html"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_k", "category"))), lambda s: s["category"])).alias("cats"))
    df = _pages(one).withColumns({"_span": dates.spanish_range("_text"), "_clock": dates.time_range("_text"), "_plain": _lines_text()})
    prose = F.filter("_plain", lambda x: text.looks_like_content(x, ["la ", "el ", "una ", "un ", "en "]))
    single = F.col("_span.first") == F.col("_span.last")
    at = lambda day, clock: F.when(single, dates.day_and_time(day.cast("string"), clock)).otherwise(day.cast("string"))
    return records(df, id=urls.last_segment("url"), titulo=F.coalesce(F.get(markup.headings("html"), F.lit(0)), markup.page_title("html")), descripcion=text.paragraphs_text(prose), precio=numbers.least_price("_text", free_first=True), moneda=F.lit("EUR"), lugar=F.lit("Casa de México"), direccion=F.lit("Calle de Alberto Aguilera, 20, Madrid"), fecha_inicio=at(F.col("_span.first"), F.col("_clock.first")), fecha_fin=at(F.col("_span.last"), F.coalesce("_clock.last", "_clock.first")), categorias=F.col("cats"), url=F.col("url"), url_compra=_bought(), imagen=markup.best_image(markup.image_candidates("html")))


@adapter("biblioteca_nacional", "html", "url string, html string, card string, place string")
def library(payload: DataFrame) -> DataFrame:
    """C15, D15, D25, M4, M8. Cards with their dates, pages with sessions; entry is free where nothing else is said."""
    df = _pages(payload).withColumn("_span", dates.card_dates("card"))
    year = F.substring(F.col("_span.first"), 1, 4).try_cast("int")
    sessions = dates.body_sessions("_text", year)
    return records(df, id=urls.last_segment("url"), titulo=F.coalesce(F.get(markup.headings("html"), F.lit(0)), markup.page_title("html")), descripcion=F.substring("_text", 1, 900), precio=numbers.price_or_policy(numbers.least_price("_text"), F.lit(True)), moneda=F.lit("EUR"), lugar=F.coalesce(text.sanitize_text("place"), F.lit("Biblioteca Nacional de España")), direccion=F.lit("Paseo de Recoletos, 20-22, Madrid"), fecha_inicio=F.col("_span.first"), fecha_fin=F.col("_span.last"), fechas_disponibles=F.when(F.size(sessions) > 0, sessions), url=F.col("url"), url_articulo=F.col("url"), categorias=F.array(F.lit("Lectura")))


def canal_foundation(payload: DataFrame, today: Column | None = None) -> DataFrame:
    """C16, D17, P3, G8. Archive pages with days as d/m/y; with `today` only those that aren't over."""
    one = payload.groupBy("url").agg(F.first("html").alias("html"), F.array_sort(F.collect_set("category")).alias("cats"))
    df = _pages(one).withColumn("_span", dates.dmy_fields("_text"))
    if today is not None:
        df = df.where(is_live(F.array("_span.first", "_span.last"), today))
    return records(df, id=urls.last_segment("url"), titulo=F.coalesce(F.get(markup.headings("html"), F.lit(0)), markup.page_title("html")), descripcion=F.substring("_text", 1, 900), precio=numbers.least_price("_text", free_first=True), moneda=F.lit("EUR"), lugar=F.lit("Fundación Canal"), direccion=F.lit("Calle de Mateo Inurria, 2, Madrid"), fecha_inicio=F.col("_span.first"), fecha_fin=F.col("_span.last"), categorias=F.col("cats"), url=urls.normalize_url("url"), url_compra=_bought(), imagen=markup.best_image(markup.image_candidates("html")))


adapter("fundacion_canal", "html", "url string, html string, category string")(canal_foundation)


@adapter("sala_el_sol", "html", "url string, html string, title string, day int, month int, position bigint, year int")
def concert_hall(payload: DataFrame) -> DataFrame:
    """C19, T16, D21, M4, T25. Concert pages; listings give day and month (years: with_years()), pages the times."""
    meta = text.meta_fields("_text", {"day": "Fecha:", "time": "Hora:", "price": "Entradas:", "kind": "Tipo:"})
    df = _pages(payload).withColumn("_meta", meta).withColumn("_clock", dates.time_range("_meta.time"))
    day = F.make_date("year", "month", "day")
    df = df.withColumn("_span", dates.overnight(day, F.col("_clock.first"), F.col("_clock.last")))
    body = F.array_join(text.collapse_paragraphs(F.filter(_lines_text(), lambda x: F.length(x) >= 60)), "\n\n")
    return records(df.withColumn("_ord", F.col("position")), id=urls.last_segment("url"), titulo=F.col("title"), descripcion=body, precio=numbers.least_price("_meta.price"), moneda=F.lit("EUR"), lugar=F.lit("Sala El Sol"), direccion=F.lit("Calle de los Jardines, 3, Madrid"), fecha_inicio=F.col("_span.first"), fecha_fin=F.col("_span.last"), categorias=F.array(F.lit("Música")), etiquetas=F.array(F.col("_meta.kind")), url=F.col("url"), url_compra=_bought())


def with_years(listing: DataFrame, today: Column) -> DataFrame:
    """D22. year of each card of a listing in order of position: the first card's, and one more at each step back."""
    from pyspark.sql import Window

    from plazaflow.operators.joins import infer_years

    cards = listing.withColumn("_md", F.col("month") * 100 + F.col("day")).withColumn("_all", F.lit(1))
    start = first_year(F.first("_md").over(Window.partitionBy("_all").orderBy("position")), today)  # a listing is one page
    return infer_years(cards.withColumn("_start", start), "_all", "position", "_md", 0).withColumn("year", (F.col("year") + F.col("_start")).cast("int")).drop("_md", "_all", "_start")


@adapter("timeout", "html")
def magazine(payload: DataFrame) -> DataFrame:
    """C21, J1, H6, T14. News pages: article data and the fullest container; or a proxy's markdown with its header lines."""
    article = markup.ld_of_type("html", ["NewsArticle", "Article"])
    header = lambda name: F.nullif(F.trim(F.regexp_extract("html", rf"(?m)^{name}:\s*(.+)$", 1)), F.lit(""))
    df = payload.withColumns({"_article": article, "_markdown": F.col("html").rlike(r"(?m)^URL Source:")})
    body = F.when(F.col("_markdown"), text.strip_markdown(F.regexp_replace("html", r"(?s)^.*?Markdown Content:\s*", ""))).otherwise(text.strip_html(F.coalesce(markup.best_container("html"), "html")))
    address = F.coalesce(header("URL Source"), F.col("url"))
    return records(df, id=urls.last_segment(address), titulo=F.coalesce(_get(F.col("_article"), "headline"), header("Title"), F.get(markup.headings("html"), F.lit(0)), markup.page_title("html")), descripcion=_get(F.col("_article"), "description"), contenido=body, autor=F.coalesce(_get(F.col("_article"), "author.name"), _get(F.col("_article"), "author[0].name")), url=address, url_articulo=address, imagen=F.coalesce(_get(F.col("_article"), "image.url"), _get(F.col("_article"), "image[0]"), markup.best_image(markup.image_candidates("html"))), fecha_publicacion=F.coalesce(_get(F.col("_article"), "datePublished"), header("Published Time")), fecha_actualizacion=_get(F.col("_article"), "dateModified"), categorias=arrays.distinct_text(F.array(_get(F.col("_article"), "articleSection"))), categoria=_get(F.col("_article"), "articleSection"))


