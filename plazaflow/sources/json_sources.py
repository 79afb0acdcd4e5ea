"""Adapters for JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.functions import arrays, dates, markup, numbers, text
from plazaflow.operators.predicates import holds_any, in_scope, sure
from plazaflow.plans import dims
from plazaflow.sources.registry import adapter, exploded, page_state, records

clean, filled = text.clean_text, text.first_filled
listed = lambda *c: arrays.distinct_text(F.array_compact(F.array(*c)))


@adapter(
    "datos_madrid",
    "json",
    """`@graph` array<struct<id:string,`@id`:string,`@type`:string,title:string,description:string,price:string,free:int,dtstart:string,dtend:string,`excluded-days`:string,
    recurrence:struct<days:string,frequency:string,interval:int>,`event-location`:string,location:struct<latitude:double,longitude:double>,
    address:struct<area:struct<`street-address`:string>,district:struct<`@id`:string>>,link:string>>""",
)
def open_data(payload: DataFrame) -> DataFrame:
    """C1. Open-data events: weekly recurrences become days, free texts prices, type addresses labels."""
    df = exploded(payload, "`@graph`").withColumns({"_start": dates.parse_temporal("x.dtstart"), "_end": dates.parse_temporal("x.dtend")})
    day = dates.weekly(F.col("_start.d"), F.col("_end.d"), F.col("x.recurrence.days"), F.coalesce("x.recurrence.interval", F.lit(1)), F.col("x.excluded-days"))
    clock = F.when(F.col("_start.has_time"), F.date_format("_start.ts", "'T'HH:mm:ss")).otherwise("")
    weekly = sure((F.col("x.recurrence.frequency") == "WEEKLY") & F.col("_end").isNotNull() & (F.coalesce("x.recurrence.days", F.lit("")) != ""))
    times = F.when(F.col("_start").isNull(), F.array().cast("array<string>")).when(weekly, F.transform(day, lambda d: F.concat(d.cast("string"), clock))).otherwise(F.array(F.col("x.dtstart")))
    df = df.withColumn("_price", numbers.text_price("x.price", F.col("x.free"), F.col("x.title")))
    district = F.element_at(F.split(F.regexp_replace("x.address.district.@id", "/+$", ""), "/"), -1)
    return records(
        df,
        id=F.coalesce("x.id", "x.@id"),
        titulo=F.col("x.title"),
        precio=F.col("_price.precio"),
        moneda=F.col("_price.moneda"),
        lugar=F.col("x.event-location"),
        direccion=F.coalesce(F.nullif(F.concat_ws(", ", F.nullif("x.address.area.street-address", F.lit("")), F.nullif(district, F.lit(""))), F.lit("")), F.lit("Madrid")),
        latitud=F.col("x.location.latitude"),
        longitud=F.col("x.location.longitude"),
        fecha_inicio=F.col("x.dtstart"),
        fecha_fin=F.col("x.dtend"),
        fechas_disponibles=times,
        categorias=F.array(text.camel_words("x.@type")),
        url=F.col("x.link"),
        descripcion=F.substring("x.description", 1, 500),
    )


FEVER_PLANS = "array<struct<id:string,name:string,cover_image:string,price_info:struct<amount:double,currency:string,hide:boolean>,location:struct<name:string,is_hidden:boolean>,first_active_session_date:string,last_active_session_date:string,rating:struct<average:double,num_ratings:bigint>,url:string>>"


@adapter(
    "fever",
    "json",
    f"category string, plans {FEVER_PLANS}",
)
def fever(payload: DataFrame) -> DataFrame:
    """C3, G8. Listing pages by category; a plan found in several has all their labels, sorted."""
    df = exploded(payload, "plans")
    one = df.groupBy("x.id").agg(F.min("_ord").alias("_ord"), F.min_by("x", "_ord").alias("x"), F.array_sort(F.collect_set("category")).alias("cats"))
    shown = F.when(~F.coalesce("x.price_info.hide", F.lit(False)), F.col("x.price_info.amount"))
    return records(one, id=F.col("x.id"), titulo=F.col("x.name"), imagen=F.col("x.cover_image"), precio=shown, moneda=F.col("x.price_info.currency"), lugar=F.when(~F.coalesce("x.location.is_hidden", F.lit(False)), F.col("x.location.name")), fecha_inicio=F.col("x.first_active_session_date"), fecha_fin=F.col("x.last_active_session_date"), categorias=F.col("cats"), url=F.coalesce("x.url", F.concat(F.lit("https://feverup.com/m/"), F.col("x.id"))), valoracion=F.col("x.rating.average"), num_valoraciones=F.col("x.rating.num_ratings"))


@page_state("fever")
def fever_state(pages: DataFrame) -> DataFrame:
    """C3, J2. Listing pages as saved: the plans of the first section that has any, in the state that the page carries."""
    state = F.from_json(markup.embedded_state("html", "serverApp-state"), f"map<string,struct<skeleton:array<struct<content:struct<plans:{FEVER_PLANS}>>>>>")
    parts = F.flatten(F.transform(F.filter(F.map_entries(state), lambda e: F.contains(e["key"], F.lit("WPFSkeleton")) & e["value"]["skeleton"].isNotNull()), lambda e: e["value"]["skeleton"]))
    return pages.select("category", F.get(F.filter(parts, lambda p: p["content"]["plans"].isNotNull()), F.lit(0))["content"]["plans"].alias("plans"))


PLACE = "struct<name:string,address:string,city:string,latitude:double,longitude:double>"


@adapter(
    "wegow",
    "json",
    "events array<struct<id:string,slug:string,title:string,subtitle:string,type:string,description:string,enabled:boolean,cancelation_status:int,start_date:string,end_date:string,price:string,min_price:string,max_price:string,currency:string,venue:struct<name:string,address:string,latitude:double,longitude:double>,city:struct<name:string>,artists:array<struct<name:string>>,permalink:string,purchase_url:string,image_url:string>>",
)
def wegow(payload: DataFrame) -> DataFrame:
    """C5, G9, M7, P5. Last version of each event; enabled, not cancelled and in the city."""
    df = exploded(payload, "events")
    last = df.groupBy("x.id").agg(F.min("_ord").alias("_first"), F.max_by("x", "_ord").alias("x")).withColumnRenamed("_first", "_ord")
    evidence = F.concat_ws(" ", *(f"x.{c}" for c in ("title", "subtitle", "description", "permalink", "purchase_url", "venue.name", "venue.address", "city.name", "slug")))
    good = sure(F.col("x.enabled") & (F.coalesce("x.cancelation_status", F.lit(0)) == 0)) & in_scope("x.city.name", "x.title", evidence, []) & (clean("x.slug") != "") & (clean("x.title") != "")
    festival = F.when(holds_any("x.description", ["festival", "fest "]), F.lit("Festivales"))
    return records(last.where(good), id=F.col("x.id"), titulo=F.col("x.title"), subtitulo=F.col("x.subtitle"), descripcion=filled("x.description", "x.title"), precio=numbers.first_number("x.price", "x.min_price", "x.max_price"), moneda=F.col("x.currency"), lugar=filled("x.venue.name", "x.city.name"), direccion=filled("x.venue.address", "x.city.name"), latitud=F.col("x.venue.latitude"), longitud=F.col("x.venue.longitude"), fecha_inicio=F.col("x.start_date"), fecha_fin=F.col("x.end_date"), categorias=listed(festival, F.lit("Musica")), etiquetas=arrays.distinct_text(F.transform("x.artists", lambda a: a["name"])), url=F.col("x.permalink"), url_compra=F.col("x.purchase_url"), imagen=F.col("x.image_url"))


TICKETS = "array<struct<id:string,discoveryId:string,title:string,url:string,partnerEvent:boolean,isPartner:boolean,dates:struct<startDate:string>,venue:struct<name:string,addressLineOne:string,city:string,latitude:double,longitude:double,imageUrl:string>,artists:array<struct<name:string,imageUrls:map<string,string>>>>>"


@adapter(
    "ticketmaster",
    "json",
    f"events {TICKETS}",
)
def ticketmaster(payload: DataFrame) -> DataFrame:
    """C6, G6, G7, A19. Dates of one title, venue and address are one plan, led by its first date that is no partner's."""
    df = exploded(payload, "events").where(clean("x.title") != "")
    partner = F.coalesce("x.partnerEvent", F.lit(False)) | F.coalesce("x.isPartner", F.lit(False))
    lead = F.struct(partner, F.coalesce("x.dates.startDate", F.lit("")), F.col("_ord"))
    one = df.groupBy(clean("x.title"), clean("x.venue.name"), clean("x.url")).agg(F.min("_ord").alias("_ord"), F.min_by("x", lead).alias("x"), F.transform(F.array_sort(F.collect_list(F.struct("_ord", F.col("x.dates.startDate").alias("at"), F.col("x.id").alias("id")))), lambda s: s).alias("all"))
    one = one.withColumn("times", arrays.session_values(F.transform("all", lambda s: s["at"]))).where(F.size("times") > 0)
    native = F.when(F.lower("x.url").rlike(r"^https?://([^/]*\.)?ticketmaster\.es(/|$)"), F.col("x.url"))
    art = F.flatten(F.transform("x.artists", lambda a: F.array(*(F.try_element_at(a["imageUrls"], F.lit(k)) for k in ("EVENT_DETAIL_PAGE_16_9", "RETINA_PORTRAIT_16_9", "ARTIST_PAGE_3_2")))))
    return records(one, id=F.get(arrays.distinct_text(F.transform("all", lambda s: s["id"])), F.lit(0)), titulo=F.col("x.title"), descripcion=F.col("x.title"), moneda=F.lit("EUR"), lugar=F.col("x.venue.name"), direccion=F.nullif(F.concat_ws(", ", "x.venue.addressLineOne", "x.venue.city"), F.lit("")), latitud=F.col("x.venue.latitude"), longitud=F.col("x.venue.longitude"), fecha_inicio=F.get("times", F.lit(0)), fecha_fin=F.element_at("times", -1), fechas_disponibles=F.col("times"), etiquetas=arrays.distinct_text(F.transform("x.artists", lambda a: a["name"])), url=F.coalesce(native, "x.url"), url_articulo=F.col("x.url"), url_compra=native, imagen=markup.first_real_image(F.concat(F.coalesce(art, F.array().cast("array<string>")), F.array(F.col("x.venue.imageUrl")))), url_fuente_editorial=F.col("x.url"))


@page_state("ticketmaster")
def ticketmaster_state(pages: DataFrame) -> DataFrame:
    """C6, J2. Discovery pages as saved: the answer to the first query for a city's events that the page carries."""
    queries = F.from_json(F.get_json_object(markup.embedded_state("html", "__NEXT_DATA__"), "$.props.pageProps.initialReduxState.api.queries"), "map<string,string>")
    first = F.get(F.filter(F.map_entries(queries), lambda e: F.startswith(e["key"], F.lit("cityEvents("))), F.lit(0))["value"]
    return pages.select(F.from_json(F.get_json_object(first, "$.data.events"), TICKETS).alias("events"))


@adapter(
    "meetup",
    "json",
    "edges array<struct<node:struct<id:string,title:string,dateTime:string,endTime:string,eventUrl:string,eventType:string,description:string,venue:struct<name:string,address:string,city:string,lat:double,lon:double>,`group`:struct<name:string,urlname:string>,featuredEventPhoto:struct<highResUrl:string>,feeSettings:struct<amount:double,currency:string>>>>",
)
def meetup(payload: DataFrame) -> DataFrame:
    """C7, A16, P5, M15. Gatherings near the city that aren't online; labels by words of title and group."""
    df = exploded(payload, "edges").withColumn("n", F.col("x.node"))
    online = holds_any(F.concat_ws(" ", "n.eventType", "n.venue.name", "n.venue.address", "n.venue.city"), ["online", "virtual", "zoom"])
    blob = F.lower(F.concat_ws(" ", clean("n.title"), clean("n.group.name")))
    return records(df.where(numbers.near_city("n.venue.lat", "n.venue.city") & ~online & (clean("n.title") != "")), id=F.col("n.id"), titulo=F.col("n.title"), descripcion=text.strip_html("n.description"), lugar=F.col("n.venue.name"), direccion=F.nullif(F.concat_ws(", ", F.nullif("n.venue.address", F.lit("")), F.nullif("n.venue.city", F.lit(""))), F.lit("")), latitud=F.col("n.venue.lat"), longitud=F.col("n.venue.lon"), precio=F.coalesce("n.feeSettings.amount", F.lit(0.0)), moneda=F.coalesce("n.feeSettings.currency", F.lit("EUR")), fecha_inicio=dates.to_local_iso("n.dateTime"), fecha_fin=dates.to_local_iso("n.endTime"), categorias=arrays.keyword_labels(blob, dims.COMMUNITY_LABELS, ["Comunidad"]), autor=F.col("n.group.name"), url=F.col("n.eventUrl"), imagen=F.col("n.featuredEventPhoto.highResUrl"))


@adapter(
    "rockthesport",
    "json",
    "items array<struct<eventId:string,provinceId:int,name:string,subtitle:string,description:string,sport:string,modality:string,distance:string,place:string,address:string,city:string,province:string,latitude:double,longitude:double,eventStartDate:string,eventEndDate:string,price:string,minPrice:string,registrationUrl:string,imageUrl:string,createdDate:string,modifiedDate:string>>",
)
def races(payload: DataFrame) -> DataFrame:
    """C8, G10, A15. First version of each race of the province; labels by sport."""
    df = exploded(payload, "items")
    first = df.groupBy("x.eventId").agg(F.min("_ord").alias("_ord"), F.min_by("x", "_ord").alias("x"))
    near = holds_any(F.concat_ws(" ", "x.city", "x.province", "x.place", "x.address"), ["madrid"])
    sport = listed(F.lit("Deportes"), F.initcap(clean("x.sport")))
    page = F.concat(F.lit("https://www.rockthesport.com/es/evento/"), F.col("x.eventId"))
    start, end = dates.to_local_iso("x.eventStartDate"), dates.to_local_iso("x.eventEndDate")
    return records(first.where(near & (clean("x.name") != "")), id=F.col("x.eventId"), titulo=F.col("x.name"), subtitulo=filled("x.subtitle", "x.sport"), descripcion=filled("x.description", "x.name"), categorias=sport, etiquetas=listed(F.col("x.sport"), F.col("x.modality"), F.col("x.distance")), lugar=filled("x.place", "x.city"), direccion=F.nullif(F.concat_ws(", ", F.nullif("x.address", F.lit("")), F.nullif("x.city", F.lit(""))), F.lit("")), latitud=F.col("x.latitude"), longitud=F.col("x.longitude"), precio=numbers.first_number("x.price", "x.minPrice"), moneda=F.lit("EUR"), fecha_inicio=start, fecha_fin=F.coalesce(end, start), fechas_disponibles=listed(start, end), url=page, url_articulo=page, url_compra=F.when(F.col("x.registrationUrl").rlike("(?i)^https?://"), F.col("x.registrationUrl")), imagen=F.col("x.imageUrl"), fecha_publicacion=dates.to_local_iso("x.createdDate"), fecha_actualizacion=dates.to_local_iso("x.modifiedDate"))


TEXT = "struct<processed:string>"
REFS = "struct<data:array<struct<type:string,id:string>>>"


@adapter(
    "matadero",
    "json",
    f"data array<struct<id:string,attributes:struct<title:string,langcode:string,path:struct<alias:string>,field_subtitle:string,field_init_date:string,field_end_date:string,field_ocurrences:array<struct<value:string>>,field_price:{TEXT},field_place:{TEXT},body:{TEXT},field_teaser:{TEXT},created:string,changed:string>,relationships:struct<field_category:{REFS},field_institution:{REFS}>>>, included array<struct<type:string,id:string,attributes:struct<name:string,title:string>>>",
)
def arts_centre(payload: DataFrame) -> DataFrame:
    """C9, Q1, J3, M4, M13. JSON:API: relationships are resolved against what the same document includes, in its row: no
    document needs a number of its own, nor a shuffle. Translations are left out."""
    items = exploded(payload, "data")

    def resolved(field: str) -> Column:
        names = lambda r: F.transform(F.filter("included", lambda i: (i["type"] == r["type"]) & (i["id"] == r["id"])), lambda i: F.coalesce(i["attributes"]["name"], i["attributes"]["title"]))
        refs = F.coalesce(f"x.relationships.{field}.data", F.array().cast("array<struct<type:string,id:string>>"))
        return F.array_compact(F.transform(refs, lambda r: F.get(names(r), F.lit(0))))

    df = items.withColumns({f: resolved(f) for f in ("field_category", "field_institution")})
    a = "x.attributes."
    place = filled(text.strip_html(f"{a}field_place.processed"), text.institution_name(F.get("field_institution", F.lit(0))), F.lit("Matadero Madrid"))
    price = text.strip_html(f"{a}field_price.processed")
    here = numbers.hinted([(place, ["movistar koi"], False), (place, ["matadero", "cineteca", "nave", "casa del lector", "auditorio", "aulas", "cantina", "patio"], True), (F.get("field_institution", F.lit(0)), ["matadero", "cineteca", "intermediae"], True)])
    url = F.concat(F.lit("https://www.mataderomadrid.org"), F.col(f"{a}path.alias"))
    spanish = sure((F.coalesce(f"{a}langcode", F.lit("es")) != "en") & ~F.startswith(F.coalesce(f"{a}path.alias", F.lit("")), F.lit("/schedule/")))
    about = filled(text.strip_html(f"{a}body.processed"), text.strip_html(f"{a}field_teaser.processed"))
    return records(df.where(spanish), id=F.col("x.id"), titulo=F.col(f"{a}title"), subtitulo=F.col(f"{a}field_subtitle"), descripcion=about, contenido=about, precio=numbers.least_price(price, adjacent=False, free_first=True), moneda=F.when(price != "", F.lit("EUR")), lugar=place, direccion=F.when(here, F.lit("Plaza de Legazpi, 8, Madrid")), latitud=F.when(here, F.lit(40.3925)), longitud=F.when(here, F.lit(-3.6977)), fecha_inicio=F.col(f"{a}field_init_date"), fecha_fin=F.col(f"{a}field_end_date"), fechas_disponibles=F.transform(f"{a}field_ocurrences", lambda o: o["value"]), categorias=arrays.categories_but("field_category", [], ["Cultura"]), url=url, url_articulo=url, fecha_publicacion=F.col(f"{a}created"), fecha_actualizacion=F.col(f"{a}changed"))


@adapter("teatros_canal", "json", "events array<struct<id:string,title:string,excerpt:string,url:string,start_date:string,end_date:string,all_day:boolean,categories:array<struct<name:string>>,tags:array<struct<name:string>>,image:struct<url:string>,detail:string>>")
def theatres(payload: DataFrame) -> DataFrame:
    """C10, D30, M5, T17-T19. Events with the text of their page."""
    df = exploded(payload, "events")
    detail = text.strip_html("x.detail")
    return records(df, id=F.col("x.id"), titulo=text.strip_html("x.title"), descripcion=filled(text.strip_html("x.excerpt"), detail), contenido=text.trim_at(detail, ["Compra de entradas", "Ficha artística"], ["Sinopsis", "Información"]), precio=numbers.ranked_price(detail), moneda=F.lit("EUR"), lugar=F.coalesce(text.before_pattern(text.slice_between(detail, "Lugar:"), r"(?i)Duraci[oó]n\s*:"), F.lit("Teatros del Canal")), fecha_inicio=dates.all_day("x.start_date"), fecha_fin=dates.all_day("x.end_date"), categorias=arrays.categories_but(F.transform("x.categories", lambda c: c["name"]), ["destacados", "portada"], ["Artes escénicas"]), etiquetas=arrays.tags(F.transform("x.tags", lambda c: c["name"])), url=F.col("x.url"), url_articulo=F.col("x.url"), imagen=F.col("x.image.url"))


POST = "id string, slug string, link string, date_gmt string, modified_gmt string, title struct<rendered:string>, excerpt struct<rendered:string>, content struct<rendered:string>, _embedded struct<author:array<struct<name:string>>,`wp:featuredmedia`:array<struct<source_url:string>>,`wp:term`:array<array<struct<taxonomy:string,name:string>>>>"


def _post(df: DataFrame) -> dict:
    """Fields that all posts have."""
    body = text.strip_html("content.rendered")
    return {"id": F.col("id"), "titulo": text.strip_html("title.rendered"), "resumen": text.strip_html("excerpt.rendered"), "descripcion": filled(text.strip_html("excerpt.rendered"), body), "contenido": body, "autor": F.get("_embedded.author", F.lit(0))["name"], "url": F.col("link"), "url_articulo": F.col("link"), "imagen": F.get("_embedded.wp:featuredmedia", F.lit(0))["source_url"], "fecha_publicacion": dates.gmt_iso("date_gmt"), "fecha_actualizacion": dates.gmt_iso("modified_gmt")}


@adapter("gacetin_madrid", "json", POST)
def gazette(payload: DataFrame) -> DataFrame:
    """C20, J4, D31. News posts with their labels."""
    cats = arrays.categories_but(markup.terms("_embedded.wp:term", "category"), ["portada"], ["Actualidad"])
    return records(payload, **_post(payload), categorias=cats, categoria=F.get(cats, F.lit(0)), etiquetas=arrays.tags(markup.terms("_embedded.wp:term", "post_tag")))


@adapter("espacio_fundacion_telefonica", "json", POST + ", html string")
def foundation(payload: DataFrame) -> DataFrame:
    """C13, J1, J4, D16. Posts with their page's event data; entry is free."""
    event = markup.ld_of_type("html", ["Event", "ExhibitionEvent"])
    when = lambda k: F.coalesce(F.get_json_object(event, f"$.{k}"), dates.date_label(F.regexp_extract(text.strip_html("html"), r"(?i)(\d{1,2}\s+[a-záéíóú]+\s+\d{4})", 1)))
    english = F.contains(F.coalesce("link", F.lit("")), F.lit("/en/"))
    return records(payload.where(~english), **_post(payload), precio=F.lit(0.0), moneda=F.lit("EUR"), lugar=F.lit("Espacio Fundación Telefónica"), direccion=F.lit("Calle de Fuencarral, 3, Madrid"), fecha_inicio=when("startDate"), fecha_fin=when("endDate"), categorias=arrays.categories_but(markup.terms("_embedded.wp:term", "category"), [], ["Cultura"]))


@adapter("museo_reina_sofia", "json", "results array<struct<url:struct<path:string>,title:string,summary:string,body:string,place:string,price:string,template:string,image:string,processedDates:array<struct<value:bigint>>,created:bigint>>")
def museum(payload: DataFrame) -> DataFrame:
    """C14, D28, M4. Search results with dates in Unix seconds; the same address once, its last version."""
    df = exploded(payload, "results").withColumn("times", F.array_sort(F.transform("x.processedDates", lambda d: dates.epoch_iso(d["value"]))))
    last = df.groupBy("x.url.path").agg(F.min("_ord").alias("_first"), F.max_by(F.struct("x", "times"), "_ord").alias("r")).select(F.col("_first").alias("_ord"), "r.*")
    page = F.concat(F.lit("https://www.museoreinasofia.es"), F.col("x.url.path"))
    return records(last, id=F.col("x.url.path"), titulo=F.col("x.title"), descripcion=text.strip_html("x.summary"), contenido=text.strip_html("x.body"), precio=numbers.least_price("x.price"), moneda=F.lit("EUR"), lugar=F.coalesce(text.sanitize_text("x.place"), F.lit("Museo Reina Sofía")), fecha_inicio=F.get("times", F.lit(0)), fecha_fin=F.try_element_at("times", F.lit(-1)), fechas_disponibles=F.col("times"), categorias=F.array(F.lit("Arte")), url=page, url_articulo=page, imagen=F.col("x.image"), fecha_publicacion=dates.epoch_iso("x.created"))


@adapter("madrid_secreto", "json", "id string, titulo string, descripcion string, contenido string, precio string, moneda string, lugar string, direccion string, fecha_inicio string, fecha_fin string, categorias array<string>, url string, url_articulo string, imagen string, fecha_publicacion string")
def editorial(payload: DataFrame) -> DataFrame:
    """C22. A feed of raw records as they are: only the contract of this source is known."""
    return payload
