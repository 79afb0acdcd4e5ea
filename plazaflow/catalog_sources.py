"""Queries of the source adapters: payloads made of the tables' values, so that SQL knows the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazaflow.catalog_functions import num, said
from plazaflow.plans import fixtures
from plazaflow.plans.fixtures import dealt, table
from plazaflow.register import query
from plazaflow.sources import extract
from plazaflow.sources.page_sources import with_years
from plazaflow.sources.registry import SCHEMAS

SHOWN = ["id", "titulo", "precio", "lugar", "fecha_inicio", "categorias", "url"]
#: Parts with a day of 2026 in SQL: p.
P = "WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_size AS size, DATE '2026-01-01' + CAST(p_partkey % 300 AS INTEGER) AS day FROM part)"


def parts(spark, d):
    p = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    return p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")).alias("day"))


def shown(raw, *more):
    """Fields of raw records, lists joined."""
    return raw.select(*(F.coalesce(F.array_join("categorias", "|"), F.lit("")).alias(c) if c == "categorias" else F.col(c).cast("double").alias(c) if c == "precio" else F.col(c) for c in SHOWN), *more)


def from_json(df, name, text):
    """Records of an adapter from JSON texts, one payload a row."""
    payload = df.select(F.from_json(text, SCHEMAS[name]).alias("p")).select("p.*")
    return extract(payload, name)


def from_pages(df, name, **columns):
    return extract(df.select(*(c.alias(n) for n, c in columns.items())), name)


def columns(*names):
    """Columns of parts(), some as text."""
    made = {"K": F.col("k"), "NAME": F.col("name"), "BRAND": F.col("brand"), "SIZE": F.col("size"), "DAY": F.col("day"), "KEY": num(F.col("k")), "ISO": num(F.col("day"))}
    return [made[n] for n in names]


def page(title, body, event=None):
    """A page's HTML of columns: its heading, its body, and an event's data."""
    ld = said('<script type="application/ld+json">', event, "</script>") if event is not None else F.lit("")
    return said("<html><head><title>Página</title>", ld, "</head><body><h1>", title, "</h1>", body, "</body></html>")


def event(url=None):
    """An event's data as JSON-LD."""
    NAME, BRAND, SIZE, KEY, ISO = columns("NAME", "BRAND", "SIZE", "KEY", "ISO")
    more = said(',"url":"', url, '"') if url is not None else F.lit("")
    return said('{"@type":"Event","name":"', NAME, ' &amp; Co","startDate":"', ISO, 'T20:00","endDate":"', ISO, '","location":{"name":"Sala ', BRAND, '","address":{"streetAddress":"Calle ', KEY, '","addressLocality":"Madrid"}},"offers":[{"price":"', num(SIZE + 5), '","priceCurrency":"EUR"},{"price":"', num(SIZE), '"}]', more, "}")


@query(f"""{P} SELECT 'd' || k AS id, name AS titulo, CASE WHEN k % 2 = 0 THEN 0.0 ELSE CAST(size AS DOUBLE) END AS precio, 'Centro ' || brand AS lugar, day || 'T19:00:00' AS fecha_inicio, 'Danza Baile' AS categorias, 'https://m/' || k AS url, 'Calle ' || k || ', Retiro' AS direccion,
  CASE WHEN k % 3 = 0 THEN CAST(3 AS INTEGER) ELSE 1 END AS n_days, CASE WHEN k % 3 = 0 THEN (day + 14) || 'T19:00:00' ELSE day || 'T19:00:00' END AS last_day FROM p""")
def source_datos_madrid(spark, d):
    """C1, D23, M3, T20."""
    K, NAME, BRAND, SIZE, DAY, KEY, ISO = columns("K", "NAME", "BRAND", "SIZE", "DAY", "KEY", "ISO")
    codes = F.get(F.array(*map(F.lit, ["MO", "TU", "WE", "TH", "FR", "SA", "SU"])), F.weekday(DAY))
    weekly = F.when(K % 3 == 0, said(',"recurrence":{"days":"', codes, '","frequency":"WEEKLY","interval":1}')).otherwise("")
    text = said('{"@graph":[{"id":"d', KEY, '","@type":"x/DanzaBaile","title":"', NAME, '","price":"', F.when(K % 2 == 0, "Gratis").otherwise(said("Entrada: ", num(SIZE), " euros")), '","dtstart":"', ISO, 'T19:00:00","dtend":"', num(F.date_add(DAY, 14)), 'T21:00:00"', weekly, ',"event-location":"Centro ', BRAND, '","address":{"area":{"street-address":"Calle ', KEY, '"},"district":{"@id":"http://d/Retiro"}},"link":"https://m/', KEY, '"}]}')
    raw = from_json(parts(spark, d), "datos_madrid", text)
    return shown(raw, "direccion", F.size("fechas_disponibles").alias("n_days"), F.element_at("fechas_disponibles", -1).alias("last_day"))


@query(f"{P}, g AS (SELECT brand, list_sort(list(DISTINCT CASE WHEN size % 2 = 0 THEN 'Par' ELSE 'Impar' END)) AS cats, min(size) FILTER (WHERE k = f) AS price, min(f) AS f, min(name) FILTER (WHERE k = f) AS name FROM (SELECT *, min(k) OVER (PARTITION BY brand) AS f FROM p) GROUP BY brand) SELECT brand AS id, 'Plan ' || brand AS titulo, array_to_string(cats, '|') AS categorias, 'https://feverup.com/m/' || brand AS url FROM g")
def source_fever(spark, d):
    """Pages with their state; a plan found in several listings has all their labels."""
    BRAND, SIZE = columns("BRAND", "SIZE")
    plan = said('{"id":"', BRAND, '","name":"Plan ', BRAND, '","location":{"name":"X","is_hidden":true}}')
    state = said('{"other":{"x":1},"key-WPFSkeleton-1":{"skeleton":[{"content":{"title":"x"}},{"content":{"plans":[', plan, '],"total_plans":1}}]}}')
    html = said('<html><script id="serverApp-state" type="application/json">', state, "</script></html>")
    raw = from_pages(parts(spark, d), "fever", url=F.lit("https://f"), html=html, category=F.when(SIZE % 2 == 0, "Par").otherwise("Impar"))
    return raw.select("id", "titulo", F.array_join("categorias", "|").alias("categorias"), "url")


@query(f"{P}, x AS (SELECT *, k // 2 AS e FROM p), l AS (SELECT e, arg_max(k, k) AS k, arg_max(name, k) AS name, arg_max(brand, k) AS brand, arg_max(size, k) AS size, arg_max(day, k) AS day FROM x GROUP BY e) SELECT CAST(e AS VARCHAR) AS id, name || ' en Madrid' AS titulo, CAST(size AS DOUBLE) AS precio, 'Sala ' || brand AS lugar, CAST(day AS VARCHAR) AS fecha_inicio, CASE WHEN k % 2 = 0 THEN 'Festivales|Musica' ELSE 'Musica' END AS categorias, 'https://w/' || k AS url FROM l WHERE k % 5 > 0")
def source_wegow(spark, d):
    """The last version of an event, unless it is cancelled."""
    K, NAME, BRAND, SIZE, KEY, ISO = columns("K", "NAME", "BRAND", "SIZE", "KEY", "ISO")
    one = said('{"id":"', num(F.floor(K / 2)), '","slug":"s', KEY, '","title":"', NAME, ' en Madrid","enabled":true,"cancelation_status":', F.when(K % 5 == 0, "1").otherwise("0"), ',"price":"a consultar","min_price":"', num(SIZE), '","start_date":"', ISO, '","venue":{"name":"Sala ', BRAND, '"},"city":{"name":"Madrid"},"description":"', F.when(K % 2 == 0, "Gran festival").otherwise("Nada"), '","permalink":"https://w/', KEY, '"}')
    p = parts(spark, d).groupBy(F.lit(1)).agg(F.array_sort(F.collect_list(F.struct("k", one.alias("j")))).alias("all"))  # the fixture's payload is one listing
    return shown(from_json(p, "wegow", said('{"events":[', F.array_join(F.transform("all", lambda x: x["j"]), ","), "]}")))


@query(f"""{P}, g AS (SELECT name, brand, size, day, k, row_number() OVER (PARTITION BY name, brand ORDER BY CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, day || 'T2' || k % 2, k) AS r, list(DISTINCT CAST(day AS VARCHAR)) OVER (PARTITION BY name, brand) AS days, list(DISTINCT day || 'T2' || k % 2) OVER (PARTITION BY name, brand) AS times FROM p)
SELECT name AS titulo, 'Sala ' || brand AS lugar, 'https://www.ticketmaster.es/' || replace(name, ' ', '-') AS url, CAST(len(days) AS INTEGER) AS n_days, len(days) < len(times) OR len(times) > 10 AS whole_days FROM g WHERE r = 1""")
def source_ticketmaster(spark, d):
    """Pages with their state; dates of one title and venue are one plan."""
    K, NAME, BRAND, KEY, ISO = columns("K", "NAME", "BRAND", "KEY", "ISO")
    one = said('{"id":"', KEY, '","title":"', NAME, '","url":"https://www.ticketmaster.es/', F.replace(NAME, F.lit(" "), F.lit("-")), '","isPartner":', F.when(K % 3 == 0, "true").otherwise("false"), ',"dates":{"startDate":"', ISO, "T2", num(K % 2), ':00"},"venue":{"name":"Sala ', BRAND, '"}}')
    p = parts(spark, d).groupBy("name", "brand").agg(F.array_sort(F.collect_list(F.struct("k", one.alias("j")))).alias("all"))
    answer = said('{"other":{},"cityEvents({x})":{"data":{"events":[', F.array_join(F.transform("all", lambda x: x["j"]), ","), "]}}}")
    html = said('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"initialReduxState":{"api":{"queries":', answer, "}}}}}</script>")
    raw = from_pages(p, "ticketmaster", url=F.lit("https://t"), html=html, category=F.lit("x"))
    days = F.array_distinct(F.transform("fechas_disponibles", lambda x: F.substring(x, 1, 10)))
    return raw.select("titulo", "lugar", "url", F.size(days).alias("n_days"), (F.length(F.col("fechas_disponibles")[0]) == 10).alias("whole_days"))


@query(f"{P} SELECT 'm' || k AS id, name || ' and salsa' AS titulo, CASE WHEN k % 2 = 0 THEN CAST(size AS DOUBLE) ELSE 0.0 END AS precio, 'Bar ' || brand AS lugar, day || 'T19:00:00+' || CASE WHEN day >= DATE '2026-03-29' AND day < DATE '2026-10-25' THEN '02' ELSE '01' END || ':00' AS fecha_inicio, 'Comunidad|Baile' AS categorias, 'https://meet/' || k AS url FROM p WHERE k % 4 < 2 AND k % 7 > 0")
def source_meetup(spark, d):
    """Near the city, not online."""
    K, NAME, BRAND, SIZE, KEY, ISO = columns("K", "NAME", "BRAND", "SIZE", "KEY", "ISO")
    lat = F.when(K % 4 < 2, "40.4").otherwise("10.5")
    fee = F.when(K % 2 == 0, said(',"feeSettings":{"amount":', num(SIZE), ',"currency":"EUR"}')).otherwise("")
    text = said('{"edges":[{"node":{"id":"m', KEY, '","title":"', NAME, ' and salsa","dateTime":"', ISO, 'T19:00:00","eventUrl":"https://meet/', KEY, '","eventType":"', F.when(K % 7 == 0, "ONLINE").otherwise("PHYSICAL"), '","venue":{"name":"Bar ', BRAND, '","city":"Madrid","lat":', lat, "}", fee, "}}]}")
    return shown(from_json(parts(spark, d), "meetup", text))


@query(f"{P} SELECT 'r' || k AS id, 'Carrera ' || name AS titulo, CAST(size AS DOUBLE) AS precio, 'Parque ' || brand AS lugar, day || 'T09:00:00+' || CASE WHEN day >= DATE '2026-03-29' AND day < DATE '2026-10-25' THEN '02' ELSE '01' END || ':00' AS fecha_inicio, 'Deportes|Trail' AS categorias, 'https://www.rockthesport.com/es/evento/r' || k AS url FROM p WHERE k % 3 > 0")
def source_rockthesport(spark, d):
    """Races of the province, the first version of each."""
    K, NAME, BRAND, SIZE, KEY, ISO = columns("K", "NAME", "BRAND", "SIZE", "KEY", "ISO")
    one = lambda name, price: said('{"eventId":"r', KEY, '","name":"', name, '","sport":"trail","place":"Parque ', BRAND, '","city":"', F.when(K % 3 == 0, "Sevilla").otherwise("Madrid"), '","eventStartDate":"', ISO, 'T09:00:00","minPrice":"', price, '"}')
    text = said('{"items":[', one(said("Carrera ", NAME), num(SIZE)), ",", one(F.lit("Otra versión"), F.lit("1")), "]}")
    return shown(from_json(parts(spark, d), "rockthesport", text))


@query(f"{P} SELECT 'e' || k AS id, name AS titulo, CASE WHEN k % 2 = 0 THEN 0.0 ELSE CAST(size AS DOUBLE) END AS precio, CASE WHEN k % 3 = 0 THEN 'Nave ' || size ELSE 'Institución ' || brand END AS lugar, CAST(day AS VARCHAR) AS fecha_inicio, 'Arte ' || brand AS categorias, 'https://www.mataderomadrid.org/p/' || k AS url FROM p")
def source_matadero(spark, d):
    """References resolved against what the page includes, translations left out."""
    K, NAME, BRAND, SIZE, KEY, ISO = columns("K", "NAME", "BRAND", "SIZE", "KEY", "ISO")
    price = F.when(K % 2 == 0, "<p>Entrada libre</p>").otherwise(said("<p>", num(SIZE), " €</p>"))
    place = F.when(K % 3 == 0, said("Nave ", num(SIZE))).otherwise("")
    item = said('{"id":"e', KEY, '","attributes":{"title":"', NAME, '","path":{"alias":"/p/', KEY, '"},"field_init_date":"', ISO, '","field_price":{"processed":"', price, '"},"field_place":{"processed":"', place, '"}},"relationships":{"field_category":{"data":[{"type":"c","id":"', BRAND, '"}]},"field_institution":{"data":[{"type":"i","id":"', BRAND, '"}]}}}')
    english = said('{"id":"x', KEY, '","attributes":{"title":"x","langcode":"en"}}')
    included = said('{"type":"c","id":"', BRAND, '","attributes":{"name":"Arte ', BRAND, '"}},{"type":"i","id":"', BRAND, '","attributes":{"title":"Institución ', BRAND, ' (3)"}},{"type":"c","id":"other","attributes":{"name":"No"}}')
    return shown(from_json(parts(spark, d), "matadero", said('{"data":[', item, ",", english, '],"included":[', included, "]}")))


@query(f"{P} SELECT 't' || k AS id, name || ' & Co' AS titulo, CAST(size AS DOUBLE) AS precio, 'Sala ' || brand AS lugar, CASE WHEN k % 2 = 0 THEN CAST(day AS VARCHAR) ELSE day || 'T20:30:00' END AS fecha_inicio, CASE WHEN k % 3 = 0 THEN 'Portada' ELSE 'Danza' END AS categorias, 'https://t/' || k AS url FROM p")
def source_teatros_canal(spark, d):
    """C10, D30, M5, T17-T19."""
    K, NAME, BRAND, SIZE, KEY, ISO = columns("K", "NAME", "BRAND", "SIZE", "KEY", "ISO")
    cats = F.when(K % 3 == 0, '[{"name":"Portada"}]').otherwise('[{"name":"Portada"},{"name":"Danza"}]')
    text = said('{"events":[{"id":"t', KEY, '","title":"', NAME, ' &amp; Co","url":"https://t/', KEY, '","start_date":"', ISO, F.when(K % 2 == 0, " 00:00:00").otherwise(" 20:30:00"), '","detail":"<p>Reducida: 1 €. Lugar: Sala ', BRAND, ". Duración: 60 min. Entrada general: ", num(SIZE), ' €</p>","categories":', cats, "}]}")
    return shown(from_json(parts(spark, d), "teatros_canal", text))


def post(more=""):
    """A post as JSON."""
    K, NAME, BRAND, KEY, ISO = columns("K", "NAME", "BRAND", "KEY", "ISO")
    return said('{"id":"', KEY, '","link":"https://g/', F.when(K % 5 == 0, "en/").otherwise(""), KEY, '","date_gmt":"', ISO, 'T10:00:00","title":{"rendered":"', NAME, ' &amp; Co"},"excerpt":{"rendered":"<p>Resumen</p>"},"content":{"rendered":"<p>Cuerpo</p>"},"_embedded":{"wp:term":[[{"taxonomy":"category","name":"Portada"},{"taxonomy":"category","name":"', BRAND, '"},{"taxonomy":"post_tag","name":"Etiqueta"}]]}', more, "}")


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name || ' & Co' AS titulo, brand AS categorias, 'https://g/' || CASE WHEN k % 5 = 0 THEN 'en/' ELSE '' END || k AS url, day || 'T10:00:00Z' AS published, 'Etiqueta' AS tags FROM p")
def source_gacetin_madrid(spark, d):
    """C20, J4, D31."""
    raw = from_json(parts(spark, d), "gacetin_madrid", post())
    return raw.select("id", "titulo", F.array_join("categorias", "|").alias("categorias"), "url", F.col("fecha_publicacion").alias("published"), F.array_join("etiquetas", "|").alias("tags"))


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name || ' & Co' AS titulo, 0.0 AS precio, 'Espacio Fundación Telefónica' AS lugar, CASE WHEN k % 2 = 0 THEN day || 'T20:00' ELSE CAST(day AS VARCHAR) END AS fecha_inicio, 'Portada|' || brand AS categorias, 'https://g/' || k AS url FROM p WHERE k % 5 > 0")
def source_espacio_fundacion_telefonica(spark, d):
    """The page's event data, else its date; English pages are left out."""
    K, NAME, DAY = columns("K", "NAME", "DAY")
    names = F.array(*map(F.lit, fixtures.dims.MONTHS_ES))
    spelled = said("<p>", num(F.dayofmonth(DAY)), " ", F.get(names, F.month(DAY) - 1), " ", num(F.year(DAY)), "</p>")
    quoted = lambda c: F.regexp_replace(c, '(["])', r'\\$1')
    html = F.when(K % 2 == 0, page(NAME, F.lit(""), event())).otherwise(page(NAME, spelled))
    return shown(from_json(parts(spark, d), "espacio_fundacion_telefonica", post(said(',"html":"', quoted(html), '"'))))


@query(f"{P} SELECT '/e/' || k AS id, name AS titulo, CAST(size AS DOUBLE) AS precio, CASE WHEN k % 2 = 0 THEN 'Edificio ' || brand ELSE 'Museo Reina Sofía' END AS lugar, strftime(TIMESTAMP '1970-01-01' + to_seconds(1769940000 + k * 3600), '%Y-%m-%dT%H:%M:%SZ') AS fecha_inicio, 'Arte' AS categorias, 'https://www.museoreinasofia.es/e/' || k AS url FROM p")
def source_museo_reina_sofia(spark, d):
    """The last version of an address."""
    K, NAME, BRAND, SIZE, KEY = columns("K", "NAME", "BRAND", "SIZE", "KEY")
    one = lambda title: said('{"url":{"path":"/e/', KEY, '"},"title":"', title, '","place":"', F.when(K % 2 == 0, said("Edificio ", BRAND)).otherwise(""), '","price":"', num(SIZE), ' €","processedDates":[{"value":', num(1769940000 + K * 3600), "}]}")
    return shown(from_json(parts(spark, d), "museo_reina_sofia", said('{"results":[', one(F.lit("x")), ",", one(NAME), "]}")))


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name AS titulo, CAST(size AS DOUBLE) AS precio, brand AS lugar, CAST(day AS VARCHAR) AS fecha_inicio, '' AS categorias, 'https://s/' || k AS url FROM p")
def source_madrid_secreto(spark, d):
    """C22."""
    NAME, BRAND, SIZE, KEY, ISO = columns("NAME", "BRAND", "SIZE", "KEY", "ISO")
    text = said('{"id":"', KEY, '","titulo":"', NAME, '","precio":"', num(SIZE), '","lugar":"', BRAND, '","fecha_inicio":"', ISO, '","categorias":[],"url":"https://s/', KEY, '"}')
    return shown(from_json(parts(spark, d), "madrid_secreto", text))


@query(f"""{P}, u AS (SELECT 'https://h/e/' || k AS url, * FROM p) SELECT CAST(k AS VARCHAR) AS id, name || ' & Co' AS titulo, CAST(size AS DOUBLE) AS precio, 'Sala ' || brand AS lugar, day || 'T20:00:00+' || CASE WHEN day >= DATE '2026-03-29' AND day < DATE '2026-10-25' THEN '02' ELSE '01' END || ':00' AS fecha_inicio, CASE WHEN k % 2 = 0 THEN 'A|B' ELSE 'B' END AS categorias, url,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'https://h/entradas/' || k END AS bought, CASE WHEN k % 3 = 0 THEN 'https://h/entradas/todo' END AS original FROM u""")
def source_esmadrid(spark, d):
    """Pages found under categories; an address that several sell at is no plan's."""
    K, NAME, KEY = columns("K", "NAME", "KEY")
    body = said("<a href='/entradas/", F.when(K % 3 == 0, "todo").otherwise(KEY), "'>Comprar entradas</a>")
    p = parts(spark, d)
    both = p.withColumn("c", F.lit("B")).unionByName(p.where("k % 2 = 0").withColumn("c", F.lit("A")))
    raw = from_pages(both, "esmadrid", url=said("https://h/e/", KEY), html=page(NAME, body, event()), category=F.col("c"))
    return shown(raw, F.col("url_compra").alias("bought"), F.try_element_at("metadata", F.lit("url_compra_original")).alias("original"))


LOCAL = "day || 'T20:00:00+' || CASE WHEN day >= DATE '2026-03-29' AND day < DATE '2026-10-25' THEN '02' ELSE '01' END || ':00'"


@query(f"{P} SELECT CAST(100 + k AS VARCHAR) AS id, name || ' & Co' AS titulo, CAST(size AS DOUBLE) AS precio, 'Sala ' || brand AS lugar, {LOCAL} AS fecha_inicio, 'Música' AS categorias, 'https://e/ev-' || 100 + k || '/' AS url FROM p")
def source_eventbrite(spark, d):
    """Item lists; an address that a later item repeats counts once."""
    K, NAME, KEY = columns("K", "NAME", "KEY")
    one = event(url=said("https://e/ev-", num(100 + K)))
    lists = said('{"itemListElement":[{"item":', one, "},{\"item\":", one, "}]}")
    raw = from_pages(parts(spark, d), "eventbrite", url=said("https://e/list/", KEY), html=page(NAME, F.lit(""), lists), category=F.lit("Música"))
    return shown(raw)


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name || ' & Co' AS titulo, CAST(size AS DOUBLE) AS precio, 'Sala ' || brand AS lugar, {LOCAL} AS fecha_inicio, 'Ferias y Congresos' AS categorias, 'https://i/f/' || k AS url FROM p")
def source_ifema_madrid(spark, d):
    """C18, J1, G9, P5."""
    NAME, KEY = columns("NAME", "KEY")
    return shown(from_pages(parts(spark, d), "ifema_madrid", url=said("https://i/", KEY), html=page(NAME, F.lit(""), event(url=said("https://i/f/", KEY)))))


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name || ' & Co' AS titulo, CAST(size AS DOUBLE) AS precio, 'Sala ' || brand AS lugar, {LOCAL} AS fecha_inicio, 'Exposiciones' AS categorias, 'https://m/x/' || k AS url, 'https://m/reservar/' || k AS bought FROM p WHERE k % 4 > 0")
def source_fundacion_mapfre(spark, d):
    """Pages with event data."""
    K, NAME, KEY = columns("K", "NAME", "KEY")
    body = said("<a href='/mas'>Más</a><a href='/reservar/", KEY, "'>Reservar</a>")
    html = F.when(K % 4 > 0, page(NAME, body, event())).otherwise(page(NAME, body))
    return shown(from_pages(parts(spark, d), "fundacion_mapfre", url=said("https://m/x/", KEY), html=html), F.col("url_compra").alias("bought"))


def slashed():
    """The day as d/m/y."""
    (DAY,) = columns("DAY")
    return said(num(F.dayofmonth(DAY)), "/", num(F.month(DAY)), "/", num(F.year(DAY)))


@query(f"{P} SELECT 'cine-club-' || k AS id, 'Cine club ' || name AS titulo, CAST(size AS DOUBLE) AS precio, 'Círculo de Bellas Artes' AS lugar, CAST(day AS VARCHAR) AS fecha_inicio, 'Cultura' AS categorias, 'https://c/a/cine-club-' || k || '/' AS url, CASE WHEN k % 2 = 0 THEN 'https://c/entradas/cine-' || k END AS bought, CASE WHEN k % 3 = 0 THEN day || 'T19:30:00' END AS session FROM p")
def source_circulo_bellas_artes(spark, d):
    """C11, T22-T24, T34, M5, D18, D26, U7."""
    K, NAME, SIZE, DAY, KEY = columns("K", "NAME", "SIZE", "DAY", "KEY")
    body = said("<p>Del ", slashed(), " al ", slashed(), ". Reducida 1 €. General: ", num(SIZE), " €</p>", F.when(K % 3 == 0, said("<p>Mié ", num(F.dayofmonth(DAY)), "/", num(F.month(DAY)), ", 19:30</p>")).otherwise(""), "<a href='/entradas/", F.when(K % 2 == 0, "cine-").otherwise("otra-"), KEY, "'>Comprar entradas</a>")
    raw = from_pages(parts(spark, d), "circulo_bellas_artes", url=said("https://c/a/cine-club-", KEY), html=page(said("Cine club ", NAME), body))
    return shown(raw, F.col("url_compra").alias("bought"), F.get("fechas_disponibles", F.lit(0)).alias("session"))


def spelled_out():
    """The day in Spanish words."""
    (DAY,) = columns("DAY")
    return said(num(F.dayofmonth(DAY)), " de ", F.get(F.array(*map(F.lit, fixtures.dims.MONTHS_ES)), F.month(DAY) - 1), " de ", num(F.year(DAY)))


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name AS titulo, CASE WHEN k % 2 = 0 THEN 0.0 ELSE CAST(size AS DOUBLE) END AS precio, 'Casa de México' AS lugar, day || 'T19:30:00' AS fecha_inicio, CASE WHEN k % 3 = 0 THEN 'Expo|Cine' ELSE 'Expo' END AS categorias, 'https://x/' || k AS url FROM p")
def source_casa_mexico(spark, d):
    """Pages found under categories, in the order of discovery."""
    K, NAME, SIZE, KEY = columns("K", "NAME", "SIZE", "KEY")
    p = parts(spark, d)
    body = said("<p>", spelled_out(), "</p><p>De 19:30 a 21:00 h</p><p>", F.when(K % 2 == 0, "Entrada libre, catálogo 5 €").otherwise(said(num(SIZE), " €")), "</p>")
    cats = F.when(K % 3 == 0, F.array(F.lit("Expo"), F.lit("Cine"), F.lit("Expo"))).otherwise(F.array(F.lit("Expo")))
    rows = p.withColumn("c", F.explode(cats))
    return shown(from_pages(rows, "casa_mexico", url=said("https://x/", KEY), html=page(NAME, body), category=F.col("c")))


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name AS titulo, CASE WHEN k % 2 = 0 THEN 0.0 ELSE CAST(size AS DOUBLE) END AS precio, CASE WHEN k % 3 = 0 THEN 'Sala ' || brand ELSE 'Biblioteca Nacional de España' END AS lugar, CAST(day AS VARCHAR) AS fecha_inicio, 'Lectura' AS categorias, 'https://b/' || k AS url, day || 'T18:00:00' AS session FROM p")
def source_biblioteca_nacional(spark, d):
    """Cards with dates, pages with sessions; free where nothing else is said."""
    K, NAME, BRAND, SIZE, DAY, KEY = columns("K", "NAME", "BRAND", "SIZE", "DAY", "KEY")
    months = F.get(F.array(*map(F.lit, fixtures.dims.MONTHS_ES)), F.month(DAY) - 1)
    body = said("<p>", num(F.dayofmonth(DAY)), " de ", months, ": 18:00 h</p>", F.when(K % 2 == 0, "").otherwise(said("<p>", num(SIZE), " €</p>")))
    raw = from_pages(parts(spark, d), "biblioteca_nacional", url=said("https://b/", KEY), html=page(NAME, body), card=said("A partir del ", spelled_out()), place=F.when(K % 3 == 0, said(" Sala ", BRAND)))
    return shown(raw, F.get("fechas_disponibles", F.lit(0)).alias("session"))


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name AS titulo, CAST(size AS DOUBLE) AS precio, 'Fundación Canal' AS lugar, day || 'T19:30:00' AS fecha_inicio, 'Conciertos' AS categorias, 'https://f/' || k || '/' AS url, day || 'T21:00:00' AS fecha_fin FROM p")
def source_fundacion_canal(spark, d):
    """C16, D17, G8."""
    NAME, SIZE, KEY = columns("NAME", "SIZE", "KEY")
    body = said("<p>", slashed(), " 19:30 90 min. ", num(SIZE), " €</p>")
    return shown(from_pages(parts(spark, d), "fundacion_canal", url=said("https://f/", KEY), html=page(NAME, body), category=F.lit("Conciertos")), "fecha_fin")


@query(
    f"""{P}, m AS (SELECT k, name, size, k * 37 % 12 + 1 AS month, k * 5 % 28 + 1 AS day FROM p), l AS (SELECT *, lag(month * 100 + day) OVER (ORDER BY k) AS before, first_value(month * 100 + day) OVER (ORDER BY k) AS first FROM m),
y AS (SELECT *, 2024 + CASE WHEN make_date(2024, CAST(first // 100 AS INTEGER), CAST(first % 100 AS INTEGER)) >= DATE '{fixtures.TODAY_TEXT}' - 30 THEN 0 ELSE 1 END + sum(CASE WHEN month * 100 + day < before THEN 1 ELSE 0 END) OVER (ORDER BY k) AS year FROM l)
SELECT CAST(k AS VARCHAR) AS id, name AS titulo, CAST(size AS DOUBLE) AS precio, 'Sala El Sol' AS lugar, make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), CAST(day AS INTEGER)) || 'T23:30:00' AS fecha_inicio, 'Música' AS categorias, 'https://s/' || k AS url, (make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), CAST(day AS INTEGER)) + 1) || 'T02:00:00' AS fecha_fin FROM y WHERE k < 400"""
)
def source_sala_el_sol(spark, d):
    """A listing's days get their years, pages give the times."""
    K, NAME, SIZE, KEY = columns("K", "NAME", "SIZE", "KEY")
    p = parts(spark, d).where("k < 400")  # a listing is one page
    cards = p.select("k", "name", "size", (K * 37 % 12 + 1).cast("int").alias("month"), (K * 5 % 28 + 1).cast("int").alias("day"), K.alias("position"))
    listed = with_years(cards, fixtures.today())
    body = said("<p>Fecha: hoy Hora: 23:30 - 02:00 Entradas: ", num(SIZE), " € Tipo: Rock</p>")
    raw = from_pages(listed, "sala_el_sol", url=said("https://s/", KEY), html=page(NAME, body), title=NAME, day=F.col("day"), month=F.col("month"), position=F.col("position"), year=F.col("year"))
    return shown(raw, "fecha_fin")


@query(f"{P} SELECT CAST(k AS VARCHAR) AS id, name AS titulo, CASE WHEN k % 2 = 0 THEN 'Ocio' ELSE '' END AS categorias, 'https://t/' || k AS url, CASE WHEN k % 2 = 0 THEN day || 'T10:00:00Z' ELSE CAST(day AS VARCHAR) END AS published, CASE WHEN k % 2 = 0 THEN 'Un texto de cuarenta caracteres o algo más, ' || name ELSE 'Hola tú, ' || name END AS body FROM p")
def source_timeout(spark, d):
    """Pages, and a proxy's markdown."""
    K, NAME, KEY, ISO = columns("K", "NAME", "KEY", "ISO")
    article = said('{"@type":"NewsArticle","headline":"', NAME, '","datePublished":"', ISO, 'T10:00:00Z","articleSection":"Ocio"}')
    html = page(F.lit("x"), said("<article><p>Un texto de cuarenta caracteres o algo más, ", NAME, "</p></article><section><p>x</p></section>"), article)
    markdown = said("Title: ", NAME, "\nURL Source: https://t/", KEY, "\nPublished Time: ", ISO, "\nMarkdown Content:\n# Hola [tú](x), *", NAME, "*")
    raw = from_pages(parts(spark, d), "timeout", url=F.when(K % 2 == 0, said("https://t/", KEY)).otherwise("https://proxy"), html=F.when(K % 2 == 0, html).otherwise(markdown))
    return raw.select("id", "titulo", F.array_join("categorias", "|").alias("categorias"), "url", F.col("fecha_publicacion").alias("published"), F.col("contenido").alias("body"))
