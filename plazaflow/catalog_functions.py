"""Queries of single column functions. Texts are made of the tables' values, so that SQL knows what must come out of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazaflow.functions import arrays, dates, markup, numbers, text, urls
from plazaflow.operators import predicates
from plazaflow.plans import dims, fixtures
from plazaflow.plans.fixtures import dealt, now, table, today
from plazaflow.register import query


def said(*parts):
    """The parts as one text; those that aren't columns are literal."""
    return F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))


def num(c):
    return c.cast("string")


def orders(spark, d):
    """Orders with a day of 2024 (day), that day's parts, and the key as k."""
    k = F.col("o_orderkey")
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select(k.alias("k"), "o_orderpriority", F.date_add(F.lit("2024-01-01").cast("date"), (k * 7 % 366).cast("int")).alias("day"))
    names = F.array(*map(F.lit, dims.MONTHS_ES))
    return o.withColumns({"y": F.year("day"), "m": F.month("day"), "d": F.dayofmonth("day"), "month": F.get(names, F.month("day") - 1), "iso": F.col("day").cast("string")})


MONTHS = "[" + ", ".join(f"'{m}'" for m in dims.MONTHS_ES) + "]"
#: orders() in SQL: o.
O = f"""WITH o0 AS (SELECT o_orderkey AS k, o_orderpriority, DATE '2024-01-01' + CAST(o_orderkey * 7 % 366 AS INTEGER) AS day FROM orders),
o AS (SELECT *, year(day) AS y, month(day) AS m, dayofmonth(day) AS d, {MONTHS}[month(day)] AS month, CAST(day AS VARCHAR) AS iso FROM o0)"""
SUMMER = "CASE WHEN {0} > DATE '2024-03-31' AND {0} <= DATE '2024-10-27' THEN '+02:00' ELSE '+01:00' END"
CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


# Texts


@query(f"SELECT doc_id, lower(regexp_replace(strip_accents({CLEAN.format('text')}), '[^\\x00-\\x7F]', '', 'g')) AS plain FROM documents")
def normalize_text(spark, d):
    """T3."""
    return table(spark, d, "documents").select("doc_id", text.normalize_text("text").alias("plain"))


@query("SELECT p_partkey, p_name || ' ' || p_brand || ' by ' || p_type AS plain FROM part")
def strip_markdown(spark, d):
    """T14."""
    made = said("# **", F.col("p_name"), "**\n- [", F.col("p_brand"), "](http://x/(a) ![pic](a.png)\n* _by_ `", F.col("p_type"), "`")
    made = F.replace(made, F.lit("(http://x/(a)"), F.lit("(http://x/a)"))
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", text.strip_markdown(made).alias("plain"))


@query(
    """SELECT p_partkey, p_type AS place, CAST(p_size AS VARCHAR) AS day, p_brand AS hour, p_name AS price, p_size || ' Hora: ' || p_brand || ' Entradas: ' || p_name || ' Lugar: ' || p_type || ' Duración: ' || p_size || ' minutos.' AS trimmed,
  'Fecha: ' || p_size AS before, p_size || ' minutos' AS duration, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS words FROM part"""
)
def page_fields(spark, d):
    """Fields of a page's text."""
    size = num(F.col("p_size"))
    made = said("Fecha: ", size, " Hora: ", F.col("p_brand"), " Entradas: ", F.col("p_name"), " Lugar: ", F.col("p_type"), " Duración: ", size, " minutos. Compra de entradas ", F.col("p_brand"))
    p = dealt(table(spark, d, "part"), "p_partkey").withColumn("t", made)
    meta = text.meta_fields("t", {"day": "Fecha:", "hour": "Hora:", "price": "Entradas:", "place": "Lugar:"})
    camel = said("http://x/tipos/", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), "/")
    return p.select(
        "p_partkey",
        text.slice_between("t", "Lugar:", "Duración:").alias("place"),
        meta["day"].alias("day"),
        meta["hour"].alias("hour"),
        meta["price"].alias("price"),
        text.trim_at("t", ["Compra de entradas", "Ficha"], ["Fecha:"]).alias("trimmed"),
        text.before_pattern("t", r"(?i)\s*hora\s*:").alias("before"),
        text.duration_text("t").alias("duration"),
        text.camel_words(camel).alias("words"),
    )


@query(
    f"""{O} SELECT k, 'Titulo ' || k || '|Descripción|Algo ' || k || '|Más ' || k % 7 || '|Compartir|Fin' AS lines, 'Algo ' || k || '|Más ' || k % 7 AS section, 'Descripción|Algo ' || k AS between_lines,
  'Algo ' || k || ' y más|Otro' AS collapsed, 'Un párrafo número ' || k || chr(10) || chr(10) || 'Otro párrafo, largo' AS paragraphs, 'Sala ' || k AS location, k % 3 = 0 AS prose,
  CASE WHEN k % 2 = 0 THEN 'Titulo ' || k ELSE 'Otro ' || k END AS title, 'Museo ' || k AS institution FROM o"""
)
def line_sections(spark, d):
    """Pages read line by line."""
    k = num(F.col("k"))
    made = said("Titulo ", k, "\n\n  Titulo ", k, " \nDescripción\nAlgo ", k, "\nMás ", num(F.col("k") % 7), "\nCompartir\nFin")
    o = orders(spark, d).withColumn("lines", text.lines(made))
    line = F.when(F.col("k") % 3 == 0, said("La sala ", k)).when(F.col("k") % 3 == 1, said("19:30 La sala ", k, F.lit("x" * 80))).otherwise(said("Sala ", k))
    heads = F.array(F.lit("Menú"), F.when(F.col("k") % 2 == 0, said("Titulo ", k)).otherwise(said("Otro ", k)))
    join = lambda a: F.array_join(a, "|")
    return o.select(
        "k",
        join("lines").alias("lines"),
        join(text.section("lines", "descripción", ["compartir", "otros"])).alias("section"),
        join(text.between_lines("lines", said("Titulo ", k), ["más"])).alias("between_lines"),
        join(text.collapse_paragraphs(F.array(said("Algo ", k), said("Algo ", k, " y más"), F.lit("algo"), F.lit("Otro")))).alias("collapsed"),
        text.paragraphs_text(F.array(said("Un párrafo  número ", k), F.lit("corto"), F.lit("http://una.direccion.larga/x"), F.lit("Otro párrafo, largo"), F.lit("otro PÁRRAFO, largo")), 12).alias("paragraphs"),
        text.inline_location(said("Sala ", k, " - Entrada 5 euros"), ["Entrada", "Reserva"]).alias("location"),
        text.looks_like_content(line, ["la "]).alias("prose"),
        text.pick_title(heads, said("Titulo ", k, ": la obra"), ["menú"]).alias("title"),
        text.institution_name(said(" Museo ", k, "  (12) ")).alias("institution"),
    )


LABELS = "[" + ", ".join(f"{{'s': '{s}', 'l': '{v}'}}" for s, v in dims.SOURCE_LABELS.items()) + "]"
SOURCES = "[" + ", ".join(f"'{s}'" for s in dims.SOURCE_LABELS) + "]"
MONEY = """CASE WHEN p = floor(p) THEN CASE WHEN p < 10000 THEN CAST(CAST(p AS BIGINT) AS VARCHAR) ELSE (CAST(p AS BIGINT) // 1000) || '.' || lpad(CAST(CAST(p AS BIGINT) % 1000 AS VARCHAR), 3, '0') END
  ELSE CASE WHEN p < 10000 THEN replace(printf('%.2f', p), '.', ',') ELSE (CAST(floor(p) AS BIGINT) // 1000) || '.' || replace(printf('%06.2f', p - (CAST(floor(p) AS BIGINT) // 1000) * 1000), '.', ',') END END || chr(160) || '€'"""


@query(
    f"""{O}, s AS (SELECT k, o_orderpriority AS name, {SOURCES}[k % {len(dims.SOURCE_LABELS)} + 1] AS source, CASE WHEN k % 5 = 1 THEN NULL ELSE k % 11 * k * 0.5 END AS p, CAST(k % 200 AS INTEGER) AS h FROM o)
SELECT k, CASE WHEN k % 4 = 0 THEN 'Sala · Calle ' || k WHEN k % 4 = 1 THEN 'Sala' WHEN k % 4 = 2 THEN 'Calle ' || k ELSE 'Ubicación por confirmar' END AS location,
  CASE WHEN p = 0 THEN 'Gratis' WHEN p IS NOT NULL THEN CASE WHEN source IN ('fever', 'eventbrite', 'wegow', 'ticketmaster') THEN 'desde ' ELSE '' END || {MONEY} END AS price,
  list_filter({LABELS}, lambda x: x.s = source)[1].l AS label, 'cafe ' || lower(name) AS token,
  abs(CASE WHEN hash >= 2147483648 THEN hash - 4294967296 ELSE hash END) AS hash,
  CASE WHEN h < 1 THEN 'Actualizado hace un momento' WHEN h < 24 THEN 'Actualizado hace ' || h || ' h' WHEN h < 48 THEN 'Actualizado ayer' ELSE 'Actualizado hace ' || h // 24 || ' días' END AS updated
FROM (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(name || k, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS hash FROM s)"""
)
def reader_labels(spark, d):
    """What cards say."""
    k = F.col("k")
    o = orders(spark, d)
    source = F.get(F.array(*map(F.lit, dims.SOURCE_LABELS)), (k % len(dims.SOURCE_LABELS)).cast("int"))
    price = F.when(k % 5 != 1, k % 11 * k * 0.5)
    place = F.when(k % 4 < 2, "Sala").when(k % 4 == 2, "")
    address = F.when(k % 4 == 1, "Sala").when(k % 4 != 3, said("Calle ", num(k)))
    return o.select(
        "k",
        text.location_label(place, address).alias("location"),
        text.price_label(price, F.lit(None).cast("boolean"), source).alias("price"),
        text.source_label(source).alias("label"),
        text.place_token(said(" Café  ", F.col("o_orderpriority"), "., ")).alias("token"),
        text.string_hash(said(F.col("o_orderpriority"), num(k))).alias("hash"),
        text.updated_label(F.timestamp_add("HOUR", -(k % 200).cast("int"), now()), now()).alias("updated"),
    )


@query("SELECT p_partkey, 'Ünder & Öber ' || p_name || ' × 5 ¼ – ª «' || p_brand || '» ¡&!' AS plain FROM part")
def references(spark, d):
    """Character references beyond the common ones, encoded once or twice."""
    made = said("&Uuml;nder &amp;amp; &Ouml;ber ", F.col("p_name"), " &times; 5 &frac14; &amp;ndash; &ordf; &laquo;", F.col("p_brand"), "&raquo; &#161;&#x26;&#33;")
    p = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    return p.select("p_partkey", text.web_text(made).alias("plain"))


# Dates


@query(
    f"""{O} SELECT k, iso || 'T00:00:00' || {SUMMER.format('day')} AS midnight, iso AS from_day, CASE WHEN k % 5 > 0 THEN iso END AS fecha, CASE WHEN k % 5 > 0 AND k % 2 = 0 THEN iso || 'T19:30:00' END AS datetime, k % 5 > 0 AND k % 2 = 0 AS tiene_hora,
  CASE WHEN k % 3 = 0 THEN iso ELSE iso || 'T' || lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':05:00' END AS joined, CAST(k % 60 // 7 + 1 AS INTEGER) AS weeks, CAST(day + CAST(k % 60 // 7 * 7 AS INTEGER) AS VARCHAR) AS last_week,
  iso || 'T10:00' AS first, CASE WHEN k % 2 = 0 THEN CAST(day + 2 AS VARCHAR) END AS last, strftime(TIMESTAMP '1970-01-01' + to_seconds(k * 100003), '%Y-%m-%dT%H:%M:%SZ') AS epoch,
  CASE WHEN k % 4 = 0 THEN 'pronto' ELSE iso || 'T' || CASE WHEN day >= DATE '2024-03-31' AND day < DATE '2024-10-27' THEN '14' ELSE '13' END || ':30:00' || CASE WHEN day >= DATE '2024-03-31' AND day < DATE '2024-10-27' THEN '+02:00' ELSE '+01:00' END END AS local,
  CASE WHEN k % 2 = 0 THEN iso ELSE iso || 'T20:15:00' END AS all_day, CASE WHEN k % 3 > 0 THEN iso || 'T20:15:00Z' END AS gmt FROM o"""
)
def record_times(spark, d):
    """Days and times as sources give them."""
    k, iso, day = F.col("k"), F.col("iso"), F.col("day")
    s = dates.record_session(F.when(k % 5 > 0, iso), said(iso, "T19:30:00"), k % 2 == 0)
    weeks = dates.every_seven(day, F.date_add(day, (k % 60).cast("int")))
    span = dates.iso_interval(F.when(k % 2 == 0, said(iso, "T10:00 - ", F.date_add(day, 2).cast("string"))).otherwise(said(iso, "T10:00")))
    return orders(spark, d).select(
        "k",
        dates.start_of_day(day).alias("midnight"),
        dates.from_day(day)["d"].cast("string").alias("from_day"),
        s["fecha"].alias("fecha"),
        s["datetime"].alias("datetime"),
        F.coalesce(s["tiene_hora"], F.lit(False)).alias("tiene_hora"),
        dates.day_and_time(iso, F.when(k % 3 > 0, said(num(k % 24), ".05 h"))).alias("joined"),
        F.size(weeks).alias("weeks"),
        F.array_max(weeks).cast("string").alias("last_week"),
        span["first"].alias("first"),
        span["last"].alias("last"),
        dates.epoch_iso(k * 100003).alias("epoch"),
        dates.to_local_iso(F.when(k % 4 == 0, "pronto").otherwise(said(iso, "T12:30:00Z"))).alias("local"),
        dates.all_day(F.when(k % 2 == 0, said(iso, " 00:00:00")).otherwise(said(iso, " 20:15:00"))).alias("all_day"),
        dates.gmt_iso(F.when(k % 3 > 0, said(iso, "T20:15:00")).otherwise(iso)).alias("gmt"),
    )


@query(
    f"""{O}, e AS (SELECT *, day + CAST(k % 40 AS INTEGER) AS z FROM o)
SELECT k, iso AS range_first, CAST(z AS VARCHAR) AS range_last, iso || CASE WHEN k % 2 = 0 THEN 'T18:00:00' ELSE '' END AS card_first, CASE WHEN k % 2 = 0 THEN iso || 'T20:30:00' END AS card_last,
  iso AS label, CASE WHEN k % 2 = 0 THEN iso || 'T19:30:00' ELSE iso END AS dmy_first, CASE WHEN k % 2 = 0 THEN strftime(CAST(day AS TIMESTAMP) + INTERVAL 19 HOUR + INTERVAL 30 MINUTE + to_minutes(CAST(k % 300 + 1 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') ELSE CAST(CASE WHEN z = day THEN day ELSE z END AS VARCHAR) END AS dmy_last,
  iso AS pair_first, CAST(CASE WHEN z = day THEN day ELSE z END AS VARCHAR) AS pair_last, CAST(CASE WHEN k % 2 = 0 THEN k % 300 ELSE k % 5 * 60 END AS INTEGER) AS minutes,
  lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':30' AS clock_first, lpad(CAST(k % 13 AS VARCHAR), 2, '0') || ':00' AS clock_last,
  iso || 'T' || lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':30:00' AS night_first, CAST(day + CASE WHEN k % 13 <= k % 24 THEN 1 ELSE 0 END AS VARCHAR) || 'T' || lpad(CAST(k % 13 AS VARCHAR), 2, '0') || ':00:00' AS night_last,
  iso || 'T09:15:00|' || iso || 'T21:45:00' AS body, iso || 'T19:30:00' AS section FROM e"""
)
def spanish_dates(spark, d):
    """Days and times in prose."""
    k, day = F.col("k"), F.col("day")
    o = orders(spark, d).withColumn("z", F.date_add(day, (k % 40).cast("int")))
    names = F.array(*map(F.lit, dims.MONTHS_ES))
    spelled = lambda c: said(num(F.dayofmonth(c)), " de ", F.get(names, F.month(c) - 1), " de ", num(F.year(c)))
    slashed = lambda c: said(num(F.dayofmonth(c)), "/", num(F.month(c)), "/", num(F.year(c)))
    short = F.upper(F.substring("month", 1, 3))
    span = dates.spanish_range(said("Del ", spelled(day), " al ", spelled("z")))
    card = dates.card_dates(F.when(k % 2 == 0, said(spelled(day), ", 18:00 h - 20:30 h")).otherwise(said("A partir del ", spelled(day))))
    dmy = dates.dmy_fields(F.when(k % 2 == 0, said(slashed(day), " - 19:30 (", num(k % 300 + 1), " min)")).otherwise(said(slashed(day), " - ", slashed("z"))))
    pair = dates.dmy_pair(said("del ", slashed(day), " al ", slashed("z"), " o ", slashed(day)))
    clock = dates.time_range(said("De ", num(k % 24), ":30 a ", num(k % 13), ".00 horas"))
    night = dates.overnight(day, clock["first"], clock["last"])
    return o.select(
        "k",
        span["first"].cast("string").alias("range_first"),
        span["last"].cast("string").alias("range_last"),
        card["first"].alias("card_first"),
        card["last"].alias("card_last"),
        dates.date_label(said(num(F.col("d")), " ", short, " ", num(F.col("y")))).alias("label"),
        dmy["first"].alias("dmy_first"),
        dmy["last"].alias("dmy_last"),
        pair["first"].alias("pair_first"),
        pair["last"].alias("pair_last"),
        dates.duration_minutes(F.when(k % 2 == 0, said("Dura ", num(k % 300), " minutos")).otherwise(said(num(k % 5), " horas"))).alias("minutes"),
        clock["first"].alias("clock_first"),
        clock["last"].alias("clock_last"),
        night["first"].alias("night_first"),
        night["last"].alias("night_last"),
        F.array_join(dates.body_sessions(said("Pases: ", num(F.col("d")), " de ", F.col("month"), ": 9:15 h y ", num(F.col("d")), " de ", F.col("month"), ": 21.45 h"), F.col("y")), "|").alias("body"),
        F.array_join(dates.section_sessions(said("Mié ", num(F.col("d")), "/", num(F.col("m")), ", 19:30"), F.col("y")), "|").alias("section"),
    )


@query(
    f"""{O} SELECT k, CASE WHEN k % 2 = 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR WHEN k % 3 = 0 THEN NULL ELSE CAST(day AS TIMESTAMP) + to_hours(CAST(k % 24 AS INTEGER)) END AS seen, CAST(day AS TIMESTAMP) AS day_start, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS day_end,
  CASE WHEN k % 24 BETWEEN 6 AND 11 THEN 'morning' WHEN k % 24 BETWEEN 12 AND 17 THEN 'afternoon' WHEN k % 24 BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS part, k % 24 NOT IN (0) AND k % 5 > 0 AS timed FROM o"""
)
def view_times(spark, d):
    """D32-D34, D36."""
    k, iso = F.col("k"), F.col("iso")
    hour = F.lpad(num(k % 24), 2, "0")
    at = F.timestamp_add("HOUR", (k % 24).cast("int"), F.col("day").cast("timestamp_ntz"))
    raw = F.when(k % 2 == 0, iso).when(k % 3 == 0, "mañana").otherwise(said(iso, "T", hour, ":00:00"))
    return orders(spark, d).select("k", dates.view_time(raw).alias("seen"), dates.day_start(at).alias("day_start"), dates.day_end(at).alias("day_end"), dates.daypart(at).alias("part"), dates.has_real_time(F.when(k % 5 > 0, said(iso, "T", hour, ":00:00+01:00"))).alias("timed"))


SHORT = "[" + ", ".join(f"'{m}'" for m in dims.MONTHS_SHORT_ES) + "]"
WEEKDAYS = "[" + ", ".join(f"'{m[:3]}'" for m in dims.WEEKDAYS_ES) + "]"
T = f"DATE '{fixtures.TODAY_TEXT}'"


@query(
    f"""{O}, e AS (SELECT *, {T} + CAST(k % 500 AS INTEGER) AS w, {T} + CAST(k % 700 AS INTEGER) AS z FROM o),
f AS (SELECT *, dayofmonth(w) || ' ' || {SHORT}[month(w)] AS short, dayofmonth(z) || ' ' || {SHORT}[month(z)] AS zs FROM e)
SELECT k, CASE WHEN k % 4 = 0 THEN 'En curso' || CASE WHEN date_diff('day', {T}, z) <= 456 THEN ' · hasta ' || zs ELSE '' END WHEN k % 4 = 1 THEN CASE WHEN k % 8 = 1 THEN 'Cuando quieras' ELSE 'Fecha por confirmar' END
  ELSE CASE WHEN w = {T} THEN 'Hoy' WHEN w = {T} + 1 THEN 'Mañana' ELSE {WEEKDAYS}[isodow(w)] || ', ' || short || CASE WHEN year(w) = 2024 THEN '' ELSE ' ' || year(w) END END || CASE WHEN k % 4 = 2 THEN ' · 20:30' ELSE '' END END AS label,
  CASE WHEN k % 4 > 1 THEN 'https://calendar.google.com/calendar/render?action=TEMPLATE&text=Obra+' || k || '&dates=' || strftime(w, '%Y%m%d') || 'T203000/' || strftime(w, '%Y%m%d') || 'T223000&ctz=Europe%2FMadrid&location=Sala+' || k % 9 END AS calendar FROM f"""
)
def schedule_labels(spark, d):
    """D39, D40."""
    k = F.col("k")
    at = F.timestamp_add("MINUTE", F.lit(1230), F.date_add(today(), (k % 500).cast("int")).cast("timestamp_ntz"))
    none = F.lit(None).cast("timestamp_ntz")
    end = F.date_add(today(), (k % 700).cast("int")).cast("timestamp_ntz")
    resolved = F.struct(
        F.when(k % 4 == 1, none).otherwise(at).alias("primary"),
        end.alias("end"),
        (k % 4 == 0).alias("ongoing"),
        F.when(k % 4 == 2, said(at.cast("date").cast("string"), "T20:30:00")).alias("time_source"),
    )
    o = orders(spark, d).select("k", F.when(k % 8 == 1, "sin_fecha").otherwise("puntual").alias("mode"), resolved.alias("r"), F.when(k % 4 > 1, at).alias("at"))
    start = F.lit(f"{fixtures.TODAY_TEXT} 00:00:00").cast("timestamp_ntz")
    return o.select("k", dates.schedule_label(F.col("r"), "mode", start).alias("label"), dates.calendar_url(said("Obra ", num(k)), F.col("at"), said("Sala ", num(k % 9))).alias("calendar"))


# Numbers, addresses


@query(
    f"""{O}, p AS (SELECT k, k % 90 + 0.5 AS p FROM o)
SELECT k, CASE WHEN k % 5 = 0 THEN 0.0 WHEN k % 5 = 1 THEN NULL WHEN k % 5 = 2 THEN 0.0 ELSE p END AS text_price, CASE WHEN k % 5 <> 1 THEN 'EUR' END AS currency, CASE WHEN k % 3 = 0 THEN p WHEN k % 3 = 1 THEN p + 1 ELSE 3.0 END AS ranked, CASE WHEN k % 4 > 0 THEN least(p, 20.0) ELSE 20.0 END AS offered, 'EUR' AS offered_in,
  CASE WHEN k % 2 = 0 THEN p WHEN k % 3 = 0 THEN 0.0 END AS policy, k % 3 = 0 AS hinted, CASE WHEN k % 2 = 0 THEN 40 + k / 100000.0 END AS lat, CASE WHEN k % 2 = 0 THEN -3.5 END AS lon, CASE WHEN k % 4 = 0 THEN k % 8 = 0 ELSE k % 4 < 3 END AS near_city FROM p"""
)
def prices_and_points(spark, d):
    """M3, M5, M6, M8, M13-M15."""
    k = F.col("k")
    p = k % 90 + 0.5
    comma = F.replace(num(p), F.lit("."), F.lit(","))
    raw = F.when(k % 5 == 0, "Entrada gratuita: gratis").when(k % 5 > 2, said("Desde ", comma, " €")).otherwise("")
    money = numbers.text_price(raw, (k % 5 == 2).cast("int"), F.lit("Obra"))
    ranked = numbers.ranked_price(F.when(k % 3 == 0, said("Reducida 2 €. Entrada general: ", comma, " €")).when(k % 3 == 1, said("Reducida 2 € general ", F.replace(num(p + 1), F.lit("."), F.lit(",")), " €")).otherwise("Reducida 3 €, otras 8 €"))
    offered = numbers.offers_price(F.array(F.lit("20"), F.when(k % 4 > 0, num(p)), F.lit("x")), F.array(F.lit(""), F.lit("EUR"), F.lit("USD")))
    point = numbers.map_link_point(F.when(k % 2 == 0, said("https://maps/@", F.format_number(40 + k / 100000.0, 5), ",-3.5,17z")).otherwise("https://maps/"))
    city = F.when(k % 4 == 1, "").when(k % 4 == 2, "Madrid, España").otherwise("Sevilla")
    lat = F.when(k % 8 == 0, "40.5").when(k % 8 == 4, "10.5")
    return orders(spark, d).select(
        "k",
        money["precio"].alias("text_price"),
        money["moneda"].alias("currency"),
        ranked.alias("ranked"),
        offered["precio"].alias("offered"),
        offered["moneda"].alias("offered_in"),
        numbers.price_or_policy(F.when(k % 2 == 0, p.cast("double")), k % 3 == 0).alias("policy"),
        numbers.hinted([(F.when(k % 3 == 1, "Koi Arena"), ["koi"], False), (F.when(k % 3 == 0, "la Nave"), ["nave"], True)]).alias("hinted"),
        point["lat"].alias("lat"),
        point["lon"].alias("lon"),
        numbers.near_city(lat, city).alias("near_city"),
    )


@query(
    f"""{O} SELECT k, CASE WHEN k % 3 = 0 THEN 'https://h/' || k END AS web, 'https://h.es/a/' || k AS beside, 'https://h.es/' || k AS rooted, 'https://c.es/' || k AS other_host, 'https://h.es/a/b?x=' || k AS asked, k % 2 = 0 AS specific,
  CASE WHEN k % 3 = 0 THEN 'https://www.google.com/maps/dir/?api=1&destination=40.5,-3.5' WHEN k % 3 = 1 THEN 'https://www.google.com/maps/dir/?api=1&destination=Sala+' || k END AS directions FROM o"""
)
def page_addresses(spark, d):
    """U4, U6-U8."""
    k = F.col("k")
    key, base = num(k), F.lit("https://h.es/a/b?q=1#f")
    first = k % 3 == 0
    return orders(spark, d).select(
        "k",
        urls.web_url(F.when(first, said(" https://h/", key, " ")).when(k % 3 == 1, said("ftp://h/", key))).alias("web"),
        urls.join_url(key, base).alias("beside"),
        urls.join_url(said("/", key), base).alias("rooted"),
        urls.join_url(said("//c.es/", key), base).alias("other_host"),
        urls.join_url(said("?x=", key), base).alias("asked"),
        urls.specific_purchase(F.when(k % 2 == 0, "https://t/entradas-macbeth-2024").otherwise("https://t/evento-2024"), F.lit("https://h/obras/macbeth-evento-2024"), ["evento"]).alias("specific"),
        urls.directions_url(F.when(first, F.lit(40.5)), F.when(first, F.lit(-3.5)), F.when(k % 3 == 1, said("Sala ", key))).alias("directions"),
    )


# Markup


@query(
    """SELECT p_partkey, 3 AS n_objects, p_name AS event, '{"k":' || p_size || '}' AS state, 'Cine & ' || p_brand AS terms, p_name || '|' || p_type || '|x "y"' AS strings, 'https://h/' || p_partkey || '.jpg' AS image,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://h/a.jpg' END AS real, 'Un texto que pasa de cuarenta caracteres sin duda, ' || p_name AS container, '/comprar/' || p_partkey AS bought FROM part"""
)
def page_markup(spark, d):
    """J1, J2, J4, J5, H4-H7."""
    k, name = F.col("p_partkey"), F.col("p_name")
    ld = said('<script type="application/ld+json">{"@graph":[{"@type":"Place","name":"x"},{"@type":["Thing","Event"],"name":"', name, '"}]}</script><script TYPE="application/ld+json">{"@type":"Event","name":"later"}</script>')
    state = said("<script id='__DATA__' type=\"application/json\"> {\"k\":", num(F.col("p_size")), "} </script>")
    long = "Un texto que pasa de cuarenta caracteres sin duda, "
    body = said("<section><p>Corto</p></section><article><p>", long, name, "</p></article><main><p>Corto</p><p>Otro</p></main><a href='/mas'>Más</a><a href='/comprar/", num(k), "'>Comprar entradas</a>")
    p = dealt(table(spark, d, "part"), "p_partkey").withColumn("html", said(ld, state, body)).withColumn("objects", markup.ld_objects("html"))
    term = lambda kind, v: F.struct(F.lit(kind).alias("taxonomy"), v.alias("name"))
    embedded = F.array(F.array(term("category", said("Cine &amp; ", F.col("p_brand"))), term("post_tag", F.lit("no"))), F.lit(None).cast("array<struct<taxonomy:string,name:string>>"))
    return p.select(
        "p_partkey",
        F.size("objects").alias("n_objects"),
        F.get_json_object(markup.of_type("objects", ["Event"]), "$.name").alias("event"),
        markup.embedded_state("html", "__DATA__").alias("state"),
        F.array_join(markup.terms(embedded, "category"), "|").alias("terms"),
        F.array_join(markup.json_strings(said('{"a":"', name, '","b":[1,"', F.col("p_type"), '"],"c":{"d":"x \\"y\\""}}')), "|").alias("strings"),
        markup.first_real_image(F.array(F.lit(""), F.lit("https://h/favicon.ico"), said("https://h/", num(k), ".jpg"))).alias("image"),
        markup.real_image(F.when(k % 2 == 0, "https://h/a.jpg").otherwise("https://images.unsplash.com/a.jpg")).alias("real"),
        text.strip_html(markup.best_container("html")).alias("container"),
        markup.purchase_link(markup.links("html"), ["comprar"]).alias("bought"),
    )


# Arrays, maps, links


@query(
    f"""{O} SELECT k, 'Uno|dos ' || k AS once, 'Cine|Arte' AS categories, 'a|b ' || k % 5 AS tags, 'valoracion=' || k || ';x=1' AS metadata, 'a=1;b=' || k || ';c=3' AS merged, CASE WHEN k % 2 = 0 THEN 'compra' ELSE 'detalle' END AS kind, CASE WHEN k % 2 = 0 THEN 'https://b/' || k ELSE 'https://p/' || k END AS url,
  k % 3 = 0 AS free, 'fever https://p/' || k || ' compra ' || (k % 7) || '.0|wegow https://p/' || k || ' detalle -' AS links FROM o"""
)
def merged_values(spark, d):
    """A1-A3, A7-A10 as the merge uses them."""
    k = F.col("k")
    key = num(k)
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    record = {"url_compra": F.when(k % 2 == 0, said("https://b/", key)), "url": said(" https://p/", key), "url_articulo": F.lit("https://a"), "url_fuente_editorial": F.lit(None).cast("string"), "precio": F.when(k % 3 == 0, F.lit(0.0)).otherwise(F.lit(2.0)), "es_gratis": F.lit(None).cast("boolean"), "fuente": F.lit("fever"), "moneda": F.lit("EUR")}
    own = arrays.source_link(record)
    link = lambda source, url, kind, price: F.struct(F.lit(source).alias("fuente"), url.alias("url"), F.lit(kind).alias("kind"), price.cast("double").alias("precio"), F.lit(None).cast("string").alias("moneda"), F.lit(None).cast("boolean").alias("es_gratis"))
    links = arrays.merge_links(F.array(link("fever", said("https://p/", key), "detalle", F.lit(None)), link("wegow", said("https://p/", key), "detalle", F.lit(None)), link("FEVER", said("https://P/", key, "/"), "compra", k % 7)))
    value = lambda x: F.coalesce(x["precio"].cast("string"), F.lit("-"))
    return orders(spark, d).select(
        "k",
        F.array_join(arrays.distinct_text(F.array(F.lit(" Uno "), F.lit("UNO"), F.lit(""), said("dos  ", key))), "|").alias("once"),
        F.array_join(arrays.categories(F.lit("Cine"), F.array(F.lit("cine"), F.lit("Arte"))), "|").alias("categories"),
        F.array_join(arrays.tags(F.array(F.lit("a"), F.lit("A"), said("b ", num(k % 5)))), "|").alias("tags"),
        shown(arrays.source_metadata(F.create_map(F.lit("x"), F.lit("1")), {"valoracion": key, "secciones": F.lit("")})).alias("metadata"),
        shown(arrays.merge_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), key, F.lit("c"), F.lit("3")))).alias("merged"),
        own["kind"].alias("kind"),
        own["url"].alias("url"),
        own["es_gratis"].alias("free"),
        F.array_join(F.transform(links, lambda x: F.concat_ws(" ", x["fuente"], x["url"], x["kind"], value(x))), "|").alias("links"),
    )


@query(
    f"""{O}, s AS (SELECT k, list_transform(range(12), lambda i: DATE '2024-01-10' + CAST(i * (k % 9) AS INTEGER)) AS days FROM o)
SELECT k, CASE WHEN k % 2 = 0 THEN CASE WHEN len(list_filter(days, lambda x: x >= {T})) > 0 THEN least(8, len(list_filter(days, lambda x: x >= {T}))) ELSE 1 END ELSE 0 END AS n_sessions,
  CASE WHEN k % 2 = 0 THEN CAST(CASE WHEN len(list_filter(days, lambda x: x >= {T})) > 0 THEN list_filter(days, lambda x: x >= {T})[1] ELSE days[12] END AS VARCHAR) END AS first_session,
  CAST(CASE WHEN k % 10 >= 6 THEN 5 ELSE k % 10 END AS INTEGER) AS n_links, 'compra detalle enlace' AS kinds, CASE WHEN k % 3 = 0 THEN 'Danza|Baile' ELSE 'Otros' END AS looked_up, 'Comunidad' || CASE WHEN k % 4 = 0 THEN '|Baile' ELSE '' END || CASE WHEN k % 2 = 1 THEN '|Música' ELSE '' END AS labels,
  CASE WHEN k % 3 = 0 THEN 'Cultura' WHEN k % 3 = 1 THEN 'Portada' ELSE 'Danza' END AS categories, CASE WHEN k % 2 = 0 THEN 'uno' ELSE 'dos ' || k END AS card,
  CASE WHEN k % 3 = 0 THEN '2024-01-05' WHEN k % 3 = 1 THEN '2024-01-05T10:00|2024-01-06T10:00' ELSE list_aggregate(list_transform(range(10, 21), lambda i: '2024-01-' || i), 'string_agg', '|') END AS times FROM s"""
)
def feed_values(spark, d):
    """A11, A12, A14-A19."""
    k = F.col("k")
    step = (k % 9).cast("int")
    sessions = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(F.date_add(F.lit("2024-01-10").cast("date"), (i * step).cast("int")).cast("string").alias("fecha"), F.lit(None).cast("string").alias("datetime"), F.lit(False).alias("tiene_hora")))
    slim = arrays.slim_sessions(F.when(k % 2 == 0, "multiple").otherwise("rango"), sessions, today())
    made = lambda i: F.struct(F.lit("fever").alias("fuente"), F.when(i == 2, "ftp://x").otherwise(said("https://p/", num(i))).alias("url"), F.lit("").alias("kind"), F.lit(None).cast("double").alias("precio"), F.lit(None).cast("string").alias("moneda"), F.lit(None).cast("boolean").alias("es_gratis"))
    some = F.when(k % 10 >= 1, F.transform(F.sequence(F.lit(1), (k % 10 + F.when(k % 10 >= 2, 1).otherwise(0)).cast("int")), made)).otherwise(F.array().cast(f"array<{arrays.LINK}>"))
    views = arrays.view_links(F.array(made(F.lit(1))), F.lit("fever"), F.lit("https://page"), said("https://buy/", num(k)))
    first = F.array_join(F.transform(views, lambda x: F.coalesce(F.nullif(x["kind"], F.lit("")), F.lit("enlace"))), " ")
    blob = said("open ", F.when(k % 4 == 0, "salsa").otherwise("x"), F.when(k % 2 == 1, " music").otherwise(""))
    cats = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("Portada"))).otherwise(F.array(F.lit("portada"), F.lit("Danza")))
    times = F.when(k % 3 == 0, F.array(F.lit("2024-01-05T10:00"), F.lit("2024-01-05T12:00"))).when(k % 3 == 1, F.array(F.lit("2024-01-05T10:00"), F.lit("2024-01-06T10:00"))).otherwise(F.transform(F.sequence(F.lit(10), F.lit(20)), lambda i: said("2024-01-", num(i), "T10:00")))
    return orders(spark, d).withColumn("slim", slim).select(
        "k",
        F.when(F.col("slim").isNotNull(), F.size("slim")).otherwise(0).cast("bigint").alias("n_sessions"),
        F.get("slim", F.lit(0))["fecha"].alias("first_session"),
        F.size(arrays.slim_links(some)).alias("n_links"),
        first.alias("kinds"),
        F.array_join(arrays.lookup(F.when(k % 3 == 0, " danza ").otherwise("x"), {"Danza": ["Danza", "Baile"]}, F.array(F.lit("Otros"))), "|").alias("looked_up"),
        F.array_join(arrays.keyword_labels(blob, dims.COMMUNITY_LABELS, ["Comunidad"]), "|").alias("labels"),
        F.array_join(arrays.categories_but(cats, ["portada"], ["Cultura"]), "|").alias("categories"),
        arrays.fill_card([F.when(k % 2 == 0, " uno ").otherwise(" "), said("dos ", num(k))]).alias("card"),
        F.array_join(arrays.session_values(times), "|").alias("times"),
    )


@query(f"{O} SELECT k, k % 400 >= 14 AS live, k % 3 < 2 AND k % 2 = 0 AS in_scope, k % 4 = 0 AS held FROM o")
def source_filters(spark, d):
    """Days that are still ahead, evidence of the city, words in a text."""
    k = F.col("k")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (k % 400 - n).cast("int")).cast("string")
    here = F.when(k % 3 == 0, "Madrid").when(k % 3 == 2, "Sevilla")
    evidence = F.when(k % 2 == 0, "Calle Mayor, Madrid").otherwise("Calle Mayor")
    return orders(spark, d).select("k", predicates.is_live(F.array(day(9), F.lit(None).cast("string"), day(0)), today()).alias("live"), predicates.in_scope(here, F.lit("Obra"), evidence, []).alias("in_scope"), predicates.holds_any(F.when(k % 4 == 0, "Gran FESTIVAL"), ["festival"]).alias("held"))
