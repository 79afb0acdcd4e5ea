"""The engine's queries by name, each beside the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazaflow.functions import arrays, dates, markup, numbers, text, urls
from plazaflow.operators import discover, enrich, joins, predicates, publish, resolve, validate
from plazaflow.operators.discover import Profile, State
from plazaflow.operators.nights import Nights
from plazaflow.plans import dims, fixtures
from plazaflow.plans.fixtures import SQL as RP
from plazaflow.plans.fixtures import feed, now, plans, raw_plans, table, today
from plazaflow.plans.storage import folder, stored
from plazaflow.register import ORACLE_SQL, QUERIES, query  # noqa: F401

#: SQL pieces.
CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
FOLD = "lower(strip_accents({}))"
SLUG = r"coalesce(nullif(trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'madrid-item')"
T, N = f"DATE '{fixtures.TODAY_TEXT}'", f"TIMESTAMP '{fixtures.NOW_TEXT}'"
OFFSET = "CASE WHEN {0} >= DATE '2024-03-31' THEN '+02:00' ELSE '+01:00' END"


# Text, URLs, markup, JSON


@query(f"SELECT doc_id, {CLEAN.format('text')} AS clean FROM documents")
def clean_text(spark, d):
    """T1."""
    return table(spark, d, "documents").select("doc_id", text.clean_text("text").alias("clean"))


@query(f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def fold_search(spark, d):
    """T4."""
    return table(spark, d, "documents").select("doc_id", text.fold_search("text").alias("folded"))


@query(f"{RP} SELECT doc_id, {SLUG.format('titulo')} AS slug FROM rp")
def slugify(spark, d):
    """T2."""
    return raw_plans(spark, d).select(F.col("_ord").alias("doc_id"), text.slugify("titulo").alias("slug"))


@query(f"WITH c AS (SELECT doc_id, {CLEAN.format('text')} AS v FROM documents) SELECT doc_id, CASE WHEN length(v) <= 120 THEN v ELSE regexp_replace(substr(v, 1, 119), ' [^ ]*$', '') || '…' END AS capped FROM c")
def cap_text(spark, d):
    """T7, T8; of a text that has nothing to show, an empty one."""
    nothing = F.when(F.col("text").isNotNull(), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.cap_text("text", 120), nothing).alias("capped"))


@query(f"{RP} SELECT doc_id, substr({CLEAN.format('descripcion')}, 1, 320) AS summary FROM rp")
def summary(spark, d):
    """T11, T12."""
    nothing = F.lit(None).cast("string")
    return raw_plans(spark, d).select(F.col("_ord").alias("doc_id"), text.summary("titulo", nothing, "descripcion", nothing).alias("summary"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM a)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b"""
)
def strip_html(spark, d):
    """T13."""
    return table(spark, d, "pages").select("page_id", text.strip_html("html").alias("text"))


@query(
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2) AS t FROM pages),
b AS (SELECT page_id, unnest(h) AS href, unnest(t) AS text, unnest(range(len(h))) AS pos FROM a)
SELECT page_id, CAST(pos AS INTEGER) AS pos, href, trim(replace(replace(text, '&quot;', '"'), '&amp;', '&')) AS text FROM b"""
)
def page_links(spark, d):
    """H1."""
    found = table(spark, d, "pages").select("page_id", F.posexplode(markup.links("html")).alias("pos", "a"))
    return found.select("page_id", "pos", "a.href", "a.text")


@query(r"SELECT page_id, trim(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&')) AS heading, trim(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&')) AS title FROM pages")
def page_headings(spark, d):
    """H1."""
    return table(spark, d, "pages").select("page_id", F.get(markup.headings("html"), F.lit(0)).alias("heading"), markup.page_title("html").alias("title"))


@query(
    r"""WITH a AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, host, path, nullif(regexp_extract(rtrim(path, '/'), '([^/]*)$', 1), '') AS last,
  rtrim(regexp_replace(url, '[?#].*$', ''), '/') || '/' AS normal FROM a"""
)
def url_parts(spark, d):
    """U1, U5."""
    return table(spark, d, "pages").select("page_id", urls.scheme("url").alias("scheme"), urls.host("url").alias("host"), urls.path("url").alias("path"), urls.last_segment("url").alias("last"), urls.normalize_url("url").alias("normal"))


@query(
    rf"""{RP} SELECT doc_id, 'plan:' || fuente || ':' || array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'evento' ELSE id END,
  CASE WHEN doc_id % 3 = 0 THEN nullif(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), '') END,
  CASE WHEN doc_id % 3 = 0 THEN {SLUG.format('titulo')} END, CASE WHEN doc_id % 3 = 0 THEN CAST(inicio AS VARCHAR) END], lambda x: x IS NOT NULL), '::') AS id FROM rp"""
)
def source_ids(spark, d):
    """U2, U3. Every third record has a generic id."""
    raw = raw_plans(spark, d)
    generic = F.when(F.col("_ord") % 3 == 0, F.lit("evento")).otherwise(F.col("id"))
    return raw.select(F.col("_ord").alias("doc_id"), urls.compound_id("plan", "fuente", urls.plan_source_id(generic, ["url"], "titulo", ["fecha_inicio"])).alias("id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS price FROM events")
def json_props(spark, d):
    """J, M1, M7."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.cast("bigint").alias("k"), numbers.first_number(F.get_json_object("props", "$.price"), k).alias("price"))


FREE = " OR ".join(f"contains(t, '{w}')" for w in dims.FREE_WORDS)


@query(
    rf"""WITH a AS (SELECT doc_id, lower({CLEAN.format('text')}) AS t FROM documents)
SELECT doc_id, coalesce(list_min(list_transform(regexp_extract_all(t, '\d+(?:[.,]\d+)?'), lambda x: try_cast(replace(x, ',', '.') AS DOUBLE))), CASE WHEN {FREE} THEN 0.0 END) AS price FROM a"""
)
def price_from_text(spark, d):
    """M4."""
    return table(spark, d, "documents").select("doc_id", numbers.least_price("text", adjacent=False).alias("price"))


@query(
    f"""{RP}, a AS (SELECT *, round(lat, 5) AS la, round(lon, 5) AS lo FROM rp)
SELECT doc_id, la BETWEEN 40.25 AND 40.60 AND lo BETWEEN -3.92 AND -3.48 AS inside, round(sqrt(power((la - 40.4168) * 111.32, 2) + power((lo + 3.7038) * 111.32 * cos(radians((la + 40.4168) / 2)), 2)), 6) AS km FROM a"""
)
def coordinates(spark, d):
    """M9-M12."""
    p = raw_plans(spark, d).withColumns({"la": numbers.round_coord("latitud"), "lo": numbers.round_coord("longitud")})
    km = numbers.distance_km(F.col("la"), F.col("lo"), F.lit(dims.CENTER[0]), F.lit(dims.CENTER[1]))
    return p.select(F.col("_ord").alias("doc_id"), numbers.within(F.col("la"), F.col("lo"), dims.PUBLISH_BOX).alias("inside"), F.round(km, 6).alias("km"))


# Dates and sessions


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS iso, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%H:%M:%S') NOT IN ('00:00:00', '23:59:00', '23:59:59') AS has_time FROM events")
def parse_temporal(spark, d):
    """D1, D2."""
    e = table(spark, d, "events").select("event_id", dates.parse_temporal(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"))
    return e.select("event_id", F.col("t.iso").alias("iso"), F.col("t.d").cast("string").alias("day"), F.col("t.has_time").alias("has_time"))


@query(
    f"""{RP} SELECT doc_id, CASE WHEN inicio = fin THEN 'puntual' ELSE 'rango' END AS mode,
  CASE WHEN fin < {T} THEN 'pasado' WHEN inicio <= {T} THEN 'en_curso' ELSE 'proximo' END AS status,
  CAST(fin AS VARCHAR) || 'T23:59:59' || {OFFSET.format('fin')} AS until,
  CAST(CASE WHEN inicio >= {T} THEN inicio WHEN fin >= {T} THEN fin END AS VARCHAR) AS next_day FROM rp"""
)
def normalized_dates(spark, d):
    """D3, D5, D8-D11 through R1."""
    return plans(spark, d).select(F.col("_ord").alias("doc_id"), F.col("modo_fecha").alias("mode"), F.col("estado_temporal").alias("status"), F.col("vigente_hasta").alias("until"), F.col("proxima_fecha").alias("next_day"))


@query(
    rf"""{RP} SELECT doc_id, 'plan:' || fuente || ':' || id AS id, {SLUG.format('titulo')} AS slug, substr({CLEAN.format('descripcion')}, 1, 320) AS resumen,
  categoria AS main, precio, precio = 0 AS free, CAST(publicado AS VARCHAR) || 'T00:00:00+01:00' AS published FROM rp"""
)
def normalized_plans(spark, d):
    """R1."""
    return plans(spark, d).select(F.col("_ord").alias("doc_id"), "id", "slug", "resumen", F.col("categoria_principal").alias("main"), "precio", F.col("es_gratis").alias("free"), F.col("publicado_en").alias("published"))


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS b, 1 + o_orderkey % 3 AS step FROM orders),
e AS (SELECT o_orderkey, a, step, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS x FROM o),
k AS (SELECT o_orderkey, CAST(x AS DATE) AS day FROM e WHERE isodow(x) IN (1, 3) AND (date_diff('day', CAST(date_trunc('week', a) AS DATE), CAST(x AS DATE)) // 7) % step = 0)
SELECT o.o_orderkey, CAST(CASE WHEN count(day) = 0 THEN 1 ELSE count(day) END AS INTEGER) AS n, CAST(coalesce(min(day), min(o.a)) AS VARCHAR) AS first_day, CAST(coalesce(max(day), min(o.a)) AS VARCHAR) AS last_day FROM o LEFT JOIN k USING (o_orderkey) GROUP BY 1"""
)
def weekly_recurrence(spark, d):
    """D23."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    k = F.col("o_orderkey")
    days = dates.weekly(F.col("a"), F.date_add("a", (k % 60).cast("int")), F.lit("MO,WE"), (1 + k % 3), F.lit(""))
    return o.select("o_orderkey", days.alias("s")).select("o_orderkey", F.size("s").alias("n"), F.array_min("s").cast("string").alias("first_day"), F.array_max("s").cast("string").alias("last_day"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_id * 11 % 12 * 100 + event_id * 7 % 28 + 101 AS md FROM events),
l AS (SELECT *, lag(md) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e)
SELECT event_id, CAST(2024 + sum(CASE WHEN md < p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS year FROM l"""
)
def year_inference(spark, d):
    """D22, W3. Cards with a month and a day, in order: a step back in the year is the next one."""
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", (k * 11 % 12 * 100 + k * 7 % 28 + 101).alias("md"))
    return joins.infer_years(e, "user_id", "event_id", "md", 2024).select("event_id", "year")


# Filters


@query(f"{RP} SELECT doc_id FROM rp WHERE fin >= {T} AND inicio <= {T} + 365")
def current_plans(spark, d):
    """P1."""
    return plans(spark, d).where(predicates.is_current_plan(today())).select(F.col("_ord").alias("doc_id"))


@query(f"{RP} SELECT doc_id FROM rp WHERE CAST(publicado AS TIMESTAMP) >= {N} - INTERVAL 21 DAY")
def recent_news(spark, d):
    """P2."""
    return raw_plans(spark, d).where(predicates.is_recent_news(now(), "fecha_publicacion", F.lit(None).cast("string"))).select(F.col("_ord").alias("doc_id"))


BLOB = FOLD.format("titulo || ' ' || descripcion || ' ' || coalesce(lugar, '')")


@query(f"{RP} SELECT doc_id FROM rp WHERE contains({BLOB}, 'supplier#00') AND contains({BLOB}, 'the')")
def text_search(spark, d):
    """T5, P10."""
    p = raw_plans(spark, d).withColumn("blob", text.search_blob(F.col("titulo"), F.col("descripcion"), F.col("lugar")))
    return p.where(predicates.matches_text("Supplier#00 thé", "blob")).select(F.col("_ord").alias("doc_id"))


@query(f"{RP} SELECT doc_id FROM rp WHERE fuente = 'fever' OR (categoria = 'Cine' AND precio = 0)")
def facet_filter(spark, d):
    """P6-P8."""
    p = plans(spark, d)
    chosen = predicates.of_source("fever") | (predicates.of_category("Cine", "categorias") & predicates.free("es_gratis"))
    return p.where(chosen).select(F.col("_ord").alias("doc_id"))


#: The dates that the discovery view works out, in SQL, for plans without times.
VIEW = f"""{RP}, v AS (SELECT *, CASE WHEN inicio < {T} THEN {N} ELSE CAST(inicio AS TIMESTAMP) + INTERVAL 12 HOUR END AS prim, inicio < {T} AS ongoing, CAST(fin AS TIMESTAMP) + INTERVAL 12 HOUR AS fin_ts FROM rp
  WHERE fin >= {T} AND titulo <> '')
"""


@query(
    f"""{VIEW} SELECT doc_id, prim >= {T} AND prim < {T} + 1 AS is_today, (prim >= {T} + 1 AND prim < {T} + 2) OR (ongoing AND fin_ts >= {T} + 1) AS is_tomorrow,
  prim < {T} + 8 AS is_week, (prim >= DATE '2024-01-20' AND prim < DATE '2024-01-22') OR (ongoing AND fin_ts >= DATE '2024-01-20') AS is_weekend, prim < DATE '2024-02-16' AS is_month FROM v"""
)
def date_filter(spark, d):
    """D35, D37, D38, P11."""
    return discover.view_events(feed(spark, d), now()).select(F.col("_ord").alias("doc_id"), "is_today", "is_tomorrow", "is_week", "is_weekend", "is_month")


KM = "sqrt(power(({0} - lat) * 111.32, 2) + power(({1} - lon) * 111.32 * cos(radians((lat + {0}) / 2)), 2))"


@query(f"{RP} SELECT doc_id FROM rp WHERE CASE WHEN lat BETWEEN 40.25 AND 40.60 AND lon BETWEEN -3.92 AND -3.48 THEN {KM.format('40.411', '(-3.676)')} <= 1.7 ELSE false END")
def zone_filter(spark, d):
    """P9."""
    p = plans(spark, d)
    return p.where(predicates.in_zone("Retiro", "latitud", "longitud", text.location_label("lugar", "direccion"))).select(F.col("_ord").alias("doc_id"))


ZONES = ", ".join(f"('{n}', {a}::DOUBLE, {o}::DOUBLE, {r}::DOUBLE)" for n, a, o, r in dims.ZONES)


@query(f"{RP} SELECT name AS zone, doc_id FROM rp JOIN (VALUES {ZONES}) AS z(name, zlat, zlon, radius) ON {KM.format('zlat', 'zlon')} <= radius")
def zone_join(spark, d):
    """Q7."""
    return joins.near_zones(plans(spark, d)).select("zone", F.col("_ord").alias("doc_id"))


# Joins


PRIORITY = ", ".join(f"('{s}', {p})" for s, p in dims.SOURCE_PRIORITY.items())


@query(f"{RP} SELECT doc_id, coalesce(prio, 99) AS prio FROM rp LEFT JOIN (VALUES {PRIORITY}) AS p(s, prio) ON s = fuente")
def source_priority_join(spark, d):
    """Q4."""
    return raw_plans(spark, d).select(F.col("_ord").alias("doc_id"), resolve.source_priority("fuente").alias("prio"))


@query(f"{RP} SELECT doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 40.0 + s_suppkey / 1000.0 END AS lat FROM rp LEFT JOIN supplier ON s_name = lugar")
def cache_join(spark, d):
    """Q2, Q3, R5. Coordinates from a cache that holds every other venue."""
    venues = table(spark, d, "supplier")
    address = F.lower(enrich.clean_address("s_name"))
    cache = venues.where("s_suppkey % 2 = 0").select(address.alias("cache_key"), (F.lit(40.0) + F.col("s_suppkey") / 1000.0).alias("lat"), F.lit(-3.7).alias("lon"), F.col("s_name").alias("query"))
    bare = plans(spark, d).withColumns({"latitud": F.lit(None).cast("double"), "longitud": F.lit(None).cast("double")})
    return enrich.geocode(bare, cache).select(F.col("_ord").alias("doc_id"), F.col("latitud").alias("lat"))


TOKENS = f"list_sort(list_distinct(string_split({SLUG.format('titulo')}, '-')))"


@query(
    f"""{RP}, t AS (SELECT doc_id, inicio, {TOKENS} AS k, length(replace({SLUG.format('titulo')}, '-', '')) AS letters FROM rp), u AS (SELECT * FROM t WHERE len(k) > 1 AND letters >= 10)
SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.inicio = b.inicio AND a.doc_id <> b.doc_id AND list_has_all(b.k, a.k) AND (len(a.k) >= 3 OR len(a.k) = len(b.k))"""
)
def fuzzy_pairs(spark, d):
    """Q5. Pairs on one day where one title's words are among the other's."""
    p = raw_plans(spark, d).select(F.col("_ord").alias("id"), F.col("fecha_inicio").alias("day"), resolve.title_tokens("titulo").alias("tokens"))
    return joins.containment_pairs(p.where("tokens is not null"), "id", "day", "tokens")


@query(
    f"""WITH s AS (SELECT s_suppkey, substr(s_name, 1, CAST(12 + s_suppkey % 7 AS INTEGER)) AS place FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey AND starts_with({SLUG.format('b.place')}, {SLUG.format('a.place')})"""
)
def place_prefix_pairs(spark, d):
    """Q6."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("id"), text.slugify(F.substring("s_name", F.lit(1), (12 + k % 7).cast("int"))).alias("place"))
    return joins.prefix_pairs(s, "id", "place")


# Entity resolution

CANDIDATE = r"CASE WHEN fuente <> 'esmadrid' THEN lower(rtrim(url, '/')) END"
KEY = f"coalesce({CANDIDATE}, {SLUG.format('titulo')} || '::' || CAST(inicio AS VARCHAR) || '::' || {SLUG.format('lugar')})"


@query(f"{RP} SELECT {KEY} AS merge_key, count(*) AS n, min(doc_id) AS first_id FROM rp GROUP BY 1")
def merge_key_groups(spark, d):
    """E1-E3."""
    p = plans(spark, d)
    return p.groupBy(resolve.merge_key(resolve.columns_of(p)).alias("merge_key")).agg(F.count(F.lit(1)).alias("n"), F.min("_ord").alias("first_id"))


#: The records that lead exact merges: w, with the leader m (d, rank r, length n, price p) of each key.
EXACT = f"""p AS (SELECT rp.*, {KEY} AS k, coalesce(prio, 99) AS rank, length({CLEAN.format('descripcion')}) AS n FROM rp LEFT JOIN (VALUES {PRIORITY}) AS q(s, prio) ON s = fuente),
g AS (SELECT k, min(doc_id) AS first_id, count(DISTINCT fuente) AS n_sources, count(DISTINCT fuente || id) AS n_ids, max(n) AS longest, list({{'d': doc_id, 'r': rank, 'n': n, 'p': precio}} ORDER BY doc_id) AS l FROM p GROUP BY k),
w AS (SELECT *, list_reduce(l, lambda a, x: CASE WHEN x.r < a.r OR (x.r = a.r AND x.n > a.n) THEN {{'d': x.d, 'r': x.r, 'n': greatest(a.n, x.n), 'p': CASE WHEN x.p = 0 THEN a.p ELSE x.p END}}
  ELSE {{'d': a.d, 'r': a.r, 'n': greatest(a.n, x.n), 'p': CASE WHEN a.p = 0 THEN x.p ELSE a.p END}} END) AS m FROM g)"""


@query(
    f"""{RP}, {EXACT}
SELECT first_id, n_sources, n_ids, longest, m.p AS precio, m.p = 0 AS es_gratis, 'plan:' || fuente || ':' || id AS id, fuente, titulo, lugar, CAST(inicio AS VARCHAR) AS fecha_inicio, CAST(fin AS VARCHAR) AS fecha_fin, url FROM w JOIN rp ON doc_id = m.d"""
)
def merge_exact(spark, d):
    """The record that leads each merge, by source and completeness, and what the others add to it."""
    return led(resolve.merge_exact(plans(spark, d)))


def led(m):
    counted = [F.size("fuentes_relacionadas").cast("bigint").alias("n_sources"), F.size("ids_relacionados").cast("bigint").alias("n_ids"), F.length("contenido").cast("bigint").alias("longest")]
    return m.select(F.col("_ord").alias("first_id"), *counted, "precio", "es_gratis", "id", "fuente", "titulo", "lugar", "fecha_inicio", "fecha_fin", "url")


@query(ORACLE_SQL["merge_exact"])
def second_night(spark, d):
    """Exact merges of the night after one whose records with ids divisible by ten had another price; the groups
    without such a record are not merged again."""
    place, all_ = f"{folder(spark)}/nights-{uuid.uuid4().hex}", stored(plans(spark, d))
    earlier = all_.withColumn("precio", F.when(F.col("_ord") % 10 == 0, F.lit(1.5)).otherwise(F.col("precio")))
    for night, rows in (("1", earlier), ("2", all_)):
        nights = Nights(spark, place, night, fixtures.SCRAPED)
        m = resolve.merge_exact(nights.marked(rows), nights=nights)
        nights.commit()
    return led(m)


#: Exact merges, then those of a day, record by record: each goes into the first open one that holds its words at its place.
DAYS = f"""{RP.replace("WITH ", "WITH RECURSIVE ", 1)}, {EXACT},
x AS (SELECT first_id, n_ids, m.d AS d, m.r AS r, m.n AS n, inicio AS day, {TOKENS} AS k, length(replace({SLUG.format('titulo')}, '-', '')) AS letters, {SLUG.format('lugar')} AS place FROM w JOIN rp ON doc_id = m.d),
o AS (SELECT *, row_number() OVER (ORDER BY day, len(k) DESC, first_id) AS i FROM x WHERE len(k) > 1 AND letters >= 10),
f(i, held) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, day DATE, k VARCHAR[], place VARCHAR, r INTEGER, n BIGINT, d BIGINT, n_ids BIGINT)[])
  UNION ALL SELECT i, CASE WHEN t IS NULL THEN list_append(held, {{'i': i, 'day': day, 'k': k, 'place': place, 'r': CAST(r AS INTEGER), 'n': n, 'd': d, 'n_ids': n_ids}})
    ELSE list_transform(held, lambda e: CASE WHEN e.i <> t THEN e WHEN r < e.r OR (r = e.r AND n > e.n) THEN {{'i': e.i, 'day': day, 'k': e.k, 'place': place, 'r': CAST(r AS INTEGER), 'n': greatest(n, e.n), 'd': d, 'n_ids': n_ids + e.n_ids}}
      ELSE {{'i': e.i, 'day': day, 'k': e.k, 'place': e.place, 'r': e.r, 'n': greatest(n, e.n), 'd': e.d, 'n_ids': n_ids + e.n_ids}} END) END
  FROM (SELECT o.*, held, list_filter(held, lambda e: e.day = o.day AND list_has_all(e.k, o.k) AND (len(o.k) >= 3 OR len(o.k) = len(e.k)) AND (starts_with(e.place, o.place) OR starts_with(o.place, e.place)))[1].i AS t FROM f JOIN o ON o.i = f.i + 1)),
z AS (SELECT unnest(held) AS e FROM f WHERE i = (SELECT max(i) FROM f)),
days AS (SELECT e.d AS d, e.n_ids AS n_ids FROM z UNION ALL SELECT d, n_ids FROM x WHERE NOT (len(k) > 1 AND letters >= 10))"""


@query(f"{DAYS} SELECT 'plan:' || fuente || ':' || id AS id, titulo, CAST(inicio AS VARCHAR) AS fecha_inicio, CAST(n_ids AS INTEGER) AS n_ids FROM days JOIN rp ON doc_id = d")
def fuzzy_same_day(spark, d):
    """E4."""
    m = resolve.merge_same_day(resolve.merge_exact(plans(spark, d)))
    return m.select("id", "titulo", "fecha_inicio", F.size("ids_relacionados").alias("n_ids"))


@query()
def recurring_groups(spark, d):
    """E6, E7."""
    m = resolve.merge_recurring(resolve.merge_same_day(resolve.merge_exact(plans(spark, d))), fixtures.TODAY_TEXT)
    return m.select("id", "titulo", "modo_fecha", "fecha_inicio", "fecha_fin", "proxima_fecha", F.size("sesiones").alias("n_sessions"), F.size("ids_relacionados").alias("n_ids"))


@query()
def merge_plans(spark, d):
    """E11."""
    m = resolve.merge_plans(plans(spark, d), fixtures.TODAY_TEXT)
    return m.select("id", "fuente", "titulo", "fecha_inicio", "fecha_fin", "precio", "es_gratis", F.size("ids_relacionados").alias("n_ids"), F.size("source_links").alias("n_links"))


def news_items(spark, d):
    """News made from the same records: one address for about four of them."""
    p = plans(spark, d)
    return p.select(F.concat(F.lit("https://n/"), (F.col("_ord") % 251).cast("string")).alias("url"), "id", "fuente", "fuente_id", "titulo", "subtitulo", "resumen", "descripcion", "contenido", "categorias", "etiquetas", "autor", "imagen", "publicado_en", "actualizado_en", "categoria_principal", "metadata", F.col("publicado_en").alias("sort_datetime"), F.lit("noticia").alias("tipo"), "_ord")


@query(
    f"""{RP}, m AS (SELECT *, doc_id % 251 AS k, {CLEAN.format('descripcion')} AS t FROM rp)
SELECT 'https://n/' || k AS url, arg_min(titulo, doc_id) AS titulo, max(length(t)) AS longest, count(DISTINCT fuente) AS n_sources, count(DISTINCT categoria) AS n_categories, CAST(arg_min(publicado, doc_id) AS VARCHAR) || 'T00:00:00+01:00' AS published
FROM m GROUP BY k"""
)
def merge_news(spark, d):
    """E12."""
    m = resolve.merge_news(news_items(spark, d))
    return m.select("url", "titulo", F.length("contenido").cast("bigint").alias("longest"), F.size("fuentes_relacionadas").cast("bigint").alias("n_sources"), F.size("categorias").cast("bigint").alias("n_categories"), F.col("publicado_en").alias("published"))


@query(f"{RP} SELECT lugar, count(DISTINCT fuente || '::' || lower(rtrim(url, '/'))) AS n_links, max(fuente || '::' || lower(rtrim(url, '/'))) AS last_key, count(DISTINCT fuente || '::' || lower(rtrim(url, '/'))) FILTER (WHERE precio = 0) AS n_free FROM rp GROUP BY lugar")
def source_links(spark, d):
    """A9, A10 over rows: a venue's links, each once, with whether any record of a link is free."""
    return joins.venue_links(plans(spark, d)).groupBy("lugar").agg(F.count(F.lit(1)).alias("n_links"), F.max("link_key").alias("last_key"), F.count_if("free").alias("n_free"))


# Taxonomy, validation, publishing


def _rule_sql(blob: str) -> str:
    """Categories whose rules hit a text, as a list in order. RE2 has neither look-ahead nor Unicode word edges: the former
    is left out (none of these texts meets one), the latter spelled out."""
    word = r"[^\p{L}\p{N}_]"
    found: dict[str, list[str]] = {}
    for pattern, category in dims.RULES:
        flat = re.sub(r"\(\?![^()]*(\([^()]*\))?[^()]*\)", "", pattern.removeprefix(r"\b")).replace(r"\b", f"($|{word})")
        found.setdefault(category, []).append(f"regexp_matches({blob}, '(?i)(^|{word}){flat}')")
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(hits)} THEN '{c}' END" for c, hits in found.items()) + "], lambda x: x IS NOT NULL)"


#: The categories of rp's records in SQL: norm, one list a record.
NORMALIZED = f"""b AS (SELECT doc_id, concat_ws(' ', nullif(titulo, ''), lugar, categoria, categoria, fuente) AS strong, concat_ws(' ', substr({CLEAN.format('descripcion')}, 1, 320), {CLEAN.format('descripcion')}) AS weak FROM rp),
s AS (SELECT doc_id, {_rule_sql('strong')} AS a, {_rule_sql('weak')} AS w FROM b),
m AS (SELECT doc_id, CASE WHEN len(a) >= 2 THEN a ELSE a || (list_filter(w, lambda x: NOT list_contains(a, x)))[1:(2 - len(a))] END AS l FROM s),
norm AS (SELECT doc_id, (CASE WHEN len(l) = 0 THEN ['{dims.LEISURE}'] WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> '{dims.LEISURE}') ELSE l END)[1:3] AS cats FROM m)"""


@query(f"{RP}, {NORMALIZED} SELECT doc_id, array_to_string(cats, '|') AS labels FROM norm")
def classify(spark, d):
    """R3, R4."""
    return enrich.classify(plans(spark, d)).select(F.col("_ord").alias("doc_id"), F.array_join("categorias_normalizadas", "|").alias("labels"))


@query(f"{RP} SELECT count(*) AS total, count(precio) AS with_price, count(lugar) AS with_location, bool_and(fin >= {T} AND titulo <> '') AS valid, CAST(least(50, sum(CASE WHEN fin < {T} THEN 1 ELSE 0 END + CASE WHEN titulo = '' THEN 1 ELSE 0 END)) AS INTEGER) AS n_errors FROM rp")
def validate_plans(spark, d):
    """G1."""
    return validate.validate_plans(plans(spark, d), today()).select("total", "with_price", "with_location", "valid", F.size("errors").alias("n_errors"))


@query(f"{RP} SELECT fuente AS source, count(*) AS n FROM rp GROUP BY 1")
def validate_by_source(spark, d):
    """Counts by source."""
    return validate.validate_plans(plans(spark, d), today()).select(F.explode("by_source").alias("source", "n"))


@query(f"{RP} SELECT categoria AS category, count(*) AS n FROM rp GROUP BY 1")
def validate_news(spark, d):
    """Counts by category."""
    return validate.validate_news(news_items(spark, d), now()).select(F.explode("by_category").alias("category", "n"))


# Aggregations


@query(
    f"""{VIEW}, c AS (SELECT *, round(lat, 4) AS la, round(lon, 4) AS lo FROM v WHERE lat BETWEEN 40.25 AND 40.60 AND lon BETWEEN -3.92 AND -3.48)
SELECT la AS lat, lo AS lon, count(*) AS n, round(least(15.0, 8.0 + 2.0 * log2(count(*))), 6) AS radius FROM c GROUP BY 1, 2"""
)
def map_points(spark, d):
    """G12."""
    return discover.map_points(discover.view_events(feed(spark, d), now()))


@query(f"{VIEW} SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, 'plan:' || fuente || ':' || id AS id FROM v WHERE round(lat, 5) BETWEEN 40.25 AND 40.60 AND round(lon, 5) BETWEEN -3.92 AND -3.48")
def map_members(spark, d):
    """The plans of each mark."""
    return discover.map_members(discover.view_events(feed(spark, d), now()))


@query(
    f"""{VIEW}, {NORMALIZED}, e AS (SELECT 'source' AS facet, fuente AS value, doc_id FROM v UNION ALL SELECT 'category', unnest(cats), doc_id FROM norm SEMI JOIN v USING (doc_id))
SELECT facet, value, count(*) AS n, min(doc_id) AS first FROM e GROUP BY 1, 2"""
)
def facets(spark, d):
    """G3."""
    return discover.facets(discover.view_events(feed(spark, d), now())).select("facet", "value", "n", "first")


@query(f"{VIEW} SELECT count(*) AS total, count(*) FILTER (WHERE (prim < {T} + 1 OR ongoing) AND precio = 0) AS free_today, count(*) FILTER (WHERE prim < {T} + 1 OR ongoing) AS today, count(*) FILTER (WHERE lat BETWEEN 40.25 AND 40.60 AND lon BETWEEN -3.92 AND -3.48) AS with_coordinates, (SELECT count(*) FROM documents) AS news FROM v")
def city_stats(spark, d):
    """G4."""
    return discover.city_stats(discover.view_events(feed(spark, d), now()), table(spark, d, "documents").select("doc_id"))


@query(
    """WITH f AS (SELECT event_type, event_id FROM events WHERE event_id % 2 = 0 AND event_type IN ('view', 'click')), p AS (SELECT event_type, event_id FROM events WHERE event_id % 2 = 1)
SELECT event_type AS source, event_id, false AS stale FROM f UNION ALL SELECT event_type, event_id, true FROM p WHERE event_type NOT IN (SELECT event_type FROM f)"""
)
def lkg_reconcile(spark, d):
    """X1, X3, Q11, G13. Fresh records of the sources that have any, the last known ones of the others."""
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), "event_id")
    return joins.last_known_good(e.where("event_id % 2 = 0 and source in ('view', 'click')"), e.where("event_id % 2 = 1"), "source")


@query(
    f"""{RP}, k AS (SELECT lower(lugar || ', madrid, españa') AS cache_key, min(doc_id) AS first_id FROM rp WHERE lugar NOT LIKE '%7' GROUP BY 1)
SELECT cache_key, first_id FROM k ORDER BY first_id LIMIT 30"""
)
def geocode_cap(spark, d):
    """W5, P13, R6."""
    bare = plans(spark, d).withColumns({"latitud": F.lit(None).cast("double"), "longitud": F.lit(None).cast("double")})
    cached = table(spark, d, "supplier").where("s_name like '%7'").select(F.lower(enrich.clean_address("s_name")).alias("cache_key"))
    return enrich.lookups(bare, cached, 30).select("cache_key", F.col("_ord").alias("first_id"))


@query(f"WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS url, unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)))) AS i FROM pages) SELECT page_id, arg_min(url, (CASE WHEN contains(lower(url), 'th') THEN 0 ELSE 1000 END) + i) AS image FROM c GROUP BY 1")
def image_argmax(spark, d):
    """H2, H3. Anchors stand for picture candidates; those with "th" in the address are preferred."""
    none = F.lit(None).cast("int")
    candidates = F.transform(markup.links("html"), lambda a, i: F.struct(a["href"].alias("url"), F.lit("img").alias("source"), F.lit("").alias("alt"), none.alias("width"), none.alias("height"), i.alias("index")))
    return table(spark, d, "pages").select("page_id", markup.best_image(candidates, ["th"]).alias("image"))


# Ranking


@query(f"{RP}, o AS (SELECT doc_id, CAST(CASE WHEN inicio >= {T} THEN inicio WHEN fin >= {T} THEN fin END AS VARCHAR) AS nx, publicado, titulo, CASE WHEN inicio >= {T} THEN inicio WHEN fin >= {T} THEN fin ELSE publicado END AS dy FROM rp) SELECT doc_id, row_number() OVER (ORDER BY CAST(dy AS VARCHAR) || 'T00:00:00' || {OFFSET.format('dy')}, lower(titulo), doc_id) AS rank FROM o")
def plan_sort(spark, d):
    """S1."""
    return discover.with_rank(plans(spark, d).select("modo_fecha", "titulo", "sort_datetime", "actualizado_en", "publicado_en", "_ord"), discover.plan_order()).select(F.col("_ord").alias("doc_id"), "rank")


@query(f"{RP} SELECT doc_id, row_number() OVER (ORDER BY publicado DESC, lower(titulo) DESC, doc_id) AS rank FROM rp")
def news_sort(spark, d):
    """S2, S11."""
    n = raw_plans(spark, d).select(F.col("fecha_publicacion").alias("sort_datetime"), "titulo", "_ord")
    return discover.with_rank(n, discover.news_order()).select(F.col("_ord").alias("doc_id"), "rank")


SEARCHED = FOLD.format(f"concat_ws(' ', {CLEAN.format('titulo')}, substr({CLEAN.format('descripcion')}, 1, 320), {CLEAN.format('descripcion')}, lugar)")
SCORE = f"least(99, CASE WHEN prim < {T} + 1 THEN 8 ELSE 0 END + CASE WHEN precio = 0 THEN 3 ELSE 0 END + least(28, 7 * (contains({SEARCHED}, 'the')::INT + contains({SEARCHED}, 'ing')::INT + contains({SEARCHED}, 'sch')::INT)) + CASE WHEN precio = 0 OR precio <= 25 THEN 12 ELSE 0 END)"
TASTE = Profile(interests=("the", "ing", "sch"), answered=True, budget="moderate")


@query(f"{VIEW} SELECT doc_id, {SCORE} AS score FROM v")
def score_events(spark, d):
    """S4."""
    return discover.view_events(feed(spark, d), now()).select(F.col("_ord").alias("doc_id"), discover.score(TASTE).alias("score"))


RANKED = f"{VIEW}, s AS (SELECT *, {SCORE} AS score, 'plan:' || fuente || ':' || id AS pid FROM v)"


@query(f"{RANKED} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, CAST(prim AS DATE), ongoing, prim, titulo COLLATE es, titulo, pid) AS rank FROM s")
def rank_events(spark, d):
    """S5, R14."""
    view = discover.view_events(feed(spark, d), now())
    scored = discover.filtered(view, State()).withColumn("score", discover.score(TASTE)).select("score", "primary", "ongoing", "titulo", "id", "_ord")
    return discover.with_rank(scored, discover.rank_order(True)).select(F.col("_ord").alias("doc_id"), "score", "rank")


@query(f"{RANKED} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, prim, pid) AS rank FROM s WHERE score > 20 QUALIFY rank <= 6")
def featured(spark, d):
    """S7, P15."""
    return discover.featured(discover.view_events(feed(spark, d), now()), TASTE).select(F.col("_ord").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"{VIEW} SELECT doc_id, row_number() OVER (ORDER BY prim, doc_id) AS rank FROM v QUALIFY rank BETWEEN 13 AND 24")
def visible_page(spark, d):
    """S3, S8. The second page of the feed."""
    view = discover.view_events(feed(spark, d), now())
    return discover.first_rows(view, [F.col("primary").asc_nulls_last(), F.col("_ord")], 24).where("rank > 12").select(F.col("_ord").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY replace(replace(p_name, 'n', 'ñ'), 'a', CASE WHEN p_partkey % 2 = 0 THEN 'á' ELSE 'A' END) COLLATE es, p_partkey) AS rank FROM part")
def spanish_titles(spark, d):
    """S5. The order of titles: ñ between n and o, letters with and without marks, in either case, beside one another."""
    marked = F.replace(F.replace("p_name", F.lit("n"), F.lit("ñ")), F.lit("a"), F.when(F.col("p_partkey") % 2 == 0, "á").otherwise("A"))
    return discover.with_rank(table(spark, d, "part").select("p_partkey", F.collate(marked, "es").alias("title")), [F.col("title"), F.col("p_partkey")]).select("p_partkey", F.col("rank").cast("bigint").alias("rank"))


#: A list in which the first row that may be shown comes next, one by one.
VARIED = f"""{RANKED.replace("WITH ", "WITH RECURSIVE ", 1)}, {NORMALIZED.replace("s AS (", "s2 AS (", 1).replace("FROM s)", "FROM s2)", 1)},
r AS (SELECT pid AS id, cats[1] AS kind, row_number() OVER (ORDER BY CAST(prim AS DATE), ongoing, prim, titulo COLLATE es, titulo, pid) AS rank FROM s JOIN norm USING (doc_id)),
w(step, waiting, a, b, pick) AS (SELECT 0, list({{'rank': rank, 'kind': kind}} ORDER BY rank), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM r
  UNION ALL SELECT step + 1, list_filter(waiting, lambda x: x.rank <> nxt.rank), b, nxt.kind, nxt.rank
  FROM (SELECT *, coalesce(list_filter(waiting, lambda x: NOT coalesce(a = b AND x.kind = b, false))[1], waiting[1]) AS nxt FROM w WHERE len(waiting) > 0))"""


@query(f"{VARIED} SELECT id, kind AS primary_category, rank, step AS place FROM w JOIN r ON r.rank = w.pick")
def diversify(spark, d):
    """S6. The neutral browse view, all of it."""
    return discover.discover(discover.view_events(feed(spark, d), now()), State(show=None)).select("id", "primary_category", F.col("rank").cast("bigint").alias("rank"), F.col("place").cast("int").alias("place"))


ASKED = f"{RANKED}, f AS (SELECT *, row_number() OVER (ORDER BY CAST(prim AS DATE), ongoing, prim, titulo COLLATE es, titulo, pid) AS rank FROM s WHERE contains({SEARCHED}, 'supplier#0') AND contains({SEARCHED}, 'the') AND (prim < {T} + 8 OR ongoing))"


@query(f"{ASKED} SELECT pid AS id, titulo, rank, CAST(CAST(prim AS DATE) AS VARCHAR) AS day, ongoing, CASE WHEN precio = 0 THEN 'Gratis' END AS free_label FROM f WHERE rank <= 12")
def discover_page(spark, d):
    """The flagship: search and date filter over the classified feed, ranked, one page."""
    view = discover.view_events(feed(spark, d), now())
    page = discover.discover(view, State(query="SUPPLIER#0 thé", date_filter="week"))
    return page.select("id", "titulo", F.col("rank").cast("bigint").alias("rank"), F.col("primary").cast("date").cast("string").alias("day"), "ongoing", F.when(F.col("price_label") == "Gratis", F.col("price_label")).alias("free_label"))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Extension: tumbling windows, as the streaming query counts them."""
    from plazaflow.streaming.windows import tumbling

    out = tumbling(table(spark, d, "events"), "1 hour")
    return out.select(F.date_format(F.col("start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


from plazaflow import catalog_functions, catalog_operators, catalog_sources, catalog_sql  # noqa: E402, F401  register their queries
