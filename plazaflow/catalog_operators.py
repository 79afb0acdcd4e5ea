"""Queries of operators over records: sessions, joins, sinks, the nightly run."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazaflow.catalog_functions import CLEAN, SUMMER, O, T, num, orders, said
from plazaflow.functions import dates, text
from plazaflow.operators import discover, enrich, index, joins, normalize, pipeline, publish
from plazaflow.plans import dims, fixtures
from plazaflow.plans.fixtures import SQL as RP
from plazaflow.plans.fixtures import feed, now, plans, raw_plans, table, today
from plazaflow.plans.storage import folder, kept
from plazaflow.register import ORACLE_SQL, query
from plazaflow.sources.registry import read_cache, read_feed

N = f"TIMESTAMP '{fixtures.NOW_TEXT}'"
OFFSET = "CASE WHEN {0} >= DATE '2024-03-31' THEN '+02:00' ELSE '+01:00' END"
VIEW = f"""{RP}, v AS (SELECT *, 'plan:' || fuente || ':' || id AS pid, CASE WHEN inicio < {T} THEN {N} ELSE CAST(inicio AS TIMESTAMP) + INTERVAL 12 HOUR END AS prim, inicio < {T} AS ongoing FROM rp WHERE fin >= {T} AND titulo <> '')"""


def view(spark, d):
    return discover.view_events(feed(spark, d), now())


# Sessions


@query(
    f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type <> 'view' AND strftime(ts, '%H:%M:%S') NOT IN ('00:00:00', '23:59:00', '23:59:59') AS timed, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS iso FROM events),
a AS (SELECT user_id, day, bool_or(timed) AS any_timed FROM e GROUP BY ALL),
s AS (SELECT DISTINCT e.user_id, day, CASE WHEN timed THEN iso END AS w FROM e JOIN a USING (user_id, day) WHERE timed OR NOT any_timed),
l AS (SELECT user_id, list({{'d': day, 'a': w}} ORDER BY day, w) AS l FROM s GROUP BY user_id),
o AS (SELECT user_id, len(l) AS n, CASE WHEN len(l) <= 2 THEN l WHEN len(list_filter(l, lambda x: x.d >= {T})) > 0 THEN list_filter(l, lambda x: x.d >= {T}) ELSE l[len(l):] END AS out FROM l)
SELECT user_id, CAST(n AS INTEGER) AS n, CAST(len(out) AS INTEGER) AS published, CAST(out[1].d AS VARCHAR) AS fecha, out[1].a AS datetime, out[1].a IS NOT NULL AS tiene_hora, CAST(list_filter(out, lambda x: x.d >= {T})[1].d AS VARCHAR) AS next_day FROM o"""
)
def user_sessions(spark, d):
    """A user's events are the sessions of a plan; views have no time."""
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"))
    none = F.lit(None).cast("string")
    s = e.groupBy("user_id").agg(F.collect_list("at").alias("all")).withColumn("s", dates.sessions("all", none, none))
    s = s.withColumn("out", dates.output_sessions("s", today()))
    s = s.withColumn("first", F.transform("out", dates.session)[0])
    nothing = F.lit(None).cast(dates.TEMPORAL)
    return s.select("user_id", F.size("s").alias("n"), F.size("out").alias("published"), "first.fecha", "first.datetime", "first.tiene_hora", F.when(F.size(F.filter("out", lambda t: t["d"] >= today())) > 0, dates.next_relevant(nothing, nothing, "out", today())["d"].cast("string")).alias("next_day"))


# Joins


@query(f"{VIEW} SELECT doc_id, row_number() OVER (ORDER BY prim, pid) AS place FROM v WHERE doc_id % 5 = 0")
def agenda_semi(spark, d):
    """Q8, S10."""
    saved = feed(spark, d).where("_ord % 5 = 0").select("id").unionByName(feed(spark, d).where("_ord % 10 = 0").select("id"))
    out = discover.agenda(view(spark, d), saved).withColumn("_at", F.monotonically_increasing_id())
    return out.select(F.col("_ord").alias("doc_id"), F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("place"))


@query(f"{VIEW} SELECT doc_id FROM v WHERE doc_id % 3 > 0")
def grid_anti(spark, d):
    """Q9, X4."""
    return discover.grid(view(spark, d), feed(spark, d).where("_ord % 3 = 0")).select(F.col("_ord").alias("doc_id"))


@query(f"{VIEW} SELECT doc_id, titulo FROM v WHERE doc_id = 77")
def lookup_by_id(spark, d):
    """Q10."""
    return discover.by_id(view(spark, d), f"plan:{fixtures.SOURCES[77 % len(fixtures.SOURCES)]}:77").select(F.col("_ord").alias("doc_id"), "titulo")


@query(f"SELECT max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) FILTER (WHERE event_type = 'view') AS disk, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) FILTER (WHERE event_type = 'click') AS committed, CASE WHEN max(ts) FILTER (WHERE event_type = 'click') > max(ts) FILTER (WHERE event_type = 'view') THEN 'committed' ELSE 'disk' END AS use FROM events")
def freshest_feed(spark, d):
    """Q11, G13."""
    e = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scraped_en"))
    latest = joins.fresher(e.where("event_type = 'view'"), e.where("event_type = 'click'"))
    return latest.select(F.substring("disk", 1, 19).alias("disk"), F.substring("committed", 1, 19).alias("committed"), "use")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 END * 4294967296 + event_id AS place FROM events WHERE event_type IN ('view', 'click')")
def union_sources(spark, d):
    """X1."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("event_id").alias("_ord"))
    return joins.union_all([e.where(f"event_type = '{t}'").drop("event_type") for t in ("view", "click")]).select("event_id", F.col("_ord").alias("place"))


@query("""WITH c AS (SELECT event_id, event_type AS fuente, 'https://b/' || user_id % 40 || '/' || event_id % 3 AS u FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY fuente, u) AS n FROM c)
SELECT event_id, CASE WHEN n = 1 THEN u END AS url_compra, CASE WHEN n > 1 THEN u END AS original, 1 + CASE WHEN n > 1 THEN 1 ELSE 0 END AS n_keys FROM n""")
def shared_url(spark, d):
    """G5, W2."""
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("fuente"), said("https://b/", num(F.col("user_id") % 40), "/", num(k % 3)).alias("url_compra"), F.create_map(F.lit("x"), F.lit("1")).alias("metadata"))
    return enrich.shared_purchase_urls(e).select("event_id", "url_compra", F.try_element_at("metadata", F.lit("url_compra_original")).alias("original"), F.size("metadata").alias("n_keys"))


@query("""WITH c AS (SELECT user_id, event_id AS o, CASE WHEN event_id % 3 = 0 THEN '2024-01-0' || event_id % 7 ELSE '' END AS day, repeat('x', CAST(event_id % 9 AS INTEGER)) AS title FROM events),
l AS (SELECT user_id, list({'o': o, 'd': day, 't': title} ORDER BY o) AS l FROM c GROUP BY user_id)
SELECT user_id, w.o AS chosen, w.d AS fecha_inicio, len(w.t) AS letters FROM (SELECT user_id, list_reduce(l, lambda h, x: CASE WHEN (h.d = '' AND x.d <> '') OR len(x.t) > len(h.t) THEN x ELSE h END) AS w FROM l)""")
def listing_wins(spark, d):
    """G11, W1."""
    k = F.col("event_id")
    cards = table(spark, d, "events").select("user_id", k.alias("_ord"), F.when(k % 3 == 0, said("2024-01-0", num(k % 7))).otherwise("").alias("fecha_inicio"), F.repeat(F.lit("x"), (k % 9).cast("int")).alias("titulo"))
    return joins.listing_wins(cards, "user_id").select("user_id", F.col("_ord").alias("chosen"), "fecha_inicio", F.length("titulo").cast("bigint").alias("letters"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'old' WHEN p_partkey % 4 = 1 THEN NULL WHEN length(p_brand) % 2 = 0 OR p_size % 5 = 0 THEN NULL ELSE 'https://i/' || p_brand || '?' || p_size % 5 END AS imagen FROM part""")
def image_fan_out(spark, d):
    """G14. A picture for each brand's address and size's reference; some aren't found."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.when(k % 4 == 0, "old").alias("imagen"), F.when(k % 4 != 1, F.col("p_brand")).alias("url"), num(F.col("p_size") % 5).alias("referencia_url"))
    return enrich.resolve_images(p, lambda url, ref: None if len(url) % 2 == 0 or ref == "0" else f"https://i/{url}?{ref}").select("p_partkey", "imagen")


@query(f"{RP} SELECT doc_id, row_number() OVER (ORDER BY CAST(publicado AS VARCHAR) DESC, id DESC) AS rank FROM rp")
def stamped_sort(spark, d):
    """S11. By date and id as text, both downwards."""
    n = raw_plans(spark, d).select("fecha_publicacion", "id", "_ord")
    return discover.with_rank(n, discover.stamped_order()).select(F.col("_ord").alias("doc_id"), "rank")


@query(f"{VIEW} SELECT 1 AS n, bool_or(prim < {T} + 8 OR ongoing) AS near FROM v")
def surprise(spark, d):
    """S9. The plan drawn is one of today, this week or under way, where there is any."""
    one = discover.surprise(view(spark, d), 7)
    return one.agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(F.col("is_today") | F.col("is_week") | F.col("ongoing")).alias("near"))


# Taxonomy

#: Titles that rules with a look-ahead take or leave, and the categories that they have.
CASES = [
    ("Recital", "Música y Conciertos"),
    ("Recital poesía", "Lectura y Literatura"),
    ("Yoga", "Deportes y Aventura"),
    ("Yoga y meditación", "Bienestar y Salud"),
    ("Parque", "Naturaleza y Aire Libre"),
    ("Parque infantil", "Familia e Infantil"),
    ("Ruta", "Visitas y Rutas"),
    ("Ruta verde", "Naturaleza y Aire Libre"),
    ("Ruta tapas", "Gastronomía"),
    ("Mercado", "Mercados y Ferias"),
    ("Mercado gastro", "Gastronomía"),
    ("Cuentos", "Lectura y Literatura"),
    ("Cuento cuento", "Lectura y Literatura"),
    ("Nada", dims.LEISURE),
    ("Evento de cine", "Cine"),
    ("Cine, teatro, danza, museo y vino", "Arte y Exposiciones|Teatro y Danza|Cine"),
]


@query(f"{O} SELECT k, [{', '.join(repr(c) for _, c in CASES)}][k % {len(CASES)} + 1] AS labels FROM o")
def classify_cases(spark, d):
    """Rules with look-aheads, the cap, leisure as the last resort."""
    title = F.get(F.array(*(F.lit(t) for t, _ in CASES)), (F.col("k") % len(CASES)).cast("int"))
    return enrich.classify(orders(spark, d).select("k", title.alias("titulo"))).select("k", F.array_join("categorias_normalizadas", "|").alias("labels"))


# Records, feeds and sinks


@query(
    rf"""{RP} SELECT doc_id, 'noticia:timeout:' || id AS id, CAST(publicado AS VARCHAR) || 'T00:00:00+01:00' AS sort_datetime, 'reciente' AS status, 'Actualidad ' || doc_id % 5 AS original, substr({CLEAN.format('descripcion')}, 1, 320) AS resumen
FROM rp WHERE CAST(publicado AS TIMESTAMP) >= {N} - INTERVAL 21 DAY"""
)
def normalized_news(spark, d):
    """R2."""
    raw = raw_plans(spark, d).withColumns({"fuente": F.lit("timeout"), "categoria": said("Actualidad ", num(F.col("_ord") % 5))})
    n = normalize.normalize_news(raw, now(), fixtures.SCRAPED)
    return n.select(F.col("_ord").alias("doc_id"), "id", "sort_datetime", F.col("estado_temporal").alias("status"), F.try_element_at("metadata", F.lit("categoria_original")).alias("original"), "resumen")


def news(spark, d):
    raw = raw_plans(spark, d).withColumns({"fuente": F.lit("timeout"), "categoria": F.lit("Actualidad")})
    return normalize.normalize_news(raw, now(), fixtures.SCRAPED, keep_only_recent=False)


#: Sentence case for a long title that is all capitals; a letter rises if a mark or nothing stands between it and the last letter.
SMART = r"""CASE WHEN length({0}) > 12 AND upper({0}) = {0} AND lower({0}) <> {0} THEN list_reduce(list_prepend('', string_split(lower({0}), '')),
  lambda done, ch: done || CASE WHEN regexp_matches(ch, '\p{{L}}') AND regexp_matches(done, '(^|[:.¡!¿?])[^\p{{L}}]*$') THEN upper(ch) ELSE ch END) ELSE {0} END"""


@query(f"{RP}, u AS (SELECT doc_id, upper(titulo) AS u FROM rp) SELECT doc_id, {SMART.format('u')} AS title FROM u")
def smart_title(spark, d):
    """T9. Titles shouted, then given sentence case again."""
    shouted = F.upper(F.replace("titulo", F.lit("ß"), F.lit("ẞ")))  # a capital of its own, not SS
    return raw_plans(spark, d).select(F.col("_ord").alias("doc_id"), text.smart_title(shouted).alias("title"))


BODY = rf"""a AS (SELECT *, {CLEAN.format('descripcion')} AS t FROM rp), b AS (SELECT *, CASE WHEN length(t) <= 900 THEN t ELSE regexp_replace(substr(t, 1, 899), ' [^ ]*$', '') || '…' END AS body, substr(t, 1, 320) AS r FROM a),
c AS (SELECT *, CASE WHEN length(r) <= 260 THEN r ELSE regexp_replace(substr(r, 1, 259), ' [^ ]*$', '') || '…' END AS short, CASE WHEN inicio >= {T} THEN inicio WHEN fin >= {T} THEN fin END AS nx FROM b WHERE fin >= {T})"""
LIKE = "CASE WHEN regexp_replace(lower({0}), '[.…]+$', '') = regexp_replace(lower(titulo), '\\.+$', '') AND titulo <> '' THEN NULL ELSE nullif({0}, '') END"


@query(
    f"""{RP}, {BODY} SELECT doc_id, 'plan:' || fuente || ':' || id AS id, nullif({SMART.format('titulo')}, '') AS titulo, {LIKE.format('short')} AS resumen, {LIKE.format('body')} AS descripcion, fuente, url, lugar, round(CASE WHEN lat BETWEEN 40.25 AND 40.60 AND lon BETWEEN -3.92 AND -3.48 THEN lat END, 5) AS latitud,
  round(CASE WHEN lat BETWEEN 40.25 AND 40.60 AND lon BETWEEN -3.92 AND -3.48 THEN lon END, 5) AS longitud, precio, precio = 0 AS es_gratis, CASE WHEN inicio = fin THEN 'puntual' ELSE 'rango' END AS modo_fecha, CASE WHEN inicio <= {T} THEN 'en_curso' ELSE 'proximo' END AS estado_temporal,
  CAST(inicio AS VARCHAR) AS fecha_inicio, CAST(fin AS VARCHAR) AS fecha_fin, CAST(nx AS VARCHAR) AS proxima_fecha, CAST(nx AS VARCHAR) || 'T00:00:00' || {SUMMER.format('nx')} AS proximo_datetime, CAST(nx AS VARCHAR) || 'T00:00:00' || {SUMMER.format('nx')} AS sort_datetime,
  CAST(fin AS VARCHAR) || 'T23:59:59' || {OFFSET.format('fin')} AS vigente_hasta, CAST(0 AS INTEGER) AS n_filled_never FROM c"""
)
def slim_feed(spark, d):
    """20 of the feed's fields; of the others those that these records can't have are counted."""
    events, _ = publish.build_feeds(kept(plans(spark, d)).withColumns({"categorias_normalizadas": F.array(F.lit("Cine")), "categoria_principal_norm": F.lit("Cine")}), news(spark, d).withColumn("categoria_principal_norm", F.lit("x")), today(), now())
    never = ["subtitulo", "imagen", "fuentes_relacionadas", "url_compra", "direccion", "moneda", "datetime_inicio", "sesiones", "valoracion"]
    filled = sum((F.col(c).isNotNull().cast("int") for c in never), F.lit(0))
    shown = "id titulo resumen descripcion fuente url lugar latitud longitud precio es_gratis modo_fecha estado_temporal fecha_inicio fecha_fin proxima_fecha proximo_datetime sort_datetime vigente_hasta".split()
    return events.select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("doc_id"), *shown, filled.alias("n_filled_never"))


@query(
    f"""{RP}, k AS (SELECT *, CASE WHEN inicio >= {T} THEN inicio ELSE fin END AS dy FROM rp WHERE fin >= {T})
SELECT doc_id, row_number() OVER (ORDER BY CAST(dy AS VARCHAR) || 'T00:00:00' || {OFFSET.format('dy')}, lower(titulo), doc_id) AS place, (row_number() OVER (ORDER BY CAST(dy AS VARCHAR) || 'T00:00:00' || {OFFSET.format('dy')}, lower(titulo), doc_id)) = 1 AS opens, true AS compact FROM k"""
)
def feed_array(spark, d):
    """The feed as one JSON array, record by record, in its order."""
    events, _ = publish.build_feeds(kept(plans(spark, d)).withColumns({"categorias_normalizadas": F.array(F.lit("Cine")), "categoria_principal_norm": F.lit("Cine")}), news(spark, d).withColumn("categoria_principal_norm", F.lit("x")), today(), now())
    array = publish.as_array(events.select("id", "titulo", "precio")).withColumn("_at", F.monotonically_increasing_id()).where("value <> ']'")
    body = F.substring("value", F.lit(2), F.length("value"))
    id_ = F.get_json_object(body, "$.id")
    return array.select(F.regexp_extract(id_, r"(\d+)$", 1).cast("bigint").alias("doc_id"), F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("place"), (F.substring("value", 1, 1) == "[").alias("opens"), F.startswith(body, F.concat(F.lit('{"id":"'), id_, F.lit('","'))).alias("compact"))


@query(rf"""{RP}, t AS (SELECT *, {CLEAN.format('descripcion')} AS t FROM rp), s AS (SELECT *, substr(t, 1, 320) AS r FROM t WHERE CAST(publicado AS TIMESTAMP) >= {N} - INTERVAL 21 DAY)
SELECT doc_id, 'noticia:timeout:' || id AS id, nullif({SMART.format('titulo')}, '') AS titulo, nullif(CASE WHEN length(r) <= 280 THEN r ELSE regexp_replace(substr(r, 1, 279), ' [^ ]*$', '') || '…' END, '') AS resumen, url, row_number() OVER (ORDER BY publicado DESC, lower(titulo) DESC, doc_id) AS place FROM s""")
def slim_news(spark, d):
    """R8, R9, S2."""
    _, slim = publish.build_feeds(plans(spark, d).limit(0).withColumns({"categorias_normalizadas": F.array(F.lit("x")), "categoria_principal_norm": F.lit("x")}), news(spark, d).withColumn("categoria_principal_norm", F.lit("x")), today(), now())
    slim = slim.withColumn("_at", F.monotonically_increasing_id())
    return slim.select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "id", "titulo", "resumen", "url", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("place"))


@query(rf"{RP} SELECT doc_id, CAST(publicado AS TIMESTAMP) AS published, 'Actualidad' AS category, 'Time Out Madrid' AS source, coalesce(nullif(titulo, ''), 'Noticia sin título') AS titulo FROM rp WHERE titulo <> ''")
def news_view(spark, d):
    """R13."""
    n = discover.view_news(news(spark, d).withColumn("categoria_principal_norm", F.lit(" ")))
    return n.select(F.col("_ord").alias("doc_id"), "published", F.col("primary_category").alias("category"), F.col("source_label").alias("source"), "titulo")


@query(f"{RP} SELECT fuente AS source, count(*) AS archived, count(*) AS read, count(*) FILTER (WHERE precio = 0) AS free FROM rp GROUP BY 1")
def sinks(spark, d):
    """Written by source, and as JSON lines, and read again."""
    path = f"{folder(spark)}/sinks-{uuid.uuid4().hex}"
    p = plans(spark, d).select("id", "fuente", "precio", "es_gratis")
    publish.write_by_source(p, f"{path}/archive")
    publish.write_feed(p, f"{path}/feed")
    archived = spark.read.parquet(f"{path}/archive").groupBy(F.col("fuente").alias("source")).agg(F.count(F.lit(1)).alias("archived"))
    back = read_feed(spark, f"{path}/feed", "id string, fuente string, precio double, es_gratis boolean").groupBy(F.col("fuente").alias("source")).agg(F.count(F.lit(1)).alias("read"), F.count_if("es_gratis").alias("free"))
    return archived.join(back, "source").select("source", "archived", "read", "free")


@query("SELECT lower(s_name) AS cache_key, 40.0 + s_suppkey / 1000.0 AS lat FROM supplier")
def cache_round_trip(spark, d):
    """C24. A cache of coordinates, written and read."""
    path = f"{folder(spark)}/cache-{uuid.uuid4().hex}"
    publish.write_feed(table(spark, d, "supplier").select(F.lower("s_name").alias("cache_key"), (F.lit(40.0) + F.col("s_suppkey") / 1000.0).alias("lat"), F.lit(-3.7).alias("lon"), F.col("s_name").alias("query")), path)
    return read_cache(spark, path).select("cache_key", "lat")


@query(
    f"""{RP}, k AS (SELECT lower(lugar || ', madrid, españa') AS cache_key, min(doc_id) AS first FROM rp WHERE lugar IS NOT NULL GROUP BY 1 ORDER BY first LIMIT 80)
SELECT cache_key, CASE WHEN ascii(cache_key[10:10]) % 3 > 0 THEN round(40.3 + length(cache_key) / 1000.0, 6) END AS lat, first FROM k"""
)
def geocode_nights(spark, d):
    """R5, W5, C24. Two nights of 40 look-ups each, the second of which asks for what the first left, and their cache."""
    from plazaflow.operators import geocoding

    path = f"{folder(spark)}/geocode-{uuid.uuid4().hex}"
    bare = kept(plans(spark, d).withColumns({"latitud": F.lit(None).cast("double"), "longitud": F.lit(None).cast("double")}).select("_ord", "direccion", "lugar", "latitud", "longitud"))
    for _ in range(2):
        geocoding.look_up(bare, path, lambda key: (40.3 + len(key) / 1000.0, -3.7) if ord(key[9]) % 3 else None, most=40, pause=0)
    first = enrich.with_query(bare).groupBy("cache_key").agg(F.min("_ord").alias("first"))
    return geocoding.read(spark, path).join(first, "cache_key").select("cache_key", "lat", "first")


def indexed(spark, d):
    return index.build(view(spark, d), f"{folder(spark)}/index-{uuid.uuid4().hex}")


#: The folded text that a search looks into, and a plan's price as the view has it.
SOUGHT = f"lower(titulo || ' ' || {CLEAN.format('descripcion')} || ' ' || coalesce(lugar, ''))"


@query(f"{VIEW} SELECT pid AS id FROM v WHERE contains({SOUGHT}, 'supplier#0') AND contains({SOUGHT}, 'the') AND fuente = 'fever'")
def indexed_search(spark, d):
    """Words and a source through the index of the feed."""
    return index.matching(indexed(spark, d), discover.State(query="Supplier#0 thé", source="fever")).select("id")


@query(ORACLE_SQL["facets"])
def indexed_facets(spark, d):
    """G3, from the bits of the index."""
    return index.facets(indexed(spark, d)).select("facet", "value", "n", "first")


NEWS = ", ".join(f"'{s}'" for s in dims.NEWS_SOURCES)
OLD = f"(SELECT source, kind, n FROM (VALUES ('meetup', 'plan', 7), ('gacetin_madrid', 'news', 3)) AS t(source, kind, n))"


@query(
    f"""{RP}, f AS (SELECT fuente AS source, CASE WHEN fuente IN ({NEWS}) THEN 'news' ELSE 'plan' END AS kind, count(*) AS n FROM rp WHERE fuente <> 'meetup' AND CASE WHEN fuente IN ({NEWS}) THEN CAST(publicado AS TIMESTAMP) >= {N} - INTERVAL 21 DAY ELSE fin >= {T} END GROUP BY 1, 2)
SELECT source AS name, kind, 'ok' AS status, n AS count, false AS stale, CAST(NULL AS VARCHAR) AS stale_since, (SELECT count(*) FROM f) AS sources_ok FROM f
UNION ALL SELECT source, kind, 'failed', n, true, '2024-01-14T04:15:00Z', (SELECT count(*) FROM f) FROM {OLD}"""
)
def nightly_run(spark, d):
    """Every source of a run, two of which bring nothing and keep what they had."""
    raw = kept(raw_plans(spark, d))
    by = {s: raw.where(F.col("fuente") == s) for s in [*dims.PLAN_SOURCES, *dims.NEWS_SOURCES] if s != "meetup"}
    stamp = F.lit("2024-01-14T04:15:00Z")
    old = plans(spark, d).where("fuente = 'meetup'").orderBy("_ord").limit(7).withColumn("scraped_en", stamp)
    old = old if old.count() == 7 else plans(spark, d).limit(7).withColumns({"fuente": F.lit("meetup"), "scraped_en": stamp})
    old_news = news(spark, d).limit(3).withColumns({"fuente": F.lit("gacetin_madrid"), "scraped_en": stamp})
    out = pipeline.run_all(by, old, old_news, fixtures.TODAY_TEXT, now(), fixtures.SCRAPED, {"type": "scheduled"}, fixtures.SCRAPED)
    rows = out["manifest"].select("sources_ok", F.explode("sources").alias("s"))
    return rows.select("s.name", "s.kind", "s.status", "s.count", "s.stale", "s.stale_since", "sources_ok")
