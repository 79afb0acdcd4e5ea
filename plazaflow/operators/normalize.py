"""From raw records to canonical ones (R1, R2): projections only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaflow.functions import arrays, dates, numbers, text, urls
from plazaflow.operators.predicates import is_current_plan, is_recent_news
from plazaflow.plans import schema


def with_raw_columns(df: DataFrame) -> DataFrame:
    """df with every column of the raw contract, those that it lacks null; other columns are dropped."""
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in schema.fields(schema.RAW).items()))


def _with_long_texts(df: DataFrame) -> DataFrame:
    """df with its long texts cleaned: _about, _body, of which several columns are made, each cleaned once."""
    return df.withColumns({"_about": text.sanitize_text("descripcion"), "_body": text.sanitize_text("contenido")})


def _texts(source_id: Column) -> dict[str, Column]:
    cats = arrays.categories("categoria", "categorias")
    resumen = F.substring(F.coalesce(text.sanitize_text("subtitulo"), "_about", "_body", text.sanitize_text("titulo"), F.lit("")), 1, 320)
    descripcion = F.coalesce("_about", resumen)
    same = {n: text.sanitize_text(n) for n in ("subtitulo", "autor", "url", "imagen")}
    return {
        "slug": text.slugify(F.coalesce(text.sanitize_text("titulo"), source_id)),
        "titulo": text.clean_text("titulo"),
        **same,
        "resumen": resumen,
        "descripcion": descripcion,
        "contenido": F.coalesce("_body", descripcion),
        "categorias": cats,
        "etiquetas": arrays.tags("etiquetas"),
        "publicado_en": dates.normalized("fecha_publicacion"),
        "actualizado_en": dates.normalized("fecha_actualizacion"),
    }


def _metadata(original: Column | None = None) -> Column:
    return arrays.source_metadata("metadata", {k: F.col(k) for k in arrays.METADATA_KEYS}, original)


def normalize_plans(raw: DataFrame, today: Column, scraped_at: str, keep_only_current: bool = True) -> DataFrame:
    """R1. Canonical plans of raw records: texts cleaned, dates, sessions and status worked out as of `today`."""
    df = _with_long_texts(with_raw_columns(raw)).withColumn("fuente_id", urls.plan_source_id("id", [F.col(u) for u in ("url_compra", "url", "url_articulo")], "titulo", [F.col(d) for d in ("fecha_inicio", "fecha_fin", "fecha_publicacion")]))
    df = df.withColumns({"_sessions": dates.sessions("fechas_disponibles", "fecha_inicio", "fecha_fin"), "_from": dates.parse_temporal("fecha_inicio"), "_to": dates.parse_temporal("fecha_fin")})
    start, end = dates.ordered_ends(F.col("_from"), F.col("_to"), "_sessions")
    df = df.withColumns({"_start": start, "_end": end})
    df = df.withColumns({"_next": dates.next_relevant(F.col("_start"), F.col("_end"), "_sessions", today), "_output": dates.output_sessions("_sessions", today)})
    s, e, n = F.col("_start"), F.col("_end"), F.col("_next")
    own = _texts(F.col("fuente_id"))
    meta = _metadata()
    trimmed = F.map_concat(F.map_filter(meta, lambda k, v: ~k.isin("sesiones_total_fuente", "sesiones_publicadas")), F.create_map(F.lit("sesiones_total_fuente"), F.size("_sessions").cast("string"), F.lit("sesiones_publicadas"), F.size("_output").cast("string")))
    df = df.withColumns(own | {"_meta": F.when(F.size("_output") != F.size("_sessions"), trimmed).otherwise(meta), "precio": numbers.as_float("precio"), "sesiones": F.transform("_output", dates.session)})
    timed = lambda t: F.coalesce(t["has_time"], F.lit(False))
    day = lambda t: t["d"].cast("string")
    columns = {
        "id": urls.compound_id("plan", "fuente", "fuente_id"),
        "tipo": F.lit("plan"),
        "categoria_principal": F.get("categorias", F.lit(0)),
        **{c: text.sanitize_text(c) for c in ("url_articulo", "url_compra", "lugar", "direccion", "moneda")},
        "latitud": numbers.as_float("latitud"),
        "longitud": numbers.as_float("longitud"),
        "es_gratis": numbers.is_free("precio"),
        "modo_fecha": dates.plan_mode(s, e, "_sessions"),
        "estado_temporal": dates.temporal_status(s, e, today),
        "fecha_inicio": day(s),
        "fecha_fin": day(e),
        "datetime_inicio": F.when(timed(s), s["iso"]),
        "datetime_fin": F.when(timed(e), e["iso"]),
        "tiene_hora_inicio": timed(s),
        "tiene_hora_fin": timed(e),
        "fechas_disponibles": F.transform("sesiones", lambda x: F.coalesce(x["datetime"], x["fecha"])),
        "proxima_fecha": day(n),
        "proximo_datetime": n["iso"],
        "sort_datetime": F.coalesce(n["iso"], "actualizado_en", "publicado_en"),
        "vigente_hasta": dates.effective_end(F.coalesce(e, s)),
        "scraped_en": F.lit(scraped_at),
        "timezone": F.lit("Europe/Madrid"),
        "valido_para_web": F.lit(True),
        "metadata": F.col("_meta"),
    }
    df = df.withColumns(columns)
    df = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.fields(schema.PLAN).items()))
    return df.where(is_current_plan(today)) if keep_only_current else df


def normalize_news(raw: DataFrame, now: Column, scraped_at: str, keep_only_recent: bool = True) -> DataFrame:
    """R2. Canonical news items of raw records."""
    df = _with_long_texts(with_raw_columns(raw)).withColumn("fuente_id", urls.source_id("id", [F.col(u) for u in ("url", "url_articulo", "url_compra")], "titulo"))
    df = df.withColumns(_texts(F.col("fuente_id")) | {"metadata": _metadata(F.col("categoria"))})
    df = df.withColumns(
        {
            "id": urls.compound_id("noticia", "fuente", "fuente_id"),
            "tipo": F.lit("noticia"),
            "categoria_principal": F.get("categorias", F.lit(0)),
            "modo_fecha": F.lit("publicacion"),
            "estado_temporal": F.when(F.coalesce("publicado_en", "actualizado_en").isNotNull(), "reciente").otherwise("sin_fecha"),
            "sort_datetime": F.coalesce("publicado_en", "actualizado_en", F.lit(scraped_at)),
            "scraped_en": F.lit(scraped_at),
            "timezone": F.lit("Europe/Madrid"),
            "valido_para_web": F.lit(True),
        }
    )
    df = df.select(*(F.col(c).cast(t).alias(c) for c, t in schema.fields(schema.NEWS).items()))
    return df.where(is_recent_news(now)) if keep_only_recent else df
