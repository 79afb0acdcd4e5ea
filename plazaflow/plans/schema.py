"""Schemas of raw records, canonical records and feeds (DDL)."""

LINKS = "array<struct<fuente:string,url:string,kind:string,precio:double,moneda:string,es_gratis:boolean>>"
SESSIONS = "array<struct<fecha:string,datetime:string,tiene_hora:boolean>>"

#: What every adapter emits; _ord is the place in (job, file) order.
RAW = """id string, titulo string, subtitulo string, descripcion string, contenido string, precio string, moneda string,
lugar string, direccion string, latitud string, longitud string, fecha_inicio string, fecha_fin string,
fechas_disponibles array<string>, categorias array<string>, categoria string, etiquetas array<string>, autor string,
url string, url_articulo string, url_compra string, imagen string, fecha_publicacion string, fecha_actualizacion string,
tipo_origen string, url_fuente_editorial string, valoracion string, num_valoraciones string, secciones array<string>,
metadata map<string,string>, fuente string, _ord bigint"""

#: A canonical plan; days are ISO texts, as in the feeds, so that comparisons are those of texts.
PLAN = f"""id string, fuente string, fuente_id string, tipo string, slug string, titulo string, subtitulo string, resumen string,
descripcion string, contenido string, categorias array<string>, categoria_principal string, etiquetas array<string>,
autor string, url string, url_articulo string, url_compra string, imagen string, lugar string, direccion string,
latitud double, longitud double, precio double, moneda string, es_gratis boolean, modo_fecha string, estado_temporal string,
fecha_inicio string, fecha_fin string, datetime_inicio string, datetime_fin string, tiene_hora_inicio boolean, tiene_hora_fin boolean,
fechas_disponibles array<string>, sesiones {SESSIONS}, proxima_fecha string, proximo_datetime string, sort_datetime string,
vigente_hasta string, publicado_en string, actualizado_en string, scraped_en string, timezone string, valido_para_web boolean,
metadata map<string,string>, source_links {LINKS}, ids_relacionados array<string>, fuentes_relacionadas array<string>, _ord bigint"""

NEWS = f"""id string, fuente string, fuente_id string, tipo string, slug string, titulo string, subtitulo string, resumen string,
descripcion string, contenido string, categorias array<string>, categoria_principal string, etiquetas array<string>,
autor string, url string, imagen string, publicado_en string, actualizado_en string, modo_fecha string, estado_temporal string,
sort_datetime string, scraped_en string, timezone string, valido_para_web boolean, metadata map<string,string>, _ord bigint"""

#: A run's report on one source.
RESULT = "name string, kind string, status string, count bigint, duration_seconds double, error string, stale boolean, stale_since string"
GEOCODE = "cache_key string, lat double, lon double, query string"


def fields(ddl: str) -> dict[str, str]:
    """{name: type} of a DDL text."""
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return dict(p.split(None, 1) for p in [*out, part])
