"""Array and struct functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazaflow.plans import dims
from plazaflow.plans.compat import KEPT, Compat


def _text():
    from plazaflow.functions import text

    return text


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


NO_TEXT = "array<string>"


def empty() -> Column:
    return F.array().cast(NO_TEXT)


def filled(c: Column | str) -> Column:
    """The array, or an empty one for null."""
    return F.coalesce(col(c), empty())


def let(value: Column, body) -> Column:
    return _text().let(value, body)


def first_of_each(values: Column, keys: Column) -> Column:
    """Values whose key no earlier one has, in their order: by sorting, as looking each up takes a list's square."""
    placed = F.array_sort(F.transform(values, lambda x, i: F.struct(F.get(keys, i).alias("k"), i.alias("i"), x.alias("x"))))
    new = lambda e: F.filter(e, lambda v, j: (j == 0) | (v["k"] != F.get(e, j - 1)["k"]))
    return F.transform(F.array_sort(F.transform(let(placed, new), lambda v: F.struct(v["i"].alias("i"), v["x"].alias("x")))), lambda v: v["x"])


def distinct_text(c: Column | str) -> Column:
    """A1. Clean values that aren't empty; of values equal but for case the first, in its spelling. Each value is cleaned once."""
    values = F.filter(F.transform(filled(c), lambda x: _text().clean_text(x)), lambda x: x != "")
    once = lambda v, low: F.when(F.size(F.array_distinct(low)) == F.size(low), v).otherwise(first_of_each(v, low))
    return let(values, lambda v: let(F.transform(v, F.lower), lambda low: once(v, low)))


def categories(main: Column | str, others: Column | str) -> Column:
    """A2. The category, then the categories, each once."""
    return distinct_text(F.concat(F.array(col(main)), filled(others)))


def tags(c: Column | str) -> Column:
    """A3. Tags, each once."""
    return distinct_text(c)


def union_text(a: Column | str, b: Column | str) -> Column:
    """A4. Values of both arrays, each once, the first array's first."""
    return distinct_text(F.concat(filled(a), filled(b)))


def union_sessions(a: Column | str, b: Column | str) -> Column:
    """A5. Sessions of both arrays by their time (or day): of two with one time the later counts; sorted by it."""
    key = lambda s: F.coalesce(s["datetime"], s["fecha"])
    both = F.filter(F.concat(col(a), col(b)), lambda s: key(s).isNotNull())
    placed = F.array_sort(F.transform(both, lambda s, i: F.struct(key(s).alias("k"), i.alias("i"), s.alias("s"))))
    last = lambda e: F.filter(e, lambda x, j: (j == F.size(e) - 1) | (x["k"] != F.get(e, j + 1)["k"]))
    return F.transform(let(placed, last), lambda x: x["s"])


def related_ids(ids: Column | str, source: Column | str, source_id: Column | str) -> Column:
    """A6. The ids that there are, or the record's own."""
    own = F.when((F.coalesce(col(source), F.lit("")) != "") & (F.coalesce(col(source_id), F.lit("")) != ""), F.array(F.concat_ws(":", col(source), col(source_id)))).otherwise(empty())
    return F.when(F.size(filled(ids)) > 0, distinct_text(ids)).otherwise(own)


#: Keys of a raw record that its metadata takes over.
METADATA_KEYS = ["tipo_origen", "url_fuente_editorial", "valoracion", "num_valoraciones", "secciones"]


def source_metadata(metadata: Column | str, values: dict[str, Column], original: Column | None = None) -> Column:
    """A7. A map<string, string>: the metadata and, where it lacks them, the values of METADATA_KEYS; a news item's original category."""
    own = F.coalesce(col(metadata), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, v: v.isNotNull() & (v != "") & (v != "[]"))
    given = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.nullif(v.cast("string"), F.lit("")) for v in values.values()))), lambda k, v: v.isNotNull() & ~F.map_contains_key(kept, k))
    out = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k)), given)
    if original is None:
        return out
    rest = F.map_filter(out, lambda k, v: k != "categoria_original")
    return F.when(F.coalesce(original, F.lit("")) != "", F.map_concat(rest, F.create_map(F.lit("categoria_original"), original))).otherwise(out)


def merge_metadata(a: Column | str, b: Column | str) -> Column:
    """A8. Values of the first map unless they are empty; then of the second."""
    nothing = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(col(a), nothing), F.coalesce(col(b), nothing), lambda k, x, y: F.coalesce(F.nullif(x, F.lit("")), y))


LINK = "struct<fuente:string,url:string,kind:string,precio:double,moneda:string,es_gratis:boolean>"


def source_link(r: dict[str, Column]) -> Column:
    """A9. The record's own link: purchase address, else page, else article, else editorial page; null without any."""
    text = _text()
    bought, page = text.sanitize_text(r["url_compra"]), text.sanitize_text(r["url"])
    url = F.coalesce(bought, page, text.sanitize_text(r["url_articulo"]), text.sanitize_text(r["url_fuente_editorial"]))
    kind = F.when(bought.isNotNull(), "compra").when(page.isNotNull(), "detalle").otherwise("editorial")
    free = F.coalesce(r["precio"] == 0, r["es_gratis"])
    link = F.struct(text.clean_text(r["fuente"]).alias("fuente"), url.alias("url"), kind.alias("kind"), r["precio"].cast("double").alias("precio"), text.sanitize_text(r["moneda"]).alias("moneda"), free.alias("es_gratis"))
    return F.when((text.clean_text(r["fuente"]) != "") & url.isNotNull(), link).cast(LINK)


def merge_links(c: Column | str) -> Column:
    """A10. Links by source and address (case and a slash at the end don't count), in order of their first one; later ones
    raise its kind to a purchase and fill in price, currency and whether it is free."""
    links = F.filter(col(c), lambda x: x.isNotNull() & (F.coalesce(x["fuente"], F.lit("")) != "") & (F.coalesce(x["url"], F.lit("")) != ""))
    key = lambda x: F.concat(F.lower(x["fuente"]), F.lit("::"), F.lower(F.regexp_replace(x["url"], "/+$", "")))

    def merged(keyed: Column, x: Column) -> Column:
        def one(same: Column) -> Column:
            value = lambda name: F.get(F.filter(F.transform(same, lambda y: y["x"][name]), lambda v: v.isNotNull()), F.lit(0)).alias(name)
            kind = F.when(F.exists(same, lambda y: y["x"]["kind"] == "compra"), F.lit("compra")).otherwise(F.coalesce(F.nullif(x["x"]["kind"], F.lit("")), F.lit("detalle")))
            return F.struct(x["x"]["fuente"].alias("fuente"), x["x"]["url"].alias("url"), kind.alias("kind"), value("precio"), value("moneda"), value("es_gratis"))

        return let(F.filter(keyed, lambda y: y["k"] == x["k"]), one)

    def all_(keyed: Column) -> Column:
        return F.transform(first_of_each(keyed, F.transform(keyed, lambda y: y["k"])), lambda x: merged(keyed, x))

    return let(F.transform(links, lambda x: F.struct(key(x).alias("k"), x.alias("x"))), all_).cast(f"array<{LINK}>")


def slim_sessions(mode: Column | str, sessions: Column | str, today: Column) -> Column:
    """A11. Of a plan with several dates the sessions from today on, or the last; at most eight."""
    ahead = lambda s: F.filter(s, lambda x: F.coalesce(x["fecha"], F.lit("")) >= today.cast("string"))
    some = lambda s, a: F.when(F.size(a) > 0, a).when(F.size(s) > 0, F.slice(s, F.size(s), F.lit(1))).otherwise(s)
    slim = let(col(sessions), lambda s: let(ahead(s), lambda a: F.slice(some(s, a), 1, dims.WEB_SESSIONS)))
    return F.when(col(mode) == "multiple", slim)


def slim_links(links: Column | str, compat: Compat = KEPT) -> Column:
    """A12. Of the first six links those to web pages."""
    web = lambda c: F.filter(c, lambda x: F.lower(F.trim(x["url"])).rlike("^https?://"))
    first = lambda c: F.slice(c, 1, dims.WEB_LINKS)
    return F.transform(
        web(first(col(links))) if compat.links_cut_first else first(web(col(links))),
        lambda x: F.struct(x["fuente"].alias("fuente"), x["url"].alias("url"), F.coalesce(F.nullif(x["kind"], F.lit("")), F.lit("detalle")).alias("kind"), x["precio"].alias("precio"), x["es_gratis"].alias("es_gratis")),
    )


def nothing_if_empty(c: Column | str, kind: str) -> Column:
    """A13. Null for an empty array or text, so that to_json leaves the key out."""
    return F.when(F.size(col(c)) > 0, col(c)) if kind.startswith("array") else F.nullif(col(c), F.lit("")) if kind == "string" else col(c)


def view_links(links: Column | str, source: Column | str, url: Column | str, bought: Column | str) -> Column:
    """A14. Web links, before them the plan's own page and purchase address if they lack them (the purchase address first)."""
    web = lambda u: F.coalesce(F.lower(u).rlike("^https?://"), F.lit(False))
    none = F.array().cast(f"array<{LINK}>")
    known = F.coalesce(F.filter(col(links).cast(f"array<{LINK}>"), lambda x: web(x["url"])), none)

    def before(known: Column, u: Column, kind: str) -> Column:
        own = F.array(F.struct(col(source).alias("fuente"), u.alias("url"), F.lit(kind).alias("kind"), F.lit(None).alias("precio"), F.lit(None).alias("moneda"), F.lit(None).alias("es_gratis"))).cast(f"array<{LINK}>")
        return F.when(web(u) & ~F.exists(known, lambda x: x["url"] == u), F.concat(own, known)).otherwise(known)

    return let(let(known, lambda k: before(k, col(url), "detalle")), lambda k: before(k, col(bought), "compra"))


def lookup(c: Column | str, table: dict[str, list[str]], default: Column) -> Column:
    """A15. The labels of a value (case doesn't count), else the default."""
    known = F.create_map(*(x for k, v in table.items() for x in (F.lit(k.lower()), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(known, F.lower(_text().clean_text(c))), default)


def keyword_labels(blob: Column, table: list[tuple[str, list[str]]], first: list[str] = ()) -> Column:
    """A16. The given labels, then every label one of whose words the text holds."""
    hit = lambda words: reduce(lambda a, b: a | b, [F.contains(blob, F.lit(w)) for w in words])
    found = [F.when(hit(words), F.lit(label)) for label, words in table]
    return F.filter(F.array(*map(F.lit, first), *found), lambda x: x.isNotNull())


def categories_but(c: Column | str, ignored: list[str], default: list[str]) -> Column:
    """A17. Labels without the ignored ones; all of them if none is left; the default if there was none."""
    but = lambda every: F.filter(every, lambda x: ~F.lower(x).isin(*[i.lower() for i in ignored])) if ignored else every
    some = lambda every, kept: F.when(F.size(kept) > 0, kept).when(F.size(every) > 0, every).otherwise(F.array(*map(F.lit, default)))
    return let(distinct_text(c), lambda every: let(but(every), lambda kept: some(every, kept)))


def fill_card(first: list[Column | str]) -> Column:
    """A18. The first of a field's values, in order of discovery, that isn't empty."""
    return _text().first_filled(*first)


def session_values(c: Column | str) -> Column:
    """A19. Distinct times; days instead if a day has several or there are more than ten."""
    days = lambda times: distinct_text(F.transform(times, lambda x: F.substring_index(x, "T", 1)))
    some = lambda times, days: F.when((F.size(times) > F.size(days)) | (F.size(times) > 10), days).otherwise(times)
    return let(distinct_text(c), lambda times: let(days(times), lambda d: some(times, d)))
