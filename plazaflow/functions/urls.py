"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazaflow.functions.arrays import distinct_text
from plazaflow.functions.text import clean_text, sanitize_text, slugify
from plazaflow.plans import dims


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


SCHEME, HOST, PATH = r"^([A-Za-z][A-Za-z0-9+.-]*):", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), SCHEME, 1))


def host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), HOST, 1))


def path(c: Column | str) -> Column:
    return F.regexp_extract(col(c), PATH, 1)


def last_segment(c: Column | str) -> Column:
    """The path's last part; null without one."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(path(c), "/+$", ""), "/"), -1), F.lit(""))


def source_id(raw_id: Column | str, urls: list[Column | str], title: Column | str) -> Column:
    """U1. The id, else the last part of the first address with a path, else the title's slug."""
    return F.coalesce(sanitize_text(raw_id), *(last_segment(u) for u in urls), slugify(clean_text(title)))


def plan_source_id(raw_id: Column | str, urls: list[Column | str], title: Column | str, dates: list[Column | str]) -> Column:
    """U2. The id without a prefix of our own; for a generic id (or none): id, last parts of addresses, title slug and days, each once."""
    text = clean_text(raw_id)
    bare = F.when(text.rlike("^(plan|noticia):"), F.regexp_replace(text, "^[^:]*:(?:[^:]*:)?", "")).otherwise(text)
    days = [F.nullif(F.regexp_extract(clean_text(d), "^([^T ]*)", 1), F.lit("")) for d in dates]
    parts = distinct_text(F.array_compact(F.array(*(last_segment(u) for u in urls), slugify(clean_text(title)), *days)))
    known = F.array_contains(F.transform(parts, F.lower), F.lower(bare))
    every = F.when((bare != "") & ~known, F.concat(F.array(bare), parts)).otherwise(parts)
    return F.when((bare != "") & ~F.lower(bare).isin(*dims.GENERIC_IDS), bare).otherwise(F.array_join(every, "::"))


def compound_id(kind: str, source: Column | str, source_id: Column | str) -> Column:
    """U3. kind:source:id."""
    return F.concat_ws(":", F.lit(kind), col(source), col(source_id))


def web_url(c: Column | str) -> Column:
    """U4. The trimmed address if it is http or https."""
    text = F.trim(col(c))
    return F.when(F.lower(text).rlike("^https?://"), text)


def normalize_url(c: Column | str, base: str = "") -> Column:
    """U5. Absolute, without query and fragment, with one slash at its end."""
    full = F.when(col(c).rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), col(c)).otherwise(F.concat(F.lit(base.rstrip("/")), F.lit("/"), F.regexp_replace(col(c), "^/+", "")))
    return F.concat(F.regexp_replace(F.regexp_replace(full, r"[?#].*$", ""), "/+$", ""), F.lit("/"))


def join_url(c: Column | str, base: Column | str) -> Column:
    """U6. An address as seen from a page: absolute, scheme-relative, host-relative or beside the page."""
    text, page = F.trim(col(c)), col(base)
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), "[^/]*$", "")
    return F.nullif(
        F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text)
        .when(text.startswith("//"), F.concat(scheme(page), F.lit(":"), text))
        .when(text.startswith("/"), F.concat(root, text))
        .when(text.rlike("^[?#]"), F.concat(F.regexp_replace(page, r"[?#].*$", ""), text))
        .otherwise(F.concat(F.when(folder.rlike("://$"), F.concat(root, F.lit("/"))).otherwise(folder), text)),
        F.lit(""),
    )


def specific_purchase(url: Column | str, page: Column | str, generic: list[str] = ()) -> Column:
    """U7. Whether the purchase path holds a telling word of the page's slug: four letters or more, no number, not generic."""
    words = F.filter(F.split(F.lower(last_segment(page)), "[^a-z0-9]+"), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$") & (~t.isin(*generic) if generic else F.lit(True)))
    return F.coalesce(F.exists(words, lambda t: F.contains(F.lower(path(url)), t)), F.lit(False))


def directions_url(lat: Column, lon: Column, label: Column) -> Column:
    """U8. Map directions to a point, else to a named place; null without either."""
    base = F.lit("https://www.google.com/maps/dir/?api=1&destination=")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(base, lat.cast("string"), F.lit(","), lon.cast("string"))).when(F.coalesce(label, F.lit("")) != "", F.concat(base, F.url_encode(label)))
