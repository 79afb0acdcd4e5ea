"""Filters (P1-P15). Each is a boolean column that is never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazaflow.functions import dates, numbers, text
from plazaflow.plans import dims
from plazaflow.plans.compat import KEPT, Compat


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_current_plan(today: Column, first: Column | str = "fecha_inicio", last: Column | str = "fecha_fin", updated: Column | str = "actualizado_en", published: Column | str = "publicado_en") -> Column:
    """P1. Ends today or later and starts within a year; undated, changed within 45 days."""
    given = lambda c: F.nullif(col(c).cast("string"), F.lit(""))
    a, b = F.coalesce(given(first), given(last)), F.coalesce(given(last), given(first))
    changed = dates.parse_temporal(F.coalesce(given(updated), given(published)))["d"]
    dated = (b.try_cast("date") >= today) & (a.try_cast("date") <= F.date_add(today, dims.PLAN_LOOKAHEAD_DAYS))
    return sure(F.when(a.isNotNull(), dated).otherwise(changed >= F.date_sub(today, dims.PLAN_UNDATED_LOOKBACK_DAYS)))


def is_recent_news(now: Column, published: Column | str = "publicado_en", updated: Column | str = "actualizado_en") -> Column:
    """P2. Published (or changed) within 21 days."""
    at = dates.parse_temporal(F.coalesce(F.nullif(col(published), F.lit("")), F.nullif(col(updated), F.lit(""))))["ts"]
    return sure(at >= F.timestamp_add("DAY", F.lit(-dims.NEWS_LOOKBACK_DAYS), now))


def is_live(days: Column, today: Column) -> Column:
    """P3, P4. Whether any of the texts' days is today or later."""
    return sure(F.exists(F.filter(days, lambda x: x.isNotNull()), lambda x: F.substring(x, 1, 10).try_cast("date") >= today))


def holds_any(blob: Column | str, words: list[str]) -> Column:
    return sure(reduce(lambda a, b: a | b, [F.contains(F.lower(col(blob)), F.lit(w)) for w in words], F.lit(False)))


def in_scope(city: Column | str, title: Column | str, evidence: Column, blocked: list[str], name: str = "madrid") -> Column:
    """P5. No other city's name, no title "en" another place, no blocked word, and the city's name somewhere."""
    where, what = F.lower(text.clean_text(city)), F.lower(text.clean_text(title))
    elsewhere = F.contains(what, F.lit(" en ")) & ~F.contains(what, F.lit(f" en {name}"))
    return sure(((where == "") | F.contains(where, F.lit(name))) & ~elsewhere & ~holds_any(what, blocked) & F.contains(F.lower(evidence), F.lit(name)))


def of_source(source: str, own: Column | str = "fuente", related: Column | str = "fuentes_relacionadas") -> Column:
    """P6. From the source, first or merged."""
    return sure((col(own) == source) | F.array_contains(F.coalesce(col(related), F.array().cast("array<string>")), source))


def of_category(category: str, categories: Column | str) -> Column:
    """P7."""
    return sure(F.array_contains(col(categories), category))


def free(is_free: Column | str) -> Column:
    """P8."""
    return sure(col(is_free))


def in_zone(zone: str, lat: Column | str, lon: Column | str, label: Column | str, compat: Compat = KEPT) -> Column:
    """P9. Within the zone's radius; without a point in the city, the zone's name in the label. An unknown zone takes all."""
    known = {z[0]: z for z in dims.ZONES}.get(zone)
    if known is None:
        return F.lit(compat.zones_as_written)
    _, zlat, zlon, radius = known
    named = F.contains(F.lower(col(label)), F.lit(zone.lower())) if compat.zones_as_written else F.contains(text.fold_search(label), text.fold_search(F.lit(zone)))
    near = numbers.distance_km(col(lat), col(lon), F.lit(zlat), F.lit(zlon)) <= radius
    return sure(F.when(numbers.within(col(lat), col(lon), dims.PUBLISH_BOX), near).otherwise(named))


def matches_text(query: str, blob: Column | str) -> Column:
    """P10. The folded blob holds every word of the query."""
    words = [w for w in query.split() if w]
    return sure(text.let(col(blob), lambda t: reduce(lambda a, b: a & b, [F.contains(t, text.fold_search(F.lit(w))) for w in words], F.lit(True))))


DATE_FILTERS = {"all": [], "today": ["is_today", "ongoing"], "tomorrow": ["is_tomorrow"], "weekend": ["is_weekend"], "week": ["is_week", "ongoing"], "month": ["is_month", "ongoing"]}


def on_date(which: str, columns: dict[str, Column]) -> Column:
    """P11. all, today, tomorrow, weekend, week or month; what is under way counts for today, the week and the month."""
    names = DATE_FILTERS[which]
    return sure(reduce(lambda a, b: a | b, [columns[n] for n in names])) if names else F.lit(True)


def valid_for_view(id_: Column | str, title: Column | str, upcoming: Column) -> Column:
    """P12. Has an id and a title and isn't over."""
    return sure((col(id_) != "") & (col(title) != "") & upcoming)


def worth_geocoding(query: Column | str, lat: Column | str, lon: Column | str) -> Column:
    """P13. No point yet, and an address of eight characters or more that isn't generic."""
    plain = text.clean_text(F.replace(F.lower(col(query)), F.lit(","), F.lit(" ")))
    generic = [" ".join(q.replace(",", "").split()) for q in dims.GENERIC_QUERIES]
    has_point = sure((col(lat) != 0) & (col(lon) != 0))
    return sure(~has_point & (F.length(F.trim(col(query))) >= 5) & ~plain.isin(*generic) & (F.length(plain) >= 8))


def has_active_filters(query: str = "", source: str = "", category: str = "", zone: str = "", free_only: bool = False, date_filter: str = "all") -> bool:
    """P14."""
    return bool(query or source or category or zone or free_only or date_filter != "all")


def featurable(mode: Column | str, primary: Column | str) -> Column:
    """P15. A plan with a date."""
    return sure((col(mode) != "sin_fecha") & col(primary).isNotNull())
