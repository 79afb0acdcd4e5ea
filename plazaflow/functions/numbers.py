"""Number, price and geographic functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazaflow.functions.text import clean_text, let, place_token
from plazaflow.plans import dims


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_float(c: Column | str) -> Column:
    """M1. The number that a text is, else null; a suffix of a Java literal (1d, 1f) is no part of one."""
    text = col(c).cast("string")
    return F.when(~text.rlike(r"[dDfF]\s*$") | text.rlike(r"(?i)inf\s*$"), text.try_cast("double"))


def is_free(price: Column | str) -> Column:
    """M2. Whether the price is zero; null without a price."""
    return col(price) == 0


NUMBER = r"(\d+(?:[.,]\d+)?)"


def _number(text: Column) -> Column:
    return F.nullif(F.replace(text, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def text_price(price: Column | str, free: Column, title: Column) -> Column:
    """M3. struct<precio, moneda> of a free text: zero for words that say so, else the first number; without a text, zero
    if the flag is 1 or the title says gratis."""
    raw = F.lower(F.trim(F.coalesce(col(price), F.lit(""))))
    free_ = F.coalesce(free == 1, F.lit(False)) | F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit("gratis"))
    zero = _has(raw, ["gratis", "gratuito", "free"]) | (raw == "0")
    value = F.when(raw == "", F.when(free_, F.lit(0.0))).when(zero, F.lit(0.0)).otherwise(_number(F.regexp_extract(raw, r"(\d+[.,]?\d*)", 1)))
    return F.struct(value.alias("precio"), F.when((raw != "") | free_, F.lit("EUR")).alias("moneda"))


def least_price(c: Column | str, adjacent: bool = True, free_first: bool = False) -> Column:
    """M4. The least number (next to a euro sign, if `adjacent`); zero for words that say so: before numbers if `free_first`,
    else only without a number."""

    def found(text: Column) -> Column:
        least = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(NUMBER + r"\s*(?:€|euros?)" if adjacent else NUMBER), F.lit(1)), _number))
        zero = F.when(_has(text, dims.FREE_WORDS), F.lit(0.0))
        return F.coalesce(zero, least) if free_first else F.coalesce(least, zero)

    return let(F.lower(clean_text(c)), found)


#: Patterns of a general price, the surest first.
GENERAL = [rf"entrada\s+general\s*:?\s*{NUMBER}\s*€", rf"\bgeneral\s*:?\s*{NUMBER}\s*€", rf"localidades\s+sueltas\s*:\s*desde\s*{NUMBER}\s*€", rf"matr[ií]cula\s*.*?precio\s*:\s*{NUMBER}\s*€", rf"desde\s*{NUMBER}\s*€"]


def ranked_price(c: Column | str) -> Column:
    """M5. The price by the surest pattern that matches, else the least price."""
    found = lambda text: F.coalesce(*(_number(F.regexp_extract(text, p, 1)) for p in GENERAL), least_price(text))
    return let(F.lower(clean_text(c)), found)


def offers_price(prices: Column | str, currencies: Column | str) -> Column:
    """M6. struct<precio, moneda>: the least of the offers' prices, the first currency."""
    return F.struct(F.array_min(F.transform(col(prices), as_float)).alias("precio"), F.get(F.filter(col(currencies), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)).alias("moneda"))


def first_number(*fields: Column | str) -> Column:
    """M7. The first field that is a number."""
    return F.coalesce(*(as_float(f) for f in fields))


def price_or_policy(price: Column | str, policy: Column) -> Column:
    """M8. The price, or zero where the venue's policy says so."""
    return F.coalesce(col(price), F.when(policy, F.lit(0.0)))


def round_coord(c: Column | str) -> Column:
    """M9. Five decimals."""
    return F.round(as_float(c), 5)


def within(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """M11. Whether a point lies in the box; false without one."""
    south, north, west, east = box
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def concrete_place(place: Column | str, address: Column | str) -> Column:
    """Whether place or address names more than the city."""
    named = lambda c: ~F.coalesce(place_token(c), F.lit("")).isin("", *dims.GENERIC_PLACES)
    return named(place) | named(address)


def clean_coordinates(lat: Column | str, lon: Column | str, place: Column | str, address: Column | str) -> Column:
    """M10. struct<lat, lon>, rounded; nulls outside the city or without a concrete place."""
    la, lo = round_coord(lat), round_coord(lon)
    good = within(la, lo, dims.PUBLISH_BOX) & concrete_place(place, address)
    return F.struct(F.when(good, la).alias("lat"), F.when(good, lo).alias("lon"))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M12. Equirectangular distance, good at a city's scale."""
    dx = (lon2 - lon1) * F.lit(111.32) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * F.lit(111.32)
    return F.sqrt(dx * dx + dy * dy)


def hinted(hints: list[tuple[Column, list[str], bool]]) -> Column:
    """M13. The value of the first hint one of whose words its text holds; false if none does."""
    chain = None
    for text, words, value in hints:
        hit = _has(F.lower(F.coalesce(text, F.lit(""))), words)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain.otherwise(F.lit(False))


def map_link_point(c: Column | str) -> Column:
    """M14. struct<lat, lon> of "@lat,lon" in a map's address."""
    part = lambda k: F.nullif(F.regexp_extract(col(c), r"@(-?\d+\.\d+),(-?\d+\.\d+)", k), F.lit("")).cast("double")
    return F.struct(part(1).alias("lat"), part(2).alias("lon"))


def near_city(lat: Column | str, city: Column | str) -> Column:
    """M15. No latitude more than two degrees off; without one, no other city's name."""
    la = as_float(lat)
    name = F.lower(clean_text(city))
    return F.when(la.isNotNull(), F.abs(la - 40.42) <= 2.0).otherwise((name == "") | F.contains(name, F.lit("madrid")))
