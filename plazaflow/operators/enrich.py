"""Taxonomy, addresses and coordinates of plans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants as op
from re import _parser as parser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plazaflow.functions import markup, numbers, text
from plazaflow.operators.predicates import worth_geocoding
from plazaflow.plans import dims
from plazaflow.plans.compat import KEPT, Compat


def stems(pattern: str) -> list[str] | None:
    """Literals of which every match of a rule holds one: of each alternative the longest; null if one has none of two letters."""
    found = []
    (kind, group), *_ = [x for x in parser.parse(pattern) if x[0] is not op.AT]
    tree = group[3] if kind is op.SUBPATTERN else []
    options = tree[0][1][1] if len(tree) == 1 and tree[0][0] is op.BRANCH else [tree]
    prefix = ""
    if len(tree) > 1:  # the parser moves what all alternatives begin with before the branch
        prefix, options = "", [tree]
    for option in options:
        runs, run = [], prefix
        for k, value in option:
            if k is op.LITERAL:
                run += chr(value)
            else:
                runs.append(run)
                run = ""
        longest = max([*runs, run], key=len)
        if len(longest) < 2:
            return None
        found.append(longest)
    return found


def rule_hits(low: Column) -> list[Column]:
    """Whether each rule's pattern occurs at a word's start of a lower-case text. A text without any of the rule's stems
    isn't searched by the expression."""
    hits = []
    for pattern, _ in dims.RULES:
        search, words = low.rlike(f"(?U){pattern}"), stems(pattern)
        hits.append(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) & search if words else search)
    return hits


def strong_blob(r: dict[str, Column]) -> Column:
    """What a category is read from first: title, subtitle, place, labels and source."""
    filled = lambda c: F.nullif(c, F.lit(""))
    listed = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.concat_ws(" ", filled(r["titulo"]), filled(r["subtitulo"]), filled(r["lugar"]), listed(r["categorias"]), listed(r["etiquetas"]), filled(r["categoria_principal"]), filled(r["fuente"]))


def _loose(pattern: str) -> str:
    """A rule's pattern in RE2, which reads a text once and never goes back: it matches whatever the pattern does. Edges of words
    need no letter, digit or underscore beyond them, what must not follow is left out."""
    edge = r"[^\p{L}\p{Nd}_]"
    flat = re.sub(r"\(\?\![^()]*(\([^()]*\))?[^()]*\)", "", pattern.removeprefix(r"\b"))
    return rf"(?:^|{edge})" + flat.replace(r"\b", rf"(?:$|{edge})").replace(r"\s", r"[\s\x0b\p{Z}\x{85}]")


def possible_rules(low: Column) -> Column:
    """Bits of the rules that may hit a lower-case text. Long texts hit few rules, so few are left to the rules' own expressions."""
    loose = [_loose(pattern) for pattern, _ in dims.RULES]

    @F.arrow_udf("bigint")
    def bits(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.int64)
        for k, pattern in enumerate(loose):
            hit = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
            out |= hit.to_numpy(zero_copy_only=False).astype(np.int64) << k
        return pa.array(out)

    return bits(low)


def first_labels(strong: Column) -> Column:
    """R3. Categories of all rules that hit the strong text, in lower case."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(hit, F.lit(c)) for hit, (_, c) in zip(rule_hits(strong), dims.RULES)))))


def labels(first: Column, weak: Column, possible: Column) -> Column:
    """R3. Up to three categories: first_labels(); with fewer than two, further ones of rules that hit the weak text, in lower
    case, until there are two; leisure only where there is nothing else. possible: possible_rules() of the weak text."""
    hits = [F.when((possible.bitwiseAND(1 << k) != 0) & weak.rlike(f"(?U){pattern}"), F.lit(c)) for k, (pattern, c) in enumerate(dims.RULES)]
    none = F.array().cast("array<string>")
    further = F.when((F.size(first) < 2) & (possible != 0), F.array_distinct(F.array_compact(F.array(*hits)))).otherwise(none)
    more = text.let(F.array_except(further, first), lambda m: F.concat(first, F.slice(m, 1, F.greatest(2 - F.size(first), F.lit(0)))))
    all_ = text.let(more, lambda m: F.when(F.size(m) == 0, F.array(F.lit(dims.LEISURE))).when(F.size(m) > 1, F.array_remove(m, dims.LEISURE)).otherwise(m))
    return F.slice(all_, 1, dims.CATEGORY_LIMIT)


def classify(plans: DataFrame, force: bool = True) -> DataFrame:
    """R3, R4. categorias_normalizadas and categoria_principal_norm; without `force`, categories that there are stay."""
    r = {c: F.col(c) if c in plans.columns else F.lit(None).cast("string") for c in ("titulo", "subtitulo", "lugar", "categoria_principal", "fuente", "resumen", "descripcion")}
    r |= {c: F.col(c) if c in plans.columns else F.lit(None).cast("array<string>") for c in ("categorias", "etiquetas")}
    blobs = plans.withColumns({"_strong": F.lower(strong_blob(r)), "_weak": F.lower(F.concat_ws(" ", r["resumen"], r["descripcion"]))})
    blobs = blobs.withColumn("_first", first_labels(F.col("_strong")))
    blobs = blobs.withColumn("_possible", possible_rules(F.when(F.size("_first") < 2, F.col("_weak"))))
    found = labels(F.col("_first"), F.col("_weak"), F.col("_possible"))
    if not force and "categorias_normalizadas" in plans.columns:
        found = F.when(F.size("categorias_normalizadas") > 0, F.col("categorias_normalizadas")).otherwise(found)
    out = blobs.withColumn("categorias_normalizadas", found).drop("_strong", "_weak", "_first", "_possible")
    return out.withColumn("categoria_principal_norm", F.get("categorias_normalizadas", F.lit(0)))


def without_placeholders(plans: DataFrame) -> DataFrame:
    """H5. Placeholder pictures removed."""
    return plans.withColumn("imagen", markup.real_image("imagen"))


def resolve_images(plans: DataFrame, resolver: Callable[[str, str], str | None], reference: str = "referencia_url") -> DataFrame:
    """G14. Pictures of plans that have an address and none yet: each (address, reference) is resolved once, on the
    executors, and written to all plans that have it."""
    wants = (F.coalesce("imagen", F.lit("")) == "") & (F.coalesce("url", F.lit("")) != "")
    ref = F.coalesce(F.col(reference), F.lit("")) if reference in plans.columns else F.lit("")
    keyed = plans.withColumns({"_url": F.when(wants, F.col("url")), "_ref": F.when(wants, ref)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(_image=[resolver(u, r) for u, r in zip(frame._url, frame._ref)])

    keys = keyed.where("_url is not null").select("_url", "_ref").distinct()
    found = keys.mapInPandas(run, "_url string, _ref string, _image string").where(F.coalesce("_image", F.lit("")) != "")
    return keyed.join(found, ["_url", "_ref"], "left").withColumn("imagen", F.coalesce("_image", "imagen")).drop("_url", "_ref", "_image")


def clean_address(c: Column | str) -> Column:
    """R6. An address to look up: without the country's name, with the city and the country at its end."""
    bare = F.trim(F.regexp_replace(F.trim(text.col(c)), r"(?iU)\b(España|Spain)\b", ""))
    cut = F.regexp_replace(bare, r"[,. ]+$", "")
    low = F.lower(bare)
    return F.trim(F.when(~F.contains(low, F.lit("madrid")), F.concat(cut, F.lit(", Madrid, España"))).when(~F.contains(low, F.lit("españa")) & ~F.contains(low, F.lit("spain")), F.concat(cut, F.lit(", España"))).otherwise(bare))


def lookups(plans: DataFrame, cache: DataFrame, most: int = dims.NEW_LOOKUPS) -> DataFrame:
    """W5. (cache_key, _ord): the first `most` addresses, by their first plan, that are worth looking up and not cached."""
    wanted = with_query(plans).where("_wanted").groupBy("cache_key").agg(F.min("_ord").alias("_ord"))
    return wanted.join(cache.select("cache_key"), "cache_key", "left_anti").orderBy("_ord", "cache_key").limit(most)


def with_query(plans: DataFrame) -> DataFrame:
    query = F.coalesce(text.sanitize_text("direccion"), text.sanitize_text("lugar"))
    out = plans.withColumn("_query", query)
    return out.withColumns({"_wanted": worth_geocoding("_query", "latitud", "longitud"), "cache_key": F.lower(clean_address("_query"))})


def resolve_addresses(keys: DataFrame, resolver: Callable[[str], tuple[float, float] | None], compat: Compat = KEPT) -> DataFrame:
    """New cache rows from a resolver, one call a key; points outside the box, and failures, are cached as nulls."""
    south, north, west, east = dims.GEOCODE_BOX

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = [resolver(k) for k in frame.cache_key]
            good = [p if p and south <= p[0] <= north and west <= p[1] <= east else (None, None) for p in points]
            yield pd.DataFrame({"cache_key": frame.cache_key, "lat": [round(p[0], 6) if p[0] is not None else None for p in good], "lon": [round(p[1], 6) if p[1] is not None else None for p in good], "query": frame.cache_key})

    found = keys.select("cache_key").mapInPandas(run, "cache_key string, lat double, lon double, query string")
    return found if compat.failures_are_cached else found.where("lat is not null")


def geocode(plans: DataFrame, cache: DataFrame) -> DataFrame:
    """R5, Q3. Coordinates from the cache for plans that lack them."""
    known = cache.select("cache_key", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    joined = with_query(plans).join(known, "cache_key", "left")
    use = F.col("_wanted") & F.col("_lat").isNotNull()
    return joined.withColumns({"latitud": F.when(use, F.col("_lat")).otherwise(F.col("latitud")), "longitud": F.when(use, F.col("_lon")).otherwise(F.col("longitud"))}).drop("cache_key", "_query", "_wanted", "_lat", "_lon")


def shared_purchase_urls(plans: DataFrame) -> DataFrame:
    """G5. A purchase address that several records of a source have says nothing: it moves to the metadata."""
    several = (F.count("url_compra").over(Window.partitionBy("fuente", "url_compra")) > 1) & F.col("url_compra").isNotNull()
    kept = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "url_compra_original"), F.create_map(F.lit("url_compra_original"), F.col("url_compra")))
    return plans.withColumn("_several", several).withColumns({"metadata": F.when(F.col("_several"), kept).otherwise(F.col("metadata")), "url_compra": F.when(~F.col("_several"), F.col("url_compra"))}).drop("_several")
