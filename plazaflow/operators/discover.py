"""Queries over the feed: view model, search, facets, ranking."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plazaflow.functions import arrays, dates, numbers, text, urls
from plazaflow.operators import predicates
from plazaflow.operators.orders import agenda_order, news_order, plan_order, stamped_order  # noqa: F401
from plazaflow.plans import dims
from plazaflow.plans.compat import KEPT, Compat
from plazaflow.plans.storage import kept


@dataclass(frozen=True)
class State:
    """What a reader asks for."""

    query: str = ""
    source: str = ""
    category: str = ""
    date_filter: str = "all"
    free_only: bool = False
    zone: str = ""
    show: int | None = dims.PAGE_SIZE  # None: the whole neutral list


@dataclass(frozen=True)
class Profile:
    """What a reader likes."""

    interests: tuple[str, ...] = ()
    answered: bool = False
    vibe: str | None = None
    budget: str | None = None
    companion: str | None = None
    zones: tuple[str, ...] = field(default=())

    @property
    def personal(self) -> bool:
        return self.answered or bool(self.vibe)


VIEW_INPUT = "datetime_inicio fecha_inicio fecha_fin proximo_datetime proxima_fecha sort_datetime modo_fecha vigente_hasta".split()


def view_events(feed: DataFrame, now: Column) -> DataFrame:
    """R12. Feed rows that aren't over, with what cards show and filters read."""
    r = {c: F.col(c) if c in feed.columns else F.lit(None).cast("string") for c in VIEW_INPUT}
    r["sesiones"] = F.col("sesiones") if "sesiones" in feed.columns else F.lit(None).cast(f"array<{dates.SESSION}>")
    get = lambda c, t="string": F.col(c) if c in feed.columns else F.lit(None).cast(t)
    df = feed.where(predicates.valid_for_view(F.col("id"), F.col("titulo"), dates.is_upcoming(r, now))).withColumn("_dates", dates.resolve_dates(r, now))
    d = F.col("_dates")
    listed = get("categorias_normalizadas", "array<string>")
    main = F.coalesce(text.sanitize_text(get("categoria_principal_norm")), text.sanitize_text(F.get(listed, F.lit(0))), F.lit(dims.LEISURE))
    title = F.coalesce(text.sanitize_text("titulo"), F.lit("Plan sin título"))
    df = df.withColumns({"primary_category": main, "titulo": title, **{c: text.sanitize_text(get(c)) for c in ("subtitulo", "resumen", "descripcion", "lugar", "direccion")}})
    cats = F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(F.array("primary_category"))
    df = df.withColumn("categories", cats)
    zero = F.coalesce(get("es_gratis", "boolean"), F.lit(False)) | F.coalesce(F.col("precio") == 0, F.lit(False))
    columns = {
        "primary": d["primary"],
        "end": d["end"],
        "ongoing": d["ongoing"],
        "schedule_label": dates.schedule_label(d, r["modo_fecha"], now),
        "relative_label": F.when(d["ongoing"], "En curso").when(d["primary"].isNotNull(), dates.relative_day(d["primary"], now)).when(r["modo_fecha"] == "sin_fecha", "Cuando quieras").otherwise("Fecha por confirmar"),
        "price_label": text.price_label("precio", get("es_gratis", "boolean"), "fuente"),
        "location_label": text.location_label("lugar", "direccion"),
        "search_blob": text.search_blob(F.col("titulo"), F.col("subtitulo"), F.col("resumen"), F.col("descripcion"), F.col("lugar"), F.col("direccion"), F.concat_ws(" ", "categories")),
        "is_free": zero,
        "has_coordinates": numbers.within(get("latitud", "double"), get("longitud", "double"), dims.PUBLISH_BOX),
        "source_label": text.source_label("fuente"),
        **dates.buckets(d, now),
        "url": urls.web_url(get("url")),
    }
    return df.withColumns(columns).drop("_dates")


def view_news(feed: DataFrame) -> DataFrame:
    """R13. News with a date, a category and the source's name."""
    df = feed.where(predicates.sure((F.col("id") != "") & (F.col("titulo") != "")))
    published = dates.view_time(F.coalesce(F.nullif("sort_datetime", F.lit("")), "publicado_en"))
    return df.withColumns({"titulo": F.coalesce(text.sanitize_text("titulo"), F.lit("Noticia sin título")), "published": published, "primary_category": F.coalesce(text.sanitize_text("categoria_principal_norm"), F.lit("Actualidad")), "source_label": text.source_label("fuente")})


def hits(blob: Column, words, compat: Compat = KEPT) -> Column:
    """How many of the words the text holds."""
    return reduce(lambda a, b: a + b, [F.contains(blob, F.lit(w) if compat.accents_never_meet else text.fold_search(F.lit(w))).cast("int") for w in words], F.lit(0))


def score(profile: Profile, compat: Compat = KEPT) -> Column:
    """S4. Points of a plan for a profile, 0 to 99. Needs view_events()."""
    blob, price = F.col("search_blob"), F.col("precio")
    points = [F.when(F.col("is_today"), 8).otherwise(0), F.when(F.col("is_free"), 3).otherwise(0), F.when(F.coalesce("imagen", F.lit("")) != "", 2).otherwise(0)]
    if profile.vibe:
        points.append(F.least(F.lit(38), hits(blob, dims.VIBE_WORDS[profile.vibe], compat) * 9))
    if profile.interests:
        points.append(F.least(F.lit(28), hits(blob, [i.lower() for i in profile.interests], compat) * 7))
    if profile.budget == "free":
        points.append(F.when(F.col("is_free"), 18).otherwise(0))
    elif profile.budget == "moderate":
        points.append(F.when(F.col("is_free") | F.coalesce(price <= 25, F.lit(False)), 12).otherwise(0))
    elif profile.budget == "flexible":
        points.append(F.lit(4))
    if profile.companion:
        words, each = dims.COMPANION_WORDS[profile.companion]
        points.append(hits(blob, words, compat) * each)
    if profile.zones:
        near = reduce(lambda a, b: a | b, [predicates.in_zone(z, "latitud", "longitud", "location_label", compat) for z in profile.zones])
        points.append(F.when(near, 10).otherwise(0))
    return F.greatest(F.lit(0), F.least(F.lit(99), reduce(lambda a, b: a + b, points)))


def filtered(view: DataFrame, state: State) -> DataFrame:
    """P6-P11 for a reader's state."""
    buckets = {n: F.col(n) for n in ("is_today", "is_tomorrow", "is_week", "is_weekend", "is_month", "ongoing")}
    out = view.where(predicates.on_date(state.date_filter, buckets))  # first, as only what is left has its texts searched
    if state.source:
        out = out.where(predicates.of_source(state.source) if "fuentes_relacionadas" in view.columns else F.col("fuente") == state.source)
    if state.category:
        out = out.where(predicates.of_category(state.category, "categories"))
    if state.free_only:
        out = out.where(predicates.free("is_free"))
    if state.zone:
        out = out.where(predicates.in_zone(state.zone, "latitud", "longitud", "location_label"))
    if state.query.split():
        out = out.where(predicates.matches_text(state.query, "search_blob"))
    return out


def rank_order(personal: bool) -> list[Column]:
    """S5. Score (for a personal profile), day in UTC (undated last), one-off before ongoing, time, title in the order of a Spanish dictionary; the id
    decides ties."""
    utc = F.convert_timezone(F.lit(dims.TIMEZONE), F.lit("UTC"), F.col("primary"))
    day = F.datediff(utc.cast("date"), F.lit("1970-01-01").cast("date"))
    order = [day.asc_nulls_last(), F.col("ongoing"), F.col("primary").asc_nulls_last(), F.collate("titulo", "es"), F.col("titulo"), F.col("id")]
    return [F.col("score").desc(), *order] if personal else order


def ranked(view: DataFrame, state: State, profile: Profile) -> DataFrame:
    """S5, R14 without S6. Plans that match, with their score, in order."""
    return filtered(view, state).withColumn("score", score(profile)).orderBy(*rank_order(profile.personal))


def first_rows(df: DataFrame, order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """S7, S8. The first `most` rows by an order, numbered from 1: each task keeps its first ones, so little meets in one."""
    return df.orderBy(*order).limit(most).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their place in an order, from 1. Rows are dealt out by range and numbered there; only the partitions'
    sizes meet, as one row each. The dealt rows are kept in the checkpoint folder, as ranges must not differ between uses; so
    are the rows before, which are read twice, once for the ranges."""
    dealt = kept(kept(df).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


#: Rows of a ranked list that one task varies; pending rows up to which a segment says beforehand how it ends.
SEGMENT, SMALL = 1 << 18, 4
#: What a list shows last: the category of its last row, how many rows of it stand together (two at most), and how many more of
#: it wait. Rows wait for others only behind two of their category, so all that wait are of one category.
Shown = tuple[str | None, int, int]
START: Shown = (None, 0, 0)
#: Stands for any category that a segment lacks.
OTHER = "\0"


def shown_after(state: Shown, kind: str) -> Shown:
    """S6. The state after one more row: it waits behind two of its category; another one lets up to two that wait go."""
    last, together, waiting = state
    if kind == last:
        return (last, 2, waiting + 1) if together == 2 else (last, together + 1, 0)
    return (kind, 1, 0) if not waiting else (last, 1, 0) if waiting == 1 else (last, 2, waiting - 2)


def segment_ends(kinds: list[str]) -> dict:
    """What a segment makes of any state: `ends` of states with up to SMALL waiting rows, and for more of them, by category, the net change and from how many on they never run out before the end."""
    own = sorted(set(kinds))
    starts: list[Shown] = [START] + [(c, t, w) for c in [*own, OTHER] for t, w in [(1, 0), *((2, w) for w in range(SMALL + 1))]]
    now: dict[Shown, list[Shown]] = {s: [s] for s in starts}
    for kind in kinds:
        after: dict[Shown, list[Shown]] = {}
        for state, since in now.items():
            after.setdefault(shown_after(state, kind), []).extend(since)
        now = after
    counts = dict.fromkeys([*own, OTHER], 0)
    change, least = dict(counts), dict(counts)
    for k, kind in enumerate(kinds):
        for c in counts:
            if c != kind:
                least[c] = max(least[c], 2 - change[c])
            change[c] += 1 if c == kind else -2
    for kind in kinds:
        counts[kind] += 1
    ends = [[list(s), list(end)] for end, since in now.items() for s in since]
    return {"ends": ends, "counts": counts, "change": change, "least": least}


def known_end(summary: dict, state: Shown) -> Shown | None:
    """The state after a segment, unless only the segment's rows can tell."""
    last, together, waiting = state
    c = last if last is None or last in summary["counts"] else OTHER
    if waiting <= SMALL:
        end = summary["by"][c, together, waiting]
        return (last if end[0] == OTHER else end[0], *end[1:])
    return (last, 2, waiting + summary["change"][c]) if waiting >= summary["least"][c] else None


def _varied(kinds: list[str], state: Shown, emitted: dict[str, int]) -> Iterator[tuple[str, int]]:
    """The categories that a segment shows, in order, each with the number of rows of it that were shown by then."""
    for kind in kinds:
        last, together, waiting = state
        state = shown_after(state, kind)
        if kind == last and together == 2:
            continue
        for c in [kind] if kind == last else [kind] + [last] * min(waiting, 2):
            emitted[c] = emitted.get(c, 0) + 1
            yield c, emitted[c]


def varied_places(keys: DataFrame) -> DataFrame:
    """(_rank, place) of rows with _rank and _kind, varied as a whole (S6), in segments of SEGMENT ranks.

    First each segment says what it makes of any state; these sums, a few numbers a category and segment, are composed in
    order (a segment in which very many waiting rows run out is looked at once more). Then each segment, from the state
    it truly starts with, says which row of a category stands at which place: a category's rows keep their order, so its
    n-th shown row is its n-th row, and the two meet by category and number. Rows that wait at the end follow.
    """
    seg = F.floor((F.col("_rank") - 1) / SEGMENT)
    parts = kept(keys.withColumn("_seg", seg))

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seg": frame._seg[:1], "said": [json.dumps(segment_ends(frame.sort_values("_rank")._kind.tolist()))]})

    def ended(state: Shown) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"end": [json.dumps(reduce(shown_after, frame.sort_values("_rank")._kind.tolist(), state))]})

        return run

    state, before, begins = START, {}, {}
    for r in sorted(parts.groupBy("_seg").applyInPandas(summed, "seg long, said string").collect()):
        summary = json.loads(r.said)
        summary["by"] = {tuple(s): tuple(e) for s, e in summary["ends"]}
        begins[r.seg] = (state, dict(before))
        after = known_end(summary, state)
        if after is None:
            (told,) = parts.where(F.col("_seg") == r.seg).groupBy("_seg").applyInPandas(ended(state), "end string").collect()
            after = tuple(json.loads(told.end))
        for c, n in summary["counts"].items():
            before[c] = before.get(c, 0) + n
        state = after

    def placed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_rank")
        at, counted = begins[frame._seg.iloc[0]]
        emitted = dict(counted) if at[0] is None else counted | {at[0]: counted.get(at[0], 0) - at[2]}
        first = sum(emitted.values())
        kinds = frame._kind.tolist()
        shown = list(_varied(kinds, at, emitted))
        own = frame.groupby("_kind").cumcount() + 1 + frame._kind.map(lambda c: counted.get(c, 0))
        rows = pd.DataFrame({"kind": kinds, "n": own, "_rank": frame._rank, "place": None})
        said = pd.DataFrame({"kind": [c for c, _ in shown], "n": [n for _, n in shown], "_rank": None, "place": range(first + 1, first + len(shown) + 1)})
        return pd.concat([rows, said]).astype({"n": "int64", "_rank": "Int64", "place": "Int64"})

    met = parts.groupBy("_seg").applyInPandas(placed, "kind string, n long, _rank long, place long").groupBy("kind", "n").agg(F.max("_rank").alias("_rank"), F.max("place").alias("place"))
    total = sum(before.values())
    behind = F.col("n") - F.lit(before.get(state[0], 0)) + F.lit(total)  # those of the last category that still wait
    return met.select("_rank", F.coalesce("place", behind).alias("place"))


def diversify(df: DataFrame, most: int | None, category: str = "primary_category", rank: str = "rank") -> DataFrame:
    """S6. Ranked rows in an order that shows at most two neighbours of one category while others are left: a row that would
    be the third waits, and comes as soon as it may. place numbers the new order from 1; its first `most` rows, or all.

    A category's rows keep their order, so the first `most` places need only the first `most` rows of each category: a
    page's are one segment. A whole list is varied in segments (varied_places).
    """
    own = F.row_number().over(Window.partitionBy(category).orderBy(rank))
    top = df if most is None else df.withColumn("_own", own).where(F.col("_own") <= most).drop("_own")
    keys = top.select(F.col(rank).cast("bigint").alias("_rank"), F.coalesce(F.col(category), F.lit("")).alias("_kind"))
    if most is None:
        return top.join(varied_places(keys), F.col(rank) == F.col("_rank")).drop("_rank")

    def page(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"_rank": [], "_kind": []}), *frames])
        ranks: dict[str, list[int]] = {}
        for at, kind in zip(rows._rank.tolist(), rows._kind.tolist()):
            ranks.setdefault(kind, []).append(int(at))
        emitted: dict[str, int] = {}
        order = [ranks[c][n - 1] for c, n in _varied(rows._kind.tolist(), START, emitted)]
        order += [x for c, each in ranks.items() for x in each[emitted.get(c, 0) :]]  # those that wait, all of one category
        yield pd.DataFrame({"_rank": order[:most], "place": range(1, len(order[:most]) + 1)})

    places = keys.repartition(1).sortWithinPartitions("_rank").mapInPandas(page, "_rank bigint, place bigint")
    return top.join(places, F.col(rank) == F.col("_rank")).drop("_rank")


def discover(view: DataFrame, state: State, profile: Profile = Profile()) -> DataFrame:
    """R14. The page that a reader sees: matching plans in order, varied by category where nothing was chosen."""
    matching = filtered(view, state).withColumn("score", score(profile))
    order = rank_order(profile.personal)
    neutral = not profile.personal and not state.category and not state.query.split()
    if not neutral:
        return first_rows(matching, order, state.show)
    return diversify(with_rank(matching, order).withColumn("rank", F.col("rank").cast("int")), state.show)


def featured(view: DataFrame, profile: Profile) -> DataFrame:
    """S7. Up to six dated plans with more than 20 points for a personal profile."""
    if not profile.personal:
        return view.limit(0).withColumns({"score": F.lit(0), "rank": F.lit(0)})
    fit = view.where(predicates.featurable("modo_fecha", "primary")).withColumn("score", score(profile)).where(F.col("score") > dims.FEATURED_SCORE)
    return first_rows(fit, [F.col("score").desc(), F.col("primary"), F.col("id")], dims.FEATURED)


def facets(view: DataFrame) -> DataFrame:
    """G3. (facet, value, n, first): counts of categories and sources; equal counts go by first appearance."""
    cats = view.select(F.lit("category").alias("facet"), F.explode("categories").alias("value"), "_ord")
    every = cats.unionByName(view.select(F.lit("source").alias("facet"), F.col("fuente").alias("value"), "_ord"))
    return every.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_ord").alias("first"))


def city_stats(view: DataFrame, news: DataFrame) -> DataFrame:
    """G4. One row of totals."""
    now_on = F.col("is_today") | F.col("ongoing")
    stats = view.agg(F.count(F.lit(1)).alias("total"), F.count_if(now_on & F.col("is_free")).alias("free_today"), F.count_if(now_on).alias("today"), F.count_if("has_coordinates").alias("with_coordinates"))
    return stats.crossJoin(news.agg(F.count(F.lit(1)).alias("news")))  # one row each


def _mark(c: str) -> Column:
    return F.round(F.col(c), 4)


def map_points(view: DataFrame) -> DataFrame:
    """G12. Marks of a map: places (four decimals) with their number of plans and the mark's radius. A place's plans are
    rows of map_members(), so that a mark of very many is no row of very many."""
    n = F.count(F.lit(1))
    radius = F.least(F.lit(15.0), F.lit(8.0) + F.lit(2.0) * F.log2(n.cast("double")))
    return view.where("has_coordinates").groupBy(_mark("latitud").alias("lat"), _mark("longitud").alias("lon")).agg(n.alias("n"), F.round(radius, 6).alias("radius"))


def map_members(view: DataFrame) -> DataFrame:
    """G12. (lat, lon, id): the plans of each mark."""
    return view.where("has_coordinates").select(_mark("latitud").alias("lat"), _mark("longitud").alias("lon"), "id")


def agenda(view: DataFrame, saved: DataFrame, key: str = "id") -> DataFrame:
    """Q8, S10. The plans that a reader saved, by date. saved: ids, which may repeat or be gone."""
    return view.join(saved.select(key), key, "left_semi").orderBy(*agenda_order())


def grid(view: DataFrame, shown: DataFrame, key: str = "id") -> DataFrame:
    """Q9, X4. Plans that aren't shown above already."""
    return view.join(shown.select(key), key, "left_anti")


def by_id(view: DataFrame, wanted: str, key: str = "id") -> DataFrame:
    """Q10. The plan of an address; the predicate reaches the scan."""
    return view.where(F.col(key) == wanted)


def surprise(view: DataFrame, seed: int) -> DataFrame:
    """S9. One plan of today, this week or under way, else any; the seed decides."""
    near = F.col("is_today") | F.col("is_week") | F.col("ongoing")
    return view.withColumn("_far", ~near).orderBy("_far", F.xxhash64("id", F.lit(seed)), "id").limit(1).drop("_far")
