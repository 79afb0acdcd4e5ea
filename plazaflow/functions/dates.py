"""Date, time and session functions on columns.

Local times are timestamp_ntz in Europe/Madrid whatever the session's time zone; "today" and "now" are always arguments.
A temporal is struct<raw, ts timestamp_ntz, d date, has_time, iso>; a session struct<fecha, datetime, tiene_hora>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazaflow.functions.text import clean_text, fold_search, let
from plazaflow.plans import dims


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


TEMPORAL = "struct<raw:string,ts:timestamp_ntz,d:date,has_time:boolean,iso:string>"
SESSION = "struct<fecha:string,datetime:string,tiene_hora:boolean>"
PATTERN = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,6}\d*)?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def iso_local(ts: Column) -> Column:
    """A local time with its offset, to the second."""

    def offset(t: Column) -> Column:
        minutes = F.timestamp_diff("MINUTE", F.convert_timezone(F.lit(dims.TIMEZONE), F.lit("UTC"), t), t)
        return let(minutes, lambda m: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(m < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(m) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(m) % 60).cast("string"), 2, "0")))

    return let(ts, offset)


def temporal_of(raw: Column, ts: Column, has_time: Column) -> Column:
    return F.when(ts.isNotNull(), F.struct(raw.alias("raw"), ts.alias("ts"), ts.cast("date").alias("d"), has_time.alias("has_time"), iso_local(F.date_trunc("second", ts)).alias("iso"))).cast(TEMPORAL)


def parse_temporal(c: Column | str) -> Column:
    """D1. An ISO day or time; without an offset local, else turned to local; null for anything else. A time of day of
    0:00, 23:59 or 23:59:59 counts as none."""

    def local_time(text: Column) -> Column:
        compact = F.replace(F.replace(F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), F.lit(","), F.lit(".")), F.lit("Z"), F.lit("+00:00"))
        return let(compact, lambda t: F.when(t.rlike(PATTERN), let(F.regexp_extract(t, r"[T ].*([+-]\d{2}:?\d{2})$", 1), lambda offset: turned(t, offset))))

    def turned(t: Column, offset: Column) -> Column:
        bare = F.when(offset == "", t).otherwise(F.substring(t, F.lit(1), F.length(t) - F.length(offset)))
        ts = F.regexp_replace(bare, r"([T ]\d{2})$", "$1:00").try_cast("timestamp_ntz")
        minutes = (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int")) * F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
        return F.when(offset == "", ts).otherwise(F.convert_timezone(F.lit("UTC"), F.lit(dims.TIMEZONE), F.timestamp_add("MINUTE", -minutes, ts)))

    def whole(text: Column, at: Column) -> Column:
        timed = (text.rlike(r"\d{2}:\d{2}") | F.contains(text, F.lit("T"))) & ~F.date_format(at, "HH:mm:ss.SSSSSS").isin("00:00:00.000000", "23:59:00.000000", "23:59:59.000000")
        return temporal_of(text, at, timed)

    return let(clean_text(col(c).cast("string")), lambda text: let(local_time(text), lambda at: whole(text, at)))


def normalized(c: Column | str) -> Column:
    """D2. The ISO form of a time, or null."""
    return parse_temporal(c)["iso"]


def sessions(dates: Column | str, start: Column | str, end: Column | str) -> Column:
    """D3. Temporals of the dates (or of start and end without any): of a day with timed ones each time once, else its first."""
    given = F.filter(F.coalesce(col(dates), F.array().cast("array<string>")), lambda x: x.isNotNull())
    ends = F.filter(F.array(col(start).cast("string"), col(end).cast("string")), lambda x: F.coalesce(x, F.lit("")) != "")
    parsed = F.filter(F.transform(F.when(F.size(given) > 0, given).otherwise(ends), parse_temporal), lambda t: t.isNotNull())
    key = lambda t: F.when(t["has_time"], t["iso"]).otherwise(t["d"].cast("string"))
    timed_days = lambda every: F.transform(F.filter(every, lambda t: t["has_time"]), lambda t: t["d"])
    kept = let(parsed, lambda every: let(timed_days(every), lambda timed: F.filter(every, lambda t: t["has_time"] | ~F.array_contains(timed, t["d"]))))
    once = let(kept, lambda some: let(F.transform(some, key), lambda keys: F.filter(some, lambda t, i: F.array_position(keys, key(t)) == i + 1)))
    return F.transform(F.array_sort(F.transform(once, lambda t: F.struct(t["d"].alias("d"), t["ts"].alias("ts"), t.alias("t")))), lambda x: x["t"])


def session(t: Column) -> Column:
    """D4. A temporal as a session."""
    return F.struct(t["d"].cast("string").alias("fecha"), F.when(t["has_time"], t["iso"]).alias("datetime"), t["has_time"].alias("tiene_hora")).cast(SESSION)


def end_of_day(day: Column) -> Column:
    return iso_local(F.concat(day.cast("date").cast("string"), F.lit(" 23:59:59")).cast("timestamp_ntz"))


def start_of_day(day: Column) -> Column:
    """D6. Midnight of a day, as ISO."""
    return iso_local(day.cast("date").cast("timestamp_ntz"))


def from_day(day: Column) -> Column:
    """D6. A day as a temporal without a time."""
    return temporal_of(day.cast("string"), day.cast("date").cast("timestamp_ntz"), F.lit(False))


def effective_end(t: Column) -> Column:
    """D5. The time, or the end of the day without one."""
    return F.when(t["has_time"], t["iso"]).otherwise(end_of_day(t["d"]))


def output_sessions(s: Column | str, today: Column) -> Column:
    """D7. Up to two sessions as they are; of more those from today on, or the last."""
    ahead = F.filter(col(s), lambda t: t["d"] >= today)
    return F.when(F.size(col(s)) <= 2, col(s)).when(F.size(ahead) > 0, ahead).otherwise(F.slice(col(s), -1, 1))


def next_relevant(start: Column, end: Column, s: Column | str, today: Column) -> Column:
    """D8. The first session from today on; else today within the range; else the start if ahead; else today before the end."""
    ahead = F.get(F.filter(col(s), lambda t: t["d"] >= today), F.lit(0))
    now = from_day(today)
    rest = F.when((start["d"] <= today) & (end["d"] >= today), now).when(start["d"] >= today, start).when(end["d"] >= today, now)
    return F.coalesce(ahead.cast(TEMPORAL), rest)


def plan_mode(start: Column, end: Column, s: Column | str) -> Column:
    """D9. sin_fecha, rango, multiple, puntual_con_hora or puntual."""
    n = F.size(col(s))
    some = F.coalesce(start, end, F.get(col(s), F.lit(0)))
    apart = F.coalesce(start["d"] != end["d"], F.lit(False))
    return F.when(some.isNull(), "sin_fecha").when(apart & (n <= 2), "rango").when(apart | (n > 1), "multiple").when(some["has_time"], "puntual_con_hora").otherwise("puntual")


def temporal_status(start: Column, end: Column, today: Column) -> Column:
    """D10. sin_fecha, pasado, en_curso or proximo, from days."""
    first, last = F.coalesce(start["d"], end["d"]), F.coalesce(end["d"], start["d"])
    return F.when(first.isNull(), "sin_fecha").when(last < today, "pasado").when((first <= today) & (today <= last), "en_curso").otherwise("proximo")


def ordered_ends(start: Column, end: Column, s: Column | str) -> tuple[Column, Column]:
    """D11. Start and end, from the sessions where they lack; an end before the start is the start."""
    first = F.coalesce(start, F.get(col(s), F.lit(0)))
    last = F.coalesce(end, F.try_element_at(col(s), F.lit(-1)))
    return first, F.when(last["ts"] < first["ts"], first).otherwise(last)


def record_session(day: Column | str, at: Column | str, has_time: Column | str) -> Column:
    """D12. A session from a record's start; null without a day."""
    timed = F.coalesce(col(has_time), F.lit(False)) & (F.coalesce(col(at), F.lit("")) != "")
    return F.when(F.coalesce(col(day).cast("string"), F.lit("")) != "", F.struct(col(day).cast("string").alias("fecha"), F.when(timed, col(at)).alias("datetime"), timed.alias("tiene_hora"))).cast(SESSION)


def day_and_time(day: Column | str, clock: Column | str) -> Column:
    """D13. Day and HH:MM as one ISO text; the day alone without a time."""
    time = F.regexp_extract(F.coalesce(col(clock), F.lit("")), r"(\d{1,2})[:.](\d{2})", 1)
    full = F.concat(col(day), F.lit("T"), F.lpad(time, 2, "0"), F.lit(":"), F.regexp_extract(col(clock), r"(\d{1,2})[:.](\d{2})", 2), F.lit(":00"))
    return F.when(time != "", full).otherwise(col(day))


def month_number(c: Column | str) -> Column:
    """The month that a Spanish or English name or abbreviation stands for."""
    table = F.create_map(*(F.lit(x) for kv in dims.month_numbers().items() for x in kv))
    return F.try_element_at(table, F.regexp_replace(fold_search(F.trim(col(c))), r"\.$", ""))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


MONTH = r"([a-záéíóúñ]+)\.?"


def spanish_range(c: Column | str) -> Column:
    """D14. struct<first, last> of "del D [de M] [de Y] al D de M de Y", or of a single "D de M de Y"; what the start lacks
    is the end's."""
    text = F.lower(clean_text(c))
    span = rf"(\d{{1,2}})(?:\s+de\s+{MONTH})?(?:\s+(?:de\s+)?(\d{{4}}))?\s+al?\s+(\d{{1,2}})\s+de\s+{MONTH}(?:\s+(?:de\s+)?(\d{{4}}))"
    one = rf"(\d{{1,2}})\s+de\s+{MONTH}\s+(?:de\s+)?(\d{{4}})"
    y2, m2 = _int(text, span, 6), month_number(F.regexp_extract(text, span, 5))
    last = _day(y2, m2, _int(text, span, 4))
    first = _day(F.coalesce(_int(text, span, 3), y2), F.coalesce(month_number(F.regexp_extract(text, span, 2)), m2), _int(text, span, 1))
    single = _day(_int(text, one, 3), month_number(F.regexp_extract(text, one, 2)), _int(text, one, 1))
    return F.struct(F.coalesce(first, single).alias("first"), F.coalesce(last, single).alias("last"))


def card_dates(c: Column | str) -> Column:
    """D15. struct<first, last> as ISO texts of a card: a range of days, one day with an hour (or two), or an open start."""
    text = F.lower(clean_text(c))
    span = spanish_range(text)
    one = _int(text, r"(\d{1,2})[:.](\d{2})\s*h?", 1).isNotNull()
    times = F.regexp_extract_all(text, F.lit(r"(\d{1,2}[:.]\d{2})"), F.lit(1))
    single = span["first"] == span["last"]
    opened = text.rlike("^a partir del")
    first = F.when(single & one, day_and_time(span["first"].cast("string"), F.get(times, F.lit(0)))).otherwise(span["first"].cast("string"))
    last = F.when(opened, F.lit(None)).when(single & one, day_and_time(span["last"].cast("string"), F.coalesce(F.get(times, F.lit(1)), F.get(times, F.lit(0))))).otherwise(span["last"].cast("string"))
    return F.struct(first.alias("first"), last.alias("last"))


def date_label(c: Column | str) -> Column:
    """D16. "12 JUL 2026" as an ISO day."""
    text = F.lower(clean_text(c))
    pattern = r"(\d{1,2})\s+([a-záéíóú]+)\.?\s+(\d{4})"
    return _day(_int(text, pattern, 3), month_number(F.regexp_extract(text, pattern, 2)), _int(text, pattern, 1)).cast("string")


def duration_minutes(c: Column | str) -> Column:
    """D19. "N min", else "N horas" times 60."""
    text = F.lower(clean_text(c))
    return F.coalesce(_int(text, r"(\d+)\s*min", 1), _int(text, r"(\d+)\s*hora", 1) * 60)


def dmy_days(c: Column | str) -> Column:
    """Days written d/m/y, in order, each once."""
    found = F.regexp_extract_all(clean_text(c), F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1))
    days = F.transform(found, lambda x: _day(F.split(x, "/")[2].cast("int"), F.split(x, "/")[1].cast("int"), F.split(x, "/")[0].cast("int")).cast("string"))
    return F.array_distinct(F.filter(days, lambda x: x.isNotNull()))


def dmy_fields(c: Column | str) -> Column:
    """D17. struct<first, last> of "d/m/y - d/m/y", of "d/m/y HH:MM" with a duration, or of a day."""
    text, days = clean_text(c), dmy_days(c)
    clock = F.regexp_extract(text, r"\d{4}\D{1,6}(\d{1,2}:\d{2})", 1)
    first, second = F.get(days, F.lit(0)), F.get(days, F.lit(1))
    timed = F.when(clock != "", day_and_time(first, clock))
    end = F.date_format(F.timestamp_add("MINUTE", duration_minutes(text), timed.try_cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.struct(F.coalesce(F.when(second.isNull(), timed), first).alias("first"), F.coalesce(second, end, timed, first).alias("last"))


def dmy_pair(c: Column | str) -> Column:
    """D18. struct<first, last>: the first two different days written d/m/y."""
    days = dmy_days(c)
    return F.struct(F.get(days, F.lit(0)).alias("first"), F.coalesce(F.get(days, F.lit(1)), F.get(days, F.lit(0))).alias("last"))


def time_range(c: Column | str) -> Column:
    """D20. struct<first, last>: the first two times, as HH:MM."""
    found = F.regexp_extract_all(clean_text(c), F.lit(r"(\d{1,2})[:.]\d{2}"), F.lit(0))
    clock = lambda k: F.lpad(F.replace(F.get(found, F.lit(k)), F.lit("."), F.lit(":")), 5, "0")
    return F.struct(clock(0).alias("first"), clock(1).alias("last"))


def overnight(day: Column, first: Column, last: Column) -> Column:
    """D21. struct<first, last>: times of a day; an end that isn't after the start is on the next day."""
    d = day.cast("date")
    end_day = F.when(last <= first, F.date_add(d, 1)).otherwise(d)
    return F.struct(day_and_time(d.cast("string"), first).alias("first"), F.when(last.isNotNull(), day_and_time(end_day.cast("string"), last)).alias("last"))


def weekly(start: Column, end: Column, days: Column, interval: Column, excluded: Column) -> Column:
    """D23. Days from start to end whose code (MO, TU, ...) is among the days, every `interval` weeks from the start's week,
    without the excluded ones; the start alone if there is none."""
    codes = F.array(*map(F.lit, dims.DAY_CODES))
    wanted = F.transform(F.split(F.coalesce(days, F.lit("")), ","), F.trim)
    step = F.when(interval >= 1, interval).otherwise(1)
    monday = F.date_trunc("week", start.cast("timestamp_ntz")).cast("date")
    skipped = F.transform(F.split(F.coalesce(excluded, F.lit("")), ","), F.trim)
    every = F.when(end >= start, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(F.array(start))
    found = F.filter(
        every,
        lambda d: F.array_contains(wanted, F.get(codes, F.weekday(d)))
        & (F.floor(F.datediff(d, monday) / 7) % step == 0)
        & ~F.array_contains(skipped, d.cast("string")),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(start))


def every_seven(start: Column, end: Column) -> Column:
    """D24. Days from start to end, a week apart."""
    return F.when(end >= start, F.sequence(start, end, F.expr("interval 7 days"))).otherwise(F.array(start))


def body_sessions(c: Column | str, year: Column) -> Column:
    """D25. "D de MES: HH:MM h" in a text, with a default year, as ISO texts."""
    text = F.lower(clean_text(c))
    pattern = r"(\d{1,2})\s+de\s+([a-záéíóú]+)\s*:\s*(\d{1,2}[:.]\d{2})"
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    rows = F.arrays_zip(part(1).alias("d"), part(2).alias("m"), part(3).alias("t"))
    out = F.transform(rows, lambda r: day_and_time(_day(year, month_number(r["m"]), r["d"].cast("int")).cast("string"), r["t"]))
    return F.filter(out, lambda x: x.isNotNull())


def section_sessions(c: Column | str, year: Column) -> Column:
    """D26. "Mié 12/03, 19:30" in a text, with a year, as ISO texts."""
    pattern = r"(\d{1,2})/(\d{1,2})\s*,\s*(\d{1,2}[:.]\d{2})"
    part = lambda text, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    rows = let(clean_text(c), lambda text: F.arrays_zip(part(text, 1).alias("d"), part(text, 2).alias("m"), part(text, 3).alias("t")))
    out = F.transform(rows, lambda r: day_and_time(_day(year, r["m"].cast("int"), r["d"].cast("int")).cast("string"), r["t"]))
    return F.filter(out, lambda x: x.isNotNull())


def iso_interval(c: Column | str) -> Column:
    """D27. struct<first, last> of "iso - iso"."""
    part = lambda k: F.nullif(F.regexp_extract(clean_text(c), r"(\d{4}-\d{2}-\d{2}\S*)(?:\s+-\s+(\d{4}-\d{2}-\d{2}\S*))?", k), F.lit(""))
    return F.struct(part(1).alias("first"), part(2).alias("last"))


def epoch_iso(c: Column | str) -> Column:
    """D28. Unix seconds as UTC; a year of five digits has no sign."""
    at = F.timestamp_add("SECOND", col(c).cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.ltrim(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("+"))


def to_local_iso(c: Column | str) -> Column:
    """D29. A time as local ISO; a text that is none as it is."""
    return F.coalesce(normalized(c), F.nullif(clean_text(c), F.lit("")))


def all_day(c: Column | str) -> Column:
    """D30. The day where there is no time of day, else the local time."""
    t = parse_temporal(c)
    return F.when(t["has_time"], F.date_format(t["ts"], "yyyy-MM-dd'T'HH:mm:ss")).otherwise(t["d"].cast("string"))


def gmt_iso(c: Column | str) -> Column:
    """D31. A time without an offset as UTC."""
    text = clean_text(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), F.concat(text, F.lit("Z")))


def view_time(c: Column | str) -> Column:
    """D32. A day is its noon, a time itself; local, null for anything else."""
    return let(clean_text(c), lambda t: F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit(" 12:00:00")).try_cast("timestamp_ntz")).otherwise(parse_temporal(t)["ts"]))


def day_start(now: Column) -> Column:
    """D33. Midnight before a local time."""
    return F.date_trunc("day", now)


def day_end(now: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(-1000), F.timestamp_add("DAY", F.lit(1), day_start(now)))


def daypart(now: Column) -> Column:
    """D34. Part of the day of a local time."""
    h = F.hour(now)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 21), "evening").otherwise("night")


RESOLVED = "struct<primary:timestamp_ntz,end:timestamp_ntz,ongoing:boolean,time_source:string>"


def resolve_dates(r: dict[str, Column], now: Column) -> Column:
    """D35. struct<primary, end, ongoing, time_source>: the next date that matters to someone looking now."""
    today = day_start(now)
    noon = F.timestamp_add("HOUR", F.lit(12), today)
    none = F.lit(None)
    filled = lambda *names: F.coalesce(*(F.nullif(r[n].cast("string"), F.lit("")) for n in names))
    options = F.transform(F.coalesce(r["sesiones"], F.array().cast(f"array<{SESSION}>")), lambda s: F.struct(view_time(F.coalesce(F.nullif(s["datetime"], F.lit("")), s["fecha"])).alias("ts"), F.nullif(s["datetime"], F.lit("")).alias("iso")))
    ahead = F.get(F.array_sort(F.filter(options, lambda s: s["ts"] >= today)), F.lit(0))
    facts = F.struct(
        view_time(filled("datetime_inicio", "fecha_inicio")).alias("start"),
        view_time(filled("fecha_fin")).alias("end"),
        ahead.alias("ahead"),
        view_time(filled("proximo_datetime", "proxima_fecha", "sort_datetime")).alias("fallback"),
    )

    def decided(f: Column) -> Column:
        start, end, ahead, fallback = f["start"], f["end"], f["ahead"], f["fallback"]
        case = lambda primary, ongoing, source: F.struct(primary.alias("primary"), end.alias("end"), F.lit(ongoing).alias("ongoing"), source.cast("string").alias("time_source")).cast(RESOLVED)
        return (
            F.when((r["modo_fecha"] == "multiple") & ahead.isNotNull(), case(ahead["ts"], False, ahead["iso"]))
            .when((start < today) & (end >= today), case(noon, True, none))
            .when(start >= today, case(start, False, filled("datetime_inicio")))
            .when(ahead.isNotNull(), case(ahead["ts"], False, ahead["iso"]))
            .when(end >= today, case(noon, True, none))
            .when(fallback >= today, case(fallback, False, filled("proximo_datetime")))
            .otherwise(case(none.cast("timestamp_ntz"), False, none))
        )

    return let(facts, decided)


def has_real_time(c: Column | str) -> Column:
    """D36. Whether an ISO text has a time other than 0:00 and 23:59."""
    clock = F.regexp_extract(col(c), r"T(\d{2}:\d{2})", 1)
    return F.coalesce(~clock.isin("", "00:00", "23:59"), F.lit(False))


def is_upcoming(r: dict[str, Column], now: Column) -> Column:
    """D37. Not over yet: a timed end plus three hours, else the end's day, else the start's; true without a date."""
    today = day_start(now)
    filled = lambda *names: F.coalesce(*(F.nullif(r[n].cast("string"), F.lit("")) for n in names))
    end_text = filled("vigente_hasta", "fecha_fin")
    facts = F.struct(end_text.alias("text"), view_time(end_text).alias("end"), view_time(filled("datetime_inicio", "fecha_inicio")).alias("start"))

    def decided(f: Column) -> Column:
        timed = now <= F.timestamp_add("HOUR", F.lit(dims.GRACE_HOURS), f["end"])
        return F.when(f["end"].isNotNull(), F.when(has_real_time(f["text"]), timed).otherwise(f["end"] >= today)).when(f["start"].isNotNull(), f["start"] >= today).otherwise(True)

    return let(facts, decided)


def buckets(resolved: Column, now: Column) -> dict[str, Column]:
    """D38. Whether a plan is today, tomorrow, within a week, at the weekend, within a month (whose end may overflow)."""
    primary, end, ongoing = resolved["primary"], F.coalesce(resolved["end"], F.lit("9999-12-31").cast("timestamp_ntz")), resolved["ongoing"]
    first, last = day_start(now), day_end(now)
    day = now.cast("date")
    sunday = F.date_add(day, (7 - F.weekday(day) - 1).cast("int"))
    weekend = F.greatest(F.date_add(sunday, -1).cast("timestamp_ntz"), first)
    weekend_end = day_end(sunday.cast("timestamp_ntz"))
    month_end = day_end(F.date_add(F.add_months(F.trunc(day, "month"), 1), F.dayofmonth(day) - 1).cast("timestamp_ntz"))
    add = lambda days: F.timestamp_add("DAY", F.lit(days), last)
    sure = lambda c: F.coalesce(c, F.lit(False))
    return {
        "is_today": sure((primary >= first) & (primary <= last)),
        "is_tomorrow": sure((primary > last) & (primary <= add(1))) | (ongoing & (end > last)),
        "is_week": sure((primary >= first) & (primary <= add(7))),
        "is_weekend": sure((primary >= weekend) & (primary <= weekend_end)) | (ongoing & (end >= weekend)),
        "is_month": sure((primary >= first) & (primary <= month_end)),
    }


def _name(names: list[str], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), k)


def short_date(ts: Column) -> Column:
    """17 jul"""
    return F.concat_ws(" ", F.dayofmonth(ts).cast("string"), _name(dims.MONTHS_SHORT_ES, F.month(ts) - 1))


def long_date(ts: Column) -> Column:
    """viernes, 17 de julio de 2026"""
    return F.concat(_name(dims.WEEKDAYS_ES, F.weekday(ts)), F.lit(", "), F.dayofmonth(ts).cast("string"), F.lit(" de "), _name(dims.MONTHS_ES, F.month(ts) - 1), F.lit(" de "), F.year(ts).cast("string"))


def relative_day(ts: Column, now: Column) -> Column:
    """Hoy, Mañana, or vie, 17 jul (with the year if it is another)."""
    gap = F.datediff(ts.cast("date"), now.cast("date"))
    day = F.concat(F.substring(_name(dims.WEEKDAYS_ES, F.weekday(ts)), 1, 3), F.lit(", "), short_date(ts))
    return F.when(ts.isNull(), "Fecha por confirmar").when(gap == 0, "Hoy").when(gap == 1, "Mañana").when(F.year(ts) == F.year(now), day).otherwise(F.concat(day, F.lit(" "), F.year(ts).cast("string")))


def schedule_label(resolved: Column, mode: Column | str, now: Column) -> Column:
    """D39. What a card says: under way until when, whenever, or day and time."""
    end = resolved["end"]
    far = F.timestamp_diff("SECOND", now, end) > dims.FAR_DAYS * 86400
    until = F.when(end.isNotNull() & ~far, F.concat(F.lit(" · hasta "), short_date(end))).otherwise("")
    clock = F.when(has_real_time(resolved["time_source"]) | (F.regexp_extract(resolved["time_source"], r"T(\d{2}:\d{2})", 1) == "23:59"), F.date_format(parse_temporal(resolved["time_source"])["ts"], "HH:mm"))
    dated = F.concat_ws(" · ", relative_day(resolved["primary"], now), clock)
    undated = F.when(col(mode) == "sin_fecha", "Cuando quieras").otherwise("Fecha por confirmar")
    return F.when(resolved["ongoing"], F.concat(F.lit("En curso"), until)).when(resolved["primary"].isNull(), undated).otherwise(dated)


def calendar_url(title: Column | str, at: Column, place: Column | str) -> Column:
    """D40. A calendar entry of two hours; null without a date."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    span = F.concat(stamp(at), F.lit("/"), stamp(F.timestamp_add("HOUR", F.lit(2), at)))
    return F.concat(F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE&text="), F.url_encode(col(title)), F.lit("&dates="), span, F.lit("&ctz=Europe%2FMadrid&location="), F.url_encode(F.coalesce(col(place), F.lit(""))))
