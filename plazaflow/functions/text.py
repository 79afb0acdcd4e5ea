"""Text functions on columns."""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazaflow.functions import arrays
from plazaflow.plans import dims

#: Letters with marks and what is left of them without; letters without a decomposition (ß, ø, æ) have no entry.
MARKED = "áàâäãåāçćčéèêëēęėíìîïīñńóòôöõōúùûüūýÿźžżśš"
PLAIN = "".join(unicodedata.normalize("NFD", ch)[0] for ch in MARKED)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's variable stands for it, so that plans stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_marks(c: Column | str) -> Column:
    """Letters without their accents, in either case."""
    return F.translate(col(c), MARKED + MARKED.upper(), PLAIN + PLAIN.upper())


#: White space but for the plain space; runs of white space that aren't one plain space, which is what it becomes. Letters,
#: digits and signs of ASCII are turned away at once.
ODD = r"\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RUNS = rf"(?![!-~])(?:[{ODD}][ {ODD}]*| [ {ODD}]+)"


def clean_text(c: Column | str) -> Column:
    """T1. Null becomes empty; any run of white space, no-break spaces too, one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), RUNS, " "))


def sanitize_text(c: Column | str) -> Column:
    """T6. clean_text, null if empty."""
    return let(clean_text(c), lambda v: F.when(v != "", v))


def ascii_only(c: Column | str) -> Column:
    return F.regexp_replace(without_marks(c), r"[^\x00-\x7F]", "")


def slugify(c: Column | str, empty: str = dims.EMPTY_SLUG) -> Column:
    """T2. Lower-case ASCII words joined by hyphens; `empty` if nothing is left."""
    slug = F.regexp_replace(F.lower(ascii_only(F.coalesce(col(c), F.lit("")))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit(empty))


def normalize_text(c: Column | str) -> Column:
    """T3. Clean, ASCII only, lower case."""
    return F.lower(ascii_only(clean_text(c)))


def fold_search(c: Column | str) -> Column:
    """T4. Lower case without accents; ß and ø stay."""
    return without_marks(F.lower(col(c)))


def search_blob(*parts: Column) -> Column:
    """T5. Parts (strings or arrays of strings) that aren't empty, joined and folded."""
    return fold_search(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


#: The commonest named character references, looked up first; the others are HTML's own table.
COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "©", "middot": "·", "hellip": "…"}
BUCKETS = 1024


def _buckets() -> str:
    """HTML's own table, a map a bucket of names: a map's keys are looked through one by one, so maps are kept short."""
    maps: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, value in html5.items():
        if name.endswith(";"):
            maps[zlib.crc32(name[:-1].encode()) % BUCKETS][name[:-1]] = value
    return json.dumps(maps)


NAMED = _buckets()


def _decoded(text: Column) -> Column:
    table = F.from_json(F.lit(NAMED), "array<map<string,string>>")
    pieces = F.split(text, "&")

    def char(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
        digits, hexa = F.regexp_extract(piece, r"^#(\d{1,7});", 1), F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexa != "", F.conv(hexa, 16, 10).cast("int"))
        common = reduce(lambda a, kv: a.when(name == kv[0], kv[1]), COMMON.items(), F.when(F.lit(False), ""))
        numbered = F.when((code > 0) & (code < 0x110000), F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32"))
        return F.when(F.startswith(piece, F.lit("#")), numbered).when(name != "", F.coalesce(common, F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % BUCKETS).cast("int")), name)))

    decoded = lambda piece: let(char(piece), lambda c: F.coalesce(F.concat(c, F.regexp_replace(piece, "^[^;]*;", "")), F.concat(F.lit("&"), piece)))
    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))


def unescape(c: Column | str) -> Column:
    """Character references decoded once: HTML's names, decimal and hexadecimal numbers; all end in a semicolon. A text
    without an ampersand and a semicolon is taken as it is."""
    return let(col(c), lambda text: F.when(F.contains(text, F.lit("&")) & F.contains(text, F.lit(";")), _decoded(text)).otherwise(text))


def web_text(c: Column | str) -> Column:
    """T7. Character references decoded twice, then clean."""
    return clean_text(unescape(unescape(F.coalesce(col(c), F.lit("")))))


def cap_text(c: Column | str, limit: int) -> Column:
    """T8. Web text; longer than `limit` it is cut before the word that crosses limit - 1 and ends in an ellipsis."""
    text = web_text(c)
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), " [^ ]*$", ""), F.lit("…"))
    return F.nullif(F.when(F.length(text) <= limit, text).otherwise(cut), F.lit(""))


def smart_title(c: Column | str) -> Column:
    """T9. A title of more than 12 characters that is all capitals gets sentence case, anew after : . ¡ ! ¿ ? A letter that rises
    is the title's own capital again: ß there comes from ẞ only, and doesn't become SS."""
    title = col(c)
    low = F.lower(title)
    state = F.struct(F.lit("").alias("text"), F.lit(True).alias("next"))

    def step(s: Column, ch: Column) -> Column:
        letter = ch.rlike(r"\p{L}")
        rise = s["next"] & letter
        return F.struct(
            F.concat(s["text"], F.when(rise, F.upper(F.replace(ch, F.lit("ß"), F.lit("ẞ")))).otherwise(ch)).alias("text"),
            F.when(rise, F.lit(False)).when(ch.isin(*":.¡!¿?"), F.lit(True)).otherwise(s["next"]).alias("next"),
        )

    sentence = F.aggregate(F.split(low, ""), state, step)["text"]
    return F.when((F.length(title) > 12) & (F.upper(title) == title) & (low != title), sentence).otherwise(title)


def unless_title(text: Column, title: Column) -> Column:
    """T10. Null where the text only repeats the title."""
    same = F.regexp_replace(F.lower(text), r"[.…]+$", "") == F.regexp_replace(F.lower(title), r"\.+$", "")
    return F.when(F.coalesce(same & (title != ""), F.lit(False)), F.lit(None)).otherwise(text)


def first_filled(*values: Column | str) -> Column:
    """T35. The first value that isn't empty once clean."""
    return F.coalesce(*(sanitize_text(v) for v in values))


def summary(title: Column | str, subtitle: Column | str, description: Column | str, content: Column | str) -> Column:
    """T11. The first of subtitle, description, content and title that isn't empty: 320 characters."""
    return F.substring(F.coalesce(first_filled(subtitle, description, content, title), F.lit("")), 1, 320)


def strip_html(c: Column | str) -> Column:
    """T13. Text of an HTML piece: scripts, styles, comments and tags go, line breaks and references are decoded."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")
    return clean_text(unescape(text))


def strip_markdown(c: Column | str) -> Column:
    """T14. Images go, links keep their words, emphasis, code marks and marks at a line's start go."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return clean_text(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*[#*-]+\s*", ""), r"[*_`]+", ""))


def slice_between(c: Column | str, start: str, end: str | None = None) -> Column:
    """T15. What stands after the first `start`, up to the first `end` after it."""
    text = col(c)
    after = F.when(F.contains(text, F.lit(start)), F.substring_index(F.regexp_replace(text, f"(?s)^.*?{_quoted(start)}", ""), end, 1) if end else F.regexp_replace(text, f"(?s)^.*?{_quoted(start)}", ""))
    return sanitize_text(after)


def _quoted(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in text)


def meta_fields(c: Column | str, markers: dict[str, str]) -> Column:
    """T16. A struct of what follows each marker up to the next one present. markers: {field: marker}, in order."""
    stops = "|".join(map(_quoted, markers.values()))
    return F.struct(*(sanitize_text(F.regexp_extract(col(c), f"(?s){_quoted(m)}(.*?)(?:{stops}|$)", 1)).alias(k) for k, m in markers.items()))


def trim_at(c: Column | str, markers: list[str], leading: list[str] = ()) -> Column:
    """T17. Text before the first of the markers, without the leading labels."""
    text = F.split(col(c), "|".join(map(_quoted, markers)), 2)[0]
    return clean_text(F.regexp_replace(clean_text(text), f"^(?:(?:{'|'.join(map(_quoted, leading))})\\s*)+", "") if leading else text)


def before_pattern(c: Column | str, pattern: str, strip: str = " .") -> Column:
    """T18. Text before the first match, without the given characters at its ends."""
    return F.nullif(F.btrim(clean_text(F.split(col(c), pattern, 2)[0]), F.lit(strip)), F.lit(""))


def duration_text(c: Column | str) -> Column:
    """T19. What follows "Duración:" up to a full stop."""
    return F.nullif(F.trim(F.regexp_extract(col(c), r"(?iU)duraci[oó]n\s*:\s*([^.]+)", 1)), F.lit(""))


def camel_words(c: Column | str, default: str = "Cultura") -> Column:
    """T20. The last segment of a path with a space before each capital; `default` without a path."""
    last = F.element_at(F.split(F.regexp_replace(col(c), "/+$", ""), "/"), -1)
    spaced = F.regexp_replace(last, r"(?<=[a-z])(?=[A-Z])", " ")
    return F.coalesce(F.when(F.contains(col(c), F.lit("/")), F.nullif(spaced, F.lit(""))), F.lit(default))


def inline_location(c: Column | str, stops: list[str]) -> Column:
    """T21. Text before the first pictograph or stop word, without punctuation at its ends."""
    return F.nullif(F.btrim(clean_text(F.split(clean_text(c), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]|" + "|".join(map(_quoted, stops)), 2)[0]), F.lit(" .,;:-")), F.lit(""))


def lines(c: Column | str) -> Column:
    """T22. Clean lines that aren't empty; of equal neighbours only the first."""
    every = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\n"), clean_text), lambda x: x != "")
    return let(every, lambda full: F.filter(full, lambda x, i: (i == 0) | (x != F.get(full, i - 1))))


def section(array: Column | str, heading: str, stops: list[str]) -> Column:
    """T23. Lines after a heading up to one of the stops."""
    at = F.array_position(F.transform(col(array), F.lower), heading.lower())
    rest = F.slice(col(array), (at + 1).cast("int"), F.greatest(F.size(col(array)) - at.cast("int"), F.lit(0)))
    low = [s.lower() for s in stops]
    end = F.array_min(F.filter(F.transform(rest, lambda x, i: F.when(F.lower(x).isin(*low), i)), lambda i: i.isNotNull()))
    return F.when(at > 0, F.slice(rest, 1, F.coalesce(end, F.size(rest)))).otherwise(F.array().cast("array<string>"))


def between_lines(array: Column | str, title: Column, stops: list[str]) -> Column:
    """T24. Lines after the one that equals the title (all lines, without one), up to the first that starts with a stop."""
    lines_ = col(array)
    at = F.coalesce(F.array_position(lines_, title), F.lit(0)).cast("int")
    rest = F.slice(lines_, at + 1, F.greatest(F.size(lines_) - at, F.lit(0)))
    stop = reduce(lambda a, b: a | b, [F.startswith(F.lit(""), F.lit("x"))])
    ends = F.transform(rest, lambda x, i: F.when(reduce(lambda a, b: a | b, [F.startswith(F.lower(x), F.lit(s.lower())) for s in stops], stop), i))
    end = F.array_min(F.filter(ends, lambda i: i.isNotNull()))
    return F.slice(rest, 1, F.coalesce(end, F.size(rest)))


def collapse_paragraphs(array: Column | str) -> Column:
    """T25. Paragraphs in order; one that an earlier one contains goes, a longer later one takes the place of one that it contains."""

    def step(acc: Column, x: Column) -> Column:
        inside = F.exists(acc, lambda y: F.contains(F.lower(y), F.lower(x)))
        holds = F.exists(acc, lambda y: F.contains(F.lower(x), F.lower(y)))
        swapped = arrays.distinct_text(F.transform(acc, lambda y: F.when(F.contains(F.lower(x), F.lower(y)), x).otherwise(y)))
        return F.when(inside, acc).when(holds, swapped).otherwise(F.concat(acc, F.array(x)))

    full = F.filter(F.transform(col(array), clean_text), lambda x: x != "")
    return F.aggregate(full, F.array().cast("array<string>"), step)


def paragraphs_text(array: Column | str, least: int = 30) -> Column:
    """T26. Paragraphs of enough characters that are no address, each once, an empty line between."""
    kept = F.filter(F.transform(col(array), clean_text), lambda x: (F.length(x) >= least) & ~F.startswith(F.lower(x), F.lit("http")))
    return F.nullif(F.array_join(arrays.distinct_text(kept), "\n\n"), F.lit(""))


def location_label(place: Column | str, address: Column | str) -> Column:
    """T27. Place · address, or the one that there is."""
    p, a = F.nullif(col(place), F.lit("")), F.nullif(col(address), F.lit(""))
    return F.when(p.isNotNull() & a.isNotNull() & (p != a), F.concat_ws(" · ", p, a)).otherwise(F.coalesce(p, a, F.lit("Ubicación por confirmar")))


def euro(price: Column) -> Column:
    """A price as Spanish text: 1234.5 is 1.234,50 €; thousands are set apart from five digits on; whole euros have no cents."""
    whole = price == F.floor(price)
    text = F.when(whole, F.format_number(price, 0)).otherwise(F.format_number(price, 2))
    text = F.when(F.abs(price) < 10000, F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
    return F.concat(F.translate(text, ",.", ".,"), F.lit("\u00a0€"))


def price_label(price: Column | str, free: Column | str, source: Column | str) -> Column:
    """T28. Gratis, or the price, after "desde" where the source publishes its lowest one; null without a price."""
    p = col(price).cast("double")
    label = F.when(col(source).isin(*dims.FROM_PRICE_SOURCES), F.concat(F.lit("desde "), euro(p))).otherwise(euro(p))
    return F.when(F.coalesce(col(free), F.lit(False)) | F.coalesce(p == 0, F.lit(False)), F.lit("Gratis")).when(p.isNotNull(), label)


def source_label(source: Column | str) -> Column:
    """T29. The source's name for readers."""
    table = F.create_map(*(F.lit(x) for kv in dims.SOURCE_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(col(source), F.lit(""))), F.nullif(col(source), F.lit("")), F.lit("Fuente"))


def place_token(c: Column | str) -> Column:
    """T30. Lower case, clean, ASCII, without blanks, full stops and commas at its ends."""
    return F.btrim(ascii_only(clean_text(F.lower(col(c)))), F.lit(" .,"))


def looks_like_content(line: Column, prefixes: list[str], least: int = 70) -> Column:
    """T31. A line of prose: long enough, or begun by one of the prefixes, and no time, date or price."""
    short = line.rlike(r"^\d{1,2}[:.]\d{2}") | line.rlike(r"\d{1,2}/\d{1,2}/\d{4}") | F.contains(line, F.lit("€"))
    starts = reduce(lambda a, b: a | b, [F.startswith(F.lower(line), F.lit(p)) for p in prefixes], F.lit(False))
    return ~short & (starts | (F.length(line) >= least))


def string_hash(c: Column | str) -> Column:
    """T32. The 31-polynomial hash of a text's UTF-16 units below 65536, as an unsigned 32-bit number of its magnitude."""
    total = F.aggregate(F.split(col(c), ""), F.lit(0).cast("bigint"), lambda h, ch: ((h * 31 + F.ascii(ch)) % F.lit(4294967296)))
    signed = F.when(total >= 2147483648, total - 4294967296).otherwise(total)
    return F.abs(signed)


def updated_label(updated: Column, now: Column) -> Column:
    """T33. How long ago: minutes below an hour count as moments, hours below a day, then days."""
    hours = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(updated.cast("timestamp"))) / 3600)
    days = F.floor(hours / 24)
    return F.when(updated.isNull(), F.lit(None)).when(hours < 1, F.lit("Actualizado hace un momento")).when(hours < 24, F.concat(F.lit("Actualizado hace "), hours.cast("string"), F.lit(" h"))).when(days == 1, F.lit("Actualizado ayer")).otherwise(F.concat(F.lit("Actualizado hace "), days.cast("string"), F.lit(" días")))


def pick_title(headings: Column | str, listed: Column, ignored: list[str]) -> Column:
    """T34. The first heading that the listed title contains, else the first that isn't ignored, else the listed one."""
    h = F.filter(F.transform(col(headings), clean_text), lambda x: x != "")
    same = F.filter(h, lambda x: F.contains(F.lower(listed), F.lower(x)))
    other = F.filter(h, lambda x: ~F.lower(x).isin(*[i.lower() for i in ignored]))
    return F.coalesce(F.get(same, F.lit(0)), F.get(other, F.lit(0)), listed)


def institution_name(c: Column | str) -> Column:
    """T36. Without a number in brackets at the end."""
    return F.nullif(F.regexp_replace(clean_text(c), r"\s*\(\d+\)\s*$", ""), F.lit(""))
