"""The column functions as SQL functions: register(spark), then they can be called in spark.sql(...).

Each is defined once, as a column; what SQL gets is that column's own expression over the function's arguments, so both run as
the same JVM expressions, and the optimiser sees through the call.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plazaflow.functions import dates, markup, numbers, text, urls

#: A string literal, or an operator that stands as a function's name.
_PARTS = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(<=>|<=|>=|!=|<>|=|<|>|-|\+|\*|/|%|!|and|or|in|not)(?=\()", re.S)
_UNIT = re.compile(r"\b(timestampadd|timestampdiff)\('(\w+)'")

#: Scalar functions: SQL types of the arguments by name, and the column that they make.
SCALARS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "clean_text": ({"t": "STRING"}, text.clean_text),
    "slugify": ({"t": "STRING"}, text.slugify),
    "normalize_text": ({"t": "STRING"}, text.normalize_text),
    "fold_search": ({"t": "STRING"}, text.fold_search),
    "sanitize_text": ({"t": "STRING"}, text.sanitize_text),
    "smart_title": ({"t": "STRING"}, text.smart_title),
    "strip_html": ({"t": "STRING"}, text.strip_html),
    "parse_temporal": ({"t": "STRING"}, dates.parse_temporal),
    "normalized_time": ({"t": "STRING"}, dates.normalized),
    "normal_url": ({"u": "STRING"}, urls.normalize_url),
    "distance_km": ({"a": "DOUBLE", "b": "DOUBLE", "c": "DOUBLE", "d": "DOUBLE"}, numbers.distance_km),
    "page_title": ({"html": "STRING"}, markup.page_title),
}
#: Table functions: arguments, the array of rows, and the columns' types.
TABLES: dict[str, tuple[dict[str, str], Callable[..., Column], dict[str, str]]] = {
    "page_links": ({"html": "STRING"}, markup.links, {"href": "STRING", "text": "STRING"}),
    "page_headings": ({"html": "STRING"}, lambda html: F.transform(markup.headings(html), lambda h: F.struct(h.alias("heading"))), {"heading": "STRING"}),
    "page_objects": ({"html": "STRING"}, lambda html: F.transform(markup.ld_objects(html), lambda o: F.struct(o.alias("json"))), {"json": "STRING"}),
}


def expression(column: Column) -> str:
    """A column as SQL that parses: operators in it stand as functions' names, in backticks."""
    plain = _UNIT.sub(r"\1(\2", column._jc.node().sql())
    return _PARTS.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], plain)


def register(spark: SparkSession) -> None:
    """Defines all of them as temporary functions of the session. Table functions give a row for each item, with its place."""
    signature = lambda of: ", ".join(f"{n} {t}" for n, t in of.items())
    for name, (given, make) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature(given)}) RETURN {expression(make(*map(F.col, given)))}")
    for name, (given, make, columns) in TABLES.items():
        rows = expression(make(*map(F.col, given)))
        picked = ", ".join(f"x.{c}" for c in columns)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature(given)}) RETURNS TABLE({signature({'pos': 'INT'} | columns)}) RETURN SELECT pos, {picked} FROM (SELECT posexplode({rows}) AS (pos, x))")
