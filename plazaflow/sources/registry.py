"""Source adapters: saved payloads in, raw records out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaflow.operators.normalize import with_raw_columns

ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
#: How a source's payload is read: "json" (one document a file), or "html" (rows of url, html).
KINDS: dict[str, str] = {}
SCHEMAS: dict[str, str] = {}


def adapter(name: str, kind: str, schema: str = "url string, html string"):
    def add(f: Callable[[DataFrame], DataFrame]):
        ADAPTERS[name], KINDS[name], SCHEMAS[name] = f, kind, schema
        return f

    return add


#: Sources whose JSON stands in saved pages (url, html, category): what makes their payload of them.
PAGE_STATES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def page_state(name: str):
    def add(f: Callable[[DataFrame], DataFrame]):
        PAGE_STATES[name] = f
        return f

    return add


def read_payload(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A source's saved payload with its fixed schema: JSON documents that may span lines, or a landing table of pages.
    Records that can't be read come out as nulls and give no plan. A landing table of pages (a path that ends in .parquet or
    /pages) of a source whose JSON stands in its pages is read from there."""
    if KINDS[name] == "json" and name in PAGE_STATES and path.rstrip("/").endswith((".parquet", "/pages")):
        return PAGE_STATES[name](spark.read.schema("url string, html string, category string").parquet(path))
    if KINDS[name] == "json":
        return spark.read.schema(SCHEMAS[name]).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def extract(payload: DataFrame, name: str) -> DataFrame:
    """Raw records of a source's payload; _ord follows the payload's order."""
    payload = PAGE_STATES[name](payload) if name in PAGE_STATES and "html" in payload.columns else payload
    out = ADAPTERS[name](payload)
    out = out if "_ord" in out.columns else out.withColumn("_ord", F.monotonically_increasing_id())
    return with_raw_columns(out.withColumn("fuente", F.lit(name)))


def records(df: DataFrame, **columns: Column) -> DataFrame:
    """The given columns of each row, beside its place if it has one."""
    return df.select(*(c.alias(n) for n, c in columns.items()), *(["_ord"] if "_ord" in df.columns else []))


def exploded(payload: DataFrame, items: str | Column, name: str = "x") -> DataFrame:
    """A row for each item, with its place."""
    return payload.select("*", F.posexplode(items).alias("_ord", name))


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """C23, C25. A feed of JSON lines; a row that can't be read is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """C24. The cache of coordinates."""
    return spark.read.schema("cache_key string, lat double, lon double, query string").json(path)
