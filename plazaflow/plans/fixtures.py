"""Agenda records made from the general tables, in DataFrames and in SQL, as of a fixed day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaflow.operators.enrich import classify
from plazaflow.operators.normalize import normalize_plans
from plazaflow.plans import dims
from plazaflow.plans.storage import kept

TODAY_TEXT, NOW_TEXT, SCRAPED = "2024-01-15", "2024-01-15 12:00:00", "2024-01-15T04:15:00Z"
SOURCES = list(dims.SOURCE_PRIORITY)
CATEGORIES = list(dict.fromkeys(c for _, c in dims.RULES))


def today() -> Column:
    return F.lit(TODAY_TEXT).cast("date")


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by a key if it comes from fewer partitions than there are cores: one small file would be one task."""
    return df.repartition(key) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


#: Rows of a narrow table that one task works on, where a row of few bytes is much work.
ROWS = 50_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by a key into tasks of about ROWS rows, and one a core at least: files of narrow rows are split by their
    bytes, which are few, so that a task would have all rows. Conditions on what is made of the rows would otherwise be looked at
    before they are dealt out, and with them whatever they are made of: none passes one that isn't deterministic."""
    most = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df if df.rdd.getNumPartitions() >= most else df.repartition(most, key).where(F.monotonically_increasing_id() >= 0)


def raw_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw plan records: one a document, with page, supplier and part by remainders of its id."""
    t = lambda n: table(spark, sf_dir, n)
    size = {n: t(n).agg(F.count(F.lit(1)).alias(f"_{n}")) for n in ("pages", "supplier", "part")}
    docs = spread(t("documents").select("doc_id", "text"), "doc_id")
    for one in size.values():
        docs = docs.crossJoin(F.broadcast(one))  # one row
    k = F.col("doc_id")
    docs = docs.withColumns({"_p": k % F.col("_pages"), "_s": k % F.col("_supplier"), "_t": k % F.col("_part")})
    joined = (
        docs.join(t("pages").select(F.col("page_id").alias("_p"), "url"), "_p", "left")
        .join(t("supplier").select(F.col("s_suppkey").alias("_s"), F.col("s_name").alias("lugar")), "_s", "left")
        .join(t("part").select(F.col("p_partkey").alias("_t"), "p_retailprice"), "_t", "left")
    )
    start = F.date_add(today(), (k % 120 - 30).cast("int"))
    return joined.select(
        k.cast("string").alias("id"),
        F.trim(F.regexp_replace(F.regexp_extract("text", r"^[^.]*", 0), r"\s+", " ")).alias("titulo"),
        F.col("text").alias("descripcion"),
        F.when(k % 7 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).cast("string").alias("precio"),
        "lugar",
        (F.lit(dims.CENTER[0]) + (k % 41 - 20) * 0.005).cast("string").alias("latitud"),
        (F.lit(dims.CENTER[1]) + (k % 37 - 18) * 0.005).cast("string").alias("longitud"),
        start.cast("string").alias("fecha_inicio"),
        F.date_add(start, (k % 5).cast("int")).cast("string").alias("fecha_fin"),
        F.array(F.get(F.array(*map(F.lit, CATEGORIES)), (k % len(CATEGORIES)).cast("int"))).alias("categorias"),
        F.date_sub(today(), (k % 60).cast("int")).cast("string").alias("fecha_publicacion"),
        "url",
        F.get(F.array(*map(F.lit, SOURCES)), (k % len(SOURCES)).cast("int")).alias("fuente"),
        k.alias("_ord"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical plans of raw_plans(), all of them."""
    return normalize_plans(raw_plans(spark, sf_dir), today(), SCRAPED, keep_only_current=False)


_feeds: dict[tuple[str, str], DataFrame] = {}


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with their categories, without what only the archive keeps: published to the shared folder and read again, as
    the discovery queries run over a feed that is there. Published once an application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _feeds:
        _feeds[key] = kept(classify(plans(spark, sf_dir).drop("contenido", "metadata", "source_links")))
    return _feeds[key]


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: raw_plans() in SQL, with typed days and prices: rp.
SQL = f"""WITH n AS (SELECT (SELECT count(*) FROM pages) AS np, (SELECT count(*) FROM supplier) AS ns, (SELECT count(*) FROM part) AS nt),
rp AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, trim(regexp_replace(regexp_extract(d.text, '^[^.]*'), '\\s+', ' ', 'g')) AS titulo,
    d.text AS descripcion, CASE WHEN d.doc_id % 7 = 0 THEN 0.0 ELSE t.p_retailprice END AS precio, s.s_name AS lugar,
    {dims.CENTER[0]}::DOUBLE + (d.doc_id % 41 - 20) * 0.005::DOUBLE AS lat, {dims.CENTER[1]}::DOUBLE + (d.doc_id % 37 - 18) * 0.005::DOUBLE AS lon,
    DATE '{TODAY_TEXT}' + CAST(d.doc_id % 120 - 30 AS INTEGER) AS inicio, DATE '{TODAY_TEXT}' + CAST(d.doc_id % 120 - 30 + d.doc_id % 5 AS INTEGER) AS fin,
    {_listed(CATEGORIES)}[CAST(d.doc_id % {len(CATEGORIES)} AS INTEGER) + 1] AS categoria, DATE '{TODAY_TEXT}' - CAST(d.doc_id % 60 AS INTEGER) AS publicado,
    p.url, {_listed(SOURCES)}[CAST(d.doc_id % {len(SOURCES)} AS INTEGER) + 1] AS fuente
  FROM documents d, n LEFT JOIN pages p ON p.page_id = d.doc_id % n.np LEFT JOIN supplier s ON s.s_suppkey = d.doc_id % n.ns LEFT JOIN part t ON t.p_partkey = d.doc_id % n.nt
)
"""
