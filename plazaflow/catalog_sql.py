"""Queries in Spark SQL, over the SQL functions: the same rows as their namesakes of columns, and beside the same DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plazaflow.functions.sql import register
from plazaflow.plans.fixtures import raw_plans, table
from plazaflow.register import ORACLE_SQL, query

#: By name: the query of columns that gives the same rows, the table, and the statement over it.
STATEMENTS = {
    "sql_clean_text": ("clean_text", "documents", "SELECT doc_id, clean_text(text) AS clean FROM {t}"),
    "sql_fold_search": ("fold_search", "documents", "SELECT doc_id, fold_search(text) AS folded FROM {t}"),
    "sql_slugify": ("slugify", "raw_plans", "SELECT _ord AS doc_id, slugify(titulo) AS slug FROM {t}"),
    "sql_parse_temporal": ("parse_temporal", "events", "SELECT event_id, x.iso, CAST(x.d AS STRING) AS day, x.has_time FROM (SELECT event_id, parse_temporal(date_format(ts, 'yyyy-MM-dd HH:mm:ss')) AS x FROM {t})"),
    "sql_page_links": ("page_links", "pages", "SELECT page_id, l.pos, l.href, l.text FROM {t}, LATERAL page_links(html) AS l"),
    "sql_page_headings": ("page_headings", "pages", "SELECT page_id, h.heading, page_title(html) AS title FROM {t}, LATERAL page_headings(html) AS h WHERE h.pos = 0"),
}


def _statement(name: str, source: str, statement: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark)
        rows = raw_plans(spark, d) if source == "raw_plans" else table(spark, d, source)
        return spark.sql(statement, t=rows)

    run.__name__ = name
    run.__doc__ = "SQL functions (2.14)."
    return run


for _name, (_like, _source, _text) in STATEMENTS.items():
    query(ORACLE_SQL[_like])(_statement(_name, _source, _text))
