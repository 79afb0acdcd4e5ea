"""A bounded sample of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, text, label int) of at most `most` labelled ids that may be learned from, those with the least hash.

    Rows whose id or label is null are left out, as are ids held out (common.held_out); of an id labelled twice the
    higher label holds. Only the chosen ids, at most 16 bytes each, are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), "_label")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_label").alias("label"))
