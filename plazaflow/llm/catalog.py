"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plazaflow.llm import bpe, dataset_sql, decontaminate, embeddings, importance, merkle, pages, quality, secrets, sentences, sharding, simhash, substrings, toxicity
from plazaflow.llm.common import shared_folder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")



def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), digest=True)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), bpe.shipped(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, digest=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup(table(spark, sf_dir, "documents"), digest=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_quality, op3_embedding_dedup, op4_decontamination, op5_suffix_dedup, op6_html_extraction, op7_byte_bpe, op8_secret_scan, op9_sentence_dedup, op10_simhash, op11_importance, op12_sharding, op13_merkle)
}

#: SQL for those that SQL can express: links and reach, 50-byte strings, blocks of these pages, spans of sentences.
ORACLE_SQL: dict[str, str] = dataset_sql.ORACLE_SQL | {
    "op3_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, reach.r FROM reach JOIN pairs p ON p.a = reach.a),
c AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op5_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) // 2 - 48 AS BIGINT))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
l AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM l),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS p FROM r),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * p - 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substr(h, 2 * last - 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op6_html_extraction": r"""WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM b""",
    "op9_sentence_dedup": r"""WITH p AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?]\s+|\s*\n\s*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
q AS (SELECT *, list_transform(s, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS t FROM p), u AS (SELECT *, list_transform(t, lambda x: len(string_split(x, ' '))) AS n FROM q),
e AS (SELECT doc_id, t, n, unnest(range(1, len(t) + 1)) AS i FROM u),
j AS (SELECT doc_id, t, i, list_min(list_filter(range(i + 1, least(i + 13, len(t) + 1)), lambda k: list_sum(n[i:k]) >= 12)) AS j FROM e UNION SELECT doc_id, t, i, i FROM e WHERE n[i] >= 30
  UNION SELECT doc_id, t, list_max(list_filter(range(greatest(i - 12, 1), i), lambda k: list_sum(n[k:i]) >= 12)), i FROM e),
x AS (SELECT doc_id, i, j, array_to_string(t[i:j], ' ') AS span FROM j WHERE i IS NOT NULL AND j IS NOT NULL),
o AS (SELECT span, min(doc_id * 1000000 + i) AS origin FROM x GROUP BY span HAVING count(*) > 1),
m AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS k FROM x JOIN o USING (span) WHERE doc_id * 1000000 + i <> origin),
z AS (SELECT doc_id, list(k ORDER BY k) AS gone FROM m GROUP BY doc_id),
y AS (SELECT doc_id, s, coalesce(gone, []) AS gone FROM q LEFT JOIN z USING (doc_id)),
v AS (SELECT doc_id, s, gone, array_to_string(list_filter(s, lambda x, i: NOT list_contains(gone, i)), '') AS kept FROM y)
SELECT doc_id, strlen(array_to_string(s, '')) AS n_bytes, strlen(array_to_string(s, '')) - strlen(kept) AS n_removed, CAST(len(list_filter(gone, lambda k: NOT list_contains(gone, k - 1))) AS BIGINT) AS n_spans,
  CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(gone) AS BIGINT) AS n_removed_sentences, sha256(kept) AS kept_sha256 FROM v""",
}
