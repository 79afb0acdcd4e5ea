"""SQL for the operators over whole datasets: resampling, sharding, the manifest."""

#: The 256 entries of CRC32's table, as a list t.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def crc(x: str) -> str:
    """CRC32 of an SQL text, with t at hand."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex({x}), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _encoded(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


ORACLE_SQL: dict[str, str] = {}


ORACLE_SQL["op11_importance"] = rf"""WITH k AS ({CRC_TABLE}),
r AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT row, unnest(words) AS w FROM r),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
c AS (SELECT w, {crc('w')} % 10000 AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b), k),
s AS (SELECT bucket, count(*) AS s FROM d JOIN c USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM d) AS big_s, (SELECT count(*) FROM b) AS big_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * CAST(big_s + 10000 AS DOUBLE) / ((s + 1) * CAST(big_t + 10000 AS DOUBLE)))) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN c USING (w) JOIN g USING (bucket) GROUP BY row),
h AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM r LEFT JOIN w USING (row)),
f AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM p"""

ORACLE_SQL["op12_sharding"] = f"""WITH RECURSIVE k AS ({CRC_TABLE}),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc("coalesce(text, '')")} AS text_crc32, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS INT) AS cell FROM documents, k),
s AS (SELECT cell // 16 AS slot, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY 1),
m AS (SELECT slot, slot % 16 AS shard, bytes, sum(bytes) OVER w AS upto, row_number() OVER w AS nth, ceil((SELECT sum(bytes) FROM s) / 16) AS share FROM s WINDOW w AS (PARTITION BY slot % 16 ORDER BY bytes DESC, slot)),
o AS (SELECT slot, bytes, row_number() OVER (ORDER BY bytes DESC, slot) AS i FROM m WHERE upto > share AND nth > 1),
h AS (SELECT list(coalesce(held, 0) ORDER BY shard) AS loads FROM (SELECT unnest(range(16)) AS shard) LEFT JOIN (SELECT shard, CAST(sum(bytes) AS BIGINT) AS held FROM m WHERE upto <= share OR nth = 1 GROUP BY shard) USING (shard)),
f(i, slot, target, loads) AS (SELECT CAST(0 AS BIGINT), -1, CAST(-1 AS BIGINT), loads FROM h UNION ALL
  SELECT o.i, o.slot, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT), list_transform(loads, lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.bytes ELSE 0 END) FROM f JOIN o ON o.i = f.i + 1),
a AS (SELECT d.*, coalesce(f.target, d.cell // 16 % 16) AS shard FROM d LEFT JOIN f ON f.slot = d.cell // 16)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM a"""
HEAD = " || ".join(map(_encoded, ("doc_id", "source", "lang", "n_chars")))

ORACLE_SQL["op13_merkle"] = f"""WITH RECURSIVE k AS ({CRC_TABLE}),
a AS (SELECT doc_id, source, sha256({HEAD} || {_encoded('text')}) AS leaf, CASE WHEN {crc("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN sha256({HEAD} || {_encoded("replace(text, chr(10), '')")}) END AS bad FROM documents, k),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM a),
t(source, level, i, n, h) AS (SELECT source, 0, i, n, leaf FROM l UNION ALL SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, level, i // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM t WHERE n = 1),
u(level, i, n, h) AS (SELECT 0, j, m, subroot FROM s UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3, n),
rt AS (SELECT source, level, i // 3 AS p, string_agg(h, '' ORDER BY i) AS run FROM t WHERE n > 1 GROUP BY ALL), ru AS (SELECT level, i // 3 AS p, string_agg(h, '' ORDER BY i) AS run FROM u WHERE n > 1 GROUP BY ALL),
pu AS (SELECT source, list({{f: '', l: substr(run, 1, 64 * CAST(node % 3 AS INT)), r: substr(run, 64 * CAST(node % 3 AS INT) + 65)}} ORDER BY level) AS path FROM (SELECT source, level, j // CAST(pow(3, level) AS BIGINT) AS node FROM s, (SELECT DISTINCT level FROM ru)) JOIN ru USING (level) WHERE p = node // 3 GROUP BY source),
pl AS (SELECT x, list({{f: '', l: substr(run, 1, 64 * CAST(node % 3 AS INT)), r: substr(run, 64 * CAST(node % 3 AS INT) + 65)}} ORDER BY level) AS path FROM (SELECT source || '/' || l.i AS x, source, level, i // CAST(pow(3, level) AS BIGINT) AS node FROM l, (SELECT DISTINCT level FROM rt)) JOIN rt USING (source, level) WHERE p = node // 3 GROUP BY x),
e AS (SELECT l.*, subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(pl.path, []), coalesce(pu.path, [])) AS path FROM l JOIN s USING (source) LEFT JOIN pu USING (source) LEFT JOIN pl ON pl.x = l.source || '/' || l.i),
g AS (SELECT *, list_reduce(list_prepend({{f: coalesce(bad, leaf), l: '', r: ''}}, path), lambda y, z: {{f: sha256(z.l || y.f || z.r), l: '', r: ''}}).f AS folded FROM e)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda z: z.l || z.r), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM g"""
