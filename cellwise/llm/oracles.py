"""DuckDB SQL for the rows of operators that SQL can express."""

from __future__ import annotations

#: Fixed value: what separates words, as in the operator.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
    g AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS gram, least(len(w), 10) AS size FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
    windows AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM d, (SELECT DISTINCT size FROM g), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size),
    hits AS (SELECT r, i, size, item FROM windows JOIN g USING (gram, size)),
    words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, i, size FROM hits), LATERAL (SELECT unnest(range(i, i + size)) AS p) GROUP BY r),
    items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def _shard(shards: int) -> str:
    """The shard of `key`, of equal weights: the largest score, and of equal ones the lower shard."""
    return f"CAST(-list_max([{', '.join(_scored(s) for s in range(shards))}]).s AS INTEGER)"


def _scored(shard: int) -> str:
    return f"{{h: CAST('0x' || substr(md5(key || ':{shard}'), 1, 13) AS BIGINT), s: {-shard}}}"


#: The CRC's table by its polynomial, then the checksum byte after byte.
_CRC = """
    bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)),
    t0 AS (SELECT i, list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM bits),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM t0)"""

SHARDING = f"""
    WITH {_CRC.strip()},
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, encode(coalesce(text, '')) AS body FROM documents),
    h AS (SELECT r, doc_id, key, octet_length(body) + 8 AS size, list_transform(range(octet_length(body)), lambda i: CAST('0x' || substr(hex(body[i + 1:i + 1]), 1, 2) AS BIGINT)) AS b FROM d),
    s AS (SELECT r, doc_id, key, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS text_crc32, {_shard(24)} AS shard, {_shard(25)} AS grown_shard FROM h, crc_table)
    SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, grown_shard,
        row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(key), 1, 13) AS BIGINT), text_crc32, doc_id NULLS LAST, size) - 1 AS slot FROM s"""
