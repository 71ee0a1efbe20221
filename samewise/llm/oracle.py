"""DuckDB SQL of the corpus queries that SQL can express.

The others are compared with brute force, the library or held-out labels in tests/llm.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"
#: Rule: (count, what it is a share of, scale).
_RATIOS = {"word_length": ("word_chars", "n_words", 100), "symbols": ("n_symbols", "n_words", 10000), "dup_lines": ("n_dup_lines", "n_lines", 10000), "repeats": ("n_repeat_words", "n_words", 10000)}
_VALUES = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {scale} * {x} // greatest({of}, 1) AS v FROM c WHERE n_words > 0" for k, (x, of, scale) in _RATIOS.items())
_PIVOT = ", ".join(f"max({side}) FILTER (rule = '{k}') AS {k}_{side}" for k in _RATIOS for side in ("low", "high"))


def _fences(name: str, keys: str) -> str:
    by = f"{keys} rule"
    return f"""
{name}_m AS (SELECT {by}, bucket, sum(n) AS n FROM sk GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS below, sum(n) OVER (PARTITION BY {by}) AS total FROM {name}_m),
{name}_q AS (SELECT {by}, min(bucket) FILTER (100 * below >= 15 * total) AS q15, min(bucket) FILTER (2 * below >= total) AS q50, min(bucket) FILTER (100 * below >= 85 * total) AS q85, max(total)::BIGINT AS n FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {by}, n, q15 - 2 * (q50 - q15) AS low, q85 + 2 * (q85 - q50) AS high FROM {name}_q)"""


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}+')) AS w, generate_subscripts(regexp_extract_all(text, '{_WORD}+'), 1) AS pos FROM d),
g AS (SELECT doc_id, pos, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, pos, (e IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) > 1)::INT AS rep FROM g),
r AS (SELECT doc_id, sum(inside)::BIGINT AS n FROM (SELECT doc_id, max(rep) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM h) GROUP BY doc_id),
l AS (SELECT *, regexp_extract_all(text, '{_WORD}+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
c AS MATERIALIZED (SELECT l.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM l LEFT JOIN r ON l.doc_id = r.doc_id),
v AS ({_VALUES}),
s AS (SELECT *, greatest(length(bin(v)) - 6, 0)::INT AS low FROM v),
sk AS MATERIALIZED (SELECT lang, source, rule, (v >> low) << low AS bucket, count(*) AS n FROM s GROUP BY ALL),{_fences('own', 'lang, source,')},{_fences('lg', 'lang,')},{_fences('wh', '')},
l2 AS (SELECT lg.lang, lg.rule, (lg.n * lg.low + 100 * wh.low) / (lg.n + 100) AS low, (lg.n * lg.high + 100 * wh.high) / (lg.n + 100) AS high FROM lg JOIN wh ON lg.rule = wh.rule),
o2 AS (SELECT o.lang, o.source, o.rule, (o.n * o.low + 100 * l2.low) / (o.n + 100) AS low, (o.n * o.high + 100 * l2.high) / (o.n + 100) AS high FROM own o JOIN l2 ON o.lang IS NOT DISTINCT FROM l2.lang AND o.rule = l2.rule),
f AS MATERIALIZED (SELECT lang, source, {_PIVOT} FROM o2 GROUP BY lang, source),
e AS (SELECT c.*, word_length_low * n_words / 100 AS wl, word_length_high * n_words / 100 AS wh, symbols_high * n_words / 10000 AS sh, dup_lines_high * n_lines / 10000 AS dh, repeats_high * n_words / 10000 AS rh
  FROM c LEFT JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source),
t AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',',
  CASE WHEN n_words > 0 AND (word_chars > wh AND (word_chars - wh) * (word_chars - wh) > 9 * word_chars OR word_chars < wl AND (word_chars - wl) * (word_chars - wl) > 9 * wl) THEN 'word_length' END,
  CASE WHEN n_words > 0 AND n_symbols > sh AND (n_symbols - sh) * (n_symbols - sh) > 9 * n_symbols THEN 'symbols' END,
  CASE WHEN n_words > 0 AND n_dup_lines > dh AND (n_dup_lines - dh) * (n_dup_lines - dh) > 9 * n_dup_lines THEN 'dup_lines' END,
  CASE WHEN n_words > 0 AND n_repeat_words > rh AND (n_repeat_words - rh) * (n_repeat_words - rh) > 45 * n_repeat_words THEN 'repeats' END) AS failed FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM t"""

SHARDING = """
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, key, len(h) // 2 + 1 AS size, list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)) AS bytes, list_transform(range(17), lambda s: md5(key || ':' || s)[1:13]) AS bids FROM d),
s AS (SELECT doc_id, size, xor(4294967295, list_reduce(bytes, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32, list_position(bids[1:16], list_max(bids[1:16])) - 1 AS shard, list_position(bids, list_max(bids)) - 1 AS grown_shard, ('0x' || md5(key)[1:8])::BIGINT % 1024 AS salt FROM b, t)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY salt, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard FROM s"""
