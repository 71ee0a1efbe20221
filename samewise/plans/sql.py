"""DuckDB SQL for the registered queries: the same definitions, written for another engine to check them."""

from __future__ import annotations

from ..functions import tables


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(of) -> str:
    return "(" + ", ".join(text(w) for w in of) + ")"


def clean(x: str) -> str:
    s = f"strip_accents(lower(coalesce({x}, '')))"
    s = f"replace(replace(replace(replace({s}, '&', ' and '), '+', ' and '), '''', ''), '’', '')"
    s = rf"regexp_replace({s}, '\b([a-z0-9-]+)\.(?:{'|'.join(tables.TOP_LEVEL_DOMAINS)})\b', '\1', 'g')"
    return rf"trim(regexp_replace(regexp_replace({s}, '[^0-9a-z\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def norm_name(c: str) -> str:
    kept = f"list_filter(string_split({c}, ' '), lambda t: t <> '' AND t NOT IN {words(tables.LEGAL)})"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {c} END"


def skeleton(x: str) -> str:
    """Written out here, so that the queries are not checked against their own table."""
    for a, b in [("chh", "S"), ("sch", "S"), ("sh", "S"), ("ch", "S"), ("kh", "K"), ("gh", "K"), ("th", "T"), ("dh", "T"), ("ph", "P"), ("bh", "P"), ("ng", "N"), ("ny", "N")]:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"translate({x}, 'kgqcxpbfvwtdsjzlrmnyhaeiou', 'KKKKKPPPPPTTSSSLLMM')"
    for c in ["S", "K", "T", "P", "N", "L", "M", *"0123456789", " "]:
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return f"trim({x})"


def norm_addr(c: str) -> str:
    known = tables.STATES | tables.ABBREVIATIONS
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in known.items())
    stop = [w for w in tables.ADDRESS_STOPWORDS if w not in known]
    kept = f"list_filter(string_split({c}, ' '), lambda t: t <> '' AND t NOT IN {words(stop)})"
    return rf"array_to_string(list_transform({kept}, lambda t: CASE t {cases} ELSE regexp_replace(t, '^0+([1-9])', '\1') END), ' ')"


def postal(c: str) -> str:
    hits = rf"regexp_extract_all({c}, '\b\d{{5,6}}\b')"
    return f"coalesce(list_filter({hits}, lambda h: len(h) = 6)[1], {hits}[1], '')"


#: Records from documents: three sources by id, names from the first six words, addresses from the next ten.
RAW = r"""
w AS (SELECT doc_id, lang AS country_key, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda t: t <> '') AS ws FROM documents),
raw AS (SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, country_key, array_to_string(ws[1:6], ' ') AS business_name, array_to_string(ws[7:16], ' ') AS business_address FROM w)"""
RECORDS = f"""{RAW},
cl AS MATERIALIZED (SELECT *, {clean('business_name')} AS c_name, {clean('business_address')} AS c_addr FROM raw),
nm AS MATERIALIZED (SELECT *, {norm_name('c_name')} AS n_name, {norm_addr('c_addr')} AS n_addr, {postal('c_addr')} AS postal FROM cl),
rec AS MATERIALIZED (SELECT entity_id, country_key, c_name, n_name, n_addr, postal, {skeleton('n_name')} AS s_name,
  CASE WHEN len({tokens('n_name')}) >= 2 THEN array_to_string(list_transform({tokens('n_name')}, lambda t: t[1:1]), '') ELSE '' END AS name_acr,
  array_to_string(list_sort({tokens('n_name')}), ' ') AS name_sorted FROM nm)"""
KEYS = f"""
tk AS (SELECT entity_id, country_key, postal, {tokens('s_name')} AS st, replace(s_name, ' ', '') AS flat, {tokens('n_addr')} AS aw FROM rec),
ak AS (SELECT *, list_filter(aw, lambda t: regexp_matches(t, '^[0-9]')) AS nums,
  list_filter(aw, lambda t: NOT regexp_matches(t, '^[0-9]') AND len(t) >= 3 AND t NOT IN {words(tables.GENERIC_ADDRESS)}) AS wd FROM tk),
k0 AS (
  SELECT entity_id, country_key, 'F' AS tag, array_to_string(list_sort(st), '') AS key FROM ak WHERE len(st) BETWEEN 1 AND 8
  UNION ALL SELECT entity_id, country_key, 'T', unnest(list_distinct(list_filter(st, lambda t: len(t) >= 2))) FROM ak
  UNION ALL SELECT entity_id, country_key, 'B', unnest(list_transform(range(1, len(st)), lambda i: st[i] || st[i + 1])) FROM ak
  UNION ALL SELECT entity_id, country_key, 'G', g FROM (SELECT entity_id, country_key, unnest(list_transform(range(1, len(flat) - 2), lambda i: flat[i:i + 3])) AS g FROM ak) WHERE md5('G' || g)[1:1] IN ('0', '4', '8', 'c')
  UNION ALL SELECT entity_id, country_key, 'P', unnest(list_transform(wd[1:5], lambda x: postal || '|' || x)) FROM ak WHERE postal <> ''
  UNION ALL SELECT entity_id, country_key, 'N', n || '|' || unnest(wd[1:4]) FROM (SELECT *, unnest(list_transform(nums[1:2], lambda n: regexp_replace(n, '[a-z]+$', ''))) AS n FROM ak) WHERE n <> ''
  UNION ALL SELECT entity_id, country_key, 'A', unnest(list_transform(range(1, len(wd)), lambda i: wd[i] || '|' || wd[i + 1])) FROM ak WHERE len(nums) = 0),
keys AS MATERIALIZED (SELECT entity_id, country_key, tag, key, count(*) AS tf FROM k0 GROUP BY ALL)"""


def stats(side: str, name: str) -> str:
    caps = " ".join(f"WHEN '{k}' THEN {v}" for k, v in tables.CAPS.items())
    return f"""
{name} AS MATERIALIZED (SELECT country_key, tag, key, df, ln(1 + n / df) AS idf, df <= CASE tag {caps} END AS kept
  FROM (SELECT country_key, tag, key, sum(tf)::DOUBLE AS df FROM keys WHERE {side} GROUP BY ALL) JOIN (SELECT country_key, count(*) AS n FROM rec WHERE {side} GROUP BY ALL) USING (country_key))"""


def scores(name: str, left: str, right: str, st: str, tags: str = "true", weight: str = "idf") -> str:
    """CTEs ending in <name>(l, r, s): the block score of left and right records over keys of some tags."""
    return f"""
{name}_l AS (SELECT entity_id AS l, greatest(sqrt(sum(tf * idf * idf)), 1e-6) AS ln FROM keys JOIN {st} USING (country_key, tag, key) WHERE {left} AND {tags} GROUP BY ALL),
{name}_r AS (SELECT entity_id AS r, greatest(sqrt(sum(tf * idf * idf)), 1e-6) AS rn FROM keys JOIN {st} USING (country_key, tag, key) WHERE {right} AND kept AND {tags} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT l, r, round(s / (ln * rn), 6) AS s FROM (
  SELECT a.entity_id AS l, b.entity_id AS r, sum(a.tf * b.tf * {weight}) AS s FROM (SELECT * FROM keys WHERE {left} AND {tags}) a JOIN (SELECT * FROM keys WHERE {right}) b USING (country_key, tag, key) JOIN {st} USING (country_key, tag, key) WHERE kept GROUP BY ALL)
  JOIN {name}_l USING (l) JOIN {name}_r USING (r))"""


LEFT, RIGHT = "entity_id LIKE 'S1-%'", "entity_id NOT LIKE 'S1-%'"
BASE = f"WITH {RECORDS},{KEYS}"
FORWARD = f"{BASE},{stats(RIGHT, 'st')},{scores('sc', LEFT, RIGHT, 'st')}"


def top(name: str, k: int, source: str = "sc") -> str:
    return f"{name} AS MATERIALIZED (SELECT l AS source1_entity_id, r AS cand_id, s AS sim_block FROM {source} QUALIFY row_number() OVER (PARTITION BY l ORDER BY s DESC, r) <= {k})"


REVERSE = f"{stats(LEFT, 'rst')},{scores('rsc', RIGHT, LEFT, 'rst')}, rev AS MATERIALIZED (SELECT r AS source1_entity_id, l AS cand_id, s AS rev_score, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) - 1 AS rev_rank FROM rsc QUALIFY rev_rank < 3)"
#: Scored pairs: the ten best candidates with a probability from the two numbers; links: equal texts in one language.
NUMBER = "split_part({0}, '-', 2)::BIGINT"
PAIRS = f"{FORWARD}, {top('best', 10)}, pairs AS MATERIALIZED (SELECT source1_entity_id, cand_id, sim_block, (({NUMBER.format('source1_entity_id')} * 7919 + {NUMBER.format('cand_id')} * 104729) % 9973) / 9973.0 AS prob FROM best)"
LINKS = "links AS MATERIALIZED (SELECT 'S1-' || a.doc_id AS source1_entity_id, 'S' || (1 + b.doc_id % 3) || '-' || b.doc_id AS cand_id FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0), ents AS (SELECT entity_id AS source1_entity_id FROM rec WHERE entity_id LIKE 'S1-%')"
F_BETA = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"


def per_entity(predicted: str) -> str:
    return f"""
pe AS (SELECT source1_entity_id, coalesce(n_pred, 0)::DOUBLE AS n_pred, coalesce(n_true, 0)::DOUBLE AS n_true, coalesce(tp, 0)::DOUBLE AS tp FROM ents
  LEFT JOIN (SELECT source1_entity_id, count(*) AS n_pred FROM {predicted} GROUP BY ALL) USING (source1_entity_id)
  LEFT JOIN (SELECT source1_entity_id, count(*) AS n_true FROM links GROUP BY ALL) USING (source1_entity_id)
  LEFT JOIN (SELECT source1_entity_id, count(*) AS tp FROM {predicted} JOIN links USING (source1_entity_id, cand_id) GROUP BY ALL) USING (source1_entity_id)),
pf AS (SELECT *, {F_BETA} AS f FROM pe)"""


def expected(gamma: str, some: str, source: str = "pairs", by: str = "source1_entity_id") -> str:
    """CTEs ending in ef: the pairs of the set size with the largest expected F."""
    return f"""
e1 AS (SELECT *, row_number() OVER o AS k, sum(prob) OVER (PARTITION BY {by} ORDER BY prob DESC, cand_id ROWS UNBOUNDED PRECEDING) AS tpk, sum(prob) OVER (PARTITION BY {by}) AS total,
  exp(sum(ln(greatest(1 - prob, 1e-12))) OVER (PARTITION BY {by})) AS none, max(prob) OVER (PARTITION BY {by}) AS p1 FROM {source} WHERE prob >= 0.02 WINDOW o AS (PARTITION BY {by} ORDER BY prob DESC, cand_id)),
e2 AS (SELECT *, 1.25 * (tpk / k) * (tpk / greatest({gamma} * total, 1e-9)) / (0.25 * (tpk / k) + tpk / greatest({gamma} * total, 1e-9)) AS fk FROM e1),
e3 AS (SELECT *, max(fk) OVER (PARTITION BY {by}) AS best FROM e2),
e4 AS (SELECT *, max(CASE WHEN fk >= best - 1e-12 THEN k END) OVER (PARTITION BY {by}) AS last FROM e3),
ef AS MATERIALIZED (SELECT * FROM e4 WHERE k <= last AND {some})"""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, with a bit per character of the shorter string: a number of 128 bits, or the dynamic programme's rows where it has more than 120."""
    cell = f"CASE WHEN ({a})[j[1]:j[1]] = ({b})[i[1]:i[1]] THEN rw[j[1]] + 1 ELSE greatest(rw[j[1] + 1], acc[j[1]]) END"
    places = lambda s: f"list_transform(range(1, len({s}) + 1), lambda k: [k])"
    row = f"list_reduce({places(a)}, lambda acc, j: list_append(acc, {cell}), [0::BIGINT])"
    long = f"list_reduce({places(b)}, lambda rw, i: {row}, list_transform(range(0, len({a}) + 1), lambda k: 0::BIGINT))[-1]"
    x, y = f"(CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END)"
    full = f"((1::HUGEINT << len({x})::INT) - 1)"
    mask = f"list_sum(list_transform(range(0, len({x})), lambda k: CASE WHEN {x}[k + 1:k + 1] = {y}[i:i] THEN 1::HUGEINT << k::INT ELSE 0::HUGEINT END))::HUGEINT"
    left = f"list_reduce(list_transform(range(1, len({y}) + 1), lambda i: {mask}), lambda rw, m: ((rw + (rw & m)) | (rw - (rw & m))) & {full}, {full})"
    return f"CASE WHEN least(len({a}), len({b})) > 120 THEN {long} ELSE len({x}) - bit_count({left}) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 100.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 200.0 * ({lcs(a, b)}) / (len({a}) + len({b})) END"


def kernels(source: str, a: str, b: str, name: str, whole: bool = True) -> str:
    """CTEs ending in <name>(a, b, token_set), and (ratio, token_sort) if `whole`, over the distinct pairs of strings in `source`."""
    plain = f"{ratio(a, b)} AS ratio, {ratio('xs', 'ys')} AS token_sort," if whole else ""
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda t: t <> '')"
    text = lambda x: f"array_to_string({x}, ' ')"
    return f"""
{name}_t AS MATERIALIZED (SELECT {a}, {b}, list_sort(list_distinct({words(a)})) AS x, list_sort(list_distinct({words(b)})) AS y, {text(f"list_sort({words(a)})")} AS xs, {text(f"list_sort({words(b)})")} AS ys FROM {source}),
{name}_d AS MATERIALIZED (SELECT *, {text("list_filter(x, lambda t: list_contains(y, t))")} AS common, {text("list_filter(x, lambda t: NOT list_contains(y, t))")} AS first_only, {text("list_filter(y, lambda t: NOT list_contains(x, t))")} AS second_only FROM {name}_t),
{name}_e AS MATERIALIZED (SELECT *, trim(common || ' ' || first_only) AS one, trim(common || ' ' || second_only) AS two FROM {name}_d),
{name} AS MATERIALIZED (SELECT {a}, {b}, {plain}
  CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN common <> '' AND (first_only = '' OR second_only = '') THEN 100.0 WHEN common <> '' THEN greatest({ratio('one', 'two')}, {ratio('common', 'one')}, {ratio('common', 'two')}) ELSE {ratio('one', 'two')} END AS token_set FROM {name}_e)"""
