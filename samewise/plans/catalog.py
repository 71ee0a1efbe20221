"""Registered queries over the driver's tables, and their DuckDB SQL.

Documents stand for business records: three sources by id, the first six words as a name and the next
ten as an address, the language as the country. Equal texts in different sources are the true links.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as tx
from ..operators import cluster, decide, features, keys, merge, metrics, model, nearest, ranks, retrieve, tfidf, validate
from ..sources import records as rec
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PAIR = ["source1_entity_id", "cand_id"]
Frame = DataFrame


def query(oracle: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)  # whole numbers are of one width in both engines
            return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes])

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "^[ \\t\\r\\n]+", ""), "[ \\t\\r\\n]+", 17)
    of = F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(of.alias("entity_id"), F.array_join(F.slice(w, 1, 6), " ").alias("business_name"), F.array_join(F.slice(w, 7, 10), " ").alias("business_address"), F.col("lang").alias("country"), F.lower("lang").alias("country_key"))


def checkpoints(spark) -> None:
    """The folder for checkpoints that the cluster names; one is made only on a single machine that names none."""
    import tempfile

    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def kept(df: DataFrame) -> DataFrame:
    """A table that later steps scan again and again, written once to the checkpoint folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def records(spark: SparkSession, sf: str) -> DataFrame:
    return kept(tx.normalised(raw(spark, sf)))


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = F.col("entity_id").startswith("S1-")
    return df.where(first), df.where(~first)


def searched(spark: SparkSession, sf: str, r: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    r = records(spark, sf) if r is None else r
    k = kept(keys.record_keys(r))
    return *sides(r), *sides(k)


def told(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Records and their single keys, sides told by `one`, for searches that read them once and so write neither."""
    r, one = tx.normalised(raw(spark, sf)), F.col("entity_id").startswith("S1-")
    return r.select("entity_id", "country_key", one.alias("one")), keys.single_keys(r).withColumns({"tf": F.lit(1), "one": one})


def scored_pairs(spark: SparkSession, sf: str, k: int = 10, r: DataFrame | None = None) -> DataFrame:
    number = lambda c: F.substring_index(c, "-", -1).cast("long")
    return retrieve.forward(*searched(spark, sf, r), k=k).withColumn("prob", ((number("source1_entity_id") * 7919 + number("cand_id") * 104729) % 9973) / 9973.0)


def truth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Links, and all entities of the first source."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    a, b = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("i"), "text", "lang"), d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("j"), "text", "lang")
    links = a.join(b, ["text", "lang"]).select(F.concat(F.lit("S1-"), F.col("i").cast("string")).alias("source1_entity_id"), F.expr("concat('S', cast(1 + j % 3 AS string), '-', cast(j AS string))").alias("cand_id"))
    return links, d.where("doc_id % 3 = 0").select(F.expr("concat('S1-', cast(doc_id AS string))").alias("source1_entity_id"))


# --- text -----------------------------------------------------------------------------------------------------


@query(f"WITH {sql.RECORDS} SELECT entity_id, country_key, c_name, n_name, s_name, n_addr, postal, name_acr, name_sorted, trim(n_name || ' ' || n_addr) AS blob FROM rec")
def normalised_records(spark, sf):
    return records(spark, sf).select("entity_id", "country_key", "c_name", "n_name", "s_name", "n_addr", "postal", "name_acr", "name_sorted", "blob")


@query(rf"SELECT c_custkey, {sql.clean('c_name')} AS cleaned, regexp_replace(split_part(c_name, '#', 2), '^0+([1-9])', '\1') AS denumbered, array_to_string(list_sort(list_distinct(regexp_extract_all({sql.clean('c_name')}, '\b\d+[a-z]?\b'))), ',') AS numbers, {sql.skeleton(sql.clean('c_name'))} AS skeleton FROM customer")
def customer_scalars(spark, sf):
    c = tx.clean("c_name")
    return table(spark, sf, "customer").select("c_custkey", c.alias("cleaned"), tx.denumbered(F.substring_index("c_name", "#", -1)).alias("denumbered"), F.array_join(F.array_sort(tx.numbers(c)), ",").alias("numbers"), tx.skeleton(c).alias("skeleton"))


INDIC = {"मार्केटिंग": "marketing", "लिमिटेड": "limited", "राम": "ram", "राम श्याम": "ram shyam", "১২ ক": "12 k", "plain": "plain"}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{v}', {str(k != 'plain').lower()})" for i, (k, v) in enumerate(INDIC.items())) + ") t(id, roman, indic)")
def transliteration(spark, sf):
    given = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("s")) for i, k in enumerate(INDIC)])
    return spark.range(1).select(F.explode(given).alias("g")).select("g.id", tx.transliterate(F.col("g.s")).alias("roman"), tx.has_indic(F.col("g.s")).alias("indic"))


@query(rf"SELECT page_id, regexp_replace(lower(url), '\b([a-z0-9-]+)\.(?:com|net|org|co|in|fr|biz|info|io)\b', '\1', 'g') AS bare FROM pages")
def domain_suffixes(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_domains(F.lower("url")).alias("bare"))


# --- keys and frequencies -------------------------------------------------------------------------------------


@query(f"{sql.BASE} SELECT entity_id, country_key, tag, key, tf FROM keys")
def record_keys(spark, sf):
    return keys.record_keys(records(spark, sf))


@query(f"{sql.BASE} SELECT entity_id, key, tf FROM keys WHERE tag = 'G'")
def shingles_sampled(spark, sf):
    return keys.record_keys(records(spark, sf), tags=("G",)).select("entity_id", "key", "tf")


@query(f"{sql.BASE},{sql.stats(sql.RIGHT, 'st')} SELECT country_key, tag, key, df::BIGINT AS df, round(idf, 6) AS idf, kept FROM st")
def key_df_idf(spark, sf):
    _, b, _, kb = searched(spark, sf)
    return retrieve.key_stats(kb, b).withColumn("idf", F.round("idf", 6))


@query("WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) SELECT token, count(*) AS df FROM t GROUP BY token")
def token_frequencies(spark, sf):
    return retrieve.token_df(table(spark, sf, "part"), "p_name")[0]


TOKEN_IDF = f"WITH {sql.RECORDS}, t AS (SELECT DISTINCT entity_id, unnest({sql.tokens('n_name')}) AS token FROM rec), d AS (SELECT token, count(*) AS df FROM t GROUP BY token), n AS (SELECT count(*) AS n FROM rec), i AS (SELECT entity_id, ln(1 + n::DOUBLE / df) AS idf FROM t JOIN d USING (token), n) SELECT entity_id, round(min(idf), 6) AS name_idf_min, round(avg(idf), 6) AS name_idf_mean, round(max(idf), 6) AS name_idf_max FROM rec LEFT JOIN i USING (entity_id) GROUP BY entity_id"


@query(TOKEN_IDF)
def token_idf_stats(spark, sf):
    r = records(spark, sf)
    df, n = retrieve.token_df(r, "n_name")
    out = retrieve.token_idf_stats(r, df, n.first()["n_docs"], "n_name")
    return out.select("entity_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


# --- candidates -----------------------------------------------------------------------------------------------


@query(f"{sql.FORWARD}, {sql.top('best', 5)} SELECT * FROM best")
def block_topk(spark, sf):
    return retrieve.forward(*searched(spark, sf), k=5)


@query(f"{sql.BASE},{sql.stats(sql.RIGHT, 'st')},{sql.scores('sc', sql.LEFT, sql.RIGHT, 'st', weight='idf * idf')}, {sql.top('best', 5)} SELECT * FROM best")
def block_topk_cosine(spark, sf):
    return retrieve.forward(*searched(spark, sf), k=5, mode="cosine")


@query(f"{sql.BASE},{sql.REVERSE} SELECT * FROM rev")
def block_reverse(spark, sf):
    return retrieve.reverse(*searched(spark, sf), k=3)


_TAGS = {v: "tag IN " + sql.words(t) for v, t in retrieve.VIEWS.items()}
_VIEWS = ",".join(sql.scores(f"sc_{v}", sql.LEFT, sql.RIGHT, "st", t) for v, t in _TAGS.items())
_RANKED = ", ".join(f"v_{v} AS (SELECT l, r, s, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) - 1 AS k FROM sc_{v} QUALIFY k < 8)" for v in _TAGS)


@query(f"""{sql.BASE},{sql.stats(sql.RIGHT, 'st')},{_VIEWS}, {_RANKED}, al AS (SELECT l, r FROM v_name UNION SELECT l, r FROM v_addr UNION SELECT l, r FROM v_both)
SELECT l AS source1_entity_id, r AS cand_id, coalesce(a.s, 0) AS sim_name, coalesce(b.s, 0) AS sim_addr, coalesce(c.s, 0) AS sim_both, a.k AS rank_name, b.k AS rank_addr, c.k AS rank_both,
 greatest(coalesce(a.s, 0), coalesce(b.s, 0), coalesce(c.s, 0)) AS sim_block, (coalesce(a.s, 0) > 0)::BIGINT + (coalesce(b.s, 0) > 0)::BIGINT + (coalesce(c.s, 0) > 0)::BIGINT AS n_views
FROM al LEFT JOIN v_name a USING (l, r) LEFT JOIN v_addr b USING (l, r) LEFT JOIN v_both c USING (l, r)""")
def block_multiview(spark, sf):
    return retrieve.views_together(*told(spark, sf), ks={"name": 8, "addr": 8, "both": 8})


@query(f"""WITH {sql.RECORDS}, t AS (SELECT entity_id, country_key, unnest(list_filter({sql.tokens('n_name')}, lambda t: len(t) >= 2)) AS term FROM rec),
d AS (SELECT term, ln((1.0 + (SELECT count(*) FROM rec)) / (1.0 + count(DISTINCT entity_id))) + 1 AS idf FROM t GROUP BY term HAVING count(DISTINCT entity_id) >= 2),
v AS (SELECT entity_id, country_key, term, (1 + ln(count(*))) * any_value(idf) AS w FROM t JOIN d USING (term) GROUP BY ALL),
u AS (SELECT entity_id, country_key, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM v),
s AS (SELECT a.entity_id AS l, b.entity_id AS r, round(sum(a.w * b.w), 6) AS s FROM u a JOIN u b USING (country_key, term) WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' GROUP BY ALL)
SELECT l AS source1_entity_id, r AS cand_id, s AS sim FROM s WHERE s >= 0.05 QUALIFY row_number() OVER (PARTITION BY l ORDER BY s DESC, r) <= 5""")
def tfidf_topk(spark, sf):
    a, b = sides(records(spark, sf))
    return tfidf.tfidf_top(a, b, "n_name", "word", k=5, most_terms=None)


def _tfidf(v: str, grams: str) -> str:
    """CTEs ending in <v>(l, r, s): the five best by TF-IDF cosine over the grams of a record."""
    return f"""
{v}_t AS (SELECT entity_id, country_key, unnest({grams}) AS term FROM rec),
{v}_d AS (SELECT term, ln((1.0 + (SELECT count(*) FROM rec)) / (1.0 + count(DISTINCT entity_id))) + 1 AS idf FROM {v}_t GROUP BY term HAVING count(DISTINCT entity_id) >= 2),
{v}_v AS (SELECT entity_id, country_key, term, (1 + ln(count(*))) * any_value(idf) AS w FROM {v}_t JOIN {v}_d USING (term) GROUP BY ALL),
{v}_u AS (SELECT entity_id, country_key, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM {v}_v),
{v}_s AS (SELECT a.entity_id AS l, b.entity_id AS r, round(sum(a.w * b.w), 6) AS s FROM {v}_u a JOIN {v}_u b USING (country_key, term) WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' GROUP BY ALL),
{v} AS MATERIALIZED (SELECT l, r, s FROM {v}_s WHERE s >= 0.05 QUALIFY row_number() OVER (PARTITION BY l ORDER BY s DESC, r) <= 5)"""


_WB3 = "flatten(list_transform({0}, lambda t: list_transform(range(1, len(t) + 1), lambda i: (' ' || t || ' ')[i:i + 2])))"
_NOSPACE = "replace(n_name, ' ', '')"
_CHAR3 = f"CASE WHEN len({_NOSPACE}) >= 3 THEN list_transform(range(1, len({_NOSPACE}) - 1), lambda i: {_NOSPACE}[i:i + 2]) WHEN len({_NOSPACE}) > 0 THEN [{_NOSPACE}] ELSE [] END"
_GRAMS = {"name": _WB3.format(sql.tokens("n_name")), "nospace": _CHAR3, "addr": f"list_filter({sql.tokens('n_addr')}, lambda t: len(t) >= 2)", "hybrid": _WB3.format(sql.tokens("(n_name || ' ' || n_addr)"))}


@query(f"""WITH {sql.RECORDS},{','.join(_tfidf(f'tv_{v}', g) for v, g in _GRAMS.items())}, al AS ({' UNION '.join(f'SELECT l, r FROM tv_{v}' for v in _GRAMS)})
SELECT al.l AS source1_entity_id, al.r AS cand_id, {', '.join(f'coalesce({v}.s, 0) AS sim_{v}' for v in _GRAMS)}, greatest({', '.join(f'coalesce({v}.s, 0)' for v in _GRAMS)}) AS sim_block, {' + '.join(f'(coalesce({v}.s, 0) > 0)::BIGINT' for v in _GRAMS)} AS n_views
FROM al {' '.join(f'LEFT JOIN tv_{v} {v} ON al.l = {v}.l AND al.r = {v}.r' for v in _GRAMS)}""")
def tfidf_char_views(spark, sf):
    a, b = sides(records(spark, sf))
    found = [tfidf.tfidf_top(a, b, c, how, k=5, most_terms=None).select(*PAIR, F.col("sim").alias("sim_block"), F.lit(0).alias("rank"), F.lit(v).alias("view")) for v, c, how in (("name", "n_name", "char_wb3"), ("nospace", "n_name", "char3"), ("addr", "n_addr", "word"), ("hybrid", "blob", "char_wb3"))]
    return retrieve.merged_views(found, ["name", "nospace", "addr", "hybrid"]).drop("rank_name", "rank_nospace", "rank_addr", "rank_hybrid")


@query(f"""{sql.FORWARD}, {sql.top('f', 6)},{sql.REVERSE} SELECT coalesce(f.source1_entity_id, r.source1_entity_id) AS source1_entity_id, coalesce(f.cand_id, r.cand_id) AS cand_id, coalesce(sim_block, 0) AS sim_block,
 (f.cand_id IS NOT NULL)::BIGINT AS fwd_hit, coalesce(rev_score, 0) AS rev_score, coalesce(rev_rank, 99)::BIGINT AS rev_rank, (r.cand_id IS NOT NULL)::BIGINT AS rev_hit, (f.cand_id IS NOT NULL AND r.cand_id IS NOT NULL)::BIGINT AS both_hit
FROM f FULL JOIN rev r ON f.source1_entity_id = r.source1_entity_id AND f.cand_id = r.cand_id""")
def union_provenance(spark, sf):
    return merge.merged_ways(retrieve.both_ways(*told(spark, sf), k=6, rev_k=3))


_UNION = ORACLE["union_provenance"]


@query(f"SELECT count(*) AS n_pairs, round(count(*) / count(DISTINCT source1_entity_id), 6) AS per_entity, count(*) FILTER (fwd_hit = 1 AND rev_hit = 0) AS fwd_only, count(*) FILTER (fwd_hit = 0 AND rev_hit = 1) AS rev_only, count(*) FILTER (both_hit = 1) AS both FROM ({_UNION})")
def provenance_summary(spark, sf):
    return merge.provenance(union_provenance(spark, sf)).withColumn("per_entity", F.round("per_entity", 6))


@query(f"{sql.FORWARD}, {sql.top('f', 6)},{sql.REVERSE} SELECT source1_entity_id, cand_id, rev_score, rev_rank FROM rev WHERE source1_entity_id IN (SELECT source1_entity_id FROM f WHERE sim_block > 0.1)")
def reverse_restricted(spark, sf):
    # one of the six best is above 0.1 if the best is
    return merge.restricted_ways(retrieve.both_ways(*told(spark, sf), k=1, rev_k=3), 0.1)


@query(f"""{sql.BASE},{sql.stats(sql.RIGHT, 'st')},{sql.scores('sn', sql.LEFT, sql.RIGHT, 'st', "tag IN ('F', 'T', 'B', 'G')")},{sql.scores('sa', sql.LEFT, sql.RIGHT, 'st', "tag IN ('P', 'N', 'A')")},
z AS (SELECT coalesce(n.l, a.l) AS l, coalesce(n.r, a.r) AS r, coalesce(n.s, 0) AS x, coalesce(a.s, 0) AS y FROM sn n FULL JOIN sa a ON n.l = a.l AND n.r = a.r), sc AS (SELECT l, r, round(greatest(x, y) + 0.35 * least(x, y), 6) AS s FROM z), {sql.top('best', 5)} SELECT * FROM best""")
def block_split_channels(spark, sf):
    return retrieve.split_forward(*searched(spark, sf), k=5)


@query("WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) SELECT token, round(ln((SELECT count(*) FROM part)::DOUBLE / (1 + count(*))) + 1, 6) AS idf FROM t GROUP BY token")
def smooth_idf(spark, sf):
    df, n = retrieve.token_df(table(spark, sf, "part"), "p_name")
    return retrieve.smooth_idf(df, n.first()["n_docs"])[0].withColumn("idf", F.round("idf", 6))


@query(f"""{sql.FORWARD}, {sql.top('wide', 20)}, wp AS (SELECT w.*, a.s_name AS sa, b.s_name AS sb, a.n_addr AS aa, b.n_addr AS ab FROM wide w JOIN rec a ON a.entity_id = source1_entity_id JOIN rec b ON b.entity_id = cand_id),
sp AS (SELECT DISTINCT sa, sb FROM wp), {sql.kernels('sp', 'sa', 'sb', 'ks', False)}, ap AS (SELECT DISTINCT aa, ab FROM wp), {sql.kernels('ap', 'aa', 'ab', 'ka', False)},
z AS (SELECT source1_entity_id, cand_id, round(greatest(ks.token_set, ka.token_set) + 0.35 * least(ks.token_set, ka.token_set) + 0.05 * 100.0 * sim_block, 6) AS sim_block FROM wp JOIN ks USING (sa, sb) JOIN ka USING (aa, ab))
SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY source1_entity_id ORDER BY sim_block DESC, cand_id) <= 5""")
def rescored_topk(spark, sf):
    return retrieve.rescored(retrieve.forward(*searched(spark, sf), k=20), records(spark, sf), k=5)


@query(f"{sql.PAIRS}, {sql.LINKS} SELECT source1_entity_id, cand_id, (l.cand_id IS NOT NULL)::BIGINT AS label FROM pairs p LEFT JOIN links l USING (source1_entity_id, cand_id)".replace("(l.cand_id IS NOT NULL)::BIGINT", "(EXISTS (SELECT 1 FROM links l WHERE l.source1_entity_id = p.source1_entity_id AND l.cand_id = p.cand_id))::BIGINT").replace("p LEFT JOIN links l USING (source1_entity_id, cand_id)", "p"))
def labelled_pairs(spark, sf):
    return merge.labelled(scored_pairs(spark, sf), truth(spark, sf)[0]).select(*PAIR, "label")


@query(f"{sql.PAIRS}, z AS (SELECT *, round(0.7 * prob + 0.3 * sim_block, 6) AS pre_score FROM pairs), y AS (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY pre_score DESC, cand_id) AS pre_rank FROM z) SELECT source1_entity_id, cand_id, pre_score, pre_rank FROM y WHERE pre_rank <= 3 OR pre_score >= 0.6")
def pruned_pairs(spark, sf):
    return merge.pruned(scored_pairs(spark, sf), {"prob": 0.7, "sim_block": 0.3}, top_n=3, keep_above=0.6).select(*PAIR, "pre_score", "pre_rank")


# --- windows --------------------------------------------------------------------------------------------------


@query(f"""{sql.PAIRS} SELECT source1_entity_id, cand_id, count(*) OVER c AS cand_n_claims, greatest(max(sim_block) OVER c, 0) AS cand_max_sim, round(sim_block / greatest(max(sim_block) OVER c, 1e-6), 6) AS sim_rel_cand,
 (sim_block >= max(sim_block) OVER c - 1e-6)::BIGINT AS cand_is_best, row_number() OVER (PARTITION BY cand_id ORDER BY sim_block DESC, source1_entity_id) - 1 AS cand_rank FROM pairs WINDOW c AS (PARTITION BY cand_id)""")
def competition(spark, sf):
    return ranks.competition(scored_pairs(spark, sf).drop("prob")).withColumn("sim_rel_cand", F.round("sim_rel_cand", 6)).drop("sim_block")


@query("""WITH c AS (SELECT l_partkey AS cand_id, l_suppkey AS source1_entity_id, sum(l_quantity)::DOUBLE AS score FROM lineitem GROUP BY ALL)
SELECT cand_id, source1_entity_id, count(*) OVER w AS cand_n_claims, greatest(max(score) OVER w, 0) AS cand_max_sim, round(score / greatest(max(score) OVER w, 1e-6), 6) AS sim_rel_cand, (score >= max(score) OVER w - 1e-6)::BIGINT AS cand_is_best,
 row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, source1_entity_id) - 1 AS cand_rank FROM c WINDOW w AS (PARTITION BY cand_id)""")
def competition_at_volume(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cand_id"), F.col("l_suppkey").alias("source1_entity_id")).agg(F.sum("l_quantity").cast("double").alias("score"))
    return ranks.competition(c, "score").withColumn("sim_rel_cand", F.round("sim_rel_cand", 6)).drop("score")


@query(f"{sql.PAIRS} SELECT source1_entity_id, cand_id, round(sim_block / greatest(max(sim_block) OVER e, 1e-6), 6) AS sim_block_rel, round(max(sim_block) OVER e - sim_block, 6) AS sim_block_gap, round(prob / greatest(max(prob) OVER e, 1e-6), 6) AS prob_rel, round(max(prob) OVER e - prob, 6) AS prob_gap FROM pairs WINDOW e AS (PARTITION BY source1_entity_id)")
def entity_relative(spark, sf):
    out = ranks.relative(scored_pairs(spark, sf), ["sim_block", "prob"])
    return out.select(*PAIR, *[F.round(c, 6).alias(c) for c in ("sim_block_rel", "sim_block_gap", "prob_rel", "prob_gap")])


@query(f"{sql.PAIRS} SELECT source1_entity_id, cand_id, (sim_block >= max(sim_block) OVER (PARTITION BY source1_entity_id) - 1e-9)::BIGINT AS is_anchor, first_value(cand_id) OVER o AS anchor_cand_id, round(first_value(prob) OVER o, 6) AS anchor_prob FROM pairs WINDOW o AS (PARTITION BY source1_entity_id ORDER BY sim_block DESC, cand_id)")
def anchors(spark, sf):
    out = ranks.anchored(scored_pairs(spark, sf), ["cand_id", "prob"])
    return out.select(*PAIR, "is_anchor", "anchor_cand_id", F.round("anchor_prob", 6).alias("anchor_prob"))


@query(f"""{sql.PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY sim_block DESC, cand_id) AS rank_name, row_number() OVER (PARTITION BY source1_entity_id ORDER BY prob DESC, cand_id) AS rank_combined FROM pairs)
SELECT source1_entity_id, cand_id, count(*) OVER e AS n_cands, rank_name, rank_combined, round(sim_block / greatest(max(sim_block) OVER e, 1e-6), 6) AS ratio_best_name, round(prob / greatest(max(prob) OVER e, 1e-6), 6) AS ratio_best_combined,
 round(max(prob) OVER e - prob, 6) AS gap_to_best, round(prob - avg(prob) OVER e, 6) AS combined_minus_mean, round(max(prob) OVER e - max(CASE WHEN rank_combined = 2 THEN prob ELSE 0 END) OVER e, 6) AS best_minus_second FROM r WINDOW e AS (PARTITION BY source1_entity_id)""")
def pair_context(spark, sf):
    out = ranks.context(scored_pairs(spark, sf), "prob", "sim_block")
    real = ["ratio_best_name", "ratio_best_combined", "gap_to_best", "combined_minus_mean", "best_minus_second"]
    return out.select(*PAIR, "n_cands", "rank_name", "rank_combined", *[F.round(c, 6).alias(c) for c in real])


@query(f"{sql.PAIRS} SELECT source1_entity_id, cand_id, round(prob / greatest(max(prob) OVER e, 1e-6), 6) AS p1_rel, round(max(prob) OVER e - prob, 6) AS p1_gap, round(sum(prob) OVER e, 6) AS p1_mass FROM pairs WINDOW e AS (PARTITION BY source1_entity_id)")
def probability_context(spark, sf):
    out = ranks.probability_context(scored_pairs(spark, sf), "prob")
    return out.select(*PAIR, *[F.round(c, 6).alias(c) for c in ("p1_rel", "p1_gap", "p1_mass")])


# --- similarities ---------------------------------------------------------------------------------------------

_TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
_RECJOIN = f"{sql.PAIRS}, ab AS (SELECT source1_entity_id, cand_id, a.n_name AS x, b.n_name AS y, a.n_addr AS p, b.n_addr AS q FROM pairs JOIN rec a ON a.entity_id = source1_entity_id JOIN rec b ON b.entity_id = cand_id)"
_X, _Y = _TOK.format("x"), _TOK.format("y")
_I, _U = f"len(list_intersect({_X}, {_Y}))", f"len(list_distinct(list_concat({_X}, {_Y})))"


@query(f"{_RECJOIN} SELECT source1_entity_id, cand_id, {_I} AS n_shared, round({_I} / greatest({_U}, 1), 6) AS jaccard, round(coalesce({_I} / nullif(least(len({_X}), len({_Y})), 0), 0), 6) AS containment FROM ab")
def token_overlap(spark, sf):
    p = merge.with_attributes(scored_pairs(spark, sf), records(spark, sf), ["n_name"])
    a, b = F.col("l_n_name"), F.col("r_n_name")
    return p.select(*PAIR, fuzzy.shared_tokens(a, b).cast("long").alias("n_shared"), F.round(fuzzy.jaccard(a, b), 6).alias("jaccard"), F.round(fuzzy.containment(a, b), 6).alias("containment"))


_BX, _DX = _TOK.format("b.t"), _TOK.format("d.t")


@query(f"""WITH b AS (SELECT item_id, {sql.clean('text')} AS t FROM benchmark WHERE item_id < 20), d AS (SELECT doc_id, {sql.clean('text')} AS t FROM documents WHERE doc_id % 10 = 0)
SELECT item_id, doc_id, round(len(list_intersect({_BX}, {_DX})) / least(len({_BX}), len({_DX})), 6) AS containment FROM b, d WHERE len({_BX}) > 0 AND len({_DX}) > 0 AND len(list_intersect({_BX}, {_DX})) / least(len({_BX}), len({_DX})) >= 0.9""".replace("WHERE item_id < 20", "").replace("WHERE doc_id % 10 = 0", ""))
def benchmark_containment(spark, sf):
    def words(df, key):
        return df.select(key, F.array_distinct(tx.tokens(tx.clean("text"))).alias("w")).where(F.size("w") > 0)

    b, d = kept(words(table(spark, sf, "benchmark"), "item_id")), kept(words(table(spark, sf, "documents"), "doc_id"))
    return merge.contained(b, d, "item_id", "doc_id", 9, 10).select("item_id", "doc_id", F.round("containment", 6).alias("containment"))


_PD, _QD = "list_distinct(list_filter(string_split(p, ' '), lambda t: regexp_matches(t, '[0-9]')))", "list_distinct(list_filter(string_split(q, ' '), lambda t: regexp_matches(t, '[0-9]')))"
_NI, _NU = f"len(list_intersect({_PD}, {_QD}))", f"len(list_distinct(list_concat({_PD}, {_QD})))"


@query(f"{_RECJOIN} SELECT source1_entity_id, cand_id, CASE WHEN p <> '' AND q <> '' THEN {_NI} END AS num_inter, CASE WHEN p <> '' AND q <> '' THEN {_NU} - {_NI} END AS num_conflict, round(CASE WHEN p <> '' AND q <> '' THEN ({_NU} - {_NI}) / greatest({_NU}, 1) END, 6) AS conflict_rate FROM ab")
def numeric_conflicts(spark, sf):
    p = merge.with_attributes(scored_pairs(spark, sf), records(spark, sf), ["n_addr"])
    inter, _, apart, rate = fuzzy.digit_conflicts(F.col("l_n_addr"), F.col("r_n_addr"))
    return p.select(*PAIR, inter.cast("long").alias("num_inter"), apart.cast("long").alias("num_conflict"), F.round(rate, 6).alias("conflict_rate"))


_WIDF = f"""{_RECJOIN}, tf AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT entity_id, unnest({sql.tokens('n_name')}) AS token FROM rec) GROUP BY token), n AS (SELECT count(*)::DOUBLE AS n FROM rec), idf AS (SELECT token, ln(n / (1 + df)) + 1 AS idf FROM tf, n),
tt AS (SELECT source1_entity_id, cand_id, unnest(list_distinct(list_concat({_X}, {_Y}))) AS token, x, y FROM ab), ww AS (SELECT source1_entity_id, cand_id, idf, list_contains({_X}, token) AND list_contains({_Y}, token) AS b FROM tt JOIN idf USING (token))
SELECT source1_entity_id, cand_id, round(coalesce(sum(CASE WHEN b THEN idf ELSE 0 END) / sum(idf), 0), 6) AS nm_widf, round(coalesce(max(CASE WHEN b THEN idf END), 0), 6) AS nm_maxidf FROM ab LEFT JOIN ww USING (source1_entity_id, cand_id) GROUP BY ALL"""


@query(_WIDF)
def weighted_overlap(spark, sf):
    r = records(spark, sf)
    df, n = retrieve.token_df(r, "n_name")
    idf, default = retrieve.smooth_idf(df, n.first()["n_docs"])
    p = merge.with_attributes(scored_pairs(spark, sf), r, ["n_name"]).withColumns({"l": F.col("source1_entity_id"), "r": F.col("cand_id")})
    return fuzzy.weighted_overlap(p, "l_n_name", "r_n_name", idf, default, "nm").select(*PAIR, F.round("nm_widf", 6).alias("nm_widf"), F.round("nm_maxidf", 6).alias("nm_maxidf"))


@query("""WITH s AS (SELECT a.vec_id AS source1_entity_id, b.vec_id AS cand_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS emb_cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source1_entity_id ORDER BY emb_cos DESC, cand_id) <= 5""")
def emb_cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return retrieve.top_k(nearest.cosine_top(e, 5), 5, "emb_cos")


@query("""WITH n AS (SELECT DISTINCT p_name, p_brand FROM part), p AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name) SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw FROM p""")
def jaro_winkler(spark, sf):
    return name_pairs(spark, sf).select("a", "b", F.round(fuzzy.kernel("jaro_winkler")("a", "b"), 6).alias("jw"))


def name_pairs(spark, sf):
    n = table(spark, sf, "part").select("p_name", "p_brand").distinct()
    return n.select(F.col("p_name").alias("a"), "p_brand").join(n.select(F.col("p_name").alias("b"), "p_brand"), "p_brand").where("a < b").select("a", "b").distinct()


_NAMES = "n AS (SELECT DISTINCT p_name, p_brand FROM part), ab AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name)"


@query(f"WITH {_NAMES}, {sql.kernels('ab', 'a', 'b', 'kr')} SELECT a, b, round(ratio, 4) AS ratio, round(token_sort, 4) AS token_sort, round(token_set, 4) AS token_set FROM kr")
def sequence_kernels(spark, sf):
    k = F.col("k")
    return name_pairs(spark, sf).withColumn("k", fuzzy.kernels("ratio", "token_sort", "token_set")("a", "b")).select("a", "b", *[F.round(k[n], 4).alias(n) for n in ("ratio", "token_sort", "token_set")])


@query()
def partial_kernel(spark, sf):
    return name_pairs(spark, sf).select("a", "b", F.round(fuzzy.kernel("partial")("a", "b"), 4).alias("partial"))


# --- features and models --------------------------------------------------------------------------------------


@query()
def pair_features(spark, sf):
    return features.pair_features(ranks.competition(scored_pairs(spark, sf).drop("prob")), records(spark, sf))


@query(f"{sql.PAIRS}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT source1_entity_id, cand_id, round(list_inner_product(a.v, b.v), 6) AS emb_cos FROM pairs LEFT JOIN e a ON a.vec_id = {sql.NUMBER.format('source1_entity_id')} LEFT JOIN e b ON b.vec_id = {sql.NUMBER.format('cand_id')}")
def embedding_pairs(spark, sf):
    of = lambda k: F.concat(F.lit(f"S{k}-"), F.col("vec_id").cast("string"))
    e = table(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 3 == 0, of(1)).when(F.col("vec_id") % 3 == 1, of(2)).otherwise(of(3)).alias("entity_id"), F.col("embedding").alias("vector"))
    return features.embedding_cosine(scored_pairs(spark, sf), e).select(*PAIR, F.round("emb_cos", 6).alias("emb_cos"))


@query()
def early_features(spark, sf):
    r = records(spark, sf)
    return features.early_features(kept(scored_pairs(spark, sf, r=r).drop("prob")), r)


_SIM = f"100.0 * len(list_intersect({_TOK.format('a.n')}, {_TOK.format('b.n')})) / greatest(len(list_distinct(list_concat({_TOK.format('a.n')}, {_TOK.format('b.n')}))), 1)"
_SUPPORT = f"""{sql.PAIRS}, kk AS (SELECT p.*, n_name AS n, row_number() OVER (PARTITION BY source1_entity_id ORDER BY @by DESC, cand_id) AS k FROM pairs p JOIN rec ON entity_id = cand_id QUALIFY k <= @top),
tw AS (SELECT source1_entity_id, a.cand_id, {_SIM} AS sim, b.@by AS other FROM kk a JOIN kk b USING (source1_entity_id) WHERE a.cand_id <> b.cand_id)"""


@query(f"{_SUPPORT.replace('@by', 'sim_block').replace('@top', '16')}, dg AS (SELECT source1_entity_id, cand_id, count(*) AS deg, sum(other) AS mass FROM tw WHERE sim >= 20 GROUP BY ALL) SELECT source1_entity_id, cand_id, coalesce(deg, 0) AS clus_deg, round(coalesce(mass, 0), 6) AS clus_mass, round(coalesce(deg, 0) / greatest(least(count(*) OVER (PARTITION BY source1_entity_id), 16) - 1, 1), 6) AS clus_deg_rel FROM pairs LEFT JOIN dg USING (source1_entity_id, cand_id)")
def cluster_support(spark, sf):
    p = merge.with_attributes(scored_pairs(spark, sf), records(spark, sf), ["n_name"])
    out = cluster.support(p, cluster.similar_by("r_n_name", lambda a, b: 100 * fuzzy.jaccard(a, b)), edge=20.0, carry=("r_n_name",))
    return out.select(*PAIR, "clus_deg", F.round("clus_mass", 6).alias("clus_mass"), F.round("clus_deg_rel", 6).alias("clus_deg_rel"))


@query(f"{_SUPPORT.replace('@by', 'prob').replace('@top', '12')}, sg AS (SELECT source1_entity_id, cand_id, max(sim / 100 * other) AS a, sum(sim / 100 * other) AS b, count(*) FILTER (sim >= 20 AND other >= 0.5) AS c, max(sim) AS d FROM tw GROUP BY ALL) SELECT source1_entity_id, cand_id, round(coalesce(a, 0), 6) AS sib_max, round(coalesce(b, 0), 6) AS sib_sum, coalesce(c, 0) AS sib_cnt, round(coalesce(d, 0), 6) AS sib_sim FROM pairs LEFT JOIN sg USING (source1_entity_id, cand_id)")
def sibling_support(spark, sf):
    p = merge.with_attributes(scored_pairs(spark, sf), records(spark, sf), ["n_name"])
    out = cluster.sibling_support(p, cluster.similar_by("r_n_name", lambda a, b: 100 * fuzzy.jaccard(a, b)), edge=20.0, carry=("r_n_name",), p="prob")
    return out.select(*PAIR, F.round("sib_max", 6).alias("sib_max"), F.round("sib_sum", 6).alias("sib_sum"), "sib_cnt", F.round("sib_sim", 6).alias("sib_sim"))


_FUZZY = f"""{sql.PAIRS}, kk AS (SELECT p.*, s_name AS sn, n_addr AS na, row_number() OVER (PARTITION BY source1_entity_id ORDER BY @by DESC, cand_id) AS k FROM pairs p JOIN rec ON entity_id = cand_id QUALIFY k <= @top),
t0 AS MATERIALIZED (SELECT source1_entity_id, a.cand_id, a.sn AS s1, b.sn AS s2, a.na AS a1, b.na AS a2, b.@by AS other FROM kk a JOIN kk b USING (source1_entity_id) WHERE a.cand_id <> b.cand_id),
sp AS (SELECT DISTINCT s1, s2 FROM t0), {sql.kernels('sp', 's1', 's2', 'ks', False)}, ap AS (SELECT DISTINCT a1, a2 FROM t0), {sql.kernels('ap', 'a1', 'a2', 'ka', False)},
tw AS (SELECT source1_entity_id, cand_id, greatest(ks.token_set, ka.token_set) AS sim, other FROM t0 JOIN ks USING (s1, s2) JOIN ka USING (a1, a2))"""


def sibling_pairs(spark, sf):
    """Scored pairs with the skeleton and the address of the candidate."""
    own = records(spark, sf).select(F.col("entity_id").alias("cand_id"), "s_name", "n_addr")
    return scored_pairs(spark, sf).join(own, "cand_id")


@query(f"{_FUZZY.replace('@by', 'sim_block').replace('@top', '16')}, dg AS (SELECT source1_entity_id, cand_id, count(*) AS deg, sum(other) AS mass FROM tw WHERE sim >= 85 GROUP BY ALL) SELECT source1_entity_id, cand_id, coalesce(deg, 0) AS clus_deg, round(coalesce(mass, 0), 6) AS clus_mass, round(coalesce(deg, 0) / greatest(least(count(*) OVER (PARTITION BY source1_entity_id), 16) - 1, 1), 6) AS clus_deg_rel FROM pairs LEFT JOIN dg USING (source1_entity_id, cand_id)")
def cluster_support_fuzzy(spark, sf):
    out = cluster.support(sibling_pairs(spark, sf))
    return out.select(*PAIR, "clus_deg", F.round("clus_mass", 6).alias("clus_mass"), F.round("clus_deg_rel", 6).alias("clus_deg_rel"))


@query(f"{_FUZZY.replace('@by', 'prob').replace('@top', '12')}, sg AS (SELECT source1_entity_id, cand_id, max(sim / 100 * other) AS a, sum(sim / 100 * other) AS b, count(*) FILTER (sim >= 85 AND other >= 0.5) AS c, max(sim) AS d FROM tw GROUP BY ALL) SELECT source1_entity_id, cand_id, round(coalesce(a, 0), 6) AS sib_max, round(coalesce(b, 0), 6) AS sib_sum, coalesce(c, 0) AS sib_cnt, round(coalesce(d, 0), 6) AS sib_sim FROM pairs LEFT JOIN sg USING (source1_entity_id, cand_id)")
def sibling_support_fuzzy(spark, sf):
    out = cluster.sibling_support(sibling_pairs(spark, sf), p="prob")
    return out.select(*PAIR, F.round("sib_max", 6).alias("sib_max"), F.round("sib_sum", 6).alias("sib_sum"), "sib_cnt", F.round("sib_sim", 6).alias("sib_sim"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT doc_id AS id FROM documents), g AS (SELECT text, min(doc_id) AS a FROM documents GROUP BY text), e AS (SELECT g.a, d.doc_id AS b FROM documents d JOIN g USING (text) WHERE g.a <> d.doc_id), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, reach) AS (SELECT id, id FROM n UNION SELECT r.id, b FROM r JOIN both_ways ON a = reach) SELECT id, min(reach) AS component FROM r GROUP BY id""")
def components(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("s"))
    first = d.groupBy("s").agg(F.min("id").alias("a"))
    e = d.join(first, "s").select("a", F.col("id").alias("b")).where("a <> b")
    checkpoints(spark)
    return cluster.components(e, d)


@query(f"""{_FUZZY.replace('@by', 'prob').replace('@top', '12')}, sg AS (SELECT source1_entity_id, cand_id, max(sim / 100 * other) AS a, sum(sim / 100 * other) AS b, count(*) FILTER (sim >= 85 AND other >= 0.5) AS c, max(sim) AS d FROM tw GROUP BY ALL)
SELECT source1_entity_id, cand_id, round(prob, 6) AS p1, round(coalesce(a, 0), 6) AS sib_max, round(coalesce(b, 0), 6) AS sib_sum, coalesce(c, 0) AS sib_cnt, round(coalesce(d, 0), 6) AS sib_sim,
 round(prob / greatest(max(prob) OVER e, 1e-6), 6) AS p1_rel, round(max(prob) OVER e - prob, 6) AS p1_gap, round(sum(prob) OVER e, 6) AS p1_mass FROM pairs LEFT JOIN sg USING (source1_entity_id, cand_id) WINDOW e AS (PARTITION BY source1_entity_id)""")
def stacked_features(spark, sf):
    out = model.stacked(sibling_pairs(spark, sf).withColumnRenamed("prob", "p1"))
    return out.select(*PAIR, *[F.round(c, 6).alias(c) if c != "sib_cnt" else F.col(c) for c in model.STACKED])


_RULE = f"""{sql.PAIRS.replace('WITH', 'WITH RECURSIVE', 1)}, kk AS MATERIALIZED (SELECT p.*, s_name AS sn, n_addr AS na, row_number() OVER (PARTITION BY source1_entity_id ORDER BY prob DESC, cand_id) AS k, max(prob) OVER (PARTITION BY source1_entity_id) AS top FROM pairs p JOIN rec ON entity_id = cand_id WHERE prob >= 0.05 QUALIFY k <= 12 AND top >= 0.6),
t0 AS MATERIALIZED (SELECT a.source1_entity_id AS e, a.k AS x, b.k AS y, a.sn AS s1, b.sn AS s2, a.na AS a1, b.na AS a2 FROM kk a JOIN kk b USING (source1_entity_id) WHERE a.k <> b.k),
sp AS (SELECT DISTINCT s1, s2 FROM t0), {sql.kernels('sp', 's1', 's2', 'ks', False)}, ap AS (SELECT DISTINCT a1, a2 FROM t0), {sql.kernels('ap', 'a1', 'a2', 'ka', False)},
ed AS MATERIALIZED (SELECT e, x, y FROM t0 JOIN ks USING (s1, s2) JOIN ka USING (a1, a2) WHERE greatest(ks.token_set, ka.token_set) >= 85),
rc(e, x, y) AS (SELECT source1_entity_id, k, k FROM kk UNION SELECT rc.e, rc.x, ed.y FROM rc JOIN ed ON ed.e = rc.e AND ed.x = rc.y),
lb AS (SELECT e, x, min(y) AS label FROM rc GROUP BY e, x), ms AS (SELECT e, label, sum(prob) AS mass FROM lb JOIN kk ON source1_entity_id = e AND k = x GROUP BY ALL),
ch AS (SELECT e, label FROM ms QUALIFY row_number() OVER (PARTITION BY e ORDER BY round(mass, 9) DESC, label) = 1)
SELECT source1_entity_id, cand_id FROM kk JOIN lb ON e = source1_entity_id AND x = k JOIN ch USING (e, label) WHERE prob >= 0.15"""


@query(_RULE)
def cluster_rule(spark, sf):
    return cluster.whole_cluster(sibling_pairs(spark, sf))


@query()
def gbt_score(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    t = F.col("text")
    shapes = {"n_words": F.size(F.split(t, " ")), "n_chars": F.length(t), "marks": F.length(F.regexp_replace(t, "[^#*$%&!|]", "")) / F.greatest(F.length(t), F.lit(1)), "upper": F.length(F.regexp_replace(t, "[^A-Z]", "")) / F.greatest(F.length(t), F.lit(1)), "rare": F.when(F.length(t) > 2000, F.lit(1.0))}
    rows = d.select("doc_id", F.col("quality").alias("label"), *[c.alias(n) for n, c in shapes.items()]).withColumn("source1_entity_id", F.concat(F.lit("S1-"), F.col("doc_id").cast("string"))).withColumn("cand_id", F.col("source1_entity_id"))
    held = model.held_out(F.col("source1_entity_id"))
    fitted = model.PairModel.fit(rows.where(~held & F.col("label").isNotNull()), list(shapes))
    return fitted.transform(rows.withColumn("held_out", held)).select("doc_id", "label", "held_out", "prob")


# --- decisions ------------------------------------------------------------------------------------------------

_THRESHOLD = f"{sql.PAIRS}, {sql.LINKS}, th AS MATERIALIZED (SELECT source1_entity_id, cand_id, prob FROM (SELECT *, max(prob) OVER (PARTITION BY source1_entity_id) AS best FROM pairs) WHERE best >= 0.6 AND prob >= greatest(0.425, 0.7 * best))"


@query(f"{_THRESHOLD} SELECT source1_entity_id, cand_id, round(prob, 6) AS prob FROM th")
def threshold_decision(spark, sf):
    return decide.threshold(scored_pairs(spark, sf)).select(*PAIR, F.round("prob", 6).alias("prob"))


@query(f"{_THRESHOLD} SELECT source1_entity_id, cand_id FROM th QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, source1_entity_id) = 1")
def one_to_one(spark, sf):
    return decide.threshold(scored_pairs(spark, sf), decide.Knobs(one_to_one=True)).select(*PAIR)


@query(f"{sql.PAIRS},{sql.expected('1.15', 'best > none')} SELECT source1_entity_id, cand_id FROM ef")
def expected_f(spark, sf):
    return decide.expected_f(scored_pairs(spark, sf)).select(*PAIR)


@query(f"{sql.PAIRS},{sql.expected('1.05', 'p1 >= 0.6')} SELECT source1_entity_id, cand_id FROM ef QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, source1_entity_id) = 1")
def hybrid_decision(spark, sf):
    return decide.hybrid(scored_pairs(spark, sf), 1.05, 0.6).select(*PAIR)


_LANGS = {"en": (0.5, 0.4, 0.6), "fr": (0.7, 0.5, 0.3)}


@query(f"{sql.PAIRS}, kn AS (SELECT p.*, CASE country_key WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.7 ELSE 0.6 END AS te, CASE country_key WHEN 'en' THEN 0.4 WHEN 'fr' THEN 0.5 ELSE 0.425 END AS ta, CASE country_key WHEN 'en' THEN 0.6 WHEN 'fr' THEN 0.3 ELSE 0.7 END AS al FROM pairs p JOIN rec ON entity_id = source1_entity_id) SELECT source1_entity_id, cand_id FROM (SELECT *, max(prob) OVER (PARTITION BY source1_entity_id) AS best FROM kn) WHERE best >= te AND prob >= greatest(ta, al * best)")
def threshold_by_country(spark, sf):
    country = records(spark, sf).select(F.col("entity_id").alias("source1_entity_id"), "country_key")
    knobs = spark.createDataFrame([(k, *v) for k, v in _LANGS.items()], "country_key string, tau_empty double, tau_abs double, alpha double")
    return decide.threshold_by(scored_pairs(spark, sf).join(country, "source1_entity_id"), knobs, decide.Knobs()).select(*PAIR)


@query(f"""{sql.PAIRS}, {sql.LINKS}, gr AS MATERIALIZED (SELECT tau_empty, tau_abs, alpha FROM (SELECT unnest({decide.TAUS}::DOUBLE[]) AS tau_empty), (SELECT unnest({decide.TAUS}::DOUBLE[]) AS tau_abs), (SELECT unnest({decide.ALPHAS}::DOUBLE[]) AS alpha) WHERE tau_abs <= tau_empty),
pb AS (SELECT *, max(prob) OVER (PARTITION BY source1_entity_id) AS best FROM pairs), kp AS (SELECT tau_empty, tau_abs, alpha, source1_entity_id, cand_id FROM pb, gr WHERE best >= tau_empty AND prob >= greatest(tau_abs, alpha * best)),
np AS (SELECT tau_empty, tau_abs, alpha, source1_entity_id, count(*) AS n_pred, count(l.cand_id) AS tp FROM kp LEFT JOIN (SELECT source1_entity_id, cand_id, 1 AS y FROM links) l USING (source1_entity_id, cand_id) GROUP BY ALL),
nt AS (SELECT source1_entity_id, count(*) AS n_true FROM links GROUP BY ALL),
al AS (SELECT tau_empty, tau_abs, alpha, coalesce(n_pred, 0)::DOUBLE AS n_pred, coalesce(tp, 0)::DOUBLE AS tp, coalesce(n_true, 0)::DOUBLE AS n_true FROM gr CROSS JOIN ents LEFT JOIN np USING (tau_empty, tau_abs, alpha, source1_entity_id) LEFT JOIN nt USING (source1_entity_id))
SELECT tau_empty::DOUBLE AS tau_empty, tau_abs::DOUBLE AS tau_abs, alpha::DOUBLE AS alpha, round(avg({sql.F_BETA}), 6) AS macro_f FROM al GROUP BY ALL""".replace("count(l.cand_id) AS tp", "count(l.y) AS tp"))
def threshold_grid(spark, sf):
    links, entities = truth(spark, sf)
    return decide.scored_grid(scored_pairs(spark, sf), entities, links, decide.knob_grid(spark)).withColumn("macro_f", F.round("macro_f", 6))


_GAMMA = f"gp AS (SELECT * FROM pairs, (SELECT unnest({decide.GAMMAS}::DOUBLE[]) AS gamma))"


@query(f"{sql.PAIRS}, {sql.LINKS}, {_GAMMA},{sql.expected('gamma', 'best > none', 'gp', 'source1_entity_id, gamma')}, np AS (SELECT gamma, source1_entity_id, count(*) AS n_pred, count(y) AS tp FROM ef LEFT JOIN (SELECT source1_entity_id, cand_id, 1 AS y FROM links) USING (source1_entity_id, cand_id) GROUP BY ALL), nt AS (SELECT source1_entity_id, count(*) AS n_true FROM links GROUP BY ALL), al AS (SELECT gamma, coalesce(n_pred, 0)::DOUBLE AS n_pred, coalesce(tp, 0)::DOUBLE AS tp, coalesce(n_true, 0)::DOUBLE AS n_true FROM (SELECT DISTINCT gamma FROM gp) CROSS JOIN ents LEFT JOIN np USING (gamma, source1_entity_id) LEFT JOIN nt USING (source1_entity_id)) SELECT gamma::DOUBLE AS gamma, round(avg({sql.F_BETA}), 6) AS macro_f FROM al GROUP BY ALL")
def gamma_grid(spark, sf):
    links, entities = truth(spark, sf)
    return decide.gamma_scores(scored_pairs(spark, sf), entities, links).withColumn("macro_f", F.round("macro_f", 6))


@query()
def tuned_knobs(spark, sf):
    links, entities = truth(spark, sf)
    knobs, score = decide.tune(kept(scored_pairs(spark, sf)), entities, links)
    return spark.createDataFrame([(knobs.tau_empty, knobs.tau_abs, knobs.alpha, knobs.one_to_one, score)], "tau_empty double, tau_abs double, alpha double, one_to_one boolean, macro_f double")


# --- metrics, results, checks ---------------------------------------------------------------------------------


@query(f"{_THRESHOLD},{sql.per_entity('th')} SELECT source1_entity_id, n_pred::BIGINT AS n_pred, n_true::BIGINT AS n_true, tp::BIGINT AS tp, round(f, 6) AS f FROM pf")
def entity_f(spark, sf):
    links, entities = truth(spark, sf)
    return metrics.per_entity(decide.threshold(scored_pairs(spark, sf)), links, entities).withColumn("f", F.round("f", 6))


@query(f"""{_THRESHOLD},{sql.per_entity('th')}, s AS (SELECT count(*) AS n_entities, round(avg(f), 6) AS macro_f, round(avg(f) FILTER (n_true = 0), 6) AS f_singleton, round(avg(f) FILTER (n_true > 0), 6) AS f_linked, count(*) FILTER (n_true = 0) AS n_singleton,
 count(*) FILTER (n_true = 0 AND n_pred > 0) AS false_merges, count(*) FILTER (n_true > 0 AND tp = 0) AS missed_all, sum(tp)::BIGINT AS tp, (sum(n_pred) - sum(tp))::BIGINT AS fp, (sum(n_true) - sum(tp))::BIGINT AS fn FROM pf)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS link_p, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS link_r FROM s""")
def decision_report(spark, sf):
    links, entities = truth(spark, sf)
    out = metrics.report(decide.threshold(scored_pairs(spark, sf)), links, entities).drop("link_f")
    return out.withColumns({c: F.round(c, 6) for c in ("macro_f", "f_singleton", "f_linked", "link_p", "link_r")})


@query(f"{sql.PAIRS}, {sql.LINKS}, h AS (SELECT source1_entity_id, count(*) AS n, count(p.sim_block) AS hit FROM links LEFT JOIN pairs p USING (source1_entity_id, cand_id) GROUP BY ALL) SELECT sum(n)::BIGINT AS n_links, sum(hit)::BIGINT AS n_found, round(sum(hit) / sum(n), 6) AS link_recall, count(*) AS n_linked, count(*) FILTER (hit = n) AS fully, count(*) FILTER (hit > 0 AND hit < n) AS partly FROM h")
def recall_ceiling(spark, sf):
    return metrics.recall_ceiling(scored_pairs(spark, sf), truth(spark, sf)[0]).withColumn("link_recall", F.round("link_recall", 6))


@query(f"{sql.PAIRS}, {sql.LINKS}, tp AS (SELECT source1_entity_id, cand_id FROM pairs SEMI JOIN links USING (source1_entity_id, cand_id)),{sql.per_entity('tp')} SELECT round(avg(f), 6) AS macro_f FROM pf")
def oracle_ceiling(spark, sf):
    links, entities = truth(spark, sf)
    return metrics.oracle_ceiling(scored_pairs(spark, sf), links, entities).withColumn("macro_f", F.round("macro_f", 6))


@query(f"{sql.PAIRS} SELECT count(*) AS n_pairs, round(1 - count(*) / ((SELECT count(*) FROM rec WHERE {sql.LEFT}) * (SELECT count(*) FROM rec WHERE {sql.RIGHT}))::DOUBLE, 6) AS reduction_ratio FROM pairs")
def reduction_ratio(spark, sf):
    a, b = sides(raw(spark, sf))
    return metrics.reduction_ratio(scored_pairs(spark, sf), a.count(), b.count()).withColumn("reduction_ratio", F.round("reduction_ratio", 6))


@query(f"WITH {sql.RAW} SELECT entity_id[1:2] AS source, country_key, count(*) AS n, count(*) FILTER (trim(business_name) = '') AS blank_names, count(*) FILTER (trim(business_address) = '') AS blank_addresses, count(DISTINCT entity_id) AS n_ids FROM raw GROUP BY ALL")
def profile_records(spark, sf):
    return metrics.profile_records(raw(spark, sf))


_COUNTS = f"WITH {sql.RAW}, rec AS (SELECT * FROM raw), {sql.LINKS}, k AS (SELECT e.source1_entity_id, count(l.cand_id) AS k FROM ents e LEFT JOIN links l ON l.source1_entity_id = e.source1_entity_id GROUP BY ALL)"


@query(f"""{_COUNTS} SELECT (SELECT count(*) FROM k) AS n_entities, (SELECT count(*) FROM k WHERE k = 0) AS singletons, (SELECT sum(k)::BIGINT FROM k) AS n_links, (SELECT round(avg(k), 6) FROM k) AS mean_links, (SELECT median(k)::DOUBLE FROM k) AS median_links, (SELECT max(k) FROM k) AS max_links,
 (SELECT count(*) FROM (SELECT cand_id FROM links GROUP BY ALL HAVING count(*) > 1)) AS reused_ids, (SELECT count(*) FROM links WHERE cand_id LIKE 'S2-%') AS links_s2, (SELECT count(*) FROM links WHERE cand_id LIKE 'S3-%') AS links_s3, (SELECT count(*) FROM rec WHERE {sql.RIGHT} AND entity_id NOT IN (SELECT cand_id FROM links)) AS unlinked_right""")
def profile_links(spark, sf):
    links, entities = truth(spark, sf)
    return metrics.profile_links(links, entities, sides(raw(spark, sf))[1]).withColumn("mean_links", F.round("mean_links", 6))


@query(f"{_COUNTS} SELECT k AS n_links, count(*) AS n_entities FROM k GROUP BY ALL")
def profile_sizes(spark, sf):
    return metrics.profile_sizes(*truth(spark, sf))


@query(f"""WITH {sql.RAW}, rec AS (SELECT * FROM raw), {sql.LINKS}, k AS (SELECT e.source1_entity_id, count(l.cand_id) AS k FROM ents e LEFT JOIN links l ON l.source1_entity_id = e.source1_entity_id GROUP BY ALL)
SELECT country_key, count(*) AS n_entities, round(avg((k = 0)::INT::DOUBLE), 6) AS singleton_rate, round(avg(k), 6) AS mean_links, max(k) AS max_links FROM k JOIN raw ON entity_id = source1_entity_id GROUP BY country_key""")
def profile_countries(spark, sf):
    links, _ = truth(spark, sf)
    entities = sides(raw(spark, sf))[0].select(F.col("entity_id").alias("source1_entity_id"), "country_key")
    return metrics.profile_countries(links, entities).withColumns({c: F.round(c, 6) for c in ("singleton_rate", "mean_links")})


@query(f"{sql.PAIRS} SELECT source1_entity_id, cand_id, round(prob, 6) AS prob FROM pairs WHERE prob >= 0.5 * least(0.425::DOUBLE, 0.6::DOUBLE)")
def floored_pairs(spark, sf):
    return scored_pairs(spark, sf).where(F.col("prob") >= decide.probability_floor(decide.Knobs())).select(*PAIR, F.round("prob", 6).alias("prob"))


@query(f"""{_THRESHOLD}, m AS (SELECT source1_entity_id, string_agg(cand_id, ',' ORDER BY cand_id) AS a FROM th GROUP BY ALL), c AS (SELECT source1_entity_id, string_agg(cand_id, ',' ORDER BY cand_id) AS b FROM pairs GROUP BY ALL)
SELECT source1_entity_id, coalesce(a, '') AS matched_entity_ids, coalesce(b, '') AS candidate_entity_ids FROM ents LEFT JOIN m USING (source1_entity_id) LEFT JOIN c USING (source1_entity_id)""")
def result_lists(spark, sf):
    a, b = sides(raw(spark, sf))
    pairs = scored_pairs(spark, sf)
    return rec.results(a, b, decide.threshold(pairs), pairs)


@query(f"WITH {sql.RAW} SELECT entity_id, (entity_id[2:2]::BIGINT << 32) | split_part(entity_id, '-', 2)::BIGINT AS code, entity_id AS back FROM raw")
def id_codec(spark, sf):
    code = rec.encoded(F.col("entity_id"))
    return raw(spark, sf).select("entity_id", code.alias("code"), rec.decoded(code).alias("back"))


_LISTS = "concat('S', 1 + doc_id % 4, '-', doc_id, ',', CASE WHEN doc_id % 5 = 0 THEN concat('S', 1 + doc_id % 4, '-', doc_id) ELSE 'X9' END, ',,S2- ', doc_id % 7)"


@query(f"WITH l AS (SELECT doc_id, {_LISTS} AS s FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(s, ','), lambda t: trim(t)), lambda t: t <> ''))), ',') AS ids FROM l")
def id_lists(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rec.id_text(rec.id_list(F.expr(_LISTS))).alias("ids"))


_CHECKED = f"""WITH rows AS (SELECT 'S1-' || (doc_id - doc_id % 3 + CASE WHEN doc_id % 50 = 0 THEN 3 ELSE 0 END) AS source1_entity_id, {_LISTS} AS ids FROM documents WHERE doc_id % 3 = 0),
own AS (SELECT 'S1-' || doc_id AS source1_entity_id FROM documents WHERE doc_id % 3 = 0), fl AS (SELECT source1_entity_id, unnest(list_filter(string_split(ids, ','), lambda t: t <> '')) AS id FROM rows)
SELECT 'duplicate_row' AS rule, 'error' AS severity, source1_entity_id AS key, count(*)::VARCHAR AS detail FROM rows GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'duplicate_id', 'error', source1_entity_id, id FROM fl GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'self_match', 'error', source1_entity_id, id FROM fl WHERE id LIKE 'S1-%'
UNION ALL SELECT 'bad_prefix', 'error', source1_entity_id, id FROM fl WHERE id NOT LIKE 'S1-%' AND NOT regexp_matches(id, '^S[23]-')
UNION ALL SELECT 'missing_entity', 'error', source1_entity_id, '' FROM own WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM rows)
UNION ALL SELECT DISTINCT 'extra_entity', 'error', source1_entity_id, '' FROM rows WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM own)
UNION ALL SELECT 'unknown_id', 'error', source1_entity_id, id FROM fl WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id FROM documents)"""


@query(_CHECKED)
def result_checks(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.where("doc_id % 3 = 0").select(F.expr("concat('S1-', doc_id - doc_id % 3 + CASE WHEN doc_id % 50 = 0 THEN 3 ELSE 0 END)").alias("source1_entity_id"), F.expr(_LISTS).alias("ids"))
    own = d.where("doc_id % 3 = 0").select(F.expr("concat('S1-', doc_id)").alias("source1_entity_id"))
    return validate.check_lists(rows, own, raw(spark, sf).select("entity_id"))


@query(f"WITH {sql.RAW}, rec AS (SELECT * FROM raw), {sql.LINKS}, a AS (SELECT entity_id FROM raw WHERE {sql.LEFT} ORDER BY entity_id LIMIT 50), t AS (SELECT DISTINCT cand_id FROM links WHERE source1_entity_id IN (FROM a)), o AS (SELECT entity_id FROM raw WHERE {sql.RIGHT} AND entity_id NOT IN (FROM t) ORDER BY entity_id LIMIT 150) SELECT entity_id FROM a UNION ALL SELECT cand_id FROM t UNION ALL SELECT entity_id FROM o")
def sample_subset(spark, sf):
    a, b = sides(raw(spark, sf))
    own, some, _ = rec.subset(a, b, truth(spark, sf)[0], 50, 100)
    return own.select("entity_id").unionByName(some.select("entity_id"))
