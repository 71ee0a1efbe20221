"""Features of candidate pairs: the full set of the ranking model, and the smaller earlier set.

Both take pairs with a block score and normalised records. String kernels run once per distinct pair of
strings in a batch; all else is built in. A missing value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.text import numbers, tokens
from .cluster import support
from .merge import with_attributes
from .ranks import anchored, context, relative
from .retrieve import smooth_idf, token_df, token_idf_stats

ENTITY, CAND = "source1_entity_id", "cand_id"
PASSED = (
    "cand_n_claims cand_max_sim sim_rel_cand cand_is_best cand_rank cand_name_sim cand_name_max cand_name_rel cand_name_is_best cand_name_rank "
    "emb_cos rev_score rev_rank fwd_hit rev_hit both_hit"
).split()
ALWAYS = (
    "sim_block name_tsr name_tso name_rat name_par skel_tsr skel_rat addr_tsr addr_tso addr_rat name_idf_min name_idf_mean name_idf_max "
    "postal_eq postal_both acr_eq addr_empty cand_src name_tok_inter name_tok_jacc addr_tok_inter addr_tok_jacc addr_num_inter addr_num_jacc addr_num_conflict addr_num_conflict_rate "
    "len_name_l len_name_r len_ratio ntok_l ntok_r sim_block_rel sim_block_gap name_tsr_rel name_tsr_gap skel_tsr_rel skel_tsr_gap addr_tsr_rel addr_tsr_gap "
    "is_anchor skel_vs_anchor addr_vs_anchor anchor_gap_skel anchor_gap_addr clus_deg clus_mass n_cands clus_deg_rel skel_rank"
).split()


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def pair_features(pairs: DataFrame, records: DataFrame, parity: bool = False, top: int = 16) -> DataFrame:
    """ids and the features ALWAYS, and those of PASSED that the pairs have.

    parity: one missing address makes the relative address features of its whole entity missing.
    """
    p = with_attributes(pairs, records, ["n_name", "s_name", "n_addr", "postal", "name_acr"])
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))  # noqa: E741
    set_of = fuzzy.kernel("token_set")
    p = p.withColumns({"_n": fuzzy.kernels("token_set", "token_sort", "ratio", "partial")("l_n_name", "r_n_name"), "_s": fuzzy.kernels("token_set", "ratio")("l_s_name", "r_s_name"), "_t": fuzzy.kernels("token_set", "token_sort", "ratio")("l_n_addr", "r_n_addr")})
    p = p.withColumns({
        "name_tsr": F.col("_n.token_set"), "name_tso": F.col("_n.token_sort"), "name_rat": F.col("_n.ratio"), "name_par": F.col("_n.partial"), "skel_tsr": F.col("_s.token_set"), "skel_rat": F.col("_s.ratio"),
        "_a": F.col("_t.token_set"), "_b": F.col("_t.token_sort"), "_c": F.col("_t.ratio"),
    })
    there = (l("n_addr") != "") & (r("n_addr") != "")
    num_inter, num_jacc, conflict, rate = fuzzy.digit_conflicts(l("n_addr"), r("n_addr"))
    p = p.withColumns({
        "addr_tsr": F.when(there, F.col("_a")), "addr_tso": F.when(there, F.col("_b")), "addr_rat": F.when(there, F.col("_c")),
        "postal_eq": flag((l("postal") == r("postal")) & (l("postal") != "")), "postal_both": flag((l("postal") != "") & (r("postal") != "")), "acr_eq": flag((l("name_acr") == r("name_acr")) & (l("name_acr") != "")),
        "addr_empty": flag(~there), "cand_src": F.substring(CAND, 2, 1).cast("int"),
        "name_tok_inter": fuzzy.shared_tokens(l("n_name"), r("n_name")), "name_tok_jacc": fuzzy.jaccard(l("n_name"), r("n_name")),
        "addr_tok_inter": F.when(there, fuzzy.shared_tokens(l("n_addr"), r("n_addr"))), "addr_tok_jacc": F.when(there, fuzzy.jaccard(l("n_addr"), r("n_addr"))),
        "addr_num_inter": num_inter, "addr_num_jacc": num_jacc, "addr_num_conflict": conflict, "addr_num_conflict_rate": rate,
        "len_name_l": F.length("l_n_name"), "len_name_r": F.length("r_n_name"), "len_ratio": F.length("r_n_name") / F.greatest(F.length("l_n_name"), F.lit(1)),
        "ntok_l": F.size(tokens(l("n_name"))), "ntok_r": F.size(tokens(r("n_name"))),
    })
    df, n = token_df(records, "n_name")
    idf = token_idf_stats(records, df, n.first()["n_docs"], "n_name").withColumnRenamed("entity_id", ENTITY)
    p = p.join(idf, ENTITY, "left")
    p = relative(p, ["sim_block", "name_tsr", "skel_tsr", "addr_tsr"], parity)
    p = anchored(p, ["r_s_name", "r_n_addr", "skel_tsr", "addr_tsr"])
    p = p.withColumns({"skel_vs_anchor": set_of("r_s_name", "anchor_r_s_name"), "addr_vs_anchor": set_of("r_n_addr", "anchor_r_n_addr"), "anchor_gap_skel": F.col("skel_tsr") - F.col("anchor_skel_tsr"), "anchor_gap_addr": F.col("addr_tsr") - F.col("anchor_addr_tsr")})
    p = support(p.withColumns({"s_name": r("s_name"), "n_addr": r("n_addr")}), top=top)
    w = Window.partitionBy(ENTITY).orderBy(F.col("skel_tsr").desc_nulls_last(), F.col(CAND))
    p = p.withColumn("skel_rank", F.row_number().over(w) - 1)
    return p.select(ENTITY, CAND, *[F.col(c).cast("double").alias(c) for c in [*ALWAYS, *[c for c in PASSED if c in pairs.columns]]])


EARLY = (
    "nm_ratio nm_tokset nm_toksort nm_partial nm_jw nm_jaccard nm_contain nm_widf nm_nshared nm_maxidf nm_len_l nm_len_r nm_len_ratio nm_first_tok_eq nm_acr_eq nm_exact nm_sorted_eq nm_prefix4 "
    "ad_ratio ad_tokset ad_toksort ad_jw ad_jaccard ad_contain ad_widf ad_nshared ad_num_inter ad_num_jacc ad_postal_eq ad_postal_both ad_len_l ad_len_r ad_empty_l ad_empty_r cand_src country_eq "
    "n_cands rank_name rank_combined ratio_best_name ratio_best_combined gap_to_best combined combined_minus_mean best_minus_second"
).split()


def early_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """ids, n_keys and sim_block where the pairs have them, and the features EARLY; similarities are 0 to 1."""
    p = with_attributes(pairs, records, ["n_name", "n_addr", "name_acr", "name_sorted", "postal", "country_key"], strict=True)
    p = p.withColumns({"_nm": fuzzy.kernels(*fuzzy.KERNELS)("l_n_name", "r_n_name"), "_ad": fuzzy.kernels("ratio", "token_set", "token_sort", "jaro_winkler")("l_n_addr", "r_n_addr")})
    p = p.withColumns({"l": F.col(ENTITY), "r": F.col(CAND)})
    for column, prefix in (("n_name", "nm"), ("n_addr", "ad")):
        df, n = token_df(records, column)
        idf, default = smooth_idf(df, n.first()["n_docs"])
        p = fuzzy.weighted_overlap(p, f"l_{column}", f"r_{column}", idf, default, prefix)
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))  # noqa: E741
    made: dict[str, Column] = {}
    for column, prefix in (("n_name", "nm"), ("n_addr", "ad")):
        a, b = f"l_{column}", f"r_{column}"
        made |= {f"{prefix}_{name}": F.col(f"_{prefix}.{kernel}") / 100 for name, kernel in (("ratio", "ratio"), ("tokset", "token_set"), ("toksort", "token_sort"))} | {f"{prefix}_jw": F.col(f"_{prefix}.jaro_winkler")}
        made |= {f"{prefix}_contain": fuzzy.containment(l(column), r(column)), f"{prefix}_nshared": fuzzy.shared_tokens(l(column), r(column)), f"{prefix}_len_l": F.length(a), f"{prefix}_len_r": F.length(b)}
        made[f"{prefix}_jaccard"] = F.when((l(column) != "") & (r(column) != ""), fuzzy.jaccard(l(column), r(column))).otherwise(0.0)
    x, y = numbers(l("n_addr")), numbers(r("n_addr"))
    made |= {
        "nm_partial": F.col("_nm.partial") / 100, "nm_len_ratio": F.least(F.length("l_n_name"), F.length("r_n_name")) / F.greatest(F.length("l_n_name"), F.length("r_n_name"), F.lit(1)),
        "nm_first_tok_eq": flag((F.substring_index("l_n_name", " ", 1) == F.substring_index("r_n_name", " ", 1)) & (l("n_name") != "")),
        "nm_acr_eq": flag((l("name_acr") == r("name_acr")) & (l("name_acr") != "")), "nm_exact": flag((l("n_name") == r("n_name")) & (l("n_name") != "")), "nm_sorted_eq": flag((l("name_sorted") == r("name_sorted")) & (l("name_sorted") != "")),
        "nm_prefix4": flag((F.left("l_n_name", F.lit(4)) == F.left("r_n_name", F.lit(4))) & (l("n_name") != "")),
        "ad_num_inter": F.size(F.array_intersect(x, y)), "ad_num_jacc": F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))).otherwise(0.0),
        "ad_postal_eq": flag((l("postal") == r("postal")) & (l("postal") != "")), "ad_postal_both": flag((l("postal") != "") & (r("postal") != "")),
        "ad_empty_l": flag(l("n_addr") == ""), "ad_empty_r": flag(r("n_addr") == ""), "cand_src": F.substring(CAND, 2, 1).cast("int"), "country_eq": flag(l("country_key") == r("country_key")),
    }
    p = p.withColumns(made)
    p = p.withColumn("combined", 0.40 * F.col("nm_tokset") + 0.20 * F.col("nm_jw") + 0.15 * F.col("nm_widf") + 0.15 * F.col("ad_tokset") + 0.10 * F.col("ad_widf"))
    p = context(p)
    return p.select(ENTITY, CAND, *[F.col(c).cast("double").alias(c) for c in [*[c for c in ("sim_block", "n_keys") if c in pairs.columns], *EARLY]])


def embedding_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds emb_cos of unit vectors (entity_id, vector); null where one is missing."""
    a = vectors.select(F.col("entity_id").alias(ENTITY), F.col("vector").alias("_x"))
    b = vectors.select(F.col("entity_id").alias(CAND), F.col("vector").alias("_y"))
    return pairs.join(a, ENTITY, "left").join(b, CAND, "left").withColumn("emb_cos", fuzzy.cosine(F.col("_x"), F.col("_y"), unit=True)).drop("_x", "_y")
