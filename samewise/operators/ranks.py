"""Rank-relative columns of candidate pairs. Windows over one key share one exchange; ties go to the smaller id; missing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY, CAND = "source1_entity_id", "cand_id"


def competition(pairs: DataFrame, score: str = "sim_block", names: tuple[str, ...] = ("cand_n_claims", "cand_max_sim", "sim_rel_cand", "cand_is_best", "cand_rank")) -> DataFrame:
    """Per candidate: claims on it, their largest score (0 at least), the score over that, whether it is the best, its rank from 0."""
    w = Window.partitionBy(CAND)
    s = F.col(score)
    top = F.greatest(F.max(s).over(w), F.lit(0.0))
    made = (F.count("*").over(w), top, s / F.greatest(top, F.lit(1e-6)), (s >= top - 1e-6).cast("int"), F.row_number().over(w.orderBy(s.desc_nulls_last(), F.col(ENTITY))) - 1)
    return pairs.withColumns(dict(zip(names, made)))


def name_competition(pairs: DataFrame, similarity: str) -> DataFrame:
    """The same on the similarity of names: cand_name_sim, _max, _rel, _is_best, _rank."""
    names = ("_claims", "cand_name_max", "cand_name_rel", "cand_name_is_best", "cand_name_rank")
    return competition(pairs.withColumn("cand_name_sim", F.col(similarity)), "cand_name_sim", names).drop("_claims")


def relative(pairs: DataFrame, columns: list[str], parity: bool = False) -> DataFrame:
    """Adds <column>_rel (over the entity's best) and <column>_gap (below it).

    Null values don't count for the best. parity: one missing value makes those of the whole entity missing.
    """
    w = Window.partitionBy(ENTITY)
    made: dict[str, Column] = {}
    for c in columns:
        best = F.greatest(F.max(c).over(w), F.lit(0.0))
        if parity:
            best = F.when(F.count_if(F.col(c).isNull()).over(w) == 0, best)
        made |= {f"{c}_rel": F.when(best.isNotNull(), F.col(c) / F.greatest(best, F.lit(1e-6))), f"{c}_gap": best - F.col(c)}
    return pairs.withColumns(made)


def anchored(pairs: DataFrame, carry: list[str], score: str = "sim_block") -> DataFrame:
    """Adds is_anchor (score within 1e-9 of the entity's best) and anchor_<column> of the entity's best candidate, without a join."""
    w = Window.partitionBy(ENTITY)
    ordered = w.orderBy(F.col(score).desc_nulls_last(), F.col(CAND)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {f"anchor_{c}": F.first(c).over(ordered) for c in carry}
    return pairs.withColumns({"is_anchor": (F.col(score) >= F.max(score).over(w) - 1e-9).cast("int")} | made)


def context(pairs: DataFrame, combined: str = "combined", name: str = "nm_tokset") -> DataFrame:
    """n_cands, ratio_best_name, ratio_best_combined, gap_to_best, combined_minus_mean, rank_name, rank_combined (from 1), best_minus_second."""
    w = Window.partitionBy(ENTITY)
    out = pairs.withColumns({
        "n_cands": F.count("*").over(w), "_top": F.max(combined).over(w), "_top_name": F.max(name).over(w), "_mean": F.avg(combined).over(w),
        "rank_name": F.row_number().over(w.orderBy(F.col(name).desc_nulls_last(), F.col(CAND))), "rank_combined": F.row_number().over(w.orderBy(F.col(combined).desc_nulls_last(), F.col(CAND))),
    })
    second = F.max(F.when(F.col("rank_combined") == 2, F.col(combined)).otherwise(0.0)).over(w)
    c = F.col(combined)
    out = out.withColumns({"ratio_best_name": F.col(name) / F.greatest("_top_name", F.lit(1e-6)), "ratio_best_combined": c / F.greatest("_top", F.lit(1e-6)), "gap_to_best": F.col("_top") - c, "combined_minus_mean": c - F.col("_mean"), "best_minus_second": F.col("_top") - second})
    return out.drop("_top", "_top_name", "_mean")


def probability_context(pairs: DataFrame, p: str = "p1") -> DataFrame:
    """p1_rel, p1_gap and p1_mass within the entity."""
    w = Window.partitionBy(ENTITY)
    return pairs.withColumns({"p1_rel": F.col(p) / F.greatest(F.max(p).over(w), F.lit(1e-6)), "p1_gap": F.max(p).over(w) - F.col(p), "p1_mass": F.sum(p).over(w)})
