"""Candidates of one entity compared with each other: support, components, and the cluster rule.

Only the best few candidates of an entity meet, so the self-join makes at most top * (top - 1) / 2 rows of it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy

ENTITY, CAND = "source1_entity_id", "cand_id"
EDGE = 85.0


def best_pairs(pairs: DataFrame, carry: list[str], top: int, order: str) -> DataFrame:
    """(entity, a, b, <column>_a, <column>_b) for every two of an entity's `top` candidates."""
    w = Window.partitionBy(ENTITY).orderBy(F.col(order).desc_nulls_last(), F.col(CAND))
    best = pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).select(ENTITY, CAND, "_k", *carry)
    a = best.select(ENTITY, F.col(CAND).alias("a"), F.col("_k").alias("ka"), *[F.col(c).alias(f"{c}_a") for c in carry])
    b = best.select(ENTITY, F.col(CAND).alias("b"), F.col("_k").alias("kb"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b, ENTITY).where("ka < kb").drop("ka", "kb")


def mirrored(two: DataFrame, similarity: str, weight: str) -> DataFrame:
    """(entity, cand_id, sim, other): each pair from both ends, with the weight of the other end."""
    one = two.select(ENTITY, F.col("a").alias(CAND), F.col(similarity).alias("sim"), F.col(f"{weight}_b").alias("other"))
    return one.unionByName(two.select(ENTITY, F.col("b").alias(CAND), F.col(similarity).alias("sim"), F.col(f"{weight}_a").alias("other")))


def fuzzy_similarity(two: DataFrame) -> DataFrame:
    """Adds sim: the larger of the set kernels of skeletons and of addresses."""
    k = fuzzy.kernel("token_set")
    return two.withColumns({"_s": k("s_name_a", "s_name_b"), "_t": k("n_addr_a", "n_addr_b")}).withColumn("sim", F.greatest("_s", "_t")).drop("_s", "_t")


def support(pairs: DataFrame, similar=fuzzy_similarity, top: int = 16, edge: float = EDGE, carry: tuple[str, ...] = ("s_name", "n_addr"), weight: str = "sim_block") -> DataFrame:
    """Adds clus_deg and clus_mass (siblings at `edge` and more, and their weight), n_cands and clus_deg_rel."""
    two = similar(best_pairs(pairs, [*carry, weight], top, weight))
    found = mirrored(two, "sim", weight).where(F.col("sim") >= edge).groupBy(ENTITY, CAND).agg(F.count("*").alias("clus_deg"), F.sum("other").alias("clus_mass"))
    out = pairs.join(found, [ENTITY, CAND], "left").fillna({"clus_deg": 0, "clus_mass": 0.0})
    out = out.withColumn("n_cands", F.count("*").over(Window.partitionBy(ENTITY)))
    return out.withColumn("clus_deg_rel", F.col("clus_deg") / F.greatest(F.least("n_cands", F.lit(top)) - 1, F.lit(1)))


def sibling_support(pairs: DataFrame, similar=fuzzy_similarity, top: int = 12, edge: float = EDGE, carry: tuple[str, ...] = ("s_name", "n_addr"), p: str = "p1") -> DataFrame:
    """Adds sib_max, sib_sum (of sim / 100 times the sibling's probability), sib_cnt (similar and likely siblings) and sib_sim."""
    two = similar(best_pairs(pairs, [*carry, p], top, p))
    w = F.col("sim") / 100 * F.col("other")
    found = mirrored(two, "sim", p).groupBy(ENTITY, CAND).agg(F.max(w).alias("sib_max"), F.sum(w).alias("sib_sum"), F.count_if((F.col("sim") >= edge) & (F.col("other") >= 0.5)).alias("sib_cnt"), F.max("sim").alias("sib_sim"))
    return pairs.join(found, [ENTITY, CAND], "left").fillna(0, ["sib_max", "sib_sum", "sib_cnt", "sib_sim"])


def whole_cluster(pairs: DataFrame, top: int = 12, edge: float = EDGE, tau_empty: float = 0.6, min_p: float = 0.05, carry: float = 0.15, p: str = "prob") -> DataFrame:
    """Links by the cluster rule: of an entity whose best candidate reaches tau_empty, the members (carry and more) of the component with most probability.

    Pairs need s_name and n_addr of the candidate. Groups are at most `top` rows.
    """
    w = Window.partitionBy(ENTITY).orderBy(F.col(p).desc(), F.col(CAND))
    best = pairs.where(F.col(p) >= min_p).withColumns({"_k": F.row_number().over(w), "_top": F.max(p).over(Window.partitionBy(ENTITY))})
    best = best.where((F.col("_k") <= top) & (F.col("_top") >= tau_empty)).select(ENTITY, CAND, F.col(p).alias("p"), "s_name", "n_addr")

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["p", CAND], ascending=[False, True]).reset_index(drop=True)
        names, addresses, n = rows["s_name"].fillna(""), rows["n_addr"].fillna(""), len(rows)
        label = list(range(n))
        for i in range(n):
            for j in range(i + 1, n):
                if label[i] != label[j] and max(fuzzy.token_set_ratio(names[i], names[j]), fuzzy.token_set_ratio(addresses[i], addresses[j])) >= edge:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        mass = rows["p"].groupby(label).sum()
        return rows[(pd.Series(label) == mass.idxmax()) & (rows["p"] >= carry)][[ENTITY, CAND]]

    return best.groupBy(ENTITY).applyInPandas(decide, f"{ENTITY} string, {CAND} string")


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id reachable over links (a, b), by passing the least id on and jumping to the label's label.

    Labels are checkpointed each round in the cluster's folder; the loop ends when none changes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    label = nodes.select("id", F.col("id").alias("component")).distinct().checkpoint()
    for _ in range(rounds):
        least = both.join(label, both.b == label.id).groupBy("a").agg(F.min("component").alias("near"))
        new = label.join(least, label.id == least.a, "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = new.select(F.col("id").alias("j"), F.col("component").alias("far"))
        new = new.join(jump, new.component == jump.j).select("id", F.least("component", "far").alias("component")).checkpoint()
        changed = new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def similar_by(name: str, score) -> object:
    """A built-in similarity in place of the kernel: score(a, b) of <name>_a and <name>_b, 0 to 100."""

    def run(two: DataFrame) -> DataFrame:
        s: Column = score(F.col(f"{name}_a"), F.col(f"{name}_b"))
        return two.withColumn("sim", s)

    return run
