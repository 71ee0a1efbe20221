"""Candidate sets joined with their provenance, labels and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["source1_entity_id", "cand_id"]
NEVER = 99


def union(forward: DataFrame, reverse: DataFrame, fwd_k: int = 60, rev_k: int = 3) -> DataFrame:
    """Full outer join of the fwd_k best forward and rev_k best reverse candidates; a pair not found in reverse has rev_rank 99."""
    w = Window.partitionBy("source1_entity_id").orderBy(F.col("sim_block").desc(), F.col("cand_id"))
    f = forward.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= fwd_k).select(*PAIR, "sim_block", F.lit(1).alias("fwd_hit"))
    r = reverse.where(F.col("rev_rank") < rev_k).select(*PAIR, "rev_score", "rev_rank", F.lit(1).alias("rev_hit"))
    out = f.join(r, PAIR, "full").fillna({"sim_block": 0.0, "fwd_hit": 0, "rev_score": 0.0, "rev_rank": NEVER, "rev_hit": 0})
    return out.withColumn("both_hit", F.col("fwd_hit") * F.col("rev_hit"))


def merged_ways(found: DataFrame) -> DataFrame:
    """union() of rows (way, source1_entity_id, cand_id, sim, rank) of both ways, grouped by pair instead of joined."""
    of = lambda way, c: F.max(F.when(F.col("way") == way, F.col(c)))
    out = found.groupBy(*PAIR).agg(of("forward", "sim").alias("f"), of("reverse", "sim").alias("r"), of("reverse", "rank").alias("k"))
    hit = {c: F.col(c).isNotNull().cast("int") for c in "fr"}
    return out.select(
        *PAIR, F.coalesce("f", F.lit(0.0)).alias("sim_block"), hit["f"].alias("fwd_hit"), F.coalesce("r", F.lit(0.0)).alias("rev_score"), F.coalesce("k", F.lit(NEVER)).alias("rev_rank"),
        hit["r"].alias("rev_hit"), (hit["f"] * hit["r"]).alias("both_hit"),
    )


def restricted(reverse: DataFrame, forward: DataFrame) -> DataFrame:
    """Reverse rows of entities that the forward search has."""
    return reverse.join(forward.select("source1_entity_id").distinct(), "source1_entity_id", "left_semi")


def restricted_ways(found: DataFrame, above: float) -> DataFrame:
    """Reverse rows (source1_entity_id, cand_id, rev_score, rev_rank) of entities with a forward score above a least one, from rows (way, source1_entity_id, cand_id, sim, rank) of both ways."""
    reached = F.max((F.col("way") == "forward") & (F.col("sim") > above)).over(Window.partitionBy("source1_entity_id"))
    return found.withColumn("_reached", reached).where((F.col("way") == "reverse") & F.col("_reached")).select(*PAIR, F.col("sim").alias("rev_score"), F.col("rank").alias("rev_rank"))


def provenance(pairs: DataFrame) -> DataFrame:
    """One row: pairs, pairs per entity, and shares found only forward, only in reverse, and by both."""
    n = F.count("*")
    return pairs.agg(
        n.alias("n_pairs"), (n / F.count_distinct("source1_entity_id")).alias("per_entity"),
        F.count_if((F.col("fwd_hit") == 1) & (F.col("rev_hit") == 0)).alias("fwd_only"), F.count_if((F.col("fwd_hit") == 0) & (F.col("rev_hit") == 1)).alias("rev_only"), F.count_if(F.col("both_hit") == 1).alias("both"),
    )


def labelled(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Adds label: 1 for pairs among the links (source1_entity_id, cand_id)."""
    true = links.select(*PAIR).distinct().withColumn("label", F.lit(1))
    return pairs.join(true, PAIR, "left").fillna(0, ["label"])


def with_attributes(pairs: DataFrame, records: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Adds l_<column> and r_<column>; missing records give empty strings, or, if strict, an error."""
    out = pairs
    for side, key in (("l", "source1_entity_id"), ("r", "cand_id")):
        own = records.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        if strict and (lost := out.join(own, key, "left_anti").select(key).first()):
            raise ValueError(f"no record {lost[0]}")
        out = out.join(own, key, "left").fillna("", [f"{side}_{c}" for c in columns])
    return out


def pruned(pairs: DataFrame, weights: dict[str, float], top_n: int = 12, keep_above: float = 0.80) -> DataFrame:
    """Pairs among the top_n of their entity by a weighted score, or with a score of keep_above and more."""
    score = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    w = Window.partitionBy("source1_entity_id").orderBy(F.col("pre_score").desc(), F.col("cand_id"))
    out = pairs.withColumn("pre_score", F.round(score, 6)).withColumn("pre_rank", F.row_number().over(w))
    return out.where((F.col("pre_rank") <= top_n) | (F.col("pre_score") >= keep_above))


def contained(left: DataFrame, right: DataFrame, a: str, b: str, over: int, under: int, words: str = "w") -> DataFrame:
    """(a, b, containment) of rows whose common words are over / under or more of the smaller side's; both sides have an id and a set of words.

    All but so few words of the smaller set are common that one of its rarest is, so only these look up the
    other side's words: a word that all rows have is met only by sets of little else.
    """
    x, y = (t.select(F.col(i).alias("id"), F.size(words).alias("n"), F.explode(words).alias("t")) for t, i in ((left, a), (right, b)))
    often = x.select("t").unionAll(y.select("t")).groupBy("t").agg(F.count("*").alias("df"))

    def rare(of: DataFrame) -> DataFrame:
        ranked = of.join(often, "t").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("df", "t")))
        return ranked.where(F.col("k") <= F.col("n") - F.ceil(F.lit(over) * F.col("n") / under) + 1)

    one = rare(x).alias("p").join(y.alias("q"), F.expr("p.t = q.t AND p.n <= q.n")).select(F.col("p.id").alias(a), F.col("q.id").alias(b))
    two = rare(y).alias("p").join(x.alias("q"), F.expr("p.t = q.t AND p.n <= q.n")).select(F.col("q.id").alias(a), F.col("p.id").alias(b))
    met = one.union(two).distinct().join(left.select(a, F.col(words).alias("_x")), a).join(right.select(b, F.col(words).alias("_y")), b)
    both, least = F.size(F.array_intersect("_x", "_y")), F.least(F.size("_x"), F.size("_y"))
    return met.where(under * both >= over * least).select(a, b, (both / least).alias("containment"))
