"""Scores of link sets, per entity and over all; recall of candidates; profiles of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY, CAND = "source1_entity_id", "cand_id"


def f_beta(tp: Column, n_pred: Column, n_true: Column, beta2: float = 0.25) -> Column:
    """1 if both sets are empty, 0 if one is or nothing is common; else F with the square of beta given."""
    p, r = tp / F.greatest(n_pred, F.lit(1)), tp / F.greatest(n_true, F.lit(1))
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise((1 + beta2) * p * r / (beta2 * p + r))


def per_entity(predicted: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, n_pred, n_true, tp, f) for every entity."""
    a = predicted.select(ENTITY, CAND).distinct().withColumn("p", F.lit(1))
    b = links.select(ENTITY, CAND).distinct().withColumn("t", F.lit(1))
    both = a.join(b, [ENTITY, CAND], "full").groupBy(ENTITY).agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    out = entities.select(ENTITY).distinct().join(both, ENTITY, "left").fillna(0, ["n_pred", "n_true", "tp"])
    return out.withColumn("f", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f(predicted: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    return per_entity(predicted, links, entities).agg(F.avg("f").alias("macro_f"))


def report(predicted: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: macro F of all, of entities without and with links; errors; counts, precision, recall and F over links."""
    single, some = F.col("n_true") == 0, F.col("n_true") > 0
    out = per_entity(predicted, links, entities).agg(
        F.count("*").alias("n_entities"), F.avg("f").alias("macro_f"), F.avg(F.when(single, F.col("f"))).alias("f_singleton"), F.avg(F.when(some, F.col("f"))).alias("f_linked"),
        F.count_if(single).alias("n_singleton"), F.count_if(single & (F.col("n_pred") > 0)).alias("false_merges"), F.count_if(some & (F.col("tp") == 0)).alias("missed_all"),
        F.sum("tp").alias("tp"), (F.sum("n_pred") - F.sum("tp")).alias("fp"), (F.sum("n_true") - F.sum("tp")).alias("fn"),
    )
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return out.withColumns({"link_p": p, "link_r": r, "link_f": F.coalesce(F.try_divide(1.25 * p * r, 0.25 * p + r), F.lit(0.0))})


def recall_ceiling(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """One row: links, links among the pairs, their share; entities with links, of these all or some of whose links are among the pairs."""
    found = pairs.select(ENTITY, CAND).distinct().withColumn("x", F.lit(1))
    own = links.select(ENTITY, CAND).distinct().join(found, [ENTITY, CAND], "left").groupBy(ENTITY).agg(F.count("*").alias("n"), F.count("x").alias("hit"))
    return own.agg(F.sum("n").alias("n_links"), F.sum("hit").alias("n_found"), (F.sum("hit") / F.sum("n")).alias("link_recall"), F.count("*").alias("n_linked"), F.count_if(F.col("hit") == F.col("n")).alias("fully"), F.count_if((F.col("hit") > 0) & (F.col("hit") < F.col("n"))).alias("partly"))


def oracle_ceiling(pairs: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Macro F of the decision that keeps just the true pairs among the candidates."""
    return macro_f(pairs.join(links.select(ENTITY, CAND).distinct(), [ENTITY, CAND], "left_semi"), links, entities)


def reduction_ratio(pairs: DataFrame, n_left: int, n_right: int) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_pairs"), (1 - F.count("*") / F.lit(float(max(n_left * n_right, 1)))).alias("reduction_ratio"))


def profile_records(records: DataFrame) -> DataFrame:
    """Per source and country: records, blank names and addresses, distinct ids."""
    return records.groupBy(F.substring("entity_id", 1, 2).alias("source"), "country_key").agg(F.count("*").alias("n"), F.count_if(F.trim("business_name") == "").alias("blank_names"), F.count_if(F.trim("business_address") == "").alias("blank_addresses"), F.count_distinct("entity_id").alias("n_ids"))


def profile_links(links: DataFrame, entities: DataFrame, right: DataFrame) -> DataFrame:
    """One row: sizes of link sets, links by source, candidates claimed twice, records of the right side without a link."""
    n = links.groupBy(ENTITY).agg(F.count("*").alias("k"))
    sizes = entities.select(ENTITY).distinct().join(n, ENTITY, "left").fillna(0, ["k"]).agg(F.count("*").alias("n_entities"), F.count_if(F.col("k") == 0).alias("singletons"), F.sum("k").alias("n_links"), F.avg("k").alias("mean_links"), F.percentile("k", F.lit(0.5)).alias("median_links"), F.max("k").alias("max_links"))
    reuse = links.groupBy(CAND).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("reused_ids"))
    by = links.agg(F.count_if(F.col(CAND).startswith("S2-")).alias("links_s2"), F.count_if(F.col(CAND).startswith("S3-")).alias("links_s3"))
    free = right.join(links.select(F.col(CAND).alias("entity_id")), "entity_id", "left_anti").agg(F.count("*").alias("unlinked_right"))
    return sizes.join(reuse, F.lit(True)).join(by, F.lit(True)).join(free, F.lit(True))


def profile_sizes(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(n_links, n_entities): how many entities have how many links."""
    n = links.groupBy(ENTITY).agg(F.count("*").alias("k"))
    return entities.select(ENTITY).distinct().join(n, ENTITY, "left").fillna(0, ["k"]).groupBy(F.col("k").alias("n_links")).agg(F.count("*").alias("n_entities"))


def profile_countries(links: DataFrame, entities: DataFrame, by: str = "country_key") -> DataFrame:
    """Per country of the first source: entities, the share of them without a link, mean and largest number of links. Entities need the column."""
    n = links.groupBy(ENTITY).agg(F.count("*").alias("k"))
    own = entities.select(ENTITY, by).distinct().join(n, ENTITY, "left").fillna(0, ["k"])
    return own.groupBy(by).agg(F.count("*").alias("n_entities"), F.avg((F.col("k") == 0).cast("double")).alias("singleton_rate"), F.avg("k").alias("mean_links"), F.max("k").alias("max_links"))
