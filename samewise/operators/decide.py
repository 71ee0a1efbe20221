"""From scored pairs to a set of links per entity: thresholds, expected F, one-to-one assignment, and tuning.

Pairs are (source1_entity_id, cand_id, prob). Decisions are windows over the entity; tuning works on counts per
level of probability, and the metric's parts combine before they shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import f_beta

ENTITY, CAND = "source1_entity_id", "cand_id"
#: The grids that are searched.
TAUS = [round(k / 40, 3) for k in range(4, 33)]
ALPHAS = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
GAMMAS = [0.8, 0.9, 1.0, 1.05, 1.1, 1.15, 1.2, 1.3, 1.5, 1.8]


@dataclass(frozen=True)
class Knobs:
    tau_empty: float = 0.6
    tau_abs: float = 0.425
    alpha: float = 0.7
    one_to_one: bool = False


def one_to_one(links: DataFrame, p: str = "prob") -> DataFrame:
    """Of the claims on a candidate only the best stays; ties go to the smaller entity id."""
    w = Window.partitionBy(CAND).orderBy(F.col(p).desc_nulls_last(), F.col(ENTITY))
    return links.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def threshold(pairs: DataFrame, knobs: Knobs = Knobs(), p: str = "prob") -> DataFrame:
    """Pairs at max(tau_abs, alpha * best) and more, of entities whose best reaches tau_empty."""
    best = F.max(p).over(Window.partitionBy(ENTITY))
    kept = pairs.withColumn("_best", best).where((F.col("_best") >= knobs.tau_empty) & (F.col(p) >= F.greatest(F.lit(knobs.tau_abs), knobs.alpha * F.col("_best")))).drop("_best")
    return one_to_one(kept, p) if knobs.one_to_one else kept


def threshold_by(pairs: DataFrame, knobs: DataFrame, fallback: Knobs, by: str = "country_key", p: str = "prob") -> DataFrame:
    """threshold() with knobs (by, tau_empty, tau_abs, alpha) of each group, the fallback where there are none."""
    k = knobs.select(by, *[F.col(c).alias(f"_{c}") for c in ("tau_empty", "tau_abs", "alpha")])
    best = F.max(p).over(Window.partitionBy(ENTITY))
    own = {c: F.coalesce(f"_{c}", F.lit(getattr(fallback, c))) for c in ("tau_empty", "tau_abs", "alpha")}
    rows = pairs.join(k, by, "left").withColumns(own).withColumn("_best", best)
    kept = rows.where((F.col("_best") >= F.col("tau_empty")) & (F.col(p) >= F.greatest("tau_abs", F.col("alpha") * F.col("_best")))).select(*pairs.columns)
    return one_to_one(kept, p) if fallback.one_to_one else kept


def expected_f(pairs: DataFrame, gamma: float | Column = 1.15, min_p: float = 0.02, tau_empty: float | None = None, p: str = "prob", by: tuple[str, ...] = (ENTITY,)) -> DataFrame:
    """Pairs of the set size with the largest expected F0.5 (the largest size within 1e-12 of it).

    Expected true links are gamma times the sum of probabilities. An entity predicts nothing if its best is no
    larger than the chance that it has no link, or, with tau_empty, if its best probability is below that.
    """
    w = Window.partitionBy(*by)
    order = w.orderBy(F.col(p).desc(), F.col(CAND))
    rows = pairs.where(F.col(p) >= min_p).withColumns({"_k": F.row_number().over(order), "_tp": F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(p).over(w), "_none": F.exp(F.sum(F.log(F.greatest(1 - F.col(p), F.lit(1e-12)))).over(w)), "_p1": F.max(p).over(w)})
    size, found = F.col("_tp") / F.col("_k"), F.col("_tp") / F.greatest(gamma * F.col("_all"), F.lit(1e-9))
    rows = rows.withColumn("_f", F.coalesce(F.try_divide(1.25 * size * found, 0.25 * size + found), F.lit(0.0)))
    rows = rows.withColumn("_best", F.max("_f").over(w))
    rows = rows.withColumn("_last", F.max(F.when(F.col("_f") >= F.col("_best") - 1e-12, F.col("_k"))).over(w))
    some = F.col("_best") > F.col("_none") if tau_empty is None else F.col("_p1") >= tau_empty
    return rows.where((F.col("_k") <= F.col("_last")) & some).drop("_k", "_tp", "_all", "_none", "_p1", "_f", "_best", "_last")


def hybrid(pairs: DataFrame, gamma: float, tau_empty: float, assign: bool = True) -> DataFrame:
    """Whether to predict by the gate, how many by expected F; conflicts by probability."""
    links = expected_f(pairs, gamma, tau_empty=tau_empty)
    return one_to_one(links) if assign else links


def truth_counts(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(entity, n_true) for every entity, those without links included."""
    n = links.select(ENTITY, CAND).distinct().groupBy(ENTITY).agg(F.count("*").alias("n_true"))
    return entities.select(ENTITY).distinct().join(n, ENTITY, "left").fillna(0, ["n_true"])


def scored_grid(pairs: DataFrame, entities: DataFrame, links: DataFrame, grid: DataFrame, p: str = "prob") -> DataFrame:
    """(tau_empty, tau_abs, alpha, macro_f) for each row of the grid, which is small and of a fixed size.

    A pair counts under a threshold if its level, the number of thresholds it reaches, is high enough; so what an entity
    predicts follows from its counts per level, summed from the top, once per alpha. Whether it predicts follows from the
    level of its best alone. No pair meets the grid; sums per alpha and two levels do.
    """
    values = {c: sorted({r[c] for r in grid.select(c).collect()}) for c in ("tau_empty", "tau_abs", "alpha")}

    def level(c: str, of: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, of)), lambda t: t <= F.col(c)))

    def place(c: str) -> Column:
        return F.array_position(F.array(*map(F.lit, values[c])), F.col(c))

    true = links.select(ENTITY, CAND).distinct().withColumn("y", F.lit(1))
    rows = pairs.select(ENTITY, CAND, F.col(p).alias("p")).join(true, [ENTITY, CAND], "left").fillna(0, ["y"]).withColumn("best", F.max("p").over(Window.partitionBy(ENTITY)))
    rows = rows.withColumns({"_at": level("p", values["tau_abs"]), "_from": level("best", values["tau_empty"])}).where("_at > 0 AND _from > 0")
    rows = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, values["alpha"])))).where("p >= alpha * best")
    by = rows.groupBy(ENTITY, "alpha", "_at").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.max("_from").alias("_from"))
    w = Window.partitionBy(ENTITY, "alpha").orderBy(F.col("_at").desc())
    above = w.rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumns({"n_pred": F.sum("n").over(above), "tp": F.sum("y").over(above), "_next": F.coalesce(F.lead("_at").over(w), F.lit(0))})
    counts = truth_counts(entities, links)
    by = by.join(counts, ENTITY).withColumn("f", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    by = by.withColumn("_abs", F.explode(F.sequence(F.col("_next") + 1, F.col("_at"))))
    sums = by.groupBy("alpha", "_abs", "_from").agg(F.sum("f").alias("s"), F.count_if(F.col("n_true") == 0).alias("lost"))
    asked = grid.withColumns({"_abs": place("tau_abs"), "_empty": place("tau_empty")})
    sums = asked.join(sums, ["alpha", "_abs"]).where("_from >= _empty").groupBy("tau_empty", "tau_abs", "alpha").agg(F.sum("s").alias("s"), F.sum("lost").alias("lost"))
    every = counts.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("empty"))
    out = grid.join(sums, ["tau_empty", "tau_abs", "alpha"], "left").fillna({"s": 0.0, "lost": 0}).join(F.broadcast(every), F.lit(True))
    return out.select("tau_empty", "tau_abs", "alpha", ((F.col("s") + F.col("empty") - F.col("lost")) / F.col("n")).alias("macro_f"))


def knob_grid(spark, taus: list[float] = TAUS, alphas: list[float] = ALPHAS) -> DataFrame:
    return spark.createDataFrame([(e, a, x) for e in taus for a in taus if a <= e for x in alphas], "tau_empty double, tau_abs double, alpha double")


def tune(pairs: DataFrame, entities: DataFrame, links: DataFrame, taus: list[float] = TAUS, alphas: list[float] = ALPHAS, retry: int = 10) -> tuple[Knobs, float]:
    """The knobs with the largest macro F0.5; equal ones by larger tau_empty, tau_abs, alpha.

    The best `retry` are tried with one-to-one assignment too, which has to be better to be chosen.
    """
    from .metrics import macro_f

    grid = knob_grid(pairs.sparkSession, taus, alphas)
    top = scored_grid(pairs, entities, links, grid).orderBy(F.round("macro_f", 12).desc(), F.col("tau_empty").desc(), F.col("tau_abs").desc(), F.col("alpha").desc()).limit(retry).collect()
    chosen, best = Knobs(top[0]["tau_empty"], top[0]["tau_abs"], top[0]["alpha"]), top[0]["macro_f"]
    for r in top:
        own = Knobs(r["tau_empty"], r["tau_abs"], r["alpha"], True)
        score = macro_f(threshold(pairs, own), links, entities).first()["macro_f"]
        if score > best + 1e-12:
            chosen, best = own, score
    return chosen, best


def at_edge(knobs: Knobs, taus: list[float] = TAUS, alphas: list[float] = ALPHAS) -> list[str]:
    """Names of the knobs whose chosen value is the first or last of its grid, so that a better one may lie outside."""
    ends = {"tau_empty": (min(taus), max(taus)), "tau_abs": (min(taus), max(taus)), "alpha": (min(alphas), max(alphas))}
    return [k for k, own in ends.items() if getattr(knobs, k) in own]


def tune_by(pairs: DataFrame, entities: DataFrame, links: DataFrame, by: str = "country_key", least: int = 200, **grid) -> tuple[dict[str, Knobs], Knobs]:
    """Knobs of each group with `least` entities or more, and those of all for the rest. Entities need the group column."""
    whole, _ = tune(pairs, entities, links, **grid)
    groups = [r[by] for r in entities.groupBy(by).count().where(F.col("count") >= least).collect()]
    own = {}
    for g in groups:
        some = entities.where(F.col(by) == g)
        own[g] = replace(tune(pairs.join(some, ENTITY, "left_semi"), some, links.join(some, ENTITY, "left_semi"), **grid)[0], one_to_one=whole.one_to_one)
    return own, whole


def gamma_scores(pairs: DataFrame, entities: DataFrame, links: DataFrame, gammas: list[float] = GAMMAS, tau_empty: float | None = None, min_p: float = 0.02) -> DataFrame:
    """(gamma, macro_f) for each gamma: the pairs are repeated once per gamma and decided together."""
    spread = pairs.select(ENTITY, CAND, "prob", F.explode(F.array(*[F.lit(float(g)) for g in gammas])).alias("gamma"))
    kept = expected_f(spread, F.col("gamma"), min_p, tau_empty, by=(ENTITY, "gamma"))
    true = links.select(ENTITY, CAND).distinct().withColumn("y", F.lit(1))
    hit = kept.join(true, [ENTITY, CAND], "left").groupBy("gamma", ENTITY).agg(F.count("*").alias("n_pred"), F.sum(F.coalesce("y", F.lit(0))).alias("tp"))
    counts = truth_counts(entities, links)
    sums = hit.join(counts, ENTITY).withColumn("f", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"))).groupBy("gamma").agg(F.sum("f").alias("s"), F.count_if(F.col("n_true") == 0).alias("lost"))
    every = counts.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("empty"))
    return sums.join(F.broadcast(every), F.lit(True)).select("gamma", ((F.col("s") + F.col("empty") - F.col("lost")) / F.col("n")).alias("macro_f"))


def tune_hybrid(pairs: DataFrame, entities: DataFrame, links: DataFrame, taus: list[float] = TAUS, gammas: list[float] = GAMMAS) -> tuple[float, float, float]:
    """(gamma, tau_empty, macro_f) with the largest macro F0.5."""
    found = [(r["macro_f"], t, r["gamma"]) for t in taus for r in gamma_scores(pairs, entities, links, gammas, t).collect()]
    f, t, g = max(found)
    return g, t, f


def probability_floor(knobs: Knobs, stacked: bool = False) -> float:
    """A probability below which no pair matters to threshold decisions; what predictions are cut at before they are written.

    Not for expected F, which sums the small probabilities too.
    """
    return 0.4 * min(knobs.tau_empty, 0.5) if stacked else 0.5 * min(knobs.tau_abs, knobs.tau_empty)
