"""Training and scoring of the pair model: gradient-boosted trees of Spark ML, splits by hashed id, stacking.

Spark's trees take no missing values, so a null becomes -1 and a flag beside it. Encoders and cross-encoders
need weights that are not here; `scorer` takes any function over batches of text pairs in their place.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import sibling_support
from .ranks import probability_context

ENTITY, CAND = "source1_entity_id", "cand_id"
STACKED = ("p1", "sib_max", "sib_sum", "sib_cnt", "sib_sim", "p1_rel", "p1_gap", "p1_mass")


def held_out(entity: Column, share: float = 0.2, seed: int = 42) -> Column:
    """Whether an entity belongs to the held-out share; all its pairs go with it."""
    return F.pmod(F.xxhash64(entity, F.lit(seed)), F.lit(1000)) < int(share * 1000)


def fold(entity: Column, n: int = 3) -> Column:
    """The number in the id modulo n."""
    return F.pmod(F.substring_index(entity, "-", -1).cast("long"), F.lit(n)).cast("int")


def filled(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    out = df.withColumns({f"{c}_isna": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in features})
    return out.withColumns({c: F.when(F.col(f"{c}_isna") == 1, -1.0).otherwise(F.col(c).cast("double")) for c in features}), [*features, *[f"{c}_isna" for c in features]]


class PairModel:
    """Trees over named features."""

    def __init__(self, features: list[str], trees: Transformer) -> None:
        self.features, self.trees = features, trees

    @classmethod
    def fit(cls, pairs: DataFrame, features: list[str], rounds: int = 60, depth: int = 5, rate: float = 0.1, least: int = 20, label: str = "label", valid: Column | None = None, seed: int = 42) -> PairModel:
        """valid: the rows on which boosting stops once the loss no longer falls."""
        rows, inputs = filled(pairs, features)
        rows = VectorAssembler(inputCols=inputs, outputCol="_x").transform(rows).withColumn(label, F.col(label).cast("double"))
        gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, maxBins=255, minInstancesPerNode=least, subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=seed)
        if valid is not None:
            rows = rows.withColumn("_valid", valid)
            gbt = gbt.setValidationIndicatorCol("_valid")
        return cls(features, gbt.fit(rows))

    def transform(self, pairs: DataFrame, out: str = "prob") -> DataFrame:
        rows, inputs = filled(pairs, self.features)
        rows = VectorAssembler(inputCols=inputs, outputCol="_x").transform(rows.select(*[c for c in pairs.columns if c not in self.features], *inputs))
        scored = self.trees.transform(rows).withColumn(out, vector_to_array("probability")[1])
        restored = [F.when(F.col(f"{c}_isna") == 1, F.lit(None)).otherwise(F.col(c)).alias(c) for c in self.features]
        return scored.select(*[c for c in pairs.columns if c not in self.features], *restored, out)

    def importance(self, top: int = 20) -> list[tuple[str, float]]:
        names = [*self.features, *[f"{c}_isna" for c in self.features]]
        return sorted(zip(names, self.trees.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:top]

    def save(self, path: str) -> None:
        PipelineModel([self.trees]).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, features: list[str]) -> PairModel:
        return cls(features, PipelineModel.load(path).stages[0])


def stacked(pairs: DataFrame) -> DataFrame:
    """Adds the second stage's features from the first stage's probability p1; pairs need s_name and n_addr of the candidate."""
    return probability_context(sibling_support(pairs))


def fit_stack(pairs: DataFrame, features: list[str], folds: int = 3, first_rounds: int = 30, **how) -> tuple[PairModel, PairModel]:
    """First and second stage: the second sees first-stage probabilities of models that did not see the entity."""
    k, one = fold(F.col(ENTITY), folds), how | {"rounds": first_rounds}
    parts = [PairModel.fit(pairs.where(k != f), features, **one).transform(pairs.where(k == f), "p1") for f in range(folds)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    second = PairModel.fit(stacked(rows.checkpoint()), [*features, *STACKED], **how)
    return PairModel.fit(pairs, features, **one), second


def predict_stack(pairs: DataFrame, first: PairModel, second: PairModel) -> DataFrame:
    return second.transform(stacked(first.transform(pairs, "p1")))


def hard_negatives(pairs: DataFrame, n: int, p: str = "prob") -> DataFrame:
    """The n unlabelled pairs with the highest scores."""
    return pairs.where("label = 0").orderBy(F.col(p).desc_nulls_last(), ENTITY, CAND).limit(n)


def scorer(pairs: DataFrame, left: str, right: str, score: Callable[[list[str], list[str]], list[float]], top: int = 10, order: str = "sim_block", out: str = "ce_score") -> DataFrame:
    """Adds the score of an outside text-pair model for each entity's `top` pairs, null for the others."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(score(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    w = Window.partitionBy(ENTITY).orderBy(F.col(order).desc_nulls_last(), F.col(CAND))
    ranked = pairs.withColumn("_k", F.row_number().over(w))
    scored = ranked.where(F.col("_k") <= top).withColumn(out, run(left, right))
    return scored.unionByName(ranked.where(F.col("_k") > top).withColumn(out, F.lit(None).cast("double"))).drop("_k")
