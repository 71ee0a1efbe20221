"""Nearest vectors of a label: matrices within tasks give what a table of all pairs gives."""

import contextlib
import io
import math
import random

from pyspark.sql import functions as F

from samewise.functions import fuzzy
from samewise.operators import nearest, retrieve

SCHEMA = "id long, label int, vector array<float>"


def test_cosine_top_is_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAST", 60)
    monkeypatch.setattr(nearest, "CELLS", 200)
    r = random.Random(10)
    vectors = [[r.gauss(0, 1) for _ in range(6)] for _ in range(200)]
    vectors += [vectors[i % 5] for i in range(100)]  # copies tie
    rows = [(i * 7 % 301, i % 3, v) for i, v in enumerate(vectors)] + [(900, 1, None), (901, 2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (905, 0, []), (902, 1, [1.0]), (903, None, vectors[0]), (904, 9, vectors[0])]
    e = spark.createDataFrame(rows, SCHEMA)
    a, b = e.select(F.col("id").alias("source1_entity_id"), F.col("vector").alias("x"), "label"), e.select(F.col("id").alias("cand_id"), F.col("vector").alias("y"), "label")
    pairs = a.join(b, "label").where("source1_entity_id <> cand_id").select("source1_entity_id", "cand_id", F.round(fuzzy.cosine(F.col("x"), F.col("y")), 6).alias("emb_cos"))
    pairs = pairs.where("source1_entity_id <> 905 AND cand_id <> 905")  # Spark has no quotient there
    order = lambda df: sorted((x[0], x[1], x[2] is None, x[2] or 0.0) for x in df.collect())
    assert order(retrieve.top_k(nearest.cosine_top(e, 4).where("source1_entity_id <> 905 AND cand_id <> 905"), 4, "emb_cos")) == order(retrieve.top_k(pairs, 4, "emb_cos"))


def test_vectors_of_no_length_come_first_as_nan(spark):
    e = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [1.0, 1.0])], SCHEMA)
    got = {(x[0], x[1]): x[2] for x in retrieve.top_k(nearest.cosine_top(e, 1), 1, "emb_cos").collect()}
    assert set(got) == {(1, 2), (2, 1), (3, 1)} and all(math.isnan(x) for x in got.values())


def test_cosine_top_makes_no_table_of_pairs(spark):
    import __spark_entry__ as entry
    from tests.test_queries import SMALL

    with contextlib.redirect_stdout(out := io.StringIO()):
        entry.queries()["emb_cosine_topk"](spark, SMALL).explain()
    assert "CoGroupsInArrow" in out.getvalue() and "Join" not in out.getvalue()
