"""Registered queries answer for all of their input, not a share of it."""

import __spark_entry__ as entry
from tests.test_queries import SMALL


def test_gbt_score_has_a_row_for_every_document(spark):
    got = entry.queries()["gbt_score"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(r["label"] == known.get(r["doc_id"]) and 0 <= r["prob"] <= 1 for r in got)
    assert {r["held_out"] for r in got} == {True, False}


def test_tuned_knobs_is_the_best_of_the_whole_grid(spark, monkeypatch):
    from samewise.operators import decide

    sizes, plain = [], decide.scored_grid
    monkeypatch.setattr(decide, "scored_grid", lambda pairs, entities, links, grid, p="prob": sizes.append(grid.count()) or plain(pairs, entities, links, grid, p))
    (r,) = entry.queries()["tuned_knobs"](spark, SMALL).collect()
    assert sizes == [3480]
    assert r["tau_empty"] in decide.TAUS and r["tau_abs"] in decide.TAUS and r["alpha"] in decide.ALPHAS
