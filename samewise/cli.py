"""Command line: each step reads and writes files, as in `python -m samewise.cli block --folder data --split test`.

A folder holds <split>_source{1,2,3}.tsv and train_ground_truth.tsv; what the steps make goes to <folder>/work.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import decide, features, keys, merge, metrics, model, ranks, retrieve, tfidf, validate
from .sources import records as rec


class Work:
    """Paths and tables of one folder and split."""

    def __init__(self, spark: SparkSession, folder: str, split: str) -> None:
        self.spark, self.folder, self.split = spark, folder.rstrip("/"), split
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir") or self.path("checkpoints"))

    def path(self, name: str) -> str:
        return f"{self.folder}/work/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))

    def records(self, source: int) -> DataFrame:
        return self.read(f"{self.split}_norm{source}")

    def sides(self) -> tuple[DataFrame, DataFrame]:
        return self.records(1), self.records(2).unionByName(self.records(3))

    def searched(self, sample: int = 0):
        left, right = self.sides()
        left = left.orderBy("entity_id").limit(sample) if sample else left
        return left, right, keys.record_keys(left), keys.record_keys(right)

    def links(self) -> DataFrame:
        return rec.links(rec.ground_truth(self.spark, f"{self.folder}/train_ground_truth.tsv"))

    def entities(self) -> DataFrame:
        return self.records(1).select(F.col("entity_id").alias("source1_entity_id"))


def inspect(w: Work, a) -> None:
    for k in (1, 2, 3):
        metrics.profile_records(rec.source(w.spark, f"{w.folder}/{w.split}_source{k}.tsv")).show(100, False)
    if w.split == "train":
        metrics.profile_links(w.links(), w.entities(), w.sides()[1]).show(truncate=False)
        metrics.profile_sizes(w.links(), w.entities()).orderBy("n_links").show()
        metrics.profile_countries(w.links(), w.records(1).select(F.col("entity_id").alias("source1_entity_id"), "country_key")).show()


def prep(w: Work, a) -> None:
    for k in (1, 2, 3):
        rec.prepare(w.spark, f"{w.folder}/{w.split}_source{k}.tsv", w.path(f"{w.split}_norm{k}"))


def tokidf(w: Work, a) -> None:
    left, right = w.sides()
    df, n = retrieve.token_df(left.select("n_name").unionAll(right.select("n_name")), "n_name")
    w.write(df.join(n, F.lit(True)), f"{w.split}_token_df")


def block(w: Work, a) -> None:
    left, right, lk, rk = w.searched(a.sample)
    pairs = retrieve.forward(left, right, lk, rk, k=a.wide or a.top_k)
    if a.wide:
        pairs = retrieve.rescored(pairs, left.unionByName(right), a.top_k)
    w.write(pairs, a.out or f"{w.split}_forward")
    if w.split == "train":
        metrics.recall_ceiling(w.read(a.out or f"{w.split}_forward"), w.links()).show(truncate=False)


def reverse(w: Work, a) -> None:
    w.write(retrieve.reverse(*w.searched(a.sample), k=a.rev_k), a.out or f"{w.split}_reverse")


def merge_cands(w: Work, a) -> None:
    forward, back = w.read(a.fwd or f"{w.split}_forward"), w.read(a.rev or f"{w.split}_reverse")
    w.write(merge.union(forward, merge.restricted(back, forward), a.fwd_k, a.rev_k), a.out or f"{w.split}_union")
    merge.provenance(w.read(a.out or f"{w.split}_union")).show(truncate=False)


def competition(w: Work, a) -> None:
    from .functions import fuzzy

    left, right = w.sides()
    pairs = merge.with_attributes(ranks.competition(w.read(a.cands or f"{w.split}_union")), left.unionByName(right), ["s_name"])
    pairs = ranks.name_competition(pairs.withColumn("_s", fuzzy.kernel("token_set")("l_s_name", "r_s_name")), "_s")
    w.write(pairs.drop("_s", "l_s_name", "r_s_name"), a.out or f"{w.split}_cands")


def multiview(w: Work, a) -> None:
    w.write(retrieve.multi_view(*w.searched(a.sample), ks={"name": a.k_name, "addr": a.k_addr, "both": a.k_both}), a.out or f"{w.split}_multiview")


def tfidf_views(w: Work, a) -> None:
    left, right = (t.withColumn("blob", F.trim(F.concat_ws(" ", "n_name", "n_addr"))) for t in w.sides())
    found = []
    for view, column, how, k in (("name", "n_name", "char_wb3", a.k_name), ("nospace", "n_name", "char3", a.k_nospace), ("addr", "n_addr", "word", a.k_addr), ("hybrid", "blob", "char_wb3", a.k_hybrid)):
        best = ranks.competition(tfidf.tfidf_top(left, right, column, how, k).withColumnRenamed("sim", "sim_block"))
        found.append(best.select("source1_entity_id", "cand_id", "sim_block", F.lit(0).alias("rank"), F.lit(view).alias("view")))
    w.write(retrieve.merged_views(found, ["name", "nospace", "addr", "hybrid"]), a.out or f"{w.split}_tfidf")


def featured(w: Work, a) -> DataFrame:
    left, right = w.sides()
    return features.pair_features(w.read(a.cands or f"{w.split}_cands"), left.unionByName(right))


def train(w: Work, a) -> None:
    w.write(merge.labelled(featured(w, a), w.links()), "train_features")
    rows = w.read("train_features")
    names = [c for c in rows.columns if c not in ("source1_entity_id", "cand_id", "label")]
    held = model.held_out(F.col("source1_entity_id"))
    fitted = model.PairModel.fit(rows.where(~held), names, rounds=a.rounds)
    fitted.save(w.path("model"))
    w.write(fitted.transform(rows.where(held)).select("source1_entity_id", "cand_id", "prob"), "valid_scored")
    scored, some = w.read("valid_scored"), w.entities().where(held)
    links = w.links().join(some, "source1_entity_id", "left_semi")
    knobs, score = decide.tune(scored, some, links)
    gamma, tau, both = decide.tune_hybrid(scored, some, links, decide.TAUS[::4])
    state = {"features": names, "knobs": asdict(knobs), "macro_f": score, "hybrid": {"gamma": gamma, "tau_empty": tau, "macro_f": both}}
    keep_state(w, state, "knobs")
    if edge := decide.at_edge(knobs):
        print("at the edge of its grid: " + ", ".join(edge))
    metrics.report(decide.threshold(scored, knobs), links, some).show(truncate=False, vertical=True)
    for name, gain in fitted.importance():
        print(f"{gain:.4f} {name}")


def state_of(w: Work, name: str = "knobs") -> dict:
    return json.loads(w.spark.read.text(w.path(name)).first()["value"])


def keep_state(w: Work, state: dict, name: str) -> None:
    w.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(w.path(name))


def decided(w: Work, scored: DataFrame, state: dict, stacked: bool = False) -> None:
    """Scores written, cut at the floor where thresholds decide, and the results from them."""
    knobs, hybrid = decide.Knobs(**state["knobs"]), state["hybrid"]
    by_f = hybrid["macro_f"] > state["macro_f"]
    w.write(scored if by_f else scored.where(F.col("prob") >= decide.probability_floor(knobs, stacked)), f"{w.split}_scored")
    scored = w.read(f"{w.split}_scored")
    links = decide.hybrid(scored, hybrid["gamma"], hybrid["tau_empty"], knobs.one_to_one) if by_f else decide.threshold(scored, knobs)
    left, right = w.sides()
    rec.write_results(rec.results(left, right, links, scored), w.path("matching_results"), w.path("candidate_pairs"))


def predict(w: Work, a) -> None:
    state = state_of(w)
    fitted = model.PairModel.load(w.path("model"), state["features"])
    decided(w, fitted.transform(featured(w, a)).select("source1_entity_id", "cand_id", "prob"), state)


def with_texts(w: Work, pairs: DataFrame) -> DataFrame:
    """Pairs with the skeleton and address of the candidate, which the second stage compares."""
    own = w.sides()[1].select(F.col("entity_id").alias("cand_id"), "s_name", "n_addr")
    return pairs.join(own, "cand_id")


def embfeat(w: Work, a) -> None:
    """Cosines of the vectors in <folder>/work/<split>_vectors (entity_id, vector), beside the candidates."""
    name = a.cands or f"{w.split}_cands"
    w.write(features.embedding_cosine(w.read(name), w.read(f"{w.split}_vectors")), a.out or f"{name}_emb")


def stack(w: Work, a) -> None:
    """Fits both stages on entities not held out, and tunes the decision on those that are."""
    w.write(merge.labelled(featured(w, a), w.links()), "train_features")
    rows = with_texts(w, w.read("train_features"))
    names = [c for c in rows.columns if c not in ("source1_entity_id", "cand_id", "label", "s_name", "n_addr")]
    held = model.held_out(F.col("source1_entity_id"))
    first, second = model.fit_stack(rows.where(~held), names, rounds=a.rounds)
    first.save(w.path("stack_first"))
    second.save(w.path("stack_second"))
    w.write(model.predict_stack(rows.where(held), first, second).select("source1_entity_id", "cand_id", "prob"), "valid_stacked")
    scored, some = w.read("valid_stacked"), w.entities().where(held)
    links = w.links().join(some, "source1_entity_id", "left_semi")
    knobs, score = decide.tune(scored, some, links)
    gamma, tau, both = decide.tune_hybrid(scored, some, links, decide.TAUS[::4])
    keep_state(w, {"features": names, "knobs": asdict(knobs), "macro_f": score, "hybrid": {"gamma": gamma, "tau_empty": tau, "macro_f": both}}, "stack_knobs")


def predict_stack(w: Work, a) -> None:
    state = state_of(w, "stack_knobs")
    first = model.PairModel.load(w.path("stack_first"), state["features"])
    second = model.PairModel.load(w.path("stack_second"), [*state["features"], *model.STACKED])
    decided(w, model.predict_stack(with_texts(w, featured(w, a)), first, second).select("source1_entity_id", "cand_id", "prob"), state, stacked=True)


def run_pipeline(w: Work, a) -> None:
    """From sources to checked results in one call: candidates, model on the train split, results of the split asked for."""
    for split in dict.fromkeys(("train", w.split)):
        own = Work(w.spark, w.folder, split)
        for step in (prep, block, reverse, merge_cands, competition):
            step(own, a)
    (stack if a.stacked else train)(Work(w.spark, w.folder, "train"), a)
    (predict_stack if a.stacked else predict)(w, a)
    check(w, a)


def check(w: Work, a) -> None:
    read = lambda p: rec.tsv(w.spark, p).toDF("source1_entity_id", "ids")
    m, c = a.matching or w.path("matching_results"), a.candidate or w.path("candidate_pairs")
    form = validate.lines(w.spark, m, "matching").unionByName(validate.lines(w.spark, c, "candidate"))
    if not validate.exit_code(form):
        known = w.sides()[1].select("entity_id") if a.check_ids else None
        for p in (m, c):
            form = form.unionByName(validate.check_lists(read(p), w.entities(), known))
        form = form.unionByName(validate.check_subset(read(m), read(c)))
    validate.summary(form).show(100, False)
    sys.exit(validate.exit_code(form))


STEPS = {f.__name__: f for f in (inspect, prep, tokidf, block, reverse, merge_cands, competition, multiview, tfidf_views, embfeat, train, predict, stack, predict_stack, run_pipeline, check)}


def parsed(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="samewise", description=__doc__)
    p.add_argument("step", choices=STEPS)
    p.add_argument("--folder", default=".")
    p.add_argument("--split", default="train")
    p.add_argument("--sample", type=int, default=0)
    p.add_argument("--top-k", type=int, default=25)
    p.add_argument("--wide", type=int, default=0)
    p.add_argument("--fwd-k", type=int, default=60)
    p.add_argument("--rev-k", type=int, default=3)
    for name, k in (("name", 40), ("addr", 40), ("both", 40), ("nospace", 20), ("hybrid", 40)):
        p.add_argument(f"--k-{name}", type=int, default=k)
    p.add_argument("--rounds", type=int, default=60)
    for name in ("out", "fwd", "rev", "cands", "matching", "candidate"):
        p.add_argument(f"--{name}")
    p.add_argument("--check-ids", action="store_true")
    p.add_argument("--stacked", action="store_true")
    return p.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parsed(args)
    spark = spark or SparkSession.builder.appName("samewise").getOrCreate()
    STEPS[a.step](Work(spark, a.folder, a.split), a)


if __name__ == "__main__":
    main()
