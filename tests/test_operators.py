import random

import pytest
from pyspark.sql import functions as F

from samewise import cli
from samewise.operators import cluster, decide, keys, merge, metrics, model, ranks, retrieve, tfidf, validate
from samewise.sources import records as rec
from samewise.functions import text


def pairs_of(spark, rows, schema="source1_entity_id string, cand_id string, prob double"):
    return spark.createDataFrame(rows, schema)


def test_f_half_example(spark):
    df = spark.createDataFrame([(2, 3, 2), (0, 0, 0), (0, 1, 0), (0, 0, 1)], "tp int, n_pred int, n_true int")
    got = [round(r["f"], 3) for r in df.select(metrics.f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")).alias("f")).collect()]
    assert got == [0.714, 1.0, 0.0, 0.0]


def test_missing_values_do_not_spread(spark):
    p = pairs_of(spark, [("S1-1", "S2-1", 0.5), ("S1-1", "S2-2", None), ("S1-1", "S2-3", 1.0)])
    got = {r["cand_id"]: r["prob_rel"] for r in ranks.relative(p, ["prob"]).collect()}
    assert got == {"S2-1": 0.5, "S2-2": None, "S2-3": 1.0}
    assert {r["prob_rel"] for r in ranks.relative(p, ["prob"], parity=True).collect()} == {None}


def test_ties_go_to_the_smaller_id(spark):
    p = pairs_of(spark, [("S1-2", "S2-1", 0.9), ("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.9)])
    assert [tuple(r) for r in decide.one_to_one(p).orderBy("cand_id").select("source1_entity_id", "cand_id").collect()] == [("S1-1", "S2-1"), ("S1-1", "S2-2")]
    assert [r["cand_id"] for r in retrieve.top_k(p, 1, "prob").orderBy("source1_entity_id").collect()] == ["S2-1", "S2-1"]


def brute_expected(ps, gamma, min_p=0.02):
    ps = sorted((p for p in ps if p >= min_p), reverse=True)
    if not ps:
        return 0
    best, size, total = 0.0, 0, gamma * sum(ps)
    none = 1.0
    for p in ps:
        none *= 1 - p
    for k in range(1, len(ps) + 1):
        tp = sum(ps[:k])
        pr, rc = tp / k, tp / total
        f = 1.25 * pr * rc / (0.25 * pr + rc)
        if f >= best - 1e-12:
            best, size = max(best, f), k
    return size if best > none else 0


def test_expected_f(spark):
    r = random.Random(3)
    data = {f"S1-{i}": [round(r.random(), 3) for _ in range(r.randint(1, 7))] for i in range(60)}
    p = pairs_of(spark, [(e, f"S2-{j}", x) for e, xs in data.items() for j, x in enumerate(xs)])
    got = {x["source1_entity_id"]: x["count"] for x in decide.expected_f(p).groupBy("source1_entity_id").count().collect()}
    assert all(got.get(e, 0) == brute_expected(xs, 1.15) for e, xs in data.items())


def test_tuning_finds_the_best_grid_point(spark):
    r = random.Random(4)
    rows = [(f"S1-{i}", f"S2-{i}-{j}", round(r.random(), 2)) for i in range(30) for j in range(4)]
    p = pairs_of(spark, rows)
    links = p.where("prob > 0.6").drop("prob")
    entities = p.select("source1_entity_id").distinct()
    knobs, score = decide.tune(p, entities, links, [0.2, 0.6, 0.61, 0.8], [0.0, 0.9])
    assert score == pytest.approx(metrics.macro_f(decide.threshold(p, knobs), links, entities).first()["macro_f"])
    grid = [(e, a, x) for e in (0.2, 0.6, 0.61, 0.8) for a in (0.2, 0.6, 0.61, 0.8) if a <= e for x in (0.0, 0.9)]
    assert score >= max(metrics.macro_f(decide.threshold(p, decide.Knobs(*g)), links, entities).first()["macro_f"] for g in grid[:6]) - 1e-9
    gamma, tau, f = decide.tune_hybrid(p, entities, links, [0.2, 0.6], [0.9, 1.2])
    assert f == pytest.approx(metrics.macro_f(decide.expected_f(p, gamma, tau_empty=tau), links, entities).first()["macro_f"])
    own, whole = decide.tune_by(p.withColumn("c", F.lit(1)), entities.withColumn("country_key", F.lit("x")), links, least=5, taus=[0.2, 0.6], alphas=[0.0])
    assert set(own) == {"x"}


def test_wide_keys_and_caps(spark):
    df = spark.createDataFrame([("S1-1", "acme tools", "12b main road springfield 12345 q"), ("S1-2", "ab", "")], "entity_id string, business_name string, business_address string").withColumn("country_key", F.lit("x"))
    r = text.normalised(df)
    got = {(x["tag"], x["key"]) for x in keys.record_keys(r, wide=True).collect()}
    assert ("P", "12345|main") in got and ("N", "12|main") in got and ("G", "P") in got
    capped = retrieve.key_stats(keys.record_keys(r), r, {"T": 0})
    assert {x["kept"] for x in capped.where("tag = 'T'").collect()} == {False}


def test_score_modes(spark):
    df = spark.createDataFrame([("S1-1", "acme tools", "1 main"), ("S2-1", "acme tool", "1 main"), ("S3-1", "other thing", "9 elm")], "entity_id string, business_name string, business_address string").withColumn("country_key", F.lit("x"))
    r = text.normalised(df).checkpoint()
    a, b = r.where("entity_id LIKE 'S1%'"), r.where("entity_id NOT LIKE 'S1%'")
    ka, kb = keys.record_keys(a), keys.record_keys(b)
    cosine = retrieve.block_scores(a, b, ka, kb, mode="cosine").collect()
    assert [x["cand_id"] for x in cosine] == ["S2-1"] and 0 < cosine[0]["sim_block"] <= 1
    assert retrieve.split_scores(a, b, ka, kb).count() == 1
    with pytest.raises(ValueError):
        retrieve.block_scores(a, b, ka, kb, mode="no")
    assert tfidf.tfidf_top(a, b, "n_name", "char3", 1, min_df=1).first()["cand_id"] == "S2-1"


def test_cluster_rule(spark):
    rows = [("S1-1", "S2-1", 0.9, "KLPL", "main street"), ("S1-1", "S2-2", 0.3, "KLPL", "elm"), ("S1-1", "S2-3", 0.85, "TTT", "oak"), ("S1-1", "S2-4", 0.1, "KLPL", ""), ("S1-2", "S2-5", 0.5, "X", "")]
    df = spark.createDataFrame(rows, "source1_entity_id string, cand_id string, prob double, s_name string, n_addr string")
    assert {r["cand_id"] for r in cluster.whole_cluster(df).collect()} == {"S2-1", "S2-2"}


def test_model_and_stack(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"S1-{i}", f"S2-{i}{j}", x, None if r.random() < 0.2 else x + r.random() / 5, int(x > 0.5), "A", "b") for i in range(80) for j in range(4) for x in [r.random()]]
    df = spark.createDataFrame(rows, "source1_entity_id string, cand_id string, x double, y double, label int, s_name string, n_addr string")
    fitted = model.PairModel.fit(df, ["x", "y"], rounds=5, depth=2, least=2, valid=F.col("x") < 0.1)
    out = fitted.transform(df)
    assert out.where("y IS NULL").count() == df.where("y IS NULL").count()
    assert out.where("(prob > 0.5) = (label = 1)").count() > 0.95 * len(rows)
    fitted.save(str(tmp_path / "m"))
    assert model.PairModel.load(str(tmp_path / "m"), ["x", "y"]).transform(df).agg(F.sum("prob")).first()[0] == pytest.approx(out.agg(F.sum("prob")).first()[0])
    assert fitted.importance(1)[0][0] in ("x", "y")
    first, second = model.fit_stack(df, ["x", "y"], folds=2, first_rounds=2, rounds=3, depth=2, least=2)
    assert model.predict_stack(df, first, second).count() == len(rows)
    scored = model.scorer(df, "s_name", "n_addr", lambda a, b: [1.0] * len(a), top=1, order="x")
    assert scored.where("ce_score = 1").count() == 80 and scored.count() == len(rows)


def test_files(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name \tbusiness_address\tcountry\nS1-1\t"Quoted" name \t\tIN\nS2-2\tx\ty\tFR\n')
    got = rec.source(spark, str(p)).collect()
    assert got[0]["business_name"] == '"Quoted" name' and got[0]["business_address"] == "" and got[0]["country_key"] == "in"
    bad = tmp_path / "b.tsv"
    bad.write_text("entity_id\tcountry\nS1-1\tx\n")
    with pytest.raises(ValueError):
        rec.source(spark, str(bad))
    t = tmp_path / "t.tsv"
    t.write_text("source1_entity_id\tx\nS1-1\tS2-1, S2-2,,S2-1\nS1-2\t\n")
    assert {r["source1_entity_id"]: r["matched"] for r in rec.ground_truth(spark, str(t)).collect()} == {"S1-1": ["S2-1", "S2-2"], "S1-2": []}


def test_checks_of_lines(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\n")
    assert {r["rule"] for r in validate.lines(spark, str(p), "matching").collect()} == {"no_tab"}
    assert {r["rule"] for r in validate.lines(spark, str(p), "candidate").collect()} == {"header", "no_tab"}
    assert validate.lines(spark, str(tmp_path / "none"), "matching").first()["rule"] == "missing_file"
    (tmp_path / "e.tsv").write_text("")
    assert validate.lines(spark, str(tmp_path / "e.tsv"), "matching").first()["rule"] == "empty_file"
    m, c = (spark.createDataFrame([("S1-1", x)], "source1_entity_id string, ids string") for x in ("S2-1,S2-2", "S2-1"))
    assert [tuple(r)[2:] for r in validate.check_subset(m, c).collect()] == [("S1-1", "S2-2")]
    assert validate.exit_code(validate.check_subset(m, c)) == 0


def test_command_line_end_to_end(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ter", "son", "ba"]) for _ in range(r.randint(2, 4)))
    sources, truth = {1: [], 2: [], 3: []}, []
    for i in range(60):
        name, address = f"{word()} {word()} ltd", f"{r.randint(1, 99)} {word()} street {r.randint(10000, 99999)}"
        sources[1].append((f"S1-{i}", name, address))
        own = []
        for k in (2, 3):
            if r.random() < 0.8:
                sources[k].append((f"S{k}-{i}", name.replace("ltd", "limited"), address if r.random() < 0.7 else ""))
                own.append(f"S{k}-{i}")
            sources[k].append((f"S{k}-{1000 + i}", f"{word()} {word()}", f"{r.randint(1, 99)} {word()} road"))
        truth.append((f"S1-{i}", ",".join(own)))
    for split in ("train", "test"):
        for k, rows in sources.items():
            (tmp_path / f"{split}_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join((*x, "US")) + "\n" for x in rows))
    (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in truth))
    run = lambda step, split, *more: cli.main([step, "--folder", str(tmp_path), "--split", split, *more], spark)
    for split in ("train", "test"):
        for step in ("prep", "block", "reverse", "merge_cands", "competition"):
            run(step, split)
    run("train", "train", "--rounds", "3")
    run("predict", "test")
    with pytest.raises(SystemExit) as end:
        run("check", "test", "--check-ids")
    assert end.value.code == 0
    got = {x["source1_entity_id"]: x["matched_entity_ids"] for x in rec.tsv(spark, str(tmp_path / "work/matching_results")).collect()}
    assert sum(got[i] == ids for i, ids in truth) > 40
    for step in ("tokidf", "multiview", "tfidf_views"):
        run(step, "test")
    vectors = [(f"S{k}-{i}", [1.0, 0.0] if i % 2 else [0.6, 0.8]) for k in (1, 2) for i in range(60)]
    spark.createDataFrame(vectors, "entity_id string, vector array<double>").write.parquet(str(tmp_path / "work/test_vectors"))
    run("embfeat", "test")
    assert {round(x["emb_cos"], 6) for x in spark.read.parquet(str(tmp_path / "work/test_cands_emb")).where("emb_cos IS NOT NULL").collect()} <= {1.0, 0.6}
    run("stack", "train", "--rounds", "2")
    run("predict_stack", "test")
    assert rec.tsv(spark, str(tmp_path / "work/matching_results")).count() == 60


def test_one_call_runs_the_steps_in_order(spark, tmp_path, monkeypatch):
    ran = []
    for name in ("prep", "block", "reverse", "merge_cands", "competition", "train", "stack", "predict", "predict_stack", "check"):
        monkeypatch.setattr(cli, name, lambda w, a, name=name: ran.append((name, w.split)))
    cli.main(["run_pipeline", "--folder", str(tmp_path), "--split", "test", "--stacked"], spark)
    steps = ["prep", "block", "reverse", "merge_cands", "competition"]
    assert ran == [*[(s, "train") for s in steps], *[(s, "test") for s in steps], ("stack", "train"), ("predict_stack", "test"), ("check", "test")]


def test_containment_against_brute_force(spark):
    r = random.Random(14)
    sets = {k: [(i, r.sample(range(12 if i % 3 else 40), r.randint(1, 12))) for i in range(60)] for k in "ab"}
    a, b = (spark.createDataFrame([(i, [f"w{x}" for x in w]) for i, w in sets[k]], f"{k} long, w array<string>") for k in "ab")
    got = {(x["a"], x["b"]): round(x["containment"], 9) for x in merge.contained(a, b, "a", "b", 9, 10).collect()}
    share = {(i, j): len(set(v) & set(w)) / min(len(v), len(w)) for i, v in sets["a"] for j, w in sets["b"]}
    assert got == {k: round(v, 9) for k, v in share.items() if v >= 0.9} and len(got) > 100


def test_floor_and_countries(spark):
    assert decide.at_edge(decide.Knobs(0.1, 0.1, 0.9)) == ["tau_empty", "tau_abs", "alpha"] and decide.at_edge(decide.Knobs()) == []
    assert decide.probability_floor(decide.Knobs(0.6, 0.425)) == 0.2125 and decide.probability_floor(decide.Knobs(0.4), stacked=True) == pytest.approx(0.16)
    entities = spark.createDataFrame([("S1-1", "x"), ("S1-2", "x"), ("S1-3", "y")], "source1_entity_id string, country_key string")
    links = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-3", "S2-3")], "source1_entity_id string, cand_id string")
    assert {tuple(r) for r in metrics.profile_countries(links, entities).collect()} == {("x", 2, 0.5, 1.0, 2), ("y", 1, 0.0, 1.0, 1)}


def test_stream(spark, tmp_path):
    from samewise.streaming.records import normalised_stream

    df = spark.createDataFrame([("S1-1", "Acme Ltd", "1 Main St", "US")], "entity_id string, business_name string, business_address string, country string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = normalised_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["n_name"] == "acme"


def test_grams_of_the_views(spark):
    df = spark.createDataFrame([("ab cde f",), ("a",), ("",)], "s string")
    got = {how: [r["g"] for r in df.select(tfidf.grams(F.col("s"), how).alias("g")).collect()] for how in ("word", "char3", "char_wb3")}
    assert got["word"] == [["ab", "cde"], [], []]
    assert got["char3"] == [["abc", "bcd", "cde", "def"], ["a"], []]
    assert got["char_wb3"] == [[" ab", "ab ", " cd", "cde", "de ", " f "], [" a "], []]
    with pytest.raises(ValueError):
        tfidf.grams(F.col("s"), "other")


def test_rescoring_and_sibling_support_against_plain_python(spark):
    from samewise.functions import fuzzy

    r = random.Random(8)
    word = lambda: r.choice(["KLP", "TNS", "MRK", "PLS", "STN"])
    recs = {f"S{k}-{i}": (" ".join(word() for _ in range(r.randint(1, 3))), r.choice(["", "main street 5", "elm road 7", "oak lane"])) for k in (1, 2) for i in range(8)}
    df = spark.createDataFrame([(i, *v) for i, v in recs.items()], "entity_id string, s_name string, n_addr string")
    rows = [(f"S1-{i}", f"S2-{j}", round(r.random(), 3)) for i in range(5) for j in range(8)]
    pairs = spark.createDataFrame(rows, "source1_entity_id string, cand_id string, sim_block double")
    two = lambda a, b: (fuzzy.token_set_ratio(recs[a][0], recs[b][0]), fuzzy.token_set_ratio(recs[a][1], recs[b][1]))
    score = {(e, c): round(max(two(e, c)) + 0.35 * min(two(e, c)) + 0.05 * 100 * s, 6) for e, c, s in rows}
    got = {(x["source1_entity_id"], x["cand_id"]): x["sim_block"] for x in retrieve.rescored(pairs, df, 3).collect()}
    for e in {e for e, _, _ in rows}:
        own = sorted((k for k in score if k[0] == e), key=lambda k: (-score[k], k[1]))[:3]
        assert {k for k in got if k[0] == e} == set(own) and all(abs(got[k] - score[k]) < 1e-6 for k in own)
    own = pairs.withColumnRenamed("sim_block", "p1").join(df.withColumnRenamed("entity_id", "cand_id"), "cand_id")
    found = {(x["source1_entity_id"], x["cand_id"]): x for x in model.stacked(own).collect()}
    for e, c, p in rows:
        others = [(max(two(c, d)), q) for f, d, q in rows if f == e and d != c]
        g = found[e, c]
        want = (max(s / 100 * q for s, q in others), sum(s / 100 * q for s, q in others), sum(s >= 85 and q >= 0.5 for s, q in others), max(s for s, _ in others))
        assert all(abs(a - b) < 1e-9 for a, b in zip(want, (g["sib_max"], g["sib_sum"], g["sib_cnt"], g["sib_sim"])))
        top = max(q for f, _, q in rows if f == e)
        assert abs(g["p1_rel"] - p / top) < 1e-9 and abs(g["p1_gap"] - (top - p)) < 1e-9
