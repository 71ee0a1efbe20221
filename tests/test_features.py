"""Pair features against plain Python over the same normalised records."""

import math
import random

import pytest
from pyspark.sql import functions as F

from samewise.functions import fuzzy, text
from samewise.operators import features


@pytest.fixture(scope="module")
def fixture(spark):
    r = random.Random(11)
    word = lambda: r.choice(["acme", "tools", "house", "global", "food", "ltd", "kulopal", "of"])
    rows = [(f"S{k}-{i}", " ".join(word() for _ in range(r.randint(1, 4))), r.choice(["", f"{r.randint(1, 40)}b main st {r.randint(10000, 10005)}", f"{r.randint(1, 40)} elm road"])) for k in (1, 2, 3) for i in range(8)]
    df = text.normalised(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string").withColumn("country_key", F.lit("x"))).checkpoint()
    pairs = [(f"S1-{i}", f"S{k}-{j}", round(r.random(), 3)) for i in range(6) for k in (2, 3) for j in range(8) if r.random() < 0.6]
    return {x["entity_id"]: x for x in df.collect()}, df, pairs, spark.createDataFrame(pairs, "source1_entity_id string, cand_id string, sim_block double")


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_full_set(fixture):
    rec, df, pairs, frame = fixture
    got = {(x["source1_entity_id"], x["cand_id"]): x for x in features.pair_features(frame, df).collect()}
    assert set(got) == {p[:2] for p in pairs} and len(features.ALWAYS) == 49 and len(features.PASSED) == 16
    tsr = fuzzy.token_set_ratio
    n, dfs = len(rec), {}
    for x in rec.values():
        for t in set(x["n_name"].split()):
            dfs[t] = dfs.get(t, 0) + 1
    for e in {p[0] for p in pairs}:
        own = sorted((p for p in pairs if p[0] == e), key=lambda p: (-p[2], p[1]))
        skel = {c: tsr(rec[e]["s_name"], rec[c]["s_name"]) for _, c, _ in own}
        addr = {c: tsr(rec[e]["n_addr"], rec[c]["n_addr"]) if rec[e]["n_addr"] and rec[c]["n_addr"] else None for _, c, _ in own}
        top, anchor = own[0][2], own[0][1]
        best_addr = max([x for x in addr.values() if x is not None], default=0.0)
        ranked = sorted(skel, key=lambda c: (-skel[c], c))
        idf = [math.log(1 + n / dfs[t]) for t in set(rec[e]["n_name"].split())]
        first = own[:16]
        for _, c, s in own:
            g, a, b = got[e, c], rec[e], rec[c]
            near = [o for o in first if o[1] != c and max(tsr(rec[o[1]]["s_name"], b["s_name"]), tsr(rec[o[1]]["n_addr"], b["n_addr"])) >= 85] if (e, c, s) in first else []
            x, y = ({t for t in z["n_addr"].split() if any(ch.isdigit() for ch in t)} for z in (a, b))
            there = bool(a["n_addr"] and b["n_addr"])
            want = {
                "sim_block": s, "name_tsr": tsr(a["n_name"], b["n_name"]), "name_par": fuzzy.partial_ratio(a["n_name"], b["n_name"]), "skel_tsr": skel[c], "addr_tsr": addr[c],
                "name_idf_min": min(idf), "name_idf_mean": sum(idf) / len(idf), "name_idf_max": max(idf), "postal_eq": float(a["postal"] == b["postal"] != ""), "acr_eq": float(a["name_acr"] == b["name_acr"] != ""), "addr_empty": float(not there), "cand_src": float(c[1]),
                "addr_num_conflict": float(len(x ^ y)) if there else None, "addr_num_conflict_rate": len(x ^ y) / max(len(x | y), 1) if there else None, "len_ratio": len(b["n_name"]) / max(len(a["n_name"]), 1), "ntok_r": float(len(b["n_name"].split())),
                "sim_block_rel": s / max(top, 1e-6), "sim_block_gap": top - s, "addr_tsr_rel": None if addr[c] is None else addr[c] / max(best_addr, 1e-6), "is_anchor": float(s >= top - 1e-9), "skel_vs_anchor": tsr(b["s_name"], rec[anchor]["s_name"]), "anchor_gap_skel": skel[c] - skel[anchor],
                "clus_deg": float(len(near)), "clus_mass": sum(o[2] for o in near), "n_cands": float(len(own)), "clus_deg_rel": len(near) / max(min(len(own), 16) - 1, 1), "skel_rank": float(ranked.index(c)),
            }
            assert not [k for k, v in want.items() if not close(g[k], v)], (e, c)


def test_early_set(fixture):
    rec, df, pairs, frame = fixture
    got = {(x["source1_entity_id"], x["cand_id"]): x for x in features.early_features(frame, df).collect()}
    assert len(features.EARLY) == 45
    n, dfs = len(rec), {"n_name": {}, "n_addr": {}}
    for x in rec.values():
        for c in dfs:
            for t in set(x[c].split()):
                dfs[c][t] = dfs[c].get(t, 0) + 1

    def widf(c, a, b):
        w = lambda t: math.log(n / (1 + dfs[c][t])) + 1
        x, y = set(a[c].split()), set(b[c].split())
        return sum(map(w, x & y)) / sum(map(w, x | y)) if x | y else 0.0

    combined = {}
    for e, c, _ in pairs:
        a, b = rec[e], rec[c]
        combined[e, c] = 0.4 * fuzzy.token_set_ratio(a["n_name"], b["n_name"]) / 100 + 0.2 * fuzzy.jaro_winkler(a["n_name"], b["n_name"]) + 0.15 * widf("n_name", a, b) + 0.15 * fuzzy.token_set_ratio(a["n_addr"], b["n_addr"]) / 100 + 0.1 * widf("n_addr", a, b)
    for (e, c), v in combined.items():
        own = sorted((k for k in combined if k[0] == e), key=lambda k: (-combined[k], k[1]))
        best, second = combined[own[0]], combined[own[1]] if len(own) > 1 else 0.0
        g, x, y = got[e, c], set(rec[e]["n_name"].split()), set(rec[c]["n_name"].split())
        want = {"combined": v, "nm_contain": len(x & y) / min(len(x), len(y)), "nm_nshared": float(len(x & y)), "gap_to_best": best - v, "combined_minus_mean": v - sum(combined[k] for k in own) / len(own), "best_minus_second": best - second, "n_cands": float(len(own)), "nm_exact": float(rec[e]["n_name"] == rec[c]["n_name"])}
        assert not [k for k, w in want.items() if not close(g[k], w)], (e, c)
    with pytest.raises(ValueError):
        features.early_features(frame.withColumn("cand_id", F.lit("S2-404")), df)
