import random
import re

import numpy as np
import pytest
import xxhash

from samewise.llm import simhash, vector_forest
from samewise.llm.common import components
from samewise.llm.queries import QUERIES
from tests.llm.fixtures import documents, write_tables


def least_reachable(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_on_long_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(300)]
    want = least_reachable({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_planes_find_all_links():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    fps = [int(x) for x in base]
    for _ in range(300):
        x = int(base[r.integers(0, 500)])
        for _ in range(r.integers(0, 6)):
            x ^= 1 << int(r.integers(0, 64))
        fps.append(x)
    fps += [fps[0] ^ 1 << a ^ 1 << b for a in range(12) for b in range(64)] + [0, (1 << 64) - 1]
    got = {(i, int(j)) for i, js in simhash.links(np.array(fps, np.uint64)) for j in js}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}


@pytest.mark.parametrize("n", [10, 1 << 20, 1 << 30, 1 << 40])
def test_masks_agree_within_the_radius(n):
    r = random.Random(4)
    masks = simhash.key_masks(n, 512)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 3):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op6_against_brute_force(spark, tmp_path):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    known = [(i, f) for i, f in fps if i is not None]
    comp = least_reachable({i for i, _ in known}, [(i, j) for i, f in known for j, g in known if (f ^ g).bit_count() <= 3])
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, write_tables(spark, tmp_path, documents=docs)).collect()}
    assert {x for x in got if x[0] is not None} == {(i, f"{f:016x}", comp[i]) for i, f in known}
    assert len(got) == len(rows)
    assert QUERIES["op6_simhash"](spark, write_tables(spark, tmp_path / "none", documents=docs.where("1 = 0"))).count() == 0


def test_op6_hot_bins_are_cut(spark):
    r = random.Random(8)
    words = [f"w{r.randint(0, 400)}" for _ in range(400)]
    rows = []
    for i in range(300):
        own = list(words)
        for _ in range(r.randint(0, 2)):
            own[r.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own), "en", "s"))
    docs = documents(spark, rows)
    whole = {tuple(x) for x in simhash.near_duplicates(docs).collect()}
    parts = {tuple(x) for x in simhash.near_duplicates(docs, per_bin=1000, most=16).collect()}
    assert whole == parts


def vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((150, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    for i in range(100):
        rows.append((1000 + i, [float(x) for x in base[i % 7] + 0.05 * r.standard_normal(16)]))
    rows += [(2000 + i, rows[3][1]) for i in range(5)] + [(2100, [3 * x for x in rows[3][1]])]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, [float("inf")] + [0.0] * 15), (3005, []), (3006, [1.0, 2.0]), (3007, [1.0, 2.0]), (None, rows[3][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS part", "3 AS leaf").repartition(3)


@pytest.mark.parametrize("most", [1024, 16])
def test_op5_against_brute_force(spark, most):
    rows, df = vectors(spark)
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = [(i, j) for i, v in good.items() for j, w in good.items() if i < j and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9]
    n = {i: 0 for i, _ in rows}
    for a, b in near:
        n[a] += 1
        n[b] += 1
    comp = least_reachable([i for i, _ in rows if i is not None], near)
    got = {r["vec_id"]: r for r in vector_forest.near_vectors(df, leaf=40, most=most).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * sum(n.values()) and all(r["n_links"] <= n[i] for i, r in got.items())
    assert sum(got[i]["component_id"] == comp[i] for i in comp) >= len(comp) - 2
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert vector_forest.near_vectors(df.where("1 = 0")).count() == 0


def test_components_of_few_and_of_many_links(spark):
    r = random.Random(41)
    links = [(r.randint(-300, 300), r.randint(-300, 300)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    known = [(a, b) for a, b in links if a is not None and a != b]
    want = least_reachable({x for pair in known for x in pair}, known)
    for few in (0, 1 << 17):
        assert {r["node"]: r["component"] for r in components(df, few=few).collect()} == want
        assert components(df.where("1 = 0"), few=few).count() == 0
