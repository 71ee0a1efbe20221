import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from samewise.llm import simhash
from tests.llm.fixtures import documents
from tests.llm.test_op5_op6 import least_reachable


def brute_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(rows):
    sets = [(i, brute_set(t)) for i, t in rows if i is not None]
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return least_reachable({i for i, _ in sets}, [(i, j) for i, a in sets for j, b in sets if i < j and alike(a, b)])


def edited(r, n_copies, first):
    line = " ".join(f"common{i}" for i in range(8))
    rows = []
    for g in range(n_copies):
        words = [f"w{r.randint(0, 500)}" for _ in range(r.randint(6, 300))]
        for k in range(r.randint(1, 8)):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 30))):
                own[r.randrange(len(own))] = f"x{r.randint(0, 10**6)}"
            rows.append((first + 10 * g + k, line + "\n" + " ".join(own)))
    return rows


def test_near_copies_against_brute_force(spark):
    r = random.Random(3)
    rows = edited(r, 60, 0) + [(2000, None), (2001, ""), (2002, "one"), (2003, "one"), (2004, "one two three four five")]
    r.shuffle(rows)
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], extra=False)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_texts(docs).collect()}
    want = brute_components(rows)
    assert got == want
    assert len(set(want.values())) < len(want) - 30


def test_stage_drops_copies_that_fingerprints_three_bits_apart_miss(spark):
    from samewise.llm.simhash import fingerprint

    r = random.Random(5)
    rows = edited(r, 40, 0)
    want = {i for i, c in brute_components(rows).items() if i == c}
    fps = {i: fingerprint(t) for i, t in rows}
    narrow = least_reachable(fps, [(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {i for i, c in narrow.items() if i == c} - want
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], extra=False)
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    rows = [(3, text["a"]), (7, text["a"]), (7, text["b"]), (7, text["b"]), (7, text["c"]), (7, text["c"] + " more"), (None, text["a"])]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], extra=False)
    got = sorted((r["doc_id"] or 0, r["text"].removesuffix(" more")) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(0, text["a"]), (3, text["a"]), (7, text["b"]), (7, text["c"])]


def test_counters_at_any_radius():
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = np.array([b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 40))) for b in base for _ in range(60)], np.uint64)
    for radius in (1, 3, 5, 7, 24):
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert {(i, int(j)) for i, found in simhash.links(fps, radius, 64) for j in found} == want
        assert simhash.within(fps, fps[::-1].copy(), radius).tolist() == [int(a ^ b).bit_count() <= radius for a, b in zip(fps, fps[::-1])]


def test_large_meetings_are_cut_in_blocks(spark, monkeypatch):
    r = random.Random(13)
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(i, line + " " + " ".join(f"t{r.randint(0, 3)}" for _ in range(r.randint(1, 6)))) for i in range(120)]
    rows += [(200 + i, " ".join(f"{w}{i // 40 if k % 9 else i % 40 // 2}" for k, w in enumerate(["a"] * 60))) for i in range(120)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], extra=False)
    want = brute_components(rows)
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_texts(docs).collect()} == want
    keys = simhash.prefixes(docs.where("doc_id IS NOT NULL"), []).toPandas().sort_values(["key", "c"])
    batches = pa.Table.from_pandas(keys, preserve_index=False).to_batches(max_chunksize=37)
    whole = [x for b in simhash.met(iter(batches)) for x in b.to_pylist()]
    monkeypatch.setattr(simhash, "BLOCK", 8)
    parts = [x for b in simhash.met(iter(batches)) for x in b.to_pylist()]
    member = lambda x: [m["c"] for m in x["m"]]
    by_key = {}
    for x in sorted((x for x in parts if x["key"] is not None), key=lambda x: x["part"]):
        assert len(x["m"]) <= 8 and x["part"] == len(by_key.setdefault(x["key"], [])) 
        by_key[x["key"]].append(member(x))
    assert {tuple(sum(v, [])) for v in by_key.values()} | {tuple(member(x)) for x in parts if x["key"] is None} >= {tuple(member(x)) for x in whole}


def test_groups_of_candidates_and_whole_sets(spark, monkeypatch):
    """A base and copies of it with few to many edits, in one part and in many."""
    r = random.Random(31)
    base = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        own = list(base)
        for _ in range(r.randint(1, 6)):
            own[r.randrange(90)] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows], extra=False)
    want = brute_components(rows)
    assert 10 < len(set(want.values())) < 110
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_texts(docs).collect()} == want
    monkeypatch.setattr(simhash, "MOST_SHINGLES", 2000)
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_texts(docs).collect()} == want
    table = pa.table({"c": [i for i, _ in rows], "text": [t for _, t in rows]})
    links = list(zip(*simhash.verify(table).to_pydict().values()))
    assert least_reachable([i for i, _ in rows], links) == want
