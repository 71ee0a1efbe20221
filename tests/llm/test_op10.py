import hashlib
import random

import numpy as np
import pytest

from samewise.llm import suffix_dedup
from samewise.llm.queries import QUERIES
from tests.llm.fixtures import documents, write_tables


def brute(rows, width=50):
    """rows: (doc_id, text) -> sorted results; windows of documents with a smaller id by a dict of all."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - width + 1):
                w = b[k : k + width]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - width + 1):
                if least[b[k : k + width]] < i:
                    gone[k : k + width] = b"\x01" * width
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def shared_rows(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(6, 30)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : r.randint(a, len(p))], text(r.randint(0, 10))]
        rows.append((r.randint(0, 1000), " ".join(parts)))
    line = "A very common line that all too many of the documents here have got in them."
    rows += [(2000 + i, f"{text(5)}\n{line}\n{text(8)}") for i in range(60)]
    rows += [(3000 + i, rows[3][1]) for i in range(20)] + [(5, rows[3][1]), (5, rows[4][1]), (3003, rows[3][1])]
    rows += [(4000, "a" * 400), (4001, "a" * 300 + "b"), (4002, "ab" * 100), (4003, "ab" * 30), (4004, "x" * 50), (4005, "x" * 49), (4006, "x" * 50), (4007, "\x00" * 60), (4008, "\x00" * 55)]
    return rows


@pytest.mark.parametrize("frequent", [256, 4])
def test_op10_against_brute_force(spark, frequent):
    rows = shared_rows()
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = suffix_dedup.deduplicated(docs, frequent=frequent, group_bytes=4000, bucket_bytes=9000).collect()
    assert sorted([(*r[:4], hashlib.sha256(r["kept"]).hexdigest()) for r in got], key=str) == brute(rows)


def test_op10_odd_documents_and_nothing(spark, tmp_path):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = QUERIES["op10_suffix_dedup"](spark, write_tables(spark, tmp_path, documents=docs)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert QUERIES["op10_suffix_dedup"](spark, write_tables(spark, tmp_path / "none", documents=docs.where("1 = 0"))).count() == 0


def test_sorted_windows():
    r = random.Random(2)
    for _ in range(30):
        t = bytes(r.choice(b"ab") for _ in range(r.randint(1, 4))) * 200 if r.random() < 0.5 else bytes(r.choice(b"abc") for _ in range(600))
        text = np.frombuffer(t + t[: len(t) // 2] + bytes(80), np.uint8)
        raw, n = text.tobytes(), len(text) - 80 - 50
        starts, new = suffix_dedup.sorted_windows(text, np.arange(n))
        own = [raw[s : s + 50] for s in starts]
        assert own == sorted(raw[s : s + 50] for s in range(n))
        assert [a != b for a, b in zip(own, own[1:])] == new[1:].tolist()


def test_cover_has_a_shift_for_every_pair():
    assert all((r + suffix_dedup.SHIFT[r, s]) % 7 in suffix_dedup.COVER and (s + suffix_dedup.SHIFT[r, s]) % 7 in suffix_dedup.COVER for r in range(7) for s in range(7))


def test_runs_hold_equal_windows_under_one_minimizer():
    a, b = b"some text before that is unlike " + bytes(range(65, 125)) + b"tail", b"x" + bytes(range(65, 125)) + b"other tail of some length here"
    found = {}
    for i, starts, windows, m in suffix_dedup.runs_of([a, b]):
        for s, n, k in zip(starts, windows, m):
            for j in range(int(n)):
                found.setdefault(([a, b][i])[s + j : s + j + 50], set()).add(int(k))
    assert all(len(x) == 1 for x in found.values()) and len(found) < len(a) + len(b) - 98


def test_pack_round_trip():
    for arrays in ([np.arange(5, dtype="<u8"), np.array([1, 2], "<u2")], [np.empty(0, "u1"), np.array([7], "<u4")]):
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, suffix_dedup.unpack(suffix_dedup.pack(*arrays))))
