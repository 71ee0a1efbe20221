import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    got = df.collect()
    if name not in entry.oracle_sql():
        assert df.columns and got is not None
        return
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(names, want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["source1_entity_id", "cand_id", "sim_block"]


def test_nothing_imports_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "samewise")):
        for f in files:
            if f.endswith(".py") and "llm" not in folder.split(os.sep):
                assert not re.search(r"^\s*(from|import) .*\bllm\b", open(os.path.join(folder, f)).read(), re.M), f
