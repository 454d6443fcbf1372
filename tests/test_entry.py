"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from colloquy.plans import engine

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted([tuple(cell(r[i]) for i in order) for r in table])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    df = engine.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] or name == "ppmi_associations"
    if name in engine.SQL:
        exp = duck.execute(engine.SQL[name])
        assert got == rows([c[0] for c in exp.description], exp.fetchall())
