"""Every named query against its SQL check, and the shape of the contract."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from matchlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
# Iterative training has no SQL form.
WITHOUT_CHECK = {"score_model", "model_errors", "ablation"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    out = [tuple(clean(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - WITHOUT_CHECK))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    duck.execute(catalog.CHECKS[name])
    want = table([d[0] for d in duck.description], duck.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]
    assert [list(map(type, r)) for r in got[1]] == [list(map(type, r)) for r in want[1]]


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) - set(catalog.CHECKS) == WITHOUT_CHECK
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "tier" in df.columns
