"""Every bound query that SQL can express, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from assayforge.plans import bindings
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = bindings.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cur = duck.execute(bindings.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_split_keeps_groups_and_meets_fractions(spark):
    found = bindings.QUERIES["split_identity"](spark, SMALL)
    rows = found.collect()
    assert len({r["key"] for r in rows}) == len(rows)
    total = sum(r["n"] for r in rows)
    train = sum(r["n"] for r in rows if r["split"] == "train")
    assert abs(train / total - 0.8) < 0.05
