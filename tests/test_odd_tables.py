"""Bound queries on tables of few odd rows, against the same SQL."""

import duckdb
import pytest

from assayforge.operators import cliffs
from assayforge.plans import bindings


@pytest.fixture()
def differences(spark, tmp_path):
    """Rows that a query and its SQL do not share, as (columns, only in the query, only in SQL)."""

    def run(name, table, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        df = bindings.QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = [tuple(r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({bindings.ORACLE_SQL[name]})").fetchall()]
        got = [tuple(r) for r in df.collect()]
        assert len(want) > 0
        return sorted(set(got) - set(want)), sorted(set(want) - set(got)), len(got) - len(want)

    return run


def test_spread_just_below_a_half_and_just_beyond_the_tolerance(differences):
    # 106929.49999999999, 250000.00000000003 and 234879.5 as doubles.
    prices = [(1, 138536.55), (1, 31607.05), (2, 262144.02), (2, 12144.02), (3, 234979.5), (3, 100.0)]
    rows = [(i, c, "3-MEDIUM", p) for i, (c, p) in enumerate(prices)]
    assert differences("label_conflicts_value", "orders", "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double", rows) == ([], [], 0)


PART = "p_partkey long, p_name string, p_brand string, p_type string"


def test_core_pairs_of_copies_and_of_missing_names(differences):
    names = ["red bolt", "red ring", "blue bolt", "bolt red", "ring ring", "bolt", "", None]
    rows = [(i, names[i * 5 % 8], "B1" if i % 3 else "B2", "SMALL" if i % 11 else None) for i in range(200)]
    rows += [(3, "red ring", "B2", "SMALL"), (3, "blue bolt", "B2", "SMALL"), (None, "red bolt", "B1", "SMALL"), (300, "red bolt", None, "SMALL")]
    assert differences("core_pairs", "part", PART, rows) == ([], [], 0)


def test_core_pairs_of_copies_are_made_after_the_last_exchange(spark):
    # 40 copies of each of 3 compounds, one of which has a core with two rests; blocks of few members each.
    kinds = {0: [("c", "r")], 1: [("c", "s"), ("d", "t")], 2: [("c", "r"), ("c", "uu"), ("d", "v")]}
    rows = [(i, c, len(c), r, len(r)) for i in range(120) for c, r in kinds[i * 7 % 3]]
    df = cliffs.core_pairs(spark.createDataFrame(rows, "id long, core string, core_size int, rest string, rest_size int"), block=7)
    got = sorted((r["a"], r["b"], r["core"], r["transformation"], r["n_changed"]) for r in df.collect())
    want = []
    for a in range(120):
        for b in range(a + 1, 120):
            met = [(len(r) + len(s), -len(c), r, s, c) for c, r in kinds[a * 7 % 3] for d, s in kinds[b * 7 % 3] if c == d and r != s]
            want += [(a, b, c, f"{r}>>{s}", n) for n, _, r, s, c in sorted(met)[:1]]
    assert got == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan.split("Exchange")[0]
