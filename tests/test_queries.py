"""Every query with an oracle against DuckDB, on the smallest tables."""

import importlib.util
import math
from pathlib import Path

import duckdb
import pytest

from fieldledger.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    expected = want.fetchall()
    assert sorted(got.columns) == sorted(names)
    found = [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in got.collect()]
    expected = [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in expected]
    assert rows_of(got.columns, found) == rows_of(names, expected)
    if name != "audit_repeats":
        assert found, "the query found nothing to compare"


def test_entry_works_without_the_optional_parts(spark):
    spec = importlib.util.find_spec("__spark_entry__")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(QUERIES) <= set(module.queries()) and set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() > 0
