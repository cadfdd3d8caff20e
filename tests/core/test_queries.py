"""Every registered query that has a twin gives the twin's rows on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from reachloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if math.isnan(float(value)) else round(float(value), 6)
    return str(value)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


#: Queries that ask for a pairing of dimensions, a list of phrases or rules, or a few rows of totals.
PAIRED = ("J12", "K05", "D05", "D10", "M07", "R04", "A08")


def has_keys(df) -> bool:
    """No nested loop or product of whole tables hides in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, small, duck, name):
    got = registry.queries()[name](spark, small)
    assert name.startswith(PAIRED) or has_keys(got)
    names = sorted(got.columns)
    twin = duck.sql(registry.oracle_sql()[name])
    assert sorted(twin.columns) == names
    at = [twin.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in twin.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str) == want


def test_entry(spark, small):
    assert registry.entry(spark, small).count() == 11


def test_no_query_without_a_twin_pairs_all_rows(spark, small):
    twins = registry.oracle_sql()
    for name, query in registry.queries().items():
        assert name in twins or name.startswith(PAIRED) or has_keys(query(spark, small)), name
