import os

import duckdb
import pytest

from seriesgrove.plans import catalog, engine, stored  # noqa: F401


def norm(v):
    """Single numbers to five places, as the driver compares them; what stands in a list exactly, the sign of zero included."""
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return repr(list(v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    base = duckdb.connect()
    for f in os.listdir(sf_dir):
        base.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return base


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    out, want = catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.SQL[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([norm(r[c]) for c in columns]) for r in out.collect())
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in want.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).collect()


def test_entry_point_has_them_all(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
