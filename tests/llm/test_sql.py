import os

import duckdb
import pytest

from seriesgrove.llm import queries

NAMES = sorted(queries.SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, sf_dir, name):
    base = duckdb.connect()
    for f in os.listdir(sf_dir):
        base.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    out = queries.QUERIES[name](spark, sf_dir)
    want = base.sql(queries.SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    columns = sorted(out.columns)
    assert sorted(map(repr, map(tuple, out.select(columns).collect()))) == sorted(map(repr, base.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()))
