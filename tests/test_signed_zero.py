import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seriesgrove.plans import catalog, stored  # noqa: F401


def beside_zero(vec_id, noisy, at=15, below=2.5e-7):
    """64 values whose z-normalised one at `at` lies so far below zero."""
    rng = random.Random(vec_id)
    scale = 0.1 + 0.3 * ((vec_id * 31 + 7) % 100) / 100 if noisy else 0.0
    shift = [scale * (((vec_id * 7919 + i * 104729 + 12345) % 1000) / 1000 - 0.5) for i in range(64)]
    x = pa.array([rng.uniform(-0.2, 0.2) for _ in range(64)], pa.float32()).to_pylist()
    others = [v + s for i, (v, s) in enumerate(zip(x, shift, strict=True)) if i != at]
    m = sum(others) / 63
    x[at] = m - below * (sum((o - m) ** 2 for o in others) / 64) ** 0.5 - shift[at]
    return x


@pytest.mark.parametrize("name", ["synth_queries_portable", "synth_queries_stored", "znormalize"])
def test_values_just_below_zero_keep_their_sign_as_in_sql(spark, tmp_path, name):
    ids = list(range(8))
    rows = [beside_zero(i, name != "znormalize", below=2.5e-7 * (-1) ** i) for i in ids]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array(ids, pa.int32())}), f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {r[0]: repr(r[1]) for r in base.sql(catalog.SQL[name]).fetchall()}
    got = {r[0]: repr(list(r["values"])) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(", -0.0," in v for v in want.values()) == 4 and sum(", 0.0," in v for v in want.values()) == 4
