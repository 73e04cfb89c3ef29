"""Truths beyond 10,000 rows."""

import math

import duckdb
import numpy as np
import pytest

from lodestone.plans import catalog


@pytest.fixture(scope="module")
def large_dir(spark, tmp_path_factory):
    """Three queries; 10,500 odd rows nearest to them, and 200 rows of ids 100-399 a little farther."""
    rng = np.random.default_rng(6)
    near = [(6 * j + 1, rng.normal(0, 0.001, 4)) for j in range(100, 10_600)]
    far = [(i, np.array([0.1, 0, 0, 0]) + rng.normal(0, 0.01, 4)) for i in range(100, 400) if i % 6 != 1 and i % 6 != 4 and i % 20]
    rows = [(i, v.tolist(), 1) for i, v in [*((i, rng.normal(0, 0.001, 4)) for i in (0, 20, 40)), *near, *far]]
    folder = tmp_path_factory.mktemp("large")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["range_truth_update", "recall_tie_aware", "recall_active_only"])
def test_truth_is_whole(spark, large_dir, name):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{large_dir}/embeddings.parquet/*.parquet'")
    db.sql("create view events as select 0::bigint as event_id, 0::bigint as user_id, '' as event_type")
    df = catalog.queries()[name](spark, large_dir)
    want = db.sql(catalog.oracle_sql()[name]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b, strict=True)), (a, b)
