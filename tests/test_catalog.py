"""Each registered query against its SQL, and properties of those that SQL cannot tell."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, knn
from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, small_dir, name):
    df = catalog.queries()[name](spark, small_dir)
    columns = sorted(df.columns)
    found = db.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == columns
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    want = ordered(found.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_recall_rows_can_fail(spark, small_dir):
    """The row that the searches are compared by tells a bad result from a good one."""
    base = catalog.embeddings(spark, small_dir)
    queries = catalog.asked(base)
    truth = knn.exact_knn(queries, base, 10)
    good = catalog._recall_row(truth, truth, queries, 0.95).first()
    assert good["recall_reached"] and good["odd_rows"] == 0 and good["full"] == good["n_queries"]
    half = catalog._recall_row(truth.where("rank <= 5"), truth, queries, 0.95).first()
    assert not half["recall_reached"] and half["full"] == 0
    moved = catalog._recall_row(truth.withColumn("dist", F.col("dist") + 1), truth, queries, 0.95).first()
    assert moved["odd_rows"] == truth.count()
    twice = catalog._recall_row(truth.unionByName(truth.where("rank = 1")), truth, queries, 0.95).first()
    assert twice["odd_rows"] == good["n_queries"]


def test_graph_properties(spark, small_dir):
    rows = {r["vec_id"]: r for r in graph.unpacked(catalog.built(spark, small_dir).versions.read("graph")).collect()}
    assert len(rows) == catalog.embeddings(spark, small_dir).count()
    assert all(len(r["nbrs"]) <= 32 and r["vec_id"] not in r["nbrs"] for r in rows.values())


def test_partition_covers_all(spark, small_dir):
    base = catalog.embeddings(spark, small_dir)
    parts, centers = catalog.clustering.partition(base, most_rows=150)
    assert len(centers) > 1
    rows = parts.groupBy("vec_id").agg(F.count_distinct("shard").alias("n")).collect()
    assert len(rows) == base.count() and all(r["n"] == 2 for r in rows)
    assert parts.groupBy("shard").count().agg(F.max("count")).first()[0] <= 150


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
