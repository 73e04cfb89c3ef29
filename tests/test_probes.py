"""How many shards a search asks follows from what the build measured."""

import numpy as np

from lodestone.index import Index
from tests.test_index import asked, cloud, recall


def test_recall_over_many_shards(spark, tmp_path):
    """Neighbours of a row of an even cloud lie in many shards, and a search finds them whatever their number."""
    rows = cloud(spark, 900).coalesce(2).cache()
    index = Index.build(spark, str(tmp_path), rows, degree=24, size=48, most_rows=100, chunks=8)
    queries = asked(rows, 40)
    assert index.status()["shards"] >= 18
    assert recall(index, queries, size=96, width=8) >= 95 > recall(index, queries, size=96, width=8, probes=4)
    index.remove(rows.where("vec_id % 9 = 0").select("vec_id"))
    index.merge()
    assert recall(index, queries, size=96, width=8) >= 95


def test_few_shards_are_asked_where_few_hold_the_nearest(spark, tmp_path):
    rng = np.random.default_rng(3)
    places = rng.normal(0, 50, (12, 8))
    rows = spark.createDataFrame([(i, (places[i % 12] + rng.normal(0, 1, 8)).tolist()) for i in range(960)], "vec_id long, embedding array<float>").coalesce(2).cache()
    index = Index.build(spark, str(tmp_path), rows, degree=24, size=48, most_rows=200, chunks=8)
    meta = index._state()[1]
    assert meta["probes"] < index.status()["shards"]
    assert recall(index, asked(rows, 24), size=64) >= 95
