"""Exact search in tiles: ties, memory, and the grid of blocks."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import knn
from lodestone.plans import catalog


def test_copies_are_told_by_their_id(spark):
    """Of more equal rows than any reserve holds the least ids are the nearest."""
    base = spark.createDataFrame([(999 - i, [float(i % 2), 1.0]) for i in range(1000)], "vec_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0])], "qid long, qv array<float>")
    for metric in ("l2", "cosine"):
        found = knn.exact_knn(q, base, 5, metric).orderBy("qid", "rank").collect()
        assert [r["vec_id"] for r in found] == [1, 3, 5, 7, 9, 0, 2, 4, 6, 8]
    own = knn.exact_knn(q, base, 3, skip_self=True).orderBy("qid", "rank").collect()
    assert [r["vec_id"] for r in own] == [1, 3, 5, 0, 2, 4]


def test_memory_of_a_task_does_not_follow_the_queries():
    """A full block of queries against a full batch of rows: 330 MB for one matrix of their distances."""
    x = np.random.default_rng(0).normal(size=(10_000, 16))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(10_001) * 16, pa.int32()), pa.array(x.ravel()))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), lists], ["vec_id", "embedding"])
    parts = knn._grouped(pa.table({"qid": pa.array(np.arange(4096)), "qv": lists.slice(0, 4096)}))
    tracemalloc.start()
    found = pa.Table.from_batches(list(knn._met(parts, lambda qids, q, bounds: knn._Nearest(qids, q, "l2", 10, False), iter([rows]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20 and len(found) == 40_960
    at = np.flatnonzero(found["qid"].to_numpy() == 7)
    assert set(found["vec_id"].to_numpy()[at]) == set(np.argsort(((x - x[7]) ** 2).sum(1))[:10].tolist())


def test_grid_of_blocks(spark, small_dir, monkeypatch):
    base = catalog.rows(spark, small_dir).where("vec_id < 200").cache()
    q = base.where("vec_id < 60").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    asked = q.withColumn("expression", F.when(F.col("qid") % 2 == 0, "1 | 12").otherwise("2"))
    bounded = q.withColumn("most", F.col("qid") / 40)
    searches = [lambda: knn.exact_knn(q, base, 5), lambda: knn.exact_knn(q, base, 5, "cosine", skip_self=True), lambda: knn.exact_knn(asked, base, 5), lambda: knn.within(bounded, base)]
    whole = [sorted(map(tuple, s().collect())) for s in searches]
    monkeypatch.setattr(knn, "QUERY_BLOCK", 10)
    monkeypatch.setattr(knn, "BLOCK_VALUES", 25 * 64)
    assert [sorted(map(tuple, s().collect())) for s in searches] == whole and len(whole[0]) == 300
    tiles = knn._meeting(q, base, lambda qids, x, bounds: knn._Nearest(qids, x, "l2", 5, False))
    assert tiles.rdd.getNumPartitions() == 3 * 8  # no task has more than a block of each


def test_exact_graph_is_searched_once(spark, small_dir):
    """Plans that name the graph several times read it back instead of comparing all pairs again."""
    plans = [catalog.queries()[n](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString() for n in ("edge_repair", "shard_union_cap", "khop_expand")]
    assert all("MapInArrow" not in p and "FlatMapCoGroups" not in p for p in plans)


def test_recall_row_searches_once(spark, small_dir):
    """Found rows and truth are each read once."""
    base = catalog.embeddings(spark, small_dir)
    truth = knn.exact_knn(catalog.asked(base), base, 10)
    plan = catalog._recall_row(truth, truth, catalog.asked(base), 0.95)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
