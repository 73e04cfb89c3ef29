"""Overlapping partitions: bounds that copies and small bases keep, and what is fitted."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import clustering
from lodestone.plans import catalog


def shards_of(parts):
    found = {}
    for r in parts.select("vec_id", "shard").collect():
        found.setdefault(r["vec_id"], []).append(r["shard"])
    return found, parts.groupBy("shard").count().agg(F.max("count")).first()[0]


def test_copies_fill_no_shard(spark):
    """800 copies of one vector, 200 other rows: each row in two shards, none of more than 100 rows."""
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 5 else rng.normal(size=4).tolist()) for i in range(1000)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    parts, centers = clustering.partition(base, most_rows=100)
    found, largest = shards_of(parts)
    assert len(found) == 1000 and all(len(s) == len(set(s)) == 2 for s in found.values()) and largest <= 100
    assert len(centers) < 200


def test_small_bases_have_two_shards_too(spark, small_dir, tmp_path):
    for n in (1, 2, 100):
        catalog.embeddings(spark, small_dir).where(F.col("vec_id") < n).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        row = catalog.queries()["kmeans_partition"](spark, f"{tmp_path}/{n}").first()
        assert (row["n"], row["n_ids"], row["least_shards"], row["most_shards"], row["within_bound"]) == (2 * n, n, 2, 2, True)
        found, _ = shards_of(clustering.partition(catalog.embeddings(spark, f"{tmp_path}/{n}"), 300, alone=False)[0])
        assert all(sorted(s) == [0, 1] for s in found.values()) and len(found) == n


def test_rows_are_in_their_nearest_shards(spark, small_dir, monkeypatch):
    """Large shards get centers; nothing is fitted to all rows for all shards at once."""
    fits = []
    fit = clustering.kmeans_of
    monkeypatch.setattr(clustering, "kmeans_of", lambda x, k, **more: fits.append(len(x) * k) or fit(x, k, **more))
    base = catalog.embeddings(spark, small_dir)
    parts, centers = clustering.partition(base, most_rows=12)
    found, largest = shards_of(parts)
    assert largest <= 12 and len(found) == 500 and max(fits) <= 500 * 64 and len(centers) > 80
    for r in base.where("vec_id < 40").collect():
        d = ((centers - np.array(r["embedding"])) ** 2).sum(1)
        assert set(found[r["vec_id"]]) == set(np.argsort(d)[:2].tolist())
