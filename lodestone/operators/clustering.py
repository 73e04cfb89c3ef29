"""Centroids, medoid, Lloyd iterations, and overlapping partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators.knn import matrix, usable, vectors_of


def mean_vector(base: DataFrame) -> DataFrame:
    """(dim, mean): aggregated in the JVM, one row for each dimension after the partial sums."""
    return base.select(F.posexplode(vectors.doubles(F.col("embedding"))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def medoid(base: DataFrame) -> DataFrame:
    """The row nearest to the mean, ties to the least id: (vec_id, dist)."""
    mean = mean_vector(base).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("mean"))
    dist = base.crossJoin(F.broadcast(mean)).select("vec_id", vectors.squared_l2(F.col("embedding"), F.col("mean")).alias("dist"))
    return dist.agg(F.min(F.struct("dist", "vec_id")).alias("m")).select("m.vec_id", "m.dist")


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of a bounded number of rows to all centers."""
    return vectors.METRICS["l2"][1](x, centers)


def nearest(x: np.ndarray, centers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centers, squared distances) of the k nearest of each row, ties to the least center.

    Products find the few that can be among them, which are then measured one by one.
    """
    k = min(k, len(centers))
    few = min(k + 4, len(centers))
    found, dist = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    step = max(1, min(4096, (1 << 21) // len(centers)))
    for at in range(0, len(x), step):
        y = x[at : at + step]
        rough = vectors.METRICS["l2"][1](y, centers)
        near = np.sort(np.argpartition(rough, few - 1, 1)[:, :few], 1) if few < len(centers) else np.tile(np.arange(few), (len(y), 1))
        d = np.stack([((y - centers[near[:, j]]) ** 2).sum(1) for j in range(few)], 1)
        order = np.argsort(d, 1, kind="stable")[:, :k]
        found[at : at + step], dist[at : at + step] = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
    return found, dist


def nearest_centers(base: DataFrame, centers: np.ndarray, k: int = 1) -> DataFrame:
    """base's columns and rank, center, dist: the k nearest of a bounded set of centers.

    Rows whose vector is null, of another length than the centers, or not finite are left out.
    """
    shared = base.sparkSession.sparkContext.broadcast(np.asarray(centers, np.float64))
    at_vector = base.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            at, x = vectors_of(batch.column(at_vector), c.shape[1])
            found, dist = nearest(x, c, k)
            kept = found.shape[1]
            row = pa.array(np.repeat(at, kept))
            yield pa.RecordBatch.from_arrays(
                [*(column.take(row) for column in batch.columns), pa.array(np.tile(np.arange(1, kept + 1), len(x))), pa.array(found.ravel()), pa.array(dist.ravel())],
                [*batch.schema.names, "rank", "center", "dist"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{kinds}, rank long, center long, dist double")


def lloyd_step(base: DataFrame, centers: np.ndarray) -> DataFrame:
    """(center, n, residual, mean): each task sums its rows, so the shuffle carries one row for a center and task."""
    shared = base.sparkSession.sparkContext.broadcast(np.asarray(centers, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n, residual, sums = np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros_like(c)
        for batch in batches:
            _, x = vectors_of(batch.column(0), c.shape[1])
            if len(x):
                found, dist = nearest(x, c, 1)
                n += np.bincount(found[:, 0], minlength=len(c))
                residual += np.bincount(found[:, 0], weights=dist[:, 0], minlength=len(c))
                np.add.at(sums, found[:, 0], x)
        met = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * c.shape[1], pa.int32()), pa.array(sums[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(residual[met]), lists], ["center", "n", "residual", "sums"])

    parts = base.select("embedding").mapInArrow(run, "center long, n long, residual double, sums array<double>")
    totals = parts.groupBy("center").agg(F.sum("n").alias("n"), F.sum("residual").alias("residual"))
    means = parts.select("center", F.posexplode("sums").alias("dim", "x")).groupBy("center", "dim").agg(F.sum("x").alias("x"))
    means = means.groupBy("center").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("sums"))
    return totals.join(means, "center").select("center", "n", "residual", F.transform("sums", lambda x: x / F.col("n")).alias("mean"))


def seeded(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Starting centers: rows picked with a chance that grows with the distance from those picked before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(int(rng.choice(len(x), p=p)))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].copy()


def sampled(base: DataFrame, rows: int, seed: int) -> np.ndarray:
    """The vectors of a bounded sample, ordered by a hash of the id."""
    picked = usable(base).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(rows).select("embedding").toArrow()
    return matrix(picked["embedding"]) if len(picked) else np.zeros((0, 1))


def kmeans(base: DataFrame, k: int, rounds: int = 20, seed: int = 7, tolerance: float = 1e-5, sample: int = 20_000) -> np.ndarray:
    """Centers after seeding on a bounded sample and Lloyd rounds over all rows.

    An empty cluster keeps its center. Stops when the residual falls by less than tolerance.
    """
    centers, before = seeded(sampled(base, max(sample, k), seed), k, seed), math.inf
    for _ in range(rounds):
        step = lloyd_step(base, centers).collect()  # k rows
        for r in step:
            centers[r["center"]] = r["mean"]
        residual = sum(r["residual"] for r in step)
        if before - residual <= tolerance * before:
            break
        before = residual
    return centers


def kmeans_of(x: np.ndarray, k: int, rounds: int = 20, seed: int = 7, tolerance: float = 1e-5) -> np.ndarray:
    """Centers of rows in memory, by the same steps."""
    centers, before = seeded(x, k, seed), math.inf
    for _ in range(rounds):
        found, dist = nearest(x, centers, 1)
        n = np.bincount(found[:, 0], minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, found[:, 0], x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        residual = dist.sum()
        if before - residual <= tolerance * before:
            break
        before = residual
    return centers


def fitted(x: np.ndarray, k: int, seed: int = 7, most: int = 64) -> np.ndarray:
    """k centers of rows in memory; more than `most` in two steps, each coarse cluster by its share of the rows."""
    if not len(x):
        return np.zeros((k, x.shape[1] or 1))
    if k <= most or len(x) <= most:
        centers = kmeans_of(x, k, seed=seed)
    else:
        coarse = math.ceil(math.sqrt(k))
        cell = nearest(x, kmeans_of(x, coarse, seed=seed), 1)[0][:, 0]
        sizes = np.bincount(cell, minlength=coarse)
        share = np.diff(np.floor(np.cumsum(sizes) * (k / len(x)) + 0.5).astype(int), prepend=0)
        centers = np.concatenate([fitted(x[cell == i], int(n), seed, most) for i, n in enumerate(share) if n])
    # fewer rows than centers: some are there more than once
    return centers[np.arange(k) % len(centers)]


def _dealt(ids: np.ndarray, found: np.ndarray, inverse: np.ndarray, copies: list[np.ndarray], k: int) -> np.ndarray:
    """Of each row's nearest different centers (found), the first k shards: those of one center in an order by a hash of the id."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    out = np.empty((len(ids), k), np.int64)
    filled = np.zeros(len(ids), np.int64)
    sizes = np.array([len(c) for c in copies])
    table = np.full((len(copies), sizes.max()), -1, np.int64)
    for i, c in enumerate(copies):
        table[i, : len(c)] = c
    for column in found.T:
        n = sizes[column]
        for step in range(k):
            rows = np.flatnonzero((step < n) & (filled < k))
            if not len(rows):
                break
            out[rows, filled[rows]] = table[column[rows], (h[rows].astype(np.int64) + step) % n[rows]]
            filled[rows] += 1
    return out


def placed(base: DataFrame, centers: np.ndarray, overlap: int) -> DataFrame:
    """base's columns and shard: each row in the shards of its `overlap` nearest centers, or in all there are.

    Rows as near to several equal centers are dealt to these by a hash of the id, so
    copies of one vector fill no shard beyond its bound.
    """
    overlap = min(overlap, len(centers))
    different, inverse = np.unique(np.asarray(centers, np.float64), axis=0, return_inverse=True)
    copies = [np.flatnonzero(inverse.ravel() == i) for i in range(len(different))] if len(different) < len(centers) else [np.array([i]) for i in np.argsort(inverse.ravel())]
    shared = base.sparkSession.sparkContext.broadcast((different, inverse, copies))
    at_id, at_vector = base.columns.index("vec_id"), base.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        different, inverse, copies = shared.value
        for batch in batches:
            at, x = vectors_of(batch.column(at_vector), different.shape[1])
            found = nearest(x, different, overlap)[0]
            shards = _dealt(batch.column(at_id).to_numpy()[at], found, inverse, copies, overlap) if len(at) else np.zeros((0, overlap), np.int64)
            row = pa.array(np.repeat(at, overlap))
            yield pa.RecordBatch.from_arrays([*(column.take(row) for column in batch.columns), pa.array(shards.ravel(), pa.int32())], [*batch.schema.names, "shard"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{kinds}, shard int")


def partition(
    base: DataFrame, most_rows: int, overlap: int = 2, start: int = 3, seed: int = 7, sample: int = 100_000, centers: np.ndarray | None = None, alone: bool = True,
) -> tuple[DataFrame, np.ndarray]:
    """(base's columns and shard; the shards' centers): each row in its `overlap` nearest shards, more shards until each fits.

    A base that fits one shard is one, if it may be alone; else it has `start` shards, or
    `overlap` of all rows.

    Centers are fitted to a bounded sample, 32 rows for a shard at least; sizes are
    counted over all rows. A shard that is too large gets more centers, fitted to a
    sample of its rows; the others stay, so they only shrink.
    """
    if centers is not None:
        return placed(base, centers, overlap), centers
    total = base.count()
    shards = max(start, math.ceil(overlap * total / most_rows)) if total > most_rows else 1 if alone else overlap
    centers = fitted(sampled(base, max(sample, 32 * shards), seed), shards, seed)
    while overlap < len(centers) < 4 * overlap * total:
        sizes = placed(base.select("vec_id", "embedding"), centers, overlap).groupBy("shard").count().where(F.col("count") > most_rows)
        large = {r["shard"]: r["count"] for r in sizes.collect()}  # at most one row for a shard
        if not large:
            break
        # as many rows as the first fit had at most, by a hash of the id
        share = min(1.0, max(sample, 32 * len(centers)) / sum(large.values()))
        some = base.select("vec_id", "embedding").where(F.pmod(F.xxhash64("vec_id", F.lit(seed + len(centers))), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
        rows = placed(some, centers, overlap).where(F.col("shard").isin(list(large))).select("shard", "embedding").toArrow()
        x, shard = matrix(rows["embedding"]), rows["shard"].to_numpy()
        more = [fitted(x[shard == i] if (shard == i).any() else centers[i : i + 1], max(1, math.ceil(1.25 * n / most_rows) - 1), seed) for i, n in sorted(large.items())]
        centers = np.concatenate([centers, *more])
    return placed(base, centers, overlap), centers


def memory_estimate(rows: int, dimension: int, bytes_each: int, degree: int, slack: float = 1.3) -> float:
    """Bytes of a graph index over so many rows."""
    return 1.1 * rows * (dimension * bytes_each + degree * slack * 4)


def quantizer_chunks(budget_bytes: float, rows: int, dimension: int) -> int:
    return max(1, min(int(budget_bytes // max(rows, 1)), dimension, 128))
