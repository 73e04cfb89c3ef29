"""Product quantisation: contiguous chunks of the centred vector, each coded by its nearest center."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import labels as label_functions
from lodestone.operators import clustering, knn
from lodestone.operators.knn import matrix, vectors_of


def chunk_borders(dimension: int, chunks: int) -> list[int]:
    """The first dimension % chunks chunks are one longer."""
    short, longer = divmod(dimension, chunks)
    return np.cumsum([0] + [short + (i < longer) for i in range(chunks)]).tolist()


@dataclass(frozen=True)
class Codebook:
    """centers[chunk] is (codes, width of the chunk); its size is fixed by codes and dimension."""

    mean: np.ndarray
    borders: list[int]
    centers: list[np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The first nearest center of each chunk."""
        y = x - self.mean
        parts = zip(self.borders, self.borders[1:], self.centers, strict=False)
        return np.stack([_first_nearest(y[:, a:b], c) for a, b, c in parts], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centers)], 1) + self.mean

    def table(self, query: np.ndarray) -> np.ndarray:
        """Squared distances of the query's chunks to each center: (chunks, codes)."""
        y = query - self.mean
        parts = zip(self.borders, self.borders[1:], self.centers, strict=False)
        return np.stack([((c - y[a:b]) ** 2).sum(1) for a, b, c in parts])

    def between(self) -> np.ndarray:
        """Squared distances of all pairs of centers: (chunks, codes, codes)."""
        return np.stack([((c[:, None] - c[None]) ** 2).sum(2) for c in self.centers])


def _first_nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest center of each row, the first of equally near ones: by differences, in blocks."""
    found = np.empty(len(y), np.int64)
    step = max(1, (1 << 20) // max(c.size, 1))
    for at in range(0, len(y), step):
        found[at : at + step] = ((y[at : at + step, None, :] - c[None]) ** 2).sum(2).argmin(1)
    return found


def _nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest center of each row, by blocks."""
    found = np.empty(len(y), np.int64)
    squares = (c**2).sum(1)
    for at in range(0, len(y), 8192):
        found[at : at + 8192] = (squares[None, :] - 2 * y[at : at + 8192] @ c.T).argmin(1)
    return found


def train(base: DataFrame, chunks: int, codes: int = 256, rounds: int = 15, sample: int = 256_000, seed: int = 11) -> Codebook:
    """Fit to at most `sample` rows, those that come first by a hash of the id."""
    x = clustering.sampled(base, sample, seed)
    if not len(x):
        raise ValueError("no vector to train on")
    mean = x.mean(0)
    borders = chunk_borders(x.shape[1], chunks)
    rng = np.random.default_rng(seed)
    centers = []
    for a, b in zip(borders, borders[1:], strict=False):
        y = x[:, a:b] - mean[a:b]
        c = y[rng.choice(len(y), min(codes, len(y)), replace=False)].copy()
        for _ in range(rounds):
            near = _nearest(y, c)
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, y)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        centers.append(c)
    return Codebook(mean, borders, centers)


def book_table(spark: SparkSession, book: Codebook) -> DataFrame:
    """(chunk, code, first, center) of a codebook, and its mean in the row of chunk -1."""
    rows = [(-1, -1, 0, book.mean.tolist())]
    rows += [(chunk, code, a, c.tolist()) for chunk, (a, centers) in enumerate(zip(book.borders, book.centers, strict=False)) for code, c in enumerate(centers)]
    return spark.createDataFrame(rows, "chunk int, code int, first int, center array<double>").coalesce(1)


def read_book(table: DataFrame) -> Codebook:
    """The codebook of such a table, whose size is fixed by codes and dimension; a table with gaps is an error."""
    rows = sorted(table.collect(), key=lambda r: (r["chunk"], r["code"]))
    mean = next((np.array(r["center"]) for r in rows if r["chunk"] == -1), None)
    if mean is None:
        raise ValueError("the codebook has no mean")
    by_chunk: dict[int, list] = {}
    for r in rows:
        if r["chunk"] >= 0:
            by_chunk.setdefault(r["chunk"], []).append(r)
    borders, centers = [0], []
    for chunk in range(len(by_chunk)):
        found = by_chunk.get(chunk, [])
        if [r["code"] for r in found] != list(range(len(found))) or not found or found[0]["first"] != borders[-1]:
            raise ValueError(f"chunk {chunk} of the codebook has gaps")
        centers.append(np.array([r["center"] for r in found]))
        borders.append(borders[-1] + centers[-1].shape[1])
    if borders[-1] != len(mean):
        raise ValueError("the codebook's chunks do not make up its mean")
    return Codebook(mean, borders, centers)


def encode(base: DataFrame, book: Codebook) -> DataFrame:
    """base's columns and code, an array of small integers; rows whose vector the book cannot code (null, of
    another length, not finite) are left out."""
    shared = base.sparkSession.sparkContext.broadcast(book)
    at_vector = base.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors_of(batch.column(at_vector), len(shared.value.mean))
            codes = shared.value.encode(x) if len(x) else np.zeros((0, 1), np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int16()))
            row = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(column.take(row) for column in batch.columns), lists], [*batch.schema.names, "code"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{kinds}, code array<short>")


def decode(coded: DataFrame, book: Codebook) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(book)

    @F.arrow_udf("array<double>")
    def inflate(codes: pa.Array) -> pa.Array:
        x = shared.value.decode(matrix(codes).astype(int))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    return coded.withColumn("decoded", inflate("code"))


def scan(queries: DataFrame, coded: DataFrame, book: Codebook, k: int, symmetric: bool = False, places: int | None = None) -> DataFrame:
    """(qid, rank, vec_id, dist) by codes alone: to the query itself, or to its code if symmetric.

    queries (qid, qv) go in blocks, one pass each; each task keeps k rows for each
    query and batch. With a column expression (coded then has labels and
    is_universal) a query's rows are those that its expression holds. Distances are
    rounded to so many places, if given, before they are compared.
    """
    wanted = [c for c in ("qid", "qv", "expression") if c in queries.columns]
    found = [scan_block(block, coded, book, k, symmetric, places) for block in knn.blocks(queries.select(*wanted))]
    return knn.top(reduce(DataFrame.unionByName, found), k).select("qid", "rank", "vec_id", "dist")


def scan_block(block: pa.Table, coded: DataFrame, book: Codebook, k: int, symmetric: bool = False, places: int | None = None, group: int = 64) -> DataFrame:
    """(qid, vec_id, dist) of one block of queries, k rows of each batch."""
    at, q = vectors_of(block["qv"], len(book.mean))
    qids = block["qid"].to_numpy()[at]
    labelled = "expression" in block.column_names
    texts = [block["expression"][int(i)].as_py() for i in at] if labelled else [None] * len(at)
    order = sorted(range(len(at)), key=lambda i: (texts[i] or "", qids[i]))
    shared = coded.sparkSession.sparkContext.broadcast((book, qids[order], q[order], [texts[i] for i in order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, qids, q, texts = shared.value
        between = book.between() if symmetric else None
        cuts = [i for i in range(len(qids)) if not i or texts[i] != texts[i - 1]] + [len(qids)]
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            all_ids, all_codes = batch.column(0).to_numpy(), matrix(batch.column(1)).astype(int)
            for a, b in zip(cuts, cuts[1:], strict=False):
                ids, codes = all_ids, all_codes
                if texts[a] is not None:
                    inside = label_functions.arrow_rows_that_hold(texts[a], batch.column(2), batch.column(3))
                    ids, codes = ids[inside], codes[inside]
                if not len(ids):
                    continue
                for start in range(a, b, group):
                    part = slice(start, min(start + group, b))
                    if symmetric:
                        luts = np.stack([between[np.arange(len(c)), c] for c in book.encode(q[part])])
                    else:
                        luts = np.stack([book.table(v) for v in q[part]])
                    dist = np.zeros((luts.shape[0], len(ids)))
                    for c in range(codes.shape[1]):
                        dist += luts[:, c][:, codes[:, c]]
                    if places is not None:
                        dist = np.round(dist, places)
                    keep = min(k, len(ids))
                    # all rows as near as the k-th, so that ties are told by the id
                    last = np.partition(dist, keep - 1, 1)[:, keep - 1]
                    i, j = np.nonzero(dist <= last[:, None])
                    found = dist[i, j]
                    rank_order = np.lexsort((ids[j], found, i))
                    i, j, found = i[rank_order], j[rank_order], found[rank_order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield pa.RecordBatch.from_arrays([pa.array(qids[part][i[best]], pa.int64()), pa.array(ids[j[best]], pa.int64()), pa.array(found[best])], ["qid", "vec_id", "dist"])

    return coded.select("vec_id", "code", *(["labels", "is_universal"] if labelled else [])).mapInArrow(run, "qid long, vec_id long, dist double")


def rerank(near: DataFrame, queries: DataFrame, base: DataFrame, k: int, distance) -> DataFrame:
    """The k nearest of each query's candidates (qid, vec_id) by exact distance."""
    pairs = near.select("qid", "vec_id").join(base.select("vec_id", "embedding"), "vec_id").join(queries.select("qid", "qv"), "qid")
    return knn.top(pairs.select("qid", "vec_id", distance(F.col("qv"), F.col("embedding")).alias("dist")), k).select("qid", "rank", "vec_id", "dist")
