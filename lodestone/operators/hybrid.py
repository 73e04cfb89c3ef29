"""Label-constrained search: a route for each query by the share of rows that its label expression holds.

Queries carry their expression (qid, qv, expression). Expressions are evaluated once for
a batch of rows and each distinct text, where the labels lie; no pair of a query and a
row is made but for those that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import labels as label_functions
from lodestone.functions.vectors import squared_l2
from lodestone.operators import graph as graphs
from lodestone.operators import knn, quantizer


def _over_texts(block: pa.Table, rows: DataFrame, emit, schema: str) -> DataFrame:
    """emit(texts, masks, ids) of each batch of rows; masks come one at a time."""
    texts = sorted(set(block["expression"].to_pylist()))
    shared = rows.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = ((n, label_functions.arrow_rows_that_hold(t, batch.column(1), batch.column(2))) for n, t in enumerate(shared.value))
            yield from emit(masks, batch.column(0).to_numpy())

    return rows.select("vec_id", "labels", "is_universal").mapInArrow(run, schema), texts


def candidates(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, vec_id) of the rows that each query's expression holds: one scan for a block of queries."""
    found = []
    for block in knn.blocks(queries.select("qid", "expression")):

        def emit(masks, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            for n, mask in masks:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(mask.sum()), n, np.int32)), pa.array(ids[mask])], ["text", "vec_id"])

        pairs, texts = _over_texts(block, rows, emit, "text int, vec_id long")
        number = {t: n for n, t in enumerate(texts)}
        named = rows.sparkSession.createDataFrame([(q, number[t]) for q, t in zip(block["qid"].to_pylist(), block["expression"].to_pylist(), strict=True)], "qid long, text int")
        found.append(pairs.join(named, "text").select("qid", "vec_id"))
    return reduce(DataFrame.unionByName, found)


def counts(block: pa.Table, rows: DataFrame) -> dict[str, int]:
    """Rows that each distinct expression of a block of queries holds; counted in the tasks."""

    def emit(masks, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums = [(n, int(mask.sum())) for n, mask in masks]
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in sums], pa.int32()), pa.array([s[1] for s in sums], pa.int64())], ["text", "n"])

    sums, texts = _over_texts(block, rows, emit, "text int, n long")
    found = {texts[r["text"]]: r["n"] for r in sums.groupBy("text").agg(F.sum("n").alias("n")).collect()}  # one row for each text of the block
    return {t: found.get(t, 0) for t in texts}


def route(n: int, total: int, threshold: float) -> str:
    return "scan" if not total or n / total < threshold else "graph"


def routes(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(qid, n, hit_rate, path): scan below the threshold, graph from it on."""
    total = rows.count()
    found = []
    for block in knn.blocks(queries.select("qid", "expression")):
        n = counts(block, rows)
        found += [(q, n[t], round(n[t] / total, 6) if total else 0.0, route(n[t], total, threshold)) for q, t in zip(block["qid"].to_pylist(), block["expression"].to_pylist(), strict=True)]
    return rows.sparkSession.createDataFrame(found, "qid long, n long, hit_rate double, path string")


def exact(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The definition that the approximate paths are held against; rows have embedding, labels, is_universal."""
    return knn.exact_knn(queries, rows, k)


def search(queries: DataFrame, rows: DataFrame, graph: DataFrame, coded: DataFrame, book, k: int, threshold: float = 0.1, multiplier: int = 3, size: int = 160, centers=None, probes: int = 4) -> DataFrame:
    """(qid, rank, vec_id, dist, path). Queries with at most k candidates return them all, by the scan.

    coded: vec_id, embedding, labels, is_universal and code. The scan takes code
    distances of the rows that the expression holds, measures the best k * multiplier of
    them exactly and keeps the best k.
    """
    total = rows.count()
    parts = []
    for block in knn.blocks(queries.select("qid", "qv", "expression")):
        n = counts(block, rows)
        paths = ["scan" if n[t] <= k else route(n[t], total, threshold) for t in block["expression"].to_pylist()]
        by_path = {p: block.filter(pa.array([x == p for x in paths], pa.bool_())) for p in ("scan", "graph")}
        if len(by_path["scan"]):
            near = knn.top(quantizer.scan_block(by_path["scan"], coded, book, k * multiplier), k * multiplier)
            asked = rows.sparkSession.createDataFrame(by_path["scan"].select(["qid", "qv"]))
            parts.append(quantizer.rerank(near, asked, coded, k, squared_l2).withColumn("path", F.lit("scan")))
        if len(by_path["graph"]):
            found = graphs.search_block(graph, by_path["graph"], k, size, "beam", book=book, centers=centers, probes=probes)
            parts.append(found.withColumn("path", F.lit("graph")))
    if not parts:
        return rows.sparkSession.createDataFrame([], "qid long, rank long, vec_id long, dist double, path string")
    return reduce(DataFrame.unionByName, parts)
