"""Exact nearest neighbours: blocks of queries against all rows, the top k so far in each task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import labels as label_functions
from lodestone.functions import vectors

#: Queries that are broadcast at once; more go in blocks.
QUERY_BLOCK = 4096
#: Pairs whose products a task holds at once, rows of the base among them, and pairs that are measured at once.
TILE, TILE_ROWS, PAIRS = 1 << 20, 2048, 1 << 14
#: Components of the vectors of a block in the grid of an exact search, its blocks' pairs at least, and rows opened at once.
BLOCK_VALUES, TILES, TILE_BATCH = 1 << 22, 64, 16_384


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def vectors_of(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the vectors of this length whose components are all finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dimension)
    x = matrix(column if len(at) == len(column) else column.take(pa.array(at))) if len(at) and dimension else np.zeros((len(at), dimension))
    good = np.isfinite(x).all(1)  # a null component reads as NaN
    return (at, x) if good.all() else (at[good], x[good])


def usable(rows: DataFrame, dimension: int | None = None, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has this length, or the commonest (of equally common ones the greater), and finite components only."""
    v = F.col(vector)
    if dimension is None:
        sizes = rows.where(F.size(v) > 0).groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
        dimension = sizes.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"] or -2  # no vector has a length below 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where((F.size(v) == dimension) & finite)


def top(df: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k least (dist, vec_id) of each group, with their rank from 1."""
    w = Window.partitionBy(by).orderBy("dist", "vec_id")
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def exact_knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", skip_self: bool = False) -> DataFrame:
    """(qid, rank, vec_id, dist) from queries (qid, qv) and base (vec_id, embedding).

    queries may have a column expression, base then has labels and is_universal: a
    query's rows are those that its expression holds.

    Each task keeps k rows for each of its queries, so the shuffle carries at most
    k rows for each query and task, whatever the size of the base. Vectors are
    compared with those of their length; a null vector, or one with null or
    non-finite components, is no neighbour and has none. The cosine distance from a
    zero vector is 1.
    """
    found = _meeting(_asked(queries), base, lambda qids, q, bounds: _Nearest(qids, q, metric, k, skip_self))
    return top(found, k).select("qid", "rank", "vec_id", "dist")


def within(queries: DataFrame, base: DataFrame, metric: str = "l2") -> DataFrame:
    """(qid, vec_id, dist) of all rows no farther from a query (qid, qv, most) than its distance most."""
    return _meeting(_asked(queries, "most"), base, lambda qids, q, bounds: _Within(qids, q, metric, bounds))


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask that holds little: eight places are looked at as one."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[words])
    return 8 * words[i] + j


class _Within:
    """Queries that meet the base batch by batch: all rows no farther from a query than its bound.

    Products of tiles of TILE pairs tell what may be near enough, in single precision
    where the numbers allow it and with a margin for their rounding; only that is measured, row by
    row in double precision. So memory is bounded by the tile and by what is found.
    """

    def __init__(self, qids: np.ndarray, q: np.ndarray, metric: str, bounds: np.ndarray):
        self.qids, self.q, self.metric, self.bounds = qids, q, metric, bounds
        self.squares = (q * q).sum(1)
        self.most = np.abs(q).max(initial=0.0)
        self.sides: dict[type, np.ndarray] = {}

    def _side(self, x: np.ndarray, kind: type, margin: float, queries: bool) -> np.ndarray:
        """Factors whose product is 2qx - x² less the margin; for cosine the similarity."""
        if self.metric == "cosine":
            norm = np.sqrt((x * x).sum(1))[:, None]
            return (x / np.where(norm > 0, norm, np.inf)).astype(kind)
        more = np.ones((len(x), 1)) if queries else -(1 - margin) * (x * x).sum(1)[:, None]
        return np.concatenate([x if queries else 2 * x, more], 1).astype(kind)

    def _least(self, part: slice, kind: type, margin: float) -> np.ndarray:
        """The product that a row at the bound has at least."""
        bound = self.bounds[part]
        if self.metric == "cosine":
            return (1 - bound - 2 * margin).astype(kind)
        return ((1 - 2 * margin) * self.squares[part] - (1 + 2 * margin) * bound - (1e-30 if kind is np.float32 else 0)).astype(kind)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> Iterator[Found]:
        """(positions of queries, ids, distances) that are certain already."""
        with np.errstate(all="ignore"):
            most = max(self.most, np.abs(x).max(initial=0.0))
            kind = np.float32 if 1e-6 < most < 1e6 else np.float64
            margin = (x.shape[1] + 16) * float(np.finfo(kind).eps)
            if kind not in self.sides:
                self.sides[kind] = self._side(self.q, kind, margin, True)
            mine = self.sides[kind]
            for start in range(0, len(ids), TILE_ROWS):
                some, y = ids[start : start + TILE_ROWS], x[start : start + TILE_ROWS]
                side = np.ascontiguousarray(self._side(y, kind, margin, False).T)
                tall = TILE // len(some)
                for at in range(0, len(mine), tall):
                    part = slice(at, at + tall)
                    products = mine[part] @ side
                    self._narrow(part, products, some, y)
                    near = _places(products >= self._least(part, kind, margin)[:, None])
                    for n in range(0, len(near), PAIRS):
                        i, j = np.divmod(near[n : n + PAIRS], len(some))
                        i += at
                        dist = vectors.exact(self.metric, self.q[i], y[j])
                        good = (dist <= self.bounds[i]) & np.isfinite(dist)
                        if good.any():
                            yield from self._take(i[good], some[j[good]], dist[good])

    def _narrow(self, part: slice, products: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Bounds that a tile tells; given ones stay."""

    def _take(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> Iterator[Found]:
        yield at, ids, dist

    def rest(self) -> Iterator[Found]:
        """What is certain only when all rows were met."""
        yield from ()


class _Nearest(_Within):
    """The k nearest rows of each query by (distance, id); the bound is the k-th distance so far."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, metric: str, k: int, skip_self: bool):
        super().__init__(qids, q, metric, np.full(len(qids), np.inf))
        self.k, self.skip_self = k, skip_self
        self.ids, self.dist = np.zeros((len(qids), k), np.int64), np.full((len(qids), k), np.inf)

    def _narrow(self, part: slice, products: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """A query without a bound takes the k-th distance of the rows of its greatest products."""
        few = self.k + self.skip_self
        open_ = np.flatnonzero(np.isinf(self.bounds[part]))
        if not len(open_) or len(ids) <= few:
            return
        step = max(1, PAIRS // few)
        for at in range(0, len(open_), step):
            i = open_[at : at + step]
            best = np.argpartition(products[i], len(ids) - few, 1)[:, len(ids) - few :]
            i = i + part.start
            dist = vectors.exact(self.metric, self.q[np.repeat(i, few)], x[best.ravel()]).reshape(best.shape)
            if self.skip_self:
                dist[ids[best] == self.qids[i][:, None]] = np.inf
            kth = np.partition(dist, self.k - 1, 1)[:, self.k - 1]
            self.bounds[i] = np.where(np.isfinite(kth), kth, np.inf)

    def _take(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> Iterator[Found]:
        if self.skip_self:
            other = self.qids[at] != ids
            at, ids, dist = at[other], ids[other], dist[other]
        met = np.unique(at)
        held = np.isfinite(self.dist[met])
        at = np.concatenate([at, np.repeat(met, held.sum(1))])
        ids, dist = np.concatenate([ids, self.ids[met][held]]), np.concatenate([dist, self.dist[met][held]])
        order = np.lexsort((ids, dist, at))
        at, ids, dist = at[order], ids[order], dist[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        self.ids[at[kept], rank[kept]], self.dist[at[kept], rank[kept]] = ids[kept], dist[kept]
        self.bounds[met] = np.minimum(self.bounds[met], self.dist[met, self.k - 1])
        yield from ()

    def rest(self) -> Iterator[Found]:
        for start in range(0, len(self.qids), PAIRS):
            i, j = np.nonzero(np.isfinite(self.dist[start : start + PAIRS]))
            yield i + start, self.ids[i + start, j], self.dist[i + start, j]


def _asked(queries: DataFrame, *more: str) -> DataFrame:
    return queries.select("qid", "qv", *more, *[c for c in queries.columns if c == "expression"])


def _grouped(block: pa.Table) -> list[tuple[int, str | None, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(dimension, expression, qids, vectors, bounds) of queries that go together: of one length and one expression."""
    parts, labelled = [], "expression" in block.column_names
    lengths = pc.fill_null(pc.list_value_length(block["qv"]), -1).to_numpy()
    texts = block["expression"].to_pylist() if labelled else [None] * len(block)
    qids = block["qid"].to_numpy()
    bounds = block["most"].to_numpy() if "most" in block.column_names else None
    for d in np.unique(lengths[lengths > 0]).tolist():
        at, q = vectors_of(block["qv"], d)
        by_text: dict[str | None, list[int]] = {}
        for n, i in enumerate(at.tolist()):
            by_text.setdefault(texts[i], []).append(n)
        parts += [(d, text, qids[at[rows]], q[rows], None if bounds is None else bounds[at[rows]].astype(float)) for text, rows in by_text.items()]
    return parts


def _met(parts: list, make: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, vec_id, dist) of what each group of queries takes from the batches; expressions are told for a batch once."""
    groups = [make(qids, q, bounds) for _, _, qids, q, bounds in parts]

    def told(group: _Within, found: Iterator[Found]) -> Iterator[pa.RecordBatch]:
        for at, ids, dist in found:
            yield pa.RecordBatch.from_arrays([pa.array(group.qids[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())], ["qid", "vec_id", "dist"])

    for batch in batches:
        ids = batch.column(0).to_numpy()
        opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for (d, text, *_), group in zip(parts, groups, strict=True):
            if d not in opened:
                opened[d] = vectors_of(batch.column(1), d)
            at, x = opened[d]
            if text is not None:
                inside = label_functions.arrow_rows_that_hold(text, batch.column(2), batch.column(3))[at]
                at, x = at[inside], x[inside]
            if len(at):
                yield from told(group, group.meet(ids[at], x))
    for group in groups:
        yield from told(group, group.rest())


def _meeting(queries: DataFrame, base: DataFrame, make: Callable) -> DataFrame:
    """(qid, vec_id, dist) of what make(qids, queries, bounds) takes from the base.

    Up to QUERY_BLOCK queries are broadcast. More are cut into blocks by a hash of the
    qid, as the base is by a hash of its id, and a task has one block of each: no
    query goes through the driver, and memory is bounded by the blocks.
    """
    base = base.select("vec_id", "embedding", *(["labels", "is_universal"] if "expression" in queries.columns else []))
    schema = "qid long, vec_id long, dist double"
    first = queries.limit(QUERY_BLOCK + 1).toArrow()
    if len(first) <= QUERY_BLOCK:
        shared = base.sparkSession.sparkContext.broadcast(_grouped(first.sort_by("qid")))
        return base.mapInArrow(lambda batches: _met(shared.value, make, batches), schema)
    sizes = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qv")).alias("d")).first()
    rows = max(base.count(), 1)
    # a tile of the grid is bounded; below that there are about TILES of them, for all cores, unless they are small
    most = max(1, min(BLOCK_VALUES // max(sizes["d"] or 1, 1), max(1024, math.ceil(math.sqrt(sizes["n"] * rows / TILES)))))
    across, down = math.ceil(sizes["n"] / most), math.ceil(rows / most)

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(across * down, "__q", "__b")

    left = dealt(queries, "qid", "__q", across, "__b", down).groupBy("__q", "__b")
    right = dealt(base, "vec_id", "__b", down, "__q", across).groupBy("__q", "__b")

    def tile(some: pa.Table, others: pa.Table) -> pa.Table:
        names = [c for c in others.column_names if c not in ("__q", "__b")]
        found = list(_met(_grouped(some), make, iter(others.select(names).to_batches(max_chunksize=TILE_BATCH))))
        return pa.Table.from_batches(found) if found else pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})

    return left.cogroup(right).applyInArrow(tile, schema)


def blocks(queries: DataFrame, most: int | None = None) -> Iterator[pa.Table]:
    """The queries in blocks of about so many at most, as Arrow tables; one empty block if there are none.

    More than one block is dealt by a hash of the qid, so that no block sorts the others.
    """
    most = most or QUERY_BLOCK
    first = queries.limit(most + 1).toArrow()
    if len(first) <= most:
        yield first.sort_by("qid")
        return
    n = math.ceil(1.1 * queries.count() / most)
    for number in range(n):
        yield queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == number).toArrow().sort_by("qid")


def restrict_truth(truth: DataFrame, start: int, end: int, k: int) -> DataFrame:
    """Truth rows whose id lies in [start, end), ranked anew; only queries that keep k of them."""
    kept = top(truth.where(F.col("vec_id").between(start, end - 1)).drop("rank"), k)
    full = kept.groupBy("qid").count().where(F.col("count") == k).select("qid")
    return kept.join(full, "qid", "left_semi")
