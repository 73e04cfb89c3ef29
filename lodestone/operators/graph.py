"""Proximity graphs: built and searched shard by shard, so that no task holds more than one shard.

A packed graph has one row for each shard: ids, vectors, padded adjacency, labels and
the entry node as flat arrays. So a search is a scan of the shards that a query is sent
to: nothing is shuffled but the best rows of each. Building takes the nearest rows of
each row by blocks of products, prunes them so that a kept neighbour covers what lies
near it, links back and prunes again; searching moves all queries of a block forward
together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import labels as label_functions
from lodestone.operators import knn
from lodestone.operators.clustering import partition

PACKED = "shard int, n int, dimension int, ids binary, vectors binary, nbrs binary, entry int, label_ends binary, labels binary, universal binary, codes binary"
MODES = ("greedy", "beam", "page", "pipe", "interleaved")
#: Rows of a page, for page search: consecutive rows of a shard in the order of the layout.
PAGE_ROWS = 8


def prune_many(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each node from its row of pool (-1 pads): (nodes, degree), nearest first, -1 pads.

    A candidate t is covered by a kept s when ``a * d(s, t) <= d(node, t)``; a grows
    from 1 to alpha in steps of a fifth while there is room. Squared distances.
    """
    there = (pool >= 0) & (pool != nodes[:, None])
    v = x[np.where(there, pool, 0)]
    dist = np.where(there, ((v - x[nodes][:, None, :]) ** 2).sum(2), np.inf)
    order = np.lexsort((pool, dist), axis=1)
    pool, dist = np.take_along_axis(pool, order, 1), np.take_along_axis(dist, order, 1)
    there = np.isfinite(dist)
    again = np.zeros_like(there)
    again[:, 1:] = (pool[:, 1:] == pool[:, :-1]) & there[:, 1:]
    there &= ~again
    v = np.take_along_axis(v, order[:, :, None], 1)
    squares = (v * v).sum(2)
    apart = squares[:, :, None] + squares[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    known = np.where(there, dist, 0.0)
    # rounding of the expansion must not make two rows look equal that are not, or the reverse
    scale = 1e-9 * (squares[:, :, None] + squares[:, None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > scale, known[:, None, :] / apart, np.inf)
    kept = np.zeros_like(there)
    cover = np.where(there, 0.0, np.inf)
    room = np.full(len(nodes), degree)
    a = 1.0
    while a <= alpha + 1e-9 and (room > 0).any():
        for t in range(pool.shape[1]):
            good = (cover[:, t] <= a) & (room > 0)
            if good.any():
                kept[good, t] = True
                room[good] -= 1
                cover[good] = np.maximum(cover[good], ratio[good, t])
                cover[good, t] = np.inf
        a *= 1.2
    place = np.cumsum(kept, 1) - 1
    found = np.full((len(nodes), degree), -1, np.int64)
    row, column = np.nonzero(kept)
    found[row, place[row, column]] = pool[row, column]
    return found


def prune(x: np.ndarray, node: int, pool: np.ndarray, degree: int, alpha: float, most: int = 750) -> np.ndarray:
    """The neighbours of one node, from the `most` nearest of a pool."""
    pool = np.unique(pool[pool != node])
    if not len(pool):
        return pool
    order = np.lexsort((pool, ((x[pool] - x[node]) ** 2).sum(1)))[:most]
    found = prune_many(x, np.array([node]), pool[order][None], degree, alpha)[0]
    return found[found >= 0]


def delta_prune(x: np.ndarray, node: int, links: np.ndarray, new: int, degree: int, alpha: float) -> np.ndarray:
    """The links with one more; beyond the degree exactly one goes: the farthest that another covers, else the farthest."""
    pool = np.unique(np.append(links[links != node], new))
    if len(pool) <= degree:
        return pool
    dist = ((x[pool] - x[node]) ** 2).sum(1)
    order = np.lexsort((pool, dist))
    pool, dist = pool[order], dist[order]
    for at in range(len(pool) - 1, 0, -1):
        if (alpha * ((x[pool[:at]] - x[pool[at]]) ** 2).sum(1) <= dist[at]).any():
            return np.delete(pool, at)
    return pool[:-1]


def _joined(x: np.ndarray, links: np.ndarray, entry: int) -> None:
    """Link whatever the entry does not reach from the nearest reached node with room, else with another's last place."""
    n, degree = links.shape
    reached = np.zeros(n, bool)
    front = np.array([entry])
    while True:
        while len(front):
            reached[front] = True
            front = np.unique(links[front])
            front = front[front >= 0]
            front = front[~reached[front]]
        if reached.all():
            return
        lost = int(np.argmin(reached))
        held = (links >= 0).sum(1)
        ok = np.flatnonzero(reached & (held < degree))
        if len(ok):
            near = ok[np.argmin(((x[ok] - x[lost]) ** 2).sum(1))]
            links[near, held[near]] = lost
        else:  # every reached node is full: the nearest gives up its last link to a node that stays reached
            ok = np.flatnonzero(reached)
            near = ok[np.argmin(((x[ok] - x[lost]) ** 2).sum(1))]
            links[lost, min(held[lost], degree - 1)] = links[near, degree - 1]
            links[near, degree - 1] = lost
        front = np.array([lost])


def build_shard(x: np.ndarray, degree: int, size: int, alpha: float, far: int = 16, block: int = 256) -> tuple[np.ndarray, int]:
    """(padded links, entry node) of one shard.

    A node's pool is its `size` nearest rows and `far` rows picked by a fixed hash,
    which give the long edges; links back join the pool of the other end.
    """
    n = len(x)
    entry = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    if n == 1:
        return np.full((1, degree), -1, np.int64), entry
    y = x.astype(np.float32) if n > 4096 else x
    squares = (y * y).sum(1)
    near = min(size, n - 1)
    rng = np.random.default_rng(n)
    links = np.empty((n, degree), np.int64)
    for at in range(0, n, block):
        rows = np.arange(at, min(at + block, n))
        rough = squares[None, :] - 2 * y[rows] @ y.T
        rough[np.arange(len(rows)), rows] = np.inf
        pool = np.argpartition(rough, near - 1, 1)[:, :near] if near < n - 1 else np.argsort(rough, 1)[:, :near]
        more = rng.integers(0, n, (len(rows), min(far, n - 1)))
        links[rows] = prune_many(x, rows, np.concatenate([pool, more], 1), degree, alpha)
    links = with_reverse(x, links, degree, alpha, block)
    _joined(x, links, entry)
    return links, entry


def with_reverse(x: np.ndarray, links: np.ndarray, degree: int, alpha: float, block: int = 256, most: int = 3) -> np.ndarray:
    """Links in both directions; a node with more than its degree is pruned again, among its `most * degree` nearest."""
    n = len(links)
    row, column = np.nonzero(links >= 0)
    a, b = row, links[row, column]
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = edges // n, edges % n
    dist = np.empty(len(a))
    for at in range(0, len(a), 1 << 16):
        s = slice(at, at + (1 << 16))
        dist[s] = ((x[a[s]] - x[b[s]]) ** 2).sum(1)
    order = np.lexsort((b, dist, a))
    a, b = a[order], b[order]
    starts = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - starts[a]
    width = most * degree
    pools = np.full((n, width), -1, np.int64)
    inside = rank < width
    pools[a[inside], rank[inside]] = b[inside]
    counts = np.bincount(a, minlength=n)
    found = pools[:, :degree].copy()
    full = np.flatnonzero(counts > degree)
    for at in range(0, len(full), block):
        rows = full[at : at + block]
        found[rows] = prune_many(x, rows, pools[rows], degree, alpha)
    return found


class Shard:
    """One packed row, opened."""

    def __init__(self, row: dict):
        self.number, self.n, self.dimension = row["shard"], row["n"], row["dimension"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.wide = len(row["vectors"]) == 8 * self.n * self.dimension
        self.x = np.frombuffer(row["vectors"], "<f8" if self.wide else "<f4").reshape(self.n, self.dimension).astype(np.float64)
        self.links = np.frombuffer(row["nbrs"], "<i4").reshape(self.n, -1).astype(np.int64)
        self.entry = row["entry"]
        self._row = row

    def coded(self, book) -> np.ndarray:
        """The codes of all rows: what is stored, else made here."""
        data = self._row["codes"]
        return book.encode(self.x) if data is None else np.frombuffer(data, "<i2").reshape(self.n, -1).astype(np.int64)

    def label_lists(self, at: np.ndarray) -> tuple[list[list[int]], list[bool]]:
        """Labels and flags of some rows."""
        if self._row["labels"] is None:
            return [[] for _ in at], [False] * len(at)
        ends = np.frombuffer(self._row["label_ends"], "<i4").tolist()
        values = np.frombuffer(self._row["labels"], "<i4").tolist()
        flags = np.frombuffer(self._row["universal"], np.uint8)
        return [values[ends[i - 1] if i else 0 : ends[i]] for i in at.tolist()], [bool(flags[i]) for i in at]

    def holds(self, expression: str) -> np.ndarray:
        """Which rows a label expression holds."""
        if self._row["labels"] is None:
            raise ValueError("the graph was built without labels")
        ends = np.frombuffer(self._row["label_ends"], "<i4")
        values = np.frombuffer(self._row["labels"], "<i4")
        owner = np.repeat(np.arange(self.n), np.diff(ends, prepend=0))
        return label_functions.rows_that_hold(expression, owner, values, np.frombuffer(self._row["universal"], np.uint8) > 0)


def _packed(shard: int, ids: np.ndarray, x: np.ndarray, links: np.ndarray, entry: int, wide: bool, labels=None, universal=None) -> pa.Table:
    ends = values = flags = None
    if labels is not None:
        ends = np.cumsum([len(v) for v in labels]).astype("<i4").tobytes()
        values = np.array([v for row in labels for v in row], "<i4").tobytes()
        flags = np.asarray(universal, np.uint8).tobytes()
    row = (int(shard), len(ids), x.shape[1], ids.astype("<i8").tobytes(), x.astype("<f8" if wide else "<f4").tobytes(), links.astype("<i4").tobytes(), int(entry), ends, values, flags, None)
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array([v], kinds[c.split()[1]]) for n, v, c in zip(names, row, PACKED.split(", "), strict=True)})


def _is_wide(base: DataFrame) -> bool:
    """Whether the vectors need double precision."""
    return base.schema["embedding"].dataType.elementType.simpleString() not in ("float", "tinyint", "smallint")


def build_packed(base: DataFrame, degree: int = 32, size: int = 64, alpha: float = 1.2, most_rows: int = 20_000, overlap: int = 2, centers: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """(packed graph, centers of the shards): a graph for each shard of bounded size.

    base: vec_id, embedding, and labels and is_universal if searches are to be
    filtered. Rows whose vector is null, of another length than most rows, or holds
    null or non-finite values are left out. With one shard there is no overlap.
    """
    base = knn.usable(base)
    wide, labelled = _is_wide(base), "labels" in base.columns
    extra = ["labels", "is_universal"] if labelled else []

    def one(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        order = np.unique(ids, return_index=True)[1]
        group = group.take(pa.array(order))
        x = knn.matrix(group["embedding"])
        links, entry = build_shard(x, degree, size, alpha)
        labels = [v or [] for v in group["labels"].to_pylist()] if labelled else None
        universal = [bool(v) for v in group["is_universal"].to_pylist()] if labelled else None
        return _packed(group["shard"][0].as_py(), ids[order], x, links, entry, wide, labels, universal)

    shards, centers = partition(base.select("vec_id", "embedding", *extra), most_rows, overlap, centers=centers)
    return shards.groupBy("shard").applyInArrow(one, PACKED), centers


def with_codes(packed: DataFrame, book) -> DataFrame:
    """A packed graph that holds the codes of its rows."""
    shared = packed.sparkSession.sparkContext.broadcast(book)
    at_codes = packed.columns.index("codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                s = Shard(row.to_pylist()[0] | {"codes": None})
                yield row.set_column(at_codes, "codes", pa.array([s.coded(shared.value).astype("<i2").tobytes()], pa.binary()))

    return packed.mapInArrow(run, packed.schema)


def unpacked(packed: DataFrame) -> DataFrame:
    """(shard, vec_id, embedding, nbrs, is_entry) of a packed graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                held = s.links >= 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held.sum(1))]), pa.int32()), pa.array(s.ids[s.links[held]]))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1) * s.dimension, pa.int32()), pa.array(s.x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(s.n, s.number), pa.int32()), pa.array(s.ids), vectors, lists, pa.array(np.arange(s.n) == s.entry)], ["shard", "vec_id", "embedding", "nbrs", "is_entry"])

    return packed.mapInArrow(run, "shard int, vec_id long, embedding array<double>, nbrs array<long>, is_entry boolean")


def build(base: DataFrame, degree: int = 32, size: int = 64, alpha: float = 1.2, most_rows: int = 20_000, overlap: int = 2) -> DataFrame:
    """(shard, vec_id, embedding, nbrs, is_entry): a graph for each shard of bounded size."""
    return unpacked(build_packed(base, degree, size, alpha, most_rows, overlap)[0])


def packed(graph: DataFrame) -> DataFrame:
    """A packed graph from rows (vec_id, embedding, nbrs), by shard if they have one; links to rows of other shards go.

    The entry is the row that is_entry names, else the one nearest to the mean.
    """
    wide = _is_wide(graph)
    named, labelled = "is_entry" in graph.columns, "labels" in graph.columns
    rows = graph if "shard" in graph.columns else graph.withColumn("shard", F.lit(0))

    def one(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.unique(group["vec_id"].to_numpy(), return_index=True)[1]))
        ids, x = group["vec_id"].to_numpy(), knn.matrix(group["embedding"])
        lists = group["nbrs"].combine_chunks()
        ends = lists.value_lengths().fill_null(0).to_numpy()
        owner, other = np.repeat(np.arange(len(ids)), ends), lists.flatten().to_numpy()
        at = np.searchsorted(ids, other).clip(max=len(ids) - 1)
        inside = ids[at] == other
        owner, at = owner[inside], at[inside]
        counts = np.bincount(owner, minlength=len(ids))
        links = np.full((len(ids), max(counts.max(initial=0), 1)), -1, np.int64)
        links[owner, np.arange(len(owner)) - np.searchsorted(owner, owner)] = at
        entries = np.flatnonzero(group["is_entry"].to_numpy(zero_copy_only=False)) if named else []
        entry = int(entries[0]) if len(entries) else int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
        labels = [v or [] for v in group["labels"].to_pylist()] if labelled else None
        universal = [bool(v) for v in group["is_universal"].to_pylist()] if labelled else None
        return _packed(group["shard"][0].as_py(), ids, x, links, entry, wide, labels, universal)

    extra = [c for c in ("is_entry", "labels", "is_universal") if c in graph.columns]
    return rows.select(F.col("shard").cast("int"), "vec_id", "embedding", "nbrs", *extra).groupBy("shard").applyInArrow(one, PACKED)


def merged(graph: DataFrame, degree: int) -> DataFrame:
    """(vec_id, nbrs): the shards' graphs in one, each node's neighbours united and capped by a hash order."""
    edges = graph.select("vec_id", F.explode("nbrs").alias("nbr")).where("vec_id <> nbr").distinct()
    ranked = knn.top(edges.select(F.col("vec_id").alias("qid"), F.pmod(F.col("nbr") * 7919 + F.col("vec_id") * 104729, F.lit(1_000_003)).cast("double").alias("dist"), F.col("nbr").alias("vec_id")), degree)
    return ranked.groupBy(F.col("qid").alias("vec_id")).agg(F.array_sort(F.collect_list("vec_id")).alias("nbrs"))


class Walk:
    """The state of a block of queries that move through one shard together.

    pool: the best nodes of each query in order. Nodes that may not be returned
    (`hidden`) lead on, but do not count against size: the list grows until it holds
    `size` others.
    """

    def __init__(self, links: np.ndarray, n_queries: int, size: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], hidden: np.ndarray | None = None):
        self.links, self.size, self.score, self.hidden = links, size, score, hidden
        self.nodes = np.full((n_queries, 0), -1, np.int64)
        self.dist = np.full((n_queries, 0), np.inf)
        self.done = np.zeros((n_queries, 0), bool)
        self.seen = np.zeros((n_queries, len(links)), bool)
        self.expanded: list[tuple[np.ndarray, np.ndarray]] = []
        self.scored = np.zeros(n_queries, np.int64)

    def offer(self, rows: np.ndarray, nodes: np.ndarray, done: bool = False) -> None:
        """Score nodes that a query has not seen and put them in their place."""
        new = (nodes >= 0) & ~self.seen[rows, nodes]
        pairs = np.unique(rows[new] * len(self.links) + nodes[new])
        rows, nodes = pairs // len(self.links), pairs % len(self.links)
        if not len(rows):
            return
        self.seen[rows, nodes] = True
        counts = np.bincount(rows, minlength=len(self.seen))
        self.scored += counts
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        shape = (len(self.seen), counts.max())
        more, dist = np.full(shape, -1, np.int64), np.full(shape, np.inf)
        more[rows, place], dist[rows, place] = nodes, self.score(rows, nodes)
        all_nodes, all_dist = np.concatenate([self.nodes, more], 1), np.concatenate([self.dist, dist], 1)
        all_done = np.concatenate([self.done, np.full(shape, done)], 1)
        order = np.lexsort((all_nodes, all_dist), axis=1)
        if self.hidden is None:
            order = order[:, : self.size]
            self.nodes, self.dist, self.done = (np.take_along_axis(v, order, 1) for v in (all_nodes, all_dist, all_done))
            return
        self.nodes, self.dist, self.done = (np.take_along_axis(v, order, 1) for v in (all_nodes, all_dist, all_done))
        live = np.cumsum((self.nodes >= 0) & ~self.hidden[self.nodes], 1)
        inside = (live < self.size) | ((live == self.size) & (self.nodes >= 0) & ~self.hidden[self.nodes])
        inside &= self.nodes >= 0
        self.nodes, self.dist = np.where(inside, self.nodes, -1), np.where(inside, self.dist, np.inf)
        most = int(inside.sum(1).max(initial=0))
        self.nodes, self.dist, self.done = self.nodes[:, :most], self.dist[:, :most], self.done[:, :most]

    def pick(self, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest `width` nodes of each query that are not expanded yet, marked as expanded."""
        open_ = (self.nodes >= 0) & ~self.done
        rows, at = np.nonzero(open_ & (np.cumsum(open_, 1) <= width[:, None]))
        self.done[rows, at] = True
        nodes = self.nodes[rows, at]
        self.expanded.append((rows, nodes))
        return rows, nodes

    def onward(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        near = self.links[nodes]
        self.offer(np.repeat(rows, near.shape[1]), near.ravel())


def walk(links: np.ndarray, start: list[tuple[np.ndarray, np.ndarray]], n_queries: int, size: int, score, mode: str, width: int, hidden: np.ndarray | None = None, most_rounds: int | None = None, page_rows: int = PAGE_ROWS) -> Walk:
    """Best-first search of a block of queries.

    Each round expands the nearest nodes that are not expanded, among the best
    `size`; it ends when all of these are, or after most_rounds. greedy expands
    one at a time, beam and interleaved `width`; pipe starts with four and adds one,
    up to `width`, while at most a tenth of what a round expanded has dropped out of
    the list. page expands every row of an expanded node's page with it.
    """
    w = Walk(links, n_queries, size, score, hidden)
    for rows, nodes in start:
        w.offer(rows, nodes)
    widths = np.full(n_queries, 1 if mode == "greedy" else min(4, width) if mode == "pipe" else width)
    visited = np.zeros((n_queries, -(-len(links) // page_rows)), bool) if mode == "page" else None
    turn = 0
    while most_rounds is None or turn < most_rounds:
        turn += 1
        rows, nodes = w.pick(widths)
        if not len(rows):
            break
        if visited is None:
            w.onward(rows, nodes)
        else:
            pages = np.unique(rows * visited.shape[1] + nodes // page_rows)
            r, p = pages // visited.shape[1], pages % visited.shape[1]
            new = ~visited[r, p]
            r, p = r[new], p[new]
            visited[r, p] = True
            r, together = np.repeat(r, page_rows), (p[:, None] * page_rows + np.arange(page_rows)).ravel()
            r, together = r[together < len(links)], together[together < len(links)]
            w.expanded.append((r, together))
            w.onward(r, together)
        if mode == "pipe":
            still = np.zeros(n_queries)
            np.add.at(still, rows, (w.nodes[rows] == nodes[:, None]).any(1))
            sent = np.bincount(rows, minlength=n_queries)
            first_open = np.where(((w.nodes >= 0) & ~w.done).any(1), ((w.nodes >= 0) & ~w.done).argmax(1), w.nodes.shape[1])
            widths = np.where((sent > 0) & (first_open >= 5) & (sent - still <= 0.1 * sent), np.minimum(widths + 1, width), widths)
    return w


def search(
    graph: DataFrame, queries: DataFrame, k: int, size: int = 64, mode: str = "greedy", width: int = 4, book=None, most_queries: int | None = None, excluded: DataFrame | None = None,
    centers: np.ndarray | None = None, probes: int = 4, starts: list[int] | None = None, sampled: int = 0, most_rounds: int | None = None, stats: bool = False,
) -> DataFrame:
    """(qid, rank, vec_id, dist): each shard searches for each query, in blocks of most_queries
    (knn.QUERY_BLOCK); the best k of all shards stay.

    graph: packed, or rows (shard, vec_id, embedding, nbrs, is_entry). queries: qid, qv
    and, for filtered searches of a graph with labels, expression; only rows that it
    holds are returned, navigation is not restricted.

    greedy: exact distances lead, the best list is the result. The other modes: code
    distances lead if a codebook is given, and the expanded nodes are the result, by
    exact distance; beam and interleaved differ in how they read a disk, not in
    what they return. excluded (vec_id): rows that lead on but are not returned
    (deleted rows, helper nodes); lists grow so that `size` others remain, and the
    table goes to the shards by a join. centers: a query goes to the `probes`
    shards of the nearest centers only. starts: ids that the search begins from,
    where a shard has them, beside the entry; sampled: so many rows of each shard,
    by a hash, of which the nearest eight begin too. most_rounds bounds the rounds
    of a search. stats adds the numbers of rows scored and expanded to each row.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if "ids" not in graph.columns:
        graph = packed(graph)
    if excluded is not None:
        graph = with_hidden(graph, excluded)
    wanted = [c for c in ("qid", "qv", "expression") if c in queries.columns]
    found = [
        search_block(graph, block, k, size, mode, width, book, centers, probes, starts, sampled, most_rounds, stats)
        for block in knn.blocks(queries.select(*wanted), most_queries)
    ]
    return reduce(DataFrame.unionByName, found)


def search_block(
    graph: DataFrame, block: pa.Table, k: int, size: int = 64, mode: str = "greedy", width: int = 4, book=None, centers: np.ndarray | None = None, probes: int = 4,
    starts: list[int] | None = None, sampled: int = 0, most_rounds: int | None = None, stats: bool = False,
) -> DataFrame:
    """The same for one block of queries, an Arrow table, over a packed graph."""
    every = _search(graph, block, (k, size, mode, width, book, starts or [], sampled, most_rounds), centers, probes)
    # a row of several shards is one row
    ranked = knn.top(every.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist")), k).select("qid", "rank", "vec_id", "dist")
    if not stats:
        return ranked
    costs = every.groupBy("qid", "shard").agg(F.max("scored").alias("scored"), F.max("expanded").alias("expanded")).groupBy("qid").agg(F.sum("scored").alias("scored"), F.sum("expanded").alias("expanded"))
    return ranked.join(costs, "qid")


def with_hidden(graph: DataFrame, excluded: DataFrame) -> DataFrame:
    """Packed rows with a column more: hidden, the positions of excluded ids in the shard."""
    ids = excluded.select(F.col("vec_id").cast("long").alias("gone")).distinct()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number), pa.int32()), pa.array(held), pa.array(np.arange(len(held)), pa.int32())], ["place", "gone", "at"])

    # positions only, so a shard's list is bounded by its rows
    places = graph.select("shard", "ids").mapInArrow(members, "place int, gone long, at int").join(ids, "gone").groupBy("place").agg(F.collect_list("at").alias("hidden"))
    return graph.join(places, F.col("shard") == F.col("place"), "left").drop("place")


def _search(graph: DataFrame, block: pa.Table, options: tuple, centers: np.ndarray | None, probes: int) -> DataFrame:
    """(qid, vec_id, dist) of one block of queries, up to k rows of each shard."""
    qids = block["qid"].to_numpy()
    q = knn.matrix(block["qv"]) if len(qids) else np.zeros((0, 1))
    expressions = block["expression"].to_pylist() if "expression" in block.column_names else None
    targets = None
    if centers is not None and len(centers) > probes and len(qids):
        rough = (centers**2).sum(1)[None, :] - 2 * q @ centers.T
        nearest = np.argpartition(rough, probes - 1, 1)[:, :probes]
        targets = {int(s): np.flatnonzero((nearest == s).any(1)) for s in np.unique(nearest)}
        graph = graph.where(F.col("shard").isin(list(targets)))
    shared = graph.sparkSession.sparkContext.broadcast((qids, q, expressions, targets, options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                yield from _in_shard(Shard(row), row.get("hidden"), *shared.value)

    return graph.mapInArrow(run, "shard int, qid long, vec_id long, dist double, scored long, expanded long")


def _in_shard(s: Shard, hidden: list[int] | None, qids: np.ndarray, q: np.ndarray, expressions: list | None, targets: dict | None, options: tuple, most: int = 512) -> Iterator[pa.RecordBatch]:
    k, size, mode, width, book, starts, sampled, most_rounds = options
    mine = np.arange(len(qids)) if targets is None else targets.get(s.number, np.empty(0, int))
    if not len(mine) or not s.n:
        return
    gone = None
    if hidden:
        gone = np.zeros(s.n, bool)
        gone[hidden] = True
    coded = s.coded(book) if book is not None and mode != "greedy" else None
    begin = [s.entry]
    if starts:
        at = np.searchsorted(s.ids, starts).clip(max=s.n - 1)
        begin += at[s.ids[at] == starts].tolist()
    sample = np.argsort((np.arange(s.n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:sampled] if sampled else np.empty(0, int)
    held: dict[str, np.ndarray] = {}
    for at in range(0, len(mine), most):
        part = mine[at : at + most]
        v = q[part]
        rows = np.arange(len(part))
        if coded is None:
            score = lambda r, n, v=v: ((s.x[n] - v[r]) ** 2).sum(1)
        else:
            tables = np.stack([book.table(x) for x in v])
            chunks = np.arange(coded.shape[1])
            score = lambda r, n, tables=tables, chunks=chunks: tables[r[:, None], chunks[None, :], coded[n]].sum(1)
        start = [(np.repeat(rows, len(begin)), np.tile(begin, len(part)))]
        if len(sample):
            rough = (s.x[sample] ** 2).sum(1)[None, :] - 2 * v @ s.x[sample].T
            few = min(8, len(sample))
            start.append((np.repeat(rows, few), sample[np.argpartition(rough, few - 1, 1)[:, :few]].ravel()))
        w = walk(s.links, start, len(part), size, score, mode, width, gone, most_rounds)
        if mode == "greedy":
            r, c = np.nonzero(w.nodes >= 0)
            nodes = w.nodes[r, c]
        else:
            r, nodes = (np.concatenate(z) for z in zip(*w.expanded, strict=True))
        expanded = np.bincount(r, minlength=len(part)) if mode != "greedy" else np.bincount(np.concatenate([z[0] for z in w.expanded]), minlength=len(part))
        if expressions is not None:
            # beside what was met, the first k allowed rows, so that a rare label still has its rows
            for text in {expressions[p] for p in part}:
                if text not in held:
                    held[text] = s.holds(text)
            allowed = np.stack([held[expressions[p]] for p in part]) if len(part) else np.zeros((0, s.n), bool)
            lists = np.nonzero(w.nodes >= 0)
            few = np.nonzero(allowed & (np.cumsum(allowed, 1) <= k))
            r, nodes = np.concatenate([r, lists[0], few[0]]), np.concatenate([nodes, w.nodes[lists], few[1]])
            good = allowed[r, nodes]
            r, nodes = r[good], nodes[good]
        if gone is not None:
            r, nodes = r[~gone[nodes]], nodes[~gone[nodes]]
        pairs = np.unique(r * s.n + nodes)
        r, nodes = pairs // s.n, pairs % s.n
        dist = ((s.x[nodes] - v[r]) ** 2).sum(1)
        order = np.lexsort((s.ids[nodes], dist, r))
        r, nodes, dist = r[order], nodes[order], dist[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, nodes, dist = r[best], nodes[best], dist[best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(r), s.number), pa.int32()), pa.array(qids[part[r]], pa.int64()), pa.array(s.ids[nodes]), pa.array(dist), pa.array(w.scored[r]), pa.array(expanded[r].astype(np.int64))],
            ["shard", "qid", "vec_id", "dist", "scored", "expanded"],
        )


def merge_shard(s: Shard | None, gone: np.ndarray, ids: np.ndarray, x: np.ndarray, degree: int, size: int, alpha: float, block: int = 256, sample: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(positions of old rows that stay, ids, vectors, links, entry) after rows went and new rows came.

    A link to a row that went gives way to that row's live links (its first `sample`, if
    given). Changed nodes and new rows are pruned; new rows take their candidates from
    the nearest rows, and are linked back.
    """
    old = np.flatnonzero(~gone) if s is not None else np.empty(0, int)
    all_ids = np.concatenate([s.ids[old] if s is not None else np.empty(0, np.int64), ids])
    all_x = np.concatenate([s.x[old], x]) if s is not None and len(x) else s.x[old] if s is not None else x
    n = len(all_ids)
    if not n:
        return old, all_ids, all_x, np.empty((0, degree), np.int64), 0
    if not len(old):
        return old, all_ids, all_x, *build_shard(all_x, degree, size, alpha)
    to_new = np.full(s.n, -1)
    to_new[old] = np.arange(len(old))
    links = np.full((n, degree), -1, np.int64)
    there = s.links >= 0
    straight = np.where(there, to_new[s.links], -1)[old]
    width = min(degree, straight.shape[1])
    links[: len(old), :width] = straight[:, :width]
    lost = np.flatnonzero((there[old] & gone[s.links[old]]).any(1))
    for at in range(0, len(lost), 64):
        rows = lost[at : at + 64]
        near = s.links[old[rows]]
        dead = (near >= 0) & gone[near]
        onward = s.links[near][:, :, :sample]
        onward = np.where(dead[:, :, None] & (onward >= 0), to_new[onward], -1).reshape(len(rows), -1)
        pool = np.concatenate([straight[rows], onward], 1)
        # the nearest 4 * degree candidates decide
        d = np.where(pool >= 0, ((all_x[pool] - all_x[rows][:, None, :]) ** 2).sum(2), np.inf)
        few = min(4 * degree, pool.shape[1])
        best = np.argpartition(d, few - 1, 1)[:, :few]
        links[rows] = prune_many(all_x, rows, np.take_along_axis(pool, best, 1), degree, alpha)
    squares = (all_x * all_x).sum(1)
    near = min(size, n - 1)
    rng = np.random.default_rng(n)
    for at in range(len(old), n, block):
        rows = np.arange(at, min(at + block, n))
        rough = squares[None, :] - 2 * all_x[rows] @ all_x.T
        rough[np.arange(len(rows)), rows] = np.inf
        if near:
            pool = np.argpartition(rough, near - 1, 1)[:, :near]
            links[rows] = prune_many(all_x, rows, np.concatenate([pool, rng.integers(0, n, (len(rows), min(16, n)))], 1), degree, alpha)
    links = with_reverse(all_x, links, degree, alpha, block)
    entry = int(np.argmin(((all_x - all_x.mean(0)) ** 2).sum(1)))
    _joined(all_x, links, entry)
    return old, all_ids, all_x, links, entry


def merge_shards(packed: DataFrame, new: DataFrame, degree: int, size: int, alpha: float) -> DataFrame:
    """The packed graph without its hidden rows and with new rows (shard, vec_id, embedding, labels, is_universal) linked in."""
    wide = _is_wide(new)

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        s = Shard(a.to_pylist()[0]) if len(a) else None
        gone = np.zeros(s.n if s else 0, bool)
        if s and a["hidden"][0].as_py():
            gone[a["hidden"][0].as_py()] = True
        order = np.unique(b["vec_id"].to_numpy(), return_index=True)[1]
        b = b.take(pa.array(order))
        x = knn.matrix(b["embedding"]) if len(b) else np.zeros((0, s.dimension))
        old, ids, x, links, entry = merge_shard(s, gone, b["vec_id"].to_numpy(), x, degree, size, alpha)
        if not len(ids):
            return pa.table({f.name: pa.array([], f.type) for f in _packed(0, ids, np.zeros((0, 1)), links, 0, wide).schema})
        labels, universal = s.label_lists(old) if s else ([], [])
        labels += [v or [] for v in b["labels"].to_pylist()]
        universal += [bool(v) for v in b["is_universal"].to_pylist()]
        # by id, as searches expect
        place = np.argsort(ids, kind="stable")
        back = np.empty(len(ids), np.int64)
        back[place] = np.arange(len(ids))
        links = np.where(links >= 0, back[links], -1)[place]
        number = s.number if s else b["shard"][0].as_py()
        return _packed(number, ids[place], x[place], links, int(back[entry]), wide or bool(s and s.wide), [labels[i] for i in place], [universal[i] for i in place])

    rows = new.select("shard", "vec_id", "embedding", "labels", "is_universal")
    return packed.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(one, PACKED)


def repaired(graph: DataFrame, deleted: DataFrame, sample: int | None = None) -> DataFrame:
    """(vec_id, nbrs) of live nodes: a deleted neighbour gives way to its own live neighbours, its first `sample` if given.

    One hop only; equi-joins on exploded edges, no node's edges are gathered but its own.
    """
    edges = graph.select("vec_id", F.explode("nbrs").alias("nbr"))
    gone = deleted.select(F.col("vec_id").alias("nbr")).distinct()
    live = edges.join(deleted.select("vec_id"), "vec_id", "left_anti")
    straight = live.join(gone, "nbr", "left_anti").select("vec_id", "nbr")
    onward = graph.join(deleted.select("vec_id"), "vec_id", "left_semi")
    onward = onward.select(F.col("vec_id").alias("nbr"), F.explode(F.slice("nbrs", 1, sample) if sample else F.col("nbrs")).alias("next"))
    bridged = live.join(onward, "nbr").select("vec_id", F.col("next").alias("nbr")).join(gone, "nbr", "left_anti").select("vec_id", "nbr")
    united = straight.unionByName(bridged).where("vec_id <> nbr").distinct()
    nodes = graph.select("vec_id").join(deleted.select("vec_id"), "vec_id", "left_anti")
    lists = united.groupBy("vec_id").agg(F.array_sort(F.collect_list("nbr")).alias("nbrs"))
    return nodes.join(lists, "vec_id", "left").select("vec_id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def pruned(edges: DataFrame, vectors: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """(vec_id, nbrs): each node's candidate edges (vec_id, nbr) pruned so that a kept neighbour covers what lies near it.

    Candidate vectors are joined to the edges; a node's are gathered after its
    nearest `4 * degree` are picked, so a hub costs no more than another node.
    """
    v = vectors.select("vec_id", "embedding")
    pairs = edges.where("vec_id <> nbr").distinct().join(v.withColumnRenamed("embedding", "a"), "vec_id").join(v.select(F.col("vec_id").alias("nbr"), F.col("embedding").alias("b")), "nbr")
    from lodestone.functions.vectors import squared_l2

    near = knn.top(pairs.select(F.col("vec_id").alias("qid"), F.col("nbr").alias("vec_id"), squared_l2(F.col("a"), F.col("b")).alias("dist"), "a", "b"), 4 * degree)

    def one(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        x = np.concatenate([knn.matrix(group["a"].combine_chunks().slice(0, 1)), knn.matrix(group["b"])])
        kept = prune_many(x, np.array([0]), np.arange(1, len(x))[None], degree, alpha)[0]
        kept = kept[kept >= 0] - 1
        return pa.table({"vec_id": pa.array([group["qid"][0].as_py()], pa.int64()), "nbrs": pa.array([np.sort(ids[kept]).tolist()], pa.list_(pa.int64()))})

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes that lie whole in a run of batches, one after the other."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            qids = table["qid"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(qids)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from one(table.slice(a, b - a)).to_batches()
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from one(held).to_batches()

    sorted_ = near.select("qid", "vec_id", "a", "b").repartition("qid").sortWithinPartitions("qid", "vec_id")
    return sorted_.mapInArrow(many, "vec_id long, nbrs array<long>")


def within_hops(graph: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(origin, vec_id, hop): nodes first reached from each start after so many joins."""
    edges = graph.select(F.col("vec_id").alias("at"), F.explode("nbrs").alias("to"))
    reached = starts.select(F.col("vec_id").alias("origin"), "vec_id", F.lit(0).cast("long").alias("hop"))
    front = reached
    for hop in range(1, hops + 1):
        front = front.join(edges, F.col("vec_id") == F.col("at")).select("origin", F.col("to").alias("vec_id")).distinct()
        front = front.join(reached.select("origin", "vec_id"), ["origin", "vec_id"], "left_anti").withColumn("hop", F.lit(hop).cast("long"))
        reached = reached.unionByName(front)
    return reached


def reachable(graph: DataFrame) -> DataFrame:
    """(vec_id) of the nodes that lead from the entries, found shard by shard and joined over shared rows."""

    def one(group: pa.Table) -> pa.Table:
        s = Shard(group.to_pylist()[0])
        reached = np.zeros(s.n, bool)
        front = np.array([s.entry])
        while len(front):
            reached[front] = True
            front = np.unique(s.links[front])
            front = front[front >= 0]
            front = front[~reached[front]]
        return pa.table({"vec_id": s.ids[reached]})

    return packed(graph).groupBy("shard").applyInArrow(one, "vec_id long").distinct()


def degree_stats(graph: DataFrame) -> DataFrame:
    d = F.size("nbrs")
    return graph.agg(F.max(d).cast("long").alias("max_degree"), F.round(F.avg(d), 6).alias("avg_degree"), F.min(d).cast("long").alias("min_degree"), F.sum((d < 2).cast("long")).alias("below_two"))


def cross_counts(graph: DataFrame, first_new: int) -> DataFrame:
    """Edges between rows before and from an id on: old to new, new to old, and within."""
    edges = graph.select("vec_id", F.explode("nbrs").alias("nbr"))
    a, b = F.col("vec_id") >= first_new, F.col("nbr") >= first_new
    return edges.agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("old_to_new", ~a & b), ("new_to_old", a & ~b), ("old_to_old", ~a & ~b), ("new_to_new", a & b))])
