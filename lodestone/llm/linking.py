"""Links within buckets, and connected components over links, both as Spark joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: Rows that a bucket holds before it is dealt out in blocks.
BLOCK = 512

#: (left columns, right columns) -> which left row links to which right row.
Kernel = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def columns(batch: pa.Table) -> dict[str, np.ndarray]:
    """Arrays by name: lists of one length as matrices, binaries of one length as byte matrices."""
    found = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        column = column.combine_chunks()
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            found[name] = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
        elif pa.types.is_binary(column.type):
            found[name] = np.array(column.to_pylist(), dtype=object)
        elif pa.types.is_primitive(column.type):
            found[name] = column.to_numpy(zero_copy_only=False)
    return found


def _classes(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position of each row's class in both lists, as the smallest node that links reach."""
    far = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        new_a = np.minimum(a, np.where(links, b[None, :], far).min(1, initial=far))
        new_b = np.minimum(b, np.where(links, new_a[:, None], far).min(0, initial=far))
        if np.array_equal(a, new_a) and np.array_equal(b, new_b):
            return a, b
        a, b = new_a, new_b


def deal(rows: DataFrame, keys: list[str], node: str, block: int = BLOCK) -> DataFrame:
    """The nodes of each bucket of two or more, dealt out: keys, __i, __j, __own and node.

    rows: keys and node, each pair once. A bucket of one node costs a count and no
    more. A large bucket is split into blocks by a hash of the node, and each pair
    of blocks (__i, __j) is a group of its own of at most about two blocks; __own is
    the block that a node is from.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    shared = rows.join(counts, keys)
    blocks = F.ceil(F.col("__n") / block).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    return (
        shared.withColumns({"__own": own, "__other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        .withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")})
        .select(*keys, "__i", "__j", "__own", node)
    )


def each_group(dealt: DataFrame, keys: list[str], work: Callable[[], Callable[[pa.Table], pa.RecordBatch | pa.Table]], schema) -> DataFrame:
    """What the function that work makes gives for the rows of each block pair; one group is held at a time."""
    groups = [*keys, "__i", "__j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = work()
        held: list[pa.RecordBatch] = []
        last = None

        def result() -> Iterator[pa.RecordBatch]:
            found = compare(pa.Table.from_batches(held))
            yield from found.to_batches() if isinstance(found, pa.Table) else [found]

        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in groups]
            change = np.zeros(batch.num_rows - 1, bool)
            for v in names:
                change |= v[1:] != v[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                key = tuple(v[at] for v in names)
                if key != last and held:
                    yield from result()
                    held = []
                last = key
                held.append(batch.slice(at, end - at))
        if held:
            yield from result()

    return dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, schema)


def sides(group: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], bool]:
    """(left rows, right rows, are they the same rows) of a block pair."""
    data = columns(group)
    i, j = group["__i"][0].as_py(), group["__j"][0].as_py()
    if i == j:
        return data, data, True
    return {k: v[data["__own"] == i] for k, v in data.items()}, {k: v[data["__own"] == j] for k, v in data.items()}, False


def linked(group: pa.Table, kernel: Kernel, node: str, weight: str | None = None) -> pa.RecordBatch:
    """(node, rep, links) of every node that links within the group: links are summed by weight, rep is its class's smallest node."""
    left, right, same = sides(group)
    links = kernel(left, right)
    if same:
        np.fill_diagonal(links, False)
    a, b = _classes(links, left[node], right[node])
    parts = [(left[node], a, links @ right[weight] if weight else links.sum(1), links.any(1))]
    if not same:
        parts.append((right[node], b, left[weight] @ links if weight else links.sum(0), links.any(0)))
    arrays = [np.concatenate([p[k][p[3]] for p in parts]).astype(np.int64) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["node", "rep", "links"])


LINKS = "node long, rep long, links long"


def bucket_links(rows: DataFrame, keys: list[str], payload: DataFrame, node: str, make_kernel: Callable[[], Kernel], block: int = BLOCK, weight: str | None = None) -> DataFrame:
    """Compare the nodes of each bucket; (node, rep, links) of every node that links within it.

    rows: keys and node, each pair once. payload: node and what the kernel needs.
    Buckets are dealt out in block pairs (``deal``), and no pair leaves one as a row:
    a node's links are summed (by weight, if named), and its class in the block
    pair is given by the class's smallest node.
    """
    dealt = deal(rows, keys, node, block).join(payload, node)

    def work() -> Callable[[pa.Table], pa.RecordBatch]:
        kernel = make_kernel()
        return lambda group: linked(group, kernel, node, weight)

    return each_group(dealt, keys, work, LINKS)


def connected(rows: DataFrame, keys: list[str], payload: DataFrame, node: str, make_kernel: Callable[[], Kernel], block: int = BLOCK, rounds: int = 2) -> DataFrame:
    """(node, root) of the components that all links within buckets make.

    Nodes that links have joined already are not compared again, so a large group of
    copies costs about as many comparisons as it has rows times a block:

    1. Each bucket is dealt into blocks by a hash, and each block is compared within itself.
       For a bucket of one block that is all.
    2. Larger buckets whose nodes are not yet one component are dealt anew, `rounds` times.
    3. What is still apart: the nodes outside the bucket's commonest component are
       compared with all nodes of the bucket, block by block. So no link is lost that
       would join two components.
    """
    n = payload.count()
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    shared = rows.join(counts, keys)

    def work() -> Callable[[pa.Table], pa.RecordBatch]:
        kernel = make_kernel()

        def apart(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> np.ndarray:
            return kernel(left, right) & (left[node][:, None] != right[node][None, :])

        return lambda group: linked(group, apart, node)

    def within(some: DataFrame, turn: int) -> DataFrame:
        blocks = F.ceil(F.col("__n") / block).cast("int")
        own = F.pmod(F.xxhash64(node, F.lit(turn)), blocks).cast("int")
        dealt = some.select(*keys, own.alias("__i"), own.alias("__j"), own.alias("__own"), node).join(payload, node)
        return common.written(each_group(dealt, keys, work, LINKS).select("node", "rep"), "links", rows=n)

    found = within(shared, 0)
    large = common.written(shared.where(F.col("__n") > block), "large", rows=n)
    if large.isEmpty():
        return components(found, "node", "rep", rows=n)
    for turn in range(1, rounds + 2):
        roots = components(found, "node", "rep", rows=n)
        marked = large.join(roots.withColumnRenamed("node", node), node, "left").withColumn("__class", F.coalesce("root", node)).drop("root")
        several = marked.groupBy(*keys).agg(F.min("__class").alias("a"), F.max("__class").alias("b")).where("a <> b").select(*keys)
        marked = common.written(marked.join(several, keys, "left_semi"), "apart", rows=n)
        if marked.isEmpty():
            return roots
        if turn <= rounds:
            more = within(marked, turn)
            found = common.written(roots.select("node", F.col("root").alias("rep")).unionByName(more), "links", instead_of=[found, more], rows=n)
    sizes = marked.groupBy(*keys, "__class").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy(*keys).agg(F.max_by("__class", F.struct("m", "__class")).alias("__most"), (F.sum("m") - F.max("m")).alias("__few"))
    marked = marked.join(sizes, keys)
    few, all_ = F.ceil(F.col("__few") / block).cast("int"), F.ceil(F.col("__n") / block).cast("int")
    # the left blocks have the numbers below -1, so that the two sides differ
    left_own, right_own = -2 - F.pmod(F.xxhash64(node, F.lit("few")), few).cast("int"), F.pmod(F.xxhash64(node, F.lit("all")), all_).cast("int")
    left = marked.where("__class <> __most").select(*keys, left_own.alias("__i"), F.explode(F.sequence(F.lit(0), all_ - 1)).alias("__j"), left_own.alias("__own"), node)
    right = marked.select(*keys, F.explode(F.sequence(F.lit(-2), -1 - few, F.lit(-1))).alias("__i"), right_own.alias("__j"), right_own.alias("__own"), node)
    more = common.written(each_group(left.unionByName(right).join(payload, node), keys, work, LINKS).select("node", "rep"), "links", rows=n)
    return components(roots.select("node", F.col("root").alias("rep")).unionByName(more), "node", "rep", rows=n)


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of a few edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], least)
        np.minimum.at(after, root[y], least)
        after = after[after]
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            return nodes, nodes[root]
        root = after


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = 15_000, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges; root is one node of its component.

    Each round hooks every node to the neighbour (or itself) that a fresh hash
    puts first, follows two more hooks, and contracts the graph; a constant share
    of the nodes goes in a round, whatever the graph's shape. Rounds are written
    to the shared folder, so an executor's loss costs one round at most; a round's
    tables go when the next one's are there. A graph of at most `few` edges, as
    contraction leaves it, is finished by one task. rows: about how many nodes there are at most.
    """
    def tidy(x: DataFrame) -> DataFrame:
        return x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left = common.written(tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges", rows=rows)
    roots = None

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_of(table["a"].to_numpy(), table["b"].to_numpy())], ["v", "p"])

    for turn in range(most_rounds):
        n = left.count()
        if not n:
            break
        rows = rows or 2 * n
        if n <= few:
            hook = left.select("a", "b").coalesce(1).mapInArrow(finished, "v long, p long")
            if roots is None:
                return common.written(hook.select(F.col("v").alias("node"), F.col("p").alias("root")), "roots", instead_of=[left])
            onward = roots.join(hook.select(F.col("v").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
            return common.written(onward, "roots", instead_of=[left, roots], rows=rows)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least(rank("a"), F.col("m")).alias("p")).select("v", F.col("p.v").alias("p"))
        first = common.written(first, "hooks", rows=2 * n)
        hook = first
        for _ in range(2):
            onward = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            hook = hook.join(onward, "p").select("v", F.col("q").alias("p"))
        hook = common.written(hook, "hooks", instead_of=[first], rows=2 * n)
        ends = left.join(hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(hook.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        left = common.written(tidy(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges", instead_of=[left], rows=n)
        step = hook.select(F.col("v").alias("root"), "p")
        if roots is None:
            roots = hook.select(F.col("v").alias("node"), F.col("p").alias("root"))
            roots = common.written(roots, "roots", instead_of=[hook], rows=2 * n)
        else:
            onward = roots.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
            roots = common.written(onward, "roots", instead_of=[hook, roots], rows=rows)
    else:
        raise RuntimeError("the components did not settle")
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
