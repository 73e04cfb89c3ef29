"""Groups of documents by exact Jaccard similarity of their word shingles, found by SimHash.

Fingerprints: the distinct ``width``-word shingles of a text vote, as in ``simhash``, for
``LANES`` lanes of 64 bits. At similarity 0.8 two sets differ in a bit with 0.15 (the angle
between them over pi), too often for the two bits of ``simhash.components_of``; so the
multi-index has a table for each of ``SEGMENTS`` segments of ``WIDTH`` bits, which a fingerprint
enters with the segment and with each of the ``WEAK`` bits flipped that its votes decided most
narrowly: these differ first. Two documents that agree in an entry meet, at 0.8 in 0.40 of
the segments (simulated), so a pair misses all with 0.6**16 = 0.0003, one at 0.85 with
0.00001. The lanes that are in no segment verify: pairs that meet and differ in ``MOST`` of
these 128 bits at most (four standard errors above 0.15) are joined to clusters; of
unrelated pairs one in a million does.

Links: within a cluster the exact similarity of whole sets decides, never an estimate
(``minhash.within``). Documents of equal sets are one node. A bucket beyond ``BUCKET``
entries is compared block by block (``linking.connected``), so none is cut.

Defined results: as in ``minhash``: null and empty texts have the empty set and are one
group; a text of fewer words than a shingle is one shingle; texts of any length are read
whole; of tied rows the least id names the group; repeated rows, of ids of their own, are
one group; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common, linking, minhash, simhash

WIDTH, SEGMENTS, WEAK, MOST = 16, 16, 3, 36
#: Lanes of the segments, and the two that verify.
LANES = WIDTH * SEGMENTS // 64 + 2
#: Entries of a bucket that are compared at once, and entries of all buckets that a task holds.
BUCKET, HELD = 4096, 1 << 16


def ballots(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The votes for less those against each bit of the lanes that ``simhash.fingerprint`` gives for these hashes."""
    counts = np.zeros(lanes * 64, np.int64)
    steps = np.array([lane * common.ODD % (1 << 64) for lane in range(lanes)], np.uint64)
    for at in range(0, len(hashes), 255):  # as many votes as a byte holds
        some = hashes[at : at + 255]
        mixes = common.mixed(some[:, None] + steps)
        mixes[:, 0] = some
        bits = np.unpackbits(mixes.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(0).view(np.uint8)
    return 2 * counts - len(hashes)


def index(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of the multi-index, the lanes that verify) of a fingerprint. An entry's segment stands above its bits."""
    bits = np.packbits(votes > 0, bitorder="little")
    own = bits[: SEGMENTS * WIDTH // 8].view("<u2").astype(np.int32)[:, None]
    margins = np.abs(votes[: SEGMENTS * WIDTH]).reshape(SEGMENTS, WIDTH)
    flips = np.int32(1) << np.argsort(margins, 1, kind="stable")[:, :WEAK].astype(np.int32)
    entries = np.concatenate([own, own ^ flips], 1) + (np.arange(SEGMENTS, dtype=np.int32) << WIDTH)[:, None]
    return entries.ravel(), bits[SEGMENTS * WIDTH // 8 :].view("<i8")


def marks(docs: DataFrame, width: int = 5, text: str = "text", node: str = "node", entries: str = "entries", check: str = "check") -> DataFrame:
    """docs with three columns more: 128 bits of hash of the text's set, and what ``index`` gives for it."""
    common.small_batches(docs.sparkSession)
    mark = common.fresh(docs, stem="__mark")
    kind = pa.struct([("set", pa.binary()), ("entries", pa.list_(pa.int32())), ("check", pa.list_(pa.int64()))])

    def lists(values: list[np.ndarray], of: type) -> pa.ListArray:
        flat = np.concatenate(values) if values else np.empty(0, of)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        common.lean_worker()
        for texts in batches:
            sets, found, checks = [], [], []
            for x in texts:
                hashes = minhash.shingle_set(x.as_py() or b"", width)
                sets.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                for values, value in zip((found, checks), index(ballots(hashes)), strict=True):
                    values.append(value)
            yield pa.StructArray.from_arrays([pa.array(sets, pa.binary()), lists(found, np.int32), lists(checks, np.int64)], fields=list(kind))

    marked = docs.withColumn(mark, F.arrow_udf(run, "struct<set: binary, entries: array<int>, check: array<long>>")(common.as_bytes(text)))
    return marked.withColumns({node: F.col(f"{mark}.set"), entries: F.col(f"{mark}.entries"), check: F.col(f"{mark}.check")}).drop(mark)


def joined(key: np.ndarray, node: np.ndarray, check: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, its component's least node) for those that links within keys join; the keys are in order.

    What links have joined already is not compared again, so no pair is held.
    """
    names, label = np.unique(node, return_inverse=True)
    root = np.arange(len(names))
    at = np.arange(len(key))
    for step in range(1, len(key)):
        at = at[: np.searchsorted(at, len(key) - step)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        apart = at[root[label[at]] != root[label[at + step]]]
        close = apart[np.bitwise_count(check[apart] ^ check[apart + step]).sum(1, dtype=np.int64) <= most_bits]
        if len(close):
            old, new = linking.least_of(root[label[close]], root[label[close + step]])
            move = np.arange(len(names))
            move[old] = new
            root = move[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


MET = "node long, rep long, key long"


def meetings(rows: DataFrame, most_bits: int, block: int = BUCKET) -> DataFrame:
    """(node, rep, null) of nodes that links join to rep, and (node, null, key) of all in a bucket beyond a block, which is not compared here.

    rows: key, node and the check's two lanes, each key and node once. No bucket is held of which more than a block has come.
    """
    kind = pa.schema([(n, pa.int64()) for n in ("node", "rep", "key")])

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole buckets; the columns of rows are key, node, c0 and c1."""
        _, first, size = np.unique(rows[:, 0], return_index=True, return_counts=True)
        large = np.repeat(size > block, size)
        if large.any():
            yield over(rows[large])
            rows = rows[~large]
        nodes, least = joined(rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64), most_bits)
        if len(nodes):
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least), pa.nulls(len(nodes), pa.int64())], schema=kind)

    def over(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 1].copy()), pa.nulls(len(rows), pa.int64()), pa.array(rows[:, 0].copy())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        passed = None  # the bucket that has gone on without being compared
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            if passed is not None:
                end = np.searchsorted(rows[:, 0], passed, "right")
                if end:
                    yield over(rows[:end])
                    rows = rows[end:]
            if not len(rows):
                continue
            passed = None
            held.append(rows)
            if sum(map(len, held)) < HELD:
                continue
            rows = np.concatenate(held)
            start = np.searchsorted(rows[:, 0], rows[-1, 0])  # the last bucket may go on
            if start:
                yield from links(rows[:start])
            held = [rows[start:]]
            if len(rows) - start > block:
                passed = rows[-1, 0]
                yield over(held.pop())
        if held:
            yield from links(np.concatenate(held))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, MET)


def groups(marked: DataFrame, id_column: str, threshold: float = 0.8, width: int = 5, text: str = "text", node: str = "node", entries: str = "entries", check: str = "check", block: int = BUCKET) -> DataFrame:
    """(id, component_id) of each row of marked: the least id that links of this similarity reach.

    marked: what ``marks`` gave, written, with unique ids; its texts are read again only for nodes that have candidates.
    """
    codes = marked.select(F.col(id_column).alias("__id"), F.col(node).alias("set"), F.col(entries).alias("entries"), F.col(check).alias("lanes"))
    known = codes.groupBy("set").agg(F.min("__id").alias("__first"), F.first("entries").alias("entries"), F.first("lanes").alias("lanes"))
    n = marked.count()
    known = common.written(known.withColumn("node", F.monotonically_increasing_id()), "nodes", rows=n)
    rows = known.select(F.explode(F.col("entries").cast("array<long>")).alias("key"), "node", F.col("lanes")[0].alias("lane0"), F.col("lanes")[1].alias("lane1"))
    found = common.written(meetings(rows, MOST, block), "meetings", rows=n)
    clusters = found.where("rep is not null").select("node", "rep")
    large = found.where("key is not null").select("key", "node")
    if not large.isEmpty():
        more = linking.connected(large, ["key"], known.select("node", "lanes"), "node", lambda: simhash._kernel(MOST))
        clusters = clusters.unionByName(more.withColumnRenamed("root", "rep"))
    return minhash.within(marked, known, linking.components(clusters, "node", "rep", rows=n), id_column, threshold, width, text, node)
