"""Groups of documents by exact Jaccard similarity of their word shingles.

Candidates: a document's set of shingle hashes (XXH64, seed 42) has the least
value under each of ``TABLES * ROWS`` hash functions; documents that agree in all
``ROWS`` values of a table meet. At similarity 0.8 a pair misses all of 16 tables
of four with (1 - 0.8**4)**16 = 0.0002, whatever the edit and however short the
texts; above, with less. Pairs that meet and agree in ``LEAST`` of all values
(five standard errors below 0.8) are joined to clusters.

Links: within a cluster the exact similarity of whole sets decides, never an estimate.
Clusters are compared block by block until no link can join two groups any more
(``linking.connected``), and no pair leaves a block as a row. Documents of equal sets
are one node.

Defined results: null and empty texts have the empty set and are one group; a text
of fewer words than a shingle is one shingle; texts of any length are read whole; of
tied rows the least id names the group; repeated rows, of ids of their own, are one
group; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common, linking
from lodestone.llm.simhash import shingle_hashes

TABLES, ROWS, LEAST = 16, 4, 0.55

_rng = np.random.default_rng(20240229)
_TIMES = _rng.integers(0, 1 << 32, TABLES * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, TABLES * ROWS, dtype=np.uint32)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, width))


def least_values(hashes: np.ndarray, portion: int = 1 << 13) -> np.ndarray:
    """The least value of a set under each hash function; all ones if it is empty."""
    found = np.full(len(_TIMES), 0xFFFFFFFF, np.uint32)
    short = (common.mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), portion):
        np.minimum(found, (short[at : at + portion, None] * _TIMES + _PLUS).min(0), out=found)
    return found


def marks(docs: DataFrame, width: int = 5, text: str = "text", node: str = "node", sketch: str = "sketch") -> DataFrame:
    """docs with two columns more: 128 bits of hash of the text's set, and its least values."""
    common.small_batches(docs.sparkSession)
    mark = common.fresh(docs, stem="__mark")
    kind = pa.struct([("set", pa.binary()), ("sketch", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        common.lean_worker()
        for texts in batches:
            sets, values = [], []
            for x in texts:
                hashes = shingle_set(x.as_py() or b"", width)
                sets.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                values.append(least_values(hashes).view(np.int32))
            flat = np.concatenate(values) if values else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(_TIMES), pa.int32()), pa.array(flat))
            yield pa.StructArray.from_arrays([pa.array(sets, pa.binary()), lists], fields=list(kind))

    marked = docs.withColumn(mark, F.arrow_udf(run, "struct<set: binary, sketch: array<int>>")(common.as_bytes(text)))
    return marked.withColumns({node: F.col(f"{mark}.set"), sketch: F.col(f"{mark}.sketch")}).drop(mark)


def agree(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> np.ndarray:
    """Which pairs agree in the share LEAST of their least values."""
    a, b = left["sketch"], right["sketch"]
    same = np.zeros((len(a), len(b)), np.uint16)
    for k in range(len(_TIMES)):
        same += a[:, k, None] == b[None, :, k]
    return same >= LEAST * len(_TIMES)


def similar(left: dict[str, np.ndarray], right: dict[str, np.ndarray], threshold: float, portion: int = 2048) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of threshold or more; exact."""
    a = [np.frombuffer(x, np.uint64) for x in left["shingles"]]
    b = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
    sizes_a, sizes_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    rows_a, rows_b = np.repeat(np.arange(len(a)), sizes_a), np.repeat(np.arange(len(b)), sizes_b)
    both = np.intersect1d(flat_a, flat_b)
    shared = np.zeros((len(a), len(b)), np.float64)
    sides = []
    for flat, rows in ((flat_a, rows_a), (flat_b, rows_b)):
        at = np.searchsorted(both, flat).clip(max=max(len(both) - 1, 0))
        known = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        sides.append((at[known][order], rows[known][order]))
    for start in range(0, len(both), portion):
        tables = []
        for (at, rows), n in zip(sides, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(at, [start, start + portion])
            held = np.zeros((n, min(portion, len(both) - start)), np.float32)
            held[rows[i:j], at[i:j] - start] = 1
            tables.append(held)
        shared += tables[0] @ tables[1].T
    united = sizes_a[:, None] + sizes_b[None, :] - shared
    return shared >= threshold * united - 1e-9


def groups(marked: DataFrame, id_column: str, threshold: float = 0.8, width: int = 5, text: str = "text", node: str = "node", sketch: str = "sketch") -> DataFrame:
    """(id, component_id) of each row of marked: the least id that links of this similarity reach.

    marked: what ``marks`` gave, written, with unique ids; its texts are read again only for nodes that have candidates.
    """
    codes = marked.select(F.col(id_column).alias("__id"), F.col(node).alias("set"), F.col(sketch).alias("sketch"))
    known = codes.groupBy("set").agg(F.min("__id").alias("__first"), F.first("sketch").alias("sketch"))
    known = common.written(known.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = F.array(*[F.xxhash64(F.lit(t), *[F.col("sketch")[t * ROWS + k] for k in range(ROWS)]) for t in range(TABLES)])
    clusters = linking.connected(known.select("node", F.explode(F.array_distinct(keys)).alias("key")), ["key"], known.select("node", "sketch"), "node", lambda: agree)
    return within(marked, known, clusters, id_column, threshold, width, text, node)


def within(marked: DataFrame, known: DataFrame, clusters: DataFrame, id_column: str, threshold: float, width: int = 5, text: str = "text", node: str = "node") -> DataFrame:
    """(id, component_id) of each row of marked, linked by the exact similarity of whole sets within clusters.

    known: set, node and __first, the least id of each different set, written. clusters: node and root of the
    sets that may be similar to another.
    """
    clusters = common.written(clusters, "clusters", rows=known.count())

    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingle_set(x.as_py() or b"", width).tobytes() for x in texts], pa.binary())

    firsts = known.join(clusters, "node", "left_semi").select("node", F.col("__first").alias(id_column))
    bodies = firsts.join(marked.select(id_column, common.as_bytes(text).alias("__body")), id_column)
    payload = common.written(bodies.select("node", F.arrow_udf(sets, "binary")("__body").alias("shingles")), "sets")
    roots = linking.connected(clusters.select(F.col("root").alias("cluster"), "node"), ["cluster"], payload, "node", lambda: lambda a, b: similar(a, b, threshold), block=256)
    named = known.join(roots, "node", "left").select("set", "__first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("__first").alias("component_id"))
    classes = named.join(least, "root").select("set", "component_id")
    codes = marked.select(F.col(id_column).alias("__id"), F.col(node).alias("set"))
    return codes.join(classes, "set").select(F.col("__id").alias(id_column), "component_id")
