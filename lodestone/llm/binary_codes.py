"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Vectors are made unit length and turned by fixed random rotations. What is stored of a
vector, once, and sent to the comparisons, is

* its code: the signs of its turned coordinates, a bit each, for one rotation or as
  many as give ``CODE_BITS`` bits;
* its correction factor: the inner product of the vector, turned by the first
  rotation, with its own code;
* its turned coordinates in four bits each, rounded with a fixed dither, as bit planes.

For a code x with factor f and the coordinates q of another vector, ``<x, q> / f`` is
an unbiased estimate of the inner product of the two, found by counting bits of
``code & plane``. The error has a deviation of ``sqrt((1 - c**2) * (1 - f**2) / (f**2 *
(D - 1)))`` at the inner product c, and that of the rounding; a pair at the threshold
or above falls ``epsilon`` deviations below the threshold only with a chance that falls
as ``exp(-epsilon**2 / 2)``. Pairs below that bound are done with; the vectors
themselves are fetched only for the others, and these are recomputed in double
precision. No upper bound lets a pair through unseen, for none below the threshold may
link.

Candidates: vectors of one label and length meet in the buckets of several tables. A
table's key is a choice of the code's bits, so whether a pair met in an earlier table
is told by the two codes, and it counts in the first one only. The number of bits
grows with the logarithm of the largest label's size, and the number of tables follows
from it and the recall asked for at the threshold; a label of up to ``BUCKET`` vectors
is one bucket and complete. Equal vectors of a label count as one node. Large
buckets are compared block by block, and no pair leaves a block as a row: a block
names the rows that have an unsure pair, the vectors are joined to these, and the
second pass finds the same unsure pairs again from the same codes.

Defined results: vectors of different lengths do not link; vectors that are null, zero
or hold null or non-finite components link with nothing, as do rows with a null label;
they are their own component and are kept. Repeated rows link with each other; of
equal ids the least names the class. An empty table gives an empty table; other
columns, whatever their names, are not read; there are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common, linking

#: Bits of a code, at least; a multiple of the vectors' length.
CODE_BITS = 256
#: Vectors that a bucket is meant to hold.
BUCKET = 512
#: Bits of a rounded coordinate.
PLANES = 4


@lru_cache(64)
def rotation(dimension: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dimension)).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as 64-bit words, the last one padded with 0."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    padded = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8").astype(np.uint64)


def chance(signs: int, tables: int, bits: int, threshold: float) -> float:
    """That a pair at the threshold meets in a table: over the bits in which its codes may differ."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    total = 0.0
    for h in range(bits + 1):
        log = math.lgamma(bits + 1) - math.lgamma(h + 1) - math.lgamma(bits - h + 1) + (h * math.log(p) if p else -math.inf if h else 0.0) + (bits - h) * math.log1p(-p)
        hit = math.comb(bits - h, signs) / math.comb(bits, signs)
        total += math.exp(log) * (1 - (1 - hit) ** tables)
    return total


def plan(largest: int, threshold: float, recall: float, bits: int = CODE_BITS, bucket: int = BUCKET, most_tables: int = 256) -> tuple[int, int]:
    """(bits of a key, tables) for labels of so many vectors."""
    signs = max(0, math.ceil(math.log2(max(largest, 1) / bucket)))
    while signs:
        for tables in range(1, most_tables + 1):
            if chance(signs, tables, bits, threshold) >= recall:
                return signs, tables
        signs -= 1  # fewer bits, larger buckets
    return 0, 1


class Coder:
    """Codes of one length of vectors."""

    def __init__(self, dimension: int, signs: int, tables: int, seed: int):
        self.dimension = dimension
        turns = math.ceil(CODE_BITS / dimension)
        self.turns = [rotation(dimension, seed + k) for k in range(turns)]
        self.width = -(-dimension // 64)  # words of the first rotation, which the estimates use
        rng = np.random.default_rng((seed, dimension, signs))
        self.dither = rng.random(dimension)
        picks = [np.sort(rng.choice(dimension * turns, signs, replace=False)) for _ in range(tables)]
        self.picks = np.array(picks, np.int64).reshape(tables, signs)
        # where a bit of a rotation stands in the padded words
        masks = np.zeros((tables, turns * self.width * 64), np.uint8)
        for t, p in enumerate(self.picks):
            masks[t, p // dimension * self.width * 64 + p % dimension] = 1
        self.masks = words(masks)
        self.weights = 1 << np.arange(signs, dtype=np.int64)

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        """Of length one; the largest coordinate comes out first, so that no square overflows or vanishes."""
        v = vectors.astype(np.float64)
        v = v / np.abs(v).max(1, keepdims=True)
        return v / np.sqrt((v * v).sum(1, keepdims=True))

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code words, plane words, (factor, least, step, sum of roundings), keys)."""
        d = self.dimension
        turned = [unit @ t.T for t in self.turns]
        bits = [(t >= 0).astype(np.uint8) for t in turned]
        code = np.concatenate([words(b) for b in bits], 1)
        first = turned[0]
        factor = np.abs(first).sum(1) / math.sqrt(d)
        least, most = first.min(1), first.max(1)
        step = np.maximum((most - least) / ((1 << PLANES) - 1), 1e-12)
        rounded = np.clip(np.floor((first - least[:, None]) / step[:, None] + self.dither), 0, (1 << PLANES) - 1).astype(np.uint8)
        planes = np.concatenate([words(rounded >> p & 1) for p in range(PLANES)], 1)
        stats = np.stack([factor, least, step, rounded.sum(1, dtype=np.float64)], 1)
        keys = (np.concatenate(bits, 1).astype(np.int64)[:, self.picks] * self.weights).sum(2)
        return code, planes, stats, keys


@lru_cache(32)
def coder_of(dimension: int, signs: int, tables: int, seed: int) -> Coder:
    return Coder(dimension, signs, tables, seed)


def estimates(dimension: int, code: np.ndarray, planes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated inner products of all pairs: codes and factors of the left, rounded coordinates of the right."""
    width = -(-dimension // 64)
    counted = np.zeros((len(code), len(planes)))
    ones = np.bitwise_count(code[:, :width]).sum(1).astype(np.float64)
    for w in range(width):
        x = code[:, w, None]
        for p in range(PLANES):
            counted += np.bitwise_count(x & planes[None, :, p * width + w]) * float(1 << p)
    least, step, total = (right[None, :, k] for k in (1, 2, 3))
    dots = (2 * (least * ones[:, None] + step * counted) - (dimension * least + step * total)) / math.sqrt(dimension)
    return dots / left[:, 0, None]


def deviations(dimension: int, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """The deviation of each estimate at that inner product: of the code, and of the rounding."""
    f = left[:, 0, None]
    of_code = (1 - cosine**2) * (1 - f**2).clip(0) / max(dimension - 1, 1)
    return np.sqrt(of_code + right[None, :, 2] ** 2 / 4) / f


def _words(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), "<u8").reshape(len(column), -1).astype(np.uint64) if len(column) else np.zeros((0, 1), np.uint64)


class Kernel:
    """Which pairs of a block are unsure, and which of these link."""

    def __init__(self, threshold: float, epsilon: float, coder: Callable[[int], Coder]):
        self.threshold, self.epsilon, self.coder = threshold, epsilon, coder
        self.seen = self.recomputed = 0

    def unsure(self, left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs whose bound reaches the threshold and that meet here first."""
        if not len(left["node"]) or not len(right["node"]):
            return np.empty(0, int), np.empty(0, int)
        d, table = int(left["length"][0]), int(left["table"][0])
        code, planes = _words(left["code"]), _words(right["planes"])
        a, b = left["stats"], right["stats"]
        bound = self.threshold - self.epsilon * deviations(d, a, b, self.threshold)
        i, j = np.nonzero((estimates(d, code, planes, a, b) >= bound) & (left["node"][:, None] != right["node"][None, :]))
        self.seen += len(a) * len(b)
        if table and len(i):
            other = _words(right["code"])
            differ = code[i] ^ other[j]
            new = np.ones(len(i), bool)
            for mask in self.coder(d).masks[:table]:
                new &= (differ & mask).any(1)
            i, j = i[new], j[new]
        return i, j

    def __call__(self, left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> np.ndarray:
        d = int(left["length"][0]) if len(left["node"]) else 1
        links = np.zeros((len(left["node"]), len(right["node"])), bool)
        i, j = self.unsure(left, right)
        self.recomputed += len(i)
        if len(i):
            a, b = (self.coder(d).unit(x["vector"]) for x in (left, right))
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                links[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= self.threshold
        return links


def links(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.98, epsilon: float = 3.5, seed: int = 20240229, bucket: int = BUCKET) -> DataFrame:
    """One row per vector: the id, n_links, component_id and kept."""
    v, most = F.col("vector"), F.col("most")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("most", F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))))
    good = F.coalesce((most > 0) & (most < float("inf")) & ~F.isnan(most) & ~F.exists(v, lambda x: x.isNull()) & F.col("label").isNotNull(), F.lit(False))
    # 128 bits of hash stand for a label and vector; -0.0 hashes as 0.0
    rows = rows.select("id", "label", "vector", F.when(good, F.xxhash64("label", "vector")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "vector", "label")).alias("h2"))
    usable = rows.where("h1 is not null")
    sizes = usable.groupBy("label", F.size("vector").alias("d")).agg(F.approx_count_distinct("h1", 0.03).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    signs, tables = plan(largest, threshold, recall, bucket=bucket)
    coder = lambda d: coder_of(d, signs, tables, seed)
    nodes = usable.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "label", "vector", "copies", "first", "h1", "h2")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in batches:
            lengths = pc.list_value_length(mixed.column("vector")).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                batch = mixed.filter(pa.array(lengths == d))
                c = coder(d)
                n = batch.num_rows
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, d)
                code, planes, stats, keys = c.encode(c.unit(x))
                lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))
                packed = lambda a: pa.array([r.tobytes() for r in a.astype("<u8")], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(n, d), pa.int32()), packed(code), packed(planes), lists(stats, pa.float64()), lists(keys, pa.int64())],
                    names=[*batch.schema.names, "length", "code", "planes", "stats", "keys"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    coded = common.written(nodes.mapInArrow(encode, f"{kinds}, length int, code binary, planes binary, stats array<double>, keys array<long>"), "codes")
    keys = ["label", "length", "table", "key"]
    rows_of = coded.select("node", "label", "length", F.posexplode("keys").alias("table", "key"))
    payload = coded.select("node", "code", "planes", "stats")
    kernel = lambda: Kernel(threshold, epsilon, coder)
    places = [*keys, "__i", "__j", "__own", "node"]

    def unsure() -> Callable[[pa.Table], pa.Table]:
        k = kernel()

        def named(group: pa.Table) -> pa.Table:
            left, right, same = linking.sides(group)
            i, j = k.unsure(left, right)
            chosen = np.union1d(left["node"][i], right["node"][j])
            return group.select(places).filter(pa.array(np.isin(group["node"].to_numpy(), chosen)))

        return named

    dealt = linking.deal(rows_of, keys, "node")
    schema = dealt.select(places).schema
    opened = common.written(linking.each_group(dealt.join(payload, "node"), keys, unsure, schema), "unsure")

    def exact() -> Callable[[pa.Table], pa.RecordBatch]:
        k = kernel()
        return lambda group: linking.linked(group, k, "node", "copies")

    again = opened.join(coded.select("node", "code", "planes", "stats", "copies", "vector"), "node")
    found = common.written(linking.each_group(again, keys, exact, linking.LINKS), "links", instead_of=[opened])
    degree = found.groupBy("node").agg(F.sum("links").alias("linked"))
    roots = linking.components(found.select("node", "rep"), "node", "rep")
    named = coded.select("node", "h1", "h2", "copies", "first").join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    classes = named.join(least, "root").select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"), "least")
    marked = rows.select("id", "h1", "h2")
    joined = marked.where("h1 is not null").join(classes, ["h1", "h2"]).unionByName(marked.where("h1 is null"), allowMissingColumns=True)
    component = F.coalesce("least", "id")
    return joined.select(
        F.col("id").alias(id_column),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
