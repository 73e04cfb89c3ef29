"""SimHash near-duplicates by multi-index hashing.

A fingerprint has one or more lanes of 64 bits; lane 0 is voted by the XXH64
(seed 42) of the shingles, further lanes by mixes of the same hashes. Each lane
is two segments of 32 bits. Two fingerprints that differ in few bits have a
segment in which they differ in at most one: so each fingerprint enters a table
with every segment, and with the segments at distance one, and those that meet
are verified on all bits. With one lane and two bits, the second segment needs
no neighbours: if the first differs in two bits, the second is equal.

A pair at distance one in a segment is met once, from the side whose bit is 0.
Equal fingerprints count as one node, so groups of copies cost nothing, and nodes that
links have joined already are not compared again.

Defined results: a null or empty text has fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows share a
component; texts of any length are read whole; null ids never name a component unless
all of its ids are null, and of tied ids the least names it; an empty table gives an
empty table. Of ``fingerprints`` other columns pass through, and a column that has the
result's name gives way to it; ``components_of`` reads its two columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common, linking

SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of the text with A-Z in lower case, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed=SEED) for s in shingles]), ">u8").astype(np.uint64)


def votes(hashes: np.ndarray, portion: int = 1 << 15) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), portion):
        bits = np.unpackbits(hashes[at : at + portion].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3, lanes: int = 1) -> list[int]:
    """Signed 64-bit lanes of a text's fingerprint."""
    hashes = shingle_hashes(text, width)
    found = []
    for lane in range(lanes):
        value = votes(common.mixed(hashes + np.uint64(lane * common.ODD % (1 << 64))) if lane else hashes) if len(hashes) else 0
        found.append(value - (1 << 64) if value >> 63 else value)
    return found


def fingerprints(docs: DataFrame, width: int = 3, lanes: int = 1, text: str = "text", out: str = "lanes") -> DataFrame:
    """docs with one column more, named out: the lanes of each whole text."""

    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.lean_worker()
        for texts in batches:
            yield pa.array([fingerprint(x.as_py() or b"", width, lanes) for x in texts], pa.list_(pa.int64()))

    return docs.withColumn(out, F.arrow_udf(run, "array<long>")(common.as_bytes(text)))


def _segment(lanes: str, s: int) -> F.Column:
    lane = F.col(lanes)[s // 2]
    return F.shiftrightunsigned(lane, 32) if s % 2 == 0 else lane.bitwiseAND(F.lit(0xFFFFFFFF))


def _probes(segment: F.Column, s: int, neighbours: bool) -> F.Column:
    """Keys of a segment: itself, and with one of its 0 bits set. The number of the segment stands above its 32 bits."""
    tag = F.lit(s << 32)
    own = F.array(segment + tag)
    if not neighbours:
        return own
    set_bits = F.array(*[F.when(segment.bitwiseAND(F.lit(1 << i)) == 0, segment + F.lit(1 << i) + tag) for i in range(32)])
    return F.concat(own, F.filter(set_bits, lambda x: x.isNotNull()))


def _kernel(most_bits: int):
    """Links of at most so many bits."""

    def kernel(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> np.ndarray:
        x, y = left["lanes"].astype(np.int64).view(np.uint64), right["lanes"].astype(np.int64).view(np.uint64)
        distance = np.zeros((len(x), len(y)), np.uint16)
        for lane in range(x.shape[1]):
            distance += np.bitwise_count(x[:, lane, None] ^ y[None, :, lane])
        return distance <= most_bits

    return kernel


def components_of(marked: DataFrame, id_column: str = "doc_id", most_bits: int = 2, neighbours: list[bool] | None = None, lanes: int = 1) -> DataFrame:
    """The id and ``lanes`` of each row, and ``component_id``, the least id that links reach.

    Other columns of marked are not read.

    neighbours: for each segment, whether its Hamming ball of radius one is
    enumerated. By default all but the last segment of a fingerprint of one lane
    and two bits. The links are complete while ``most_bits`` is less than twice
    the enumerated segments plus the others.
    """
    neighbours = neighbours or ([True, False] if lanes == 1 and most_bits <= 2 else [True] * (2 * lanes))
    marked = common.written(marked.select(id_column, "lanes"), "fingerprints")
    known = marked.groupBy("lanes").agg(F.min(id_column).alias("__first"))
    known = common.written(known.select("lanes", "__first", F.monotonically_increasing_id().alias("node") if lanes > 1 else F.col("lanes")[0].alias("node")), "nodes", rows=marked.count())
    probes = F.concat(*[_probes(_segment("lanes", s), s, near) for s, near in enumerate(neighbours)])
    rows = known.select("node", F.explode(probes).alias("key"))
    roots = linking.connected(rows, ["key"], known.select("node", "lanes"), "node", lambda: _kernel(most_bits))
    named = known.join(roots, "node", "left").select("lanes", "__first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("__first").alias("component_id"))
    classes = named.join(least, "root").select("lanes", "component_id")
    return marked.join(classes, "lanes")
