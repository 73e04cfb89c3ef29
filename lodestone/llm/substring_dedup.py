"""Substring dedup with a count-min prefilter.

A window is ``width`` consecutive words; a word goes if a window over it, word
for word, starts at another place too, in the same document or another.

1. Sketch: each partition counts the grams that stand for its windows in a
   count-min sketch with counters that stop at two. What stands for a window is
   the least hash of its ``gram``-word parts: equal windows have equal least
   parts, so the estimate for a window is never below its count, and a text
   needs an eighth of the insertions. The partitions' sketches are merged block
   by block, and the blocks' "twice or more" bits, of bounded size, are broadcast.
2. Windows: a second pass hashes every window (96 bits, so that 10**13 windows hold a
   false pair with a chance of 0.001) and drops those that the sketch estimates at
   one. Of the rest, those that a task meets again are known at once; one row for
   each distinct window is dealt by its hash and grouped exactly. So a passage
   that a third of all rows share costs a task one row, and no group is gathered
   anywhere.
3. The repeated spans come back to their documents, and the words go.

The sketch is sized by the bytes of text: eight cells for each expected
insertion, up to ``most_cells`` in each of its two rows, for it is broadcast. A corpus
that needs more has no sketch in one place: the grams that would be inserted, an eighth
of the words, are dealt by their hash and grouped as the windows are, and documents
are joined to their repeated grams, which then decide what windows pass. The result
is the same.

Defined results: a null or empty text has no words and stays empty; texts shorter
than a window stay; repeated rows are documents of their own, so all their
windows are repeated; of equal windows none is kept, so there are no ties; texts of any
length are read whole, a window never reaches into another text; a null id is an
id like any other; an empty table gives an empty table; other columns pass through, and
a column that has the result's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

DEPTH = 2
#: Cells of a block of the sketch, which travels as one row.
BLOCK = 1 << 16

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every run of width values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return best(values[: len(values) - rest], values[rest:]) if rest else values


class Portion:
    """The words of some texts as one array of hashes, and the windows in it."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        words = [t.split() for t in texts]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.width, self.gram = width, gram
        self.hashes = common.word_hashes([w for ws in words for w in ws])
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        n = len(self.hashes)
        self.whole = np.zeros(max(n - width + 1, 0), bool)
        if n >= width:
            starts = np.arange(n - width + 1)
            self.whole = self.ends[self.doc[: n - width + 1]] - starts >= width
            self.grams = common.window_hashes(self.hashes, gram)
            self.least = np.where(self.whole, _sliding(self.grams, width - gram + 1, np.minimum), np.uint64(0))

    def places(self) -> np.ndarray:
        """Where the grams begin that stand for some window."""
        if not self.whole.any():
            return np.empty(0, np.int64)
        span = self.width - self.gram + 1
        pad = np.zeros(span - 1, np.uint64)
        most = _sliding(np.concatenate([pad, self.least, pad]), span, np.maximum)
        return np.flatnonzero((most == self.grams) & (most > 0))

    def inserted(self) -> np.ndarray:
        """The grams that stand for some window, once for each place."""
        at = self.places()
        return self.grams[at] if len(at) else np.empty(0, np.uint64)


def cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    return common.mixed(grams ^ np.uint64((row + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))) >> np.uint64(64 - bits)


class Sketch:
    """Counters of one partition, as the bits "once or more" and "twice or more" of each cell."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
        self.twice = np.zeros_like(self.once)

    def add(self, grams: np.ndarray) -> None:
        for row in range(DEPTH):
            found, counts = np.unique(cells(grams, row, self.bits), return_counts=True)
            if not len(found):
                continue
            at, bit = (found >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (found & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
            again = np.where((counts > 1) | ((self.once[row][at] & bit) > 0), bit, np.uint8(0)).astype(np.uint8)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            self.once[row][at[starts]] |= np.bitwise_or.reduceat(bit, starts)
            self.twice[row][at[starts]] |= np.bitwise_or.reduceat(again, starts)

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = min(BLOCK, 1 << self.bits) // 8
        once, twice = self.once.reshape(-1, size), self.twice.reshape(-1, size)
        for k in np.flatnonzero(once.any(1)):
            yield int(k), shut(once[k]), shut(twice[k])


def shut(block: np.ndarray) -> bytes:
    """A block's set bits as 16-bit positions, or the block itself where that is shorter."""
    at = np.flatnonzero(np.unpackbits(block, bitorder="little"))
    return at.astype("<u2").tobytes() if 2 * len(at) < len(block) else block.tobytes()


def opened(data: bytes, size: int) -> np.ndarray:
    if len(data) == size:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(size * 8, np.uint8)
    bits[np.frombuffer(data, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def sketch_cells(text_bytes: int) -> float:
    """Eight cells for each expected insertion: an eighth of the words, at about seven bytes each."""
    return text_bytes / 7 / 8 * 8


def sketch_bits(text_bytes: int, most_cells: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(sketch_cells(text_bytes), 1))), 16, np.log2(most_cells)))


def build_sketch(texts: DataFrame, width: int, gram: int, bits: int) -> np.ndarray:
    """The merged sketch's "twice or more" bits, one row of bytes for each hash."""
    size = min(BLOCK, 1 << bits) // 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        sketch = Sketch(bits)
        for batch in batches:
            for portion in common.portions(common.binaries(batch.column(0))):
                sketch.add(Portion(portion, width, gram).inserted())
        rows = list(sketch.blocks())
        for at in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = opened(once, size), opened(twice, size)
                if block in merged:
                    c, d = merged[block]
                    a, b = a | c, b | d | (a & c)
                merged[block] = a, b
        for block, (_, twice) in merged.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shut(twice)], pa.binary())], ["block", "twice"])

    partial = texts.mapInArrow(count, "block long, once binary, twice binary")
    rows = partial.repartition("block").mapInArrow(merge, "block long, twice binary").toArrow()
    sketch = np.zeros((DEPTH * (1 << bits) // 8 // size, size), np.uint8)
    for block, twice in zip(rows["block"].to_pylist(), rows["twice"].to_pylist(), strict=True):
        sketch[block] = opened(twice, size)
    return sketch.reshape(DEPTH, -1)


def estimated_repeated(sketch: np.ndarray, bits: int, grams: np.ndarray) -> np.ndarray:
    found = np.ones(len(grams), bool)
    for row in range(DEPTH):
        c = cells(grams, row, bits)
        found &= (sketch[row][(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
    return found


def runs(starts: np.ndarray, width: int) -> bytes:
    """Sorted window starts as packed 32-bit (from, to) spans of words."""
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    first, last = np.concatenate([starts[:1], starts[cut]]), np.concatenate([starts[cut - 1], starts[-1:]])
    return np.stack([first, last + width], 1).astype("<u4").tobytes()


WINDOWS = "deal long, high long, low int, key1 long, key2 int, at int, again boolean, spans binary"
#: Windows that a task holds to find repeats among them before it deals them out.
HELD = 1 << 20
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
_KIND = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in WINDOWS.split(", "))])


def dealt(parts: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
    """Rows for held windows, given as arrays of high, low, key1, key2, at and the document's number.

    One row for each distinct window; it names its document only if no other held
    window is equal. The windows that are, are repeated for certain: their
    documents get rows of spans.
    """
    high, low, key1, key2, at, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((low, high))
    high, low, key1, key2, at, doc = (x[order] for x in (high, low, key1, key2, at, doc))
    new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    again = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    n, hidden = int(new.sum()), again[new]
    first = pa.array(high[new].view(np.int64))
    yield pa.RecordBatch.from_arrays(
        [first, first, pa.array(low[new].view(np.int32)), *(pa.array(x[new], mask=hidden) for x in (key1, key2, at)), pa.array(hidden), pa.nulls(n, pa.binary())], schema=_KIND
    )
    if not again.any():
        return
    doc, at, key1, key2 = doc[again], at[again].astype(np.int64), key1[again], key2[again]
    order = np.lexsort((at, doc))
    doc, at, key1, key2 = doc[order], at[order], key1[order], key2[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    heads = np.concatenate([[0], cuts])
    m = len(heads)
    nothing = [pa.nulls(m, _ARROW[t]) for t in ("long", "int")]
    spans = pa.array([runs(x, width) for x in np.split(at, cuts)], pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(key1[heads]), *nothing, pa.array(key1[heads]), pa.array(key2[heads]), pa.nulls(m, pa.int32()), pa.array(np.ones(m, bool)), spans], schema=_KIND
    )


def starts_of(known: list[bytes], length: int, first: np.ndarray) -> np.ndarray:
    """The starts in packed spans of each text, counted over all texts, whose first words are given."""
    found = [np.empty(0, np.int64)]
    for spans, base in zip(known, first.tolist(), strict=True):
        for a, b in np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64).tolist():
            found.append(np.arange(base + a, base + b - length + 1))
    return np.concatenate(found)


def repeated_spans(texts: DataFrame, width: int, gram: int, bits: int | None = None, sketch=None, of_grams: bool = False) -> DataFrame:
    """(key1, key2, spans) rows from texts (body, key1, key2); spans of repeated windows.

    What may be repeated is told by a sketch, or by a column ``known`` of the texts, the
    spans of their repeated grams; with of_grams the grams themselves are grouped.
    """
    length = gram if of_grams else width

    def candidates(p: Portion, shared: np.ndarray | None, known: list[bytes] | None) -> np.ndarray:
        if of_grams:
            return p.places()
        at = np.flatnonzero(p.whole)
        if not len(at):
            return at
        if shared is not None:
            return at[estimated_repeated(shared, bits, p.least[at])]
        return at[np.isin(p.least[at], p.grams[starts_of(known, gram, p.ends - p.lengths)])]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        shared = None if sketch is None else sketch.value
        held: list[tuple] = []
        seen = 0
        for batch in batches:
            key1, key2 = (batch.column(i).to_numpy() for i in (1, 2))
            known = common.binaries(batch.column(3)) if batch.num_columns > 3 else None
            done = 0
            for portion in common.portions(common.binaries(batch.column(0))):
                p = Portion(portion, width, gram)
                at = candidates(p, shared, known and known[done : done + len(portion)])
                if len(at):
                    high = common.window_hashes(p.hashes, length)[at]
                    low = (common.window_hashes(common.mixed(p.hashes + np.uint64(common.ODD)), length)[at] >> np.uint64(32)).astype(np.uint32)
                    doc = p.doc[at]
                    held.append((high, low, key1[done + doc], key2[done + doc], (at - (p.ends - p.lengths)[doc]).astype(np.int32), seen + doc))
                done += len(portion)
                seen += len(portion)
                if sum(len(h[0]) for h in held) >= HELD:
                    yield from dealt(held, length)
                    held = []
        if held:
            yield from dealt(held, length)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by window, known repeats first; the state is one row."""
        last: tuple | None = None  # window, may it still have to report its first row, that row
        for batch in batches:
            spans = batch.column("spans")
            direct = pc.is_valid(spans)
            d = batch.filter(direct)
            if d.num_rows:
                yield pa.RecordBatch.from_arrays([d.column("key1"), d.column("key2"), d.column("spans")], names=["key1", "key2", "spans"])
            w = batch.filter(pc.invert(direct))
            n = w.num_rows
            if not n:
                continue
            high, low = w.column("high").to_numpy(), w.column("low").to_numpy()
            again = w.column("again").to_numpy(zero_copy_only=False)
            k1, k2, at = (w.column(c).fill_null(0).to_numpy() for c in ("key1", "key2", "at"))
            new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            repeated = size > 1
            repeated |= np.bincount(group, weights=again) > 0
            if last is not None and last[0] == (high[0], low[0]):
                repeated[0] = True
                pending = last[2]
            else:
                pending = None
            out = repeated[group] & ~again
            rows = [k1[out], k2[out], at[out]]
            if pending is not None:
                rows = [np.concatenate([np.array([p], r.dtype), r]) for p, r in zip(pending, rows, strict=True)]
            g = group[-1]
            alone = not repeated[g]
            last = ((high[-1], low[-1]), alone, (k1[-1], k2[-1], at[-1]) if alone else None)
            if len(rows[0]):
                packed = np.stack([rows[2], rows[2] + length], 1).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array([r.tobytes() for r in packed], pa.binary())], names=["key1", "key2", "spans"])

    rows = texts.mapInArrow(windows, WINDOWS)
    order = ["high", "low", F.desc("again")]
    return rows.repartition("deal").sortWithinPartitions(*order).mapInArrow(grouped, "key1 long, key2 int, spans binary")


def strip(text: bytes, spans: list[bytes]) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space) of a text."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, np.minimum(pairs[:, 1], len(words)), -1)
    gone = np.cumsum(change[:-1]) > 0
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), len(words) - len(kept), b" ".join(kept)


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 35, gram: int = 20, most_cells: int = 1 << 30, out: str = "stripped") -> DataFrame:
    """docs with one struct column more, named out: n_words, n_removed, kept_text."""
    common.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    a, b, listed = (common.fresh(docs, stem=s) for s in ("__key1", "__key2", "__spans"))
    keyed = docs.withColumns({a: F.xxhash64(F.col(id_column).cast("string"), body), b: F.hash(body, F.lit(1))})
    texts = keyed.select(body.cast("binary").alias("body"), F.col(a).alias("key1"), F.col(b).alias("key2"))
    total = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    # an id and text that whole rows repeat gives the same spans, so a set of them is bounded by the text
    gathered = lambda spans: spans.groupBy("key1", "key2").agg(F.collect_set("spans").alias(listed))
    if sketch_cells(total) <= most_cells:
        bits = sketch_bits(total, most_cells)
        sketch = spark.sparkContext.broadcast(build_sketch(texts.select("body"), width, gram, bits))
        spans = repeated_spans(texts, width, gram, bits, sketch)
    else:
        known = gathered(repeated_spans(texts, width, gram, of_grams=True))
        known = known.select("key1", "key2", F.aggregate(listed, F.lit(b""), lambda s, x: F.concat(s, x)).alias("known"))
        spans = repeated_spans(texts.join(known, ["key1", "key2"]).select("body", "key1", "key2", "known"), width, gram)
    joined = keyed.join(gathered(spans).withColumnsRenamed({"key1": a, "key2": b}), [a, b], "left")
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, lists in batches:
            found = [strip(x.as_py() or b"", s.as_py() or []) for x, s in zip(bodies, lists, strict=True)]
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), common.utf8(list(columns[2]))], fields=list(kind))

    return joined.withColumn(out, F.arrow_udf(run, RESULT)(common.as_bytes(text), F.col(listed))).drop(a, b, listed)
