"""Packing of token sequences: bounded-space online best fit.

Each partition reads its documents once and keeps a fixed number of windows
open. A document's ids (with an end id) are cut into full windows, which leave
at once, and a rest, which goes into the open window with the least room that
holds it. If none does and all are in use, the fullest leaves and a new one
opens. What is open at the end of the partitions is merged: those leftovers, at
most ``open_windows`` for a partition, are packed again best fit in groups of
bounded size.

Defined results: a null or empty text is one end id; repeated rows are packed
each for itself; a document of any length is cut, never shortened; an empty
table gives no piece; only the id and text columns are read, so further columns
with any names do no harm.
"""

from __future__ import annotations

import base64
import math
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

#: Leftover windows that one task packs.
MERGE_GROUP = 20_000
#: Chunks that one generation of a worker's table holds; rare ones cost more here than elsewhere.
CHUNK_ENTRIES = 500_000


class ByteBpe:
    """Whole texts to ids, as the tokenizers library encodes them with a byte-level vocabulary.

    A text is cut at single spaces between two characters that are not white
    space; pre-tokens of these vocabularies begin there and never reach across,
    so each chunk (with its space before it) is encoded once for a worker. Chunks
    of Latin letters, digits and ASCII signs go through the rank table, all others,
    and those with an added token, through the library itself.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    _LATIN = re.compile("[\t\n\r -~À-ſ]*")
    _BORDER = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, spec: str, ranks: bytes):
        import tiktoken
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(spec)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.ranks = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.table = common.WordTable(self.encode_chunks, CHUNK_ENTRIES)

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes | None]:
        """Packed ids of each key; None for a chunk that must not be cut off here.

        Keys: a chunk without the space before it; 0xFF and the first chunk of a
        text; 0xFE and a chunk whose borders have been looked at.
        """
        found: list[bytes | None] = [None] * len(chunks)
        others: list[tuple[int, str]] = []
        for i, key in enumerate(chunks):
            mark = key[:1]
            chunk = (key[1:] if mark in (b"\xff", b"\xfe") else key).decode("utf-8", "replace")
            if mark != b"\xfe" and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
                continue
            text = chunk if mark in (b"\xff", b"\xfe") else " " + chunk
            if self._LATIN.fullmatch(text) and not (self.special and self.special.search(text)):
                ids = self.ranks.encode_ordinary(text)
                found[i] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append((i, text))
        if others:
            encoded = self.library.encode_batch_fast([t for _, t in others], add_special_tokens=False)
            for (i, _), e in zip(others, encoded, strict=True):
                found[i] = np.array(e.ids, "<u4").tobytes()
        return found

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            keys = text.split(b" ")
            keys[0] = b"\xff" + keys[0]
            cut.append(keys)
        self.table.admit(cut)
        for text, keys in zip(texts, cut, strict=True):
            values = list(map(self.table.__getitem__, keys))
            if None in values:
                keys = [b"\xfe" + c.encode() for c in self._BORDER.split(text.decode("utf-8", "replace")) if c]
                values = self.encode_chunks(keys)
            yield b"".join(values)


class OpenWindows:
    """The open windows of one partition."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.rooms: list[tuple[int, int]] = []  # (room, number) in order
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int, piece: tuple) -> list[tuple[int, list[tuple]]]:
        """Put a piece of this length into its window; the windows that leave."""
        left = []
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                left.append(self.leave(0))
            room, number = self.size, self.new()
            self.pieces[number] = []
        self.pieces[number].append((*piece, self.size - room))
        if room == length:
            left.append((number, self.pieces.pop(number)))
        else:
            insort(self.rooms, (room - length, number))
        return left

    def leave(self, at: int) -> tuple[int, list[tuple]]:
        _, number = self.rooms.pop(at)
        return number, self.pieces.pop(number)


def merge_windows(windows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Best fit, longest first: window -> the sequence and offset that it moves to."""
    rooms: list[tuple[int, int]] = []
    moved = []
    order = windows.sort_values(["fill", "sequence_id"], ascending=[False, True])
    for number, fill in zip(order["sequence_id"].tolist(), order["fill"].tolist(), strict=True):
        at = bisect_left(rooms, (fill, -1))
        room, sequence = rooms.pop(at) if at < len(rooms) else (size, number)
        moved.append((number, sequence, size - room))
        if room > fill:
            insort(rooms, (room - fill, sequence))
    return pd.DataFrame(moved, columns=["sequence_id", "to_sequence", "to_offset"])


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_column: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0, open_windows: int = 64) -> DataFrame:
    """One row per piece: id, start, length, ids (packed little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id, offset.

    The first pass is written to the shared folder, so that the merge of leftovers
    does not encode again. Lost executors repeat their own partitions only; a
    partition's sequence ids depend on its number and rows alone.
    """
    common.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_column), common.as_bytes(text).alias("__text"))
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length")]
    schema = T.StructType(
        [T.StructField(id_column, source.schema[0].dataType), *longs, T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset", "fill")]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        bpe, windows = ByteBpe(spec.value, ranks.value), OpenWindows(size, open_windows)
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        kind: pa.Schema | None = None

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kind, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=kind)

        def emit(number: int, pieces: list[tuple], fill: int | None = None) -> None:
            rows.extend((*p[:5], base + number, p[5], fill) for p in pieces)

        for batch in batches:
            kind = kind or pa.schema(
                [pa.field(id_column, batch.schema.field(0).type)]
                + [pa.field(n, pa.binary() if n == "ids" else pa.int64()) for n in schema.names[1:]]
            )
            keys = iter(batch.column(0).to_pylist())
            for portion in common.portions(common.binaries(batch.column(1))):
                for ids in bpe.encode(portion):
                    key, ids = next(keys), ids + end
                    total = len(ids) // 4
                    whole = total - total % size
                    for start in range(0, whole, size):
                        emit(windows.new(), [(key, start, size, ids[4 * start : 4 * (start + size)], total, 0)])
                    if whole < total:
                        for number, pieces in windows.place(total - whole, (key, whole, total - whole, ids[4 * whole :], total)):
                            emit(number, pieces)
                    if len(rows) >= 2048:
                        yield flush()
        while windows.rooms:
            fill = size - windows.rooms[0][0]
            emit(*windows.leave(0), fill)
        if rows:
            yield flush()

    first = common.written(source.mapInArrow(run, schema), "packed")
    left = first.where(F.col("fill").isNotNull())
    starts = left.where("offset = 0").select("sequence_id", "fill")
    groups = max(1, math.ceil(starts.count() / MERGE_GROUP))
    moves = starts.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("g")).applyInPandas(
        lambda w: merge_windows(w, size), "sequence_id long, to_sequence long, to_offset long"
    )
    names = [c for c in schema.names if c != "fill"]
    moved = left.join(moves, "sequence_id").withColumns({"sequence_id": F.col("to_sequence"), "offset": F.col("offset") + F.col("to_offset")})
    return first.where(F.col("fill").isNull()).select(names).unionByName(moved.select(names))
