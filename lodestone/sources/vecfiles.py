"""Vector files as Spark data sources: ``vecbin``, ``vecs`` and ``truth``.

vecbin: int32 rows, int32 dimension, then the values row by row. vecs: each row has
its own int32 dimension. truth: ids, then optionally distances and tags, told apart by
the file's size. Element types: float, int8, uint8, uint32. Files are read in row
ranges, one for each partition, and columns that a query does not use are dropped
before they reach Spark. A directory of part files, as the writer leaves it, reads
as one table; the part's name holds its first row number. Any store that Arrow's
file systems open will do.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodestone.functions import labels, vectors

#: element type -> (NumPy type, Spark type, Arrow type); Spark has no unsigned bytes
ELEMENTS = {
    "float": ("<f4", "float", pa.float32()),
    "int8": ("i1", "tinyint", pa.int8()),
    "uint8": ("u1", "smallint", pa.int16()),
    "uint32": ("<u4", "bigint", pa.int64()),
}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int, int]]:
    """(path, first row, bytes) of a file or of the part files in a directory."""
    fs, inner = _open(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(inner, 0, info.size)]
    parts = []
    for f in fs.get_file_info(pafs.FileSelector(inner)):
        m = re.fullmatch(r"part-(\d+)-[0-9a-f]+\..*", f.base_name)
        if m:
            parts.append((f.path, int(m[1]), f.size))
    return sorted(parts)


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    at: int
    count: int
    dimension: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, layout: str):
        self.path, self.layout = options["path"], layout
        self.kind = options.get("element", "float")
        self.step = int(options.get("rowsperpartition", 262_144))

    def _shape(self, file: str, size: int) -> tuple[int, int]:
        fs, _ = _open(self.path)
        width = np.dtype(ELEMENTS[self.kind][0]).itemsize
        with fs.open_input_file(file) as f:
            head = np.frombuffer(f.read(8), "<i4")
        if self.layout == "vecs":
            if not size:
                return 0, 0
            row = 4 + int(head[0]) * width
            if size % row:
                raise ValueError(f"{file} does not hold whole rows of dimension {head[0]}")
            return size // row, int(head[0])
        n, d = int(head[0]), int(head[1])
        if self.layout == "bin" and size != 8 + n * d * width:
            raise ValueError(f"{file} should have {8 + n * d * width} bytes and has {size}")
        return n, d

    def partitions(self) -> list[InputPartition]:
        found = []
        for file, first, size in _files(self.path):
            n, d = self._shape(file, size)
            found += [Rows(file, first, at, min(self.step, n - at), d) for at in range(0, n, self.step)]
        return found or [Rows("", 0, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, _ = _open(self.path)
        kind, _, arrow = ELEMENTS[self.kind]
        d, width = partition.dimension, np.dtype(kind).itemsize
        row = d * width + (4 if self.layout == "vecs" else 0)
        with fs.open_input_file(partition.file) as f:
            for at in range(partition.at, partition.at + partition.count, 8192):
                n = min(8192, partition.at + partition.count - at)
                data = f.read_at(n * row, at * row + (8 if self.layout == "bin" else 0))
                raw = np.frombuffer(data, np.uint8).reshape(n, row)
                if self.layout == "vecs":
                    dims = raw[:, :4].copy().view("<i4").ravel()
                    if (dims != d).any():
                        raise ValueError(f"{partition.file} mixes dimensions")
                    raw = raw[:, 4:]
                values = np.ascontiguousarray(raw).view(kind).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(values).cast(arrow))
                ids = pa.array(np.arange(partition.first + at, partition.first + at + n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids, lists], ["vec_id", "embedding"])


class _TruthReader(_Reader):
    def _shape(self, file: str, size: int) -> tuple[int, int]:
        self.kind = "uint32"
        return super()._shape(file, size)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, _ = _open(self.path)
        k = partition.dimension
        with fs.open_input_file(partition.file) as f:
            n = int(np.frombuffer(f.read_at(4, 0), "<i4")[0])
            blocks = (f.size() - 8) // (4 * n * k)
            if blocks not in (1, 2, 3) or f.size() != 8 + 4 * n * k * blocks:
                raise ValueError(f"{partition.file} is no truth file")
            take = lambda b, kind: np.frombuffer(f.read_at(4 * k * partition.count, 8 + 4 * k * (b * n + partition.at)), kind)
            size = partition.count * k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(partition.count) + partition.at + partition.first, k)),
                    pa.array(np.tile(np.arange(1, k + 1), partition.count)),
                    pa.array(take(0, "<u4").astype(np.int64)),
                    pa.array(take(1, "<f4").astype(np.float64)) if blocks > 1 else pa.nulls(size, pa.float64()),
                    pa.array(take(2, "<u4").astype(np.int64)) if blocks > 2 else pa.nulls(size, pa.int64()),
                ],
                ["qid", "rank", "vec_id", "dist", "tag"],
            )


@dataclass
class Part(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceArrowWriter):
    """One part file for each task; its rows must be consecutive and in order."""

    def __init__(self, options: dict, layout: str):
        self.path, self.layout, self.kind = options["path"], layout, options.get("element", "float")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, inner = _open(self.path)
        fs.create_dir(inner, recursive=True)
        kind = ELEMENTS[self.kind][0]
        first = after = None
        n = d = 0
        stream, temporary = None, f"{inner}/.{uuid.uuid4().hex}"
        for batch in iterator:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy()
            lists = batch.column(batch.schema.get_field_index("embedding"))
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            if after is not None and ids[0] != after or (np.diff(ids) != 1).any():
                raise ValueError("rows must be consecutive: repartitionByRange and sort by vec_id first")
            if d and x.shape[1] != d:
                raise ValueError("vectors of different dimensions")
            first, after, d = ids[0] if first is None else first, ids[-1] + 1, x.shape[1]
            stream = stream or fs.open_output_stream(temporary)
            data = x.astype(kind)
            if self.layout == "vecs":
                head = np.full((len(x), 1), d, "<i4").view(np.uint8).reshape(len(x), 4)
                data = np.concatenate([head, np.ascontiguousarray(data).view(np.uint8).reshape(len(x), -1)], 1)
            stream.write(data.tobytes())
            n += len(ids)
        if stream is None:
            return Part(None)
        stream.close()
        name = f"{inner}/part-{first:020d}-{uuid.uuid4().hex}.{self.layout}"
        if self.layout == "bin":  # the header's row count is known only now
            with fs.open_input_stream(temporary) as source, fs.open_output_stream(name + ".tmp") as target:
                target.write(np.array([n, d], "<i4").tobytes())
                while block := source.read(16 << 20):
                    target.write(block)
            fs.delete_file(temporary)
            temporary = name + ".tmp"
        fs.move(temporary, name + ".done")
        return Part(name)

    def commit(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.move(m.file + ".done", m.file)

    def abort(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(m.file + ".done")


class _TruthWriter(_Writer):
    """One part file for each task: the ids, distances and tags of consecutive queries, block after block."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, inner = _open(self.path)
        fs.create_dir(inner, recursive=True)
        blocks: list[list[np.ndarray]] = [[], [], []]
        first = after = k = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            qids = batch.column(batch.schema.get_field_index("qid")).to_numpy()
            if after is not None and qids[0] != after or (np.diff(qids) != 1).any():
                raise ValueError("queries must be consecutive: repartitionByRange and sort by qid first")
            first, after = qids[0] if first is None else first, qids[-1] + 1
            for block, (name, kind) in zip(blocks, (("ids", "<u4"), ("dists", "<f4"), ("tags", "<u4")), strict=True):
                lists = batch.column(batch.schema.get_field_index(name))
                lengths = {len(v) for v in lists.to_pylist()} | ({k} if k is not None else set())
                if len(lengths) != 1:
                    raise ValueError("every query needs as many rows of truth")
                (k,) = lengths
                block.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(qids), k).astype(kind))
        if first is None:
            return Part(None)
        name = f"{inner}/part-{first:020d}-{uuid.uuid4().hex}.truth"
        with fs.open_output_stream(name + ".done") as target:
            target.write(np.array([after - first, k], "<i4").tobytes())
            for block in blocks:
                for x in block:
                    target.write(x.tobytes())
        return Part(name)


class _Vectors(DataSource):
    layout = "bin"

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{ELEMENTS[self.options.get('element', 'float')][1]}>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), self.layout)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), self.layout)


class VecBin(_Vectors):
    @classmethod
    def name(cls) -> str:
        return "vecbin"


class Vecs(_Vectors):
    layout = "vecs"

    @classmethod
    def name(cls) -> str:
        return "vecs"


class Truth(DataSource):
    @classmethod
    def name(cls) -> str:
        return "truth"

    def schema(self) -> str:
        return "qid bigint, rank bigint, vec_id bigint, dist double, tag bigint"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TruthReader(dict(self.options), "truth")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TruthWriter(dict(self.options), "truth")


def register(spark: SparkSession) -> None:
    for source in (VecBin, Vecs, Truth):
        spark.dataSource.register(source)


def write(df: DataFrame, path: str, layout: str = "vecbin", element: str = "float", normalize: bool = False) -> None:
    """Part files of consecutive rows, of length one if asked for. vec_id must be gapless from 0."""
    register(df.sparkSession)
    ordered = df.select("vec_id", vectors.normalized(F.col("embedding"), 1e-12).alias("embedding") if normalize else "embedding")
    ordered.repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.format(layout).option("element", element).mode("append").save(path)


def metadata(spark: SparkSession, path: str, layout: str = "vecbin", element: str = "float") -> DataFrame:
    """(file, first_row, n, dimension) from the headers and sizes of the files alone."""
    reader = _Reader({"path": path, "element": element}, "vecs" if layout == "vecs" else "bin")
    rows = [(file, first, *reader._shape(file, size)) for file, first, size in _files(path)]
    return spark.createDataFrame(rows, "file string, first_row long, n long, dimension long")


def write_truth(truth: DataFrame, path: str) -> None:
    """Truth files from rows (qid, rank, vec_id, dist and, if there is one, tag; else the id is the tag).

    qid must be gapless from 0, and every query have the same number of rows.
    """
    register(truth.sparkSession)
    tag = F.col("tag") if "tag" in truth.columns else F.col("vec_id")
    lists = truth.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist", tag.alias("tag")))).alias("x"))  # k rows of a query
    lists = lists.select("qid", F.col("x.vec_id").alias("ids"), F.col("x.dist").alias("dists"), F.col("x.tag").alias("tags"))
    lists.repartitionByRange("qid").sortWithinPartitions("qid").write.format("truth").mode("append").save(path)


#: What stands for no row in result files.
NO_ROW = 0xFFFFFFFF


def write_results(results: DataFrame, path: str, k: int) -> None:
    """Results (qid, rank, vec_id, dist) as two matrices of k columns, ``ids`` and ``dists``; short lists end in NO_ROW and infinity.

    qid must be gapless from 0.
    """
    lists = results.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("x"))
    more = F.lit(k) - F.size("x")
    for name, column, pad, element in (("ids", "vec_id", F.lit(NO_ROW).cast("long"), "uint32"), ("dists", "dist", F.lit(float("inf")), "float")):
        values = F.concat(F.col(f"x.{column}"), F.array_repeat(pad, more))
        write(lists.select(F.col("qid").alias("vec_id"), values.alias("embedding")), f"{path}/{name}", "vecbin", element)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, vec_id, dist) of what ``write_results`` left."""
    ids, dists = (read(spark, f"{path}/{n}", "vecbin", e).select(F.col("vec_id").alias("qid"), F.col("embedding").alias(n)) for n, e in (("ids", "uint32"), ("dists", "float")))
    rows = ids.join(dists, "qid").select("qid", F.posexplode(F.arrays_zip("ids", "dists")).alias("p", "x"))
    return rows.select("qid", (F.col("p") + 1).cast("long").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.dists").cast("double").alias("dist")).where(F.col("vec_id") != NO_ROW)


def read(spark: SparkSession, path: str, layout: str = "vecbin", element: str = "float", **options) -> DataFrame:
    register(spark)
    return spark.read.format(layout).option("element", element).options(**options).load(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line) of a text file, without carriage returns.

    Line numbers need the counts of the parts before, which zipWithIndex takes in one pass more.
    """
    lines = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("number long, line string")
    return lines.withColumn("line", F.regexp_replace("line", "\r", ""))


def label_lines(spark: SparkSession, path: str, universal: int | None = None) -> DataFrame:
    """(vec_id, labels, is_universal) from lines of comma-separated numbers; a line's number is its id.

    Blank lines have an id and no labels; fields that are not numbers are skipped.
    """
    numbers = F.filter(F.transform(F.split("line", ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    found = numbered_lines(spark, path).select(F.col("number").alias("vec_id"), F.array_distinct(numbers).alias("labels"))
    return found.withColumn("is_universal", F.lit(False) if universal is None else F.array_contains("labels", universal))


def query_lines(spark: SparkSession, path: str, n_queries: int) -> DataFrame:
    """(qid, expression): one line for each query; another number of lines than queries is an error, as is a malformed line."""
    found = numbered_lines(spark, path).select(F.col("number").alias("qid"), F.trim("line").alias("expression"))
    n = found.count()
    if n != n_queries:
        raise ValueError(f"{n} lines for {n_queries} queries")
    for row in found.select("expression").distinct().toLocalIterator():
        labels.parse(row["expression"])
    return found


def tag_lines(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id) of numbers divided by white space, up to the first that is none, each once."""
    words = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("w"))
    numbers = F.transform("w", lambda x: x.try_cast("long"))
    first_odd = F.coalesce(F.nullif(F.array_position(F.transform(numbers, lambda x: x.isNull().cast("int")), 1), F.lit(0)), F.size("w") + 1)
    return words.select(F.explode(F.slice(numbers, 1, (first_odd - 1).cast("int"))).alias("vec_id")).distinct()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, slot, vec_id) of a page layout file: three 64-bit numbers (rows of a page, pages, rows), then for each
    page its number of rows and their ids, padded to a page's rows or not; the file's size tells which."""
    fs, inner = _open(path)
    size = fs.get_file_info(inner).size
    with fs.open_input_file(inner) as f:
        most, pages, rows = (int(x) for x in np.frombuffer(f.read(24), "<u8"))
    padded = size == 24 + 4 * pages * (1 + most)
    if not padded and size != 24 + 4 * (pages + rows):
        raise ValueError(f"{path} is no page layout of {pages} pages")
    step = 1 << 20
    jobs = spark.createDataFrame([(at, min(step, pages - at)) for at in range(0, pages, step)] if padded else [(0, pages)], "first long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name = _open(path)
        for batch in batches:
            for first, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_file(name) as f:
                    if padded:
                        table = np.frombuffer(f.read_at(4 * n * (1 + most), 24 + 4 * first * (1 + most)), "<u4").reshape(n, 1 + most)
                        counts = table[:, 0].astype(np.int64)
                        ids = table[:, 1:][np.arange(most)[None, :] < counts[:, None]]
                    else:
                        data = np.frombuffer(f.read_at(size - 24, 24), "<u4")
                        counts, at = np.empty(n, np.int64), 0
                        heads = np.empty(n, np.int64)
                        for i in range(n):
                            counts[i], heads[i] = data[at], at
                            at += 1 + int(data[at])
                        ids = np.delete(data, heads)
                owner = np.repeat(np.arange(n), counts)
                yield pa.RecordBatch.from_arrays([pa.array(first + owner), pa.array(np.arange(len(owner)) - np.searchsorted(owner, owner)), pa.array(ids.astype(np.int64))], ["page", "slot", "vec_id"])

    return jobs.mapInArrow(run, "page long, slot long, vec_id long")


def write_pages(pages: DataFrame, path: str, most: int) -> None:
    """A padded page layout file from (page, slot, vec_id); pages gapless from 0, at most `most` rows each.

    The file is one stream; pages come to the driver in order, a part at a time.
    """
    lists = pages.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("slot", "vec_id"))).alias("x")).select("page", F.transform("x", lambda r: r["vec_id"]).alias("ids"))
    sums = lists.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("rows"), F.max(F.size("ids")).alias("most"), F.max("page").alias("last")).first()
    if sums["n"] and (sums["most"] > most or sums["last"] != sums["n"] - 1):
        raise ValueError("pages must be gapless from 0 and hold no more than a page's rows")
    fs, inner = _open(path)
    with fs.open_output_stream(inner) as f:
        f.write(np.array([most, sums["n"], sums["rows"] or 0], "<u8").tobytes())
        for row in lists.orderBy("page").toLocalIterator():
            page = np.full(1 + most, NO_ROW, "<u4")
            page[0] = len(row["ids"])
            page[1 : 1 + len(row["ids"])] = row["ids"]
            f.write(page.tobytes())
