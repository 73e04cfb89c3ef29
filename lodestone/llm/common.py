"""Helpers that the operators of this subpackage share.

Words are runs of bytes other than 0x20 and 0x09-0x0D; ``bytes.split()``
splits a UTF-8 text at exactly these bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that one generation of a worker's table may hold.
TABLE_ENTRIES = 150_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only a local
    session that names none gets a temporary one, on a cluster that is an error."""
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(conf or "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: The folders of tables that ``written`` made, as long as their frames are held.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: Rows of numbers that a file of a table holds at least, once there are two files a core.
FILE_ROWS = 50_000


def written(df: DataFrame, name: str = "step", instead_of: Iterable[DataFrame] = (), rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    Tables of earlier calls that only df was made from can be named in instead_of;
    they are deleted once df is written. rows: about how many df has at most; its partitions
    are joined to as many files as they fill, for Hadoop's local files start two processes each.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[found] = path
    for old in instead_of:
        if folder := _FOLDERS.pop(old, None):
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return found


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand whole texts to Python in batches of at most so many rows, unless the session asks for another size.

    Spark's default of 10,000 rows is meant for numbers; of texts it is tens of
    megabytes on each side.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def lean_worker() -> None:
    """At the start of a task in a Python worker that earlier tasks have used: their
    tables go (they refer to themselves, so only the collector frees them), and freed
    memory returns to the system."""
    gc.unfreeze()
    gc.collect()
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(*frames: DataFrame, stem: str) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column) -> F.Column:
    """The UTF-8 bytes of a string column; null is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The XXH64 of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


class WordTable(dict):
    """word -> value, for the words of the batch at hand and those met lately.

    ``encode`` turns a list of new words into a list of values. At most two
    generations of ``entries`` words stay, beside the words of one batch.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], entries: int = TABLE_ENTRIES):
        self.encode, self.entries, self.older = encode, entries, {}

    def admit(self, texts: Iterable[Iterable[bytes]]) -> None:
        """Make sure that every word of these texts has its value."""
        new = set().union(*texts).difference(self)
        if len(self) + len(new) > self.entries and self:
            self.older = dict(self)
            self.clear()
            new = set().union(*texts)
        known = self.older
        fresh_words = []
        for word in new:
            value = known.get(word)
            if value is None:
                fresh_words.append(word)
            else:
                self[word] = value
        fresh_words.sort()
        self.update(zip(fresh_words, self.encode(fresh_words), strict=True))


ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and ODD**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for slot, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of so many words, from the hashes of the words."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * down[:n], dtype=np.uint64, out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * up[: n - width + 1])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0


def binaries(array: pa.Array) -> list[bytes]:
    """Python bytes of a binary Arrow array; null is empty."""
    return [x or b"" for x in array.to_pylist()]


def portions(texts: list[bytes], most: int = 2 << 20) -> Iterator[list[bytes]]:
    """The texts of a batch in runs of about so many bytes, each with one text at least."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def utf8(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())
