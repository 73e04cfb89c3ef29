"""Update logs, upserts, tombstones, merges and versioned tables.

The last operation on an id wins, in the order of the log's sequence number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph as graphs
from lodestone.operators import knn


def latest(log: DataFrame, key: str = "vec_id", order: str = "seq") -> DataFrame:
    """The last row of each key: an aggregate, so a hot key is folded before the shuffle."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in rest])


def fold(log: DataFrame) -> DataFrame:
    """(vec_id, labels) that are live after the log (seq, op, vec_id, labels)."""
    return latest(log).where(F.col("op") == "INSERT").select("vec_id", "labels")


def fold_merging(log: DataFrame) -> DataFrame:
    """As fold, but labels of inserts since the last removal add up."""
    removed = log.where(F.col("op") == "REMOVE").groupBy("vec_id").agg(F.max("seq").alias("gone"))
    since = log.where(F.col("op") == "INSERT").join(removed, "vec_id", "left").where("gone is null or seq > gone")
    return since.select("vec_id", F.explode("labels").alias("l")).distinct().groupBy("vec_id").agg(F.array_sort(F.collect_list("l")).alias("labels"))


def delete(live: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, tags that were not there)."""
    return live.join(tags, "vec_id", "left_anti"), tags.join(live.select("vec_id"), "vec_id", "left_anti")


def sampled_ids(spark: SparkSession, first: int, end: int, n: int, seed: int = 0) -> DataFrame:
    """(vec_id): n distinct ids of [first, end), those that come first by a seeded hash; an error if there are fewer."""
    if end - first < n:
        raise ValueError("not enough ids to sample")
    # a hash below this bound holds more than n ids almost surely; else all are ordered
    ids = spark.range(first, end).select(F.col("id").alias("vec_id"))
    share = min(1.0, (n + 10 * n**0.5 + 50) / max(end - first, 1))
    hashed = ids.withColumn("h", F.xxhash64("vec_id", F.lit(seed)))
    few = hashed.where(F.col("h") < F.lit(int(-(2**63) + share * (2**64 - 1024)))) if share < 1 else hashed
    picked = few.orderBy("h", "vec_id").limit(n).select("vec_id")
    return picked if share == 1 or picked.count() == n else hashed.orderBy("h", "vec_id").limit(n).select("vec_id")


def rows_to_insert(spark: SparkSession, total: int, n: int, seed: int = 0) -> DataFrame:
    """(slot, vec_id): n rows of [0, total), distinct if there are so many, else with repeats."""
    if total <= 0:
        raise ValueError("no rows to sample")
    if total >= n:
        ids = sampled_ids(spark, 0, total, n, seed)
        return ids.select(F.monotonically_increasing_id().alias("slot"), "vec_id")
    return spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("vec_id"))


def bernoulli(rows: DataFrame, rate: float, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """A share of the rows, picked by a hash of the key, and at least one of a table that is not empty."""
    bound = int(-(2**63) + min(max(rate, 0.0), 1.0) * (2**64 - 1024))
    h = F.xxhash64(key, F.lit(seed))
    picked = rows.where(h < F.lit(bound)) if rate < 1 else rows
    if not picked.isEmpty():
        return picked
    return rows.orderBy(h, key).limit(1)


def merge(base: DataFrame, graph: DataFrame, delta: DataFrame, deleted: DataFrame, degree: int = 32, alpha: float = 1.2, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The next version's vectors and graph: tombstones leave, edges are repaired, new rows are linked.

    New rows get their `2 * degree` nearest by exact search as candidates, and are
    candidates of these; the nodes whose edges changed are pruned again, so that a kept
    neighbour covers what lies near it and long edges stay. No node keeps more than
    `degree` edges; a node that nothing touched keeps its edges as they are.
    """
    gone = deleted.select("vec_id").distinct()
    vectors = base.join(delta.select("vec_id"), "vec_id", "left_anti").unionByName(delta).join(gone, "vec_id", "left_anti")
    stale = gone.unionByName(delta.select("vec_id")).distinct()
    lists = graph.select("vec_id", "nbrs")
    kept = graphs.repaired(lists, stale, sample)
    near = knn.exact_knn(delta.join(gone, "vec_id", "left_anti").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), vectors, 2 * degree, skip_self=True)
    forth = near.select(F.col("qid").alias("vec_id"), F.col("vec_id").alias("nbr"))
    more = forth.unionByName(forth.select(F.col("nbr").alias("vec_id"), F.col("vec_id").alias("nbr")))
    before = lists.select("vec_id", F.array_sort("nbrs").alias("before"))
    changed = kept.join(before, "vec_id").where(F.col("before") != F.array_sort("nbrs")).select("vec_id").unionByName(more.select("vec_id")).distinct()
    edges = kept.select("vec_id", F.explode("nbrs").alias("nbr")).unionByName(more).join(changed, "vec_id", "left_semi")
    lists = graphs.pruned(edges, vectors, degree, alpha).unionByName(kept.join(changed, "vec_id", "left_anti"))
    whole = vectors.select("vec_id").join(lists, "vec_id", "left").select("vec_id", F.slice(F.coalesce("nbrs", F.array().cast("array<bigint>")), 1, degree).alias("nbrs"))
    return vectors, whole


@dataclass(frozen=True)
class Snapshot:
    """What one version holds: its tables stay readable whatever is written later."""

    spark: SparkSession
    folder: str
    version: int | None = None
    batch: int = -1
    places: tuple[tuple[str, str], ...] = ()

    @property
    def names(self) -> set[str]:
        return {name for name, _ in self.places}

    def read(self, name: str) -> DataFrame:
        paths = [f"{self.folder}/{path}" for n, path in self.places if n == name]
        if not paths:
            raise ValueError(f"no table {name} in version {self.version}")
        return self.spark.read.parquet(*paths)


class Versions:
    """Versioned tables in one folder: tables are immutable directories, a pointer names those of the current version.

    Everything goes through Spark's file sources, so the folder can lie in any store.
    The pointer is a table that is appended to with one row for each version, last of
    all, and its highest version counts: a writer that stops before leaves the version
    before. A table may have several directories, those that were appended.
    """

    POINTER = "version long, batch long, tables array<struct<name: string, path: string>>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The current version, or a given one; empty if there is none."""
        try:
            rows = self.spark.read.schema(self.POINTER).parquet(f"{self.folder}/current")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return Snapshot(self.spark, self.folder)
        rows = rows if version is None else rows.where(F.col("version") == version)
        last = rows.agg(F.max_by(F.struct("version", "batch", "tables"), "version").alias("x")).first()["x"]
        if last is None:
            return Snapshot(self.spark, self.folder)
        return Snapshot(self.spark, self.folder, last["version"], last["batch"], tuple((t["name"], t["path"]) for t in last["tables"]))

    def current(self) -> int | None:
        return self.snapshot().version

    def batch(self) -> int:
        """The highest number that a write was given; -1 if none was."""
        return self.snapshot().batch

    def names(self) -> set[str]:
        return self.snapshot().names

    def stage(self, name: str, df: DataFrame) -> str:
        """Write a table that no version names yet; its path, for ``staged`` and ``write``."""
        path = f"t-{uuid.uuid4().hex}/{name}"
        df.write.parquet(f"{self.folder}/{path}")
        return path

    def staged(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{path}")

    def write(self, tables: dict[str, DataFrame | str], append: dict[str, DataFrame | str] | None = None, drop: Iterable[str] = (), batch: int | None = None) -> int:
        """The next version: tables (or what was staged) replace those of their name, append adds to them, drop leaves them out; others stay.

        batch is remembered by this version and those after it.
        """
        new = [(name, df if isinstance(df, str) else self.stage(name, df)) for name, df in [*tables.items(), *(append or {}).items()]]
        before = self.snapshot()
        gone = {*tables, *drop}
        places = [(n, p) for n, p in before.places if n not in gone] + new
        version = (before.version or 0) + 1
        row = (version, max(before.batch, -1 if batch is None else batch), places)
        self.spark.createDataFrame([row], self.POINTER).coalesce(1).write.mode("append").parquet(f"{self.folder}/current")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.snapshot(version).read(name)
