"""Structured Streaming over update logs: each micro-batch folds into the next version of the state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.updates import Versions, latest

LOG = "seq bigint, op string, vec_id bigint, labels array<int>"


def fold_stream(log: DataFrame, folder: str, trigger: dict | None = None, fold_after: int = 16) -> Versions:
    """Run the stream (seq, op, vec_id, labels) to its end and leave the folded state in versions of ``state``.

    A micro-batch is folded by itself and appended to the state; after `fold_after`
    batches the state is folded again as a whole, so a batch does not rewrite it. The
    state keeps the last row of each id, removals too, so rows that come late or
    twice change nothing. A version carries the number of its micro-batch, and a batch
    that is repeated after a failure finds a version with its number and is
    skipped, whoever else writes versions of other tables to the folder.
    """
    spark = log.sparkSession
    versions = Versions(spark, folder)

    def one(batch: DataFrame, number: int) -> None:
        now = versions.snapshot()
        if now.batch >= number:
            return
        rows = latest(batch.select("seq", "op", "vec_id", "labels"))
        if number % fold_after or "state" not in now.names:
            versions.write({}, append={"state": rows}, batch=number)
        else:
            versions.write({"state": latest(rows.unionByName(now.read("state")))}, batch=number)

    query = log.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return versions


def append(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    """Add operations (seq, op, vec_id, labels) to a log that ``fold_stream`` or ``replay`` reads.

    Rows of an unknown operation are an error; they would be lost in the fold.
    """
    odd = rows.where(~F.coalesce(F.col("op").isin("INSERT", "REMOVE"), F.lit(False))).limit(1).collect()
    if odd:
        raise ValueError(f"no such operation: {odd[0]['op']!r}")
    rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LOG.split(", ")]).write.mode("append").parquet(folder)


def replay(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, labels) that are live after the whole log; an empty log has none."""
    try:
        log = spark.read.schema(LOG).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], LOG)
    return latest(log).where(F.col("op") == "INSERT").select("vec_id", "labels")


def live(versions: Versions, spark: SparkSession) -> DataFrame:
    now = versions.snapshot()
    if "state" not in now.names:
        return spark.createDataFrame([], "vec_id bigint, labels array<int>")
    return latest(now.read("state")).where(F.col("op") == "INSERT").select("vec_id", "labels")
