"""Recall with ties, percentiles by position, path and latency statistics, checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(n_queries, recall): truth counts as far as its distance equals the k-th; results are sets."""
    w = Window.partitionBy("qid").orderBy("dist")
    tied = truth.withColumn("r", F.rank().over(w)).where(F.col("r") <= k).select("qid", "vec_id")
    hits = results.where(F.col("rank") <= k).select("qid", "vec_id").distinct().join(tied, ["qid", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    asked = truth.agg(F.count_distinct("qid").alias("n_queries"))
    return asked.crossJoin(hits).select("n_queries", F.round(100.0 * F.col("hits") / (F.col("n_queries") * k), 6).alias("recall"))


def percentile(df: DataFrame, value: str, p: float, name: str, cuts: int = 128, held: int = 1_000_000) -> DataFrame:
    """The value at position floor(p * n) of the sorted values, without interpolation.

    Sketched cuts divide the values into ranges, which are counted exactly; the one
    that holds the position is divided again until it has at most `held` rows or
    cannot be divided, and only that range is sorted.
    """
    rows = df.select(F.col(value).alias("v")).where("v is not null")
    target = None
    while True:
        edges = sorted(set(rows.agg(F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 10 * cuts).alias("e")).first()["e"] or []))
        # below the first edge 0; at or above edge i, below the next, i + 1
        place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("v"))) if edges else F.lit(0)
        counts = {r["place"]: r["n"] for r in rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `cuts` rows
        target = math.floor(p * sum(counts.values())) if target is None else target
        chosen = None
        for at in sorted(counts):
            if counts[at] > target:
                chosen = at
                break
            target -= counts[at]
        if chosen is None:
            return rows.agg(F.max("v").alias(name))
        rows = rows.where(place == chosen)
        if counts[chosen] <= held or len(counts) == 1:
            break
    running = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("until", F.sum("n").over(Window.orderBy("v")))
    return running.where(F.col("until") > target).agg(F.min("v").alias(name))


def path_stats(df: DataFrame, path: str, value: str) -> DataFrame:
    return df.groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("avg_value"), F.max(value).alias("max_value"))


def share(condition: Column, name: str) -> Column:
    return F.round(100.0 * F.avg(condition.cast("double")), 6).alias(name)


def violations(results: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The results (qid, vec_id, ...) whose row does not carry what the query's expression asks for, or is not there.

    queries (qid, expression), rows (vec_id, labels, is_universal). Each pair of a
    result is judged by itself, a batch's distinct expressions once each.
    """
    from lodestone.functions import labels as label_functions

    joined = results.join(queries.select("qid", "expression"), "qid").join(rows.select("vec_id", "labels", "is_universal", F.lit(True).alias("there")), "vec_id", "left")

    @F.arrow_udf("boolean")
    def holds(expressions: pa.Array, labels: pa.Array, universal: pa.Array) -> pa.Array:
        texts = np.array(expressions.to_pylist(), object)
        found = np.zeros(len(texts), bool)
        for text in set(texts.tolist()):
            at = np.flatnonzero(texts == text)
            some = pa.array(at)
            found[at] = label_functions.arrow_rows_that_hold(text, labels.take(some), universal.take(some))
        return pa.array(found)

    good = F.col("there").isNotNull() & holds("expression", "labels", "is_universal")
    return joined.where(~good).select(*results.columns)


def incomplete(results: DataFrame, k: int) -> DataFrame:
    """Queries with fewer than k rows."""
    return results.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def integrity(vectors: DataFrame, graph: DataFrame) -> DataFrame:
    """Counts that must be zero: repeated ids, edges to rows that are missing, self-loops, odd dimensions."""
    edges = graph.select("vec_id", F.explode("nbrs").alias("nbr"))
    dims = vectors.agg((F.max(F.size("embedding")) - F.min(F.size("embedding"))).cast("long").alias("odd_dimensions"), (F.count("vec_id") - F.count_distinct("vec_id")).alias("repeated_ids"))
    dangling = edges.join(vectors.select(F.col("vec_id").alias("nbr")), "nbr", "left_anti").agg(F.count(F.lit(1)).alias("dangling_edges"))
    loops = edges.agg(F.coalesce(F.sum((F.col("vec_id") == F.col("nbr")).cast("long")), F.lit(0)).alias("self_loops"))
    return dims.crossJoin(dangling).crossJoin(loops)


def throughput(n: int, seconds: float) -> float:
    """Queries (or rows) a second; 0 without time."""
    return n / seconds if seconds > 0 else 0.0


def hit_ratios(results: DataFrame, inserted: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(n_queries, any_inserted, probe_hit): the shares of queries that return an inserted row, and
    their own probe (qid, vec_id), among results (qid, vec_id)."""
    marked = results.join(inserted.select("vec_id", F.lit(True).alias("new")).distinct(), "vec_id", "left")
    if probes is not None:
        marked = marked.join(probes.select("qid", F.col("vec_id").alias("probe")), "qid", "left")
    probe = F.max(F.coalesce(F.col("probe") == F.col("vec_id"), F.lit(False)).cast("int")) if probes is not None else F.lit(None).cast("int")
    each = marked.groupBy("qid").agg(F.max(F.coalesce("new", F.lit(False)).cast("int")).alias("new"), probe.alias("probe"))
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("new"), 6).alias("any_inserted"), F.round(F.avg("probe"), 6).alias("probe_hit"))


def success_rate(truth: DataFrame, k: int, n_queries: int) -> float:
    """The share of the queries that have k rows of truth."""
    return truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).count() / n_queries if n_queries else 0.0


def mismatches(stored: DataFrame, raw: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(vec_id, what): ids of one table only, and vectors that differ by more than a tolerance in some component."""
    a, b = stored.select("vec_id", F.col("embedding").alias("a")), raw.select("vec_id", F.col("embedding").alias("b"))
    joined = a.join(b, "vec_id", "full")
    differ = (F.size("a") != F.size("b")) | F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d.isNull() | (d > tolerance))
    what = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unknown").when(differ, "differs")
    return joined.select("vec_id", what.alias("what")).where("what is not null")
