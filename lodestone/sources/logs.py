"""What search logs tell: completeness of filtered results, and series of throughput, latency and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.vecfiles import numbered_lines

# The wording of the log lines.
_QUERY = r"\[Debug (IVF|Graph) Path\] Query ID:\s+(\d+)"
_TOTAL = r"- Total Results:\s+(\d+)\s+/\s+(\d+)\s+\(all satisfy tag constraints\)"
_SHORT = r"\[(IVF|Graph) Path Warning\] Query\s+(\d+):\s+Insufficient tag-constrained vectors \((\d+)\s+<\s+(\d+)\)"


def _group(pattern: str, n: int, kind: str = "long") -> F.Column:
    return F.nullif(F.regexp_extract("line", pattern, n), F.lit("")).cast(kind)


def completeness(spark: SparkSession, path: str) -> DataFrame:
    """(qid, path, found, wanted, warned): the results of each query in a log, the last if it is there twice.

    A line of results belongs to the query that was named last before it; results before
    any query are of none. Warnings name their query themselves.
    """
    lines = numbered_lines(spark, path).select(
        "number", _group(_QUERY, 2).alias("query"), _group(_QUERY, 1, "string").alias("query_path"), _group(_TOTAL, 1).alias("found"), _group(_TOTAL, 2).alias("wanted"),
        _group(_SHORT, 2).alias("short"), _group(_SHORT, 1, "string").alias("short_path"), _group(_SHORT, 3).alias("short_found"), _group(_SHORT, 4).alias("short_wanted"),
    )
    kept = lines.where("query is not null or found is not null or short is not null")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)  # one log is one run of lines
    totals = kept.withColumns({"qid": F.last("query", True).over(before), "path": F.last("query_path", True).over(before)}).where("found is not null and qid is not null")
    totals = totals.groupBy("qid").agg(F.max_by(F.struct("path", "found", "wanted"), "number").alias("t"))
    warned = kept.where("short is not null").groupBy(F.col("short").alias("qid")).agg(F.max_by(F.struct("short_path", "short_found", "short_wanted"), "number").alias("w"))
    joined = totals.join(warned, "qid", "full")
    return joined.select(
        "qid", F.coalesce("t.path", "w.short_path").alias("path"), F.coalesce("t.found", "w.short_found").alias("found"), F.coalesce("t.wanted", "w.short_wanted").alias("wanted"), F.col("w").isNotNull().alias("warned")
    )


def series(spark: SparkSession, path: str) -> DataFrame:
    """(number, size, qps, p50, p90, p99, recall, pages) of each line of ten figures, and the time that was named last before it.

    Recall is a share; it is null where the run had no truth (a recall of 0 in the log).
    """
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    lines = numbered_lines(spark, path).select("number", numbers.alias("x"), _group(r"search current time:\s*([0-9.eE+-]+)", 1, "double").alias("time"))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.where((F.col("time").isNotNull()) | ((F.size("x") == 10) & F.forall("x", lambda v: v.isNotNull())))
    rows = kept.withColumn("at", F.last("time", True).over(before)).where("time is null")
    x = F.col("x")
    return rows.select(
        "number", "at", x[0].cast("long").alias("size"), x[1].alias("qps"), x[3].alias("p50"), x[4].alias("p90"), x[6].alias("p99"), F.when(x[8] != 0, x[8] / 100).alias("recall"), x[9].alias("pages")
    )
