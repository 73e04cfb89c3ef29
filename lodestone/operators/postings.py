"""Label postings in layers: base, delta and tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, vec_id) of rows that are not universal, and (vec_id) of those that are; rows (vec_id, labels, is_universal)."""
    lists = rows.where(~F.col("is_universal")).select(F.explode("labels").alias("label"), "vec_id").distinct()
    return lists, rows.where("is_universal").select("vec_id").distinct()


def conjunction(wanted: list[int], base: DataFrame, delta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(vec_id) over three layers: rows that carry all the wanted labels in the base or the delta, or are
    universal in either, without tombstones. Without labels, the universal rows alone.

    base and delta: (vec_id, labels, is_universal). A row of both layers carries the
    labels of both, until a compaction lets the delta replace it. The label filter
    goes to each layer's scan; only ids are shuffled.
    """
    both = base.select("vec_id", "labels", "is_universal").unionByName(delta.select("vec_id", "labels", "is_universal"))
    wanted = sorted(set(wanted))
    held = F.array_intersect("labels", F.array(*[F.lit(x).cast("int") for x in wanted])) if wanted else F.array().cast("array<int>")
    some = both.withColumn("held", held).where(F.coalesce("is_universal", F.lit(False)) | (F.size("held") > 0))
    each = some.select("vec_id", "is_universal", F.explode_outer("held").alias("label"))
    found = each.groupBy("vec_id").agg(F.bool_or(F.coalesce("is_universal", F.lit(False))).alias("u"), F.count_distinct("label").alias("n"))
    whole = F.col("u") | (F.col("n") == len(wanted)) if wanted else F.col("u")
    return found.where(whole).select("vec_id").join(tombstones.select("vec_id").distinct(), "vec_id", "left_anti")


def sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("id_sum"))


def layered(base: DataFrame, delta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What is live: rows of the delta, and rows of the base that it does not replace, without tombstones."""
    kept = base.join(delta.select("vec_id"), "vec_id", "left_anti").unionByName(delta)
    return kept.join(tombstones.select("vec_id").distinct(), "vec_id", "left_anti")


def bitmaps(lists: DataFrame) -> DataFrame:
    """(label, bucket, bits): posting lists as bitmaps of fixed-size buckets, built in the JVM."""
    return lists.groupBy("label", F.bitmap_bucket_number("vec_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("vec_id")).alias("bits"))
