"""Balanced label propagation over documents linked by equal texts.

A link joins documents of equal text. Links are never listed: the weight of a
shard for a document is the number of its group's documents there, so a group's
state is a row for each cell (group, bucket) and range of ranks in it.

1. The cells of linked documents are laid end to end, groups in the order of a hash,
   and the row is cut into equal lengths, one for each shard.
2. Rounds of joins: each cell asks for the shard that holds most of its group. A
   move is granted against a move the other way, or into room that the quota
   leaves (documents without links are placed last, so they leave room). Grants are
   in the order of a hash of the group, so that groups move whole; the cell at the
   border is split. A full shard is not asked for in every other round, so a group
   larger than a shard fills further ones.
3. Documents without links fill what is left of each quota.

The law is ``rows``: shards differ by one row at most. All counts that come to the
driver are bounded by the number of shards. Numbers are given within hash buckets
of about ``BUCKET`` rows and offset by the buckets before, so no task sorts a shard.

Defined results: a null text is the empty text, whose documents are linked as any
equal texts; repeated rows are documents of their own; null ids are placed like
others; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common

#: Rows of a bucket that is numbered by one task.
BUCKET = 50_000
#: Parts of the order in which moves are granted.
PARTS = 1024


def numbered(df: DataFrame, keys: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """df with a number more, gapless from 0 for each key, from a column ``bucket`` below buckets."""
    within = Window.partitionBy(*keys, "bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*keys, "bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = df.withColumn("__rank", F.row_number().over(within))
    return ranked.join(offsets, [*keys, "bucket"]).withColumn(name, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__before", "__rank")


def grants(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may move from shard to shard: swaps, then what fits into room."""
    given = {(i, j): min(n, demand.get((j, i), 0)) for (i, j), n in demand.items()}
    for j in range(len(room)):
        left = room[j]
        for i in range(len(room)):
            more = min(left, demand.get((i, j), 0) - given.get((i, j), 0))
            if more > 0:
                given[i, j] += more
                left -= more
    return {k: n for k, n in given.items() if n > 0}


def _round(state: DataFrame, quotas: list[int], turn: int) -> DataFrame | None:
    """The state after one round of moves; None if nothing moves."""
    spark = state.sparkSession
    size = (F.col("hi") - F.col("lo")).alias("size")
    mass = state.groupBy("g", "shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("w"))
    loads = {r["shard"]: r["w"] for r in mass.groupBy("shard").agg(F.sum("w").alias("w")).collect()}
    room = [q - loads.get(s, 0) for s, q in enumerate(quotas)]
    open_shards = [s for s, r in enumerate(room) if r > 0 or turn % 2]
    if not open_shards:
        return state if turn % 2 == 0 else None
    # at most one entry for each shard in a group's list
    rank = F.struct("w", F.xxhash64("g", "shard").alias("tie"), "shard")
    lists = mass.groupBy("g").agg(F.collect_list(rank).alias("all")).where(F.size("all") > 1)
    asked = state.join(lists, "g").select("g", "c", "lo", "hi", "shard", size, "all")
    own = F.filter("all", lambda x: x["shard"] == F.col("shard"))[0]
    better = F.filter("all", lambda x: x["shard"].isin(open_shards) & (F.struct(x["w"], x["tie"]) > F.struct(own["w"], own["tie"])))
    asked = asked.withColumn("target", F.array_max(better)["shard"]).where("target is not null")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(PARTS)).cast("int")).drop("all")
    asked = common.written(asked, "moves")
    parts = asked.groupBy("shard", "target", "part").agg(F.sum("size").alias("n")).collect()  # at most PARTS * shards**2 rows
    demand: dict[tuple[int, int], int] = {}
    by_pair: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in parts:
        pair = r["shard"], r["target"]
        demand[pair] = demand.get(pair, 0) + r["n"]
        by_pair.setdefault(pair, []).append((r["part"], r["n"]))
    given = grants(demand, room)
    if not given:
        return state if turn % 2 == 0 else None
    rows = []
    for pair, left in given.items():
        cut = PARTS
        for part, n in sorted(by_pair[pair]):
            if n > left:
                cut = part
                break
            left -= n
        rows.append((*pair, cut, left))
    allowed = F.broadcast(spark.createDataFrame(rows, "shard int, target int, cut int, rest long"))
    asked = asked.join(allowed, ["shard", "target"]).where("part <= cut")
    edge = Window.partitionBy("shard", "target").orderBy("g", "c", "lo").rowsBetween(Window.unboundedPreceding, -1)
    border = asked.where("part = cut").withColumn("moved", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.coalesce(F.sum("size").over(edge), F.lit(0)))))
    moved = asked.where("part < cut").withColumn("moved", F.col("size")).unionByName(border).where("moved > 0")
    key = ["g", "c", "lo"]
    after = state.join(moved.select(*key, "target", "moved"), key, "left")
    middle = F.col("lo") + F.coalesce("moved", F.lit(0))
    pieces = F.array(
        F.struct("lo", middle.alias("hi"), F.col("target").alias("shard")), F.struct(middle.alias("lo"), "hi", "shard")
    )
    return common.written(after.select("g", "c", F.explode(F.filter(pieces, lambda x: x["hi"] > x["lo"])).alias("x")).select("g", "c", "x.*"), "shards")


def _laid_out(linked: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Cells (g, c, lo, hi, shard): groups end to end, cut into equal lengths."""
    cells = linked.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"))
    sums = cells.groupBy("g").agg(F.sum("m").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = earlier(Window.partitionBy("bucket").orderBy("g"))
    before = earlier(Window.orderBy("bucket"))
    offsets = sums.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = sums.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, "bucket").select("g", (F.col("first") + F.col("inside")).alias("start"))
    among = F.coalesce(F.sum("m").over(earlier(Window.partitionBy("g").orderBy("c"))), F.lit(0))
    placed = cells.withColumn("among", among).join(starts, "g").withColumn("start", F.col("start") + F.col("among"))
    placed = common.written(placed.select("g", "c", "m", "start"), "cells")
    total = placed.agg(F.sum("m")).first()[0] or 0
    zero = F.lit(0).cast("long")
    borders = [s * total // shards for s in range(shards + 1)]
    pieces = F.array(*[
        F.struct(F.greatest(zero, F.lit(a) - F.col("start")).alias("lo"), F.least("m", F.lit(b) - F.col("start")).alias("hi"), F.lit(s).alias("shard"))
        for s, (a, b) in enumerate(zip(borders, borders[1:], strict=False))
    ])
    return common.written(placed.select("g", "c", F.explode(F.filter(pieces, lambda x: x["hi"] > x["lo"])).alias("x")).select("g", "c", "x.*"), "shards")


def assign(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text", rounds: int = 8) -> DataFrame:
    """One row for each document: id, size, text_crc32, group (SHA-256 of the text), shard, slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(id_column),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("g"),
    )
    base = common.written(base, "documents")
    total = base.count()
    buckets = max(1, math.ceil(total / BUCKET))
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    base = base.join(groups, "g", "left").withColumn("u", F.xxhash64(F.col(id_column).cast("string"), "g"))
    base = common.written(base.withColumn("bucket", F.pmod("u", F.lit(buckets)).cast("int")), "documents")
    order = ["u", id_column]
    rank = Window.partitionBy("g", "bucket").orderBy(*order)
    linked = common.written(base.where("n is not null").withColumn("rank", F.row_number().over(rank) - 1).withColumnRenamed("bucket", "c"), "linked")
    state = _laid_out(linked, shards, buckets)
    idle = 0
    for turn in range(rounds):
        after = _round(state, quotas, turn)
        idle = idle + 1 if after is None or after is state else 0
        if idle == 2 or after is None:
            break
        state = after
    loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    placed = linked.join(state, ["g", "c"]).where("lo <= rank and rank < hi").select(id_column, "size", "text_crc32", "g", "u", F.col("c").alias("bucket"), "shard")
    single = numbered(base.where("n is null"), [], order, buckets, "at")
    border, shard = 0, F.lit(shards - 1)
    borders = []
    for s, quota in enumerate(quotas):
        border += quota - loads.get(s, 0)
        borders.append(border)
    for s in reversed(range(shards)):
        shard = F.when(F.col("at") < borders[s], F.lit(s)).otherwise(shard)
    single = single.select(id_column, "size", "text_crc32", "g", "u", "bucket", shard.cast("int").alias("shard"))
    return numbered(placed.unionByName(single), ["shard"], order, buckets, "slot").drop("u", "bucket")
