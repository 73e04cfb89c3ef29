"""A persisted index: built once into versions of a folder, then searched, added to, removed from and merged.

    index = Index.build(spark, folder, rows)        # vec_id, embedding and, if there are any, labels, is_universal, tag
    index.search(queries, 10, mode="beam")          # queries: qid, qv and, for filtered searches, expression
    index.insert(rows); index.remove(ids); index.merge()

Tables of a version: ``vectors``, ``graph`` (a packed row for each shard, codes inside),
``centers``, ``book``, ``meta``, and since the last merge ``delta`` (inserted rows) and
``deleted`` (ids), both with a sequence number, the last operation on an id wins. The
pointer to a version is written last, so a writer that stops leaves the version before.

A search joins the graph of the base, whose deleted and replaced rows lead on but are
not returned, with an exact scan of the delta: inserts and deletes are visible at once.
"""

from __future__ import annotations

import math
import time
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import clustering, graph, knn, metrics, quantizer, updates

#: What a version's metadata keeps beside the number of rows.
OPTIONS = ("metric", "degree", "size", "alpha", "most_rows", "overlap", "dimension", "chunks", "probes")
#: How the number of shards that a query goes to is measured: by so many rows and their nearest, of which so many must lie there.
PROBE_ROWS, PROBE_NEAREST, PROBE_SHARE = 256, 32, 0.995


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, updates.Versions(spark, folder)
        self._meta: tuple[tuple, dict, quantizer.Codebook, np.ndarray] | None = None

    # ---- building and loading -----------------------------------------------------

    @classmethod
    def build(
        cls, spark: SparkSession, folder: str, rows: DataFrame, metric: str = "l2", degree: int = 32, size: int = 64, alpha: float = 1.2, most_rows: int = 20_000, overlap: int = 2, chunks: int = 16,
        memory_limit: float | None = None,
    ) -> Index:
        """Normalise (for cosine), train the quantiser, build the shards' graphs, code them, write all, flip the pointer.

        memory_limit: bytes that one shard's build may take; bounds most_rows. With more
        than one shard each has two thirds of the degree, as their graphs overlap.
        """
        if metric not in V.METRICS:
            raise ValueError(f"metric is one of {', '.join(V.METRICS)}")
        index = cls(spark, folder)
        rows = knn.usable(index._shaped(rows, metric)).dropDuplicates(["vec_id"])
        stored = index.versions.stage("vectors", rows)
        rows = index.versions.staged(stored)
        n = rows.count()
        if not n:
            raise ValueError("no usable vector to build from")
        dimension = len(rows.select("embedding").first()["embedding"])
        if memory_limit:
            most_rows = max(1000, min(most_rows, int(memory_limit / clustering.memory_estimate(1, dimension, 8, degree))))
        shard_degree = 2 * (degree // 3) if n > most_rows else degree
        book = quantizer.train(rows, min(chunks, dimension))
        options = {"metric": metric, "degree": shard_degree, "size": size, "alpha": alpha, "most_rows": most_rows, "overlap": overlap, "dimension": dimension, "chunks": len(book.centers)}
        index._write(stored, book, options, n)
        return index

    def _shaped(self, rows: DataFrame, metric: str) -> DataFrame:
        """All columns of a row; the vector as the metric wants it. A zero vector stays as it is."""
        more = {}
        if "labels" not in rows.columns:
            more["labels"] = F.array().cast("array<int>")
        if "is_universal" not in rows.columns:
            more["is_universal"] = F.lit(False)
        if "tag" not in rows.columns:
            more["tag"] = F.col("vec_id")
        rows = rows.withColumns(more).select("vec_id", "embedding", F.col("labels").cast("array<int>"), F.coalesce("is_universal", F.lit(False)).alias("is_universal"), F.coalesce("tag", "vec_id").alias("tag"))
        if metric == "cosine":
            norm = F.sqrt(V.squared_norm(F.col("embedding")))
            rows = rows.withColumn("embedding", F.when(norm > 0, F.transform("embedding", lambda x: x.cast("double") / norm)).otherwise(V.doubles(F.col("embedding"))))
        return rows

    def _write(self, stored: str, book: quantizer.Codebook, options: dict, n: int) -> int:
        """Build the graph over staged vectors; all tables become the next version at once."""
        packed, centers = graph.build_packed(self.versions.staged(stored), options["degree"], options["size"], options["alpha"], options["most_rows"], options["overlap"])
        options = options | {"probes": self._probes(self.versions.staged(stored), centers, options["overlap"])}
        tables = {"vectors": stored, "graph": graph.with_codes(packed, book), "book": quantizer.book_table(self.spark, book), "centers": self._centers(centers)}
        return self.versions.write(tables | {"meta": self._meta_row(options, n)}, drop=["delta", "deleted"])

    def _probes(self, rows: DataFrame, centers: np.ndarray, overlap: int) -> int:
        """How many shards of the nearest centers hold the nearest rows of a row: measured by the exact search of some rows."""
        if len(centers) <= overlap:
            return len(centers)
        rows = rows.select("vec_id", "embedding")
        some = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(PROBE_ROWS).toArrow()
        queries = self.spark.createDataFrame(some).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
        near = knn.exact_knn(queries, rows, PROBE_NEAREST, skip_self=True).select("qid", "vec_id")
        held = clustering.placed(near.join(rows, "vec_id"), centers, overlap).select("qid", "vec_id", "shard").toArrow()
        if not len(held):
            return len(centers)
        x = knn.matrix(some["embedding"])
        rank = np.argsort(np.argsort(clustering.distances(x, centers), 1, kind="stable"), 1)
        at = {q: n for n, q in enumerate(some["vec_id"].to_pylist())}
        row = np.array([at[q] for q in held["qid"].to_pylist()])
        # a row of several shards is met in the first of them
        pairs = np.unique(np.stack([row, held["vec_id"].to_numpy()], 1), axis=0, return_inverse=True)[1].ravel()
        first = np.full(pairs.max() + 1, len(centers))
        np.minimum.at(first, pairs, rank[row, held["shard"].to_numpy()])
        return int(np.sort(first)[min(len(first) - 1, math.ceil(PROBE_SHARE * len(first)) - 1)]) + 1

    def _centers(self, centers: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "shard int, center array<double>").coalesce(1)

    def _meta_row(self, options: dict, n: int) -> DataFrame:
        kinds = {int: "long", float: "double", str: "string"}
        row = options | {"rows": n}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())).coalesce(1)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        """An index that was written before; an error if its tables do not fit together."""
        index = cls(spark, folder)
        wrong = [r for r in index.check().collect() if r["found"] != r["expected"]]
        if wrong:
            raise ValueError("; ".join(f"{r['what']}: {r['found']} instead of {r['expected']}" for r in wrong))
        return index

    def check(self) -> DataFrame:
        """(what, expected, found): rows, shards, dimension and chunks by the metadata and by the tables."""
        now, meta, book, centers = self._state()
        vectors = now.read("vectors").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        packed = now.read("graph")
        nodes = packed.select((F.octet_length("ids") / 8).cast("long").alias("n"), (F.octet_length("codes") / (2 * F.col("n"))).cast("long").alias("chunks"), F.col("n").alias("said"), "dimension")
        shards = nodes.agg(F.count(F.lit(1)).alias("shards"), F.sum((F.col("n") != F.col("said")).cast("long")).alias("odd"), F.max("chunks").alias("chunks"), F.max("dimension").alias("dimension")).first()
        held = graph.unpacked(packed).agg(F.count_distinct("vec_id").alias("n")).first()["n"]
        found = [
            ("rows of vectors", meta["rows"], vectors["n"]), ("distinct ids", meta["rows"], vectors["ids"]), ("ids of the graph", meta["rows"], held), ("shards of odd size", 0, shards["odd"] or 0),
            ("least length of a vector", meta["dimension"], vectors["low"]), ("largest length of a vector", meta["dimension"], vectors["high"]), ("dimension of the graph", meta["dimension"], shards["dimension"]),
            ("chunks of the codes", meta["chunks"], shards["chunks"]), ("chunks of the codebook", meta["chunks"], len(book.centers)), ("dimension of the codebook", meta["dimension"], len(book.mean)),
        ]
        if len(centers) < (shards["shards"] or 0):
            found.append(("centers", shards["shards"], len(centers)))
        return self.spark.createDataFrame([(a, int(b), int(c or 0)) for a, b, c in found], "what string, expected long, found long")

    def _state(self) -> tuple[updates.Snapshot, dict, quantizer.Codebook, np.ndarray]:
        """The current version, its metadata, codebook and centers; what did not change is not read again."""
        now = self.versions.snapshot()
        if now.version is None:
            raise ValueError("there is no index in this folder")
        key = tuple(p for p in now.places if p[0] in ("meta", "book", "centers"))
        if self._meta is None or self._meta[0] != key:
            rows = sorted(now.read("centers").collect())  # one row for each shard
            self._meta = key, now.read("meta").first().asDict(), quantizer.read_book(now.read("book")), np.array([r["center"] for r in rows])
        return now, *self._meta[1:]

    def book(self) -> quantizer.Codebook:
        return self._state()[2]

    def metric(self) -> str:
        return self._state()[1]["metric"]

    # ---- reading ------------------------------------------------------------------

    def _changes(self, now: updates.Snapshot) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows inserted since the merge that are live, ids of the base that are deleted or replaced)."""
        delta = now.read("delta") if "delta" in now.names else None
        deleted = now.read("deleted") if "deleted" in now.names else None
        live, stale = None, []
        if delta is not None:
            last = updates.latest(delta)
            if deleted is not None:
                gone = deleted.groupBy("vec_id").agg(F.max("seq").alias("gone"))
                last = last.join(gone, "vec_id", "left").where("gone is null or gone < seq").drop("gone")
            live = last.drop("seq")
            stale.append(delta.select("vec_id"))
        if deleted is not None:
            stale.append(deleted.select("vec_id"))
        return live, reduce(DataFrame.unionByName, stale).distinct() if stale else None

    def rows(self, now: updates.Snapshot | None = None) -> DataFrame:
        """What is live: vec_id, embedding, labels, is_universal, tag."""
        now = now or self.versions.snapshot()
        live, stale = self._changes(now)
        base = now.read("vectors")
        if stale is not None:
            base = base.join(stale, "vec_id", "left_anti")
        return base if live is None else base.unionByName(live)

    def get(self, ids: DataFrame, by: str = "vec_id") -> DataFrame:
        """ids (vec_id, or tag) with the columns of their rows; nulls where there is no live row."""
        return ids.join(self.rows(), by, "left")

    def search(
        self, queries: DataFrame, k: int, mode: str = "beam", size: int = 64, width: int = 4, probes: int | None = None, tags: bool = False, vectors: bool = False, dynamic: bool = True, use_codes: bool = True, **options,
    ) -> DataFrame:
        """(qid, rank, vec_id, dist) and, if asked for, tag and embedding: the graph of the base and the delta together.

        queries: qid, qv, and expression for a filtered search. mode, size, width and
        further options as in ``graph.search``; dist is squared L2, for an index
        of the cosine metric the cosine distance. A query goes to the shards of the `probes`
        nearest centers, by default as many as the build measured to hold its nearest rows; a filtered
        one, or one for more rows than were measured, to all. Without dynamic, lists do not grow past
        deleted rows, which are filtered out of the result.
        """
        if mode not in graph.MODES:
            raise ValueError(f"mode is one of {', '.join(graph.MODES)}")
        now, meta, book, centers = self._state()
        if meta["metric"] == "cosine":
            norm = F.sqrt(V.squared_norm(F.col("qv")))
            queries = queries.withColumn("qv", F.when(norm > 0, F.transform("qv", lambda x: x.cast("double") / norm)).otherwise(V.doubles(F.col("qv"))))
        live, stale = self._changes(now)
        packed = now.read("graph")
        if probes is None:
            probes = len(centers) if "expression" in queries.columns or k > PROBE_NEAREST else meta.get("probes", len(centers))
        shared = {"mode": mode, "size": size, "width": width, "book": book if use_codes else None, "centers": centers, "probes": probes, **options}
        if stale is not None and not dynamic:
            found = graph.search(packed, queries, max(k, size), **shared).join(stale, "vec_id", "left_anti")
        else:
            found = graph.search(packed, queries, k, excluded=stale, **shared)
        found = found.select("qid", "vec_id", "dist")
        if live is not None:
            found = found.unionByName(knn.exact_knn(queries, live, k).select("qid", "vec_id", "dist"))
        found = knn.top(found, k).select("qid", "rank", "vec_id", "dist")
        if meta["metric"] == "cosine":
            found = found.withColumn("dist", F.col("dist") / 2)
        if tags or vectors:
            wanted = ["vec_id", *(["tag"] if tags else []), *(["embedding"] if vectors else [])]
            found = found.join(self.rows(now).select(*wanted), "vec_id", "left")
        return found

    def status(self) -> dict[str, int]:
        """Version, rows of the base, inserted and deleted since the merge, live rows."""
        now, meta, _, centers = self._state()
        live, stale = self._changes(now)
        base = now.read("vectors")
        gone = base.join(stale, "vec_id", "left_semi").count() if stale is not None else 0
        new = live.count() if live is not None else 0
        return {"version": now.version, "base": meta["rows"], "shards": len(centers), "inserted": new, "stale": gone, "live": meta["rows"] - gone + new}

    # ---- changing -----------------------------------------------------------------

    def _next(self, now: updates.Snapshot) -> int:
        last = [now.read(n).agg(F.max("seq")).first()[0] for n in ("delta", "deleted") if n in now.names]
        return max([x for x in last if x is not None], default=0) + 1

    def insert(self, rows: DataFrame) -> int:
        """Add rows, in place of live ones of the same id; the new version. Of repeated ids in rows one stays.

        A vector that the index cannot hold (null, of another length, not finite) is an error.
        """
        now, meta, _, _ = self._state()
        rows = self._shaped(rows, meta["metric"]).dropDuplicates(["vec_id"])
        fit = knn.usable(rows, meta["dimension"])
        odd = rows.select("vec_id").join(fit.select("vec_id"), "vec_id", "left_anti").limit(1).collect()
        if odd:
            raise ValueError(f"row {odd[0]['vec_id']} has no usable vector")
        return self.versions.write({}, append={"delta": rows.withColumn("seq", F.lit(self._next(now)).cast("long"))})

    def remove(self, ids: DataFrame) -> DataFrame:
        """Delete rows by id, lazily: the ids that were not live."""
        now = self.versions.snapshot()
        ids, seq = ids.select("vec_id").distinct(), self._next(now)
        known = ids.join(self.rows(now).select("vec_id"), "vec_id", "left_semi").withColumn("seq", F.lit(seq).cast("long"))
        self.versions.write({}, append={"deleted": known})
        return ids.join(self.versions.read("deleted").where(F.col("seq") == seq), "vec_id", "left_anti")

    def remove_random(self, share: float, scope: str = "all", seed: int = 0) -> int:
        """Delete so large a share of the live rows, of the base or of what was inserted; how many went."""
        if scope not in ("all", "base", "inserted"):
            raise ValueError("scope is all, base or inserted")
        now = self.versions.snapshot()
        live, stale = self._changes(now)
        base = now.read("vectors").select("vec_id")
        base = base.join(stale, "vec_id", "left_anti") if stale is not None else base
        new = live.select("vec_id") if live is not None else base.limit(0)
        rows = base if scope == "base" else new if scope == "inserted" else base.unionByName(new)
        n = math.floor(share * rows.count())
        self.remove(rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n))
        return n

    def merge(self) -> int:
        """The next version: deleted rows leave, inserted rows are linked in, shard by shard.

        In a shard a link to a row that left gives way to that row's own links, and what
        changed is pruned again. A shard that has outgrown the bound makes a new
        partition of all shards.
        """
        now, meta, book, centers = self._state()
        live, stale = self._changes(now)
        if stale is None:
            return now.version
        options = {k: meta[k] for k in OPTIONS if k in meta}
        stored = self.versions.stage("vectors", self.rows(now))
        rows = self.versions.staged(stored)
        n = rows.count()
        if not n:
            raise ValueError("no row would be left")
        packed = graph.with_hidden(now.read("graph"), stale)
        new = live if live is not None else now.read("vectors").limit(0)
        placed, _ = clustering.partition(new, options["most_rows"], options["overlap"], centers=centers)
        merged = graph.with_codes(graph.merge_shards(packed, placed, options["degree"], options["size"], options["alpha"]), book)
        linked = self.versions.stage("graph", merged)
        if (self.versions.staged(linked).agg(F.max("n")).first()[0] or 0) > 2 * options["most_rows"]:
            return self._write(stored, book, options, n)
        options["probes"] = self._probes(rows, centers, options["overlap"])
        return self.versions.write({"vectors": stored, "graph": linked, "meta": self._meta_row(options, n)}, drop=["delta", "deleted"])

    def rebuild(self) -> int:
        """A new graph over the live rows, quantiser as it is: the next version."""
        now, meta, book, _ = self._state()
        stored = self.versions.stage("vectors", self.rows(now))
        return self._write(stored, book, {k: meta[k] for k in OPTIONS if k in meta}, self.versions.staged(stored).count())


def replay(index: Index, steps: list[tuple], k: int = 10, **options) -> DataFrame:
    """Run steps in order: ("insert", rows), ("remove", ids), ("merge",), ("search", queries).

    (step, what, n, seconds, per_second, recall): recall of a search against the exact
    search of what is live then, null for other steps.
    """
    found = []
    for number, (what, *given) in enumerate(steps):
        began, recall, n = time.perf_counter(), None, 0
        if what == "insert":
            n = given[0].count()
            index.insert(given[0])
        elif what == "remove":
            n = given[0].count()
            index.remove(given[0])
        elif what == "merge":
            n = index.merge()
        elif what == "search":
            rows = index.spark.createDataFrame(index.search(given[0], k, **options).toArrow())
            n = given[0].count()
        else:
            raise ValueError(f"unknown step {what!r}")
        seconds = time.perf_counter() - began
        if what == "search":
            live = index.rows()
            recall = metrics.recall(rows, knn.exact_knn(given[0], live, k, index.metric()), k).first()["recall"]
        found.append((number, what, n, seconds, metrics.throughput(n, seconds), recall))
    return index.spark.createDataFrame(found, "step int, what string, n long, seconds double, per_second double, recall double")


class Service:
    """Text commands over an index: one line in, one line out."""

    HELP = "HELP STATUS STATS INSERT_RANDOM n | INSERT_ROWS a,b,... | DELETE_BASE_RANDOM n | DELETE_INSERTED n | SEARCH_ROW row k [size] [width] | SEARCH_TAG tag k [size] [width] | SEARCH_RANDOM n k [size] [width] | MERGE | QUIT"

    def __init__(self, index: Index, source: DataFrame, first_new: int | None = None, seed: int = 0):
        """source (vec_id, embedding, ...): the rows that commands name; inserted copies get new ids from first_new on."""
        self.index, self.source, self.seed = index, source, seed
        self.next = first_new if first_new is not None else (source.agg(F.max("vec_id")).first()[0] or 0) + 1
        self.first = self.next
        self.closed = False
        self.done: dict[str, list[float]] = {}

    def execute(self, line: str) -> str:
        words = line.split()
        if not words:
            return "ERR empty command"
        verb, *rest = words
        method = getattr(self, f"_{verb.lower()}", None)
        if verb != verb.upper() or method is None:
            return "ERR unknown command"
        try:
            numbers = [[int(x) for x in w.split(",")] for w in rest]
            if any(n < 0 for w in numbers for n in w):
                raise ValueError
        except ValueError:
            return f"ERR usage: {self.HELP}"
        began = time.perf_counter()
        try:
            answer = method(*numbers)
        except (TypeError, IndexError):
            return f"ERR usage: {self.HELP}"
        except ValueError as wrong:
            return f"ERR {wrong}"
        self.done.setdefault(verb, []).append(time.perf_counter() - began)
        return f"OK {answer}"

    def _help(self) -> str:
        return self.HELP

    def _quit(self) -> str:
        self.closed = True
        return "bye"

    def _status(self) -> str:
        return " ".join(f"{k}={v}" for k, v in self.index.status().items())

    def _stats(self) -> str:
        """Calls, and milliseconds a call on average, of each command so far."""
        return " ".join(f"{k}={len(v)}:{1000 * sum(v) / len(v):.0f}ms" for k, v in sorted(self.done.items())) or "none"

    def _add(self, picked: DataFrame) -> str:
        """picked (slot, vec_id): rows of the source, each a new row."""
        slots = picked.join(self.source, "vec_id").orderBy("slot", "vec_id").toArrow()
        if not len(slots):
            return "inserted=0"
        ids = pa.array(np.arange(self.next, self.next + len(slots)))
        rows = slots.drop_columns(["slot"]).set_column(slots.drop_columns(["slot"]).column_names.index("vec_id"), "vec_id", ids)
        if "tag" in rows.column_names:
            rows = rows.set_column(rows.column_names.index("tag"), "tag", ids)
        self.index.insert(self.index.spark.createDataFrame(rows))
        self.next += len(slots)
        return f"inserted={len(slots)} first={self.next - len(slots)}"

    def _insert_random(self, n: list[int]) -> str:
        self.seed += 1
        ids = self.source.select("vec_id").orderBy(F.xxhash64("vec_id", F.lit(self.seed)), "vec_id").limit(n[0]).toArrow()["vec_id"].to_pylist()
        if not ids:
            raise ValueError("no rows to sample")
        picked = [(i, ids[i % len(ids)]) for i in range(n[0])]  # with repeats where there are too few
        return self._add(self.index.spark.createDataFrame(picked, "slot long, vec_id long"))

    def _insert_rows(self, rows: list[int]) -> str:
        return self._add(self.index.spark.createDataFrame(list(enumerate(rows)), "slot long, vec_id long"))

    def _remove(self, rows: DataFrame, n: int) -> str:
        self.seed += 1
        picked = rows.select("vec_id").orderBy(F.xxhash64("vec_id", F.lit(self.seed)), "vec_id").limit(n).toArrow()
        if len(picked) < n:
            raise ValueError("not enough rows to delete")
        self.index.remove(self.index.spark.createDataFrame(picked))
        return f"deleted={len(picked)}"

    def _delete_base_random(self, n: list[int]) -> str:
        return self._remove(self.index.rows().where(F.col("vec_id") < self.first), n[0])

    def _delete_inserted(self, n: list[int]) -> str:
        return self._remove(self.index.rows().where(F.col("vec_id") >= self.first), n[0])

    def _found(self, queries: DataFrame, k: int, size: list[int], width: list[int]) -> str:
        rows = self.index.search(queries, k, size=max(size[0], k), width=width[0], tags=True).orderBy("qid", "rank").collect()
        return " ".join(f"{r['qid']}:{r['tag']}:{r['dist']:.6g}" for r in rows) or "none"

    def _search_row(self, row: list[int], k: list[int], size: list[int] = [100], width: list[int] = [4]) -> str:  # noqa: B006
        return self._found(self.source.where(F.col("vec_id") == row[0]).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), k[0], size, width)

    def _search_tag(self, tag: list[int], k: list[int], size: list[int] = [100], width: list[int] = [4]) -> str:  # noqa: B006
        return self._found(self.index.rows().where(F.col("tag") == tag[0]).select(F.col("tag").alias("qid"), F.col("embedding").alias("qv")), k[0], size, width)

    def _search_random(self, n: list[int], k: list[int], size: list[int] = [100], width: list[int] = [4]) -> str:  # noqa: B006
        self.seed += 1
        picked = self.source.orderBy(F.xxhash64("vec_id", F.lit(self.seed)), "vec_id").limit(n[0])
        return self._found(picked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), k[0], size, width)

    def _merge(self) -> str:
        return f"version={self.index.merge()}"
