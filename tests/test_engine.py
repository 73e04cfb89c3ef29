"""Label expressions, layers, logs, versions, streams, kernels and files."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import labels as L
from lodestone.functions import vectors as V
from lodestone.operators import graph, knn, metrics, postings, quantizer, updates
from lodestone.sources import vecfiles
from lodestone.streaming import ingest

ROWS = [(0, [1, 2], False), (1, [2, 3], False), (2, [11], True), (3, [1, 2, 3], False)]
SCHEMA = "vec_id long, labels array<int>, is_universal boolean"


def ids(df):
    return sorted(r["vec_id"] for r in df.collect())


def held(df, wanted):
    return ids(df.where(L.conjunction(wanted, F.col("labels"), F.col("is_universal"))))


def test_layers_scenario(spark):
    base = spark.createDataFrame(ROWS, SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    gone = spark.createDataFrame([], "vec_id long")
    assert held(postings.layered(base, none, gone), [1, 2]) == [0, 2, 3]
    delta = spark.createDataFrame([(100, [1, 2], False), (101, [11], True)], SCHEMA)
    assert held(postings.layered(base, delta, gone), [1, 2]) == [0, 2, 3, 100, 101]
    gone = spark.createDataFrame([(0,), (2,)], "vec_id long")
    live = postings.layered(base, delta, gone)
    assert held(live, [1, 2]) == [3, 100, 101]
    assert held(live, []) == [101]


def test_log_scenario_and_restart(spark, tmp_path):
    log = spark.createDataFrame([(0, "INSERT", 0, [1, 2]), (1, "INSERT", 888, [1, 2]), (2, "INSERT", 999, [1, 2, 3]), (3, "REMOVE", 0, [])], ingest.LOG)
    assert ids(updates.fold(log)) == [888, 999]
    source, state = f"{tmp_path}/log", f"{tmp_path}/state"
    log.where("seq < 2").write.parquet(source)
    stream = lambda: spark.readStream.schema(ingest.LOG).parquet(source)
    versions = ingest.fold_stream(stream(), state)
    assert ids(ingest.live(versions, spark)) == [0, 888]
    log.where("seq >= 2").write.mode("append").parquet(source)
    assert ids(ingest.live(ingest.fold_stream(stream(), state), spark)) == [888, 999]
    assert ids(ingest.live(ingest.fold_stream(stream(), state), spark)) == [888, 999]


def test_merging_and_replacing_inserts(spark):
    log = spark.createDataFrame([(0, "INSERT", 5, [1]), (1, "REMOVE", 5, []), (2, "INSERT", 5, [2]), (3, "INSERT", 5, [3])], ingest.LOG)
    assert updates.fold(log).first()["labels"] == [3]
    assert updates.fold_merging(log).first()["labels"] == [2, 3]


def test_versions(spark, tmp_path):
    v = updates.Versions(spark, str(tmp_path))
    assert v.current() is None
    assert v.write({"a": spark.range(3)}) == 1 and v.write({"a": spark.range(5)}) == 2
    assert v.read("a").count() == 5 and v.read("a", 1).count() == 3


@pytest.mark.parametrize("bad", ["1 2", "1 &", "(1", "1)", "& 1", "a", "1 - - 2", "()"])
def test_malformed_expressions(bad):
    with pytest.raises(ValueError):
        L.parse(bad)


LEAVES = st.integers(1, 4).map(str)
EXPRESSIONS = st.recursive(LEAVES, lambda e: st.one_of(st.tuples(e, st.sampled_from("&|-"), e).map(" ".join), e.map(lambda x: f"({x})")), max_leaves=8)


def evaluate(text):
    """Set algebra by Python's own operators, whose precedence is spelt out by the tree."""
    sets = {label: {i for i, ls, u in ROWS if label in ls or u} for label in range(1, 5)}

    def walk(n):
        if n.op is None:
            return sets[n.label]
        a, b = walk(n.left), walk(n.right)
        return a & b if n.op == "&" else a | b if n.op == "|" else a - b

    return walk(L.parse(text))


@settings(max_examples=25, deadline=None)
@given(EXPRESSIONS)
def test_predicate_equals_sets(spark, text):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert set(ids(df.where(L.predicate(text, F.col("labels"), F.col("is_universal"))))) == evaluate(text)


def test_precedence():
    assert L.parse("1 | 2 & 3") == L.parse("1 | (2 & 3)") != L.parse("(1 | 2) & 3")
    assert L.parse("1 - 2 & 3") == L.parse("(1 - 2) & 3")


def test_prune_keeps_the_nearest_and_covers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    pool = np.arange(1, 60)
    kept = graph.prune(x, 0, pool, 8, 1.2)
    nearest = pool[np.argmin(((x[pool] - x[0]) ** 2).sum(1))]
    assert kept[0] == nearest and 0 not in kept and len(kept) <= 8 and len(set(kept)) == len(kept)
    assert len(graph.prune(x, 0, np.array([0]), 8, 1.2)) == 0
    same = np.zeros((5, 3))
    assert len(graph.prune(same, 0, np.arange(5), 3, 1.2)) >= 1


def test_knn_ties_and_short_bases(spark):
    base = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(6)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, qv array<float>")
    assert [r["vec_id"] for r in knn.exact_knn(q, base, 4).orderBy("rank").collect()] == [0, 2, 4, 1]
    assert knn.exact_knn(q, base, 99).count() == 6
    assert knn.exact_knn(q, base.limit(0), 3).count() == 0 and knn.exact_knn(q.limit(0), base, 3).count() == 0


def test_query_blocks(spark, small_dir, monkeypatch):
    base = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    q = base.where("vec_id < 25").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    whole = {tuple(r) for r in knn.exact_knn(q, base, 3).collect()}
    monkeypatch.setattr(knn, "QUERY_BLOCK", 10)
    assert {tuple(r) for r in knn.exact_knn(q, base, 3).collect()} == whole


def test_codebook_round_trip():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 10))
    borders = quantizer.chunk_borders(10, 4)
    assert borders == [0, 3, 6, 8, 10]
    book = quantizer.Codebook(x.mean(0), borders, [x[:, a:b] - x.mean(0)[a:b] for a, b in zip(borders, borders[1:])])
    assert np.allclose(book.decode(book.encode(x)), x)
    lut, codes = book.table(x[7]), book.encode(x)
    assert np.allclose(lut[np.arange(4)[None], codes].sum(1), ((x - x[7]) ** 2).sum(1))


def test_cosine_and_l2_rank_alike(spark, small_dir):
    base = spark.read.parquet(f"{small_dir}/embeddings.parquet").limit(100)
    q = base.where("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    order = lambda m: [(r["qid"], r["vec_id"]) for r in knn.exact_knn(q, base, 10, m).orderBy("qid", "rank").collect()]
    assert order("l2") == order("cosine")
    assert set(V.METRICS) == {"l2", "cosine"}


def test_recall_counts_ties(spark):
    truth = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.2), (0, 3, 0.2), (0, 4, 0.3)], "qid long, vec_id long, dist double")
    results = spark.createDataFrame([(0, 1, 3), (0, 2, 1)], "qid long, rank long, vec_id long")
    assert metrics.recall(results, truth, 2).first()["recall"] == 100.0


def test_vector_files(spark, tmp_path):
    x = np.arange(30, dtype="<f4").reshape(10, 3)
    (tmp_path / "a.bin").write_bytes(np.array([10, 3], "<i4").tobytes() + x.tobytes())
    rows = vecfiles.read(spark, str(tmp_path / "a.bin"), rowsPerPartition=4).orderBy("vec_id").collect()
    assert [r["embedding"] for r in rows] == x.tolist()
    fvecs = b"".join(np.array([3], "<i4").tobytes() + r.tobytes() for r in x)
    (tmp_path / "a.fvecs").write_bytes(fvecs)
    assert [r["embedding"] for r in vecfiles.read(spark, str(tmp_path / "a.fvecs"), "vecs").orderBy("vec_id").collect()] == x.tolist()
    (tmp_path / "u.bin").write_bytes(np.array([2, 2], "<i4").tobytes() + bytes([0, 255, 7, 128]))
    assert [r["embedding"] for r in vecfiles.read(spark, str(tmp_path / "u.bin"), element="uint8").collect()] == [[0, 255], [7, 128]]
    (tmp_path / "bad.bin").write_bytes(np.array([9, 3], "<i4").tobytes())
    with pytest.raises(Exception, match="should have"):
        vecfiles.read(spark, str(tmp_path / "bad.bin")).count()


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_truth_files(spark, tmp_path, blocks):
    ids_, dist, tags = np.array([[3, 1], [0, 2]], "<u4"), np.array([[0.0, 0.5], [0.25, 1.0]], "<f4"), np.array([[30, 10], [0, 20]], "<u4")
    (tmp_path / "gt").write_bytes(np.array([2, 2], "<i4").tobytes() + b"".join(x.tobytes() for x in (ids_, dist, tags)[:blocks]))
    vecfiles.register(spark)
    rows = spark.read.format("truth").load(str(tmp_path / "gt")).orderBy("qid", "rank").collect()
    assert [r["vec_id"] for r in rows] == [3, 1, 0, 2]
    assert [r["dist"] for r in rows] == ([0.0, 0.5, 0.25, 1.0] if blocks > 1 else [None] * 4)
    assert [r["tag"] for r in rows] == ([30, 10, 0, 20] if blocks > 2 else [None] * 4)


def test_label_lines(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("1,2\n\n11\r\n1, x,3,3\n")
    rows = vecfiles.label_lines(spark, str(tmp_path / "labels.csv"), universal=11).orderBy("vec_id").collect()
    assert [r["labels"] for r in rows] == [[1, 2], [], [11], [1, 3]]
    assert [r["is_universal"] for r in rows] == [False, False, True, False]
