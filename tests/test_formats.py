"""Files: truth, results, page layouts, labels of queries, tags, logs; and the numbers that they give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import knn, metrics
from lodestone.sources import logs, vecfiles
from lodestone.streaming import ingest


def test_truth_round_trip(spark, tmp_path):
    rows = [(q, r, 10 * q + r, 0.25 * r, 500 + r) for q in range(7) for r in range(1, 4)]
    truth = spark.createDataFrame(rows, "qid long, rank long, vec_id long, dist double, tag long")
    vecfiles.write_truth(truth, str(tmp_path / "t"))
    vecfiles.register(spark)
    back = spark.read.format("truth").load(str(tmp_path / "t")).collect()
    assert sorted(tuple(r) for r in back) == rows
    with pytest.raises(Exception, match="as many rows"):
        vecfiles.write_truth(truth.where("not (qid = 2 and rank = 3)").coalesce(1), str(tmp_path / "u"))


def test_result_round_trip(spark, tmp_path):
    rows = [(0, 1, 5, 0.5), (0, 2, 6, 0.75), (1, 1, 7, 0.25)]
    vecfiles.write_results(spark.createDataFrame(rows, "qid long, rank long, vec_id long, dist double"), str(tmp_path), 3)
    assert sorted(tuple(r) for r in vecfiles.read_results(spark, str(tmp_path)).collect()) == rows


def test_metadata_and_normalised_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, [3.0 * (i + 1), 4.0 * (i + 1)]) for i in range(5)], "vec_id long, embedding array<float>")
    for layout in ("vecbin", "vecs"):
        vecfiles.write(rows.coalesce(1), str(tmp_path / layout), layout, normalize=True)
        back = vecfiles.read(spark, str(tmp_path / layout), layout).collect()
        assert len(back) == 5 and all(np.allclose(r["embedding"], [0.6, 0.8]) for r in back)
        found = vecfiles.metadata(spark, str(tmp_path / layout), layout).collect()
        assert sum(r["n"] for r in found) == 5 and {r["dimension"] for r in found} == {2}


@pytest.mark.parametrize("padded", [True, False])
def test_page_layouts(spark, tmp_path, padded):
    pages = [[4, 2, 9], [0], [7, 1]]
    path = str(tmp_path / "pages.bin")
    if padded:
        rows = [(p, s, i) for p, ids in enumerate(pages) for s, i in enumerate(ids)]
        vecfiles.write_pages(spark.createDataFrame(rows, "page long, slot long, vec_id long"), path, 4)
    else:
        body = b"".join(np.array([len(p), *p], "<u4").tobytes() for p in pages)
        (tmp_path / "pages.bin").write_bytes(np.array([4, 3, 6], "<u8").tobytes() + body)
    back = vecfiles.read_pages(spark, path).orderBy("page", "slot").collect()
    assert [tuple(r) for r in back] == [(p, s, i) for p, ids in enumerate(pages) for s, i in enumerate(ids)]
    (tmp_path / "odd.bin").write_bytes(np.array([4, 3, 6], "<u8").tobytes() + b"123")
    with pytest.raises(ValueError, match="no page layout"):
        vecfiles.read_pages(spark, str(tmp_path / "odd.bin"))


def test_text_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1 & 2\r\n\n(3 | 4) - 5\n")
    assert [r["expression"] for r in vecfiles.query_lines(spark, str(tmp_path / "q.txt"), 3).orderBy("qid").collect()] == ["1 & 2", "", "(3 | 4) - 5"]
    with pytest.raises(ValueError, match="3 lines for 4"):
        vecfiles.query_lines(spark, str(tmp_path / "q.txt"), 4)
    (tmp_path / "bad.txt").write_text("1 &\n")
    with pytest.raises(ValueError):
        vecfiles.query_lines(spark, str(tmp_path / "bad.txt"), 1)
    (tmp_path / "tags.txt").write_text("5\n7 9\n\n5\n12x 30\n")
    assert sorted(r["vec_id"] for r in vecfiles.tag_lines(spark, str(tmp_path / "tags.txt")).collect()) == [5, 7, 9]


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "- Total Results: 9 / 10 (all satisfy tag constraints)\n[Debug IVF Path] Query ID: 4\n  - Total Results: 7 / 10 (all satisfy tag constraints)\n"
        "[Graph Path Warning] Query 6: Insufficient tag-constrained vectors (3 < 10)\n[Debug Graph Path] Query ID: 6\nnoise\n- Total Results:  3 / 10 (all satisfy tag constraints)\n"
        "[IVF Path Warning] Query 8: Insufficient tag-constrained vectors (0 < 10)\n"
    )
    found = {r["qid"]: (r["path"], r["found"], r["wanted"], r["warned"]) for r in logs.completeness(spark, str(tmp_path / "a.log")).collect()}
    assert found == {4: ("IVF", 7, 10, False), 6: ("Graph", 3, 10, True), 8: ("IVF", 0, 10, True)}
    (tmp_path / "b.log").write_text("search current time: 12.5\n20 1000 4 1.5 2.5 3 4.5 9 98.5 31\nwords and more\nsearch current time: 13\n20 900 4 1.6 2.6 3 4.6 9 0 32\n1 2 3\n")
    rows = logs.series(spark, str(tmp_path / "b.log")).orderBy("number").collect()
    assert [(r["at"], r["size"], r["qps"], r["p50"], r["p90"], r["p99"], r["recall"], r["pages"]) for r in rows] == [(12.5, 20, 1000, 1.5, 2.5, 4.5, 0.985, 31), (13, 20, 900, 1.6, 2.6, 4.6, None, 32)]


def test_log_append_and_replay(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert ingest.replay(spark, folder).count() == 0
    ingest.append(spark, folder, spark.createDataFrame([(1, "INSERT", 4, [1]), (2, "INSERT", 5, [2])], ingest.LOG))
    ingest.append(spark, folder, spark.createDataFrame([(3, "REMOVE", 4, None)], ingest.LOG))
    assert [tuple(r) for r in ingest.replay(spark, folder).collect()] == [(5, [2])]
    with pytest.raises(ValueError, match="no such operation"):
        ingest.append(spark, folder, spark.createDataFrame([(3, "UPSERT", 4, None)], ingest.LOG))


def test_stream_beside_other_writers(spark, tmp_path):
    """Versions of other tables in the same folder neither hide a batch nor are lost, and a long stream folds its state."""
    source, state = f"{tmp_path}/log", f"{tmp_path}/state"
    log = lambda i: spark.createDataFrame([(i, "INSERT", i % 3, [i])], ingest.LOG)
    versions = None
    for i in range(5):
        log(i).coalesce(1).write.mode("append").parquet(source)
        versions = ingest.fold_stream(spark.readStream.schema(ingest.LOG).parquet(source), state, fold_after=2)
        versions.write({"other": spark.range(i + 1)})
    assert {tuple(r) for r in ((r["vec_id"], tuple(r["labels"])) for r in ingest.live(versions, spark).collect())} == {(0, (3,)), (1, (4,)), (2, (2,))}
    assert versions.read("other").count() == 5


def test_nulls_and_zero_vectors(spark):
    """Rows that cannot be compared are no neighbours; a zero vector is at cosine distance 1 from all."""
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, [float("nan"), 1.0]), (7, [])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = base.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    found = {}
    for r in knn.exact_knn(queries, base, 3, "cosine").orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append((r["vec_id"], round(r["dist"], 6)))
    assert found == {0: [(0, 0.0), (1, 1.0), (2, 1.0)], 1: [(0, 1.0), (1, 1.0), (2, 1.0)], 2: [(2, 0.0), (0, 1.0), (1, 1.0)], 5: [(5, 0.0)]}


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], list(range(1000)), [3.0] * 500 + [1.0, 2.0, None], [i * i % 97 for i in range(5000)]], ids=len)
@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_percentiles(spark, values, p):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    kept = sorted(v for v in values if v is not None)
    want = kept[min(math.floor(p * len(kept)), len(kept) - 1)]
    assert metrics.percentile(df, "v", p, "x", cuts=8, held=50).first()["x"] == want


def test_success_rate_and_mismatches(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "qid long, vec_id long")
    assert metrics.success_rate(truth, 2, 4) == 0.25 and metrics.throughput(10, 2.0) == 5.0
    a = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    b = spark.createDataFrame([(0, [1.0, 2.0000001]), (2, [1.0]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in metrics.mismatches(a, b, 1e-5).collect()} == {(1, "unknown"), (2, "differs"), (3, "missing")}
