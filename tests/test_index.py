"""The persisted index: building, searching, changing, merging, and its service."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import labels as L
from lodestone.index import Index, Service, replay
from lodestone.operators import graph, knn, metrics, quantizer, updates


def cloud(spark, n=300, d=16, seed=0, first=0):
    rng = np.random.default_rng(seed)
    rows = [(first + i, rng.normal(size=d).tolist(), [int(i % 5), 10 + int(i % 3)], i % 50 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, labels array<int>, is_universal boolean")


def asked(rows, n=12):
    return rows.orderBy("vec_id").limit(n).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def recall(index, queries, k=10, **options):
    found = index.search(queries, k, **options)
    truth = knn.exact_knn(queries, index.rows(), k, index.metric())
    return metrics.recall(found, truth, k).first()["recall"]


@pytest.fixture(scope="module")
def sharded(spark, tmp_path_factory):
    return Index.build(spark, str(tmp_path_factory.mktemp("sharded")), cloud(spark, 900).coalesce(2).cache(), degree=24, size=48, most_rows=500, chunks=8)


@pytest.mark.parametrize("options", [{"mode": m} for m in graph.MODES] + [{"sampled": 20}, {"use_codes": False}, {"starts": [5, 899, 10**9]}], ids=str)
def test_recall_over_shards(spark, sharded, options):
    """Queries go to the shards of the nearest centers only."""
    assert sharded.status()["shards"] > 2
    assert recall(sharded, asked(cloud(spark, 900), 30), size=96, width=8, probes=4, **options) >= 90


def test_modes_are_told_apart(spark, sharded):
    queries = asked(cloud(spark, 900), 10)
    with pytest.raises(ValueError, match="mode"):
        sharded.search(queries, 5, mode="nonsense")
    costs = {m: {r["qid"]: r["expanded"] for r in graph.search(sharded.versions.read("graph"), queries, 5, mode=m, stats=True, book=sharded.book()).collect()} for m in ("beam", "page", "greedy")}
    assert all(costs["page"][q] >= 2 * costs["beam"][q] for q in costs["beam"])  # a page's rows are expanded together
    few = graph.search(sharded.versions.read("graph"), queries, 5, mode="beam", stats=True, most_rounds=2).collect()
    assert few and all(r["expanded"] <= 2 * 4 * sharded.status()["shards"] for r in few)


def test_page_search_returns_rows_of_the_page():
    """A node that no link leads to is found with the page that holds it."""
    x = np.array([[float(i), 0.0] for i in range(16)])
    links = np.full((16, 2), -1)
    links[0, 0], links[1, 0] = 8, 0
    score = lambda r, n: x[n][:, 0]
    start = [(np.array([0]), np.array([0]))]
    beam = graph.walk(links, start, 1, 8, score, "beam", 1)
    page = graph.walk(links, start, 1, 8, score, "page", 1)
    assert {int(n) for _, ns in beam.expanded for n in ns} == {0, 8}
    assert {int(n) for _, ns in page.expanded for n in ns} == set(range(16))


def test_lists_grow_past_hidden_rows(spark):
    """With most rows deleted, a list of ten still finds ten live ones."""
    rows = cloud(spark, 400, seed=3)
    packed, _ = graph.build_packed(rows, degree=16, size=32)
    gone = rows.where("vec_id % 10 <> 3").select("vec_id")
    queries = asked(rows, 10)
    found = graph.search(packed, queries, 10, size=10, mode="beam", excluded=gone).collect()
    assert all(r["vec_id"] % 10 == 3 for r in found)
    truth = {(r["qid"], r["vec_id"]) for r in knn.exact_knn(queries, rows.where("vec_id % 10 = 3"), 10).collect()}
    assert len({(r["qid"], r["vec_id"]) for r in found} & truth) >= 0.95 * len(truth)


def test_load_checks(spark, sharded, tmp_path):
    assert Index.load(spark, sharded.versions.folder).status() == sharded.status()
    broken = Index.build(spark, str(tmp_path / "broken"), cloud(spark, 60), chunks=4)
    broken.versions.write({"vectors": broken.versions.read("vectors").where("vec_id > 3")})
    with pytest.raises(ValueError, match="rows of vectors: 56 instead of 60"):
        Index.load(spark, broken.versions.folder)
    with pytest.raises(ValueError, match="no index"):
        Index(spark, str(tmp_path / "nothing")).search(asked(cloud(spark, 3)), 1)


def test_odd_vectors_are_left_out(spark, tmp_path):
    good = cloud(spark, 80).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = spark.createDataFrame([(900, None), (901, [1.0]), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16)], "vec_id long, embedding array<double>")
    index = Index.build(spark, str(tmp_path), good.unionByName(bad))
    assert index.status()["live"] == 80
    with pytest.raises(ValueError, match="no usable vector"):
        index.insert(bad.where("vec_id = 902"))
    with pytest.raises(ValueError, match="no usable vector"):
        Index.build(spark, str(tmp_path / "x"), bad.where("vec_id = 900"))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_changes_are_seen_at_once_and_after_the_merge(spark, tmp_path, metric):
    base, new = cloud(spark, 200), cloud(spark, 40, seed=9, first=1000)
    index = Index.build(spark, str(tmp_path), base, metric=metric, degree=16, size=32, chunks=4)
    index.insert(new)
    unknown = index.remove(spark.createDataFrame([(0,), (1,), (1001,), (5000,)], "vec_id long")).collect()
    assert [r["vec_id"] for r in unknown] == [5000]
    index.insert(new.where("vec_id = 1002").withColumn("vec_id", F.lit(1).cast("long")))  # a removed id comes back
    live = {r["vec_id"] for r in index.rows().collect()}
    assert live == {*range(200), *range(1000, 1040)} - {0, 1001}
    queries = asked(base.unionByName(new), 230)
    for _ in range(2 if metric == "l2" else 1):
        assert recall(index, queries, size=64) >= 95
        found = index.search(queries, 3, tags=True, vectors=True).toPandas()
        assert not found["vec_id"].isin([0, 1001]).any()
        near = found[(found["qid"] == 1002) & (found["rank"] == 1)].iloc[0].to_dict()
        assert near["dist"] < 1e-6 and near["vec_id"] in (1, 1002) and near["tag"] is not None and near["embedding"] is not None
        before = index.status()["version"]
        index.merge()
        assert index.status()["live"] == len(live) and index.status()["version"] >= before
        Index.load(spark, str(tmp_path))
    assert index.merge() == index.status()["version"]  # nothing to merge
    assert index.rebuild() > before and recall(index, queries, size=64) >= 95


def test_merged_graph_has_no_dead_links(spark, tmp_path):
    index = Index.build(spark, str(tmp_path), cloud(spark, 500), degree=16, size=32, most_rows=250, chunks=4)
    index.remove(cloud(spark, 500).where("vec_id % 3 = 0").select("vec_id"))
    index.insert(cloud(spark, 60, seed=4, first=2000))
    index.merge()
    g = graph.unpacked(index.versions.read("graph"))
    ids = {r["vec_id"] for r in index.rows().collect()}
    for r in g.collect():
        assert r["vec_id"] in ids and set(r["nbrs"]) <= ids and r["vec_id"] not in r["nbrs"] and len(r["nbrs"]) <= 16
    assert {r["vec_id"] for r in graph.reachable(g).collect()} == ids
    rows = {r["vec_id"]: r["labels"] for r in index.rows().collect()}
    assert rows[1] == [1, 11] and rows[2001] == [1, 11]


def test_filtered_search_after_merge(spark, tmp_path):
    index = Index.build(spark, str(tmp_path), cloud(spark, 300), degree=16, size=32, chunks=4)
    index.insert(cloud(spark, 60, seed=4, first=2000))
    queries = asked(cloud(spark, 300), 12).withColumn("expression", F.when(F.col("qid") % 2 == 0, "1 & 11").otherwise("(2 | 3) - 10"))
    for _ in range(2):
        found = index.search(queries, 5, size=96)
        assert metrics.violations(found, queries, index.rows()).count() == 0
        truth = knn.exact_knn(queries, index.rows(), 5)
        assert metrics.recall(found, truth, 5).first()["recall"] >= 90
        index.merge()


def test_growth_makes_new_shards(spark, tmp_path):
    index = Index.build(spark, str(tmp_path), cloud(spark, 100), degree=12, size=24, most_rows=120, chunks=4)
    index.insert(cloud(spark, 400, seed=5, first=500))
    index.merge()
    assert index.status()["shards"] > 1 and index.status()["base"] == 500
    assert recall(index, asked(cloud(spark, 100)), size=96) >= 90


def test_random_removal(spark, tmp_path):
    index = Index.build(spark, str(tmp_path), cloud(spark, 100), chunks=4)
    index.insert(cloud(spark, 20, seed=5, first=500))
    assert index.remove_random(0.5, "inserted") == 10 and index.rows().where("vec_id >= 500").count() == 10
    assert index.remove_random(0.25, "base", seed=1) == 25 and index.rows().where("vec_id < 500").count() == 75
    with pytest.raises(ValueError, match="scope"):
        index.remove_random(0.1, "some")


def test_get(spark, sharded):
    ids = spark.createDataFrame([(3,), (10**6,)], "vec_id long")
    found = {r["vec_id"]: r["embedding"] for r in sharded.get(ids).collect()}
    assert len(found[3]) == 16 and found[10**6] is None
    assert sharded.get(ids.withColumnRenamed("vec_id", "tag"), "tag").where("vec_id is not null").count() == 1


def test_replay(spark, tmp_path):
    index = Index.build(spark, str(tmp_path), cloud(spark, 150), degree=16, size=32, chunks=4)
    queries = asked(cloud(spark, 150))
    steps = [("search", queries), ("insert", cloud(spark, 30, seed=2, first=300)), ("remove", spark.range(10).withColumnRenamed("id", "vec_id")), ("search", queries), ("merge",), ("search", queries)]
    rows = replay(index, steps, 5, size=48).orderBy("step").collect()
    assert [r["what"] for r in rows] == [s[0] for s in steps]
    assert all(r["recall"] >= 95 and r["per_second"] > 0 for r in rows if r["what"] == "search")


def test_service(spark, tmp_path):
    source = cloud(spark, 120)
    service = Service(Index.build(spark, str(tmp_path), source, degree=16, size=32, chunks=4), source)
    assert service.execute("STATUS").startswith("OK version=1 base=120 shards=1 inserted=0")
    assert service.execute("INSERT_ROWS 3,4") == "OK inserted=2 first=120"
    assert service.execute("INSERT_RANDOM 5") == "OK inserted=5 first=122"
    assert service.execute("SEARCH_ROW 3 2").split()[1:] == ["3:3:0", "3:120:0"]
    assert service.execute("SEARCH_TAG 121 1 50 8").startswith("OK 121:4:0")
    assert service.execute("DELETE_INSERTED 2") == "OK deleted=2" and service.execute("DELETE_BASE_RANDOM 20") == "OK deleted=20"
    assert service.execute("DELETE_INSERTED 99").startswith("ERR not enough")
    assert service.execute("MERGE").startswith("OK version=")
    assert "base=105" in service.execute("STATUS")
    assert len(service.execute("SEARCH_RANDOM 3 2").split()) == 7
    assert "MERGE=1" in service.execute("STATS")
    for bad in ("", "NONSENSE", "SEARCH_ROW x 1", "SEARCH_ROW 1", "INSERT_ROWS", "status", "INSERT_RANDOM -1", "EXECUTE 1"):
        assert service.execute(bad).startswith("ERR"), bad
    assert service.execute("QUIT") == "OK bye" and service.closed


def test_codebook_table(spark):
    rng = np.random.default_rng(1)
    book = quantizer.Codebook(rng.normal(size=10), [0, 4, 10], [rng.normal(size=(5, 4)), rng.normal(size=(5, 6))])
    table = quantizer.book_table(spark, book)
    back = quantizer.read_book(table)
    assert back.borders == book.borders and all((a == b).all() for a, b in zip(back.centers, book.centers)) and (back.mean == book.mean).all()
    for odd in (table.where("chunk <> -1"), table.where("not (chunk = 0 and code = 2)"), table.where("chunk <> 1")):
        with pytest.raises(ValueError):
            quantizer.read_book(odd)


def test_delta_prune_takes_one_away():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4))
    links = np.arange(1, 9)
    assert len(graph.delta_prune(x, 0, links, 20, 12, 1.2)) == 9
    full = graph.delta_prune(x, 0, links, 20, 8, 1.2)
    assert len(full) == 8 and set(full) < {*links, 20}
    assert 0 not in graph.delta_prune(x, 0, np.array([0, 1]), 1, 8, 1.2)


def test_pruned_equals_prune(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    edges = [(i, int(j)) for i in range(20) for j in rng.choice(60, 25, replace=False)]
    found = {r["vec_id"]: r["nbrs"] for r in graph.pruned(spark.createDataFrame(edges, "vec_id long, nbr long"), vectors, 6, 1.2).collect()}
    for i in range(20):
        pool = np.array([j for a, j in edges if a == i])
        assert found[i] == sorted(graph.prune(x, i, pool, 6, 1.2, most=24).tolist())


def test_samples(spark):
    ids = [r["vec_id"] for r in updates.sampled_ids(spark, 100, 5000, 40, 1).collect()]
    assert len(set(ids)) == 40 and all(100 <= i < 5000 for i in ids)
    assert sorted(r["vec_id"] for r in updates.sampled_ids(spark, 5, 9, 4).collect()) == [5, 6, 7, 8]
    with pytest.raises(ValueError):
        updates.sampled_ids(spark, 5, 8, 4)
    few = updates.rows_to_insert(spark, 3, 10).collect()
    assert len(few) == 10 and {r["vec_id"] for r in few} <= {0, 1, 2}
    assert len({r["vec_id"] for r in updates.rows_to_insert(spark, 30, 10).collect()}) == 10
    rows = spark.range(1000).withColumnRenamed("id", "vec_id")
    assert 60 < updates.bernoulli(rows, 0.1).count() < 140
    assert updates.bernoulli(rows, 0.0).count() == 1 and updates.bernoulli(rows.limit(0), 0.5).count() == 0


def test_labels_in_memory_equal_predicates(spark):
    rows = cloud(spark, 60)
    for text in ("1", "1 & 11", "(2 | 3) - 10", "4 | 1 & 12", ""):
        want = {r["vec_id"] for r in rows.where(L.predicate(text, F.col("labels"), F.col("is_universal"))).collect()}
        table = rows.orderBy("vec_id").toArrow()
        mask = L.arrow_rows_that_hold(text, table["labels"].combine_chunks(), table["is_universal"].combine_chunks())
        assert set(np.flatnonzero(mask).tolist()) == want
