"""Links, components and embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import binary_codes, linking
from lodestone.llm.queries import table


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("shape,few", [("path", 20), ("star", 0), ("random", 30), ("path", 10**4), ("random", 10**4), ("none", 10**4), ("loop", 10**4), ("loop", 0)])
def test_components(spark, shape, few):
    rng = np.random.default_rng(4)
    pairs = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(7, i) for i in range(150)],
        "random": rng.integers(0, 300, (200, 2)).tolist(),
        "none": [],
        "loop": [(3, 3), (5, 6), (6, 5), (5, 6)],
    }[shape]
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = linking.components(edges, few=few).collect()
    want = union_find(301, pairs)
    classes = {}
    for r in found:
        classes.setdefault(r["root"], set()).add(want[r["node"]])
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)
    assert {r["node"] for r in found} == {x for p in pairs for x in p if p[0] != p[1]}


@pytest.mark.parametrize("block", [3, 1000])
def test_bucket_links_in_blocks(spark, block):
    n = 40
    rows = spark.createDataFrame([(i % 2, i) for i in range(n)] + [(9, 1)], "key long, node long")
    payload = spark.createDataFrame([(i, float(i), 1) for i in range(n)], "node long, x double, copies long")
    kernel = lambda: lambda a, b: np.abs(a["x"][:, None] - b["x"][None]) <= 4
    found = linking.bucket_links(rows, ["key"], payload, "node", kernel, block=block, weight="copies")
    links = {r["node"]: r["n"] for r in found.groupBy("node").agg(F.sum("links").alias("n")).collect()}
    assert links == {i: sum(j != i and (i - j) % 2 == 0 and abs(i - j) <= 4 for j in range(n)) for i in range(n)}
    classes = {r["root"] for r in linking.components(found, "node", "rep").collect()}
    assert len(classes) == 2


@pytest.mark.parametrize("shape,block", [("star", 5), ("path", 5), ("apart", 5), ("pairs", 2), ("path", 1000)])
def test_connected_loses_no_link(spark, shape, block):
    """Whatever the blocks: components of all links within buckets, where few pairs of a bucket link."""
    n = 60
    linked = {
        "star": lambda i, j: (i == 0) | (j == 0),
        "path": lambda i, j: np.abs(i - j) == 1,
        "apart": lambda i, j: (i == j) & (i < 0),
        "pairs": lambda i, j: i // 2 == j // 2,
    }[shape]
    buckets = [(0, i) for i in range(n)] + [(1, i) for i in range(n, n + 7)] + [(2, i) for i in range(50, 70)]
    rows = spark.createDataFrame(buckets, "key long, node long")
    payload = spark.createDataFrame([(i, i) for i in range(70)], "node long, x long")
    kernel = lambda: lambda a, b: linked(a["x"][:, None], b["x"][None, :])
    pairs = {(i, j) for k in (0, 1, 2) for a, i in buckets if a == k for b, j in buckets if b == k and i < j and linked(np.int64(i), np.int64(j))}
    want = union_find(70, pairs)
    classes = {}
    for r in linking.connected(rows, ["key"], payload, "node", kernel, block=block).collect():
        classes.setdefault(r["root"], set()).add(r["node"])
    expected = {}
    for i, w in enumerate(want):
        expected.setdefault(w, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(sorted(c) for c in expected.values() if len(c) > 1)


def brute(vectors, threshold=0.93):
    good = {i: np.array(v, float) for i, (v, l) in enumerate(vectors) if v is not None and l is not None and None not in v and len(v) == 4 and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    pairs = [(i, j) for i in unit for j in unit if i < j and vectors[i][1] == vectors[j][1] and unit[i] @ unit[j] >= threshold]
    return pairs


def test_embeddings_fixture(spark):
    vectors = [
        ([1.0, 0, 0, 0], 1), ([1.0, 0.1, 0, 0], 1), ([1.0, 0, 0, 0], 2), ([1.0, 0, 0, 0], None), ([2.0, 0.2, 0, 0], 1), (None, 1), ([0.0, 0, 0, 0], 1), ([float("nan"), 0, 0, 1], 1),
        ([float("inf"), 0, 0, 1], 1), ([None, 1.0, 0, 0], 1), ([1.0, 0, 0, 0], 1), ([0, 1.0, 0, 0], 1), ([0, 1.0, 0.05, 0], 1), ([1e30, 1e29, 0, 0], 1), ([-1.0, 0, 0, 0], 1), ([], 1), ([1.0, 0.5], 1),
    ]
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], l, "x") for i, (v, l) in enumerate(vectors)], "vec_id long, embedding array<float>, label int, node string")
    found = {r["vec_id"]: r for r in binary_codes.links(df).collect()}
    pairs = brute(vectors)
    want = union_find(len(vectors), pairs)
    assert len(found) == len(vectors)
    for i in range(len(vectors)):
        assert found[i]["n_links"] == sum(i in p for p in pairs), i
        assert found[i]["component_id"] == want[i] and found[i]["kept"] == (want[i] == i)
    assert binary_codes.links(df.limit(0)).count() == 0


def test_embeddings_recall(spark, small_dir):
    """Copies at the threshold and above are found: at least nine of ten links, and none below."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(300, 32))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.90, 1.0, (300, 1))
    rows = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * noise])
    exact = rows @ rows.T / np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(rows, axis=1))
    np.fill_diagonal(exact, 0)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r["n_links"] for r in binary_codes.links(df).collect()}
    truth = (exact >= 0.93).sum(1)
    assert all(found[i] <= truth[i] for i in range(len(rows)))
    assert sum(found.values()) >= 0.9 * truth.sum()


@pytest.mark.parametrize("d", [3, 16, 64, 100, 300])
def test_estimates_are_unbiased_and_bounded(d):
    """From the stored codes, factors and rounded coordinates alone, at the threshold's angle."""
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=(2, 400, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    errors, inside = [], []
    for seed in range(8):
        coder = binary_codes.Coder(d, 0, 1, seed)
        (code, _, left, _), (_, planes, right, _) = coder.encode(x), coder.encode(y)
        found = binary_codes.estimates(d, code, planes, left, right)
        bound = 3.5 * binary_codes.deviations(d, left, right, 0.93)
        error = np.diag(found - x @ y.T)
        errors.append(error.mean())
        inside.append((np.abs(error) <= np.diag(bound)).mean())
    assert abs(np.mean(errors)) < 0.02 and min(inside) > 0.99


def test_codes_are_small():
    """What is sent to a table is the code, the factor and four bits a coordinate, not the vector."""
    coder = binary_codes.Coder(768, 8, 3, 0)
    code, planes, stats, keys = coder.encode(coder.unit(np.random.default_rng(0).normal(size=(5, 768))))
    assert code.nbytes + planes.nbytes + stats.nbytes <= 5 * 768 * 8 / 8 and keys.shape == (5, 3)


def test_plan_reaches_its_recall():
    for largest in (10, 512, 513, 20_000, 10**6, 10**9):
        signs, tables = binary_codes.plan(largest, 0.93, 0.98)
        assert binary_codes.chance(signs, tables, 256, 0.93) >= 0.98
        assert (signs, tables) == (0, 1) if largest <= 512 else largest / 2**signs <= 512


@pytest.mark.parametrize("bucket", [512, 40])
def test_many_vectors_at_the_threshold(spark, bucket):
    """3,000 vectors of one label, half of them copies near the threshold, a group of near copies, and more tables than one."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.925, 0.95, (1300, 1))
    group = base[:1] + rng.normal(0, 0.004, (400, 64))
    rows = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * noise, group])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    exact = unit @ unit.T
    np.fill_diagonal(exact, 0)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in binary_codes.links(df, bucket=bucket).collect()}
    truth = exact >= 0.93
    n = truth.sum(1)
    assert all(found[i]["n_links"] <= n[i] for i in range(len(rows)))
    far = ~(exact >= 0.99)
    assert sum(found[i]["n_links"] for i in range(2600)) >= 0.95 * n[:2600].sum()
    pairs = (truth & far)[:1300, 1300:2600].sum()
    linked = sum(found[1300 + i]["component_id"] == found[i]["component_id"] for i in range(1300) if truth[i, 1300 + i])
    assert pairs > 800 and linked >= 0.95 * pairs


def test_odd_ids_and_columns(spark):
    """Null and repeated ids, repeated rows, and columns that carry the operator's own names."""
    rows = [(1, [1.0, 0.0], 1, 9, "x"), (1, [1.0, 0.0], 1, 9, "x"), (None, [1.0, 0.01], 1, 9, "y"), (4, [-0.0, 1.0], 1, 9, "y"), (5, [0.0, 1.0], 1, 9, None), (None, None, 1, 9, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, h1 string")
    found = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in binary_codes.links(df).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (-1, 2, 1, True), (4, 1, 4, True), (5, 1, 4, False), (-1, 0, None, True)], key=str)


def test_whole_table(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows], float)
    label = np.array([r["label"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(links, False)
    found = {r["vec_id"]: r["n_links"] for r in binary_codes.links(df).collect()}
    assert sum(found.values()) >= 0.9 * links.sum()
    assert all(found[r["vec_id"]] <= links[i].sum() for i, r in enumerate(rows))
