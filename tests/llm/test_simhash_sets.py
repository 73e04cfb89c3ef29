"""The near-duplicate stage's SimHash candidates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import minhash, simhash, simhash_sets
from tests.llm.test_links import union_find
from tests.llm.test_pipeline import pairs_at, shingles
from tests.llm.test_text_operators import prose


def test_stage_is_by_simhash(spark, monkeypatch):
    """The stage's candidates come from SimHash fingerprints, and from nothing beside them."""
    asked = []
    for name in ("marks", "groups"):
        monkeypatch.setattr(minhash, name, lambda *a, **k: pytest.fail("not the method named"))
        plain = getattr(simhash_sets, name)
        monkeypatch.setattr(simhash_sets, name, lambda *a, plain=plain, name=name, **k: asked.append(name) or plain(*a, **k))
    text = prose(300)
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, prose(200))], "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert asked == ["marks", "groups"] and len(left) == 2


@pytest.mark.parametrize("n", [1, 4, 255, 256, 700])
def test_index(n):
    """Each segment of the fingerprint, and it with one of its most narrowly decided bits flipped."""
    text = " ".join(f"w{i}" for i in range(n + 4)).encode()
    lanes = np.array(simhash.fingerprint(text, 5, simhash_sets.LANES), np.int64)
    hashes = minhash.shingle_set(text)
    votes = simhash_sets.ballots(hashes)
    entries, check = simhash_sets.index(votes)
    assert len(hashes) == n and check.tolist() == lanes[-2:].tolist()
    bits = lanes[:-2].astype("<i8").view("<u2").tolist()
    for s, keys in enumerate(entries.reshape(-1, 4).tolist()):
        assert keys[0] == (s << 16) + bits[s] and len(set(keys)) == 4
        flips = [(k ^ keys[0]).bit_length() - 1 for k in keys[1:]]
        assert all(k ^ keys[0] == 1 << f for k, f in zip(keys[1:], flips, strict=True))
        margins = np.abs(votes[16 * s : 16 * s + 16])
        assert margins[flips].tolist() == sorted(margins.tolist())[:3]
    assert not simhash_sets.ballots(hashes[:0]).any()


@pytest.mark.parametrize("block,held,batch", [(5, 40, 7), (5, 1 << 16, 1000), (1000, 40, 7)])
def test_meetings_lose_no_link(spark, monkeypatch, block, held, batch):
    """Buckets of any size, over batches of any size: compared here, or handed on whole."""
    monkeypatch.setattr(simhash_sets, "HELD", held)
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 60, 150), np.full(30, 7), np.full(90, 61)])
    checks = rng.integers(0, 4, (len(keys), 2))
    rows = [(int(k), i, int(a), int(b)) for i, (k, (a, b)) in enumerate(zip(keys, checks, strict=True))]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(batch))
    try:
        found = simhash_sets.meetings(spark.createDataFrame(rows, "key long, node long, c0 long, c1 long"), 1, block).collect()
    finally:
        spark.conf.set(size, before)
    counts = np.bincount(keys)
    assert sorted((r["key"], r["node"]) for r in found if r["key"] is not None) == sorted((int(k), i) for i, k in enumerate(keys) if counts[k] > block)
    links = [(i, j) for i in range(len(keys)) for j in range(i) if keys[i] == keys[j] and counts[keys[i]] <= block and int(np.bitwise_count(checks[i] ^ checks[j]).sum()) <= 1]
    assert links and union_find(len(keys), [(r["node"], r["rep"]) for r in found if r["rep"] is not None]) == union_find(len(keys), links)


@pytest.mark.parametrize("block", [8, simhash_sets.BUCKET])
def test_recall_at_size(spark, block):
    """Of all pairs of a larger table at 0.8 or more, one in twenty at most is lost; none below is linked."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where(F.col("doc_id") % 2 == 0)
    first = {}
    for r in docs.collect():
        first.setdefault(frozenset(shingles(r["text"])), r["doc_id"])
    sets = {i: s for s, i in first.items()}
    pairs = pairs_at(sets)
    marked = simhash_sets.marks(docs)
    found = {r["doc_id"]: r["component_id"] for r in simhash_sets.groups(marked, "doc_id", block=block).collect()}
    assert len(pairs) > 8 and sum(found[i] == found[j] for i, j in pairs) >= 0.95 * len(pairs)
    order = sorted(sets)
    at = {i: n for n, i in enumerate(order)}
    root = union_find(len(order), [(at[i], at[j]) for i, j in pairs])
    classes = {}
    for i in order:
        classes.setdefault(found[i], set()).add(root[at[i]])
    assert all(len(c) == 1 for c in classes.values())
