"""Near-duplicates of the pipeline against the exact similarity of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import minhash
from tests.llm.test_links import union_find
from tests.llm.test_pipeline import shingles
from tests.llm.test_text_operators import prose


def edited(kind, text, rng):
    """A near copy of 300 words; about half of them are at 0.8 or more."""
    w = text.split()
    if kind == "words":
        for at in rng.sample(range(len(w)), rng.randint(3, 11)):
            w[at] = f"other{rng.randrange(10**6)}"
    elif kind == "inserted":
        at = rng.randrange(len(w))
        w[at:at] = prose(rng.randint(35, 95), rng).split()
    else:
        at, n = rng.randrange(200), rng.randint(35, 75)
        del w[at : at + n]
    return " ".join(w)


@pytest.mark.parametrize("kind", ["words", "inserted", "deleted"])
def test_links_are_exact(spark, kind):
    rng = random.Random(kind)
    texts = []
    for _ in range(300):
        base = prose(300, rng)
        texts += [base, edited(kind, base, rng)]
    sets = [shingles(t) for t in texts]
    similar = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.8 <= s < 0.9 for s in similar) >= 60 and sum(0.7 <= s < 0.8 for s in similar) >= 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    kept = np.array([i in left and i + 1 in left for i in range(0, len(texts), 2)])
    assert all(i in left or i + 1 in left for i in range(0, len(texts), 2))
    assert kept.tolist() == [s < 0.8 for s in similar]


def test_groups_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = [frozenset(shingles(r["text"])) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = union_find(len(rows), pairs)
    found = {r["doc_id"]: r["component_id"] for r in minhash.groups(minhash.marks(docs), "doc_id").collect()}
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(want[i], set()).add(found[r["doc_id"]])
    assert pairs and all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)


@pytest.mark.parametrize("portion", [7, 2048])
def test_similar(portion):
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, n, replace=False), rng.integers(0, 1 << 60, m).astype(np.uint64)])) for n, m in [(50, 0), (45, 0), (40, 0), (39, 0), (50, 12), (50, 13), (0, 0), (0, 3)]]
    side = {"shingles": np.array([s.tobytes() for s in sets], dtype=object)}
    want = [[len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert minhash.similar(side, side, 0.8, portion).tolist() == want
