"""Embedding near-duplicates in a table of several vector lengths."""

import numpy as np

from lodestone.llm import binary_codes
from tests.llm.test_links import union_find


def test_lengths_do_not_hinder_each_other(spark):
    """One longer vector among many; and each length is compared within itself."""
    rng = np.random.default_rng(1)
    rows = []
    for d, n in ((16, 30), (17, 1), (9, 5)):
        for _ in range(n):
            v = rng.normal(size=d)
            rows += [v, v * 2 + rng.normal(0, 0.01, d)] if n > 1 else [v]
    unit = [v / np.linalg.norm(v) for v in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.93]
    want = union_find(len(rows), pairs)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in binary_codes.links(df).collect()}
    assert len(pairs) >= 35
    assert found == {i: (sum(i in p for p in pairs), want[i], want[i] == i) for i in range(len(rows))}
