"""Tables between steps take few files, whatever the number of shuffle partitions."""

import glob

import numpy as np

from lodestone.llm import common, simhash


def test_few_files(spark, monkeypatch):
    """Many small partitions, as of a wide shuffle, leave two files a core; the rows are all there."""
    paths, plain = [], common.written

    def spy(*args, **named):
        found = plain(*args, **named)
        paths.append(common._FOLDERS[found].removeprefix("file:"))
        names.append(len(glob.glob(f"{paths[-1]}/part-*")))
        return found

    names: list[int] = []
    monkeypatch.setattr(common, "written", spy)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(2)
        lanes = [(i, [int(x)]) for i, x in enumerate(rng.integers(0, 1 << 62, 1000).repeat(2))]
        lanes = [(i, [x ^ (1 << i % 3)]) for i, (x,) in lanes]
        marked = spark.createDataFrame(lanes, "doc_id long, lanes array<long>").repartition(4)
        found = {r["doc_id"]: r["component_id"] for r in simhash.components_of(marked).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: i // 2 * 2 for i in range(2000)}
    assert len(names) >= 4 and max(names) <= 2 * spark.sparkContext.defaultParallelism
