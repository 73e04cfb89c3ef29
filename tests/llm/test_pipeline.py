"""The pipeline's stages, each on its own input, and the registered queries of the subpackage."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, minhash, nbsvm, quality_rules, queries
from tests.llm.test_links import union_find
from tests.llm.test_text_operators import brute_substring, prose, words


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(common.written(stage(spark, found[-1], sf_dir), name))
    return found


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_rows_only_shrink(steps):
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert after.columns == steps[0].columns
        assert set(by_id(after)) <= set(by_id(before))


def test_classifier_and_rules(spark, steps, sf_dir):
    model = nbsvm.fit(steps[0], queries.table(spark, sf_dir, "labels").where(~queries.held_out()))
    good = {r["doc_id"] for r in nbsvm.score(steps[0], model).collect() if r["score"] >= 0.3}
    assert set(by_id(steps[1])) == good
    kept = quality_rules.measure(steps[1], queries.vocabulary("piece_bpe_32k.model")).where("rules.kept")
    assert set(by_id(steps[2])) == set(by_id(kept))


def shingles(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def pairs_at(sets, share=0.8):
    """Pairs (i, j) of sets whose similarity is share or more: those that meet in one of their rarest shingles."""
    count = Counter(x for s in sets.values() for x in s)
    by = {}
    for i, s in sets.items():
        rare = sorted(s, key=lambda x: (count[x], x))
        for x in rare[: len(s) - math.ceil(share * len(s)) + 1]:
            by.setdefault(x, []).append(i)
    met = {(i, j) for ids in by.values() for k, i in enumerate(ids) for j in ids[k + 1 :]}
    return {(i, j) for i, j in met if len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])}


def test_near_duplicates(steps):
    """All pairs at 0.8 or more are found, nothing else is: one document stays of each group that such pairs make."""
    before, after = by_id(steps[2]), by_id(steps[3])
    sets = {i: frozenset(shingles(r["text"])) for i, r in before.items()}
    pairs = pairs_at(sets)
    order = sorted(sets)
    at = {i: n for n, i in enumerate(order)}
    root = union_find(len(order), [(at[i], at[j]) for i, j in pairs])
    left = Counter(root[at[i]] for i in after)
    assert pairs and set(left) == set(root) and all(n == 1 for n in left.values())


def test_near_duplicates_at_size(spark):
    """Of all pairs of a larger table, a tenth at most may be lost; none below 0.8 may be linked."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    first = {}
    for r in docs.collect():
        first.setdefault(frozenset(shingles(r["text"])), r["doc_id"])
    sets = {i: s for s, i in first.items()}
    pairs = pairs_at(sets)
    found = {r["doc_id"]: r["component_id"] for r in minhash.groups(minhash.marks(docs), "doc_id").collect()}
    linked = sum(found[i] == found[j] for i, j in pairs)
    assert len(pairs) > 20 and linked >= 0.9 * len(pairs)
    order = sorted(sets)
    at = {i: n for n, i in enumerate(order)}
    root = union_find(len(order), [(at[i], at[j]) for i, j in pairs])
    classes = {}
    for i in order:
        classes.setdefault(found[i], set()).add(root[at[i]])
    assert all(len(c) == 1 for c in classes.values())


def test_substrings(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    order = sorted(before)
    kept = brute_substring([words(before[i]["text"]) for i in order])
    for i, k in zip(order, kept, strict=True):
        whole = len(k) == len(words(before[i]["text"]))
        assert after[i]["text"] == (before[i]["text"] if whole else b" ".join(k).decode())
        assert after[i]["n_chars"] == (before[i]["n_chars"] if whole else len(after[i]["text"]))


def test_packed(steps):
    pieces = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()
    assert {r["doc_id"] for r in pieces} == set(by_id(steps[4])) and all(r["n"] == r["total"] for r in pieces)


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows and further columns pass every stage; so does an empty table."""
    long = prose(400)
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (3, long, "xx", "s", 9, "c"), (3, long, "xx", "s", 9, "c"), (None, prose(300), None, None, 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lanes string")
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(1, 0, 0), (3, 1, 0)], labels).write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, str(tmp_path)).collect()
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1, 3]
    cut = corpus_pipeline.substrings(spark, docs, str(tmp_path)).where("doc_id = 3").collect()
    assert [r["text"] for r in cut] == ["", ""]


def test_registered(spark):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in known if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in known and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = db.sql(queries.ORACLES[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(want)
    assert all(not isinstance(x, float) or math.isfinite(x) for r in got for x in r)
