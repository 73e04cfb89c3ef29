"""Searches of more queries than a block holds."""

from pyspark.sql import functions as F

from lodestone.operators import graph, hybrid, knn, quantizer
from lodestone.plans import catalog


def test_searches_in_blocks(spark, small_dir, monkeypatch):
    base = catalog.rows(spark, small_dir).where("vec_id < 200").cache()
    q = base.where("vec_id < 25").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    built = graph.build_packed(base, 8, 16)[0].cache()
    book = quantizer.train(base, 16)
    coded = quantizer.encode(base, book)
    asked = q.withColumn("expression", F.when(F.col("qid") % 2 == 0, "1 | 12").otherwise("2"))
    searches = [
        lambda: graph.search(built, q, 5), lambda: graph.search(built, asked, 5, mode="beam", book=book), lambda: knn.exact_knn(asked, base, 5),
        lambda: quantizer.scan(q, coded, book, 5), lambda: quantizer.scan(q, coded, book, 5, symmetric=True), lambda: quantizer.scan(asked, coded, book, 5),
        lambda: hybrid.candidates(asked, base), lambda: hybrid.routes(asked, base, 0.1), lambda: hybrid.search(asked, base, built, coded, book, 5),
    ]
    whole = [sorted(map(tuple, s().collect())) for s in searches]
    monkeypatch.setattr(knn, "QUERY_BLOCK", 10)
    assert [sorted(map(tuple, s().collect())) for s in searches] == whole and len(whole[0]) == 125
    assert graph.search(built, q.limit(0), 5).count() == 0 and quantizer.scan(q.limit(0), coded, book, 5).count() == 0
