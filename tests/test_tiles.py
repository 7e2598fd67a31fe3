"""Exact vector search in tiles: the rows of a plain join, whatever the vectors hold, and no pair of vectors in a plan's join."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import retrieval


def plain(corpus, queries, limit, by):
    pairs = corpus.join(queries, by) if by else corpus.crossJoin(queries)
    pairs = pairs.where("v IS NOT NULL AND size(v) = size(query_vector)").withColumn("distance", retrieval.squared_distance(F.col("v"), F.col("query_vector")))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "kind").orderBy("distance", "id"))).where(F.col("rank") <= limit)
    return ranked.select("query_id", "id", "kind", "distance", "rank")


@pytest.mark.parametrize("by", [[], ["book"]])
def test_tiles_find_what_a_join_finds(spark, monkeypatch, by):
    """Ties, copies, vectors of other lengths, with null, NaN or infinite components, and blocks that split books and queries."""
    monkeypatch.setattr(retrieval, "TILE_ROWS", 50)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 7)
    r = np.random.default_rng(3)
    data = np.round(r.normal(size=(300, 5)), 1)
    data[40:80] = data[3]
    rows = [(i, int(i % 3), "ab"[i % 2], x.tolist()) for i, x in enumerate(data)]
    odd = [None, [], [1.0], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e200, 0.0, 0.0, 0.0, 0.0]]
    rows += [(1000 + i, i % 3, "ab"[i % 2], x) for i, x in enumerate(odd)]
    corpus = spark.createDataFrame(rows, "id long, book int, kind string, v array<double>")
    queries = corpus.where("id % 10 = 0 OR id >= 1000").select(F.col("id").alias("query_id"), "book", F.col("v").alias("query_vector"))
    limit = F.when(F.col("kind") == "a", 4).otherwise(9)
    queries = queries if by else queries.drop("book")
    got = retrieval.knn(corpus, queries, "id", "v", limit, ["kind"], by, "kind")
    want = plain(corpus, queries, limit, by)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect()))) and want.count() > 200


def test_vectors_meet_as_matrices(spark):
    e = spark.range(100).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    found = retrieval.knn(e, e.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector")), "id", "v", 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "zipwith" not in plan.lower()
    assert [r.id for r in found.where("query_id = 50").orderBy("rank").collect()] == [50, 49, 51]


def test_keyword_tiles_find_what_a_join_finds(spark, monkeypatch):
    """Blocks that split books, documents of two kinds, copies that tie, a query without a bound, one with an unknown term: as by the join."""
    monkeypatch.setattr(retrieval, "TILE_POSTINGS", 100)
    monkeypatch.setattr(retrieval, "TILE_TERMS", 9)
    r = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, int(i % 2), "ab"[i // 2 % 2], int(i // 4), " ".join(f"w{x}" for x in r.integers(0, 30, 12)) if i % 5 else "w1 w2 w2") for i in range(300)], "id long, book int, kind string, idx int, text string")
    index = retrieval.Index.of(docs, "id", ["text"], ["book", "idx"], "kind")
    asked = spark.createDataFrame([(q, q % 2, None if q == 3 else q * 4, [f"W{q}", "w1", "none", f"w{q + 3}"]) for q in range(20)], "query_id long, book int, current int, terms array<string>")
    limit = F.when(F.col("kind") == "a", 4).otherwise(9)
    want = index.search(asked, limit, ["book"], F.col("current").isNull() | (F.col("idx") < F.col("current")))
    got = index.search(asked, limit, ["book"], before=("idx", "current"))
    shown = lambda df: sorted((x.query_id, x.kind, x["rank"], x.id, x.book, x.idx, round(x.score, 9)) for x in df.collect())
    assert shown(got) == shown(want) and got.count() > 150
