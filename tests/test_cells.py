"""Vector search in cells: recall against all rows, books kept apart, rows without vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import retrieval
from skein.plans import generate


def vectors(spark, data, books=1):
    return spark.createDataFrame([(i, int(i % books), x.tolist()) for i, x in enumerate(data)], "id long, book int, v array<double>")


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_on_many_vectors(spark, clustered):
    r = np.random.default_rng(5)
    n = 50_000
    data = r.normal(size=(n, 16))
    if clustered:
        data = r.normal(size=(500, 16))[r.integers(0, 500, n)] + 0.3 * r.normal(size=(n, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = vectors(spark, data)
    asked = rows.where("id % 500 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    cells = retrieval.Cells.fit(rows, "v")
    assert len(cells.centroids) == int(np.sqrt(n))
    kept = cells.assigned(rows, "v")
    got = {}
    for x in retrieval.knn(kept, asked, "id", "v", 10, cells=cells).collect():
        got.setdefault(x.query_id, {})[x.id] = x.distance
    right = 0
    for q in range(0, n, 500):
        far = ((data - data[q]) ** 2).sum(axis=1)
        best = np.lexsort((np.arange(n), far))[:10]
        right += len(set(best.tolist()) & set(got[q]))
        assert all(d == pytest.approx(far[i]) for i, d in got[q].items()) and len(got[q]) == 10
    assert right / (10 * n / 500) >= 0.9


def test_cells_in_books(spark):
    """All cells give what all rows give; books stay apart; rows and queries without a usable vector take no part."""
    data = np.random.default_rng(1).normal(size=(300, 4))
    rows = vectors(spark, data, 3).unionByName(spark.createDataFrame([(900, 0, None), (901, 0, [1.0])], "id long, book int, v array<double>"))
    asked = rows.where("id % 10 = 0 OR id > 899").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"), "book")
    cells = retrieval.Cells.fit(rows, "v", cells=12)
    want = sorted(map(tuple, retrieval.knn(rows, asked, "id", "v", 5, by=["book"]).where("query_id < 900").collect()))
    got = sorted(map(tuple, retrieval.knn(rows, asked, "id", "v", 5, by=["book"], cells=cells, probes=12).collect()))
    assert got == want and len(want) == 150
    few = retrieval.knn(rows, asked, "id", "v", 5, by=["book"], cells=cells, probes=2)
    assert 0 < few.count() <= 150 and few.where("rank = 1 AND query_id <> id").count() == 0
    none = retrieval.Cells.fit(rows.where("id > 950"), "v")
    assert retrieval.knn(rows, asked, "id", "v", 5, cells=none).count() == 0


def test_hybrid_with_missing_legs(spark):
    docs = [("b", "chunk", i, i, f"t{i}", f"lamp number {i}", [1.0, float(i)] if i != 2 else None) for i in range(1, 6)] + [("b", "chunk", 9, 1, "odd", "lamp", [1.0])]
    passages, index = generate.assets(spark.createDataFrame(docs, "book_id string, source_type string, source_id long, chapter_idx int, title string, text string, vector array<double>"), None)
    asked = spark.createDataFrame([("b", 1, None, [1.0, 4.0], ["lamp"]), ("b", 2, None, None, ["lamp"]), ("b", 3, 4, [1.0, 4.0], []), ("b", 4, None, [1.0], None)], "book_id string, query_id long, current_idx int, query_vector array<double>, terms array<string>")
    states = {r.query_id: (r.vectors, r.keywords) for r in generate.legs(asked, passages, index).collect()}
    assert states == {1: ("ok", "ok"), 2: ("no vector", "ok"), 3: ("ok", "no terms"), 4: ("ok", "no terms")}
    got = {}
    for r in generate.hybrid(passages, asked, index, 4).collect():
        got.setdefault(r.query_id, []).append(r.source_id)
    assert got[1][0] == 4 and set(got[2]) <= {1, 2, 3, 4, 5, 9} and 2 in {*got[1], *got[2]} and set(got[3]) == {1, 3} and got[4] == [9]
    words = generate.hybrid(None, asked, index, 4, texts=passages)
    assert {r.query_id for r in words.collect()} == {1, 2} and {r.vectors for r in generate.legs(asked, None, None).collect()} == {"no passages"}
    near = generate.hybrid(passages, asked, None, 4, cells=retrieval.Cells.fit(passages, "vector", cells=2))
    assert {r.query_id for r in near.collect()} == {1, 3}
