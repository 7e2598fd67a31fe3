"""What near duplicates write to disk: keys in rounds, and texts only where they may be needed."""

import os
import random

import pytest

from skein.llm import jaccard_join as J

FOLDER = "/root/testdata/sf0.001"


def written(spark):
    """Shuffle bytes of each stage so far."""
    gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_without_copies_are_not_shuffled(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(160):x}" for _ in range(200)) for _ in range(1500)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(10_000 + i, texts[i]) for i in range(20)] + [(20_000 + i, texts[i] + " tail") for i in range(20)]
    docs = J.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    before = written(spark)
    kept = J.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(1500))
    most = max(v for k, v in written(spark).items() if k not in before)
    assert most < sum(map(len, texts)) / 4


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_rounds_of_keys_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 9 = 0").selectExpr("doc_id + 3 AS doc_id", "text")).unionByName(docs.where("doc_id < 5").selectExpr("CAST(null AS long) AS doc_id", "text"))
    rows = lambda: sorted(map(str, J.jaccard_components(docs, n=3, percent=60).collect()))
    monkeypatch.setattr(J, "ROUND_BYTES", 1 << 40)
    once = rows()
    monkeypatch.setattr(J, "ROUND_BYTES", 1)
    assert rows() == once and len(once) == docs.count()
