"""Written tables leave nothing behind: neither shuffle files nor settings."""

import os
import time

from pyspark.sql import functions as F

from skein.operators import lineage


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f"{at}/{f}" for d in dirs for at, _, held in os.walk(d.getPath()) for f in held if f.startswith("shuffle_")}


def test_shuffle_files_of_a_write_go_with_it(spark):
    before = shuffle_files(spark)
    rows = spark.range(50_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.max("id").alias("m"))
    out = lineage.cut(rows)
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(lineage.SWEEP) == "false" and out.count() == 7_000 and rows.count() == 7_000


def test_spent_tables_of_a_join_go(spark, monkeypatch):
    """The sketch and its keys, the largest tables of the join, are gone when it returns."""
    from skein.llm import jaccard_join

    gone = []
    monkeypatch.setattr(jaccard_join, "drop", lambda df: gone.append(set(df.columns)) or lineage.drop(df), raising=False)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 5, 60))) for i in range(20)], "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs)
    assert any("keys" in c for c in gone) and any("df" in c for c in gone)
    assert {r.component_id for r in found.collect()} == {0}
