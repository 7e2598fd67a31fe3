"""Snapshots hold every row of a book."""

from pyspark.sql import functions as F

from skein.operators import state


def test_books_of_very_many_facts_come_back_whole(spark):
    facts = spark.range(10_050).select((F.col("id") % 10_030 > 0).cast("int").alias("book_id"), F.format_string("event:%08d", "id").alias("fact_key"), F.col("id").cast("string").alias("fact_value"))
    back = state.restored(state.snapshots(world_facts=facts), "world_facts", "fact_key string, fact_value string")
    assert back.count() == 10_050 and back.exceptAll(facts).isEmpty() and facts.exceptAll(back).isEmpty()
