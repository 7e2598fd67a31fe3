"""Batches of a stream as versions of tables: once each, and the same state however the input is cut."""

import json

import pytest
from pyspark.sql import functions as F

from skein.operators.state import STATE_COLUMNS
from skein.operators.store import Tables
from skein.streaming.streams import OUTPUT, published, world_tables


def output(book, chapter, created=0.0, **fields):
    return (book, chapter, json.dumps(fields), created)


def books():
    """Two books of six chapters; people move, change and hand things on."""
    rows = []
    for book in (1, 2):
        for i in range(1, 7):
            name = f"p{i % 3}"
            rows.append(output(book, i, entities_mentioned=[name, "q"], key_events=[{"who": name, "what": f"{name} acts in {i}", "impact": ""}],
                               character_updates=[{"name": name, "change_type": "status" if i % 2 else "location", "after": f"x{i}", "evidence": "e"}],
                               new_items=[{"name": "ring", "owner": name, "description": f"d{i}"}] if i % 2 else []))
    return rows


def run(spark, folder, batches, name="told"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, OUTPUT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        tables = Tables(spark, f"{folder}/out")
        stream = spark.readStream.schema(OUTPUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        published(stream, tables, name, world_tables(tables, 4), f"{folder}/checkpoint").awaitTermination()
        assert tables.batch(name) == i
    return Tables(spark, f"{folder}/out")


def content(tables):
    return {name: sorted(tables.read(name).drop("part").collect(), key=str) for name in STATE_COLUMNS}


def test_any_cut_gives_one_state(spark, tmp_path):
    rows = books()
    whole = run(spark, str(tmp_path / "a"), [rows])
    want = content(whole)
    assert [len(want[x]) for x in ("characters", "items", "plot_events")] == [8, 2, 12]
    ordered = run(spark, str(tmp_path / "b"), [[r for r in rows if r[1] <= 2], [r for r in rows if r[1] > 2]])
    assert content(ordered) == want
    stale = output(1, 4, -1.0, key_events=[{"who": "z", "what": "was told otherwise", "impact": ""}])
    late = run(spark, str(tmp_path / "c"), [[r for r in rows if r[0] == 2 or r[1] in (3, 5, 6)] + [stale], [r for r in rows if r[0] == 1 and r[1] in (1, 2, 4)]])
    assert content(late) == want
    hashes = lambda t: {r.book_id: r.snapshot_hash for r in t.read("snapshots").where("chapter_idx = 6").groupBy("book_id").agg(F.max_by("snapshot_hash", F.length("snapshot_json")).alias("snapshot_hash")).collect()}
    assert hashes(late) == hashes(ordered) == hashes(whole)


def test_batches_are_published_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    rows = spark.createDataFrame([(1,)], "x int")
    first = tables.commit(append={"t": rows}, batch=("s", 0))
    assert tables.commit(append={"t": rows}, batch=("s", 0)) == first and tables.read("t").count() == 1
    tables.commit(append={"t": rows})  # commits of others keep the number
    assert tables.batch("s") == 0 and tables.batch("other") == -1
    tables.commit(append={"t": rows}, batch=("other", 0))
    tables.commit(append={"t": rows}, batch=("s", 1))
    assert tables.read("t").count() == 4 and tables.batch("s") == 1


def test_a_batch_that_dies_is_run_again(spark, tmp_path):
    """The stream's own checkpoint knows nothing of what the batch has published."""
    rows, folder = books(), str(tmp_path)
    spark.createDataFrame(rows, OUTPUT).coalesce(1).write.parquet(f"{folder}/in")
    tables = Tables(spark, f"{folder}/out")
    plain, calls = tables.commit, []

    def dies(**how):
        calls.append(plain(**how))
        raise OSError("the driver is gone")

    tables.commit = dies
    stream = spark.readStream.schema(OUTPUT).parquet(f"{folder}/in")
    with pytest.raises(Exception, match="the driver is gone"):
        published(stream, tables, "told", world_tables(tables, 4), f"{folder}/checkpoint").awaitTermination()
    again = Tables(spark, f"{folder}/out")
    published(stream, again, "told", world_tables(again, 4), f"{folder}/checkpoint").awaitTermination()
    assert len(calls) == 1 and again.versions() == calls and again.read("outputs").count() == 12
