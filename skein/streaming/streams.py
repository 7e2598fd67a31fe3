"""Structured Streaming forms of the ordered loop: steps as windows, idempotent ingestion, and state per book."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lineage import cut
from ..operators.state import STATE_COLUMNS, replayed, snapshots, world_of
from ..operators.store import Tables, latest


def steps(events: DataFrame, time: str = "ts", width: str = "5 days", late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts and sums of value per step of time and kind; rows later than `late` behind the newest are dropped."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("step_start"), F.col("window.end").alias("step_end"), by, "n", "total")


def fresh(rows: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each content hash; a re-run of the same input adds nothing within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


STATE = "first_idx int, last_idx int, n long, value string"
OUT = "book_id long, fact_key string, first_idx int, last_idx int, n long, value string"


def folded_state(events: DataFrame) -> DataFrame:
    """Per book and fact: first and last chapter, count and last value, kept between batches. events: book_id, fact_key, chapter_idx, value."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, value = state.get if state.exists else (None, None, 0, None)
        for b in batches:
            b = b.sort_values("chapter_idx", kind="stable")
            low, high = int(b.chapter_idx.iloc[0]), int(b.chapter_idx.iloc[-1])
            value = str(b.value.iloc[-1]) if last is None or high >= last else value
            first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(b)
        state.update((first, last, n, value))
        yield pd.DataFrame([(*key, first, last, n, value)], columns=["book_id", "fact_key", "first_idx", "last_idx", "n", "value"])

    return events.groupBy("book_id", "fact_key").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def published(stream: DataFrame, tables: Tables, name: str, changes: Callable[[DataFrame, int | None], dict], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch as one version of `tables`, published once: a batch that is run again after a crash changes nothing.

    changes: from the rows of a batch and the version they meet (None before the first) to the arguments of Tables.commit()."""

    def write(batch: DataFrame, number: int) -> None:
        if tables.batch(name) < number:
            at = tables.version()
            tables.commit(**changes(batch, at), at=at, batch=(name, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


OUTPUT = "book_id long, chapter_idx int, payload_json string, created_at double"


def world_tables(tables: Tables, parts: int = 64) -> Callable[[DataFrame, int | None], dict]:
    """For published(): stored outputs (columns of OUTPUT) folded into the four state tables, and a snapshot of each book of the batch.

    A book whose chapters all follow those before is folded onto its state; one with an earlier or repeated chapter is folded anew from all
    of its outputs, of which each chapter's last counts (by created_at, then payload). So batches in any order and cut give the same state.
    `tables` are those of the stream alone. They are partitioned by a hash of the book: of `parts` parts only those of the batch's books are
    read and written, and only these books are computed."""
    tables.partitions.update({name: "part" for name in ("outputs", *STATE_COLUMNS)})
    part = F.pmod(F.xxhash64("book_id"), F.lit(parts)).cast("int").alias("part")

    def changes(batch: DataFrame, at: int | None) -> dict:
        spark = batch.sparkSession
        old = lambda name, schema: tables.read(name, at) if at is not None and tables.has(name, at) else spark.createDataFrame([], schema)
        new = cut(batch.select("book_id", F.col("chapter_idx").cast("int").alias("chapter_idx"), "payload_json", F.col("created_at").cast("double").alias("created_at")).where("book_id IS NOT NULL AND chapter_idx IS NOT NULL"))
        touched = [r.part for r in new.select(part).distinct().collect()]  # at most `parts`
        held = old("outputs", f"{OUTPUT}, part int").where(F.col("part").isin(touched)).drop("part")
        last = held.groupBy("book_id").agg(F.max("chapter_idx").alias("last"))
        books = cut(new.groupBy("book_id").agg(F.min("chapter_idx").alias("first")).join(last, "book_id", "left").select("book_id", (F.col("first") <= F.col("last")).alias("late")))
        again = books.where("late").select("book_id")
        rows = cut(latest(new.unionByName(held.join(again, "book_id", "left_semi")), ["book_id", "chapter_idx"], ["created_at", "payload_json"]))
        before = {name: old(name, f"book_id long, {columns}, part int").where(F.col("part").isin(touched)).drop("part") for name, columns in STATE_COLUMNS.items()}
        parsed = replayed(rows, 2**31 - 1)
        mentions = parsed["mentions"].withColumn("canonical", F.col("name"))
        mine = {name: table.join(books.where("NOT coalesce(late, false)"), "book_id", "left_semi") for name, table in before.items()}
        world = {name: cut(table) for name, table in world_of(mentions, parsed["events"], parsed["updates"].where("name IS NOT NULL"), parsed["items"], mine).items()}
        whole = {name: before[name].join(books, "book_id", "left_anti").select(*world[name].columns).unionByName(world[name]).select("*", part) for name in world}
        taken = snapshots(**world).join(rows.groupBy("book_id").agg(F.max("chapter_idx").alias("chapter_idx")), "book_id")
        return {"append": {"outputs": new.select("*", part), "snapshots": taken.select("book_id", "chapter_idx", "snapshot_hash", "snapshot_json")}, "swap": whole, "parts": touched, "reads": ["outputs"]}

    return changes


def checkpointed(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True):  # noqa: ANN201
    """Appends each batch once to a Parquet folder, with the query's own checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
