"""World state as aggregations over ordered claims, snapshots and restores.

A fold over chapters in order becomes one aggregation per table: first and last appearances are minima and maxima, a changed
column is the value of the last change. Where several updates of one character meet in a chapter, each column takes its
own last value; first appearances are minima over all mentions and updates; aliases resolve against all characters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_or_empty


def character_states(mentions: DataFrame, updates: DataFrame, default: str | None = "active") -> DataFrame:
    """Characters from mentions (book_id, chapter_idx, name, canonical) and updates (book_id, chapter_idx, pos, name,
    change_type, after): aliases, first and last chapter, status (`default` before any change), location."""
    seen = mentions.select("book_id", "chapter_idx", F.col("canonical").alias("name"), F.when(F.col("name") != F.col("canonical"), F.col("name")).alias("alias"))
    seen = seen.unionByName(updates.select("book_id", "chapter_idx", "name", F.lit(None).cast("string").alias("alias")))
    base = seen.groupBy("book_id", "name").agg(F.min("chapter_idx").alias("first_chapter_idx"), F.max("chapter_idx").alias("last_chapter_idx"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
    set_ = updates.where(text_or_empty(F.col("after")) != "")

    def last(kind: str) -> object:
        return F.max_by(F.when(F.col("change_type") == kind, F.col("after")), F.when(F.col("change_type") == kind, F.struct("chapter_idx", "pos")))

    changed = set_.groupBy("book_id", "name").agg(last("status").alias("status"), last("location").alias("location"))
    return base.join(changed, ["book_id", "name"], "left").select("book_id", "name", "aliases", "first_chapter_idx", "last_chapter_idx", F.coalesce("status", F.lit(default)).alias("status"), "location")


def item_states(items: DataFrame) -> DataFrame:
    """Items from (book_id, chapter_idx, pos, name, owner, description): last owner and description, first and last chapter."""
    order = F.struct("chapter_idx", "pos")
    return items.where(text_or_empty(F.col("name")) != "").groupBy("book_id", "name").agg(
        F.max_by("owner", order).alias("owner_name"), F.max_by("description", order).alias("description"), F.min("chapter_idx").alias("first_chapter_idx"), F.max("chapter_idx").alias("last_chapter_idx")
    )


def plot_events(events: DataFrame) -> DataFrame:
    """Plot events to append, from events (book_id, chapter_idx, pos, who, what, impact)."""
    who = F.when(text_or_empty(F.col("who")) != "", F.to_json(F.array("who")))
    return events.where(text_or_empty(F.col("what")) != "").select("book_id", "chapter_idx", "pos", F.col("what").alias("event_summary"), who.alias("involved_characters_json"), F.lit("narration_draft").alias("event_type"), F.coalesce("impact", F.lit("")).alias("impact"))


def facts(events: DataFrame, updates: DataFrame, items: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Facts of events, updates and items; the last writer of a key wins. Writers of a chapter come in that order.

    Every update of a character states its status as it then is (`active` before any change), and its location once there is one.
    before: characters (book_id, name, status, location) as they were before these chapters."""
    e = events.where(text_or_empty(F.col("what")) != "").select("book_id", "chapter_idx", F.lit(0).alias("stage"), "pos", F.concat(F.lit("event:"), F.col("chapter_idx"), F.lit(":"), F.left(F.sha2("what", 256), F.lit(12))).alias("fact_key"), F.col("what").alias("fact_value"), F.lit(0.7).alias("confidence"), F.col("what").alias("excerpt"))
    order = F.struct("chapter_idx", "pos")
    set_ = text_or_empty(F.col("after")) != ""

    def last(kind: str) -> Column:
        changed = set_ & (F.lower(F.trim("change_type")) == kind)
        return F.max_by(F.when(changed, F.col("after")), F.when(changed, order))

    cast = updates.groupBy("book_id", "name").agg(F.max(order).alias("at"), F.max_by(F.coalesce("evidence", F.lit("")), order).alias("excerpt"), last("status").alias("status"), last("location").alias("location"))
    if before is not None:
        held = before.select("book_id", "name", F.col("status").alias("held_status"), F.col("location").alias("held_location"))
        cast = cast.join(held, ["book_id", "name"], "left").withColumn("status", F.coalesce("status", "held_status")).withColumn("location", F.coalesce("location", "held_location"))
    cast = cast.withColumn("status", F.coalesce("status", F.lit("active")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.lit(c).alias("confidence")) for k, c in (("status", 0.85), ("location", 0.8))])
    u = cast.select("book_id", "name", "at", "excerpt", F.explode(kinds).alias("k")).where("k.value IS NOT NULL")
    u = u.select("book_id", "at.chapter_idx", F.lit(1).alias("stage"), "at.pos", F.concat(F.lit("character:"), F.col("name"), F.lit(":"), F.col("k.kind")).alias("fact_key"), F.col("k.value").alias("fact_value"), "k.confidence", "excerpt")
    i = items.where((text_or_empty(F.col("name")) != "") & (text_or_empty(F.col("owner")) != "")).select("book_id", "chapter_idx", F.lit(2).alias("stage"), "pos", F.concat(F.lit("item:"), F.col("name"), F.lit(":owner")).alias("fact_key"), F.col("owner").alias("fact_value"), F.lit(0.75).alias("confidence"), F.coalesce(F.nullif(text_or_empty(F.col("description")), F.lit("")), "owner").alias("excerpt"))
    rows = e.unionByName(u).unionByName(i).withColumn("excerpt", F.substring("excerpt", 1, 300))
    return rows.groupBy("book_id", "fact_key").agg(F.max_by(F.struct("fact_value", "confidence", "chapter_idx", "excerpt"), F.struct("chapter_idx", "stage", "pos")).alias("f")).select("book_id", "fact_key", "f.fact_value", "f.confidence", F.col("f.chapter_idx").alias("source_chapter_idx"), F.col("f.excerpt").alias("source_excerpt"))


def world_of(mentions: DataFrame, events: DataFrame, updates: DataFrame, items: DataFrame, before: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The four state tables after the chapters of these rows. before: the tables as the chapters before them left them."""
    if before is None:
        return {"characters": character_states(mentions, updates), "items": item_states(items), "plot_events": plot_events(events), "world_facts": facts(events, updates, items)}
    people, things, keys = character_states(mentions, updates, None), item_states(items), ["book_id", "name"]
    side = lambda old, new: old.select(*new.columns, F.lit(0).alias("side")).unionByName(new.withColumn("side", F.lit(1)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("side"))).alias(c)
    span = [F.min("first_chapter_idx").alias("first_chapter_idx"), F.max("last_chapter_idx").alias("last_chapter_idx")]
    aliases = F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split("aliases", ","))), lambda x: x != ""))), ",").alias("aliases")
    people = side(before["characters"], people).groupBy(*keys).agg(aliases, *span, last("status"), last("location")).withColumn("status", F.coalesce("status", F.lit("active")))
    things = side(before["items"], things).groupBy(*keys).agg(F.max_by(F.struct("owner_name", "description"), "side").alias("x"), *span).select(*keys, "x.*", "first_chapter_idx", "last_chapter_idx")
    plot = plot_events(events)
    known = facts(events, updates, items, before["characters"])
    known = side(before["world_facts"], known).groupBy("book_id", "fact_key").agg(F.max_by(F.struct(*[c for c in known.columns if c not in ("book_id", "fact_key")]), "side").alias("x")).select("book_id", "fact_key", "x.*")
    return {"characters": people, "items": things, "plot_events": before["plot_events"].select(*plot.columns).unionByName(plot), "world_facts": known}


def first_rows(rows: DataFrame, order: Sequence[str], most: int | None) -> DataFrame:
    """The first rows of each book; windows drop the rest before anything is gathered."""
    if most is None:
        return rows
    return rows.withColumn("skein_n", F.row_number().over(W.partitionBy("book_id").orderBy(*order))).where(F.col("skein_n") <= most).drop("skein_n")


def listed(rows: DataFrame, order: Sequence[str], out: str, most: int | None = None) -> DataFrame:
    """book_id and the book's rows, sorted, as an array of structs without book_id."""
    columns = [c for c in rows.columns if c != "book_id"]
    sorted_ = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("row"))))
    return first_rows(rows, order, most).groupBy("book_id").agg(F.transform(sorted_, lambda x: x["row"]).alias(out))


#: Their columns besides book_id.
STATE_COLUMNS = {
    "characters": "name string, aliases string, first_chapter_idx int, last_chapter_idx int, status string, location string",
    "items": "name string, owner_name string, description string, first_chapter_idx int, last_chapter_idx int",
    "plot_events": "chapter_idx int, pos int, event_summary string, involved_characters_json string, event_type string, impact string",
    "world_facts": "fact_key string, fact_value string, confidence double, source_chapter_idx int, source_excerpt string",
}
#: The four tables of a world state and the order of their rows.
STATE_TABLES = {"characters": ["name"], "items": ["name"], "plot_events": ["chapter_idx", "pos"], "world_facts": ["fact_key"]}


def snapshots(**tables: DataFrame) -> DataFrame:
    """book_id, snapshot_json and snapshot_hash from tables by name (those of STATE_TABLES), with all of their rows: equal states have equal hashes."""
    parts = [listed(rows, STATE_TABLES[name], name) for name, rows in sorted(tables.items())]
    both = parts[0]
    for part in parts[1:]:
        both = both.join(part, "book_id", "full")
    return both.select("book_id", F.to_json(F.struct(*sorted(tables))).alias("snapshot_json")).withColumn("snapshot_hash", F.sha2("snapshot_json", 256))


def restored(snapshot: DataFrame, name: str, columns: str) -> DataFrame:
    """Rows of one table of snapshots. columns: its columns as DDL; other fields are ignored and book_id is the snapshot's."""
    return snapshot.select("book_id", F.inline(F.from_json("snapshot_json", f"struct<{name}: array<struct<{columns}>>>")[name]))


def lookup(chapters: DataFrame, characters: DataFrame, items: DataFrame, events: DataFrame, facts_: DataFrame, window: int, most_facts: int = 500) -> DataFrame:
    """What each chapter (book_id, chapter_idx, entities, items_mentioned) knows: rows of characters and items that it names (all of the
    book, if it names none), its recent events, newest first, and the book's first facts; as arrays of structs."""
    from .claims import recent_events

    keys = ["book_id", "chapter_idx"]

    def named(names: str, rows: DataFrame, name: str, out: str) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(name, *[c for c in rows.columns if c not in ("book_id", name)]))).alias(out)
        some = chapters.select(*keys, F.explode(F.array_distinct(names)).alias(name)).join(rows, ["book_id", name]).groupBy(*keys).agg(packed)
        # a book's whole list is made once, however many chapters name nothing
        every = chapters.where(F.coalesce(F.size(names), F.lit(0)) <= 0).select(*keys).join(rows.groupBy("book_id").agg(packed), "book_id")
        return some.unionByName(every)

    recent = recent_events(events, chapters, window)
    columns = [c for c in recent.columns if c not in (*keys, "n")]
    recent = recent.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(*columns).alias("row")))), lambda x: x["row"]).alias("recent_events"))
    out = chapters.select(*keys).join(named("entities", characters, "name", "characters"), keys, "left").join(named("items_mentioned", items, "name", "items"), keys, "left")
    return out.join(recent, keys, "left").join(listed(facts_, ["fact_key"], "facts", most_facts), "book_id", "left")


def replayed(payloads: DataFrame, upto: int, after: int = 0) -> dict[str, DataFrame]:
    """State tables rebuilt from stored outputs (book_id, chapter_idx, payload_json) of the chapters in (after, upto]: events, updates,
    items and mentions, ready for the transitions above. Only the known fields of a payload are read."""
    schema = "entities_mentioned array<string>, key_events array<struct<who:string,what:string,impact:string>>, character_updates array<struct<name:string,name_raw:string,change_type:string,after:string,evidence:string>>, new_items array<struct<name:string,owner:string,description:string>>"
    parsed = payloads.where((F.col("chapter_idx") > after) & (F.col("chapter_idx") <= upto)).select("book_id", "chapter_idx", F.from_json("payload_json", schema).alias("p"))
    out = {name: parsed.select("book_id", "chapter_idx", F.posexplode(f"p.{field}").alias("pos", "x")).select("book_id", "chapter_idx", "pos", "x.*") for name, field in (("events", "key_events"), ("updates", "character_updates"), ("items", "new_items"))}
    return out | {"mentions": parsed.select("book_id", "chapter_idx", F.explode("p.entities_mentioned").alias("name"))}


def clear_book(table: DataFrame, book_id: object) -> DataFrame:
    return table.where(~F.col("book_id").eqNullSafe(F.lit(book_id)))


def size_bins(items: DataFrame, keys: list[str], order: str, size: str, most: int) -> DataFrame:
    """In-order bins: a bin closes when the next item would take it over `most`. keys, order and `bin`, from 1.

    One pass over each key's sizes in order; only they travel, 16 bytes an item."""
    rows = items.select(*keys, F.col(order).cast("bigint").alias(order), F.col(size).cast("long").alias("skein_size"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("bin", T.IntegerType())])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        out, bin_, fill = [], 1, 0
        for n in table.column("skein_size").to_pylist():
            if fill > 0 and fill + n > most:
                bin_, fill = bin_ + 1, 0
            fill += n
            out.append(bin_)
        return table.drop_columns(["skein_size"]).append_column("bin", pa.array(out, pa.int32()))

    return rows.groupBy(*keys).applyInArrow(fold, schema)
