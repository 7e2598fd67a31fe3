"""Claims: consistency with what is known, and support by sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import EVIDENCE_TOKEN, json_list, matches, name_key, strip, text_or_empty

MOST_EVENTS, LEAST_SUPPORT = 20, 0.18


def claim_text(*parts: str) -> Column:
    """Non-empty parts joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(text_or_empty(F.col(p)), F.lit("")) for p in parts])


def consistent_events(events: DataFrame, recent: DataFrame) -> DataFrame:
    """Events (book_id, chapter_idx, pos, what) whose text is new: not empty, first of its chapter, not among
    recent events (book_id, chapter_idx, event_summary), and the chapter's first twenty."""
    known = recent.select("book_id", "chapter_idx", text_or_empty(F.col("event_summary")).alias("what")).distinct()
    clean = events.withColumn("what", text_or_empty(F.col("what"))).where("what <> ''")
    first = W.partitionBy("book_id", "chapter_idx", "what").orderBy("pos")
    new = clean.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").join(known, ["book_id", "chapter_idx", "what"], "left_anti")
    order = W.partitionBy("book_id", "chapter_idx").orderBy("pos")
    return new.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_EVENTS).drop("n")


def first_events(events: DataFrame) -> DataFrame:
    """Events (book_id, chapter_idx, pos, what) that are not empty, each text once a chapter, by its first place."""
    clean = events.withColumn("what", text_or_empty(F.col("what"))).where("what <> ''")
    first = W.partitionBy("book_id", "chapter_idx", "what").orderBy("pos")
    return clean.withColumn("skein_n", F.row_number().over(first)).where("skein_n = 1").drop("skein_n")


def spaced_events(events: DataFrame, window: int, past: DataFrame | None = None) -> DataFrame:
    """consistent_events() where the known events are those of this very run: an event is kept unless an equal one was stored in the
    `window` chapters before. One fold over the chapters of each text, in order; of a text it holds a number a chapter.

    Events may have `stored`: false for those that will not be (without support); they hold back no later ones. past (book_id,
    chapter_idx, what): what earlier runs stored."""
    first = first_events(events)
    seen = first.select("book_id", "what", F.col("chapter_idx").cast("int").alias("idx"), *[F.col("stored") if "stored" in events.columns else F.lit(True).alias("stored")], F.lit(False).alias("old"))
    if past is not None:
        old = past.select("book_id", text_or_empty(F.col("what")).alias("what"), F.col("chapter_idx").cast("int").alias("idx"), F.lit(True).alias("stored"), F.lit(True).alias("old")).where("what <> ''")
        seen = seen.unionByName(old.join(first.select("book_id", "what").distinct(), ["book_id", "what"], "left_semi").distinct())
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        far = acc["last"].isNull() | (x["idx"] - acc["last"] > window)
        last = F.when(x["old"] | (far & x["stored"]), x["idx"]).otherwise(acc["last"])
        return F.struct(last.alias("last"), F.when(far & ~x["old"], F.concat(acc["kept"], F.array(x["idx"]))).otherwise(acc["kept"]).alias("kept"))

    kept = seen.groupBy("book_id", "what").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("idx", "old", "stored"))), start, step)["kept"].alias("kept"))
    kept = kept.select("book_id", "what", F.explode("kept").alias("chapter_idx"))
    new = first.join(kept, ["book_id", "what", "chapter_idx"], "left_semi")
    order = W.partitionBy("book_id", "chapter_idx").orderBy("pos")
    return new.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_EVENTS).drop("n").select(*events.columns)


def with_evidence(claims: DataFrame, scored: DataFrame, keys: list[str], least: float = LEAST_SUPPORT) -> DataFrame:
    """The claims (keys) that are supported by `least` or more, with evidence_source_type, evidence_quote and evidence_score."""
    good = scored.where(F.col("score") >= least).select(*keys, F.col("source_type").alias("evidence_source_type"), F.col("quote").alias("evidence_quote"), F.col("score").alias("evidence_score"))
    return claims.join(good, keys)


def recent_events(events: DataFrame, chapters: DataFrame, window: int, most: int = 20) -> DataFrame:
    """For each chapter (book_id, chapter_idx) the last events of the `window` chapters before it; newest first.

    Each event is sent to the chapters that can see it, at most `window`, so the join is by equality."""
    width = max(window, 1)
    seen = events.withColumnRenamed("chapter_idx", "event_idx").withColumn("chapter_idx", F.explode(F.sequence(F.col("event_idx") + 1, F.col("event_idx") + width)))
    seen = seen.where((F.col("event_idx") >= 1)).join(chapters.select("book_id", "chapter_idx").distinct(), ["book_id", "chapter_idx"])
    order = W.partitionBy("book_id", "chapter_idx").orderBy(F.desc("event_idx"), F.desc("event_id"))
    return seen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def alias_table(characters: DataFrame) -> DataFrame:
    """book_id, key, canonical: keys of names and aliases; the last character, then the last alias, wins a key."""
    names = characters.select("book_id", "character_id", F.posexplode(F.concat(F.array("canonical_name"), json_list(F.col("aliases_json")))).alias("pos", "name"), F.col("canonical_name").alias("canonical"))
    names = names.withColumn("key", name_key(F.col("name"))).where("canonical <> ''")
    return names.groupBy("book_id", "key").agg(F.max_by("canonical", F.struct("character_id", "pos")).alias("canonical"))


def resolved(rows: DataFrame, characters: DataFrame, name: str, out: str) -> DataFrame:
    """rows with the canonical name of `name` in `out`; unknown names stay."""
    keyed = rows.withColumn("key", name_key(F.col(name)))
    known = alias_table(characters).withColumnRenamed("canonical", "skein_canonical")
    return keyed.join(known, ["book_id", "key"], "left").withColumn(out, F.coalesce("skein_canonical", name)).drop("key", "skein_canonical")


def consistent_updates(updates: DataFrame, characters: DataFrame) -> DataFrame:
    """Updates with canonical names and a change type (default `status`); nameless ones and those that change nothing go."""
    for c in ("name", "change_type", "before", "after", "evidence"):
        updates = updates.withColumn(c, text_or_empty(F.col(c)))
    named = resolved(updates.where("name <> ''").withColumnRenamed("name", "name_raw"), characters, "name_raw", "name")
    named = named.withColumn("change_type", F.when(F.col("change_type") == "", F.lit("status")).otherwise(F.col("change_type")))
    return named.where(~((F.col("before") != "") & (F.col("before") == F.col("after"))))


def supported(claims: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Best support of each claim (keys, claim_id, claim, phrases) among the sources (keys, pos, source_type, source):
    claim_id, score, source_type, quote.

    A source that contains a phrase or the claim scores 1 and the first such source wins; else the share of the claim's tokens that
    the source has, the first source on ties. Claims and sources meet by key; sources of a key are few by design."""
    return best_support(evidence_tokens(claims, "claim").join(evidence_tokens(sources.where("source <> ''"), "source"), keys, "left"), keys)


def evidence_tokens(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(f"{column}_tokens", F.array_distinct(matches(F.col(column), EVIDENCE_TOKEN)))


def best_support(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """supported() of claims that have met their sources: a row per claim (with claim_tokens) and source (with source_tokens), or none."""
    phrase = F.exists("phrases", lambda p: (strip(p) != "") & F.contains(F.col("source"), strip(p)))
    hit = (F.col("claim") != "") & F.col("source").isNotNull() & (phrase | F.contains(F.col("source"), F.col("claim")))
    share = F.size(F.array_intersect("claim_tokens", "source_tokens")) / F.greatest(F.size("claim_tokens"), F.lit(1))
    score = F.when(hit, F.lit(1.0)).when((F.col("claim") == "") | F.col("source").isNull(), F.lit(0.0)).otherwise(share)
    # only short columns are sorted and sent, not the sources
    scored = pairs.select(*keys, "claim_id", "pos", "source_type", strip(F.substring("source", 1, 120)).alias("quote"), F.coalesce(hit, F.lit(False)).alias("hit"), score.alias("score"))
    best = scored.groupBy(*keys, "claim_id").agg(F.max_by(F.struct("score", "source_type", "quote"), F.struct("hit", "score", F.negative("pos"))).alias("b"))
    some = F.col("b.score") > 0
    return best.select(*keys, "claim_id", F.round("b.score", 4).alias("score"), F.when(some, F.col("b.source_type")).otherwise("").alias("source_type"), F.when(some, F.col("b.quote")).otherwise("").alias("quote"))


def evidence_report(scored: DataFrame, keys: list[str], least: float = LEAST_SUPPORT) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count("*").alias("total_claims"), F.count_if(F.col("score") >= least).alias("supported_claims"), F.count_if(F.col("score") < least).alias("unsupported_claims"))
