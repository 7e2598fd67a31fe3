"""Command line: ingest texts into tables, embed, narrate, summarize, export, and show the configuration."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.providers import LeadingGenerator, provider
from .functions.text import content_hash, normalised
from .functions.unicode import nfkc
from .operators import export, ingest, store, tiers
from .operators.lineage import cut
from .plans import stored
from .plans.config import Config, load
from .session import session
from .sources.html import book_texts, read_epub
from .sources.text_files import read_text

log = logging.getLogger("skein")


def library(config: Config, spark: SparkSession) -> store.Tables:
    return stored.library(spark, config.data)


def run_ingest(config: Config, paths: list[str]) -> dict[str, int]:
    """Books, chapters and chunks of new texts; what is there by content hash is left alone."""
    spark = session("skein-ingest")
    own = config.ingest
    texts = read_texts(spark, paths, own.encoding).withColumn("text", normalised(nfkc(F.col("text")) if own.nfkc else F.col("text"), own.compact))
    books = texts.select(F.col("path").alias("source_path"), "text", content_hash("text").alias("book_id"))
    chapters = ingest.chapters(books.dropDuplicates(["book_id"]), "book_id", own.chapter_regex, width=own.fallback_chars)
    chapters = chapters.withColumn("chapter_hash", ingest.chapter_hash(F.col("book_id"), F.col("title"), F.col("body"))).dropDuplicates(["chapter_hash"])
    chunks = ingest.chunks(chapters.withColumnRenamed("idx", "chapter_idx"), ["book_id", "chapter_hash", "chapter_idx", "title"], "body", own.split.size, own.split.overlap, own.split.least)
    tables, counts, new = library(config, spark), {}, {}
    at = tables.version()
    for name, rows, keys in (("chapters", chapters, ["chapter_hash"]), ("chunks", chunks, ["chapter_hash", "idx"])):
        new[name] = cut(store.insert_ignore(tables.read(name) if tables.has(name) else rows.limit(0), rows, keys, keys))
        counts[name] = new[name].count()
    tables.commit(append=new, reads=list(new), at=at)
    return counts


def read_texts(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """path and text of text files and of EPUB containers."""
    books, plain = [p for p in paths if p.lower().endswith(".epub")], [p for p in paths if not p.lower().endswith(".epub")]
    parts = [read_text(spark, plain, encoding)] if plain else []
    parts += [book_texts(read_epub(spark, books)).select("path", "text")] if books else []
    return parts[0].select("path", "text").unionByName(parts[1]) if len(parts) > 1 else parts[0].select("path", "text")


def chapters_of(config: Config, book: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The chapters to work on: of one book or all, in a range that is widened to whole steps."""
    size = config.narration.step_size
    rows = library(config, session("skein")).read("chapters").withColumnRenamed("body", "text")
    rows = rows if book is None else rows.where(F.col("book_id") == book)
    rows = rows if first is None else rows.where(F.col("idx") >= (first - 1) // size * size + 1)
    rows = rows if last is None else rows.where(F.col("idx") <= -(-last // size) * size)
    return rows.select("book_id", F.xxhash64("chapter_hash").alias("chapter_id"), "idx", "title", "text")


def rule_of(config: Config) -> tiers.Tiering:
    n = config.narration
    return tiers.Tiering(enabled=n.tiering, default=n.tier, preset=n.tier, long_every_n=n.long_every_n, long_min_chars=n.long_min_chars, long_keywords=tuple(n.long_keywords))


def run_embed(config: Config) -> int:
    """Vectors and the inverted index of all chunks and narrations; only what is new is embedded, only parts that changed are written."""
    tables = library(config, session("skein-embed"))
    stored.embed(tables, provider(config.providers.embedder, "embedder"))
    return tables.read("passages").count()


def run_narrate(config: Config, book: str | None = None, first: int | None = None, last: int | None = None) -> dict[str, int]:
    """Narrates chapters that were not narrated before; what earlier chapters left behind is known to them."""
    spark = session("skein-narrate")
    n, tables = config.narration, library(config, session("skein-narrate"))
    settings = tiers.tier_settings(spark, n.tiers, {"ratio_low": n.ratio_low, "ratio_high": n.ratio_high, "memory_top_k": n.memory_top_k}, n.tiering)
    run = stored.tell(
        tables, chapters_of(config, book, first, last), rule_of(config), provider(config.providers.generator, "generator"), provider(config.providers.embedder, "embedder"), n.step_size, n.in_order, ttl=config.providers.answer_ttl, every=n.checkpoint_every,
        window=n.recent_window, least=n.evidence_least, snippets=n.evidence_snippets, memory=n.step_memory, settings=settings,
    )
    report = run.report.collect()  # one row a book of this run
    for line in report:
        log.info("%s", line.asDict())
    return {"narrated": sum(r.chapters_processed for r in report), "skipped": sum(r.chapters_skipped for r in report), "chapters": tables.read("narrations").select("chapter_id").distinct().count()}


def run_summarize(config: Config, book: str | None = None) -> dict[str, int]:
    """Summaries level by level; without a generator the first characters stand in."""
    generator = provider(config.providers.generator, "generator") or LeadingGenerator()
    return stored.summarize(library(config, session("skein-summarize")), generator, config.summary.most_chars, config.summary.story, config.providers.answer_ttl, book)


def run_export(config: Config, mode: str = "auto") -> None:
    """Reports of all books that have narrations: a file a chapter, the whole story, characters, timeline, summary and world state."""
    spark = session("skein-export")
    tables = library(config, spark)
    read = tables.read
    rows = read("narrations") if tables.has("narrations") else spark.createDataFrame([], "book_id string")
    if export.export_mode(mode, rows) == "legacy":
        if tables.has("summaries"):
            export.write_files(export.legacy_files(store.latest(read("summaries").where("scope = 'book'"), ["book_id", "summary_type"], ["created_at", "input_hash"])), config.output)
        return
    latest = stored.latest_narrations(tables)
    outputs = read("outputs").select("chapter_id", "prompt_version", "input_hash", "payload_json").dropDuplicates(["chapter_id", "prompt_version", "input_hash"])
    latest = latest.join(outputs, ["chapter_id", "prompt_version", "input_hash"], "left")
    files = export.chapter_files(latest, config.narration.step_size)
    story = export.full_story(files)
    books = latest.groupBy("book_id").agg(F.count("*").alias("n"), F.first("book_id").alias("title"))
    people, plot = read("characters"), read("plot_events")
    table = people.withColumn("canonical_name", F.col("name")).withColumn("aliases_json", F.col("aliases")).withColumn("relationships_json", F.lit(None).cast("string")).withColumn("motivation", F.lit(None).cast("string"))
    world = export.world_state(books, narrations=latest.drop("payload_json"), characters=people, items=read("items"), plot_events=plot, world_facts=read("world_facts"))
    several = [
        files.select("book_id", "filename", "content"),
        story.select("book_id", F.lit("full_story.md"), "content"),
        story.select("book_id", F.lit("story.md"), export.story(F.col("content"))),
        books.select("book_id", F.lit("book_summary.md"), export.book_summary(F.col("title"), F.format_string("共导出 %d 章说书稿。", "n"))),
        books.join(export.characters_table(table), "book_id", "left").select("book_id", F.lit("characters.md"), F.coalesce("content", F.lit(export.NO_CHARACTERS))),
        books.join(export.timeline(plot.withColumn("event_id", F.col("pos"))), "book_id", "left").select("book_id", F.lit("timeline.md"), F.coalesce("content", F.lit(export.NO_EVENTS))),
        world.select("book_id", F.lit("world_state.json"), "content"),
    ]
    out = several[0]
    for part in several[1:]:
        out = out.union(part)
    export.write_files(out, config.output, stale=r"\d{3}(-\d{3})?_.*\.md")


def main(arguments: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    parser = argparse.ArgumentParser(prog="skein", description=__doc__)
    parser.add_argument("--config")
    parser.add_argument("--profile")
    parser.add_argument("--data-dir")
    parser.add_argument("--output-dir")
    parser.add_argument("--chapter-regex")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("config", "embed", "narrate", "storytell", "summarize", "export", "ingest", "run"):
        one = commands.add_parser(name)
        if name in ("ingest", "run"):
            one.add_argument("paths", nargs="+")
        if name in ("narrate", "storytell", "run"):
            one.add_argument("--book-id")
            one.add_argument("--from-chapter", type=int)
            one.add_argument("--to-chapter", type=int)
            one.add_argument("--step-size", type=int)
            one.add_argument("--no-export", action="store_true")
        if name == "summarize":
            one.add_argument("--book-id")
        if name == "export":
            one.add_argument("--mode", default="auto", choices=["auto", "storyteller", "legacy"])
    a = parser.parse_args(arguments)
    given = {k: v for k, v in (("data", a.data_dir), ("output", a.output_dir)) if v}
    given |= {"ingest": {"chapter_regex": a.chapter_regex}} if a.chapter_regex else {}
    given |= {"narration": {"step_size": a.step_size}} if getattr(a, "step_size", None) else {}
    config = load(a.config, a.profile, given)
    if a.command == "config":
        print(json.dumps(asdict(config), ensure_ascii=False, indent=2))
    if a.command in ("ingest", "run"):
        log.info("ingested %s", run_ingest(config, a.paths))
    if a.command in ("embed", "run"):
        log.info("%d passages", run_embed(config))
    if a.command in ("narrate", "storytell", "run"):
        log.info("%s", run_narrate(config, a.book_id, a.from_chapter, a.to_chapter))
    if a.command == "summarize":
        log.info("%s", run_summarize(config, a.book_id))
    if a.command == "export" or a.command in ("storytell", "run") and not a.no_export:
        run_export(config, getattr(a, "mode", "auto"))


if __name__ == "__main__":
    main()
