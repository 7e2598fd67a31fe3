"""The library on disk: chapters, chunks, passages with their index, narrations, outputs, state and answers, as Tables that change together.

Every step reads one version and publishes one. Passages and postings lie in parts by a hash of their book: a step replaces the parts
in which a book has changed and leaves the other parts' files alone. The state of a book goes on from its last checkpoint
before the first chapter that a run narrates; checkpoints from there on are dropped, as what they hold may have changed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.providers import Embedder, Generator, with_embeddings
from ..operators import claims, retrieval, state, store, tiers
from ..operators.lineage import cut
from .narrate import Run, narrate, narrate_in_order
from .summarize import summarised

PARTS = 256
PARTITIONS = {"passages": "part", "postings": "part", "sizes": "part"}
CHECKPOINTS = "book_id {book}, chapter_idx int, snapshot_json string, snapshot_hash string"
ANSWERS = "key string, value string, created_at timestamp"


def library(spark: SparkSession, path: str) -> store.Tables:
    return store.Tables(spark, path, PARTITIONS)


def with_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("book_id"), F.lit(PARTS)).cast("int"))


def latest_narrations(tables: store.Tables) -> DataFrame:
    return store.latest(tables.read("narrations"), ["chapter_id"], ["narrated_at", "input_hash"])


def latest_outputs(outputs: DataFrame) -> DataFrame:
    """The output of each chapter that stands; of a chapter narrated again the last one."""
    return store.latest(outputs, ["chapter_id"], ["narrated_at", "input_hash"])


def corpus_of(tables: store.Tables) -> DataFrame:
    """What retrieval searches: all chunks, and the narration of each chapter that stands."""
    chunks = tables.read("chunks").select("book_id", F.lit("chunk").alias("source_type"), F.xxhash64("chapter_hash", "idx").alias("source_id"), "chapter_idx", "title", F.col("chunk_text").alias("text"))
    if not tables.has("narrations"):
        return chunks
    told = latest_narrations(tables).where("narration_text <> ''")
    return chunks.unionByName(told.select("book_id", F.lit("narration").alias("source_type"), F.xxhash64("chapter_id", "input_hash").alias("source_id"), "chapter_idx", "title", F.col("narration_text").alias("text")))


def embed(tables: store.Tables, embedder: Embedder) -> int:
    """Brings passages, vectors and postings up to date and returns how many parts it wrote. Only passages that were not there are embedded, and only
    parts in which one came or went are written."""
    at = tables.version()
    corpus = with_part(corpus_of(tables))
    keys = ["part", "source_type", "source_id"]
    if tables.has("passages"):
        old = tables.read("passages")
        changed = corpus.select(*keys).exceptAll(old.select(*keys)).unionByName(old.select(*keys).exceptAll(corpus.select(*keys))).select("part").distinct()
        parts = sorted(r.part for r in changed.toLocalIterator())  # at most PARTS
        if not parts:
            return 0
        corpus, old = corpus.where(F.col("part").isin(parts)), old.where(F.col("part").isin(parts))
        new = corpus.join(old.select(*keys), keys, "left_anti")
        held = corpus.join(old.select(*keys, "vector"), keys)
        passages = cut(held.select(*corpus.columns, "vector").unionByName(with_embeddings(new, "text", embedder).select(*corpus.columns, "vector")))
    else:
        passages, parts = cut(with_embeddings(corpus, "text", embedder)), list(range(PARTS))
    text, keep = ["title", "text"], ["part", "book_id", "chapter_idx", "source_type"]
    postings = retrieval.postings(passages, "source_id", *text, keep=keep)
    sizes = retrieval.document_sizes(passages, "source_id", *text, keep=keep).groupBy("part", "source_type").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    rows = {"passages": passages, "postings": postings, "sizes": sizes}
    if tables.has("passages"):
        tables.commit(swap=rows, reads=["chunks", *rows], at=at, parts=parts)
    else:
        tables.commit(replace=rows, reads=["chunks"], at=at)
    return len(parts)


def index_of(tables: store.Tables) -> tuple[DataFrame, retrieval.Index] | None:
    """The stored passages and their inverted index; statistics are sums over the parts. None before the first embed()."""
    if not tables.has("passages"):
        return None
    stats = tables.read("sizes").groupBy(F.col("source_type").alias("skein_kind")).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    return tables.read("passages").drop("part"), retrieval.Index(tables.read("postings").drop("part"), stats, "source_id", ["book_id", "chapter_idx", "source_type"], "source_type")


def world_at(outputs: DataFrame, checkpoints: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The state tables of books: their last checkpoint, and on top of it what the outputs of later chapters say. Earlier outputs are not parsed."""
    last = cut(store.latest(checkpoints, ["book_id"], ["chapter_idx"]))
    before = {name: state.restored(last, name, columns) for name, columns in state.STATE_COLUMNS.items()}
    later = outputs.join(last.select("book_id", F.col("chapter_idx").alias("held_idx")), "book_id", "left").where("held_idx IS NULL OR chapter_idx > held_idx")
    back = state.replayed(later, (1 << 31) - 1)
    mentions = back["mentions"].withColumn("canonical", F.col("name")) if known is None else claims.resolved(back["mentions"], known, "name", "canonical")
    return {name: cut(rows) for name, rows in state.world_of(mentions, back["events"], back["updates"], back["items"], before).items()}


def tell(tables: store.Tables, chapters: DataFrame, rule: tiers.Tiering, generator: Generator | None = None, embedder: Embedder | None = None, step_size: int = 1, in_order: bool = False, known: DataFrame | None = None, ttl: float = 0, every: int = 1, **how: object) -> Run:
    """Narrates chapters that were not narrated before and publishes narrations, outputs, answers, state and a checkpoint as one version.

    Chapters need not be all of their book: retrieval reads the stored index, and what earlier chapters left in the state is known. in_order:
    prompts hold what is known, step after step. ttl: seconds after which stored answers are asked again (0: never). every: the least
    number of chapters between the checkpoint before a run and a new one."""
    spark, at = tables.spark, tables.version()
    book = chapters.schema["book_id"].dataType.simpleString()
    done = tables.read("narrations") if tables.has("narrations") else None
    chapters = cut(chapters)
    first = chapters.groupBy("book_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    outputs = tables.read("outputs") if tables.has("outputs") else None
    checkpoints = tables.get("checkpoints", CHECKPOINTS.format(book=book))
    valid = checkpoints.join(first, "book_id", "left").where("first IS NULL OR chapter_idx < first").select(*checkpoints.columns)
    world: Mapping[str, DataFrame] | None = None
    if outputs is not None:
        earlier = latest_outputs(outputs).join(first, "book_id").where("chapter_idx < first").select(*outputs.columns)
        world = world_at(earlier, valid.join(first, "book_id", "left_semi"), known)
    cache = fresh_answers(tables, ttl)
    run = (narrate_in_order if in_order else narrate)(chapters, rule, generator=generator, cache=cache, embedder=embedder, known=known, done=done, step_size=step_size, world=world, index=index_of(tables), **how)
    now = F.current_timestamp()
    narrations, new = cut(run.narrations.withColumn("narrated_at", now)), cut(run.outputs.withColumn("narrated_at", now))
    answers = cut(run.answers.withColumn("created_at", now))

    # the books of this run anew, from their checkpoints before it; all others as they are
    both = latest_outputs(new if outputs is None else outputs.unionByName(new)).join(first, "book_id", "left_semi")
    own = valid.join(first, "book_id", "left_semi")
    after = world_at(both, own, known)
    swapped = {}
    for name, rows in after.items():
        others = tables.read(name).join(first.select("book_id"), "book_id", "left_anti") if tables.has(name) else rows.limit(0)
        swapped[name] = others.select(*rows.columns).unionByName(rows)
    ends = both.groupBy("book_id").agg(F.max("chapter_idx").cast("int").alias("chapter_idx")).join(own.groupBy("book_id").agg(F.max("chapter_idx").alias("held")), "book_id", "left").where(F.col("held").isNull() | (F.col("chapter_idx") - F.col("held") >= every)).drop("held")
    snapshots = state.snapshots(**after).join(ends, "book_id").select(*checkpoints.columns)
    swapped["checkpoints"] = valid.unionByName(snapshots)
    tables.commit(append={"narrations": narrations, "outputs": new, "answers": answers}, replace=swapped, reads=["outputs", "narrations"], at=at)
    return run


def fresh_answers(tables: store.Tables, ttl: float) -> DataFrame:
    """Stored answers that may be used (key, value): the newest of each key, if it is not older than ttl seconds."""
    held = tables.get("answers", ANSWERS).select("key", F.unix_timestamp("created_at").cast("double").alias("created_at"), "value")
    return store.unexpired(held, F.unix_timestamp(F.current_timestamp()).cast("double"), ttl).select("key", "value")


def summarize(tables: store.Tables, generator: Generator, most: int = 12_000, story: bool = True, ttl: float = 0, book: object = None) -> dict[str, int]:
    """Summaries of all books, or of one, from their stored chunks; only what changed since is asked. Returns rows and new answers."""
    at = tables.version()
    chunks = tables.read("chunks").withColumn("chapter_id", F.xxhash64("chapter_hash"))
    chunks = chunks if book is None else chunks.where(F.col("book_id").eqNullSafe(F.lit(book)))
    rows, new = summarised(chunks, generator, fresh_answers(tables, ttl), most, story)
    now = F.current_timestamp()
    rows, new = cut(rows.withColumn("created_at", now)), cut(new.withColumn("created_at", now))
    kept = rows.limit(0) if not tables.has("summaries") else tables.read("summaries").join(chunks.select("book_id").distinct(), "book_id", "left_anti")
    tables.commit(append={"answers": new}, replace={"summaries": kept.select(*rows.columns).unionByName(rows)}, reads=["chunks"], at=at)
    return {"summaries": rows.count(), "asked": new.count()}


def forget_answers(tables: store.Tables, ttl: float) -> None:
    """Deletes stored answers that are older than ttl seconds."""
    if tables.has("answers") and ttl > 0:
        fresh = tables.read("answers").where(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("created_at") <= ttl)
        tables.commit(replace={"answers": fresh})


def clear_book(tables: store.Tables, book_id: object) -> None:
    """Takes a book out of every table, in one version; parts of passages and postings without it stay as they are."""
    at, replace, swap = tables.version(), {}, {}
    for name in tables.state():
        if name == "answers":
            continue
        rows = tables.read(name)
        if name == "sizes":
            continue
        if name in PARTITIONS:
            part = rows.where(F.col("book_id").eqNullSafe(F.lit(book_id))).select("part").distinct()
            swap[name] = state.clear_book(rows.join(part, "part", "left_semi"), book_id).select(*rows.columns)
        else:
            replace[name] = state.clear_book(rows, book_id)
    if "passages" in swap:
        swap = {name: cut(rows) for name, rows in swap.items()}
        swap["sizes"] = retrieval.document_sizes(swap["passages"], "source_id", "title", "text", keep=["part", "source_type"]).groupBy("part", "source_type").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        spark = tables.spark
        parts = [r.part for r in spark.createDataFrame([(book_id,)], tables.read("passages").select("book_id").schema).transform(with_part).collect()]
        tables.commit(replace=replace, swap=swap, at=at, parts=parts)
    else:
        tables.commit(replace=replace, at=at)
