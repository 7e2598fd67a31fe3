"""The narration run: what happens to each chapter, or each step of several chapters, for all of them at once.

Tier and entities, retrieval, generation or draft, consistency, evidence, refinement, state, report. Chapters do not wait for each other:
retrieval has a causal bound, generation is asked per distinct prompt, and what depends on the order of chapters (repeated events,
world state) is an aggregation in that order. Chapters whose input was narrated before are skipped, but stay in what others
retrieve. Only prompts that tell what is known so far need their predecessors: narrate_in_order() runs step after step, all books at a time."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import best_effort, faults
from ..functions.providers import Embedder, Generator, with_embeddings
from ..functions.text import clean_json, content_hash, keyword_terms, strip, text_or_empty
from ..operators import claims, ingest, retrieval, state, store, tiers
from ..operators.lineage import cut
from . import generate

VERSION, STEP_VERSION = "v1", "step_v1"
EVENT = "struct<who:string,what:string,where:string,outcome:string,impact:string>"
UPDATE = "struct<name:string,change_type:string,before:string,after:string,evidence:string>"
ITEM = "struct<name:string,owner:string,description:string>"
ANSWER = f"struct<narration:string,key_events:array<{EVENT}>,character_updates:array<{UPDATE}>,new_items:array<{ITEM}>>"
NAMES = "struct<characters:array<string>,locations:array<string>,items:array<string>>"
MEMORY = "struct<source_type:string,source_id:bigint,chapter_idx:int,text:string>"
NAMED = {"entities": 16, "locations": 16, "items": 16}


@dataclass
class Run:
    """The tables that a run writes. The four state tables are those of the world after it. claims: every claim with its support; report: the
    metrics of each book; answers: what the generator said to new prompts (key, value)."""

    narrations: DataFrame
    outputs: DataFrame
    characters: DataFrame
    items: DataFrame
    plot_events: DataFrame
    world_facts: DataFrame
    claims: DataFrame
    report: DataFrame
    answers: DataFrame

    def world(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in state.STATE_TABLES}


def structured(answer: Column, schema: str) -> Column:
    """An answer's JSON under a schema, fences and noise removed; null where it holds none, so that callers fall back."""
    return F.from_json(clean_json(answer), schema)


def with_entities(chapters: DataFrame, generator: Generator | None, cache: DataFrame | None = None, write: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame | None]:
    """chapters with entities, locations, items, entity_calls and entity_hits, and the cache's new rows. Names come from the generator where
    the tier asks it and it answers with lists of names, else from the text."""
    none, new = F.array().cast("array<string>"), None
    plain = chapters.withColumns({"found": F.lit(None).cast(NAMES), "entity_calls": F.lit(0), "entity_hits": F.lit(0)})
    if generator is not None:
        asked = chapters.where("entity_extract_mode = 'llm'").select("chapter_id", F.concat(F.lit(generate.ENTITY_PROMPT), "text").alias("prompt"))
        asked, new = generate.cached_answers(asked, "prompt", generator, cache, "entity", VERSION, readable=lambda c: F.size(faults(c, NAMES)) == 0, write=write)
        asked = asked.select("chapter_id", structured(F.col("answer"), NAMES).alias("found"), F.lit(1).alias("entity_calls"), F.col("cache_hit").cast("int").alias("entity_hits"))
        plain = chapters.join(asked, "chapter_id", "left").fillna(0, ["entity_calls", "entity_hits"])
    names = lambda field, out, other: F.coalesce(F.when(F.size(f"found.{field}") > 0, generate.clean_names(F.col(f"found.{field}"), NAMED[out])), other).alias(out)
    return plain.select(*chapters.columns, names("characters", "entities", generate.fallback_entities(F.col("text"))), names("locations", "locations", none), names("items", "items", none), "entity_calls", "entity_hits"), new


def passages_of(chapters: DataFrame) -> DataFrame:
    """The chunks of chapters (book_id, chapter_id, idx, title, text) as retrieval's corpus."""
    parts = ingest.chunks(chapters.select("book_id", "chapter_id", F.col("idx").alias("chapter_idx"), "title", "text"), ["book_id", "chapter_id", "chapter_idx", "title"])
    return parts.select("book_id", F.lit("chunk").alias("source_type"), F.xxhash64("chapter_id", "idx").alias("source_id"), "chapter_idx", "title", F.col("chunk_text").alias("text"))


def with_memories(chapters: DataFrame, every: DataFrame, embedder: Embedder | None, held: DataFrame | None, mode: str, size: int, index: tuple[DataFrame, retrieval.Index] | None = None) -> DataFrame:
    """chapters with memories: passages of their own book's earlier chapters, as many as their tier takes, out of the stored index or else
    of `every` chapter and the passages held."""
    none = F.array().cast(f"array<{MEMORY}>")
    if embedder is None or mode == "off" or not chapters.agg(tiers.retrieval_needed(chapters).alias("n")).first().n:
        return chapters.withColumn("memories", none)
    if index is None:
        corpus = passages_of(every)
        index = generate.assets(corpus if held is None else corpus.unionByName(held), embedder)
    asked = chapters.withColumn("query_text", generate.query_text(F.col("idx"), F.col("entities"), F.col("locations"), F.col("items"), F.col("text")))
    asked = generate.step_queries(asked, mode, size)
    terms = keyword_terms(F.col("query_text"), F.concat("entities", "locations", "items")).alias("terms")
    asked = with_embeddings(asked.select("book_id", F.col("chapter_id").alias("query_id"), F.col("idx").alias("current_idx"), "query_text", terms), "query_text", embedder, "query_vector", required=False)
    most = max(row[3] for row in tiers.TIERS)
    hits = generate.memories(generate.hybrid(index[0], asked.drop("query_text"), index[1], most), most)
    taken = hits.join(chapters.select(F.col("chapter_id").alias("query_id"), "memory_top_k"), "query_id").where("rank <= memory_top_k")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.struct("source_type", "source_id", "chapter_idx", "text").alias("m"))))
    lists = taken.groupBy(F.col("query_id").alias("chapter_id")).agg(F.transform(ordered, lambda x: x["m"].cast(MEMORY)).alias("memories"))
    return chapters.join(lists, "chapter_id", "left").withColumn("memories", F.coalesce("memories", none))


def merged_in_order(lists: Column, kind: str, key: Callable[[Column], Column]) -> Column:
    """The members of several lists in order, each key once."""
    flat = F.flatten(lists)
    start = F.array().cast(f"array<{kind}>")
    return F.aggregate(flat, start, lambda kept, x: F.when(F.exists(kept, lambda y: key(x).eqNullSafe(key(y))), kept).otherwise(F.concat(kept, F.array(x))))


def steps_of(chapters: DataFrame, size: int) -> DataFrame:
    """One row a step of `size` chapters, in the place of its last one: texts joined by blank lines, names and memories of all once and in
    order, ratios and tier of the first, what the prompt tells of each, and first_idx, last_idx."""
    columns = [c for c in chapters.columns if c not in ("book_id", "step")]
    rows = chapters.withColumn("step", tiers.step_start(F.col("idx"), size)).groupBy("book_id", "step").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in columns if c != "idx"]))).alias("c"))
    first, last, own = F.col("c")[0], F.element_at("c", -1), {}
    for c in columns:
        own[c] = last[c] if c in ("chapter_id", "idx", "title", "prompt_version", "input_hash") else first[c]
    own["text"] = F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")
    names = lambda c: F.filter(F.flatten(F.transform("c", lambda x: F.transform(x[c], strip))), lambda x: x != "")
    own |= {c: F.array_distinct(names(c)) for c in NAMED}
    own["memories"] = merged_in_order(F.transform("c", lambda x: x["memories"]), MEMORY, lambda m: F.struct(m["source_id"], m["chapter_idx"], m["source_type"]))
    total = lambda c: F.aggregate("c", F.lit(0), lambda n, x: n + x[c])
    own |= {c: total(c) for c in ("entity_calls", "entity_hits")}
    told = lambda x: F.struct(x["idx"].alias("chapter_idx"), x["title"].alias("chapter_title"), x["text"].alias("chapter_text"), x["memories"].alias("memories"), F.array(x["ratio_low"], x["ratio_high"]).alias("narration_ratio"), x["include_key_dialogue"].alias("include_key_dialogue"), x["include_inner_thoughts"].alias("include_inner_thoughts"))
    return rows.select("book_id", *[own[c].alias(c) for c in columns], first["idx"].alias("first_idx"), last["idx"].alias("last_idx"), F.size("c").alias("n_chapters"), F.to_json(F.transform("c", told)).alias("told"))


def prompt(steps: bool) -> Column:
    """What the generator is asked for a chapter, or for a step."""
    share = lambda c: F.floor(F.length("text") * F.col(c)).cast("int")
    known = F.when(F.col("known") == "", F.lit("")).otherwise(F.format_string(generate.KNOWN_PROMPT, "known"))
    if steps:
        return F.format_string(generate.STEP_PROMPT, "first_idx", "last_idx", known, "told")
    earlier = F.array_join(F.transform("memories", lambda m: m["text"]), "\n")
    return F.format_string(generate.NARRATION_PROMPT, "idx", "title", share("ratio_low"), share("ratio_high"), known, earlier, "text")


def with_known(units: DataFrame, world: Mapping[str, DataFrame] | None, window: int) -> DataFrame:
    """units with `known`: JSON of the characters and items that they name, recent events and facts of the world before them, or ''."""
    if world is None:
        return units.withColumn("known", F.lit(""))
    asked = units.select("book_id", F.col("first_idx").alias("chapter_idx"), "entities", F.col("items").alias("items_mentioned"))
    events = world["plot_events"].withColumn("event_id", F.col("pos"))
    found = state.lookup(asked, world["characters"], world["items"], events, world["world_facts"], window)
    names = ["characters", "items", "recent_events", "facts"]
    found = found.select("book_id", F.col("chapter_idx").alias("first_idx"), F.when(F.greatest(*[F.coalesce(F.size(n), F.lit(0)) for n in names]) > 0, F.to_json(F.struct(*names))).otherwise("").alias("known"))
    return units.join(found, ["book_id", "first_idx"], "left").fillna("", ["known"])


def narrate(chapters: DataFrame, rule: tiers.Tiering, generator: Generator | None = None, cache: DataFrame | None = None, embedder: Embedder | None = None, held: DataFrame | None = None, known: DataFrame | None = None, done: DataFrame | None = None, window: int = 5, least: float = claims.LEAST_SUPPORT, snippets: int = 4, memory: str = "per_chapter", step_size: int = 1, write: Callable[[DataFrame], DataFrame] = cut, index: tuple[DataFrame, retrieval.Index] | None = None, world: Mapping[str, DataFrame] | None = None, tell: bool = False, settings: DataFrame | None = None) -> Run:
    """Narrates chapters (book_id, chapter_id, idx, title, text); with a step_size above 1 each step of so many chapters as one.

    generator and cache (key, value): answers as text or as JSON of ANSWER; without them drafts stand in. index: stored passages and inverted
    index for retrieval; without it those of all chapters given and of held (columns of generate.assets). known: characters (book_id,
    character_id, canonical_name, aliases_json) for names. done: narrations of earlier runs (chapter_id, prompt_version, input_hash),
    which are skipped. world: the state tables (state.STATE_TABLES) before the first of these chapters; their events count as recent, and
    the run's own state goes on from them. tell: prompts hold what of it concerns them. settings: the tiers' table."""
    spark, steps = chapters.sparkSession, step_size > 1
    known = known if known is not None else spark.createDataFrame([], chapters.select("book_id").schema.add("character_id", "long").add("canonical_name", "string").add("aliases_json", "string"))
    work = chapters.withColumn("tier", tiers.tier(rule, F.col("idx"), F.col("title"), F.col("text")))
    work = work.withColumn("prompt_version", F.lit(VERSION)).withColumn("input_hash", content_hash(F.col("chapter_id").cast("string"), F.col("idx").cast("string"), "text", "tier", F.lit(generator.name if generator else "draft")))
    identity = ["chapter_id", "prompt_version", "input_hash"]
    if steps:
        at = work.withColumn("step", tiers.step_start(F.col("idx"), step_size))
        hashes = at.groupBy("book_id", "step").agg(F.max("idx").alias("idx"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "input_hash"))), lambda x: x["input_hash"]), "::"), 256).alias("step_hash"))
        work = at.join(hashes.drop("idx"), ["book_id", "step"]).withColumn("input_hash", F.col("step_hash")).withColumn("prompt_version", F.lit(STEP_VERSION)).drop("step_hash", "step")
    skipped = work.limit(0)
    if done is not None:
        seen = done.select(*identity).distinct()
        if steps:  # the last chapter of a step stands for it
            seen = seen.where(F.col("prompt_version") == STEP_VERSION).select("prompt_version", "input_hash").distinct()
        skipped = work.join(seen, seen.columns, "left_semi")
        work = work.join(seen, seen.columns, "left_anti")
    answers = []
    work, new = with_entities(work.join(tiers.tier_table(spark) if settings is None else settings, "tier"), generator, cache, write)
    answers += [new] if new is not None else []
    work = with_memories(write(work), chapters, embedder, held, memory, step_size, index)
    work = steps_of(work, step_size) if steps else work.withColumns({"first_idx": F.col("idx"), "last_idx": F.col("idx"), "n_chapters": F.lit(1), "told": F.lit(None).cast("string")})
    work = write(with_known(write(work) if tell else work, world if tell else None, window))

    # generation: the fields of a JSON answer that fit, or any other answer as the narration, or the draft
    draft = tiers.draft(strip(F.col("text")) if steps else F.col("text"), F.col("ratio_high"))
    asked = work.withColumn("draft", draft)
    if generator is not None:
        asked, new = generate.cached_answers(asked.withColumn("prompt", prompt(steps)), "prompt", generator, cache, "step" if steps else "narration", STEP_VERSION if steps else VERSION, write=write)
        answers.append(new)
        asked = asked.drop("prompt")
    else:
        asked = asked.withColumn("answer", F.lit(None).cast("string")).withColumn("cache_hit", F.lit(False))
    asked = asked.withColumn("b", best_effort(F.col("answer"), ANSWER, "narration"))
    said = F.coalesce(F.nullif(text_or_empty(F.col("b.value.narration")), F.lit("")), F.col("draft"))
    who, where, outcome, impact = (F.lit(x) for x in generate.FALLBACK_EVENT)
    event = F.struct(who.alias("who"), F.concat(F.lit("Chapter "), "idx", F.lit(" draft narration generated")).alias("what"), where.alias("where"), outcome.alias("outcome"), impact.alias("impact")).cast(EVENT)
    given = lambda field, kind: F.coalesce(f"b.value.{field}", F.array().cast(f"array<{kind}>"))
    events = given("key_events", EVENT)
    if not steps:
        events = F.when(F.size("b.value.key_events") > 0, F.col("b.value.key_events")).when(said != "", F.array(event)).otherwise(events)
    told = asked.select(*[c for c in work.columns if c != "told"], said.alias("narration"), "cache_hit", F.col("b.source").alias("answer_source"), events.alias("key_events"), given("character_updates", UPDATE).alias("character_updates"), given("new_items", ITEM).alias("new_items"))
    told = write(told)

    # evidence: phrases that a source may hold word for word, else the share of the claim's tokens
    keys = ["book_id", "chapter_id", "chapter_idx", "pos"]
    each = lambda field: told.select("book_id", "chapter_id", F.col("idx").alias("chapter_idx"), F.posexplode(field).alias("pos", "x")).select(*keys, "x.*")
    proposed = {"key_events": each("key_events"), "character_updates": each("character_updates"), "new_items": each("new_items").where(text_or_empty(F.col("name")) != "")}
    sound = {"key_events": claims.first_events(proposed["key_events"]), "character_updates": claims.consistent_updates(proposed["character_updates"], known), "new_items": proposed["new_items"]}
    parts = {"key_events": (["who", "what", "where", "outcome", "impact"], ["what"]), "character_updates": (["name", "change_type", "before", "after", "evidence"], ["evidence", "after"]), "new_items": (["name", "owner", "description"], ["name", "description", "owner"])}
    claim_id = lambda kind: F.concat_ws(":", F.lit(kind), F.col("pos"))
    rows = [sound[kind].select("book_id", "chapter_id", claim_id(kind).alias("claim_id"), claims.claim_text(*words).alias("claim"), F.array(*[text_or_empty(F.col(p)) for p in phrases]).alias("phrases")) for kind, (words, phrases) in parts.items()]
    sources = generate.evidence_sources(told.select("chapter_id", "text", "memories"), snippets)
    scored = write(claims.supported(rows[0].unionByName(rows[1]).unionByName(rows[2]).drop("book_id"), sources, ["chapter_id"]))

    # consistency: an event that repeats a recent one which was stored is dropped; those without support are never stored
    marked = sound["key_events"].withColumn("claim_id", claim_id("key_events")).join(scored.select("chapter_id", "claim_id", (F.col("score") >= least).alias("stored")), ["chapter_id", "claim_id"], "left").drop("claim_id")
    past = None if world is None else world["plot_events"].select("book_id", "chapter_idx", F.col("event_summary").alias("what"))
    sound["key_events"] = claims.spaced_events(marked.withColumn("stored", F.coalesce("stored", F.lit(False))), window, past).drop("stored")
    sound = {kind: write(x) for kind, x in sound.items()}
    kept = {kind: claims.with_evidence(x.withColumn("claim_id", claim_id(kind)), scored, ["chapter_id", "claim_id"], least).drop("claim_id") for kind, x in sound.items()}
    standing = sound["key_events"].select("chapter_id", claim_id("key_events").alias("claim_id")).unionByName(sound["character_updates"].select("chapter_id", claim_id("character_updates").alias("claim_id"))).unionByName(sound["new_items"].select("chapter_id", claim_id("new_items").alias("claim_id")))
    scored = scored.join(standing, ["chapter_id", "claim_id"], "left_semi")

    # refinement of the tiers that have it; steps have none
    told = told.withColumn("refine_calls", F.lit(0)).withColumn("refine_hit", F.lit(False))
    if generator is not None and not steps:
        long, new = generate.refined(told.where("refine_enabled").drop("refine_hit"), generator, cache, write)
        answers += [new] if new is not None else []
        told = told.where("NOT refine_enabled").unionByName(long.withColumn("refine_calls", F.when(F.col("narration") != "", 1).otherwise(0)))
        told = write(told)

    # state, outputs and report
    updates = kept["character_updates"]
    mentions = claims.resolved(told.select("book_id", F.col("idx").alias("chapter_idx"), F.explode("entities").alias("name")), known, "name", "canonical")
    after = state.world_of(mentions, kept["key_events"], updates, kept["new_items"], world)
    listed = [x.select("chapter_id", F.lit(kind).alias("kind"), "pos", F.to_json(F.struct(*[c for c in x.columns if c not in keys])).alias("x")) for kind, x in kept.items()]
    per = listed[0].unionByName(listed[1]).unionByName(listed[2]).groupBy("chapter_id").agg(*[F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "x")))), lambda r: r["x"]), ","), F.lit("]")).alias(kind) for kind in parts])
    outputs = told.select("book_id", "chapter_id", F.col("idx").alias("chapter_idx"), "first_idx", "last_idx", "prompt_version", "input_hash", F.to_json("entities").alias("names")).join(per, "chapter_id", "left")
    range_ = F.concat(F.lit(',"step_start_chapter_idx":'), "first_idx", F.lit(',"step_end_chapter_idx":'), "last_idx") if steps else F.lit("")
    payload = F.concat(F.lit('{"entities_mentioned":'), "names", *[F.concat(F.lit(f',"{kind}":'), F.coalesce(kind, F.lit("[]"))) for kind in parts], range_, F.lit("}"))
    outputs = outputs.select("book_id", "chapter_id", "chapter_idx", payload.alias("payload_json"), "prompt_version", "input_hash")

    counted = scored.select("chapter_id", (F.col("score") >= least).cast("int").alias("supported"), (F.col("score") < least).cast("int").alias("unsupported"), F.lit(0).alias("warnings"), F.lit(0).alias("actions"))
    for kind in ("key_events", "character_updates"):
        for frame, n in ((proposed[kind], 1), (sound[kind], -1)):
            action = F.lit(0) if kind == "key_events" or n > 0 else (F.col("name") != F.col("name_raw")).cast("int")
            counted = counted.unionByName(frame.select("chapter_id", F.lit(0).alias("supported"), F.lit(0).alias("unsupported"), F.lit(n).alias("warnings"), action.alias("actions")))
    counts = ["supported", "unsupported", "warnings", "actions"]
    counted = counted.groupBy("chapter_id").agg(*[F.sum(c).alias(c) for c in counts])
    asked_once = F.lit(1 if generator else 0)
    lines = told.select("book_id", "chapter_id", "idx", "text", "narration", (F.col("entity_calls") + asked_once + F.col("refine_calls")).alias("calls"), "refine_calls", (F.col("entity_hits") + F.col("cache_hit").cast("int") + F.col("refine_hit").cast("int")).alias("cache_hit"), F.lit(False).alias("skipped"), F.col("n_chapters").alias("chapters"))
    lines = lines.join(counted, "chapter_id", "left").fillna(0, counts)
    old = skipped.select("book_id", "chapter_id", "idx", "text", F.lit("").alias("narration"), *[F.lit(0).alias(c) for c in ("calls", "refine_calls", "cache_hit")], F.lit(True).alias("skipped"), F.lit(1).alias("chapters"), *[F.lit(0).cast("long").alias(c) for c in counts])
    report = tiers.run_report(lines.unionByName(old))
    narrations = told.select("book_id", "chapter_id", F.col("idx").alias("chapter_idx"), "title", "tier", strip(F.col("narration")).alias("narration_text"), "prompt_version", "input_hash")
    said_first = generate.no_answers(spark)
    for new in answers:
        said_first = said_first.unionByName(new)
    return Run(narrations, outputs, after["characters"], after["items"], after["plot_events"], after["world_facts"], scored, report, said_first)


def narrate_in_order(chapters: DataFrame, rule: tiers.Tiering, step_size: int = 1, world: Mapping[str, DataFrame] | None = None, cache: DataFrame | None = None, done: DataFrame | None = None, write: Callable[[DataFrame], DataFrame] = cut, **how: object) -> Run:
    """narrate() for prompts that tell what is known so far: one step after another, each over all books, and each knows the world
    that the steps before it left. As many runs as the longest book has steps.

    Retrieval reads all chapters given, or the stored index (`index`), in every step; a chapter whose input was narrated before is skipped,
    so what it left must be in `world`."""
    chapters = write(chapters.withColumn("step", tiers.step_start(F.col("idx"), step_size)))
    steps = [r.step for r in chapters.select("step").distinct().orderBy("step").toLocalIterator()]
    if how.get("embedder") is not None and how.get("index") is None and how.get("memory") != "off":
        corpus = passages_of(chapters)
        how["index"] = generate.assets(corpus if how.get("held") is None else corpus.unionByName(how["held"]), how["embedder"])
    world = empty_world(chapters) if world is None else world
    runs = []
    for step in steps:
        run = narrate(chapters.where(F.col("step") == step).drop("step"), rule, step_size=step_size, world=world, tell=True, cache=cache, done=done, write=write, **how)
        run = Run(*[write(getattr(run, f.name)) for f in fields(Run)])
        world, runs = run.world(), [*runs, run]
        cache = run.answers if cache is None else cache.select("key", "value").unionByName(run.answers)
    if not runs:
        return narrate(chapters.drop("step"), rule, step_size=step_size, world=world, tell=True, cache=cache, done=done, write=write, **how)
    out = {}
    for f in fields(Run):
        parts = [getattr(run, f.name) for run in runs]
        out[f.name] = parts[-1] if f.name in state.STATE_TABLES else parts[0]
        if f.name not in state.STATE_TABLES:
            for part in parts[1:]:
                out[f.name] = out[f.name].unionByName(part)
    out["report"] = tiers.summed_reports(out["report"])
    return Run(**out)


def empty_world(chapters: DataFrame) -> dict[str, DataFrame]:
    """State tables without rows, for books of this kind."""
    book = chapters.schema["book_id"].dataType.simpleString()
    return {name: chapters.sparkSession.createDataFrame([], f"book_id {book}, {columns}") for name, columns in state.STATE_COLUMNS.items()}
