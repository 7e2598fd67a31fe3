"""Narrating in parts gives what narrating at once gives; answers are asked once; steps; summaries of changed chunks."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions.answers import best_effort, checked
from skein.functions.providers import HashingEmbedder, LeadingGenerator, answers_of, provider
from skein.operators import claims, state, store, tiers
from skein.plans import stored, summarize
from skein.plans.narrate import narrate

CHAPTERS = "book_id string, chapter_id long, idx int, title string, text string"
TABLES = ["narrations", "outputs", "characters", "items", "plot_events", "world_facts"]


def author(log):
    class Author:  # local, so that workers get it by value
        name = "author"

        def generate(self, prompts):
            with open(log, "a") as f:
                f.writelines(json.dumps(p) + "\n" for p in prompts)
            out = []
            for p in prompts:
                body = p.rpartition("Text:\n")[2]
                if p.startswith("List"):
                    out.append(json.dumps({"characters": [w for w in ("Mira", "Tal") if w in p], "items": ["lamp"] if "lamp" in p else []}))
                elif "fails" in body:
                    raise RuntimeError("no answer")
                elif p.startswith("Retell"):
                    known = p.partition("Known so far:\n")[2].partition("\n")[0]
                    events = [{"who": "Mira", "what": "Mira lights the lamp"}] if "lights" in body else []
                    updates = [{"name": "Tal", "change_type": "location", "after": w, "evidence": f"Tal is in the {w}"} for w in ("cave", "tower") if f"Tal is in the {w}" in body]
                    updates += [{"name": "Mira", "after": "hurt", "evidence": "Mira is hurt"}] if "Mira is hurt" in body else []
                    items = [{"name": "lamp", "owner": "Tal" if "gives" in body else "Mira", "description": "lamp"}] if "lamp" in body else []
                    out.append(json.dumps({"narration": f"told {len(body)} knowing {len(json.loads(known)['facts'] or []) if known else 0}", "key_events": events, "character_updates": updates, "new_items": items}))
                else:
                    out.append("Better: " + p.rpartition("\n")[2])
            return out

    return Author()


def asked(log):
    return [json.loads(x) for x in open(log)] if log.exists() else []


#: Steps one after another cost a run each.
SHORT = 3
STORY = ["Mira lights the lamp. Tal is in the cave.", "Mira lights the lamp. Mira is hurt.", "Mira gives Tal the lamp. Tal is in the tower.", "Mira walks on.", "Mira lights the lamp. Tal is in the cave again, Mira says.", "Nothing.", "Mira lights the lamp."]


@pytest.fixture(scope="module")
def chapters(spark):
    return spark.createDataFrame([(b, 100 * k + i, i, f"t{i}", f"{t} ({b})") for k, b in enumerate(("a", "b")) for i, t in enumerate(STORY, 1)], CHAPTERS)


def shelf(spark, path, chapters):
    tables = stored.library(spark, f"file://{path}")
    named = chapters.withColumn("chapter_hash", F.sha2(F.col("chapter_id").cast("string"), 256))
    chunks = named.select("book_id", "chapter_hash", F.col("idx").alias("chapter_idx"), "title", F.lit(1).alias("idx"), F.col("text").alias("chunk_text"))
    tables.commit(replace={"chapters": named, "chunks": chunks})
    stored.embed(tables, HashingEmbedder(16))
    return tables


def content(tables, name):
    rows = tables.read(name)
    return sorted(map(str, rows.drop("narrated_at", "created_at").select(*sorted(c for c in rows.columns if c not in ("narrated_at", "created_at"))).collect()))


@pytest.mark.parametrize("in_order", [False, True])
def test_parts_equal_the_whole(spark, tmp_path, chapters, in_order):
    rule, how = tiers.Tiering(default="medium", long_every_n=3), dict(embedder=HashingEmbedder(16), in_order=in_order, window=3)
    if in_order:
        chapters = chapters.where(f"idx <= {SHORT} AND book_id = 'a'")
    whole, parts = shelf(spark, tmp_path / "whole", chapters), shelf(spark, tmp_path / "parts", chapters)
    stored.tell(whole, chapters, rule, author(tmp_path / "w"), **how)
    first, rest = "idx <= 2 OR (book_id = 'b' AND idx <= 4)", "idx > 2 AND (book_id = 'a' OR idx > 4)"
    stored.tell(parts, chapters.where(first), rule, author(tmp_path / "p"), **how)
    held = parts.read("checkpoints")
    assert {(r.book_id, r.chapter_idx) for r in held.collect()} == ({("a", 2)} if in_order else {("a", 2), ("b", 4)})
    stored.tell(parts, chapters.where(rest), rule, author(tmp_path / "p"), **how)
    for name in TABLES:
        assert content(whole, name) == content(parts, name), name
    events = {(r.book_id, r.chapter_idx) for r in parts.read("plot_events").collect()}
    assert events == {(b, i) for b in "ab" for i in (1, 5)} if not in_order else {("a", 1)}  # the second and the seventh repeat one of the three chapters before
    people = {(r.book_id, r.name): r for r in parts.read("characters").collect()}
    assert (people["a", "Tal"].location, people["a", "Mira"].status, people["a", "Mira"].first_chapter_idx, people["a", "Mira"].last_chapter_idx) == (("tower", "hurt", 1, 3) if in_order else ("cave", "hurt", 1, 7))
    assert {r.owner_name for r in parts.read("items").collect()} == {"Tal" if in_order else "Mira"}
    texts = [r.narration_text for r in parts.read("narrations").collect()]
    assert any("knowing 0" not in t for t in texts) == in_order
    # every distinct prompt was asked once, and a run over everything asks nothing
    for log in ("w", "p"):
        said = asked(tmp_path / log)
        assert len(said) == len(set(said)) and (log == "w" or len(said) == len(asked(tmp_path / "w")))
    if in_order:
        return
    before = len(asked(tmp_path / "p"))
    again = stored.tell(parts, chapters, rule, author(tmp_path / "p"), **how)
    assert len(asked(tmp_path / "p")) == before and again.narrations.count() == 0
    for name in TABLES:
        assert content(whole, name) == content(parts, name), name


def test_chapter_told_again(spark, tmp_path, chapters):
    """A changed chapter's second output replaces the first in the state; later chapters keep theirs, and checkpoints after it go."""
    one = chapters.where("book_id = 'a' AND idx <= 3")
    tables, rule = shelf(spark, tmp_path / "t", one), tiers.Tiering(default="short")
    for i in (1, 2, 3):
        stored.tell(tables, one.where(F.col("idx") == i), rule, author(tmp_path / "log"), window=1)
    assert sorted(r.chapter_idx for r in tables.read("checkpoints").collect()) == [1, 2, 3]
    assert {r.chapter_idx for r in tables.read("plot_events").collect()} == {1}
    changed = one.where("idx = 1").withColumn("text", F.lit("Tal is in the tower."))
    stored.tell(tables, changed, rule, author(tmp_path / "log"), window=1)
    assert tables.read("outputs").count() == 4 and stored.latest_outputs(tables.read("outputs")).count() == 3
    assert tables.read("plot_events").count() == 0 and tables.read("items").count() == 1
    tal = tables.read("characters").where("name = 'Tal'").first()
    assert tal.location == "tower" and sorted(r.chapter_idx for r in tables.read("checkpoints").collect()) == [3]
    stored.clear_book(tables, "a")
    assert all(tables.read(name).count() == 0 for name in tables.state() if name != "answers")


def test_failed_and_stored_answers(spark, tmp_path):
    """A failing prompt falls back alone; unreadable stored answers are asked again."""
    rows = [("a", 1, 1, "x", "it fails here"), ("a", 2, 2, "y", "Mira walks with Tal far away."), ("a", 3, 3, "z", "Mira walks with Tal far away.")]
    ch = spark.createDataFrame(rows, CHAPTERS)
    run = narrate(ch, tiers.Tiering(default="medium"), author(tmp_path / "log"))
    got = {r.chapter_id: r.narration_text for r in run.narrations.collect()}
    assert got[1] == "it fails here"[:3].strip() and got[2].startswith("told")
    answers = run.answers.collect()
    assert len(answers) == len({a.key for a in answers}) == 4  # two entity prompts, two narrations
    report = run.report.first()
    assert (report.llm_calls, report.cache_hits) == (6, 0)
    assert sum("fails" in p for p in asked(tmp_path / "log") if p.startswith("Retell")) >= 3
    n = len(asked(tmp_path / "log"))
    bad = spark.createDataFrame([(a.key, "not JSON" if a.value.startswith('{"characters"') else a.value) for a in answers], "key string, value string")
    again = narrate(ch, tiers.Tiering(default="medium"), author(tmp_path / "log"), bad)
    assert {r.chapter_id: r.narration_text for r in again.narrations.collect()} == got
    new = asked(tmp_path / "log")[n:]
    assert {p[:4] for p in new} == {"List", "Rete"} and all("fails" in p for p in new if p.startswith("Rete"))
    assert answers_of(type("G", (), {"generate": lambda self, ps: [p for p in ps if p != "x"]})(), ["a", "x"], 1, lambda s: None) == ["a", None]


@pytest.mark.parametrize("telling", [False, True])
def test_steps(spark, tmp_path, chapters, telling):
    """One output a step, in the place of its last chapter; the tail step is short; drafts have no events."""
    run = narrate(chapters, tiers.Tiering(default="long"), author(tmp_path / "log") if telling else None, embedder=HashingEmbedder(16), step_size=3, memory="per_step_shared")
    got = {(r.book_id, r.chapter_idx): r for r in run.narrations.collect()}
    assert set(got) == {(b, i) for b in "ab" for i in (3, 6, 7)} and {r.prompt_version for r in got.values()} == {"step_v1"}
    text = "\n\n".join(f"{t} (a)" for t in STORY[:3])
    assert got["a", 3].chapter_id == 3 and got["a", 3].title == "t3"
    payload = {(r.book_id, r.chapter_idx): json.loads(r.payload_json) for r in run.outputs.collect()}
    assert [payload["a", i][f"step_{end}_chapter_idx"] for i in (3, 6, 7) for end in ("start", "end")] == [1, 3, 4, 6, 7, 7]
    report = {r.book_id: r for r in run.report.collect()}["a"]
    assert (report.chapters_total, report.chapters_processed) == (7, 7)
    if not telling:
        assert got["a", 3].narration_text == text[: int(len(text) * 0.5)].strip() and payload["a", 3]["key_events"] == [] and report.llm_calls == 0
        done = narrate(chapters, tiers.Tiering(default="long"), step_size=3, done=run.narrations)
        assert done.narrations.count() == 0 and {r.book_id: r.chapters_skipped for r in done.report.collect()} == {"a": 7, "b": 7}
        more = chapters.union(spark.createDataFrame([("a", 8, 8, "t8", "new")], CHAPTERS))
        assert [r.chapter_idx for r in narrate(more, tiers.Tiering(default="long"), step_size=3, done=run.narrations).narrations.collect()] == [8]
    else:
        step = next(p for p in asked(tmp_path / "log") if p.startswith("Retell chapters 4 to 6") and "(a)" in p)
        told = json.loads(step.partition("Chapters:\n")[2])
        assert [c["chapter_idx"] for c in told] == [4, 5, 6] and told[0]["narration_ratio"] == [0.4, 0.5] and told[2]["chapter_text"] == "Nothing. (a)"
        assert all(m["chapter_idx"] < c["chapter_idx"] for c in told for m in c["memories"]) and report.refine_llm_calls == 0
        assert payload["a", 3]["entities_mentioned"] == ["Mira", "Tal"] and report.llm_calls == 7 + 3


def test_spaced_events_with_past(spark):
    ev = spark.createDataFrame([("b", c, 0, w, s) for c, w, s in [(3, "x", True), (5, "x", False), (8, "x", True), (9, "x", True), (4, "y", False), (5, "y", True)]], "book_id string, chapter_idx int, pos int, what string, stored boolean")
    past = spark.createDataFrame([("b", 1, "x"), ("b", 2, " x"), ("c", 8, "x")], "book_id string, chapter_idx int, what string")
    got = claims.spaced_events(ev, 3, past)
    assert sorted((r.chapter_idx, r.what) for r in got.collect()) == [(4, "y"), (5, "y"), (8, "x")]
    assert sorted((r.chapter_idx, r.what) for r in claims.spaced_events(ev.drop("stored"), 3).collect()) == [(3, "x"), (4, "y"), (8, "x")]


def test_embedding_writes_changed_parts_only(spark, tmp_path, chapters):
    tables = shelf(spark, tmp_path / "t", chapters)
    before, postings = tables.state()["postings"]["entries"], tables.read("postings").count()
    assert stored.embed(tables, HashingEmbedder(16)) == 0
    a = chapters.where("book_id = 'a'")
    more = a.limit(1).withColumns({"idx": F.lit(8), "chapter_id": F.lit(900), "text": F.lit("eight words more for one of the books")})
    named = more.withColumn("chapter_hash", F.lit("new")).select("book_id", "chapter_hash", F.col("idx").alias("chapter_idx"), "title", F.lit(1).alias("idx"), F.col("text").alias("chunk_text"))
    tables.commit(append={"chunks": named})
    assert stored.embed(tables, HashingEmbedder(16)) == 1
    after = tables.state()["postings"]["entries"]
    assert len(set(before) & set(after)) == len(before) - 1 and tables.read("postings").where("book_id = 'a'").count() > postings / 2
    stats = stored.index_of(tables)[1].stats.first()
    sizes = tables.read("passages").select(F.size(F.regexp_extract_all(F.concat_ws(" ", "title", "text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("n")).agg(F.count("*"), F.avg("n")).first()
    assert (stats.n, stats.mean) == (sizes[0], pytest.approx(sizes[1]))
    fresh = shelf(spark, tmp_path / "u", chapters.union(more.select(*chapters.columns)))
    assert tables.read("postings").count() == fresh.read("postings").count()



def counting(log):
    class Leading:
        name = "leading"

        def generate(self, prompts):
            with open(log, "a") as f:
                f.writelines(json.dumps(p) + "\n" for p in prompts)
            return [p.partition("\n\n")[2][:20] for p in prompts]

    return Leading()


def test_changed_chunk_asks_for_its_path_only(spark, tmp_path):
    def rows(changed=""):
        return spark.createDataFrame([(b, c * 10 + b, c, i, f"{changed if (b, c, i) == (1, 2, 3) else ''}book {b} chapter {c} chunk {i} " * 3) for b in (1, 2) for c in range(1, 6) for i in range(1, 5)], "book_id int, chapter_id int, chapter_idx int, idx int, chunk_text string")

    log = tmp_path / "log"
    out, new = summarize.summarised(rows(), counting(log), most=60)
    first = {(r.scope, r.ref_id, r.summary_type): r.content for r in out.collect()}
    assert len([k for k in first if k[0] == "chunk"]) == 40 and len([k for k in first if k[0] == "chapter"]) == 10 and {k[2] for k in first if k[0] == "book"} == {"book_summary", "story"}
    n = len(asked(log))
    out, more = summarize.summarised(rows("NEW "), counting(log), new, most=60)
    second = {(r.scope, r.ref_id, r.summary_type): r.content for r in out.collect()}
    said = asked(log)[n:]
    assert len(said) == len(set(said)) == more.count()
    # the chunk and its chapter; the chapter's summary begins as before, so nothing above it is asked
    assert len(said) == 2 and {k for k in second if first[k] != second[k]} == {("chunk", "21:3", "chunk_summary")}
    n = len(asked(log))
    changed = rows().withColumn("chunk_text", F.when(F.expr("book_id = 1 AND chapter_idx = 2 AND idx = 1"), "another start of it").otherwise(F.col("chunk_text")))
    out, more = summarize.summarised(changed, counting(log), new, most=60)
    third = {(r.scope, r.ref_id, r.summary_type): r.content for r in out.collect()}
    heads = [p.partition("\n")[0].split()[0] + p.partition("\n")[0].split()[1] for p in asked(log)[n:]]
    assert all(k[0] != "book" or k[1] == "1" for k in third if first[k] != third[k]) and len(heads) <= 6
    assert summarize.summarised(rows().limit(0), counting(log))[0].count() == 0


def test_json_book_summary(spark):
    class Json:
        name = "json"

        def generate(self, prompts):
            return ['{"summary":"s","characters":["a"],"timeline":["t"],}' if "book" in p.partition("\n")[0] else "x" for p in prompts]

    rows = spark.createDataFrame([(1, 1, 1, 1, "text")], "book_id int, chapter_id int, chapter_idx int, idx int, chunk_text string")
    out, _ = summarize.summarised(rows, Json(), story=False)
    assert {r.summary_type: r.content for r in out.collect() if r.scope == "book"} == {"book_summary": "s", "characters": '["a"]', "timeline": '["t"]'}


def test_checked_answers(spark):
    schema = "narration string, key_events array<struct<what:string>>, n int"
    cases = {
        '{"narration":"a","key_events":[{"what":"x"}],"n":1}': (None, "answer"), '```json\n{"narration":"a",}\n```': (None, "answer"), '{"narration":3}': ("narration is not text", "none"),
        '{"narration":"b","key_events":"no","n":2}': ("key_events is not a list of an object", "partial"), '{"narration":"b","key_events":[1],"n":2}': ("key_events is not a list of an object", "partial"),
        '{"narration":"b","key_events":[]}': (None, "answer"), "plain": ("no JSON", "text"), "": ("empty", "none"), "[1]": ("not an object", "text"), '{"narration":null,"n":1.5}': ("narration is missing; n is not a whole number", "none"), "{bad": ("no JSON", "none"),
    }
    got = spark.createDataFrame([(t,) for t in (*cases, None)], "t string").select("t", checked(F.col("t"), schema, ["narration"]).alias("c"), best_effort(F.col("t"), schema, "narration").alias("b")).collect()
    assert {r.t: (r.c.reason, r.b.source) for r in got} == cases | {None: ("empty", "none")}
    assert all((r.c.value is None) == (r.c.reason is not None) for r in got)
    partial = next(r.b.value for r in got if r.t and '"no"' in r.t)
    assert (partial.narration, partial.key_events, partial.n) == ("b", None, 2)


def test_provider_settings():
    assert provider("", "generator") is None and provider("", "embedder") == HashingEmbedder()
    assert provider("http://x:1/v1#m", "generator").name == "http://x:1/v1/m/0.3" and provider("http://x#m", "embedder").model == "m"
    assert provider("skein.functions.providers:LeadingGenerator", "generator") == LeadingGenerator()
    with pytest.raises(ValueError):
        provider("neither", "generator")


def test_tier_settings(spark):
    got = {r.tier: r for r in tiers.tier_settings(spark, {"short": {"memory_top_k": 3}, "long": {"refine_enabled": False}}, {"memory_top_k": 9}).collect()}
    assert (got["short"].memory_top_k, got["long"].memory_top_k, got["long"].refine_enabled, got["medium"].ratio_high) == (3, 8, False, 0.3)
    assert {r.memory_top_k for r in tiers.tier_settings(spark, None, {"memory_top_k": 9}, enabled=False).collect()} == {9}


def test_stale_files_go(spark, tmp_path):
    from skein.operators.export import write_files

    files = lambda *names: spark.createDataFrame([("a", n, "x") for n in names] + [("b", "001_x.md", "y")], "book_id string, filename string, content string")
    write_files(files("001_x.md", "002_y.md", "story.md"), str(tmp_path / "out"), stale=r"\d{3}(-\d{3})?_.*\.md")
    (tmp_path / "out/a/notes.md").write_text("mine")
    assert write_files(files("001-002_z.md"), str(tmp_path / "out"), stale=r"\d{3}(-\d{3})?_.*\.md") == 2
    assert sorted(p.name for p in tmp_path.glob("out/a/*")) == ["001-002_z.md", "notes.md", "story.md"] and (tmp_path / "out/b/001_x.md").exists()


def test_ties_in_the_cache(spark):
    cache = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 1.0)], "key string, value string, created_at double")
    assert {store.unexpired(cache.orderBy(o), 2.0, 0).first().value for o in ("value", F.desc("value"))} == {"b"}


def test_world_of_goes_on(spark):
    before = {name: spark.createDataFrame(rows, f"book_id string, {state.STATE_COLUMNS[name]}") for name, rows in {"characters": [("a", "M", "m", 1, 2, "hurt", None), ("a", "N", "", 1, 1, "active", "cave")], "items": [("a", "lamp", "M", "old", 1, 2)], "plot_events": [], "world_facts": [("a", "character:M:status", "hurt", 0.85, 2, "")]}.items()}
    mentions = spark.createDataFrame([("a", 3, "m2", "M")], "book_id string, chapter_idx int, name string, canonical string")
    updates = spark.createDataFrame([("a", 3, 0, "M", "location", "tower", "e")], "book_id string, chapter_idx int, pos int, name string, change_type string, after string, evidence string")
    items = spark.createDataFrame([("a", 3, 0, "lamp", None, "new")], "book_id string, chapter_idx int, pos int, name string, owner string, description string")
    events = spark.createDataFrame([], "book_id string, chapter_idx int, pos int, who string, what string, impact string")
    got = state.world_of(mentions, events, updates, items, before)
    people = {r.name: r for r in got["characters"].collect()}
    assert tuple(people["M"])[1:] == ("M", "m,m2", 1, 3, "hurt", "tower") and tuple(people["N"])[1:] == ("N", "", 1, 1, "active", "cave")
    assert tuple(got["items"].first()) == ("a", "lamp", None, "new", 1, 3)
    facts = {r.fact_key: (r.fact_value, r.source_chapter_idx) for r in got["world_facts"].collect()}
    assert facts == {"character:M:status": ("hurt", 3), "character:M:location": ("tower", 3)}
