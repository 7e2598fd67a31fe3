"""The narration run from end to end."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions.providers import HashingEmbedder
from skein.operators import state, tiers
from skein.plans.narrate import narrate, structured

CHAPTERS = "book_id long, chapter_id long, idx int, title string, text string"


def author():
    class Author:  # local, so that workers get it by value
        name = "author"

        def generate(self, prompts):
            out = []
            for p in prompts:
                if p.startswith("List"):
                    out.append('```json\n{"characters": ["Mira", " Mira ", "Tal"], "items": ["lamp"],}\n```' if "Mira" in p else "no idea")
                elif "broken" in p:
                    out.append(None)
                elif "plain" in p:
                    out.append("A plain retelling")
                elif p.startswith("Retell"):
                    events = [{"who": "Mira", "what": "Mira finds the lamp", "impact": "light"}, {"who": "Tal", "what": "An invented duel of wizards elsewhere", "impact": "none"}]
                    out.append("Here: " + json.dumps({"narration": "Mira tells", "key_events": events, "character_updates": [{"name": "M", "change_type": "location", "before": "", "after": "cave", "evidence": "in the cave"}, {"name": "Tal", "before": "x", "after": "x"}], "new_items": [{"name": "lamp", "owner": "Mira", "description": "old lamp"}]}) + " done")
                else:
                    out.append("Refined: " + p.rpartition("\n")[2])
            return out

    return Author()


@pytest.fixture(scope="module")
def chapters(spark):
    story = "Mira finds the lamp in the cave. The old lamp belongs to Mira."
    rows = [(1, 10, 1, "one", story), (1, 11, 2, "two", story + " Again."), (1, 12, 3, "three", "plain words about rain"), (2, 20, 1, "one", "broken text of another book about rain"), (2, 21, 2, "empty", "")]
    return spark.createDataFrame(rows, CHAPTERS)


def test_drafts_without_providers(spark, chapters):
    run = narrate(chapters, tiers.Tiering(default="medium"))
    got = {r.chapter_id: r.narration_text for r in run.narrations.collect()}
    assert got[12] == "plain w"[:6].strip() and got[21] == "" and len(got) == 5
    assert run.characters.count() == 0 and run.items.count() == 0
    report = {r.book_id: r for r in run.report.collect()}
    assert (report[1].chapters_total, report[1].chapters_processed, report[1].llm_calls, report[1].chapters_skipped) == (3, 3, 0, 0)
    assert report[2].chapters_processed == 1


def test_run_with_generator(spark, chapters):
    known = spark.createDataFrame([(1, 1, "Mira", '["M"]')], "book_id long, character_id long, canonical_name string, aliases_json string")
    cache = spark.createDataFrame([], "key string, value string")
    run = narrate(chapters, tiers.Tiering(default="medium", long_every_n=2), author(), cache, HashingEmbedder(16), known=known)
    told = {r.chapter_id: (r.tier, r.narration_text) for r in run.narrations.collect()}
    assert told[10] == ("medium", "Mira tells") and told[11] == ("long", "Refined: Mira tells") and told[12][1] == "A plain retelling"
    assert told[20] == ("medium", "broken text of another book about rain"[:11].strip()) and told[21][1] == ""
    # the second chapter repeats the first one's event; the invented one has no support
    assert [(r.book_id, r.chapter_idx, r.event_summary, r.involved_characters_json) for r in run.plot_events.collect()] == [(1, 1, "Mira finds the lamp", '["Mira"]')]
    people = {(r.book_id, r.name): r for r in run.characters.collect()}
    assert people[1, "Mira"].location == "cave" and people[1, "Mira"].last_chapter_idx == 2 and (1, "Tal") in people
    facts = {(r.book_id, r.fact_key): r for r in run.world_facts.collect()}
    assert facts[1, "character:Mira:location"].fact_value == "cave" and facts[1, "item:lamp:owner"].fact_value == "Mira" and facts[1, "character:Mira:location"].source_excerpt == "in the cave"
    payload = {r.chapter_id: json.loads(r.payload_json) for r in run.outputs.collect()}
    assert payload[10]["key_events"][0]["evidence_source_type"] == "chapter" and payload[10]["entities_mentioned"] == ["Mira", "Tal"] and payload[10]["key_events"][0]["evidence_score"] == 1.0
    report = {r.book_id: r for r in run.report.collect()}[1]
    assert (report.llm_calls, report.refine_llm_calls, report.evidence_unsupported_claims > 0, report.consistency_actions) == (7, 1, True, 2)
    assert len(run.report.columns) - 1 == 17
    # the stored outputs rebuild the same facts and items
    back = state.replayed(run.outputs, 99)
    assert back["items"].count() == 2 and sorted(r.fact_key for r in state.facts(back["events"], back["updates"], back["items"]).collect()) == sorted(k for _, k in facts)
    # a second run skips what is narrated and asks nothing
    again = narrate(chapters, tiers.Tiering(default="medium", long_every_n=2), author(), cache, None, known=known, done=run.narrations)
    assert again.narrations.count() == 0 and {r.book_id: r.chapters_skipped for r in again.report.collect()} == {1: 3, 2: 2}


def test_memories_come_from_earlier_chapters_of_the_book(spark):
    rows = [(b, b * 10 + i, i, f"t{i}", f"book {b} chapter {i} about lamps and rain " * 4) for b in (1, 2) for i in range(1, 5)]
    seen = []
    from skein.operators.lineage import cut

    def write(df):
        seen.append(cut(df))
        return seen[-1]

    narrate(spark.createDataFrame(rows, CHAPTERS), tiers.Tiering(default="medium"), embedder=HashingEmbedder(16), write=write)
    memories = {r.chapter_id: [m.text for m in r.memories] for r in next(x for x in seen if "memories" in x.columns).collect()}
    assert memories[11] == [] and memories[21] == [] and 0 < len(memories[14]) <= 4
    for chapter, texts in memories.items():
        assert all(t.startswith(f"book {chapter // 10} chapter ") and int(t.split()[3]) < chapter % 10 for t in texts)


def test_structured_answers(spark):
    schema = "struct<a:int,b:array<string>>"
    rows = [('{"a":1,"b":["x"]}', (1, ["x"])), ('```json\n{"a":2,}\n```', (2, None)), ("text {\"a\":3} more", (3, None)), ("none", None), (None, None)]
    for raw, want in rows:
        got = spark.createDataFrame([(raw,)], "t string").select(structured(F.col("t"), schema).alias("x")).first().x
        assert (None if got is None or (got.a is None and got.b is None) else (got.a, got.b)) == want
