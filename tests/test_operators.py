import io
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.functions.text import clean_json, match_query, normalised, safe_filename
from skein.functions.unicode import nfkc
from skein.operators import claims, export, ingest, retrieval, state, store, tiers
from skein.sources.html import epub_assets, epub_documents, inside, to_markdown
from skein.sources.text_files import decoded


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_chunks_join_a_short_tail(spark):
    df = ingest.chunks(spark.createDataFrame([(1, "abcdefghi")], "k int, text string"), ["k"], size=4, overlap=1, least=4)
    assert rows(df.orderBy("idx"), "chunk_text", "start_pos", "end_pos") == [("abcd", 0, 4), ("defgghi", 3, 9)]
    with pytest.raises(ValueError):
        ingest.chunks(df, ["k"], size=4, overlap=0)


def test_normalise(spark):
    assert one(spark, "ＡＢＣ\r\n\r\n１２３", lambda c: normalised(nfkc(c))) == "ABC\n123"


def test_chapters_with_preface_and_fallback(spark):
    text = "前言\n第1章 始\n甲\n第2章 续\n乙"
    df = ingest.chapters(spark.createDataFrame([(1, text), (2, "0123456789"), (3, "第1章 空")], "k int, text string"), "k", r"^第[0-9]+章.*$", width=4)
    assert rows(df.where("k = 1").orderBy("idx"), "title", "body") == [("序章", "前言"), ("第1章 始", "甲"), ("第2章 续", "乙")]
    assert [r[0] for r in rows(df.where("k = 2").orderBy("idx"), "body")] == ["0123", "4567", "89"]
    assert rows(df.where("k = 3"), "title", "body", "start_pos", "end_pos") == [("第1章 空", "第1章 空", 0, 5)]


def test_encodings(spark):
    text = "第1章 开始\n韩立来到山谷，看见一位老人。"
    df = decoded(spark.createDataFrame([("a", text.encode("gb18030")), ("b", text.encode()), ("c", b"")], "path string, content binary"))
    got = {r.path: r for r in df.collect()}
    assert got["a"].text == text and got["a"].encoding == "gb18030"
    assert got["b"].text == text and got["b"].encoding in ("utf-8-sig", "utf-8")
    assert got["a"].confidence > 0 and not got["a"].used_replacement
    fixed = decoded(spark.createDataFrame([("a", b"a\xffb")], "path string, content binary"), "utf-8").first()
    assert fixed.text == "a�b" and not fixed.autodetected


def test_epub(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfile full-path="O/p.opf"/></c>')
        z.writestr("O/p.opf", '<package xmlns="x"><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i/p.png" media-type="image/png"/><item id="m" href="i/s.mp3" media-type="audio/mpeg"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="a"/></spine></package>')
        z.writestr("O/nav.xhtml", "<p>nav</p>")
        z.writestr("O/t/a.xhtml", '<h1>T</h1><p>x <b>y</b></p><img src="../i/p.png"/><audio src="../i/s.mp3"/>')
        z.writestr("O/i/p.png", b"png")
        z.writestr("O/i/s.mp3", b"mp3")
    files = spark.createDataFrame([("f", held.getvalue())], "path string, content binary")
    docs = epub_documents(files, "keep-images")
    assert rows(docs, "spine_idx", "href", "assets") == [(0, "O/t/a.xhtml", ["O/i/p.png"])]
    assert rows(epub_assets(files, docs), "href", "bytes") == [("O/i/p.png", b"png")]
    assert len(epub_documents(files, "keep-all").first().assets) == 2
    assert to_markdown(docs.first().html) == "# T\n\nx **y**"
    assert inside("O/t/a.xhtml", "../../../x") is None and inside("a.html", "b.png#c") == "b.png"


def test_ranks_and_proximity(spark):
    r = spark.range(1).select(retrieval.rank_score(F.lit(1), F.lit(4)), retrieval.rank_score(F.lit(4), F.lit(4)), retrieval.proximity(F.lit(10), F.lit(9)), retrieval.proximity(F.lit(10), F.lit(10))).first()
    assert tuple(r) == (1.0, 0.25, 0.5, 0.0)
    assert one(spark, ["a", 'b"'], match_query, "array<string>") == '"a" OR "b"'


def test_steps(spark):
    df = tiers.step_ranges(spark.createDataFrame([("b", i) for i in range(1, 13)], "book string, idx int"), "book", "idx", 5)
    assert rows(df.orderBy("step_start"), "step_start", "step_end") == [(1, 5), (6, 10), (11, 12)]


def test_latest_and_asof(spark):
    n = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1)], "id int, chapter int, at int")
    assert rows(store.latest(n, ["chapter"], ["at", "id"]).orderBy("chapter"), "id") == [(2,), (3,)]
    marks = spark.createDataFrame([("b", 1, 7), ("b", 4, 8)], "k string, at int, n int")
    goals = spark.createDataFrame([("b", 0), ("b", 2), ("b", 4), ("c", 5)], "k string, target int")
    got = {(r.k, r.target): r.found.n if r.found else None for r in store.asof(goals, marks, "k", "target", "at", ["n"]).collect()}
    assert got == {("b", 0): None, ("b", 2): 7, ("b", 4): 8, ("c", 5): None}


def test_table_clears_a_book(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", "book_id")
    t.replace(spark.createDataFrame([(1, "a"), (2, "b")], "book_id int, x string"))
    t.replace(state.clear_book(t.read(), 1))
    assert rows(t.read(), "book_id", "x") == [(2, "b")]


def test_evidence(spark):
    asked = [(1, "韩立 得到小瓶", ["得到小瓶"]), (2, "nothing of it", ["zzz"]), (3, "red green blue", []), (4, "", [])]
    c = spark.createDataFrame([(0, *a) for a in asked], "k int, claim_id int, claim string, phrases array<string>")
    s = spark.createDataFrame([(0, 0, "chapter", "韩立在谷中得到小瓶"), (0, 1, "narration", "red and green here")], "k int, pos int, source_type string, source string")
    got = {r.claim_id: (r.score, r.source_type) for r in claims.supported(c, s, ["k"]).collect()}
    assert got == {1: (1.0, "chapter"), 2: (0.0, ""), 3: (0.6667, "narration"), 4: (0.0, "")}


def test_consistency(spark):
    e = spark.createDataFrame([(1, 2, 0, "x"), (1, 2, 1, "x "), (1, 2, 2, "old"), (1, 2, 3, None)], "book_id int, chapter_idx int, pos int, what string")
    recent = spark.createDataFrame([(1, 2, "old")], "book_id int, chapter_idx int, event_summary string")
    assert rows(claims.consistent_events(e, recent), "what", "pos") == [("x", 0)]
    who = spark.createDataFrame([(1, 1, "Han Li", '["Lao Han"]')], "book_id int, character_id int, canonical_name string, aliases_json string")
    u = spark.createDataFrame([(1, "lao han", None, "a", "b", ""), (1, "Han Li", "location", "c", "c", ""), (1, "", "status", "", "d", "")], "book_id int, name string, change_type string, before string, after string, evidence string")
    assert rows(claims.consistent_updates(u, who), "name", "change_type", "after") == [("Han Li", "status", "b")]


def test_restore_ignores_other_fields(spark):
    s = spark.createDataFrame([(1, '{"items":[{"name":"a","owner_name":"1","z":2}],"other":3}'), (2, '{"items":[]}'), (3, None)], "book_id int, snapshot_json string")
    assert rows(state.restored(s, "items", "name string, owner_name string"), "book_id", "name", "owner_name") == [(1, "a", "1")]


def test_filenames_and_steps(spark):
    assert one(spark, "第1章: /危机?*", safe_filename) == "第1章___危机_"
    assert one(spark, "```json\n{\"a\": 1,}\n```", clean_json) == '{"a": 1}'
    n = spark.createDataFrame([(1, 8, "t", "x", "v1", '{"step_start_chapter_idx":1,"step_end_chapter_idx":8}'), (1, 10, "t", "x", "step_v1", None), (1, 3, None, "x", "v1", "{bad")], "book_id int, chapter_idx int, title string, narration_text string, prompt_version string, payload_json string")
    got = [r[0] for r in rows(export.chapter_files(n, 8).orderBy("chapter_idx"), "filename")]
    assert got == ["003_第3章.md", "001-008_t.md", "009-010_t.md"]


def test_draft_length_and_tiers(spark):
    assert len(one(spark, "a" * 100, lambda c: tiers.draft(c, 0.5))) == 50
    rule = tiers.Tiering(default="short", long_keywords=("Duel",))
    assert one(spark, "the duel", lambda c: tiers.tier(rule, F.lit(1), F.lit("t"), c)) == "long"
    assert one(spark, "calm", lambda c: tiers.tier(rule, F.lit(1), F.lit("t"), c)) == "short"


def test_numbered_across_ranges(spark):
    ids = [5, 1, 250_000, 100_001, 99_999, -7, None]
    df = spark.createDataFrame([(i, s) for i in ids for s in ("a", None)], "k long, s string")
    got = store.numbered(df, "s", "k")
    for s in ("a", None):
        assert [r.k for r in got.where(F.col("s").eqNullSafe(F.lit(s))).orderBy("idx").collect()] == [None, -7, 1, 5, 99_999, 100_001, 250_000]
    assert store.numbered(df.limit(0), "s", "k").count() == 0


def test_table_versions(spark, tmp_path):
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    t = store.Table(spark, f"file://{tmp_path}/t")
    assert t.version() is None
    t.replace(rows(1, 2))
    t.append(rows(3))
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 3] and t.version() == 2 and sorted(r.k for r in t.read(1).collect()) == [1, 2]
    base = t.version()
    t.append(rows(4))
    with pytest.raises(store.Conflict):
        t.tables.commit(replace={"rows": rows(7)}, at=base)
    t.replace(rows(9))
    assert len(t.vacuum()) == 3 and t.versions() == [4] and [r.k for r in t.read().collect()] == [9]
    with pytest.raises(LookupError, match="book not found: 7"):
        store.point_read(t.read(), "k", 7, "book")
    assert store.point_read(t.read(), "k", 9) == {"k": 9}


def test_table_partitions(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/p", "book")
    t.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, book string"))
    t.append(spark.createDataFrame([(3, "b")], "k int, book string"))
    assert sorted(r.k for r in t.read().where("book = 'b'").collect()) == [2, 3] and set(t.read().columns) == {"k", "book"}


def test_spaced_events(spark):
    """A dropped repeat does not hold back a later one: only kept events count."""
    ev = spark.createDataFrame([("b", c, p, w) for c, p, w in [(1, 0, "x"), (1, 1, " x "), (4, 0, "x"), (7, 0, "x"), (8, 0, "y"), (9, 0, ""), (13, 0, "x"), (14, 0, None)]], "book_id string, chapter_idx int, pos int, what string")
    got = claims.spaced_events(ev, 5)
    assert sorted((r.chapter_idx, r.pos, r.what) for r in got.collect()) == [(1, 0, "x"), (7, 0, "x"), (8, 0, "y"), (13, 0, "x")]
    assert claims.spaced_events(ev.limit(0), 5).count() == 0


def test_effective_values(spark):
    df = spark.createDataFrame([(0, False), (None, None)], "n int, b boolean")
    got = df.select(tiers.effective(F.col("n"), 8, 1).alias("n"), tiers.effective(F.col("b"), None, True).alias("b")).collect()
    assert [tuple(r) for r in got] == [(0, False), (8, True)]


def test_character_facts_state_what_holds(spark):
    """Every update states the status, `active` before any change, and a location once there is one."""
    u = spark.createDataFrame([(1, 1, 0, "A", "location", "hill", "seen"), (1, 2, 0, "A", "other", "z", "later"), (1, 1, 1, "B", "status", "", None)], "book_id int, chapter_idx int, pos int, name string, change_type string, after string, evidence string")
    none = spark.createDataFrame([], "book_id int, chapter_idx int, pos int, who string, what string, impact string")
    items = spark.createDataFrame([], "book_id int, chapter_idx int, pos int, name string, owner string, description string")
    got = {r.fact_key: (r.fact_value, r.source_chapter_idx, r.source_excerpt) for r in state.facts(none, u, items).collect()}
    assert got == {"character:A:status": ("active", 2, "later"), "character:A:location": ("hill", 2, "later"), "character:B:status": ("active", 1, "")}


def test_index_by_kind_and_book(spark):
    docs = spark.createDataFrame([(1, "a", "chunk", "red fox"), (2, "b", "chunk", "red fox red"), (3, "a", "note", "red"), (4, "a", "chunk", "blue")], "id long, book string, kind string, t string")
    asked = spark.createDataFrame([(7, "a", ["red", "Fox"])], "query_id long, book string, terms array<string>")
    got = retrieval.Index.of(docs, "id", ["t"], ["book"], "kind").search(asked, 5, ["book"])
    assert sorted((r.id, r.rank) for r in got.collect()) == [(1, 1), (3, 1)]
    none = retrieval.knn(None, asked.withColumn("query_vector", F.array(F.lit(1.0))), "id", "v", 3, ["book"])
    assert none.count() == 0 and "distance" in none.columns
