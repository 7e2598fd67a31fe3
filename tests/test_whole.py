"""Queries over whole tables, held against SQL that leaves no row or character out."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"

if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

from skein.plans.adapters import BLANKS, CHAPTERS, DAYS  # noqa: E402
from skein.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return c


def same(df, twin):
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    at = [twin.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in twin.fetchall())


#: A chapter's own text holds its first line, so that every claim with words is supported by it, before any neighbour.
SUPPORTED = f"""WITH {CHAPTERS}, c AS (SELECT *, trim(string_split(text, chr(10))[1], ' ') AS claim FROM chapters),
s AS (SELECT book_id, chapter_id AS claim_id, CASE WHEN claim <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN claim <> '' THEN 'chapter' ELSE '' END AS source_type,
CASE WHEN claim <> '' THEN regexp_replace(substr(text, 1, 120), '^{BLANKS}+|{BLANKS}+$', '', 'g') ELSE '' END AS quote FROM c)"""


def test_evidence_of_own_text(spark, duck):
    same(QUERIES["evidence_scoring"](spark, FOLDER), duck.sql(f"{SUPPORTED} SELECT claim_id, score, source_type, quote FROM s"))
    same(QUERIES["evidence_report"](spark, FOLDER), duck.sql(f"{SUPPORTED} SELECT book_id, count(*) AS total_claims, count(*) FILTER (WHERE score > 0) AS supported_claims, count(*) FILTER (WHERE score = 0) AS unsupported_claims FROM s GROUP BY 1"))


def test_evidence_reads_whole_texts_of_neighbours(spark, tmp_path, monkeypatch):
    """Sources stand before and after the claim, whole; seen by what the operator is given."""
    from skein.operators import claims

    rows = [(i, f"{i} " + "x" * 4000 + f"\nbody {i} " + "y" * 4000, "b") for i in range(1, 6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    given = []
    real = claims.best_support
    monkeypatch.setattr(claims, "best_support", lambda pairs, keys: given.append(pairs) or real(pairs, keys))
    QUERIES["evidence_scoring"](spark, str(tmp_path))
    pairs = given[0].where("at = 3").orderBy("pos").collect()
    texts = {i: t for i, t, _ in rows}
    assert {r["claim"] for r in pairs} == {texts[3].split("\n")[0]}
    assert [(r["source_type"], r["source"]) for r in pairs] == [("chapter", texts[3]), ("prev1", texts[2]), ("prev2", texts[1]), ("next1", texts[4]), ("next2", texts[5])]


def test_upsert_reads_all_days(spark, duck):
    """With every day on one side, the last write of a key is that of the table."""
    same(QUERIES["upsert_facts_lww"](spark, FOLDER), duck.sql(f"""WITH {DAYS} SELECT book_id, event_type AS fact_key, value AS fact_value, pos FROM days
QUALIFY row_number() OVER (PARTITION BY book_id, event_type ORDER BY chapter_idx > 10 DESC, pos DESC) = 1"""))


@pytest.mark.parametrize("name", ["state_transition_events", "state_transition_items", "state_transition_facts", "snapshot_hash", "snapshot_restore_roundtrip", "limit_facts", "replay_state"])
def test_state_reads_all_events(spark, duck, name):
    """Every event row is a plot event and an item: the twin without its filters by remainder."""
    whole = SQL[name].replace(" WHERE event_id % 3 = 0", "").replace(" WHERE event_id % 3 = 1", "")
    same(QUERIES[name](spark, FOLDER), duck.sql(whole))


def test_hybrid_asks_with_the_stated_queries(spark, monkeypatch):
    from skein.plans import generate

    given = []
    real = generate.hybrid
    monkeypatch.setattr(generate, "hybrid", lambda docs, asked, *a: given.append(asked) or real(docs, asked, *a))
    QUERIES["hybrid_fusion"](spark, FOLDER)
    ids = [r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.query_id for r in given[0].select("query_id").collect()) == sorted(i for i in ids if i % 100 == 0)


def test_size_bins_of_whole_texts(spark, tmp_path):
    """Full lengths fill the bins; a chapter longer than a bin has one of its own."""
    sizes = [3500, 3500, 3500, 12_000, 10, 9_990, 1]
    spark.createDataFrame([(i, "x" * n, "b") for i, n in enumerate(sizes)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["size_binning"](spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["bin"] for r in got] == [1, 1, 2, 3, 4, 4, 5]
