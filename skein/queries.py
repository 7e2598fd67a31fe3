"""All queries over the package's own operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.text import clean_json, content_hash, keyword_terms, match_query, normalised, token_estimate
from .operators import claims, export, ingest, retrieval, state, store, tiers
from .operators.lineage import own_folder
from .plans.adapters import CHAPTERS, CHARACTERS, CHUNKS, DAYS, NARRATIONS, all_chunks, chapters, characters, days, narrations, stripped, table, texts
from .sources.html import with_markdown
from .sources.text_files import quality_score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHORT_LINE = r"^[^\n]{1,60}$"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ingest


@query(f"""SELECT doc_id, {stripped("array_to_string(list_transform(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: " + stripped("x") + " <> ''), lambda x: regexp_replace(x, '" + r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]" + "+$', '')), chr(10))")} AS text FROM documents""")
def ingest_normalize(spark, folder):
    return table(spark, folder, "documents").select("doc_id", normalised(F.col("text")).alias("text"))


@query(f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
marked AS (SELECT *, CAST(length(line) BETWEEN 1 AND 60 AS INTEGER) AS head FROM lines),
run AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos) AS seg, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM marked),
per AS (SELECT doc_id, seg, min(place) AS start_pos, max(place + length(line)) AS stop, string_agg(line, chr(10) ORDER BY pos) AS block, min_by(line, pos) AS first FROM run GROUP BY ALL),
more AS (SELECT *, lead(start_pos) OVER (PARTITION BY doc_id ORDER BY seg) AS next, max(seg) OVER (PARTITION BY doc_id) AS segs FROM per),
kept AS (SELECT *, {stripped("block")} AS b, {stripped("regexp_replace(" + stripped("block") + ", '^[^\\n]*\\n?', '')")} AS rest FROM more WHERE segs > 0 AND (seg > 0 OR {stripped("block")} <> '')),
found AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS INTEGER) AS idx, CASE WHEN seg = 0 THEN '序章' ELSE {stripped("first")} END AS title,
  CASE WHEN seg = 0 OR rest = '' THEN b ELSE rest END AS body, CAST(start_pos AS INTEGER) AS start_pos, CAST(coalesce(next, stop) AS INTEGER) AS end_pos FROM kept),
plain AS (SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 1) / 20000.0) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0 AND doc_id IN (SELECT doc_id FROM per GROUP BY 1 HAVING max(seg) = 0))
SELECT * FROM found UNION ALL SELECT doc_id, CAST(k + 1 AS INTEGER), '第' || (k + 1) || '章', {stripped("substr(text, k * 20000 + 1, 20000)")}, CAST(k * 20000 AS INTEGER), CAST(least((k + 1) * 20000, length(text)) AS INTEGER) FROM plain""")
def ingest_chapters_by_heading(spark, folder):
    return ingest.chapters(table(spark, folder, "documents"), "doc_id", SHORT_LINE)


@query(f"""WITH cut AS (SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 1) / 2000.0) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(k + 1 AS INTEGER) AS idx, '第' || (k + 1) || '章' AS title, {stripped("substr(text, k * 2000 + 1, 2000)")} AS body, CAST(k * 2000 AS INTEGER) AS start_pos, CAST(least((k + 1) * 2000, length(text)) AS INTEGER) AS end_pos FROM cut""")
def ingest_fallback_split(spark, folder):
    return ingest.fixed_slices(table(spark, folder, "documents"), "doc_id", width=2000)


@query(f"WITH {CHUNKS} SELECT book_id, chapter_id, chunk_id, chapter_idx, idx, chunk_text, start_pos, end_pos, token_count FROM chunks")
def ingest_chunks(spark, folder):
    return all_chunks(spark, folder).drop("title")


@query(f"WITH {CHAPTERS} SELECT chapter_id, sha256(text) AS book_hash, sha256(book_id || '::' || title || '::' || text) AS chapter_hash FROM chapters")
def content_hashes(spark, folder):
    return texts(spark, folder).select("chapter_id", content_hash("text").alias("book_hash"), ingest.chapter_hash(F.col("book_id"), F.col("title"), F.col("text")).alias("chapter_hash"))


@query("""WITH hashed AS (SELECT doc_id, sha256(text) AS content_hash FROM documents), old AS (SELECT content_hash FROM hashed WHERE doc_id % 3 = 0)
SELECT min(doc_id) AS doc_id, content_hash FROM hashed WHERE doc_id % 3 <> 0 AND content_hash NOT IN (SELECT content_hash FROM old) GROUP BY content_hash""")
def dedupe_insert_ignore(spark, folder):
    hashed = table(spark, folder, "documents").select("doc_id", content_hash("text").alias("content_hash"))
    return store.insert_ignore(hashed.where("doc_id % 3 = 0"), hashed.where("doc_id % 3 <> 0"), ["content_hash"], ["doc_id"])


@query("""WITH s AS (SELECT doc_id, substr(text, 1, 120000) AS t FROM documents), c AS (SELECT doc_id, length(t) AS n,
  regexp_replace(t, '[\\n\\r\\t\\x20-\\x7e\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2b73f}\\x{2b740}-\\x{2b81f}\\x{2b820}-\\x{2ceaf}]', '', 'g') AS other,
  length(regexp_replace(t, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2b73f}\\x{2b740}-\\x{2b81f}\\x{2b820}-\\x{2ceaf}]', '', 'g')) AS no_cjk,
  len(regexp_extract_all(t, '(?m)^第[0-9一二三四五六七八九十百千]+章.*$')) AS heads FROM s),
d AS (SELECT *, length(other) AS odd, length(regexp_replace(other, '[\\p{C}\\p{Zl}\\p{Zp}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}]', '', 'g')) AS printable FROM c)
SELECT doc_id, CASE WHEN n = 0 THEN -1e9 ELSE round((n - odd) / n::DOUBLE * 100 + (n - no_cjk) / n::DOUBLE * 20 + least(heads, 300) * 0.5::DOUBLE - (odd - printable) / n::DOUBLE * 200, 6) END AS score FROM d""")
def encoding_score(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.round(quality_score(F.col("text")), 6).alias("score"))


@query(f"WITH {CHUNKS} SELECT book_id, chapter_id, {stripped('string_agg(chunk_text, chr(10) ORDER BY idx)')} AS text FROM chunks GROUP BY ALL")
def chapter_text_rebuild(spark, folder):
    return ingest.rebuilt(all_chunks(spark, folder), ["book_id", "chapter_id"])


# store


@query(f"WITH {NARRATIONS} SELECT narration_id, book_id, chapter_idx, title, version, narration_text FROM narrations QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY created_at DESC, narration_id DESC) = 1")
def latest_narration(spark, folder):
    return store.latest(narrations(spark, folder), ["chapter_id"], ["created_at", "narration_id"]).select("narration_id", "book_id", "chapter_idx", "title", "version", "narration_text")


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_output(spark, folder):
    return store.latest(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query(f"""WITH {DAYS}, marks AS (SELECT book_id, CAST(ceil(chapter_idx / 5.0) * 5 AS BIGINT) AS chapter_idx, count(*) AS n FROM days GROUP BY ALL), targets AS (SELECT DISTINCT book_id, CAST(chapter_idx AS BIGINT) AS target FROM days)
SELECT t.book_id, t.target, m.chapter_idx AS checkpoint_idx, m.n AS events_in_step FROM targets t ASOF LEFT JOIN marks m ON t.book_id = m.book_id AND t.target >= m.chapter_idx""")
def asof_checkpoint(spark, folder):
    d = days(spark, folder)
    marks = d.groupBy("book_id", (F.ceil(F.col("chapter_idx") / 5) * 5).cast("long").alias("chapter_idx")).agg(F.count("*").alias("n"))
    targets = d.select("book_id", F.col("chapter_idx").cast("long").alias("target")).distinct()
    found = store.asof(targets, marks, "book_id", "target", "chapter_idx", ["n"])
    return found.select("book_id", "target", F.col("found.chapter_idx").alias("checkpoint_idx"), F.col("found.n").alias("events_in_step"))


@query(f"""WITH {DAYS}, old AS (SELECT book_id, event_type AS fact_key, value AS fact_value, pos FROM days WHERE chapter_idx <= 10 QUALIFY row_number() OVER (PARTITION BY book_id, event_type ORDER BY pos DESC) = 1),
new AS (SELECT book_id, event_type AS fact_key, value AS fact_value, pos FROM days WHERE chapter_idx > 10 QUALIFY row_number() OVER (PARTITION BY book_id, event_type ORDER BY pos DESC) = 1)
SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.book_id = o.book_id AND n.fact_key = o.fact_key)""")
def upsert_facts_lww(spark, folder):
    rows = days(spark, folder).select("book_id", F.col("event_type").alias("fact_key"), F.col("value").alias("fact_value"), "pos", "chapter_idx")
    old = store.latest(rows.where("chapter_idx <= 10"), ["book_id", "fact_key"], ["pos"]).drop("chapter_idx")
    return store.upsert(old, rows.where("chapter_idx > 10"), ["book_id", "fact_key"], ["pos"])


@query(f"""WITH {DAYS}, old AS (SELECT book_id, chapter_idx, count(*) AS n, min(pos) AS first_pos FROM days WHERE chapter_idx <= 15 GROUP BY ALL), new AS (SELECT book_id, chapter_idx, count(*) * 100 AS n, max(pos) AS first_pos FROM days WHERE chapter_idx >= 10 GROUP BY ALL)
SELECT coalesce(o.book_id, w.book_id) AS book_id, coalesce(o.chapter_idx, w.chapter_idx) AS chapter_idx, CASE WHEN w.book_id IS NOT NULL THEN w.n ELSE o.n END AS n, CASE WHEN o.book_id IS NOT NULL THEN o.first_pos ELSE w.first_pos END AS first_pos
FROM old o FULL JOIN new w ON o.book_id = w.book_id AND o.chapter_idx = w.chapter_idx""")
def upsert_partial_columns(spark, folder):
    d = days(spark, folder)
    old = d.where("chapter_idx <= 15").groupBy("book_id", "chapter_idx").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    new = d.where("chapter_idx >= 10").groupBy("book_id", "chapter_idx").agg((F.count("*") * 100).alias("n"), F.max("pos").alias("first_pos"))
    return store.merge_columns(old, new, ["book_id", "chapter_idx"], ["n"])


@query(f"""WITH {DAYS}, chapters AS (SELECT DISTINCT book_id, chapter_idx FROM days)
SELECT c.book_id, c.chapter_idx, d.chapter_idx AS event_idx, d.event_id, CAST(row_number() OVER (PARTITION BY c.book_id, c.chapter_idx ORDER BY d.chapter_idx DESC, d.event_id DESC) AS INTEGER) AS n
FROM chapters c JOIN days d ON d.book_id = c.book_id AND d.chapter_idx >= greatest(1, c.chapter_idx - 5) AND d.chapter_idx < c.chapter_idx QUALIFY n <= 20""")
def recent_events_window(spark, folder):
    d = days(spark, folder)
    return claims.recent_events(d, d.select("book_id", "chapter_idx"), 5).select("book_id", "chapter_idx", "event_idx", "event_id", "n")


@query(f"WITH {CHUNKS} SELECT chunk_id, chapter_id, idx FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chapter_id % 4 = 0)")
def anti_unembedded(spark, folder):
    c = all_chunks(spark, folder).select("chunk_id", "chapter_id", "idx")
    return store.unseen(c, c.where("chapter_id % 4 = 0"), ["chunk_id"])


@query(f"WITH {NARRATIONS} SELECT narration_id, chapter_id, prompt_version, sha256(narration_text) AS input_hash FROM narrations n WHERE NOT EXISTS (SELECT 1 FROM narrations d WHERE d.version = 1 AND d.chapter_id % 2 = 0 AND d.chapter_id = n.chapter_id AND d.prompt_version = n.prompt_version AND d.narration_text = n.narration_text)")
def memo_identity_skip(spark, folder):
    rows = narrations(spark, folder).select("narration_id", "chapter_id", "prompt_version", content_hash("narration_text").alias("input_hash"), "version")
    done = rows.where("version = 1 AND chapter_id % 2 = 0")
    return store.unseen(rows.drop("version"), done, ["chapter_id", "prompt_version", "input_hash"]).select("narration_id", "chapter_id", "prompt_version", "input_hash")


@query("""WITH cache AS (SELECT event_type || ':' || user_id AS key, value, epoch(ts)::DOUBLE AS created_at, event_id FROM events), newest AS (SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) = 1)
SELECT key, value FROM newest WHERE (SELECT max(created_at) FROM cache) - created_at <= 432000""")
def cache_ttl(spark, folder):
    cache = table(spark, folder, "events").select(F.concat("event_type", F.lit(":"), "user_id").alias("key"), "value", F.unix_timestamp("ts").cast("double").alias("created_at"), "event_id")
    newest = store.latest(cache, ["key"], ["created_at", "event_id"]).drop("event_id")
    return store.unexpired(newest.crossJoin(cache.agg(F.max("created_at").alias("now"))), F.col("now"), 432_000).select("key", "value")  # one row


@query(f"WITH {NARRATIONS} SELECT chapter_id, max(version) AS version, max_by(narration_text, version) AS narration_text, count(*) AS written FROM narrations GROUP BY 1")
def commit_after_conflict(spark, folder):
    """Two writers start from one version of two tables; the second finds the latest narrations changed, starts again, and both are in both tables."""
    n = narrations(spark, folder).select("chapter_id", "version", "narration_text")
    tables = store.Tables(spark, own_folder(spark))

    def write(rows: DataFrame, at: int) -> None:
        held = store.upsert(tables.read("latest", at), rows, ["chapter_id"], ["version"])
        tables.commit(append={"narrations": rows}, replace={"latest": held}, at=at)

    base = tables.commit(replace={"narrations": n.limit(0), "latest": n.limit(0)})
    write(n.where("version = 1"), base)
    try:
        write(n.where("version = 2"), base)
    except store.Conflict:
        write(n.where("version = 2"), tables.version())
    written = tables.read("narrations").groupBy("chapter_id").agg(F.count("*").alias("written"))
    return tables.read("latest").join(written, "chapter_id")


@query("SELECT user_id AS book_id, event_id FROM events WHERE user_id <> 3")
def clear_book(spark, folder):
    return state.clear_book(table(spark, folder, "events").select(F.col("user_id").alias("book_id"), "event_id"), 3)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def broken_references(spark, folder):
    return store.broken_references(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), table(spark, folder, "customer").where("c_nationkey <> 3"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


# retrieval

TOKENS = r"regexp_extract_all(lower(title || ' ' || chunk_text), '[\p{L}\p{N}]+')"
TERMS = "asked AS (SELECT * FROM (VALUES (1, ['the', 'doc', 'tion']), (2, ['der', 'ung', 'doc']), (3, ['la', 'ment'])) q(query_id, terms))"
BM25 = f"""{CHUNKS}, {TERMS}, tok AS (SELECT chunk_id, len({TOKENS}) AS size, {TOKENS} AS tokens FROM chunks), stat AS (SELECT count(*) AS n, avg(size) AS mean FROM tok),
post AS (SELECT chunk_id, size, term, count(*) AS tf FROM (SELECT chunk_id, size, unnest(tokens) AS term FROM tok) GROUP BY ALL), want AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM asked),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), weight AS (SELECT term, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf, mean FROM df, stat),
scored AS (SELECT query_id, chunk_id, -sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score FROM post JOIN weight USING (term) JOIN want USING (term) GROUP BY ALL)"""


def asked(spark: SparkSession) -> DataFrame:
    # literal rows have a known size, so that Spark itself decides whether to broadcast them
    return spark.sql("SELECT * FROM VALUES (1, array('the', 'doc', 'tion')), (2, array('der', 'ung', 'doc')), (3, array('la', 'ment')) AS q(query_id, terms)")


def keyword_hits(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    hits = retrieval.bm25(all_chunks(spark, folder), asked(spark), "chunk_id", ["title", "chunk_text"], limit)
    return hits.withColumn("score", F.round("score", 6))


@query(f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 20")
def bm25_search(spark, folder):
    return keyword_hits(spark, folder, 20)


DISTANCE = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
KNN = f"""near AS (SELECT CAST(q.vec_id AS BIGINT) AS query_id, e.vec_id, {DISTANCE} AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE}, e.vec_id) AS INTEGER) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 30)"""


def near(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    asked_ = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.knn(e, asked_, "vec_id", "embedding", 30)


@query(f"WITH {KNN} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM near WHERE rank <= 10")
def knn_l2(spark, folder):
    return near(spark, folder).where("rank <= 10").withColumn("distance", F.round("distance", 6))


@query()
def knn_cells(spark, folder):
    """The same search in cells of near vectors: each query looks into 24 of them, and distances there are exact."""
    e = table(spark, folder, "embeddings")
    asked_ = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = retrieval.knn(e, asked_, "vec_id", "embedding", 10, cells=retrieval.Cells.fit(e, "embedding"))
    return found.withColumn("distance", F.round("distance", 6))


@query("""WITH raw AS (SELECT doc_id, list_filter(list_transform(['given', lang] || regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}A-Za-z0-9_]{2,20}'), lambda t: trim(t)), lambda t: t <> '') AS t FROM documents),
first AS (SELECT doc_id, list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 8) AS terms FROM raw)
SELECT doc_id, array_to_string(terms, ',') AS terms, array_to_string(list_transform(terms, lambda t: '"' || t || '"'), ' OR ') AS match_query FROM first""")
def keyword_terms_query(spark, folder):
    terms = keyword_terms(F.col("text"), F.array(F.lit("given"), F.col("lang")))
    return table(spark, folder, "documents").withColumn("t", terms).select("doc_id", F.array_join("t", ",").alias("terms"), match_query(F.col("t")).alias("match_query"))


@query(f"WITH {KNN} SELECT query_id, vec_id, round(greatest(0, 1 - (rank - 1) / count(*) OVER (PARTITION BY query_id)::DOUBLE), 6) AS score FROM near")
def rank_normalize(spark, folder):
    size = F.count("*").over(W.partitionBy("query_id"))
    return near(spark, folder).select("query_id", "vec_id", F.round(retrieval.rank_score(F.col("rank"), size), 6).alias("score"))


HITS = f"""WITH {KNN}, hits AS (
  SELECT query_id, 40 AS current_idx, 0 AS leg, rank, 'chunk' AS source_type, vec_id AS source_id, CAST(vec_id // 10 + 1 AS INTEGER) AS chapter_idx FROM near WHERE vec_id % 2 = 0 AND rank <= 24
  UNION ALL SELECT query_id, 40, 1, rank, 'narration', vec_id, CAST(vec_id // 10 + 1 AS INTEGER) FROM near WHERE vec_id % 2 = 1 AND rank <= 16
  UNION ALL SELECT query_id, 40, 2, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS INTEGER), CASE WHEN vec_id % 2 = 0 THEN 'chunk' ELSE 'narration' END, vec_id, CAST(vec_id // 10 + 1 AS INTEGER) FROM near WHERE vec_id % 3 = 0)"""


def hits(spark: SparkSession, folder: str) -> DataFrame:
    n = near(spark, folder).withColumn("chapter_idx", (F.floor(F.col("vec_id") / 10) + 1).cast("int"))
    kind = F.when(F.col("vec_id") % 2 == 0, "chunk").otherwise("narration")
    legs = [(0, "vec_id % 2 = 0 AND rank <= 24", F.col("rank")), (1, "vec_id % 2 = 1 AND rank <= 16", F.col("rank")), (2, "vec_id % 3 = 0", F.row_number().over(W.partitionBy("query_id").orderBy("vec_id")))]
    parts = [n.where(c).select("query_id", F.lit(40).alias("current_idx"), F.lit(leg).alias("leg"), r.alias("rank"), kind.alias("source_type"), F.col("vec_id").alias("source_id"), "chapter_idx") for leg, c, r in legs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{HITS}, s AS (SELECT *, greatest(0, 1 - (rank - 1) / count(*) OVER (PARTITION BY query_id, leg)::DOUBLE) AS s FROM hits), f AS (SELECT * FROM s WHERE chapter_idx < current_idx),
g AS (SELECT query_id, source_type, source_id, coalesce(max(s) FILTER (WHERE leg < 2), 0) AS v, coalesce(max(s) FILTER (WHERE leg = 2), 0) AS k, min_by(chapter_idx, leg * 1000 + rank) AS chapter_idx, min(leg * 1000 + rank) AS seq FROM f GROUP BY ALL),
t AS (SELECT *, 0.7::DOUBLE * v + (1 - 0.7::DOUBLE) * k + 0.2::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + (40 - chapter_idx))) AS score FROM g)
SELECT query_id, source_type, source_id, chapter_idx, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS INTEGER) AS rank FROM t QUALIFY rank <= 8""")
def hybrid_batched(spark, folder):
    return retrieval.fuse(hits(spark, folder), 8).withColumn("score", F.round("score", 6))


@query(f"""{HITS}, own AS (SELECT query_id, rank, source_id, chapter_idx, CAST(query_id // 10 + 1 AS INTEGER) AS own_idx FROM hits WHERE leg = 0)
SELECT query_id, source_id, chapter_idx, CAST(row_number() OVER (PARTITION BY query_id ORDER BY (chapter_idx = own_idx) DESC, rank) AS INTEGER) AS place FROM own QUALIFY place <= 6""")
def evidence_prefer_chapter(spark, folder):
    own = hits(spark, folder).where("leg = 0").withColumn("current_idx", (F.floor(F.col("query_id") / 10) + 1).cast("int"))
    return retrieval.prefer_chapter(own, 6).select("query_id", "source_id", "chapter_idx", "place")


# tiers, steps, drafts

RULE = tiers.Tiering(default="medium", long_every_n=7, long_min_chars=6000, long_keywords=("license", "Ñ"))
TIER = "CASE WHEN idx % 7 = 0 THEN 'long' WHEN length(text) >= 6000 THEN 'long' WHEN contains(lower(title || chr(10) || substr(text, 1, 4000)), 'license') OR contains(lower(title || chr(10) || substr(text, 1, 4000)), 'ñ') THEN 'long' ELSE 'medium' END"


@query(f"WITH {CHAPTERS} SELECT chapter_id, {TIER} AS tier FROM chapters")
def tier_decision(spark, folder):
    return chapters(spark, folder).select("chapter_id", tiers.tier(RULE, F.col("idx"), F.col("title"), F.col("text")).alias("tier"))


@query(f"""WITH {CHAPTERS}, t AS (SELECT chapter_id, {TIER} AS tier FROM chapters) SELECT chapter_id, tier, CASE tier WHEN 'long' THEN 0.4 ELSE 0.2 END::DOUBLE AS ratio_low, CASE tier WHEN 'long' THEN 0.5 ELSE 0.3 END::DOUBLE AS ratio_high,
CASE tier WHEN 'long' THEN 8 ELSE 4 END AS memory_top_k, true AS include_key_dialogue, tier = 'long' AS include_inner_thoughts, tier = 'long' AS refine_enabled, 'llm' AS entity_extract_mode FROM t""")
def tier_overrides(spark, folder):
    decided = tier_decision(spark, folder)
    return decided.join(tiers.tier_table(spark), "tier").select("chapter_id", "tier", "ratio_low", "ratio_high", "memory_top_k", "include_key_dialogue", "include_inner_thoughts", "refine_enabled", "entity_extract_mode")


@query(f"""WITH {CHAPTERS}, s AS (SELECT book_id, CAST((idx - 1) // 5 * 5 + 1 AS INTEGER) AS step_start, count(*) AS chapters FROM chapters GROUP BY ALL), m AS (SELECT book_id, max(idx) AS most FROM chapters GROUP BY 1)
SELECT book_id, step_start, CAST(least(most, step_start + 4) AS INTEGER) AS step_end, chapters FROM s JOIN m USING (book_id)""")
def step_ranges(spark, folder):
    return tiers.step_ranges(chapters(spark, folder), "book_id", "idx", 5)


@query(f"""WITH {CHAPTERS}, s AS (SELECT book_id, CAST((idx - 1) // 5 * 5 + 1 AS INTEGER) AS step_start, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS t FROM chapters GROUP BY ALL)
SELECT book_id, step_start, {stripped("substr(t, 1, greatest(1, CAST(floor(length(t) * 0.3::DOUBLE) AS INTEGER)))")} AS narration FROM s""")
def step_batch_draft(spark, folder):
    ch = chapters(spark, folder)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))  # a step has `size` chapters
    steps = ch.groupBy("book_id", tiers.step_start(F.col("idx"), 5).alias("step_start")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("t"))
    return steps.select("book_id", "step_start", tiers.draft(F.col("t"), 0.3).alias("narration"))


@query(f"WITH {NARRATIONS} SELECT narration_id, chapter_id, narration_text, 'Chapter ' || chapter_idx || ' draft narration generated' AS what FROM narrations")
def draft_narration(spark, folder):
    return narrations(spark, folder).select("narration_id", "chapter_id", "narration_text", F.concat(F.lit("Chapter "), "chapter_idx", F.lit(" draft narration generated")).alias("what"))


@query("""WITH r AS (SELECT doc_id, regexp_extract_all(translate(text, 'abcdefghijklmnop', '赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨'), '[\\x{4e00}-\\x{9fff}]{2,8}') AS t FROM documents)
SELECT doc_id, array_to_string(list_slice(list_filter(t, lambda x, i: list_position(list_slice(t, 1, i - 1), x) IS NULL OR list_position(list_slice(t, 1, i - 1), x) = 0), 1, 16), ',') AS entities FROM r""")
def entity_fallback(spark, folder):
    """Names found in texts; the tables hold no such script, so half of the Latin letters are read as family names."""
    from .plans.generate import fallback_entities

    text = F.translate("text", "abcdefghijklmnop", "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨")
    return table(spark, folder, "documents").select("doc_id", F.array_join(fallback_entities(text), ",").alias("entities"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(length(text) // 2 AS INTEGER)) END AS tokens, sha256('narration::model::v1::' || sha256(text) || '::0.3') AS cache_key FROM documents")
def token_estimates(spark, folder):
    key = content_hash(F.lit("narration"), F.lit("model"), F.lit("v1"), F.sha2("text", 256), F.lit("0.3"))
    return table(spark, folder, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"), key.alias("cache_key"))


@query(f"""WITH {NARRATIONS}, w AS (SELECT c.book_id, c.idx, c.text, n.narration_text, {TIER.replace("idx", "c.idx").replace("text", "c.text").replace("title", "c.title")} = 'long' AS refine, row_number() OVER (PARTITION BY sha256(c.text) ORDER BY c.chapter_id) > 1 AS hit FROM narrations n JOIN chapters c USING (chapter_id) WHERE version = 1),
t AS (SELECT *, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END AS i, CASE WHEN length(narration_text) = 0 THEN 0 ELSE greatest(1, length(narration_text) // 2) END AS o FROM w)
SELECT book_id, count(*) AS chapters_total, count(*) FILTER (WHERE length(narration_text) > 0) AS chapters_processed, CAST(0 AS BIGINT) AS chapters_skipped, count(*) + count(*) FILTER (WHERE refine) AS llm_calls, count(*) FILTER (WHERE refine) AS refine_llm_calls,
count(*) FILTER (WHERE hit) AS cache_hits, count(*) + count(*) FILTER (WHERE refine) - count(*) FILTER (WHERE hit) AS cache_misses, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
CAST(coalesce(sum(o) FILTER (WHERE refine), 0) AS BIGINT) AS refine_input_tokens, CAST(coalesce(sum(o) FILTER (WHERE refine), 0) AS BIGINT) AS refine_output_tokens, CAST(0 AS BIGINT) AS consistency_warnings, CAST(0 AS BIGINT) AS consistency_actions,
CAST(0 AS BIGINT) AS evidence_supported_claims, CAST(0 AS BIGINT) AS evidence_unsupported_claims, CAST(max(idx) AS INTEGER) AS max_chapter_idx, CAST(NULL AS DOUBLE) AS runtime_seconds FROM t GROUP BY 1""")
def run_report(spark, folder):
    """One call a chapter and one more where its tier refines; a prompt that an earlier chapter had is a cache hit."""
    n = narrations(spark, folder).where("version = 1").select("chapter_id", F.col("narration_text").alias("narration"))
    rows = chapters(spark, folder).withColumn("tier", tiers.tier(RULE, F.col("idx"), F.col("title"), F.col("text"))).join(n, "chapter_id")
    again = F.row_number().over(W.partitionBy(F.sha2("text", 256)).orderBy("chapter_id")) > 1
    refine = (F.col("tier") == "long").cast("long")
    return tiers.run_report(rows.withColumn("refine_calls", refine).withColumn("calls", 1 + refine).withColumn("cache_hit", again))


@query(f"""WITH {CHAPTERS}, t AS (SELECT *, {TIER} AS tier FROM chapters),
n AS (SELECT *, {stripped("substr(text, 1, greatest(1, CAST(floor(length(text) * CASE tier WHEN 'long' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) AS INTEGER)))")} AS narration_text FROM t),
e AS (SELECT chapter_id, list_distinct(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}')) AS names, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}') AS all_ FROM chapters)
SELECT n.book_id, n.chapter_id, n.idx AS chapter_idx, n.title, n.tier, n.narration_text, 'v1' AS prompt_version, sha256(n.chapter_id || '::' || n.idx || '::' || n.text || '::' || n.tier || '::draft') AS input_hash,
array_to_string(list_slice(list_filter(all_, lambda x, i: list_position(all_, x) = i), 1, 16), ',') AS entities FROM n JOIN e USING (chapter_id)""")
def narration_run(spark, folder):
    """The run from end to end, with drafts: narrations and the entities of their stored outputs."""
    from .plans.narrate import narrate

    run = narrate(chapters(spark, folder), RULE)
    named = run.outputs.select("chapter_id", F.array_join(F.from_json("payload_json", "entities_mentioned array<string>")["entities_mentioned"], ",").alias("entities"))
    return run.narrations.join(named, "chapter_id")


TOLD = f"""WITH {CHAPTERS}, c AS (SELECT *, CAST((idx - 1) // 5 * 5 + 1 AS INTEGER) AS step, {TIER} AS tier FROM chapters),
h AS (SELECT *, sha256(chapter_id || '::' || idx || '::' || text || '::' || tier || '::quoting') AS h FROM c),
s AS (SELECT book_id, step, max(idx) AS chapter_idx, max_by(chapter_id, idx) AS chapter_id, max_by(title, idx) AS title, min_by(text, idx) AS body, min_by(tier, idx) AS tier, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS whole, sha256(string_agg(h, '::' ORDER BY idx)) AS input_hash FROM h GROUP BY ALL),
told AS (SELECT *, CASE WHEN {stripped("substr(body, 1, 60)")} = '' THEN {stripped("substr(" + stripped("whole") + ", 1, greatest(1, CAST(floor(length(" + stripped("whole") + ") * CASE tier WHEN 'long' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) AS INTEGER)))")} ELSE {stripped("substr(body, 1, 60)")} END AS narration_text FROM s),
proposed AS (SELECT *, {stripped("substr(body, 11, 30)")} AS what FROM told WHERE length(body) >= 40 AND {stripped("substr(body, 1, 60)")} <> ''),
runs AS (SELECT *, (step - 1) // 5 - row_number() OVER (PARTITION BY book_id, what ORDER BY step) AS island FROM proposed WHERE what <> ''),
kept AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY book_id, what, island ORDER BY step) % 2 = 1)"""


def told_steps(spark: SparkSession, folder: str):
    from .functions.providers import QuotingGenerator
    from .plans.narrate import narrate

    return narrate(chapters(spark, folder), RULE, QuotingGenerator(), step_size=5)


@query(f"""{TOLD} SELECT t.book_id, t.chapter_id, t.chapter_idx, t.title, t.tier, t.narration_text, 'step_v1' AS prompt_version, t.input_hash, t.step AS first_idx, t.chapter_idx AS last_idx, CAST(k.chapter_id IS NOT NULL AS INTEGER) AS events FROM told t LEFT JOIN kept k ON k.chapter_id = t.chapter_id""")
def step_narration_run(spark, folder):
    """Steps of five chapters, told as one by a generator that quotes: narrations, ranges and events of their stored outputs. An event that repeats
    the step before it is dropped."""
    run = told_steps(spark, folder)
    payload = F.from_json("payload_json", "step_start_chapter_idx int, step_end_chapter_idx int, key_events array<struct<what:string>>")
    parsed = run.outputs.select("chapter_id", payload.alias("p")).select("chapter_id", F.col("p.step_start_chapter_idx").alias("first_idx"), F.col("p.step_end_chapter_idx").alias("last_idx"), F.size("p.key_events").alias("events"))
    return run.narrations.join(parsed, "chapter_id")


@query(f"""{TOLD}, u AS (SELECT book_id, chapter_idx, {stripped("substr(body, 1, 3)")} AS name, {stripped("substr(body, 21, 10)")} AS after, what AS evidence FROM proposed), i AS (SELECT book_id, chapter_idx, substr(body, 6, 4) AS name, substr(body, 1, 3) AS owner, substr(body, 11, 30) AS description FROM proposed),
w AS (SELECT book_id, chapter_idx, 0 AS stage, 'event:' || chapter_idx || ':' || substr(sha256(what), 1, 12) AS fact_key, what AS fact_value, what AS excerpt FROM kept
  UNION ALL SELECT book_id, max(chapter_idx), 1, 'character:' || name || ':status', max_by(after, chapter_idx) FILTER (WHERE after <> ''), max_by(evidence, chapter_idx) FROM u WHERE name <> '' GROUP BY book_id, name
  UNION ALL SELECT book_id, chapter_idx, 2, 'item:' || name || ':owner', owner, CASE WHEN {stripped("description")} = '' THEN owner ELSE {stripped("description")} END FROM i WHERE {stripped("name")} <> '' AND {stripped("owner")} <> '')
SELECT book_id, fact_key, coalesce(fact_value, 'active') AS fact_value, CAST(chapter_idx AS INTEGER) AS source_chapter_idx, substr(excerpt, 1, 300) AS source_excerpt FROM w QUALIFY row_number() OVER (PARTITION BY book_id, fact_key ORDER BY chapter_idx DESC, stage DESC) = 1""")
def step_narration_facts(spark, folder):
    """The facts that the same run leaves, after consistency and evidence."""
    return told_steps(spark, folder).world_facts.select("book_id", "fact_key", "fact_value", "source_chapter_idx", "source_excerpt")


ANSWERS = """a AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(event_id % 6 AS INTEGER) AS kind FROM events)"""


@query(f"""WITH {ANSWERS} SELECT event_id, CASE kind WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 4 THEN event_type || ' in plain words' ELSE event_type END AS narration, CASE WHEN kind <= 1 THEN k END AS k, CASE WHEN kind = 0 THEN 1 END AS n_events,
CASE kind WHEN 0 THEN 'answer' WHEN 1 THEN 'answer' WHEN 2 THEN 'partial' WHEN 4 THEN 'text' ELSE 'none' END AS source, CASE kind WHEN 2 THEN 'key_events is not a list of an object; k is not a whole number' WHEN 3 THEN 'narration is missing' WHEN 4 THEN 'no JSON' WHEN 5 THEN 'empty' END AS reason FROM a""")
def structured_answers(spark, folder):
    """Answers of all kinds read under a schema: whole, in a fence or amid text, with wrong types, without the main field, plain, empty."""
    from .functions.answers import best_effort

    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    kind, q = F.col("event_id") % 6, F.to_json(F.struct(F.col("event_type").alias("narration")))
    inner = F.substr(q, F.lit(2), F.length(q) - 2)
    whole = F.concat(F.lit("{"), inner, F.lit(',"key_events":[{"what":"x"}],"k":'), "k", F.lit(",}"))
    answers = F.when(kind == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here: {"), inner, F.lit(',"k":'), "k", F.lit("} done")))
    answers = answers.when(kind == 2, F.concat(F.lit("{"), inner, F.lit(',"key_events":"none","k":"'), "k", F.lit('"}'))).when(kind == 3, F.lit('{"key_events":[]}')).when(kind == 4, F.concat("event_type", F.lit(" in plain words"))).otherwise("")
    b = best_effort(answers, "narration string, key_events array<struct<what:string>>, k int", "narration")
    return e.select("event_id", b.alias("b")).select("event_id", "b.value.narration", "b.value.k", F.size("b.value.key_events").alias("n_events"), "b.source", "b.reason").withColumn("n_events", F.when(F.col("n_events") >= 0, F.col("n_events")))


LEVELS = f"""WITH RECURSIVE {CHUNKS}, low AS (SELECT book_id, chapter_id, chapter_idx, idx, {stripped("substr(chunk_text, 1, 120)")} AS content FROM chunks),
ch AS (SELECT book_id, chapter_id, chapter_idx, {stripped("substr(string_agg(content, chr(10) ORDER BY idx), 1, 120)")} AS content FROM low GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx) AS k, sum(length(content)) OVER (PARTITION BY book_id) > 2000 AND count(*) OVER (PARTITION BY book_id) > 1 AS large FROM ch),
b(book_id, k, bin, fill) AS (SELECT book_id, k, 1, CAST(length(content) AS BIGINT) FROM n WHERE k = 1 AND large UNION ALL SELECT n.book_id, n.k, CASE WHEN fill > 0 AND fill + length(content) > 2000 THEN bin + 1 ELSE bin END, CASE WHEN fill > 0 AND fill + length(content) > 2000 THEN length(content) ELSE fill + length(content) END FROM b JOIN n ON n.book_id = b.book_id AND n.k = b.k + 1),
f AS (SELECT book_id, bin AS k, CASE WHEN count(*) = 1 THEN min(content) ELSE {stripped("substr(string_agg(content, chr(10) ORDER BY k), 1, 120)")} END AS content FROM n JOIN b USING (book_id, k) GROUP BY book_id, bin),
items AS (SELECT book_id, k, content FROM n WHERE NOT large UNION ALL SELECT * FROM f), whole AS (SELECT book_id, {stripped("substr(string_agg(content, chr(10) ORDER BY k), 1, 120)")} AS content FROM items GROUP BY 1)"""


@query(f"""{LEVELS} SELECT book_id, 'chunk' AS scope, chapter_id || ':' || idx AS ref_id, 'chunk_summary' AS summary_type, content FROM low UNION ALL SELECT book_id, 'chapter', CAST(chapter_id AS VARCHAR), 'chapter_summary', content FROM ch
UNION ALL SELECT book_id, 'book', book_id, t, content FROM whole, (VALUES ('book_summary'), ('story')) v(t)""")
def summary_levels(spark, folder):
    """Chunk, chapter, book and story summaries by their first characters; chapters of a book are folded until 2,000 characters hold them."""
    from .functions.providers import LeadingGenerator
    from .plans.summarize import summarised

    rows, _ = summarised(all_chunks(spark, folder).select("book_id", "chapter_id", "chapter_idx", "idx", "chunk_text"), LeadingGenerator(), most=2000)
    return rows.select("book_id", "scope", "ref_id", "summary_type", "content")


# claims


@query(f"""WITH {DAYS}, ev AS (SELECT book_id, chapter_idx, pos, event_type || ' ' || CAST(floor(value / 20) AS INTEGER) AS what FROM days), rec AS (SELECT DISTINCT book_id, chapter_idx + 1 AS chapter_idx, what FROM ev),
f AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY book_id, chapter_idx, what ORDER BY pos) = 1)
SELECT book_id, chapter_idx, what, pos FROM f WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.book_id = f.book_id AND rec.chapter_idx = f.chapter_idx AND rec.what = f.what) QUALIFY row_number() OVER (PARTITION BY book_id, chapter_idx ORDER BY pos) <= 20""")
def event_consistency(spark, folder):
    ev = days(spark, folder).select("book_id", "chapter_idx", "pos", F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 20).cast("int")).alias("what"))
    recent = ev.select("book_id", (F.col("chapter_idx") + 1).alias("chapter_idx"), F.col("what").alias("event_summary"))
    return claims.consistent_events(ev, recent).select("book_id", "chapter_idx", "what", "pos")


ALIAS = f"""{DAYS}, {CHARACTERS}, names AS (SELECT book_id, character_id * 1000 AS place, canonical_name AS name, canonical_name FROM characters UNION ALL SELECT book_id, character_id * 1000 + 1, unnest(from_json(aliases_json, '["VARCHAR"]')), canonical_name FROM characters),
known AS (SELECT book_id, lower(replace(name, ' ', '')) AS key, max_by(canonical_name, place) AS canonical FROM names GROUP BY ALL),
named AS (SELECT d.*, coalesce(k.canonical, d.name) AS canonical FROM days d LEFT JOIN known k ON k.book_id = d.book_id AND k.key = lower(replace(d.name, ' ', '')))"""


@query(f"WITH {ALIAS} SELECT book_id, event_id, name, canonical FROM named")
def alias_resolution(spark, folder):
    return claims.resolved(days(spark, folder), characters(spark, folder), "name", "canonical").select("book_id", "event_id", "name", "canonical")


@query(f"""WITH {ALIAS}, u AS (SELECT book_id, event_id, canonical AS name, name AS name_raw, CASE WHEN event_id % 4 = 0 THEN 'location' ELSE 'status' END AS change_type, CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'old' END AS before, event_type AS after FROM named)
SELECT * FROM u WHERE NOT (before <> '' AND before = after)""")
def update_consistency(spark, folder):
    return claims.consistent_updates(updates(spark, folder), characters(spark, folder)).select("book_id", "event_id", "name", "name_raw", "change_type", "before", "after")


def updates(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 0, "location")
    return days(spark, folder).select("book_id", "chapter_idx", "pos", "event_id", "name", kind.alias("change_type"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise("old").alias("before"), F.col("event_type").alias("after"), F.col("props").alias("evidence"))


def support(spark: SparkSession, folder: str) -> DataFrame:
    """Claims: the first line of each chapter; sources: its own text, then the two chapters before it and the two after it, all whole."""
    ch = chapters(spark, folder).select("book_id", "chapter_id", "idx", "text")
    claim = F.struct(F.col("idx").alias("at"), F.col("chapter_id").alias("claim_id"), F.trim(F.split("text", "\n")[0]).alias("claim"), F.array(F.substring("text", 50, 12)).alias("phrases")).alias("c")
    # each claim goes to the five places whose text may support it, and meets their texts by place: no text travels with a book
    around = F.array(*[F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("source_type"), F.lit(step).alias("step")) for pos, (kind, step) in enumerate((("chapter", 0), ("prev1", -1), ("prev2", -2), ("next1", 1), ("next2", 2)))])
    asked_ = ch.select("book_id", claim).select("book_id", "c", F.explode(around).alias("o")).select("book_id", "c.*", "o.pos", "o.source_type", (F.col("c.at") + F.col("o.step")).alias("idx"))
    sources = claims.evidence_tokens(ch.select("book_id", "idx", F.nullif("text", F.lit("")).alias("source")), "source")
    pairs = claims.evidence_tokens(asked_, "claim").join(sources, ["book_id", "idx"]).drop("idx")
    return claims.best_support(pairs, ["book_id", "at"])


SUPPORT = f"""WITH {CHAPTERS}, asked AS (SELECT book_id, idx AS place, chapter_id AS claim_id, trim(string_split(text, chr(10))[1], ' ') AS claim, {stripped("substr(text, 50, 12)")} AS phrase FROM chapters),
around AS (SELECT * FROM (VALUES (0, 'chapter', 0), (1, 'prev1', -1), (2, 'prev2', -2), (3, 'next1', 1), (4, 'next2', 2)) v(pos, source_type, step)),
src AS (SELECT book_id, idx, nullif(text, '') AS source, list_distinct(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}|[A-Za-z0-9_]{{2,20}}')) AS st FROM chapters),
pairs AS (SELECT a.*, o.pos, o.source_type, s.source, s.st, list_distinct(regexp_extract_all(claim, '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}|[A-Za-z0-9_]{{2,20}}')) AS ct FROM asked a CROSS JOIN around o JOIN src s ON a.book_id = s.book_id AND s.idx = a.place + o.step),
h AS (SELECT *, coalesce(claim <> '' AND source IS NOT NULL AND ((phrase <> '' AND contains(source, phrase)) OR contains(source, claim)), false) AS hit FROM pairs),
sc AS (SELECT *, CASE WHEN hit THEN 1.0::DOUBLE WHEN claim = '' OR source IS NULL THEN 0.0::DOUBLE ELSE len(list_intersect(ct, st)) / greatest(len(ct), 1)::DOUBLE END AS score FROM h),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY book_id, place, claim_id ORDER BY hit DESC, score DESC, pos) = 1),
scored AS (SELECT book_id, place, claim_id, round(score, 4) AS score, CASE WHEN score > 0 THEN source_type ELSE '' END AS source_type, CASE WHEN score > 0 THEN {stripped("substr(source, 1, 120)")} ELSE '' END AS quote FROM best)"""


@query(f"{SUPPORT} SELECT claim_id, score, source_type, quote FROM scored")
def evidence_scoring(spark, folder):
    return support(spark, folder).select("claim_id", "score", "source_type", "quote")


@query(f"{SUPPORT} SELECT book_id, count(*) AS total_claims, count(*) FILTER (WHERE score >= 0.18) AS supported_claims, count(*) FILTER (WHERE score < 0.18) AS unsupported_claims FROM scored GROUP BY ALL")
def evidence_report(spark, folder):
    return claims.evidence_report(support(spark, folder), ["book_id"])


# state

UPDATES = f"""WITH {ALIAS}, u AS (SELECT book_id, chapter_idx, pos, canonical AS name, name AS name_raw, CASE WHEN event_id % 4 = 0 THEN 'location' ELSE 'status' END AS change_type, event_type AS after, props AS evidence FROM named WHERE event_id % 5 <> 0)"""


@query(f"""{UPDATES}, seen AS (SELECT book_id, chapter_idx, canonical AS name, CASE WHEN name <> canonical THEN name END AS alias FROM named UNION ALL SELECT book_id, chapter_idx, name, NULL FROM u)
SELECT book_id, name, coalesce(string_agg(DISTINCT alias, ',' ORDER BY alias), '') AS aliases, min(chapter_idx) AS first_chapter_idx, max(chapter_idx) AS last_chapter_idx,
coalesce((SELECT max_by(after, chapter_idx * 1000000 + pos) FROM u WHERE u.book_id = seen.book_id AND u.name = seen.name AND change_type = 'status'), 'active') AS status,
(SELECT max_by(after, chapter_idx * 1000000 + pos) FROM u WHERE u.book_id = seen.book_id AND u.name = seen.name AND change_type = 'location') AS location FROM seen GROUP BY book_id, name""")
def state_transition_characters(spark, folder):
    return cast_states(spark, folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return days(spark, folder).select("book_id", "chapter_idx", "pos", F.when(F.col("event_id") % 4 > 0, F.col("name")).alias("who"), F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 20).cast("int")).alias("what"), F.col("props").alias("impact"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    return days(spark, folder).select("book_id", "chapter_idx", "pos", F.concat(F.lit("item "), F.col("event_id") % 5).alias("name"), F.when(F.col("event_id") % 2 == 0, F.col("name")).alias("owner"), F.col("event_type").alias("description"))


EVENTS = "e AS (SELECT book_id, chapter_idx, pos, CASE WHEN event_id % 4 > 0 THEN name END AS who, event_type || ' ' || CAST(floor(value / 20) AS INTEGER) AS what, props AS impact FROM days)"
ITEMS = "i AS (SELECT book_id, chapter_idx, pos, 'item ' || (event_id % 5) AS name, CASE WHEN event_id % 2 = 0 THEN name END AS owner, event_type AS description FROM days)"
FACTS = f"""{UPDATES}, {EVENTS}, {ITEMS}, cast_ AS (SELECT book_id, name, max(chapter_idx * 1000000 + pos) AS at_, max_by(evidence, chapter_idx * 1000000 + pos) AS excerpt,
  coalesce(max_by(after, chapter_idx * 1000000 + pos) FILTER (WHERE change_type = 'status'), 'active') AS status, max_by(after, chapter_idx * 1000000 + pos) FILTER (WHERE change_type = 'location') AS location FROM u GROUP BY ALL),
w AS (SELECT book_id, chapter_idx, 0 AS stage, pos, 'event:' || chapter_idx || ':' || substr(sha256(what), 1, 12) AS fact_key, what AS fact_value, 0.7::DOUBLE AS confidence, what AS excerpt FROM e
  UNION ALL SELECT book_id, at_ // 1000000, 1, at_ % 1000000, 'character:' || name || ':status', status, 0.85::DOUBLE, excerpt FROM cast_
  UNION ALL SELECT book_id, at_ // 1000000, 1, at_ % 1000000, 'character:' || name || ':location', location, 0.8::DOUBLE, excerpt FROM cast_ WHERE location IS NOT NULL
  UNION ALL SELECT book_id, chapter_idx, 2, pos, 'item:' || name || ':owner', owner, 0.75::DOUBLE, coalesce(nullif(description, ''), owner) FROM i WHERE coalesce(owner, '') <> ''),
facts AS (SELECT book_id, fact_key, fact_value, confidence, CAST(chapter_idx AS INTEGER) AS source_chapter_idx, substr(excerpt, 1, 300) AS source_excerpt FROM w QUALIFY row_number() OVER (PARTITION BY book_id, fact_key ORDER BY chapter_idx DESC, stage DESC, pos DESC) = 1)"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return state.facts(events(spark, folder), claims.consistent_updates(updates(spark, folder), characters(spark, folder)), items(spark, folder))


@query(f"{FACTS} SELECT * FROM facts")
def state_transition_facts(spark, folder):
    return facts(spark, folder)


@query(f"""WITH {DAYS}, {ITEMS} SELECT book_id, name, (array_agg(owner ORDER BY chapter_idx DESC, pos DESC))[1] AS owner_name, (array_agg(description ORDER BY chapter_idx DESC, pos DESC))[1] AS description, min(chapter_idx) AS first_chapter_idx, max(chapter_idx) AS last_chapter_idx FROM i GROUP BY ALL""")
def state_transition_items(spark, folder):
    return state.item_states(items(spark, folder))


@query(f"""WITH {DAYS}, {EVENTS} SELECT book_id, chapter_idx, pos, what AS event_summary, '["' || who || '"]' AS involved_characters_json, 'narration_draft' AS event_type, impact FROM e""")
def state_transition_events(spark, folder):
    return state.plot_events(events(spark, folder))


def cast_states(spark: SparkSession, folder: str) -> DataFrame:
    known = characters(spark, folder)
    mentions = claims.resolved(days(spark, folder), known, "name", "canonical").select("book_id", "chapter_idx", "name", "canonical")
    return state.character_states(mentions, claims.consistent_updates(updates(spark, folder), known))


def snapshot_of_all(spark: SparkSession, folder: str) -> DataFrame:
    return state.snapshots(characters=cast_states(spark, folder), items=state.item_states(items(spark, folder)), plot_events=state.plot_events(events(spark, folder)), world_facts=facts(spark, folder))


@query(f"""{FACTS} SELECT book_id, sha256('{{"world_facts":[' || string_agg('{{"fact_key":"' || fact_key || '","fact_value":"' || fact_value || '"}}', ',' ORDER BY fact_key) || ']}}') AS snapshot_hash FROM facts GROUP BY 1""")
def snapshot_hash(spark, folder):
    return state.snapshots(world_facts=facts(spark, folder).select("book_id", "fact_key", "fact_value")).select("book_id", "snapshot_hash")


CAST = f"""seen AS (SELECT book_id, chapter_idx, canonical AS name, CASE WHEN name <> canonical THEN name END AS alias FROM named UNION ALL SELECT book_id, chapter_idx, name, NULL FROM u),
people AS (SELECT book_id, name, coalesce(string_agg(DISTINCT alias, ',' ORDER BY alias), '') AS aliases, min(chapter_idx) AS first_idx, max(chapter_idx) AS last_idx FROM seen GROUP BY ALL),
things AS (SELECT book_id, name, (array_agg(owner ORDER BY chapter_idx DESC, pos DESC) FILTER (WHERE owner IS NOT NULL OR true))[1] AS owner, min(chapter_idx) AS first_idx, max(chapter_idx) AS last_idx FROM i GROUP BY ALL)"""


@query(f"""{FACTS}, {CAST} SELECT book_id, 'characters' AS kind, name AS key, aliases || '|' || first_idx || '|' || last_idx AS value FROM people
UNION ALL SELECT book_id, 'items', name, coalesce(owner, '-') || '|' || first_idx || '|' || last_idx FROM things
UNION ALL SELECT book_id, 'plot_events', chapter_idx || ':' || pos, what || '|' || coalesce('["' || who || '"]', '-') || '|' || impact FROM e
UNION ALL SELECT book_id, 'world_facts', fact_key, fact_value || '|' || source_chapter_idx || '|' || source_excerpt FROM facts""")
def snapshot_restore_roundtrip(spark, folder):
    """All four tables, restored from the snapshots of all books."""
    snap = snapshot_of_all(spark, folder)
    bar = F.lit("|")
    people = state.restored(snap, "characters", "name string, aliases string, first_chapter_idx int, last_chapter_idx int").select("book_id", F.lit("characters").alias("kind"), F.col("name").alias("key"), F.concat("aliases", bar, "first_chapter_idx", bar, "last_chapter_idx").alias("value"))
    things = state.restored(snap, "items", "name string, owner_name string, first_chapter_idx int, last_chapter_idx int").select("book_id", F.lit("items"), "name", F.concat(F.coalesce("owner_name", F.lit("-")), bar, "first_chapter_idx", bar, "last_chapter_idx"))
    plot = state.restored(snap, "plot_events", "chapter_idx int, pos long, event_summary string, involved_characters_json string, impact string").select("book_id", F.lit("plot_events"), F.concat("chapter_idx", F.lit(":"), "pos"), F.concat("event_summary", bar, F.coalesce("involved_characters_json", F.lit("-")), bar, "impact"))
    known = state.restored(snap, "world_facts", "fact_key string, fact_value string, source_chapter_idx int, source_excerpt string").select("book_id", F.lit("world_facts"), "fact_key", F.concat("fact_value", bar, "source_chapter_idx", bar, "source_excerpt"))
    return people.union(things).union(plot).union(known)


@query(f"""WITH RECURSIVE {CHAPTERS}, n AS (SELECT book_id, idx, CAST(length(text) AS BIGINT) AS size FROM chapters),
b(book_id, idx, bin, fill) AS (SELECT book_id, idx, 1, size FROM n WHERE idx = 1 UNION ALL SELECT n.book_id, n.idx, CASE WHEN fill > 0 AND fill + size > 10000 THEN bin + 1 ELSE bin END, CASE WHEN fill > 0 AND fill + size > 10000 THEN size ELSE fill + size END FROM b JOIN n ON n.book_id = b.book_id AND n.idx = b.idx + 1)
SELECT book_id, CAST(idx AS BIGINT) AS idx, bin FROM b""")
def size_binning(spark, folder):
    sized = chapters(spark, folder).select("book_id", "idx", F.length("text").alias("size"))
    return state.size_bins(sized, ["book_id"], "idx", "size", 10_000)


# export

FILES = f"""WITH {NARRATIONS}, latest AS (SELECT * FROM narrations QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY created_at DESC) = 1),
r AS (SELECT *, CASE WHEN chapter_idx % 4 = 0 THEN chapter_idx - 3 WHEN version = 2 AND (chapter_idx - 1) // 3 * 3 + 1 < chapter_idx THEN (chapter_idx - 1) // 3 * 3 + 1 END AS a, regexp_replace(title, '\\s+', '_', 'g') AS safe FROM latest),
files AS (SELECT book_id, chapter_idx, CASE WHEN a IS NOT NULL THEN format('{{:03d}}-{{:03d}}_', a, chapter_idx) ELSE format('{{:03d}}_', chapter_idx) END || safe || '.md' AS filename,
  CASE WHEN a IS NOT NULL AND a <> chapter_idx THEN '# 第' || a || '-' || chapter_idx || '章（Step 汇总）' || chr(10) || chr(10) || '> 锚点章节：第' || chapter_idx || '章 ' || title ELSE '# 第' || chapter_idx || '章 ' || title END || chr(10) || chr(10) || narration_text || chr(10) AS content FROM r)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    n = store.latest(narrations(spark, folder), ["chapter_id"], ["created_at"])
    payload = F.when(F.col("chapter_idx") % 4 == 0, F.concat(F.lit('{"step_start_chapter_idx":'), F.col("chapter_idx") - 3, F.lit(',"step_end_chapter_idx":'), "chapter_idx", F.lit("}")))
    rows = n.withColumn("payload_json", payload).withColumn("prompt_version", F.when(F.col("version") == 2, "Step_v2").otherwise("v1"))
    return export.chapter_files(rows, 3)


@query(f"{FILES} SELECT * FROM files")
def export_chapter_files(spark, folder):
    return files(spark, folder)


@query(f"{FILES} SELECT book_id, sha256(string_agg(content, chr(10) || chr(10) ORDER BY chapter_idx)) AS story_hash FROM files GROUP BY 1")
def export_full_story(spark, folder):
    return export.full_story(files(spark, folder)).select("book_id", F.sha2("content", 256).alias("story_hash"))


@query(f"""WITH {DAYS} SELECT book_id, '# 时间线' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) AS content FROM (SELECT book_id, n, n || '. ' || CASE WHEN c IS NOT NULL THEN '[第' || c || '章] ' ELSE '' END || event_type || CASE WHEN impact <> '' THEN '（影响：' || impact || '）' ELSE '' END AS line
FROM (SELECT book_id, event_type, CASE WHEN event_id % 3 > 0 THEN chapter_idx END AS c, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS impact, row_number() OVER (PARTITION BY book_id ORDER BY coalesce(CASE WHEN event_id % 3 > 0 THEN chapter_idx END, -1), event_id) AS n FROM days)) GROUP BY 1""")
def export_timeline(spark, folder):
    d = days(spark, folder).select("book_id", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("chapter_idx")).alias("chapter_idx"), F.col("event_type").alias("event_summary"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("").alias("impact"))
    return export.timeline(d)


@query(f"""WITH {CHARACTERS} SELECT book_id, '# 人物表' || chr(10) || chr(10) || '| 姓名 | 别名 | 关系 | 动机/目标 | 变化 |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg('| ' || canonical_name || ' | ' || CASE WHEN character_id % 2 = 0 THEN 'N' || character_id ELSE '' END || ' |  | goal ' || character_id || ' | active |', chr(10) ORDER BY canonical_name) || chr(10) AS content FROM characters GROUP BY 1""")
def export_characters(spark, folder):
    c = characters(spark, folder).withColumn("relationships_json", F.lit(None).cast("string")).withColumn("motivation", F.concat(F.lit("goal "), "character_id")).withColumn("status", F.lit("active"))
    return export.characters_table(c)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_safe_extract(spark, folder):
    fenced = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    noisy = F.concat(F.lit("Answer: "), "props", F.lit(" done"))
    raw = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, noisy).otherwise(F.col("props"))
    return table(spark, folder, "events").select("event_id", F.from_json(clean_json(raw), "k bigint")["k"].alias("k"))


@query()
def html_to_text(spark, folder):
    return with_markdown(table(spark, folder, "pages"), media=True).select("page_id", "url", "markdown")


@query(f"""{FACTS}, {CAST}, titles AS (SELECT book_id, 'user ' || book_id AS title FROM (SELECT DISTINCT book_id FROM days)), ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY fact_key) AS n FROM facts)
SELECT t.book_id, t.title AS book_title, (SELECT string_agg(chapter_idx || ':' || t, ',' ORDER BY chapter_idx) FROM (SELECT chapter_idx, count(*) || ' events' AS t FROM days WHERE days.book_id = t.book_id GROUP BY 1)) AS narrations, (SELECT string_agg(name, ',' ORDER BY name) FROM people p WHERE p.book_id = t.book_id) AS characters, (SELECT string_agg(name || '=' || coalesce(owner, ''), ',' ORDER BY name) FROM things x WHERE x.book_id = t.book_id) AS owners,
(SELECT CAST(count(*) AS INTEGER) FROM e WHERE e.book_id = t.book_id) AS plot_events, (SELECT string_agg(fact_key || '=' || fact_value, ',' ORDER BY fact_key) FROM ranked r WHERE r.book_id = t.book_id AND n <= 100) AS facts FROM titles t""")
def world_state_json(spark, folder):
    """world_state.json of each book, read back from its text."""
    books = days(spark, folder).select("book_id").distinct().withColumn("title", F.concat(F.lit("user "), "book_id"))
    told = days(spark, folder).groupBy("book_id", "chapter_idx").agg(F.concat(F.count("*"), F.lit(" events")).alias("narration_text"))
    written = export.world_state(books, 100, narrations=told, characters=cast_states(spark, folder), items=state.item_states(items(spark, folder)), plot_events=state.plot_events(events(spark, folder)), world_facts=facts(spark, folder))
    schema = "book_id long, book_title string, narrations array<struct<chapter_idx:int,narration_text:string>>, characters array<struct<name:string>>, items array<struct<name:string,owner_name:string>>, plot_events array<struct<pos:long>>, world_facts array<struct<fact_key:string,fact_value:string>>"
    x = written.select(F.from_json("content", schema).alias("x")).select("x.*")
    pair = lambda key, value: lambda r: F.concat(r[key], F.lit("="), F.coalesce(r[value], F.lit("")))
    return x.select("book_id", "book_title", F.array_join(F.transform("narrations", lambda r: F.concat(r["chapter_idx"], F.lit(":"), r["narration_text"])), ",").alias("narrations"), F.array_join("characters.name", ",").alias("characters"), F.array_join(F.transform("items", pair("name", "owner_name")), ",").alias("owners"), F.size("plot_events").alias("plot_events"), F.array_join(F.transform("world_facts", pair("fact_key", "fact_value")), ",").alias("facts"))


QUERIES["keyword_terms"], SQL["keyword_terms"] = QUERIES.pop("keyword_terms_query"), SQL.pop("keyword_terms_query")


# scans, filters and plans


@query(f"WITH {CHAPTERS} SELECT chapter_id, book_id, idx, title FROM chapters WHERE idx BETWEEN 3 AND 9")
def chapter_range(spark, folder):
    return chapters(spark, folder).where(F.col("idx").between(3, 9)).select("chapter_id", "book_id", "idx", "title").orderBy("book_id", "idx")


@query("SELECT DISTINCT coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN 'x' || event_id END AS BIGINT), try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS id FROM events WHERE id IS NOT NULL")
def vector_ids(spark, folder):
    key = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x"), "event_id"))
    return table(spark, folder, "events").select(F.coalesce(key.try_cast("bigint"), F.get_json_object("props", "$.k").try_cast("bigint")).alias("id")).where("id IS NOT NULL").distinct()


@query("""WITH c AS (SELECT event_type || ':' || user_id AS key, value, event_id, day(ts) > 15 AS late FROM events) SELECT key, value FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY late DESC, event_id DESC) = 1""")
def cache_put(spark, folder):
    """What the first half of the month cached is replaced by the second half's answers to the same keys."""
    rows = table(spark, folder, "events").select(F.concat("event_type", F.lit(":"), "user_id").alias("key"), "value", "event_id", (F.dayofmonth("ts") > 15).alias("late"))
    held = store.latest(rows.where("NOT late"), ["key"], ["event_id"])
    return store.upsert(held, rows.where("late"), ["key"], ["event_id"]).select("key", "value")


@query(f"""WITH {CHUNKS}, tok AS (SELECT book_id, chunk_id, {TOKENS} AS t FROM chunks WHERE book_id <> (SELECT min(book_id) FROM chunks) OR chapter_id % 2 = 0), each AS (SELECT book_id, chunk_id, unnest(t) AS term FROM tok),
post AS (SELECT book_id, chunk_id, term, count(*) AS tf FROM each GROUP BY ALL) SELECT book_id, count(DISTINCT chunk_id) AS documents, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT term) AS terms FROM post GROUP BY 1""")
def index_rebuild(spark, folder):
    """The stored index of all books after one book has lost every other chapter: only that book's part is written again."""
    from .functions.providers import HashingEmbedder
    from .plans import stored

    tables = stored.library(spark, own_folder(spark))
    chunks = all_chunks(spark, folder).select("book_id", F.col("chapter_id").cast("string").alias("chapter_hash"), "chapter_id", "chapter_idx", "title", "idx", "chunk_text")
    tables.commit(replace={"chunks": chunks})
    stored.embed(tables, HashingEmbedder(8))
    first = tables.read("chunks").agg(F.min("book_id")).first()[0]
    tables.commit(replace={"chunks": tables.read("chunks").where((F.col("book_id") != first) | (F.col("chapter_id") % 2 == 0))})
    stored.embed(tables, HashingEmbedder(8))
    rows = tables.read("postings")
    return rows.groupBy("book_id").agg(F.countDistinct("source_id").alias("documents"), F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.countDistinct("term").alias("terms"))


@query(f"WITH {CHARACTERS} SELECT book_id, canonical_name FROM characters WHERE canonical_name IN ('Hero1', 'Hero5')")
def in_list_filter(spark, folder):
    names = ["Hero1", "Hero5"]
    c = characters(spark, folder).select("book_id", "canonical_name")
    return c.where(F.col("canonical_name").isin(names)) if names else c


@query(f"WITH {CHAPTERS} SELECT chapter_id, 'chapter_idx=' || idx || chr(10) || 'entities=A, B' || chr(10) || 'locations=' || chr(10) || 'items=' || book_id || chr(10) || substr(text, 1, 2000) AS query_text FROM chapters")
def retrieval_query_text(spark, folder):
    from .plans.generate import query_text

    none = F.array().cast("array<string>")
    return chapters(spark, folder).select("chapter_id", query_text(F.col("idx"), F.array(F.lit("A"), F.lit("B")), none, F.array("book_id"), F.col("text")).alias("query_text"))


@query(f"""{HITS}, m AS (SELECT query_id // 100 AS step, query_id AS at, rank, source_id, chapter_idx, source_type FROM hits WHERE leg < 2)
SELECT step, source_id, chapter_idx, source_type, at, rank FROM m QUALIFY row_number() OVER (PARTITION BY step, source_id, chapter_idx, source_type ORDER BY at, rank) = 1""".replace(" AS at,", " AS place,").replace(" at,", " place,"))
def merge_memories(spark, folder):
    from .plans.generate import merged_memories

    rows = hits(spark, folder).where("leg < 2").select(F.floor(F.col("query_id") / 100).alias("step"), F.col("query_id").alias("at"), "rank", "source_id", "chapter_idx", "source_type")
    return merged_memories(rows, "step").withColumnRenamed("at", "place")


@query(f"WITH {CHUNKS}, h AS (SELECT book_id, sha256(chapter_id || '::' || chunk_text) AS h, chunk_id FROM chunks) SELECT book_id, count(*) AS total, count(DISTINCT h) AS inserted, count(*) - count(DISTINCT h) AS skipped FROM h GROUP BY 1")
def ingest_stats(spark, folder):
    h = all_chunks(spark, folder).select("book_id", content_hash(F.col("chapter_id").cast("string"), F.col("chunk_text")).alias("h"))
    return h.groupBy("book_id").agg(F.count("*").alias("total"), F.countDistinct("h").alias("inserted")).withColumn("skipped", F.col("total") - F.col("inserted"))


@query(f"{FACTS} SELECT book_id, fact_key, fact_value FROM facts QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY fact_key) <= 5")
def limit_facts(spark, folder):
    n = F.row_number().over(W.partitionBy("book_id").orderBy("fact_key"))
    return facts(spark, folder).withColumn("n", n).where("n <= 5").select("book_id", "fact_key", "fact_value")


@query(f"""WITH {KNN} SELECT n.query_id, n.rank, '[' || n.rank || '] chunk_id=' || n.vec_id || ' 章节' || (n.vec_id // 10 + 1) || ' doc ' || d.doc_id || ': ' || CASE WHEN length(trim(replace(d.text, chr(10), ' '), ' ')) > 300 THEN substr(trim(replace(d.text, chr(10), ' '), ' '), 1, 300) || '...' ELSE trim(replace(d.text, chr(10), ' '), ' ') END AS line
FROM near n JOIN documents d ON d.doc_id = n.vec_id WHERE n.rank <= 5""")
def evidence_lines(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.concat(F.lit("doc "), "doc_id").alias("chapter_title"))
    rows = near(spark, folder).where("rank <= 5").join(docs, "vec_id").withColumn("chapter_idx", (F.floor(F.col("vec_id") / 10) + 1).cast("int")).withColumnRenamed("vec_id", "source_id")
    return export.evidence_lines(rows).select("query_id", "rank", "line")


@query(f"WITH {CHAPTERS} SELECT book_id, '# ' || CASE WHEN book_id = 'src0' THEN '(未命名)' ELSE book_id END || chr(10) || chr(10) || count(*) || ' chapters' || chr(10) AS content, '# 说书稿' || chr(10) || chr(10) || CASE WHEN count(*) > 9 THEN 'text' ELSE '暂无说书稿数据。' END || chr(10) AS story FROM chapters GROUP BY 1")
def export_book_summary(spark, folder):
    n = texts(spark, folder).groupBy("book_id").agg(F.count("*").alias("n"))
    title = F.when(F.col("book_id") != "src0", F.col("book_id"))
    return n.select("book_id", export.book_summary(title, F.concat("n", F.lit(" chapters"))).alias("content"), export.story(F.when(F.col("n") > 9, "text")).alias("story"))


KEYWORDS = f"""list_transform(regexp_extract_all('chapter_idx=' || idx || chr(10) || 'entities=' || array_to_string(list_slice(list_filter(han, lambda x, i: list_position(han, x) = i), 1, 16), ', ') || chr(10) || 'locations=' || chr(10) || 'items=' || chr(10) || substr(text, 1, 2000), '[\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9_]{{2,20}}'), lambda t: trim(t))"""
HYBRID = f"""WITH {NARRATIONS}, {CHUNKS.removeprefix(CHAPTERS + ", ")},
passages AS (SELECT book_id, 'chunk' AS source_type, chunk_id AS source_id, chapter_idx, title, chunk_text AS text, (chapter_id * 7 + idx) % (SELECT count(*) FROM embeddings) AS v FROM chunks
  UNION ALL SELECT book_id, 'narration', narration_id, chapter_idx, title, narration_text, (chapter_id * 7 + 3) % (SELECT count(*) FROM embeddings) FROM (SELECT * FROM narrations QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY created_at DESC) = 1)),
raw AS (SELECT *, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}') AS han FROM chapters WHERE chapter_id % 100 = 0), keys AS (SELECT *, list_filter({KEYWORDS}, lambda t: t <> '') AS t FROM raw),
asked AS (SELECT book_id, chapter_id AS query_id, idx AS current_idx, list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 8) AS terms, (chapter_id * 7 + 5) % (SELECT count(*) FROM embeddings) AS v FROM keys),
pair AS (SELECT a.query_id, a.current_idx, p.source_type, p.source_id, p.chapter_idx, {DISTANCE} AS distance FROM asked a JOIN passages p ON p.book_id = a.book_id JOIN embeddings q ON q.vec_id = a.v JOIN embeddings e ON e.vec_id = p.v),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY distance, source_id) AS rank FROM pair QUALIFY rank <= CASE source_type WHEN 'chunk' THEN 24 ELSE 16 END),
tok AS (SELECT *, regexp_extract_all(lower(title || ' ' || text), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM passages), stat AS (SELECT source_type, count(*) AS n, avg(len(tokens)) AS mean FROM tok GROUP BY 1),
post AS (SELECT book_id, source_type, source_id, chapter_idx, size, term, count(*) AS tf FROM (SELECT book_id, source_type, source_id, chapter_idx, len(tokens) AS size, unnest(tokens) AS term FROM tok) GROUP BY ALL), df AS (SELECT source_type, term, count(*) AS df FROM post GROUP BY ALL),
want AS (SELECT DISTINCT query_id, current_idx, book_id, lower(unnest(terms)) AS term FROM asked),
scored AS (SELECT w.query_id, w.current_idx, p.source_type, p.source_id, p.chapter_idx, -sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score
  FROM post p JOIN want w ON w.book_id = p.book_id AND w.term = p.term JOIN df ON df.source_type = p.source_type AND df.term = p.term JOIN stat ON stat.source_type = p.source_type WHERE p.chapter_idx < w.current_idx GROUP BY ALL),
words AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY round(score, 9), source_id) AS rank FROM scored QUALIFY rank <= CASE source_type WHEN 'chunk' THEN 24 ELSE 16 END),
hits AS (SELECT query_id, current_idx, CASE source_type WHEN 'chunk' THEN 0 ELSE 1 END AS leg, source_type, source_id, chapter_idx, rank FROM near UNION ALL SELECT query_id, current_idx, 2, source_type, source_id, chapter_idx, row_number() OVER (PARTITION BY query_id ORDER BY source_type, rank) FROM words),
s AS (SELECT *, greatest(0, 1 - (rank - 1) / count(*) OVER (PARTITION BY query_id, leg)::DOUBLE) AS s FROM hits),
g AS (SELECT query_id, current_idx, source_type, source_id, coalesce(max(s) FILTER (WHERE leg < 2), 0) AS v, coalesce(max(s) FILTER (WHERE leg = 2), 0) AS k, min(chapter_idx) AS chapter_idx, min(leg * 1000 + rank) AS seq FROM s WHERE chapter_idx < current_idx GROUP BY ALL),
t AS (SELECT *, 0.7::DOUBLE * v + (1 - 0.7::DOUBLE) * k + 0.2::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + (current_idx - chapter_idx))) AS score FROM g),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS INTEGER) AS rank FROM t QUALIFY rank <= 8)"""


BEST = "SELECT b.query_id, b.source_type, b.source_id, b.chapter_idx, round(b.score, 6) AS score, b.rank, p.title AS chapter_title, substr(p.text, 1, 800) AS text FROM best b JOIN passages p ON p.source_type = b.source_type AND p.source_id = b.source_id"


def hybrid_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Passages and queries: chunks and narrations take the stored vectors in turn, and so do the chapters whose id is divisible by 100, which
    ask their own book with their causal bound."""
    from .functions.text import keyword_terms as keywords
    from .plans.generate import fallback_entities, query_text

    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    turn = lambda k: ((F.col("chapter_id") * 7 + k) % vectors.count()).alias("vec_id")
    c = all_chunks(spark, folder).select("book_id", F.lit("chunk").alias("source_type"), F.col("chunk_id").alias("source_id"), "chapter_idx", "title", F.col("chunk_text").alias("text"), turn(F.col("idx")))
    n = store.latest(narrations(spark, folder), ["chapter_id"], ["created_at"]).select("book_id", F.lit("narration").alias("source_type"), F.col("narration_id").alias("source_id"), "chapter_idx", "title", F.col("narration_text").alias("text"), turn(3))
    none = F.array().cast("array<string>")
    asked_ = chapters(spark, folder).where("chapter_id % 100 = 0").withColumn("q", query_text(F.col("idx"), fallback_entities(F.col("text")), none, none, F.col("text")))
    asked_ = asked_.select("book_id", F.col("chapter_id").alias("query_id"), F.col("idx").alias("current_idx"), keywords(F.col("q"), none).alias("terms"), turn(5)).join(vectors.withColumnRenamed("vector", "query_vector"), "vec_id").drop("vec_id")
    return c.unionByName(n).join(vectors, "vec_id").drop("vec_id"), asked_


@query(f"{HYBRID} {BEST}")
def hybrid_fusion(spark, folder):
    """Chunks and narrations with stored vectors, indexed by book."""
    from .plans.generate import assets, hybrid

    corpus, asked_ = hybrid_inputs(spark, folder)
    passages, index = assets(corpus, None)
    return hybrid(passages, asked_, index, 8).withColumn("score", F.round("score", 6))


@query(f"""{HYBRID.replace("JOIN passages p ON p.book_id = a.book_id JOIN", "JOIN passages p ON p.book_id = a.book_id AND p.source_type = 'chunk' AND a.query_id % 300 <> 0 JOIN")}, found AS ({BEST})
SELECT f.*, CASE WHEN f.query_id % 300 = 0 THEN 'no vector' ELSE 'ok' END AS vectors, CASE WHEN len(a.terms) > 0 THEN 'ok' ELSE 'no terms' END AS keywords FROM found f JOIN asked a USING (query_id)""")
def hybrid_degraded(spark, folder):
    """The same where narrations have no vectors and a third of the queries has none: their words still find what they find."""
    from .plans.generate import assets, hybrid, legs

    corpus, asked_ = hybrid_inputs(spark, folder)
    passages, index = assets(corpus.withColumn("vector", F.when(F.col("source_type") == "chunk", F.col("vector"))), None)
    asked_ = asked_.withColumn("query_vector", F.when(F.col("query_id") % 300 != 0, F.col("query_vector")))
    return hybrid(passages, asked_, index, 8).withColumn("score", F.round("score", 6)).join(legs(asked_, passages, index), "query_id")


@query("""SELECT conv_id AS book_id, role AS summary_type, text AS value FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1""")
def latest_summary(spark, folder):
    return store.latest(table(spark, folder, "conversations"), ["conv_id", "role"], ["turn"]).select(F.col("conv_id").alias("book_id"), F.col("role").alias("summary_type"), F.col("text").alias("value"))


@query(f"""WITH {DAYS}, e AS (SELECT book_id, CASE event_id % 4 WHEN 0 THEN 'book_summary' WHEN 1 THEN 'story' WHEN 2 THEN 'characters' ELSE 'timeline' END AS t, max(event_id) AS m FROM days GROUP BY ALL),
b AS (SELECT book_id FROM e WHERE t = 'book_summary')
SELECT book_id, t || '.md' AS filename, CASE t WHEN 'book_summary' THEN '# b' || m WHEN 'story' THEN '# 说书稿' || chr(10) || chr(10) || 's' || m || chr(10)
 WHEN 'characters' THEN '# 人物表' || chr(10) || chr(10) || '| 姓名 | 别名 | 关系 | 动机/目标 | 变化 |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || '| c' || m || ' | a, b |  |  |  |' || chr(10)
 ELSE '# 时间线' || chr(10) || chr(10) || '1. [第3章] e' || m || '（影响：i）' || chr(10) || '2. x' || chr(10) END AS content FROM e WHERE book_id IN (SELECT book_id FROM b)""")
def legacy_export(spark, folder):
    kind = F.when(F.col("event_id") % 4 == 0, "book_summary").when(F.col("event_id") % 4 == 1, "story").when(F.col("event_id") % 4 == 2, "characters").otherwise("timeline")
    e = days(spark, folder).groupBy("book_id", kind.alias("summary_type")).agg(F.max("event_id").alias("m"))
    content = F.when(F.col("summary_type") == "book_summary", F.concat(F.lit("# b"), "m")).when(F.col("summary_type") == "story", F.concat(F.lit("s"), "m")).when(F.col("summary_type") == "characters", F.concat(F.lit('[{"name":"c'), "m", F.lit('","aliases":"a, b"}]'))).otherwise(F.concat(F.lit('[{"chapter_idx":3,"event":"e'), "m", F.lit('","impact":"i"},{"event":"x"}]')))
    return export.legacy_files(e.withColumn("content", content))


@query(f"""{FACTS}, ch AS (SELECT DISTINCT book_id, chapter_idx FROM days), who AS (SELECT DISTINCT book_id, chapter_idx, 'Hero' || (event_id % 7) AS name FROM days WHERE event_id % 3 > 0), what_ AS (SELECT DISTINCT book_id, chapter_idx, 'item ' || (event_id % 5) AS name FROM days WHERE event_id % 2 = 0), stock AS (SELECT DISTINCT book_id, name FROM i),
c1 AS (SELECT h.book_id, h.chapter_idx, k.canonical_name AS name FROM ch h JOIN characters k USING (book_id) WHERE NOT EXISTS (SELECT 1 FROM who w WHERE w.book_id = h.book_id AND w.chapter_idx = h.chapter_idx) OR EXISTS (SELECT 1 FROM who w WHERE w.book_id = h.book_id AND w.chapter_idx = h.chapter_idx AND w.name = k.canonical_name)),
i1 AS (SELECT h.book_id, h.chapter_idx, s.name FROM ch h JOIN stock s USING (book_id) WHERE NOT EXISTS (SELECT 1 FROM what_ w WHERE w.book_id = h.book_id AND w.chapter_idx = h.chapter_idx) OR EXISTS (SELECT 1 FROM what_ w WHERE w.book_id = h.book_id AND w.chapter_idx = h.chapter_idx AND w.name = s.name)),
r1 AS (SELECT h.book_id, h.chapter_idx, d.event_type, row_number() OVER (PARTITION BY h.book_id, h.chapter_idx ORDER BY d.chapter_idx DESC, d.event_id DESC) AS n FROM ch h JOIN days d ON d.book_id = h.book_id AND d.chapter_idx BETWEEN h.chapter_idx - 5 AND h.chapter_idx - 1 QUALIFY n <= 20),
f1 AS (SELECT book_id, fact_key, fact_value FROM facts QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY fact_key) <= 30)
SELECT h.book_id, h.chapter_idx, (SELECT string_agg(name, ',' ORDER BY name) FROM c1 WHERE c1.book_id = h.book_id AND c1.chapter_idx = h.chapter_idx) AS characters, (SELECT string_agg(name, ',' ORDER BY name) FROM i1 WHERE i1.book_id = h.book_id AND i1.chapter_idx = h.chapter_idx) AS items,
(SELECT string_agg(event_type, ',' ORDER BY n) FROM r1 WHERE r1.book_id = h.book_id AND r1.chapter_idx = h.chapter_idx) AS recent_events, (SELECT string_agg(fact_key || '=' || fact_value, ',' ORDER BY fact_key) FROM f1 WHERE f1.book_id = h.book_id) AS facts FROM ch h""")
def state_lookup(spark, folder):
    d = days(spark, folder)
    names = lambda kind, n, when: F.collect_set(F.when(when, F.concat(F.lit(f"{kind}"), F.col("event_id") % n)))
    asked_ = d.groupBy("book_id", "chapter_idx").agg(names("Hero", 7, F.col("event_id") % 3 > 0).alias("entities"), names("item ", 5, F.col("event_id") % 2 == 0).alias("items_mentioned"))
    ev = d.select("book_id", "chapter_idx", "event_id", F.col("event_type").alias("event_summary"))
    x = state.lookup(asked_, characters(spark, folder).withColumnRenamed("canonical_name", "name"), state.item_states(items(spark, folder)), ev, facts(spark, folder), 5, 30)
    known = F.array_join(F.transform("facts", lambda f: F.concat(f["fact_key"], F.lit("="), f["fact_value"])), ",")
    return x.select("book_id", "chapter_idx", F.array_join("characters.name", ",").alias("characters"), F.array_join("items.name", ",").alias("items"), F.array_join("recent_events.event_summary", ",").alias("recent_events"), known.alias("facts"))


@query(f"{FACTS.replace('FROM named WHERE', 'FROM named WHERE chapter_idx <= 10 AND').replace('AS impact FROM days', 'AS impact FROM days WHERE chapter_idx <= 10').replace('AS description FROM days', 'AS description FROM days WHERE chapter_idx <= 10')} SELECT * FROM facts")
def replay_state(spark, folder):
    """Stored payloads of each chapter, parsed and folded again up to chapter 10: events, updates and items."""
    keys, parts = ["book_id", "chapter_idx"], []
    known = characters(spark, folder)
    for name, rows in (("key_events", events(spark, folder)), ("character_updates", claims.consistent_updates(updates(spark, folder), known)), ("new_items", items(spark, folder))):
        columns = [c for c in rows.columns if c not in (*keys, "pos")]
        parts.append(rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*columns).alias("x")))), lambda r: r["x"]).alias(name)))
    stored = parts[0].join(parts[1], keys, "full").join(parts[2], keys, "full").select(*keys, F.to_json(F.struct("key_events", "character_updates", "new_items", F.lit(1).alias("other"))).alias("payload_json"))
    back = state.replayed(stored, 10)
    return state.facts(back["events"], back["updates"], back["items"])


@query(f"""WITH {CHUNKS}, old AS (SELECT chunk_id FROM chunks WHERE chapter_id % 4 = 0) SELECT chunk_id, 64 AS size, true AS unit FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM old)""")
def embed_missing(spark, folder):
    """Only chunks without a vector are embedded."""
    from .functions.providers import HashingEmbedder, with_embeddings

    c = all_chunks(spark, folder).select("chunk_id", "chapter_id", "chunk_text")
    new = with_embeddings(store.unseen(c, c.where("chapter_id % 4 = 0"), ["chunk_id"]), "chunk_text", HashingEmbedder())
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return new.select("chunk_id", F.size("vector").alias("size"), (F.abs(norm - 1) < 1e-9).alias("unit"))
