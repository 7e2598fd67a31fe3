"""Queries over the llm operators, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import conversations
from .fill_middle import fill_in_middle, restored
from .jaccard_join import jaccard_components
from .language_id import identify, train
from .license_scan import scan
from .line_dedup import dedup_lines
from .mixing import mix_sources, word_sizes
from .packing import pack
from .quality_rules import quality_verdicts
from .shared import cut, small_batches
from .source_divergence import source_divergence
from .suffix_dedup import suffix_dedup
from .token_counts import context_limits, length_histogram
from .vector_search import nearest


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = word_sizes(table(spark, folder, "documents").select("doc_id", "text", "source")).drop("text")
    taken = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["words"])
    return mix_sources(cut(docs)).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return scan(table(spark, folder, "documents"))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return jaccard_components(table(spark, folder, "documents"))


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(table(spark, folder, "conversations"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return context_limits(length_histogram(table(spark, folder, "documents")))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    models, limits = train(docs.where(~held_out))
    out = identify(docs, models, limits)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    out = quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    pieces = pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    cut_up = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return cut_up.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_license_scan": op3_license_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_vector_search": op8_vector_search,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_fill_middle": op11_fill_middle,
    "op12_source_divergence": op12_source_divergence,
    "op13_line_dedup": op13_line_dedup,
}
#: The join by brute force: all pairs that share a shingle, and reachability by recursion.
SQL: dict[str, str] = {
    "op4_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT d.doc_id, count(s.shingle) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, min(r.reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL""",
    "op5_chat_format": r"""WITH RECURSIVE raw AS (SELECT conv_id, turn, role, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS pos FROM conversations),
p AS (SELECT *, regexp_extract(line, '^[ \t]*(?:>[ \t]*)+') AS prefix FROM raw),
l AS (SELECT conv_id, turn, role, pos, length(prefix) - length(replace(prefix, '>', '')) AS level, substr(line, length(prefix) + 1) AS body FROM p),
c AS (SELECT *, lead(level) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS next_level, CAST(level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS INTEGER) AS starts FROM l),
g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM c),
passage AS (SELECT conv_id, turn, run, max(level) AS level, string_agg(body, chr(10) ORDER BY pos) AS t, count(*) AS n FROM g GROUP BY ALL),
unit AS (SELECT conv_id, turn, run, 0 AS i, level > 0 AS quoted, t FROM passage UNION ALL SELECT g.conv_id, g.turn, g.run, g.pos, g.level > 0, g.body FROM g JOIN passage USING (conv_id, turn, run) WHERE n > 1),
u AS (SELECT conv_id, turn, run, i, quoted, lower(trim(regexp_replace(t, '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ')) AS norm FROM unit),
said AS (SELECT q.conv_id, q.turn, q.run, q.i, q.norm, max(o.turn) AS said FROM u q JOIN (SELECT DISTINCT conv_id, turn, norm FROM u WHERE NOT quoted) o ON q.conv_id = o.conv_id AND q.norm = o.norm AND o.turn < q.turn WHERE q.quoted AND q.norm <> '' GROUP BY ALL),
vote AS (SELECT conv_id, turn, said, sum(length(norm)) AS size FROM said s WHERE i = 0 OR NOT EXISTS (SELECT 1 FROM said w WHERE w.conv_id = s.conv_id AND w.turn = s.turn AND w.run = s.run AND w.i = 0) GROUP BY ALL),
linked AS (SELECT conv_id, turn, (array_agg(said ORDER BY size DESC, said DESC))[1] AS said, sum(size) AS n_linked FROM vote GROUP BY ALL),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
reply AS (SELECT t.conv_id, t.turn, coalesce(k.said, t.before) AS reply_to, coalesce(n_linked, 0) AS n_linked FROM turns t LEFT JOIN linked k USING (conv_id, turn)),
chain(conv_id, turn, root) AS (SELECT conv_id, turn, turn FROM reply WHERE reply_to IS NULL UNION ALL SELECT r.conv_id, r.turn, c.root FROM reply r JOIN chain c ON c.conv_id = r.conv_id AND c.turn = r.reply_to),
own AS (SELECT conv_id, turn, role, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT (regexp_matches(body, '(?i)\bwrote:\s*$') AND coalesce(next_level, 0) > 0)), ''), '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS text, count(*) FILTER (WHERE level > 0) AS n_quoted FROM g GROUP BY ALL)
SELECT conv_id, turn, role, reply_to, root, n_quoted, CAST(n_linked AS BIGINT) AS n_linked, text, '<|' || coalesce(role, '') || '|>' || chr(10) || text || '<|end|>' || chr(10) AS formatted FROM own JOIN reply USING (conv_id, turn) JOIN chain USING (conv_id, turn)""",
    "op11_fill_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS x FROM d),
n AS (SELECT *, len(units) AS n, contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR text = '' OR x[3] % 100 >= 100 AS plain FROM u),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN x[4] % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocab AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
dense AS (SELECT g.lang, g.source, v.term, v.c AS lang_c, CAST(coalesce(k.c, 0) AS HUGEINT) AS c FROM groups g JOIN vocab v USING (lang) LEFT JOIN counts k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
shares AS (SELECT lang, source, term, c, 1 + 1000000000 * (c + 1) // (sum(c) OVER g + count(*) OVER g) AS p, 1 + 1000000000 * (lang_c + 1) // (sum(lang_c) OVER g + count(*) OVER g) AS q FROM dense WINDOW g AS (PARTITION BY lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_line_dedup": r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT *, list_transform(lines, lambda x: trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS keys FROM d),
l AS (SELECT row, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(lines, 1) AS pos FROM k),
gone AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
kept AS (SELECT row, count(*) AS n_lines, count(g.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '') AS text FROM l LEFT JOIN gone g USING (key) GROUP BY row)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept JOIN d USING (row)""",
}
