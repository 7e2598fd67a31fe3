"""Source divergence audit: how far the word shares of one source of a language lie from those of the others, and in which words.

All of it is relational: matches of the term pattern are exploded and counted by (lang, source, term); a language keeps the terms
of enough of its documents; its groups meet its whole kept vocabulary, so that absent terms count zero; the dense rows meet themselves
on language and term, are summed by pairs of sources, and windows rank both parts. Shares are whole numbers of billionths, one added
to every count; divergence is (p - q) squared over q, rounded down term by term, so that sums don't depend on their order.

Scale. Counts are summed before their shuffle, and what is left grows with the vocabulary, not with the text. A document counts a
term once by the distinct terms of its row, so no shuffle by document is needed. Groups and vocabulary meet by language and a hash
of the term, so that a language with most of the rows is spread over all tasks; a term brings the counts of the groups that use it. Dense rows are groups x kept terms of a language, and
the pairs' rows groups squared x kept terms: one key holds one term's groups only, and their sums are taken before the shuffle.
Whether the groups, one row each, are
broadcast is left to Spark, which knows the size of what was written. Windows by group see at most the ranks of each task.

Edge cases. Null text, lang and source are ''. Each row is a document of its own, also if it repeats an id. A group without
terms still has its rows against the others; a language with one source has no pairs; one without kept terms has the value 0 for
every pair. Ties rank by the item's UTF-8 bytes. An empty table gives no rows. Extra columns are not read. A very long text is one
row with the array of its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ascii_lower, cut

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what lies between matches of the term pattern
BILLION = 1_000_000_000


def term_counts(docs: DataFrame, text: Column) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    # the matches of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ are what splitting at the other characters leaves; far cheaper than extracting them
    terms = docs.select("lang", "source", F.sort_array(F.array_remove(F.split(ascii_lower(text), BETWEEN), "")).alias("term"))
    # sorted, so that a term that differs from the one before it is the document's first
    pairs = terms.select("lang", "source", F.inline(F.arrays_zip("term", F.concat(F.array(F.lit("")), "term").alias("before")))).where("term IS NOT NULL")
    return pairs.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def spread(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """The join on a column with few values: left rows are dealt by a hash of `by`, right rows go to every place."""
    places = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("skein_place", F.pmod(F.xxhash64(by), F.lit(places)).cast("int"))
    copies = right.withColumn("skein_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    return dealt.join(copies, [on, "skein_place"]).drop("skein_place")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact; in 64 bits where they hold the product."""
    small = f"1 + {BILLION} * ({count} + 1) div ({total} + {terms})"
    large = f"1 + (CAST({BILLION} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({total} + {terms} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {count} < {BILLION} THEN {small} ELSE {large} END")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: every other source of the language, and the terms that the source
    uses more than its language does, the most divergent first; terms to rank `most_terms`."""
    named = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    groups = named.select("lang", "source").distinct()
    counts = term_counts(named, F.coalesce("text", F.lit("")))
    same = W.partitionBy("lang", "term")  # a term's groups, one row each
    whole = counts.select("lang", "source", "term", F.sum("docs").over(same).alias("lang_docs"), F.sum("n").over(same).alias("lang_n"), F.min("source").over(same).alias("first"), F.collect_list(F.struct("source", "n")).over(same).alias("held"))
    vocabulary = whole.where((F.col("lang_docs") >= least_docs) & (F.col("source") == F.col("first")))
    vocabulary = cut(vocabulary.select("lang", "term", "lang_n", F.map_from_entries("held").alias("held")))

    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = vocabulary.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "v", "lang_total")]))

    dense = spread(vocabulary, groups, "lang", "term").withColumn("n", F.coalesce(F.try_element_at("held", F.col("source")), F.lit(0).cast("long")))
    dense = cut(dense.select("lang", "term", "source", "n", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q")))

    # both sides are the same rows, so that they are shuffled once
    one, two = (dense.select("lang", "term", "source", "p").alias(x) for x in ("one", "two"))
    met = one.join(two, (F.col("one.lang") == F.col("two.lang")) & (F.col("one.term") == F.col("two.term")) & (F.col("one.source") < F.col("two.source")))
    met = met.select("one.lang", "one.source", "one.p", F.col("two.source").alias("item"), F.col("two.p").alias("item_p"))
    # each two sources meet once and are summed both ways
    sums = met.groupBy("lang", "source", "item").agg(F.sum(divergence("p", "item_p")).alias("there"), F.sum(divergence("item_p", "p")).alias("back"))
    both = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    pairs = sums.select("lang", F.inline(both))
    bare = groups.where("v = 0").select("lang", "source")
    bare = spread(bare, bare.withColumnRenamed("source", "item"), "lang", "source").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    terms = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.unionByName(bare.select(*pairs.columns)).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
