"""Line dedup across documents, in DataFrame functions only: lines that many documents share go everywhere, the others stay in place.

A line's key is the line without the blanks [\\x20\\x09-\\x0D] at its ends and with A-Z in lower case. Keys of each document are made
distinct in its row, exploded and hashed (128 bits), and counted; those of enough documents are frequent. Lines are exploded
again with their place, meet the frequent hashes, and the places that are hit go back to their documents, which keep the
other lines in order.

Scale. Counts are summed before their shuffle; exploded rows carry hashes and places, no text. A hash with at least a thousandth of all
frequent occurrences is hot: there are at most a thousand such hashes, so they are broadcast, and their lines are dealt over many
places instead of one. Texts are shuffled once, to meet their places; the key is a hash of id and text, so copies under
different ids are dealt apart, and equal rows of one id share one list. Both lists are written, so that joins can be split.

Edge cases. Null and empty text is one empty line. Rows count as documents of their own, also if they repeat an id or have none. Empty
keys (fewer than `chars` code points) are never dropped. A text whose lines all go becomes empty. An empty table gives an empty
result. Extra columns pass through; those named like made ones are replaced. A very long text is one row with the array of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, cut

BLANK = " \t\n\x0b\x0c\r"
SHARE, PLACES = 1000, 200


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(BLANK)))


def hashed(key: str) -> list[Column]:
    """128 bits of a key."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")]


def frequent_keys(docs: DataFrame, text: Column, documents: int, chars: int) -> DataFrame:
    """a, b, n: hashes of keys that at least `documents` rows hold, and how many hold each."""
    each = docs.select(F.explode(F.array_distinct(line_keys(text))).alias("key")).where(F.length("key") >= chars)
    return each.select(*hashed("key")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= documents)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 10, chars: int = 1) -> DataFrame:
    """docs with their text without frequent lines, n_lines (before) and n_dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    text = F.coalesce(F.col(text_col), F.lit(""))
    frequent = cut(frequent_keys(docs, text, documents, chars))
    total = F.lit(frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot = (F.col("n") * SHARE >= total).alias("hot")  # at most SHARE rows

    doc = [F.xxhash64(id_col, text_col).alias("skein_a"), F.xxhash64(F.lit(1), text_col, id_col).alias("skein_b")]
    lines = docs.select(*doc, F.posexplode(line_keys(text)).alias("at", "key")).where(F.length("key") >= chars).select("skein_a", "skein_b", "at", *hashed("key"))
    lines = lines.join(F.broadcast(frequent.where(hot).select("a", "b", F.lit(True).alias("hot"))), ["a", "b"], "left")
    lines = lines.withColumn("place", F.when(F.col("hot"), F.pmod("skein_a", F.lit(PLACES)).cast("int")).otherwise(0))
    places = F.when(hot, F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    hits = lines.join(frequent.select("a", "b", F.explode(places).alias("place")), ["a", "b", "place"], "left_semi")
    dropped = cut(hits.groupBy("skein_a", "skein_b").agg(F.collect_set("at").alias("skein_dropped")))

    named = docs.withColumn("skein_text", text).withColumns(dict(zip(("skein_a", "skein_b"), doc)))
    met = named.join(dropped, ["skein_a", "skein_b"], "left").withColumn("skein_lines", F.split("skein_text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("skein_lines") - 1), "skein_dropped")
    some = F.array_join(F.transform(stay, lambda i: F.get("skein_lines", i)), "\n")
    met = met.withColumn("n_lines", F.size("skein_lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("skein_dropped"), F.lit(0)).cast("long"))
    met = met.withColumn(text_col, F.when(F.col("n_dropped") > 0, some).otherwise(F.col("skein_text")))
    return met.select(*docs.columns, "n_lines", "n_dropped")
