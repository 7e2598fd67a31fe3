"""Text files with detected encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CHAPTER_HEADING

# Encodings tried, in order.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5", "utf-16", "utf-16-le", "utf-16-be")
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}"
PLAIN = r"\n\r\t\x20-\x7e"
EXPECTED = rf"{PLAIN}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}{CJK}"
CONTROL = r"[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}]"
SAMPLE = 120_000


def quality_score(text: Column, heading: str = CHAPTER_HEADING) -> Column:
    """How much decoded text looks like text: shares of expected, CJK and unprintable characters and chapter headings of its start."""
    sample = F.substring(text, 1, SAMPLE)
    n = F.length(sample)
    some = F.nullif(n, F.lit(0))

    def without(c: Column, chars: str) -> Column:
        return F.regexp_replace(c, f"[{chars}]++", "")

    # whole runs go at once, and what ASCII text leaves is little; in coalesce(), unlike when(), Catalyst computes equal parts once
    rest = without(sample, PLAIN)
    odd = without(rest, EXPECTED)
    expected, cjk = (n - F.length(odd)) / some, (F.length(rest) - F.length(without(rest, CJK))) / some
    unprintable = (F.length(odd) - F.length(F.regexp_replace(odd, CONTROL, ""))) / some
    headings = F.least(F.regexp_count(sample, F.lit(f"(?md){heading}")), F.lit(300))
    return F.coalesce(expected * 100 + cjk * 20 + headings * 0.5 - unprintable * 200, F.when(n == 0, F.lit(-1e9)))


def decoded(files: DataFrame, encoding: str = "auto", heading: str = CHAPTER_HEADING) -> DataFrame:
    """(path, content) to path, text, encoding, autodetected, confidence, used_replacement.

    With `auto` each encoding that decodes the whole file strictly is a candidate; the best score wins, the earlier
    encoding on ties. Confidence is 1 for a single candidate, else the lead over the second in thirtieths, 0 to 1.
    Without a candidate, or with a fixed encoding, bad bytes become U+FFFD."""

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                found = []
                for k, name in enumerate(ENCODINGS if encoding == "auto" else ()):
                    try:
                        found.append((path, k, name, content.decode(name), False))
                    except UnicodeError:
                        continue
                name = "utf-8" if encoding == "auto" else encoding
                rows += found or [(path, 0, name, content.decode(name, "replace"), encoding == "auto")]
            yield pd.DataFrame(rows, columns=["path", "k", "encoding", "text", "replaced"])

    tried = files.select("path", "content").mapInPandas(candidates, "path string, k int, encoding string, text string, replaced boolean")
    tried = tried.withColumn("score", quality_score(F.col("text"), heading))
    # at most one row an encoding and file
    per = tried.groupBy("path").agg(F.max_by(F.struct("text", "encoding", "replaced"), F.struct("score", F.negative("k"))).alias("best"), F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    lead = F.when(F.size("scores") == 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.get("scores", F.lit(0)) - F.get("scores", F.lit(1))) / 30)))
    confidence = F.when(F.col("best.replaced"), F.lit(0.0)).otherwise(lead)
    return per.select("path", F.col("best.text").alias("text"), F.col("best.encoding").alias("encoding"), F.lit(encoding == "auto").alias("autodetected"), confidence.alias("confidence"), F.col("best.replaced").alias("used_replacement"))


def read_text(spark: SparkSession, paths: str | list[str], encoding: str = "auto", heading: str = CHAPTER_HEADING) -> DataFrame:
    """Whole files as decoded(); any file system that Spark reads."""
    return decoded(spark.read.format("binaryFile").load(paths), encoding, heading)
