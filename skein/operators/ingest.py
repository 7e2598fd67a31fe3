"""Segmentation of texts into chapters and overlapping chunks, with content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, strip


def fixed_slices(docs: DataFrame, key: str, text: str = "text", width: int = 20_000) -> DataFrame:
    """key, idx, title, body, start_pos, end_pos of fixed-width slices; bodies are stripped, empty texts give none."""
    n = F.length(text)
    cut = docs.where(n > 0).select(key, F.col(text).alias("skein_t"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).alias("skein_k"))
    start = F.col("skein_k") * width
    return cut.select(key, (F.col("skein_k") + 1).alias("idx"), F.concat(F.lit("第"), F.col("skein_k") + 1, F.lit("章")).alias("title"), strip(F.substr("skein_t", start + 1, F.lit(width))).alias("body"), start.alias("start_pos"), F.least(start + width, F.length("skein_t")).alias("end_pos"))


def chapters(docs: DataFrame, key: str, heading: str, text: str = "text", width: int = 20_000) -> DataFrame:
    """Chapters of each text: from one heading line to the next, text before the first as a preface; without headings
    fixed_slices(). `heading` matches one whole line.

    Lines of one text are windowed by its key, so work is spread by text."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = W.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("head", F.col("line").rlike(heading).cast("int"))
    lines = lines.withColumn("seg", F.sum("head").over(order)).withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    row = F.struct("pos", "line")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n")
    per = lines.groupBy(key, "seg").agg(F.min("at").alias("start_pos"), (F.max(F.col("at") + F.length("line"))).alias("stop"), whole.alias("block"), F.min_by("line", "pos").alias("first"))
    ahead = W.partitionBy(key).orderBy("seg")
    per = per.withColumn("next", F.lead("start_pos").over(ahead)).withColumn("segs", F.max("seg").over(W.partitionBy(key)))
    per = per.where(F.col("segs") > 0).where((F.col("seg") > 0) | (strip(F.col("block")) != ""))
    block, rest = strip(F.col("block")), strip(F.regexp_replace(strip(F.col("block")), r"(?s)^[^\n]*\n?", ""))
    body = F.when((F.col("seg") == 0) | (rest == ""), block).otherwise(rest)
    title = F.when(F.col("seg") == 0, F.lit("序章")).otherwise(strip(F.col("first")))
    found = per.select(key, F.row_number().over(ahead).alias("idx"), title.alias("title"), body.alias("body"), F.col("start_pos").cast("int").alias("start_pos"), F.coalesce("next", "stop").cast("int").alias("end_pos"))
    plain = docs.where(~F.exists(F.split(text, "\n"), lambda x: x.rlike(heading)))
    return found.unionByName(fixed_slices(plain, key, text, width))


def chunks(parts: DataFrame, keep: list[str], text: str = "text", size: int = 1200, overlap: int = 120, least: int = 200) -> DataFrame:
    """Overlapping windows: keep, idx, chunk_text, start_pos, end_pos, token_count. A tail shorter than `least` joins the chunk before it,
    its overlap twice. Closed form per text, no loop; needs 0 < overlap < size and least <= size."""
    if not 0 < overlap < size or least > size:
        raise ValueError("0 < overlap < size and least <= size are needed")
    step = size - overlap
    n = F.length(text)
    windows = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    joined = (F.col("w") > 1) & (n - (F.col("w") - 1) * step < least)
    rows = parts.where(n > 0).withColumn("w", windows).withColumn("joined", joined).withColumn("count", F.col("w") - joined.cast("int"))
    rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(1), F.col("count"))))
    start, last = (F.col("idx") - 1) * step, F.col("idx") == F.col("count")
    body = F.concat(F.substr(F.col(text), start + 1, F.lit(size)), F.when(last & F.col("joined"), F.substr(F.col(text), start + step + 1, F.lit(size))).otherwise(""))
    end = F.when(last, n).otherwise(start + size)
    return rows.select(*keep, F.col("idx").cast("int").alias("idx"), body.alias("chunk_text"), start.cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), F.length(body).alias("token_count"))


def chapter_hash(book: Column, title: Column, text: Column) -> Column:
    return content_hash(book, title, text)


def rebuilt(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks joined by line ends in order; overlaps stay, as the chunk texts are kept."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "chunk_text")))
    return parts.groupBy(*keys).agg(strip(F.array_join(F.transform(ordered, lambda x: x["chunk_text"]), "\n")).alias("text"))
