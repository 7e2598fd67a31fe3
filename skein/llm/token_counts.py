"""Exact token statistics for every context limit from a histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import pieces
from .tokens import encoded, ranks_path


def encoded_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text (null: 0) in column `out`."""
    path = path or ranks_path()
    docs = docs.drop(out)
    names = docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            lengths = pa.array(np.diff(encoded(batch.column(text_col), path)[1]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lengths], [*names, out])

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def length_histogram(docs: DataFrame, by: Sequence[str] = (), text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per distinct encoded length (and group): n_tokens, n_docs.

    Only these counts are shuffled, summed before the shuffle; a text's length is all that leaves the scan."""
    return encoded_lengths(docs.select(*by, text_col), text_col, path).groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each distinct length, taken as a context limit, by prefix and suffix sums over the histogram:

    n_docs of that length, docs_at_least (documents as long or longer), docs_at_most, tokens_at_most (tokens of
    documents no longer), truncated_tokens (all tokens if each document is cut at the limit), total_docs,
    total_tokens and quantile (share of documents no longer). A limit between two lengths has the documents of the lower
    one, and truncated_tokens grows by docs_at_least of the upper one per token.
    The window has one row per distinct length, at most the longest document's length of them.
    An empty table gives no rows; null and empty texts count as length 0."""
    up = W.partitionBy(*by).orderBy("n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*by)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return (
        histogram.withColumn("docs_at_most", F.sum("n_docs").over(up))
        .withColumn("tokens_at_most", F.sum(tokens).over(up))
        .withColumn("total_docs", F.sum("n_docs").over(whole))
        .withColumn("total_tokens", F.sum(tokens).over(whole))
        .withColumn("docs_at_least", F.col("total_docs") - F.col("docs_at_most") + F.col("n_docs"))
        .withColumn("truncated_tokens", F.col("tokens_at_most") + F.col("n_tokens") * (F.col("total_docs") - F.col("docs_at_most")))
        .withColumn("quantile", F.col("docs_at_most") / F.col("total_docs"))
    )
