"""Sizes and batches, connected components, and columns set aside; written tables are those of operators.lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, drop


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of df from file metadata, at most the sum over what it reads (joins estimate products); None if unknown.
    No job runs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = min(int(plan.stats().sizeInBytes()), sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())))
    return size if size < 1 << 60 else None


def parts_for(df: DataFrame, bytes_each: int, unknown: int = 200_000) -> int:
    """Groups (of which a task may work many) so that each holds about bytes_each, and no fewer than the session's shuffle partitions;
    `unknown` where the size of df can't be told."""
    size = input_bytes(df)
    wanted = unknown if size is None else min(size // bytes_each + 1, (1 << 31) - 1)
    return int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, as one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """text with A-Z alone in lower case; other letters stay."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), by alternating large-star and small-star.

    Returns node, component (the smallest node of it) for nodes of edges between different nodes.
    Each round groups by node with map-side partial minima and joins the minima back, so a hub's
    edges are only counted, never collected; rounds grow with the logarithm of the largest component.
    """
    spark = edges.sparkSession
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = cut(small.where("a <> b").distinct())
        drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def slot(column: str) -> Column:
    """One of 2 ** 21 places of an integer id: tables of them have a bound and can be broadcast."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << 21))


def may_be_in(rows: DataFrame, column: str, some: DataFrame) -> DataFrame:
    """rows whose integer id in column may be in some, and few besides; null ids may stay. Nothing is shuffled."""
    held = F.broadcast(some.select(slot(column).alias("skein_slot")).distinct())
    return rows.withColumn("skein_slot", slot(column)).join(held, "skein_slot", "left_semi").select(*rows.columns)


def not_in(rows: DataFrame, column: str, some: DataFrame) -> DataFrame:
    """rows whose integer id in column is not in some, exactly; null ids stay. Only rows that may be in some are shuffled. some: a written table."""
    held = F.broadcast(some.select(slot(column).alias("skein_slot")).distinct())
    surely = rows.withColumn("skein_slot", slot(column)).join(held, "skein_slot", "left_anti").select(*rows.columns)
    return surely.unionByName(may_be_in(rows, column, some).join(some.hint("merge"), column, "left_anti").select(*rows.columns))


def set_aside(docs: DataFrame, needed: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones under names that clash with none, and what gives them their names and order again."""
    names = {c: f"skein_own_{i}" for i, c in enumerate(docs.columns) if c not in needed}

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])

    return docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]), back
