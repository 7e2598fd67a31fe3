"""Effort tiers of chapters and steps of several chapters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate

# Settings of the tiers.
TIERS = [
    ("short", 0.12, 0.2, 0, False, False, False, "fallback"),
    ("medium", 0.2, 0.3, 4, True, False, False, "llm"),
    ("long", 0.4, 0.5, 8, True, True, True, "llm"),
]
TIER_SCHEMA = "tier string, ratio_low double, ratio_high double, memory_top_k int, include_key_dialogue boolean, include_inner_thoughts boolean, refine_enabled boolean, entity_extract_mode string"


@dataclass(frozen=True)
class Tiering:
    enabled: bool = True
    preset: str = "medium"
    default: str = "medium"
    long_every_n: int = 0
    long_min_chars: int = 0
    long_keywords: Sequence[str] = ()


def tier(rule: Tiering, idx: Column, title: Column, text: Column) -> Column:
    """The first of: every n-th chapter, long text, a keyword in the title or the first 4000 characters; else the default."""
    if not rule.enabled:
        return F.lit(rule.preset)
    head = F.lower(F.concat(title, F.lit("\n"), F.substring(text, 1, 4000)))
    tests = [idx % rule.long_every_n == 0] if rule.long_every_n > 0 else []
    tests += [F.length(text) >= rule.long_min_chars] if rule.long_min_chars > 0 else []
    tests += [F.contains(head, F.lit(k.strip().lower())) for k in rule.long_keywords if k.strip()]
    out = F.lit(rule.default)
    for test in reversed(tests):
        out = F.when(test, F.lit("long")).otherwise(out)
    return out


def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, TIER_SCHEMA)


def effective(override: Column, held: object = None, default: object = None) -> Column:
    """A setting's value: the override where there is one (also 0 or False), else the global one, else the default."""
    return F.coalesce(override, F.lit(held), default if isinstance(default, Column) else F.lit(default))


def retrieval_needed(settings: DataFrame) -> Column:
    """Whether any row of settings takes memories."""
    return F.coalesce(F.bool_or(settings["memory_top_k"] > 0), F.lit(False))


def step_start(idx: Column, size: int) -> Column:
    return (F.floor((idx - 1) / size) * size + 1).cast("int")


def step_ranges(chapters: DataFrame, book: str, idx: str, size: int) -> DataFrame:
    """book, step_start, step_end, chapters: steps of `size`, the last one ends at the book's last chapter."""
    steps = chapters.groupBy(book, step_start(F.col(idx), size).alias("step_start")).agg(F.max(idx).cast("int").alias("last"), F.count("*").alias("chapters"))
    most = chapters.groupBy(book).agg(F.max(idx).cast("int").alias("most"))
    return steps.join(most, book).select(book, "step_start", F.least("most", F.col("step_start") + size - 1).alias("step_end"), "chapters")


def draft(text: Column, ratio_high: Column | float) -> Column:
    """The deterministic narration: the first share of the text, one character at least, stripped."""
    from ..functions.text import strip

    high = F.lit(ratio_high) if isinstance(ratio_high, float) else ratio_high
    return strip(F.substr(text, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(text) * high).cast("int"))))


def run_report(chapters: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row of totals for each book over its chapters: idx, text, narration, calls, refine_calls, cache_hit (counts), skipped, warnings,
    actions, supported, unsupported; refine_calls and what follows may be missing and count as none. A row stands for `chapters` of them, one if there is no such column."""
    for c in ("refine_calls", "warnings", "actions", "supported", "unsupported"):
        chapters = chapters if c in chapters.columns else chapters.withColumn(c, F.lit(0))
    chapters = chapters if "skipped" in chapters.columns else chapters.withColumn("skipped", F.lit(False))
    chapters = chapters if "chapters" in chapters.columns else chapters.withColumn("chapters", F.lit(1))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long"))
    tokens = lambda c, when: F.coalesce(F.sum(F.when(when, token_estimate(F.col(c)).cast("long"))), F.lit(0).cast("long"))
    work, refined = ~F.col("skipped"), F.col("refine_calls") > 0
    calls, hits = total("calls"), total("cache_hit")
    return chapters.groupBy("book_id").agg(
        total("chapters").alias("chapters_total"),
        F.coalesce(F.sum(F.when(work & (F.length("narration") > 0), F.col("chapters").cast("long"))), F.lit(0).cast("long")).alias("chapters_processed"),
        F.count_if(F.col("skipped")).alias("chapters_skipped"),
        calls.alias("llm_calls"),
        total("refine_calls").alias("refine_llm_calls"),
        hits.alias("cache_hits"),
        F.greatest(F.lit(0).cast("long"), calls - hits).alias("cache_misses"),
        tokens("text", work).alias("input_tokens"),
        tokens("narration", work).alias("output_tokens"),
        tokens("narration", work & refined).alias("refine_input_tokens"),
        tokens("narration", work & refined).alias("refine_output_tokens"),
        total("warnings").alias("consistency_warnings"),
        total("actions").alias("consistency_actions"),
        total("supported").alias("evidence_supported_claims"),
        total("unsupported").alias("evidence_unsupported_claims"),
        F.coalesce(F.max("idx"), F.lit(0)).cast("int").alias("max_chapter_idx"),
        F.lit(seconds).cast("double").alias("runtime_seconds"),
    )


def summed_reports(reports: DataFrame) -> DataFrame:
    """One report a book out of those of several runs."""
    most = ("max_chapter_idx",)
    return reports.groupBy("book_id").agg(*[(F.max(c) if c in most else F.sum(c)).alias(c) for c in reports.columns if c != "book_id"])


def tier_settings(spark: SparkSession, overrides: Mapping[str, Mapping[str, object]] | None = None, held: Mapping[str, object] | None = None, enabled: bool = True) -> DataFrame:
    """The tiers' table with settings of their own: a tier's override where there is one (also 0 or False), else its own value. Without
    tiers (enabled is False) the global settings `held` come before the tiers' values."""
    table = tier_table(spark)
    for column in table.columns[1:]:
        own = F.lit(None)
        for name, values in (overrides or {}).items():
            own = F.when(F.col("tier") == name, F.lit(values.get(column))).otherwise(own)
        table = table.withColumn(column, effective(own.cast(table.schema[column].dataType), None if enabled else (held or {}).get(column), F.col(column)).cast(table.schema[column].dataType))
    return table
