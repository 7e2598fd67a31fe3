"""Summaries level by level: chunks, chapters, books, and a book's story.

Every level asks for all its rows at once, and each answer is kept by the hash of its prompt, which holds what the level below said. So a changed
chunk asks again for itself, and for its chapter and book only as far as their parts have changed; everything else comes from the cache.
A chapter gathers its own chunks' summaries; a book's chapters are folded in bins of bounded size first, until they fit in one prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import best_effort
from ..functions.providers import Generator
from ..functions.text import clean_json, strip
from ..operators.lineage import cut
from . import generate

VERSION = "v1"
# Templates of prompts; what is summarised follows the first blank line.
PROMPTS = {
    "chunk": "Summarise this passage as JSON with summary, events and characters.\n\n",
    "chapter": "Join these summaries of a chapter's passages into one, as JSON with summary, events, characters and open_questions.\n\n",
    "fold": "Join these summaries of neighbouring chapters into one, as JSON with summary, events and characters.\n\n",
    "book": "Summarise the book from these chapter summaries, as JSON with summary, characters and timeline.\n\n",
    "story": "Tell the book's story from these chapter summaries, as JSON with story.\n\n",
}
BOOK = "struct<summary:string,characters:array<string>,timeline:array<string>>"
ROWS = ["book_id", "scope", "ref_id", "chapter_idx", "summary_type", "input_hash", "content"]


class Levels:
    """Asks level after level and gathers new answers."""

    def __init__(self, generator: Generator, cache: DataFrame | None, write: Callable[[DataFrame], DataFrame]):
        self.generator, self.cache, self.write, self.new = generator, cache, write, []

    def ask(self, rows: DataFrame, level: str, text: str = "text") -> DataFrame:
        """rows with `content`, what was said of a text, input_hash, and cache_hit."""
        asked = rows.withColumn("skein_prompt", F.concat(F.lit(PROMPTS[level]), F.col(text)))
        asked, new = generate.cached_answers(asked, "skein_prompt", self.generator, self.cache, level, VERSION, write=self.write)
        self.new.append(new)
        content = F.coalesce(F.when(F.try_parse_json(clean_json(F.col("answer"))).isNotNull(), clean_json(F.col("answer"))), strip(F.col("answer")), F.lit(""))
        return self.write(asked.withColumn("input_hash", F.sha2(text, 256)).withColumn("content", content).drop("answer", "skein_prompt"))


def joined(order: str, text: str) -> Column:
    """Texts of a group in order, a line each."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")


def summarised(chunks: DataFrame, generator: Generator, cache: DataFrame | None = None, most: int = 12_000, story: bool = True, write: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """Summaries (ROWS and cache_hit) of chunks (book_id, chapter_id, chapter_idx, idx, chunk_text), and the cache's new rows.

    A prompt above the chapters holds at most `most` characters, or one chapter's summary. Summary types of a book: book_summary, and what an answer
    has besides of characters and timeline (JSON lists), and story. Without chunks there are no rows."""
    levels = Levels(generator, cache, write)
    low = levels.ask(chunks.select("book_id", "chapter_id", "chapter_idx", "idx", F.col("chunk_text").alias("text")), "chunk")
    chapters = low.groupBy("book_id", "chapter_id", "chapter_idx").agg(joined("idx", "content").alias("text"))
    chapters = levels.ask(chapters, "chapter")
    items = chapters.select("book_id", F.col("chapter_idx").cast("long").alias("idx"), F.col("content").alias("text"))
    items = generate.reduced(items, most, lambda rows: levels.ask(rows, "fold").select("book_id", "idx", F.col("content").alias("text")))
    texts = write(items.groupBy("book_id").agg(joined("idx", "text").alias("text")))
    books = levels.ask(texts, "book")
    row = lambda rows, scope, kind, ref, at, content="content": rows.select("book_id", F.lit(scope).alias("scope"), F.col(ref).cast("string").alias("ref_id"), F.col(at).cast("int").alias("chapter_idx") if at else F.lit(None).cast("int").alias("chapter_idx"), F.lit(kind).alias("summary_type"), "input_hash", F.col(content).alias("content"), "cache_hit")
    ref = F.concat_ws(":", F.col("chapter_id").cast("string"), F.col("idx").cast("string"))
    out = row(low.withColumn("ref", ref), "chunk", "chunk_summary", "ref", "chapter_idx").unionByName(row(chapters, "chapter", "chapter_summary", "chapter_id", "chapter_idx"))
    parts = books.withColumn("b", best_effort(F.col("content"), BOOK, "summary"))
    parts = parts.withColumns({"summary": F.coalesce("b.value.summary", "content"), "people": F.to_json("b.value.characters"), "timeline": F.to_json("b.value.timeline")})
    for kind, column in (("book_summary", "summary"), ("characters", "people"), ("timeline", "timeline")):
        out = out.unionByName(row(parts.where(F.col(column).isNotNull()), "book", kind, "book_id", None, column))
    if story:
        told = levels.ask(texts, "story")
        told = told.withColumn("told", F.coalesce(best_effort(F.col("content"), "struct<story:string>", "story")["value"]["story"], "content"))
        out = out.unionByName(row(told, "book", "story", "book_id", None, "told"))
    new = levels.new[0]
    for part in levels.new[1:]:
        new = new.unionByName(part)
    return out, new
