"""Reports as relations of file name and content, and a writer."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_list, safe_filename
from .lineage import cut
from .state import listed

# Headings and phrases of the reports.
NO_STORY = "# 全书说书稿\n\n暂无说书稿数据。\n"
NO_CHARACTERS = "# 人物表\n\n暂无人物数据。\n"
NO_EVENTS = "# 时间线\n\n暂无事件数据。\n"
CHARACTER_HEAD = "# 人物表\n\n| 姓名 | 别名 | 关系 | 动机/目标 | 变化 |\n| --- | --- | --- | --- | --- |\n"


def step_range(payload: Column, prompt_version: Column, idx: Column, size: int) -> Column:
    """Struct of first and last chapter: from the payload if it holds a valid range, else, for step prompts, up to the anchor; or null."""
    a = F.get_json_object(payload, "$.step_start_chapter_idx").try_cast("int")
    b = F.get_json_object(payload, "$.step_end_chapter_idx").try_cast("int")
    given = (a > 0) & (b > 0) & (a <= b)
    start = (F.floor((idx - 1) / max(size, 1)) * max(size, 1) + 1).cast("int")
    inferred = F.contains(F.lower(prompt_version), F.lit("step")) & (idx > 0) & F.lit(size > 1) & (start < idx)
    return F.when(given, F.struct(a.alias("first"), b.alias("last"))).when(inferred, F.struct(start.alias("first"), idx.cast("int").alias("last")))


def chapter_files(narrations: DataFrame, size: int) -> DataFrame:
    """book_id, chapter_idx, filename, content from narrations (book_id, chapter_idx, title, narration_text, prompt_version, payload_json)."""
    rows = narrations.withColumn("title", F.coalesce("title", F.concat(F.lit("第"), F.col("chapter_idx"), F.lit("章"))))
    rows = rows.withColumn("r", step_range(F.col("payload_json"), F.col("prompt_version"), F.col("chapter_idx"), size))
    safe = safe_filename(F.col("title"))
    several = F.col("r").isNotNull() & ((F.col("r.first") != F.col("chapter_idx")) | (F.col("r.last") != F.col("chapter_idx")))
    name = F.when(F.col("r").isNotNull(), F.concat(F.format_string("%03d-%03d_", "r.first", "r.last"), safe)).otherwise(F.concat(F.format_string("%03d_", F.col("chapter_idx")), safe))
    step_head = F.concat(F.lit("# 第"), F.col("r.first"), F.lit("-"), F.col("r.last"), F.lit("章（Step 汇总）\n\n> 锚点章节：第"), F.col("chapter_idx"), F.lit("章 "), "title")
    head = F.when(several, step_head).otherwise(F.concat(F.lit("# 第"), F.col("chapter_idx"), F.lit("章 "), "title"))
    return rows.select("book_id", "chapter_idx", F.concat(name, F.lit(".md")).alias("filename"), F.concat(head, F.lit("\n\n"), "narration_text", F.lit("\n")).alias("content"))


def full_story(files: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("chapter_idx", "filename", "content")))
    return files.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("content"))


def characters_table(characters: DataFrame) -> DataFrame:
    """A Markdown table of each book's characters by name."""
    cells = [F.coalesce(F.col("canonical_name"), F.lit("")), F.array_join(json_list(F.coalesce("aliases_json", F.lit(""))), ", ")] + [F.coalesce(F.col(c), F.lit("")) for c in ("relationships_json", "motivation", "status")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("canonical_name").alias("k"), row.alias("row"))))
    return characters.groupBy("book_id").agg(F.concat(F.lit(CHARACTER_HEAD), F.array_join(F.transform(ordered, lambda x: x["row"]), "\n"), F.lit("\n")).alias("content"))


def timeline(events: DataFrame) -> DataFrame:
    """A numbered list of each book's events (book_id, event_id, chapter_idx, event_summary, impact)."""
    line = F.concat(F.when(F.col("chapter_idx").isNotNull(), F.concat(F.lit("[第"), F.col("chapter_idx"), F.lit("章] "))).otherwise(""), F.coalesce("event_summary", F.lit("")), F.when(F.coalesce("impact", F.lit("")) != "", F.concat(F.lit("（影响："), F.col("impact"), F.lit("）"))).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("chapter_idx", F.lit(-1)).alias("c"), "event_id", line.alias("line"))))
    numbered = F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    return events.groupBy("book_id").agg(F.concat(F.lit("# 时间线\n\n"), F.array_join(numbered, "\n"), F.lit("\n")).alias("content"))


def story(text: Column) -> Column:
    return F.concat(F.lit("# 说书稿\n\n"), F.when(F.coalesce(text, F.lit("")) == "", F.lit("暂无说书稿数据。")).otherwise(text), F.lit("\n"))


def book_summary(title: Column, summary: Column) -> Column:
    return F.concat(F.lit("# "), F.when(F.coalesce(title, F.lit("")) == "", F.lit("(未命名)")).otherwise(title), F.lit("\n\n"), summary, F.lit("\n"))


def legacy_files(summaries: DataFrame) -> DataFrame:
    """Reports of books from summaries (book_id, summary_type, content as JSON text): the book's summary, and story, characters and timeline
    where there are such summaries. Books without a book summary have none."""
    wide = summaries.groupBy("book_id").pivot("summary_type", ["book_summary", "story", "characters", "timeline"]).agg(F.first("content"))
    wide = wide.where(F.col("book_summary").isNotNull())
    people = F.from_json("characters", "array<struct<name:string,aliases:string,relationships:string,motivation:string,changes:string>>")
    events = F.from_json("timeline", "array<struct<chapter_idx:int,event:string,impact:string>>")

    def person(x: Column) -> Column:
        cells = [F.coalesce(x["name"], F.lit("")), F.array_join(json_list(F.coalesce(x["aliases"], F.lit(""))), ", "), *[F.coalesce(x[c], F.lit("")) for c in ("relationships", "motivation", "changes")]]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    def event(x: Column, i: Column) -> Column:
        where = F.when(x["chapter_idx"].isNotNull(), F.concat(F.lit("[第"), x["chapter_idx"], F.lit("章] "))).otherwise("")
        impact = F.when(F.coalesce(x["impact"], F.lit("")) != "", F.concat(F.lit("（影响："), x["impact"], F.lit("）"))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), where, F.coalesce(x["event"], F.lit("")), impact)

    none = F.lit(None).cast("string")
    table_ = F.when(F.size(people) > 0, F.concat(F.lit(CHARACTER_HEAD), F.array_join(F.transform(people, person), "\n"), F.lit("\n"))).otherwise(NO_CHARACTERS)
    list_ = F.when(F.size(events) > 0, F.concat(F.lit("# 时间线\n\n"), F.array_join(F.transform(events, event), "\n"), F.lit("\n"))).otherwise(NO_EVENTS)
    files = {"book_summary.md": F.col("book_summary"), "story.md": F.when(F.col("story").isNotNull(), story(F.col("story"))).otherwise(none), "characters.md": F.when(F.col("characters").isNotNull(), table_).otherwise(none), "timeline.md": F.when(F.col("timeline").isNotNull(), list_).otherwise(none)}
    rows = F.array(*[F.struct(F.lit(name).alias("filename"), content.alias("content")) for name, content in files.items()])
    return wide.select("book_id", F.inline(rows)).where("content IS NOT NULL")


def export_mode(mode: str, narrations: DataFrame) -> str:
    """`auto` is `storyteller` if there is any narration, else `legacy`."""
    if mode not in ("storyteller", "legacy", "auto"):
        raise ValueError(f"unknown export mode {mode}")
    return ("legacy" if narrations.isEmpty() else "storyteller") if mode == "auto" else mode


def evidence_lines(hits: DataFrame) -> DataFrame:
    """One numbered line per query and hit, texts on one line and cut at 300 characters."""
    text = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    short = F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 300), F.lit("..."))).otherwise(text)
    return hits.withColumn("line", F.concat(F.lit("["), F.col("rank"), F.lit("] chunk_id="), F.col("source_id"), F.lit(" 章节"), F.col("chapter_idx"), F.lit(" "), F.col("chapter_title"), F.lit(": "), short))


def with_outputs(narrations: DataFrame, outputs: DataFrame) -> DataFrame:
    """narrations with the payload_json of their stored output (narration_id, payload_json), null where there is none."""
    return narrations.drop("payload_json").join(outputs.select("narration_id", "payload_json"), "narration_id", "left")


def world_state(books: DataFrame, most_facts: int = 1000, **tables: DataFrame) -> DataFrame:
    """book_id and world_state.json's content: the book (book_id, title) and its rows of each table, sorted.

    tables: narrations, characters, items, plot_events, world_facts, each with book_id; the first `most_facts` facts are held."""
    orders = {"narrations": ["chapter_idx"], "characters": ["name"], "items": ["name"], "plot_events": ["chapter_idx", "pos"], "world_facts": ["fact_key"]}
    out = books.select("book_id", F.col("title").alias("book_title"))
    for name, rows in tables.items():
        part = listed(rows, orders[name], name, most_facts if name == "world_facts" else None)
        out = out.join(part, "book_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out.select("book_id", F.to_json(F.struct("book_id", "book_title", *tables), {"pretty": "true"}).alias("content"))


def write_files(files: DataFrame, folder: str, stale: str | None = None) -> int:
    """Writes (book_id, filename, content) as files folder/book_id/filename, each from the task that holds its row; returns how many.

    A file is written beside its place and renamed, so that readers see whole files and a repeated task does no harm. stale: a pattern of names; files
    of the written books that match it and are not among the new ones are removed, book by book, once all files are written."""
    named = files.select(F.col("book_id").cast("string").alias("book_id"), "filename", "content")

    def place(book: str | None) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        return fs, f"{root.rstrip('/')}/{quote(book or 'none', safe=' ')}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, name, content in zip(*(batch.column(c).to_pylist() for c in ("book_id", "filename", "content"))):
                fs, where = place(book)
                fs.create_dir(where, recursive=True)
                part = f"{where}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write((content or "").encode())
                fs.move(part, f"{where}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    def swept(table: pa.Table) -> pa.Table:
        names, gone = set(table.column("filename").to_pylist()), 0
        fs, where = place(table.column("book_id")[0].as_py())
        for found in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)):
            if found.is_file and found.base_name not in names and re.fullmatch(stale, found.base_name):
                fs.delete_file(found.path)
                gone += 1
        return pa.table({"n": pa.array([gone], pa.int64())})

    if stale is not None:
        named = cut(named)
    written = named.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if stale is not None:
        named.select("book_id", "filename").groupBy("book_id").applyInArrow(swept, "n long").agg(F.sum("n")).collect()  # names only; one row
    return written
