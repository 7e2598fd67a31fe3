"""HTML to Markdown text, and EPUB containers as a data source: a partition a container, members read one by one."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SILENT = {"script", "style", "noscript", "template", "title"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "figure", "nav", "body"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "image", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
#: Policies of media: what a container's documents keep.
POLICIES = ("text-only", "keep-images", "keep-all")
DOCUMENT = "path string, spine_idx int, href string, html string, assets array<string>, title string, author string"
INDENT, KEPT = "\x01", "\x02"


class Markdown(HTMLParser):
    """Collects Markdown: headings, paragraphs, lists, quotes, tables, code, emphasis, links and, by `media` (a policy), references to
    media. rename gives a reference its new name, or None where it is left out. Elements that are not closed end with what holds them."""

    def __init__(self, media: str = "text-only", rename: Callable[[str], str | None] = lambda reference: reference):
        super().__init__(convert_charrefs=True)
        self.media, self.rename = media, rename
        self.out: list[str] = []
        self.open: list[tuple[str, int, str]] = []  # tag, where its text begins, link address
        self.lists: list[int | None] = []  # the next number of each open list; None without numbers
        self.rows: list[list[list[str]]] = []  # of each open table
        self.kept: list[str] = []  # text that no later step may touch
        self.assets: list[str] = []
        self.drawing = 0

    def inside(self, *tags: str) -> bool:
        return any(tag in tags for tag, _, _ in self.open)

    def keep(self, text: str) -> str:
        self.kept.append(text)
        return f"{KEPT}{len(self.kept) - 1}{KEPT}"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "svg" or self.drawing:
            self.drawing += tag not in VOID
            if self.media == "keep-all":
                self.out.append(self.keep(self.get_starttag_text() or ""))
            return
        if tag in ("img", "image", "audio", "video", "object"):
            self.asset(tag, a)
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in BLOCKS or tag in ("blockquote", "pre", "table", "ul", "ol"):
            self.out.append("\n" if tag in ("ul", "ol") and self.lists else "\n\n")
        if tag in VOID:
            return
        if tag in ("ul", "ol"):
            start = a.get("start", "")
            self.lists.append((int(start) if start.isdigit() else 1) if tag == "ol" else None)
        elif tag == "li":
            self.close_until("li", within=("ul", "ol"))
            number = self.lists[-1] if self.lists else None
            if number is not None:
                self.lists[-1] = number + 1
            begun = not self.out or self.out[-1].endswith("\n")
            self.out.append(("" if begun else "\n") + INDENT * max(len(self.lists) - 1, 0) + ("- " if number is None else f"{number}. "))
        elif tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.close_until("tr", within=("table",))
            self.rows[-1].append([])
        elif tag in ("td", "th"):
            self.close_until("td", "th", within=("tr", "table"))
        elif tag in INLINE and not self.inside("pre"):
            self.out.append(INLINE[tag])
        elif tag == "a" and a.get("href"):
            self.out.append("[")
        self.open.append((tag, len(self.out), a.get("href", "") if tag == "a" else ""))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def asset(self, tag: str, a: dict[str, str]) -> None:
        reference = a.get("src") or a.get("data") or a.get("href") or a.get("xlink:href", "")
        if not reference:
            return
        self.assets.append(reference)
        image = tag in ("img", "image")
        if self.inside(*SILENT) or self.media == "text-only" or self.media == "keep-images" and not image:
            return
        if (name := self.rename(reference)) is None:
            return
        if image:
            self.out.append(f"![{(a.get('alt') or a.get('title') or 'image').strip()}]({name})")
        elif tag == "object":
            self.out.append(f"\n\n[Embedded object: {a.get('type') or 'application/octet-stream'}]({name})\n\n")
        else:
            self.out.append(f'\n\n<{tag} controls src="{name}"></{tag}>\n\n')

    def close_until(self, *tags: str, within: Sequence[str] = ()) -> None:
        """Closes the innermost open element of these tags, and what it holds, unless one of `within` is open inside it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in within:
                return
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self.end(*self.open.pop())
                return

    def handle_endtag(self, tag: str) -> None:
        if self.drawing:
            self.drawing -= tag not in VOID
            if self.media == "keep-all":
                self.out.append(self.keep(f"</{tag}>"))
            return
        self.close_until(tag)

    def end(self, tag: str, at: int, href: str) -> None:
        if tag in ("blockquote", "pre", "td", "th"):
            text = "".join(self.out[at:])
            del self.out[at:]
            if tag == "pre":
                self.out.append(self.keep("```\n" + text.strip("\n") + "\n```") + "\n\n")
            elif tag == "blockquote":
                self.out.append("\n".join(f"> {line}".rstrip() for line in tidy(text).split("\n")) + "\n\n")
            elif self.rows and self.rows[-1]:
                self.rows[-1][-1].append(re.sub(r"\s+", " ", text).strip().replace("|", "\\|"))
        elif tag == "table" and self.rows:
            rows = [r for r in self.rows.pop() if r]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            if self.rows:  # a table in a table's cell
                self.out.append(" ".join(" ".join(r) for r in rows))
            elif lines:
                self.out.append("\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n")
        elif tag in ("ul", "ol"):
            self.lists.pop()
            self.out.append("\n" if self.lists else "\n\n")
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self.out.append("\n\n")
        elif tag in INLINE and not self.inside("pre"):
            self.out.append(INLINE[tag])
        elif tag == "a" and href:
            self.out.append(f"]({href})")

    def handle_data(self, data: str) -> None:
        if self.drawing:
            if self.media == "keep-all":
                self.out.append(self.keep(data))
        elif not self.inside(*SILENT):
            data = data.replace(INDENT, "").replace(KEPT, "")
            table = self.open and self.open[-1][0] in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol") and not data.strip()
            if not table:
                self.out.append(data if self.inside("pre") else re.sub(r"\s+", " ", data))

    def text(self) -> str:
        while self.open:
            self.end(*self.open.pop())
        out = tidy("".join(self.out)).replace(INDENT, "  ")
        while re.search(f"{KEPT}\\d+{KEPT}", out):
            out = re.sub(f"{KEPT}(\\d+){KEPT}", lambda m: self.kept[int(m[1])], out)
        return out


def tidy(text: str) -> str:
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+", "\n", text)).strip()


def to_markdown(html: str | None, media: bool | str = False, rename: Callable[[str], str | None] = lambda reference: reference) -> str:
    """media: a policy, or whether all media are kept."""
    parser = Markdown(("keep-all" if media else "text-only") if isinstance(media, bool) else media, rename)
    parser.feed(html or "")
    parser.close()
    return parser.text()


def with_markdown(pages: DataFrame, html_col: str = "html", out: str = "markdown", media: bool | str = False) -> DataFrame:
    @F.pandas_udf("string")
    def convert(html: pd.Series) -> pd.Series:
        return html.map(lambda h: to_markdown(h, media))

    return pages.withColumn(out, convert(html_col))


def inside(base: str, reference: str) -> str | None:
    """A reference resolved against its document; None if it is empty, remote or leads out of the container."""
    path = re.split("[#?]", reference)[0]
    if not path or re.match(r"[a-z][a-z0-9+.-]*:|/", path, re.I):
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), path))
    return None if path.startswith("..") else path


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def container_rows(path: str, content: BinaryIO, policy: str) -> Iterator[tuple]:
    """The rows (DOCUMENT) of one container, in spine order; only the package and the documents are read."""
    with zipfile.ZipFile(content) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in root.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        items = {e.attrib["id"]: e.attrib for e in package.iter() if e.tag.endswith("}item")}
        kinds = {inside(opf, i.get("href", "")): i.get("media-type", "") for i in items.values()}
        told = lambda name: next(((e.text or "").strip() for e in package.iter() if e.tag.endswith(f"}}{name}")), "") or None
        title, author = told("title"), told("creator")
        seen: set[str] = set()
        for e in (e for e in package.iter() if e.tag.endswith("}itemref")):
            item = items.get(e.attrib.get("idref", ""), {})
            href = inside(opf, item.get("href", ""))
            if not href or href in seen or "html" not in item.get("media-type", "") or "nav" in item.get("properties", "").split():
                continue
            seen.add(href)
            html = z.read(href).decode("utf-8", "replace")
            parser = Markdown()
            parser.feed(html)
            held = [a for r in dict.fromkeys(parser.assets) if (a := inside(href, r)) in kinds and (policy == "keep-all" or policy == "keep-images" and kinds[a].startswith("image/"))]
            yield path, len(seen) - 1, href, html, list(dict.fromkeys(held)), title, author


def epub_documents(files: DataFrame, policy: str = "text-only") -> DataFrame:
    """(path, content) of EPUB files to rows of DOCUMENT: documents in spine order; navigation, repeated and non-document items are left
    out. policy: text-only, keep-images or keep-all media. For files that only Spark reads; read_epub() does not load whole containers."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content):
                yield pd.DataFrame(list(container_rows(path, io.BytesIO(content), policy)), columns=[x.split()[0] for x in DOCUMENT.split(", ")])

    return files.select("path", "content").mapInPandas(rows, DOCUMENT)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Container(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class EpubReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.policy = options.get("path", "").split("\n"), options.get("policy", "text-only")
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {', '.join(POLICIES)}")

    def partitions(self) -> list[Container]:
        """A partition a container; a folder stands for the containers in it."""
        found = []
        for path in filter(None, self.paths):
            fs, where = opened(path)
            if fs.get_file_info(where).type == pafs.FileType.Directory:
                names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(where, recursive=True)) if x.is_file and x.path.lower().endswith(".epub"))
                prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
                found += [Container(prefix + name) for name in names]
            else:
                found.append(Container(path))
        return found

    def read(self, partition: Container | None) -> Iterator[tuple]:
        if partition is None:  # there is no container
            return
        fs, where = opened(partition.path)
        with fs.open_input_file(where) as content:
            yield from container_rows(partition.path, content, self.policy)


class EpubSource(DataSource):
    """`spark.read.format("epub")`: the documents of EPUB containers. Options: path (several, a line each) and policy."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema: object) -> EpubReader:
        return EpubReader(dict(self.options))


def read_epub(spark: SparkSession, paths: str | Sequence[str], policy: str = "text-only") -> DataFrame:
    """Documents (DOCUMENT) of containers on any file system that pyarrow opens; members are read one by one."""
    spark.dataSource.register(EpubSource)
    return spark.read.format("epub").option("policy", policy).option("path", paths if isinstance(paths, str) else "\n".join(paths)).load()


def book_texts(documents: DataFrame, policy: str = "text-only") -> DataFrame:
    """path and text of each container: its title (else the file's name) and author, then its documents as Markdown, in spine order. References to
    kept assets lead to the folder `<name>_assets`. A container's documents meet in one row, which is the book's text."""

    @F.pandas_udf("string")
    def convert(path: pd.Series, href: pd.Series, html: pd.Series, assets: pd.Series) -> pd.Series:
        def one(p: str, h: str, text: str, held: Sequence[str]) -> str:
            own = set(held)
            return to_markdown(text, policy, lambda r: f"{stem(p)}_assets/{a}" if (a := inside(h, r)) in own else None)

        return pd.Series([one(*x) for x in zip(path, href, html, assets)])

    parts = documents.withColumn("markdown", convert("path", "href", "html", "assets"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    head = F.concat(F.lit("# "), F.coalesce(F.first("title"), F.first(name)))
    author = F.concat(F.lit("> 作者："), F.first("author"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("spine_idx", "markdown"))), lambda x: x["markdown"])
    whole = parts.groupBy("path").agg(head.alias("head"), author.alias("author"), F.filter(ordered, lambda x: x != "").alias("parts"))
    return whole.select("path", F.concat(F.concat_ws("\n\n", "head", "author", "parts"), F.lit("\n")).alias("text"), F.size("parts").alias("documents"))


def epub_assets(files: DataFrame, documents: DataFrame) -> DataFrame:
    """path, href and bytes of the assets that documents refer to, once each; no other member is read."""
    wanted = documents.select("path", F.explode("assets").alias("href")).groupBy("path").agg(F.sort_array(F.collect_set("href")).alias("names"))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content, names in zip(b.path, b.content, b.names):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in names:
                        yield pd.DataFrame({"path": [path], "href": [name], "bytes": [z.read(name)]})

    return files.select("path", "content").join(wanted, "path").mapInPandas(members, "path string, href string, bytes binary")


def write_assets(documents: DataFrame, folder: str) -> int:
    """Writes the assets that documents of read_epub() refer to as folder/<name>_assets/href, member by member, and returns how many."""
    wanted = documents.select("path", F.explode("assets").alias("href")).distinct().repartition("path")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, names in b.groupby("path")["href"]:
                fs, where = opened(path)
                target, root = opened(folder)
                with fs.open_input_file(where) as content, zipfile.ZipFile(content) as z:
                    for name in names:
                        place = f"{root.rstrip('/')}/{stem(path)}_assets/{name}"
                        target.create_dir(posixpath.dirname(place), recursive=True)
                        with z.open(name) as source, target.open_output_stream(f"{place}.part") as out:
                            while piece := source.read(1 << 20):
                                out.write(piece)
                        target.move(f"{place}.part", place)
            yield pd.DataFrame({"n": [len(b)]})

    return wanted.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
