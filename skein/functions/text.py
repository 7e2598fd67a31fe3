"""Column functions on text; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as one character class, the same in Java and RE2.
BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Token patterns that retrieval and evidence results depend on.
KEYWORD = r"[\x{4e00}-\x{9fff}A-Za-z0-9_]{2,20}"
EVIDENCE_TOKEN = r"[\x{4e00}-\x{9fff}]{2,8}|[A-Za-z0-9_]{2,20}"
ENTITY = r"[\x{4e00}-\x{9fff}]{2,8}"
SEARCH_TOKEN = r"[\p{L}\p{N}]+"
BETWEEN_TOKENS = r"[^\p{L}\p{N}]+"
CHAPTER_HEADING = r"^第[0-9一二三四五六七八九十百千]+章.*$"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{BLANK}+$", "")


def text_or_empty(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def normalised(c: Column, compact: bool = True) -> Column:
    """Line ends to LF; with `compact` blank lines go and lines lose trailing white space; the whole is stripped."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    if compact:
        lines = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
        c = F.array_join(F.transform(lines, rstrip), "\n")
    return strip(c)


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern that holds no NUL, in order.

    regexp_extract_all() copies the whole text for every match, so its work grows with the square of a long text. Here matches are set
    between NULs in one pass, and every second part is one; NULs of the text itself become blanks before."""
    marked = F.regexp_replace(F.translate(c, "\0", " "), pattern, "\0$0\0")
    return F.filter(F.split(marked, "\0"), lambda x, i: i % 2 == 1)


def runs(c: Column, between: str) -> Column:
    """What lies between the matches of a pattern, without empty parts: all matches of the opposite class of characters."""
    return F.array_remove(F.split(c, between), "")


def keyword_terms(query: Column, given: Column, most: int = 8) -> Column:
    """Given terms first, then those of the query text; distinct in order, at most `most`."""
    terms = F.transform(F.concat(F.coalesce(given, F.array().cast("array<string>")), matches(query, KEYWORD)), strip)
    return F.slice(F.array_distinct(F.filter(terms, lambda t: t != "")), 1, most)


def match_query(terms: Column) -> Column:
    """Terms quoted and joined by OR; quotes inside terms go."""
    plain = F.filter(F.transform(terms, lambda t: F.replace(t, F.lit('"'), F.lit(""))), lambda t: t != "")
    return F.array_join(F.transform(plain, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def token_estimate(c: Column) -> Column:
    n = F.length(c)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 2).cast("int")))


def safe_filename(c: Column) -> Column:
    # What file names may not hold, and the name of an empty one.
    plain = F.regexp_replace(strip(F.regexp_replace(c, r'[\\/:*?"<>|]+', "_")), f"{BLANK}+", "_")
    return F.when(plain == "", F.lit("untitled")).otherwise(plain)


def name_key(c: Column) -> Column:
    """How names are compared: stripped, lower case, without spaces."""
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))


def content_hash(*parts: Column | str) -> Column:
    """sha256 of the parts joined by `::`."""
    return F.sha2(F.concat_ws("::", *parts), 256)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often it is used; written out, an expression that is used twice on each
    of several levels doubles with every level."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_json(c: Column) -> Column:
    """Text that holds JSON, made strict: fence, control characters and trailing commas go; text around an object goes."""
    # The patterns are fixed values: fences, line ends, control characters and trailing commas as models write them.

    def unfenced(c: Column) -> Column:
        fenced = c.startswith("```") & c.endswith("```") & F.contains(c, F.lit("\n"))
        return F.when(fenced, strip(F.regexp_replace(c, r"^```[^\n]*\n|\n?[^\n]*```$", ""))).otherwise(c)

    def inner(c: Column) -> Column:
        return once(F.regexp_extract(c, r"(?s)\{.*\}", 0), lambda found: F.when(c.startswith("{") & c.endswith("}") | (found == ""), c).otherwise(found))

    plain = F.regexp_replace(F.regexp_replace(once(strip(c), unfenced), "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return once(F.regexp_replace(plain, r",\s*([}\]])", "$1"), inner)


def json_list(c: Column) -> Column:
    """array<string> of a JSON list, or of comma-separated text; blank items go."""
    comma = F.split(F.regexp_replace(c, r'[\[\]"]', ""), ",")
    return F.filter(F.transform(F.coalesce(F.from_json(c, "array<string>"), comma, F.array().cast("array<string>")), strip), lambda x: x != "")
