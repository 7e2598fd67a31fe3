"""Fill-in-the-middle: texts cut in three at unit boundaries and put in another order, by big-integer bit-parallelism.

A text's UTF-8 bytes become one large integer of one bit a byte: bytes.translate maps a class of bytes to 1 and the rest to 0. Shifted
boolean operations on such class masks mark where units start, all bytes at once; bit_count gives their number, and the start of
unit k is the k-th set bit, found by halving the integer: the half that holds the bit is halved again, so a search costs about two
passes over the mask. Hashes of the document's id say after how many units the prefix and the middle end and which form it takes.

Rows are worked one by one where they lie: nothing is shuffled, and a lost task repeats its rows with the same result. Memory is that of
one Arrow batch and some five copies of one text.

Edge cases. Null text is empty; the empty text has no units and stays plain. A null id hashes like an empty one; rows that repeat an id are cut
by the same hashes, each in its own text. A text that holds one of the marks stays plain, so that every output can be taken
apart again. An empty table gives an empty result. Extra columns pass through; those named like made ones are replaced. A very long text
is one row, read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import pieces

MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "word", "char")
CONTINUATION = bytes(range(0x80, 0xC0))
BLANK = b"\t\n\x0b\x0c\r "
MADE = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def table_of(members: bytes) -> bytes:
    """The translation of bytes to the digit 1 for members of a class and 0 for others."""
    return bytes(49 if b in members else 48 for b in range(256))


NEWLINE, SPACES, INNER = table_of(b"\n"), table_of(BLANK), table_of(CONTINUATION)


def class_mask(text: bytes, table: bytes) -> int:
    """Bit i is set where byte i belongs to the class."""
    return int(text[::-1].translate(table), 2) if text else 0


def unit_starts(text: bytes, unit: str = "line") -> int:
    """The mask of bytes that begin a unit: a line with its end, a word with the blanks after it (and, first, those before
    all words), or a character."""
    if not text:
        return 0
    every = (1 << len(text)) - 1
    if unit == "char":
        return every & ~class_mask(text, INNER)
    if unit == "line":
        return (class_mask(text, NEWLINE) << 1 | 1) & every
    blank = class_mask(text, SPACES)
    return ~blank & (blank << 1) & every | 1


def nth_bit(mask: int, k: int, width: int) -> int:
    """The place of the k-th set bit, from 0, of a mask of `width` bits that has more than k."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        if k < (n := low.bit_count()):
            mask, width = low, half
        else:
            mask, at, k, width = mask >> half, at + half, k - n, width - half
    return at


def numbers(key: str) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the sha256 of a key, as unsigned integers."""
    digest = sha256(key.encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def cut_points(starts: int, width: int, first: int, second: int) -> tuple[int, int, int]:
    """The number of units and the bytes at which prefix and middle end, for two numbers that choose them."""
    n = starts.bit_count()
    a, b = sorted((first % (n + 1), second % (n + 1)))
    i = nth_bit(starts, a, width) if a < n else width
    return n, i, i if a == b else nth_bit(starts, b, width) if b < n else width


def transformed(text: bytes, key: str, unit: str, rate: int, spm: int, marks: Sequence[bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    h1, h2, h3, h4 = numbers(key)
    n, i, j = cut_points(unit_starts(text, unit), len(text), h1, h2)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    before, middle, after = text[:i], text[i:j], text[j:]
    p, s, m = marks
    sizes = [len(x.translate(None, CONTINUATION)) for x in (before, middle)]
    if h4 % 100 < spm:
        return n, "spm", *sizes, b"".join((s, after, p, before, m, middle))
    return n, "psm", *sizes, b"".join((p, before, s, after, m, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, marks: Sequence[str] = MARKS) -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output.

    rate: percent of texts that are taken apart; spm: percent of those that put the suffix first. unit: line, word or char."""
    if unit not in UNITS or len(set(marks)) != 3 or not all(marks):
        raise ValueError("unit must be one of line, word, char, and marks three different strings")
    if any(a != b and (a in b or any(a.endswith(b[:k]) for k in range(1, len(b)))) for a in marks for b in marks) or any(m.endswith(m[:k]) for m in marks for k in range(1, len(m))):
        raise ValueError("marks must not overlap each other or themselves")
    made = {f.name for f in MADE}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    names, raw = docs.columns, tuple(m.encode() for m in marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = batch.column(text_col).cast(pa.large_binary()).to_pylist()
            rows = [transformed(t or b"", f"{seed}:{'' if i is None else i}", unit, rate, spm, raw) for i, t in zip(batch.column(id_col).to_pylist(), texts)]
            n, form, prefix, middle, output = zip(*rows) if rows else [()] * 5
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, *(f.name for f in MADE)])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *MADE]))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output of some form was made of."""
    p, s, m = marks
    parts = lambda c, mark: F.split(c, "\\Q" + mark + "\\E", 2)

    def both(first: str, second: str) -> tuple[Column, Column, Column]:
        head = parts(output, second)
        tail = parts(head[1], m)
        return F.substr(head[0], F.lit(len(first) + 1)), tail[0], tail[1]

    before, after, middle = both(p, s)
    psm = F.concat(before, middle, after)
    after, before, middle = both(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(before, middle, after)).otherwise(output)
