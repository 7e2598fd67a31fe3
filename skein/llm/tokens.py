"""Token ids from public vocabulary files; the files' path is a parameter and they are only read.

A `.json` file is read by `tokenizers`, a file of ranks by `tiktoken`. Both recognise the special token inside texts."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from .bytewords import column_bytes, spans_hash, sums

# Fixed value: the special token of the ranks' vocabulary, which their file leaves out.
SPECIAL = {"<|endoftext|>": 50256}
# What may follow an apostrophe as a word of its own in the byte-level pattern.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
#: Kinds of characters. EDGE stands between texts; characters of no kind (MIXED) send their text to the library whole.
UNSEEN, LETTER, DIGIT, MARK, SPACE, EDGE, MIXED = range(7)
ASCII_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class Pool:
    """Rows of different lengths, one after the other in an array that doubles when it is full."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        total, more = len(flat), len(lengths)
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        if self.rows + more > len(self.start):
            self.start, self.length = (np.resize(x, 2 * (self.rows + more)) for x in (self.start, self.length))
        self.start[self.rows : self.rows + more] = self.used + np.cumsum(lengths) - lengths
        self.length[self.rows : self.rows + more] = lengths
        self.flat[self.used : self.used + total] = flat
        self.used, self.rows = self.used + total, self.rows + more

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The rows one after the other."""
        lengths = self.length[rows].astype(np.int64)
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Words:
    """Ids of texts from a `tokenizers` file; a word is encoded by the library once and then looked up.

    A file without normaliser whose pre-tokenizer is the byte-level pattern encodes the pattern's matches independently, so a
    text's ids are those of its words in turn. Words are found for all texts of a batch at once, on arrays of code points; a
    character's kind is what the library's own pre-tokenizer takes it for, asked once. Words are looked up by a 64-bit
    hash and compared with the stored characters. Texts that hold an added token, and any text of another kind of file, are
    encoded whole. Beyond `most` stored characters words that were met once since the last time are forgotten, or all but the most
    frequent; texts above `chunk` bytes are cut at spaces between ASCII letters, where words always end. Both bound memory only."""

    def __init__(self, path: str, most: int = 4_000_000, chunk: int = 4_000_000, slots: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task keeps to its own core
        self.path, self.words = path, Tokenizer.from_file(path)
        self.split = self.words.pre_tokenizer
        step = json.loads(self.split.__getstate__()) if self.split else {}
        self.independent = bool(step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and not self.words.normalizer and not getattr(self.words.model, "dropout", None))
        self.added = [x.content for x in self.words.get_added_tokens_decoder().values() if x.content]
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # words are not split again
        self.most, self.chunk, self.slots = most, chunk, slots
        self.kinds = np.zeros(0x110000, np.uint8)
        self.letters, self.numbers, self.times = Pool(), Pool(), np.zeros(0, np.uint32)
        self.keys, self.row, self.kept = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32), 0

    @cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Keeps the words met at least twice, at most half of `most` characters of the most frequent."""
        slot = np.flatnonzero(self.row >= 0)
        keys, rows = self.keys[slot], self.row[slot].astype(np.int64)
        order = np.argsort(-self.times[rows].astype(np.int64), kind="stable")
        order = order[(self.times[rows[order]] > 1) & (np.cumsum(self.letters.length[rows[order]]) <= self.most // 2)]
        keys, rows = keys[order], rows[order]
        for name in ("letters", "numbers"):
            old, new = getattr(self, name), Pool()
            new.append(old.take(rows), old.length[rows])
            setattr(self, name, new)
        self.times = np.zeros(len(rows), np.uint32)
        self.keys, self.row, self.kept = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32), 0
        self.add(keys, np.arange(len(rows)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 for those not kept."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        last = np.uint64(len(self.keys) - 1)
        slot = (keys & last).astype(np.int64)
        while len(todo):
            at = slot[todo]
            row = self.row[at]
            hit = (row >= 0) & (self.keys[at] == keys[todo])
            out[todo[hit]] = row[hit]
            todo = todo[(row >= 0) & ~hit]
            slot[todo] = (slot[todo] + 1) & int(last)
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Keep different hashes, each in the first free slot from its own on; half of the slots stay free."""
        if 2 * (self.kept + len(keys)) > len(self.keys):
            had = self.row >= 0
            keys, rows = np.concatenate((self.keys[had], keys)), np.concatenate((self.row[had], rows))
            size = 1 << (2 * len(keys)).bit_length()
            self.keys, self.row, self.kept = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0
        self.kept += len(keys)
        last = len(self.keys) - 1
        slot = (keys & np.uint64(last)).astype(np.int64)
        while len(keys):
            put = np.zeros(len(keys), bool)
            put[np.unique(slot, return_index=True)[1]] = True
            put &= self.row[slot] < 0
            self.keys[slot[put]], self.row[slot[put]] = keys[put], rows[put]
            keys, rows, slot = keys[~put], rows[~put], (slot[~put] + 1) & last

    def learn(self, points: np.ndarray) -> None:
        """Kinds of characters not seen before: whether one joins a letter, digit, mark or line end to one word."""
        split = self.split.pre_tokenize_str
        for c in np.unique(points).tolist():
            fits = [k for k, x in ((LETTER, "a"), (DIGIT, "1"), (MARK, "!"), (SPACE, "\n")) if len(split(x + chr(c))) == 1]
            self.kinds[c] = fits[0] if len(fits) == 1 else MIXED

    def encoded(self, texts: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and their numbers."""
        use = self.whole if whole else self.words
        own = [x.ids for x in use.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(own), np.uint32), np.fromiter(map(len, own), np.int64, len(own))

    def keep(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: bool) -> np.ndarray:
        """New rows for words."""
        lengths = ends - starts
        flat = points[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        text, at = flat.tobytes().decode("utf-32-le"), np.concatenate(([0], np.cumsum(lengths))).tolist()
        self.letters.append(flat, lengths)
        self.numbers.append(*self.encoded([text[a:b] for a, b in zip(at, at[1:])], whole))
        return np.arange(self.letters.rows - len(lengths), self.letters.rows)

    def starts(self, points: np.ndarray, edges: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """Where words start; edges: the places after each text, which start words too. Texts `lone` stay one word."""
        kinds = self.kinds[points]
        kinds[edges] = EDGE
        if (new := points[kinds == UNSEEN]).size:
            self.learn(new)
            kinds = self.kinds[points]
            kinds[edges] = EDGE
        first = np.concatenate(([0], edges[:-1] + 1))
        if (mixed := np.flatnonzero(kinds == MIXED)).size:
            lone[np.searchsorted(edges, mixed)] = True
        begin = np.empty(len(points), bool)
        begin[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
        begin[edges] = True
        begin[first] = True
        # the last of several spaces before a word stands alone, and a blank there belongs to the word
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != EDGE))
        begin[last] = True
        begin[last[points[last] == 0x20] + 1] = False
        # an apostrophe that starts a word takes a suffix with it
        at = np.flatnonzero((points[:-2] == 0x27) & begin[:-2] & (kinds[1:-1] == LETTER)) if len(points) > 2 else np.zeros(0, np.int64)
        at = at[kinds[at] == MARK]
        for suffix in SUFFIXES:
            own = at[at + len(suffix) < len(points)]
            for k, c in enumerate(suffix):
                own = own[(points[own + 1 + k] == ord(c)) & (kinds[own + 1 + k] == LETTER)]
            begin[own + 1] = False
            begin[own + 1 + len(suffix)] = True
        for i in np.flatnonzero(lone).tolist():
            begin[first[i] + 1 : edges[i]] = False
        return np.flatnonzero(begin)

    def rows_of(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """Rows of the words' ids; words not known yet are encoded and kept. lone: words that are whole texts."""
        keys = spans_hash(sums(points), starts, ends)
        row = self.find(keys)
        if (missing := np.flatnonzero(row < 0)).size:
            some, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[at]
            have = np.zeros(len(some), np.int64)
            for whole in (False, True):
                new = np.flatnonzero(lone[at] == whole)
                if len(new):
                    have[new] = self.keep(points, starts[at[new]], ends[at[new]], whole)
            self.add(some, have)
            row[missing] = have[back]
        lengths = self.letters.length[row].astype(np.int64)
        fits = lengths == ends - starts
        if fits.all() and np.array_equal(self.letters.take(row), points[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]):
            return row
        # two words of one hash: the later ones get rows that no hash leads to
        for i in range(len(row)):
            if not np.array_equal(self.letters.take(row[i : i + 1]), points[starts[i] : ends[i]]):
                row[i] = self.keep(points, starts[i : i + 1], ends[i : i + 1], bool(lone[i]))[0]
        return row

    def some(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that fit into memory together, and n + 1 offsets."""
        text = data.tobytes().decode()
        n = len(offsets) - 1
        ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets[1:]]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = ends + np.arange(n)
        points = np.insert(points, ends, 0)
        lone = np.zeros(n, bool)
        for x in self.added:
            at = text.find(x)
            while at >= 0:
                i = int(np.searchsorted(ends, at, "right"))
                lone[i] = True
                at = text.find(x, int(ends[i]))
        starts = self.starts(points, edges, lone)
        word = ~np.isin(starts, edges, assume_unique=True)
        stops = np.append(starts[1:], len(points))[word]
        starts = starts[word]
        owner = np.searchsorted(edges, starts)
        if self.letters.used > self.most:
            self.forget()
        row = self.rows_of(points, starts, stops, lone[owner])
        if self.letters.rows > len(self.times):
            self.times = np.concatenate((self.times, np.zeros(self.letters.rows + len(self.times), np.uint32)))
        self.times += np.bincount(row, minlength=len(self.times)).astype(np.uint32)
        counts = self.numbers.length[row]
        return self.numbers.take(row), np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(owner, np.arange(n + 1))]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one after the other, and n + 1 offsets; null counts as empty."""
        data, offsets = column_bytes(column)
        if not self.independent:
            flat, counts = self.encoded([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], True)
            return flat, np.concatenate(([0], np.cumsum(counts)))
        parts, ends, had = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for a, b in groups(offsets, self.chunk):
            if b - a > 1 or offsets[b] - offsets[a] <= self.chunk:
                own, at = self.some(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            else:
                text = data[offsets[a] : offsets[b]]
                own = np.concatenate([self.some(x, np.array([0, len(x)]))[0] for x in at_spaces(text, self.chunk)])
                at = np.array([0, len(own)])
            parts.append(own)
            ends.append(at[1:] + had)
            had += len(own)
        return np.concatenate(parts), np.concatenate(ends)


def groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1, a + 1)
        yield a, b
        a = b


def at_spaces(text: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """UTF-8 bytes cut before spaces that stand between ASCII letters, about `most` bytes each."""
    at = 0
    while len(text) - at > most:
        size = most
        while True:
            x = text[at : at + size]
            cuts = np.flatnonzero((x[1:-1] == 0x20) & ASCII_LETTER[x[:-2]] & ASCII_LETTER[x[2:]]) + 1
            if len(cuts) or at + size >= len(text):
                break
            size *= 2
        if not len(cuts):
            break
        yield text[at : at + int(cuts[-1])]
        at += int(cuts[-1])
    yield text[at:]


@cache
def tokenizer(path: str) -> Words:
    """The file's tokenizer, loaded once in each worker."""
    return Words(path)


@cache
def encoder(path: str) -> Any:
    """The ranks' encoder, loaded once in each worker that needs it."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("skein", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encoded(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each whole text, one after the other, and n + 1 offsets; null counts as empty. The special token's string becomes its id."""
    if path.endswith(".json"):
        return tokenizer(path).ids(column)
    encode, special = encoder(path).encode, set(SPECIAL)
    own = [np.asarray(encode(text, allowed_special=special) if text else (), np.uint32) for text in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint32), *own]), np.concatenate(([0], np.cumsum([len(x) for x in own], dtype=np.int64)))
