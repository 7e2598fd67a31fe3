"""Removal of repeated passages by a distributed merge sort of front-coded suffix runs.

Definition. Texts are UTF-8 bytes. A byte goes when some `length`-byte string that covers it also starts
earlier: in a row of smaller id, or in the same document at an earlier start. Strings are judged on the input.

Plan. Each string of `length` bytes has an anchor, the gram of ANCHOR bytes in it with the least hash
(leftmost on ties): equal strings have equal anchors at equal offsets, so only suffixes that begin at anchors are sorted,
about one in 35, each with the bytes of all strings that share the anchor.

1. Documents are dealt once into chunks by id; Spark reuses this exchange in steps 3 and 5.
2. Chunks send their distinct anchor hashes; those that occur once in the corpus go no further.
3. Chunks sort the suffixes of the others, fold equal ones, front-code the runs (common prefix with the entry before, then
   the new bytes) and deal them by anchor hash. Anchors in more than `hot` chunks are dealt by whole
   strings instead, which spreads one passage of a great many documents over all buckets.
4. Buckets merge their runs with a loser tree that keeps each entry's common prefix with the last winner, so
   known prefixes are never compared again. Neighbours that share an anchor are one group; in it
   every string but its first occurrence marks its bytes.
   The prefix lengths also say which strings of an entry can recur in its group at all: a string that begins a bytes before the
   anchor needs a neighbour that shares length - a bytes with it; others are never looked at.
5. Chunks unite the marked spans.

`length` is from 2 to 65,535 bytes. Chunks and buckets are groups, not tasks: both grow with the input, so that neither does. A chunk sends a
row to each bucket that one of its anchors falls in, so rows grow with the square of the chunks only until a row holds one anchor.

Edge cases. Null text counts as empty. Texts shorter than `length` keep all. Rows with one id are laid out in order of
their text, as if one followed the other (no string crosses rows); rows equal in id and text are one document
listed more than once and get equal results. Null ids sort first. An empty table gives an empty result. Extra columns pass unread. A
very long text lies in one chunk, whose anchors are worked in blocks.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import BASE_INVERSE, column_bytes, mix, powers, spans_hash, sums
from .shared import parts_for

ANCHOR = 32
BLOCK, PLACE_BITS = 1 << 19, 20
NULL_ID = -(1 << 63)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one anchor: first start, last start, anchor place, anchor hash.

    Worked in blocks; the least of (hash, place) packed into one integer gives the leftmost anchor."""
    width, mask = length - gram + 1, np.uint64((1 << PLACE_BITS) - 1)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    out = []
    for s in range(0, max(len(data) - length + 1, 0), BLOCK):
        part = data[s : s + BLOCK + length - 1]
        prefix = sums(part)
        n = len(part) - gram + 1
        h = (prefix[gram:] - prefix[:-gram]) * powers(BASE_INVERSE, n)[:n]
        h = mix(h)
        least = sliding_least((h & ~mask) | np.arange(n, dtype=np.uint64), width)
        starts = np.flatnonzero(inside[s : s + len(least)])
        if not len(starts):
            continue
        place = (least[starts] & mask).astype(np.int64)
        change = np.flatnonzero((place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        head, tail = np.append(0, change), np.append(change, len(starts)) - 1
        out.append((starts[head] + s, starts[tail] + s, place[head] + s, h[place[head]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def laid_out(table: pa.Table, id_col: str, text_col: str) -> tuple[np.ndarray, ...]:
    """Rows in (id, text) order, equal rows once: bytes, offsets, ids, virtual offset of each, and for each input row its place."""
    ids = table.column(id_col).combine_chunks().cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    data, offsets = column_bytes(table.column(text_col))
    raw = data.tobytes()
    if len(np.unique(ids)) == len(ids):
        order = np.argsort(ids, kind="stable").tolist()
        kept, place = order, np.argsort(np.asarray(order, np.int64))
    else:
        text = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], text[i]))
        kept, place = [], np.empty(len(ids), np.int64)
        for i in order:
            if not kept or ids[kept[-1]] != ids[i] or text[kept[-1]] != text[i]:
                kept.append(i)
            place[i] = len(kept) - 1
    sizes = np.diff(offsets)[kept] if len(kept) else np.zeros(0, np.int64)
    out = np.frombuffer(b"".join(raw[offsets[i] : offsets[i + 1]] for i in kept), np.uint8)
    new = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    own = ids[kept]
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    base = new[:-1] - np.repeat(new[:-1][head], np.diff(np.append(head, len(own)))) if len(own) else new[:-1]
    return out, new, own, base, place


def front_code(entries: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes, bytes, bytes]:
    """Sorted (suffix, left context): common prefix lengths, lengths of new bytes, lengths of contexts, and the bytes."""
    lcps, fresh, lefts, out, before = array("H"), array("H"), array("H"), [], b""
    for right, left in entries:
        n = common(before, right, 0)
        lcps.append(n)
        fresh.append(len(right) - n)
        lefts.append(len(left))
        out += (right[n:], left)
        before = right
    return lcps.tobytes(), fresh.tobytes(), lefts.tobytes(), b"".join(out)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, which agree on the first `known` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """A front-coded run, read from its start to its end."""

    __slots__ = ("lcps", "fresh", "lefts", "data", "at", "i", "right", "left")

    def __init__(self, lcps: bytes, fresh: bytes, lefts: bytes, data: bytes):
        self.lcps, self.fresh, self.lefts = (memoryview(x).cast("H") for x in (lcps, fresh, lefts))
        self.data = data
        self.at, self.i, self.right, self.left = 0, -1, b"", b""

    def step(self) -> int:
        """Goes to the next entry; its common prefix with the one before, or -1 at the end."""
        i = self.i = self.i + 1
        if i >= len(self.lcps):
            return -1
        n, cut = self.lcps[i], self.at + self.fresh[i]
        self.right = self.right[:n] + self.data[self.at : cut]
        self.at = cut + self.lefts[i]
        self.left = self.data[cut : self.at]
        return n


def merged(runs: list[Run]) -> Iterator[tuple[int, int, bytes, bytes, int]]:
    """All entries in order: run, index in it, suffix, left context, common prefix with the entry before.

    A loser tree: each inner node holds the loser of its game and the loser's common prefix with the game's winner.
    Of two entries the one that shares more with the last winner is the smaller; only on equality are bytes
    compared, and only those behind the shared prefix."""
    k = 1
    while k < len(runs):
        k *= 2
    known = [0 if i < len(runs) and runs[i].step() >= 0 else -1 for i in range(k)]
    loser = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if known[a] < 0 or known[b] < 0:
            loser[node], win = (a, b) if known[a] < 0 else (b, a)
            return win
        x, y = runs[a].right, runs[b].right
        n = common(x, y, 0)
        win, lost = (a, b) if x[n:] <= y[n:] else (b, a)
        loser[node], known[lost] = lost, n
        return win

    win = play(1) if k > 1 else 0
    last = 0
    while known[win] >= 0:
        run = runs[win]
        yield win, run.i, run.right, run.left, last
        h = run.step()
        node = (win + k) >> 1
        while node:
            other = loser[node]
            g = known[other]
            if g > h:
                loser[node], known[win] = win, h
                win, h = other, g
            elif g == h and h >= 0:
                x, y = runs[win].right, runs[other].right
                n = common(x, y, h)
                if x[n:] <= y[n:]:
                    known[other] = n
                else:
                    loser[node], known[win] = win, n
                    win = other
            node >>= 1
        known[win] = last = h


def repeats(group: list[list], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Of entries (bytes, sorted (id, start) of the first byte, chunk, anchor's offset in them, longest prefix behind the anchor that is
    shared with a neighbour), those strings that occur earlier too, as chunk, id, start and end of bytes."""
    whole: dict[bytes, list] = {}
    for entry in group:
        same = whole.get(entry[0])
        if same is None:
            whole[entry[0]] = [entry[1][0], [entry]]
        else:
            same[1].append(entry)
            same[0] = min(same[0], entry[1][0])
    lone = len(whole) == 1
    seen: set[bytes] = set()
    for text, (first, entries) in whole.items() if lone else sorted(whole.items(), key=lambda x: x[1][0]):
        for _, spots, chunk, *_ in entries:
            for spot in spots:
                if spot != first:
                    yield chunk, spot[0], spot[1], spot[1] + len(text)
        if not lone:
            here, begin, stop, chunk = first, -1, -1, next(e[2] for e in entries if e[1][0] == first)
            for j in range(min(len(text), entries[0][3] + max(x[4] for x in entries)) - length + 1):
                window = text[j : j + length]
                if window in seen:
                    if j > stop + 1 or begin < 0:
                        if begin >= 0:
                            yield chunk, here[0], here[1] + begin, here[1] + stop + length
                        begin = j
                    stop = j
                else:
                    seen.add(window)
            if begin >= 0:
                yield chunk, here[0], here[1] + begin, here[1] + stop + length


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = 20_000, chunk_bytes: int = 1_200_000, keep_text: bool = True) -> DataFrame:
    """docs with the columns n_bytes, n_removed, n_spans, spans (array of start, end), kept_sha256, and
    with keep_text also kept (binary); see the module's text. Columns of docs with these names are replaced."""
    made = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept", "skein_chunk"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    carried = docs.columns
    if not 2 <= length <= 65_535:
        raise ValueError("length must be from 2 to 65535")
    gram = min(ANCHOR, length)
    n = parts_for(docs, chunk_bytes)
    dealt = docs.withColumn("skein_chunk", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"))

    def spread(h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(n)).astype(np.int64)

    def grams(table: pa.Table) -> pa.Table:
        data, offsets, *_ = laid_out(table, id_col, text_col)
        values, counts = np.unique(anchors(data, offsets, length, gram)[3], return_counts=True)
        bucket = spread(values)
        order = np.argsort(bucket, kind="stable")
        values, counts, bucket = values[order], counts[order], bucket[order]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(bucket))
        chunk = table.column("skein_chunk")[0].as_py()
        return pa.table({"bucket": pa.array(bucket[edge], pa.int32()), "chunk": pa.array([chunk] * len(edge), pa.int32()), "grams": pa.array([values[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary()), "many": pa.array([(counts[a:b] > 1).tobytes() for a, b in zip(edge, ends)], pa.binary())})

    def recurring(table: pa.Table) -> pa.Table:
        chunks, lists = table.column("chunk").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        many = np.concatenate([np.frombuffer(x, bool) for x in table.column("many").to_pylist()])
        everything = np.concatenate(lists)
        values, back, counts = np.unique(everything, return_inverse=True, return_counts=True)
        often = (counts > 1) | (np.bincount(back, weights=many, minlength=len(values)) > 0)
        flag = np.where(often, 1 + (counts > hot), 0)[back].astype(np.uint8)
        out, at = [], 0
        for chunk, own in zip(chunks, lists):
            f = flag[at : at + len(own)]
            at += len(own)
            if f.any():
                out.append((chunk, own[f > 0].tobytes(), f[f > 0].tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "grams", "flags"])

    def runs(table: pa.Table, back: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows and back.num_rows:
            data, offsets, ids, base, _ = laid_out(table, id_col, text_col)
            first, last, place, h = anchors(data, offsets, length, gram)
            known = np.concatenate([np.frombuffer(x, np.uint64) for x in back.column("grams").to_pylist()])
            flags = np.concatenate([np.frombuffer(x, np.uint8) for x in back.column("flags").to_pylist()])
            order = np.argsort(known)
            known, flags = known[order], flags[order]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            flag = np.where(known[at] == h, flags[at], 0)
            plain, hotter = flag == 1, flag == 2
            spread_first = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[hotter], last[hotter])]) if hotter.any() else np.zeros(0, np.int64)
            bucket = np.concatenate((spread(h[plain]), spread(spans_hash(sums(data), spread_first, spread_first + length)) if len(spread_first) else np.zeros(0, np.int64)))
            first, last = np.concatenate((first[plain], spread_first)), np.concatenate((last[plain], spread_first))
            place = np.concatenate((place[plain], spread_first))
            doc = np.searchsorted(offsets, first, "right") - 1
            raw = data.tobytes()
            folded: dict[tuple, list] = {}
            for b, i, p, e, d, s in zip(bucket.tolist(), first.tolist(), place.tolist(), (last + length).tolist(), ids[doc].tolist(), (first - offsets[doc] + base[doc]).tolist()):
                folded.setdefault((b, raw[p:e], raw[i:p]), []).append((d, s))
            del raw
            keys = sorted(folded)
            chunk, i = table.column("skein_chunk")[0].as_py(), 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j][0] == keys[i][0]:
                    j += 1
                spots = [folded[k] for k in keys[i:j]]
                for x in spots:
                    x.sort()
                flat = np.array([y for x in spots for y in x], np.int64)
                rows.append((keys[i][0], chunk, *front_code([k[1:] for k in keys[i:j]]), np.array([len(x) for x in spots], np.int32).tobytes(), flat.tobytes()))
                i = j
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=["bucket", "chunk", "lcps", "fresh", "lefts", "data", "counts", "spots"])

    def judged(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("chunk", "lcps", "fresh", "lefts", "data", "counts", "spots")}
        tree = [Run(*x) for x in zip(columns["lcps"], columns["fresh"], columns["lefts"], columns["data"])]
        counts = [np.frombuffer(x, np.int32) for x in columns["counts"]]
        starts = [np.concatenate(([0], np.cumsum(c))).tolist() for c in counts]
        spots = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in columns["spots"]]
        out: dict[int, list] = {}
        group: list[list] = []

        def close() -> None:
            if len(group) > 1 or group and len(group[0][1]) > 1:
                for chunk, d, s, e in repeats(group, length):
                    out.setdefault(chunk, []).append((d, s, e))

        for run, i, right, left, shared in merged(tree):
            if shared < gram:
                close()
                group = []
            elif group:
                group[-1][4] = max(group[-1][4], shared)
            a, b = starts[run][i], starts[run][i + 1]
            group.append([left + right, list(map(tuple, spots[run][a:b].tolist())), columns["chunk"][run], len(left), shared if group else 0])
        close()
        return pa.table({"chunk": pa.array(list(out), pa.int32()), "spans": pa.array([np.array(x, np.int64).tobytes() for x in out.values()], pa.binary())})

    fields = [docs.schema[c] for c in carried]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.BinaryType())] * keep_text)

    def united(table: pa.Table, back: pa.Table) -> pa.Table:
        data, offsets, ids, base, where = laid_out(table, id_col, text_col)
        raw = data.tobytes()
        marks: dict[int, list] = {}
        if back.num_rows:
            found = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in back.column("spans").to_pylist()])
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            head = np.searchsorted(ids, found[:, 0])
            start = offsets[:-1][np.minimum(head, len(ids) - 1)] + found[:, 1]
            doc = np.searchsorted(offsets, start, "right") - 1
            for d, s, n_ in zip(doc.tolist(), (start - offsets[doc]).tolist(), (found[:, 2] - found[:, 1]).tolist()):
                own = marks.setdefault(d, [])
                if own and s <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], s + n_)
                else:
                    own.append([s, s + n_])
        done = []
        for d in range(len(ids)):
            text, at, parts = raw[offsets[d] : offsets[d + 1]], 0, []
            own = marks.get(d, [])
            for s, e in own:
                parts.append(text[at:s])
                at = e
            parts.append(text[at:])
            kept = b"".join(parts)
            done.append((len(text), len(text) - len(kept), len(own), own, hashlib.sha256(kept).hexdigest(), kept))
        done = [done[i] for i in where.tolist()]
        out = table.select(carried)
        for k, (name, kind) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()))):
            out = out.append_column(name, pa.array([x[k] for x in done], kind))
        out = out.append_column("spans", pa.array([[{"start": s, "end": e} for s, e in x[3]] for x in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
        out = out.append_column("kept_sha256", pa.array([x[4] for x in done], pa.string()))
        return out.append_column("kept", pa.array([x[5] for x in done], pa.binary())) if keep_text else out

    # the same columns in every use of the dealt documents, so that the exchange is reused
    by_chunk = dealt.groupBy("skein_chunk")
    found = by_chunk.applyInArrow(grams, "bucket int, chunk int, grams binary, many binary")
    again = found.groupBy("bucket").applyInArrow(recurring, "chunk int, grams binary, flags binary")
    sorted_runs = by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(runs, "bucket int, chunk int, lcps binary, fresh binary, lefts binary, data binary, counts binary, spots binary")
    spans = sorted_runs.groupBy("bucket").applyInArrow(judged, "chunk int, spans binary")
    return by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(united, schema)
