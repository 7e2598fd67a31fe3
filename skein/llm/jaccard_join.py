"""Similarity join on sets of word n-grams, by R-trees over vectors of group counts.

Words are lower-cased in A-Z; a document's set holds its distinct n-word shingles as 64-bit hashes (fewer words: the whole
sequence is one shingle; none: empty). Two documents link when 100 * intersection >= percent * union.
The result gives each document its set's size and its component: the smallest id that links reach.

1. Documents with equal sets fold into one representative.
2. Points. Shingles are hashed into coordinates (about one per 24 shingles, a power of two, so that longer vectors
   fold to shorter ones); a document's point holds its counts. The sum of coordinate minima of two points bounds
   the intersection from above.
3. Routing. Shingles have a global order: rare ones first, by counts from a sketch of fixed size over all documents,
   then by hash. Two linked documents share a shingle among the first n - ceil(percent * n / 100) + 1 of each.
   Few documents with one such shingle give pairs, of which the bound drops most; many are indexed in an R-tree
   that yields a spanning forest of the pairs within the bound, not the pairs.
4. Join. Groups that remain connected are leaves. In each an R-tree over the points finds, for each document, those whose
   bound allows a link; a node is entered only if its upper corner does. Survivors in other components are
   verified on the sets. Groups with more than `leaf_shingles` shingles are split by size class and hash; pairs
   of their leaves are joined in a second round, in which documents already connected are skipped.
5. Components of the links found are those of all links.

Edge cases. Null text, no words: size 0, linked with nothing, component the own id. Rows of one id are one
node, linked with what any of them links with; each row has its own size. A row without an id has the component of the rows
with its set, if one of those has an id, and links nothing. An empty table gives an empty result. Extra columns are
ignored. A very long text is one set in memory, 8 bytes a shingle; its point has 1024 coordinates of 32 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import LOWER, column_bytes, mix, pieces, shingles, spans_hash, sums, words
from .shared import components, cut, drop, input_bytes, may_be_in, not_in

SLOT_BITS, SLOT_BLOCK = 20, 4096
#: Documents with one shingle: up to FEW give pairs, more than MANY are dealt in tiles.
FEW, MANY = 12, 20_000
#: Keys are counted in rounds, each a share of all keys, so that their shuffle files are never on disk together: a round for so many bytes of sketches, up to ROUNDS.
ROUND_BYTES, ROUNDS = 64 << 20, 8


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = column_bytes(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    return [np.unique(x) for x in shingles(spans_hash(sums(data), starts, ends), first, n)]


def counted(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Documents per slot of 2 ** SLOT_BITS hashed shingle slots, over all documents; a fixed 8 MB on the driver.

    Tasks send blocks of counts, which are added in two steps, so that no group grows with the number of tasks alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in pieces(batches, text_col):
            total += np.bincount((np.concatenate(shingle_sets(batch.column(text_col), n)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        blocks = np.minimum(total, 65535).astype(np.uint16).reshape(-1, SLOT_BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        salt = TaskContext.get().partitionId() % 256
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([salt] * len(some), pa.int32()), pa.array([blocks[i].astype(np.int64).tobytes() for i in some], pa.binary())], ["block", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    once = docs.select(text_col).mapInArrow(count, "block int, salt int, counts binary").groupBy("block", "salt").applyInArrow(add, "block int, counts binary")
    out = np.zeros(1 << SLOT_BITS, np.int64)
    added = cut(once.groupBy("block").applyInArrow(add, "block int, counts binary"))
    for block, counts in added.collect():  # bounded: one row per block
        out[block * SLOT_BLOCK : (block + 1) * SLOT_BLOCK] = np.frombuffer(counts, np.int64)
    drop(added)
    return out


def point(own: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes per coordinate."""
    width = 1 << max(4, min(10, (len(own) // 24).bit_length()))
    return np.bincount((mix(own) & np.uint64(width - 1)).astype(np.int64), minlength=width)


def folded(v: np.ndarray, width: int) -> np.ndarray:
    return v.reshape(-1, width).sum(axis=0) if len(v) > width else v


def overlap_needed(a: int | np.ndarray, b: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, packed in order of set size and counts; only upper corners and size ranges are kept."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.order = np.lexsort((*points.T[: min(4, points.shape[1])][::-1], sizes))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        self.fan = fan
        while len(self.levels[-1][1]) > fan:
            top, least, most = self.levels[-1]
            at = np.arange(0, len(least), fan)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indices of points whose bound allows a link with the query."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[depth]
            at = at[(most[at] * 100 >= size * percent) & (least[at] * percent <= size * 100)]
            at = at[np.minimum(top[at], point).sum(axis=1) >= overlap_needed(size, np.maximum(least[at], -(-size * percent // 100)), percent)]
            if depth:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def leaf_links(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different labels: a spanning forest of the leaf's links. Only pairs of different sides, or any if all sides are 0."""
    sizes = np.array([len(x) for x in sets], np.int64)
    points = [point(x) for x in sets]
    width = min(map(len, points))
    points = np.array([folded(x, width) for x in points], np.int32)
    tree = CountTree(points, sizes)
    both = bool(side.any())
    labels, out = labels.copy(), []
    for q in np.argsort(ids, kind="stable").tolist():
        found = tree.near(points[q], int(sizes[q]), percent)
        found = found[(side[found] != side[q])] if both else found[(ids[found] < ids[q]) | ((ids[found] == ids[q]) & (found < q))]
        found = found[labels[found] != labels[q]]
        step = 1
        while len(found):
            some, found = found[:step], found[step:]
            held = np.concatenate([sets[i] for i in some])
            at = np.minimum(np.searchsorted(sets[q], held), len(sets[q]) - 1)
            same = np.add.reduceat((sets[q][at] == held).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
            for i in some[100 * same >= percent * (sizes[some] + sizes[q] - same)].tolist():
                if labels[i] != labels[q]:
                    out.append((int(ids[i]), int(ids[q])))
                    labels[labels == labels[q]] = labels[i]
            found = found[labels[found] != labels[q]]
            step = min(step * 2, 64)
    return out


def within_bound(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two points allow a link."""
    width = min(len(a), len(b))
    n, m = int(a.sum()), int(b.sum())
    return min(n, m) * 100 >= max(n, m) * percent and int(np.minimum(folded(a, width), folded(b, width)).sum()) >= overlap_needed(n, m, percent)


def bound_forest(ids: np.ndarray, points: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the bound; if sides differ, of the pairs of different sides.

    Neighbours in size order are tried first; then only points outside the largest component ask the tree."""
    sizes = np.array([int(x.sum()) for x in points], np.int64)
    width = min(map(len, points))
    flat = np.array([folded(x, width) for x in points], np.int32)
    labels, out, both = np.arange(len(ids)), [], bool(side.any())

    def join(i: int, j: int) -> None:
        if labels[i] != labels[j]:
            out.append((int(ids[i]), int(ids[j])))
            labels[labels == labels[j]] = labels[i]

    tree = CountTree(flat, sizes)
    order = tree.order
    for step in (1, 2, 3) if len(ids) > 2 else ():
        i, j = order[:-step], order[step:]
        fits = (np.minimum(flat[i], flat[j]).sum(axis=1) >= overlap_needed(sizes[i], sizes[j], percent)) & (np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * percent)
        fits &= (side[i] != side[j]) | (not both)
        for x, y in zip(i[fits].tolist(), j[fits].tolist()):
            if labels[x] != labels[y] and within_bound(points[x], points[y], percent):
                join(x, y)
    values, counts = np.unique(labels, return_counts=True)
    for q in np.flatnonzero(labels != values[counts.argmax()]).tolist():
        near = tree.near(flat[q], int(sizes[q]), percent)
        near = near[(side[near] != side[q]) | (not both)]
        while len(near := near[labels[near] != labels[q]]):
            if within_bound(points[q], points[near[0]], percent):
                join(q, int(near[0]))
            else:
                near = near[1:]
    return out


def candidates(sketched: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b that connect whatever shares a key within the bound. sketched: id, keys, point."""
    every = sketched.select("id", F.explode("keys").alias("key"))
    rounds = int(min((input_bytes(sketched) or 0) // ROUND_BYTES + 1, ROUNDS))
    written = []
    for i in range(rounds):
        keys = every.where(F.pmod("key", F.lit(rounds)) == i) if rounds > 1 else every
        # counted before the shuffle and joined back, so that a key of very many documents is never in one task
        written.append(cut(keys.join(keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").hint("merge"), "key")))
    shared = reduce(DataFrame.unionByName, written)
    listed = shared.where(F.col("df") <= FEW).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    pair = F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x AS a, y AS b))))")
    pairs = listed.select(F.explode(pair).alias("p")).select("p.a", "p.b").distinct()
    points = sketched.select("id", "point")
    pairs = pairs.join(points.select(F.col("id").alias("a"), F.col("point").alias("pa")), "a").join(points.select(F.col("id").alias("b"), F.col("point").alias("pb")), "b").select("a", "b", "pa", "pb")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within_bound(np.frombuffer(x, np.uint32).astype(np.int64), np.frombuffer(y, np.uint32).astype(np.int64), percent) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], ["a", "b"])

    def forest(table: pa.Table) -> pa.Table:
        points = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("point").to_pylist()]
        found = bound_forest(table.column("id").to_numpy(), points, table.column("side").to_numpy(), percent) if len(points) > 1 else []
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    # a key of very many documents is dealt in tiles: part i meets part j
    dense = shared.where(F.col("df") > FEW).withColumn("parts", F.ceil(F.col("df") / MANY).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.struct(F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    dense = dense.select("id", "key", tile.alias("tile"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side")).join(points, "id")
    tree = dense.groupBy("key", "tile").applyInArrow(forest, "a long, b long")
    found = cut(pairs.mapInArrow(bounded, "a long, b long").unionByName(tree))
    for part in written:
        drop(part)
    return found


def links_within(docs: DataFrame, leaves: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Links inside each leaf. leaves: leaf, id, label, side."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "skein_text"):
            own = shingle_sets(batch.column("skein_text"), n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("leaf", "id", "label", "side")), pa.array([x.tobytes() for x in own], pa.binary())], ["leaf", "id", "label", "side", "hashes"])

    def join(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        ids, labels, side = (table.column(c).to_numpy() for c in ("id", "label", "side"))
        found = leaf_links(ids, own, labels, side, percent) if len(own) > 1 else []
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    leaves = cut(leaves)
    texts = may_be_in(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("skein_text")), "id", leaves)
    chosen = leaves.join(texts.hint("merge"), "id").select("leaf", "id", "label", "side", "skein_text")  # leaves have no size bound: never broadcast
    return chosen.mapInArrow(sets, "leaf string, id long, label long, side int, hashes binary").groupBy("leaf").applyInArrow(join, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, leaf_shingles: int = 2_000_000) -> DataFrame:
    """One row per document: the id, n_shingles and component_id; see the module's text."""
    docs = docs.select(id_col, text_col)
    totals = counted(docs, text_col, n)
    mean = max(totals.mean(), 1.0)
    rarity = np.minimum(8 * np.log2(totals / mean + 1), 255).astype(np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            own = shingle_sets(batch.column(text_col), n)
            sizes = np.array([len(x) for x in own], np.int64)
            one, two = (np.array([np.bitwise_xor.reduce(mix(x)) if k else x.sum(dtype=np.uint64) for x in own], np.uint64).view(np.int64) for k in (0, 1))
            seen, flat, doc = set(), [], []
            named = np.flatnonzero(batch.column(id_col).is_valid().to_numpy(zero_copy_only=False))
            ids = batch.column(id_col).cast(pa.int64()).drop_null().to_numpy(zero_copy_only=False)
            for i in named[np.argsort(ids, kind="stable")].tolist():  # of equal sets the smallest id has the keys; a row without id represents none
                x = own[i]
                if len(x) and (key := (int(one[i]), int(two[i]), len(x))) not in seen:
                    seen.add(key)
                    p = len(x) - -(-percent * len(x) // 100) + 1
                    order = (rarity[(x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] << np.uint64(56)) | (x >> np.uint64(8))
                    flat.append(x[np.argpartition(order, p - 1)[:p]] if p < len(x) else x)
                    doc.append(np.full(len(flat[-1]), i))
            flat, doc = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((flat, np.uint64), (doc, np.int64)))
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(len(own) + 1))
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[order].view(np.int64), pa.int64()))
            points = pa.array([point(x).astype(np.uint32).tobytes() if len(x) else None for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(sizes), pa.array(one), pa.array(two), keys, points], ["id", "n", "s1", "s2", "keys", "point"])

    sketched = cut(docs.mapInArrow(sketch, "id long, n long, s1 long, s2 long, keys array<long>, point binary"))
    slim = cut(sketched.select("id", "n", "s1", "s2"))
    # written, so that the join below reads both sides from exchanges and a hot group of copies can be split
    first = cut(slim.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")))
    member = slim.join(first, ["s1", "s2", "n"], "left").select("id", "n", "rep")
    # keys of copies are those of their representative
    named = slim.where("n > 0 AND id IS NOT NULL").select("id").distinct()
    copies = cut(named.join(first.select(F.col("rep").alias("id")), "id", "left_anti"))
    unique = cut(not_in(sketched.where("n > 0 AND id IS NOT NULL").select("id", "keys", "point"), "id", copies))
    drop(sketched)
    near = candidates(unique, percent)
    drop(unique)
    drop(copies)
    groups = components(near)

    reps = first.join(groups, first.rep == groups.node).select("rep", "n", F.col("component").alias("grp"))
    reps = cut(reps)
    several = reps.groupBy("grp").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    small = reps.join(several.where(F.col("shingles") <= leaf_shingles), "grp").select(F.concat_ws(":", F.col("grp")).alias("leaf"), F.col("rep").alias("id"), F.col("rep").alias("label"), F.lit(0).alias("side"))
    large = reps.join(several.where(F.col("shingles") > leaf_shingles), "grp")
    ratio = math.log(100 / percent) / 2
    large = large.withColumn("size_class", F.floor(F.log("n") / ratio).cast("int"))
    splits = large.groupBy("grp", "size_class").agg(F.ceil(F.sum("n") / leaf_shingles).cast("int").alias("parts"))
    large = large.join(splits, ["grp", "size_class"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    own = F.concat_ws(":", "grp", "size_class", "part")
    links = cut(links_within(docs, small.unionByName(large.select(own.alias("leaf"), F.col("rep").alias("id"), F.col("rep").alias("label"), F.lit(0).alias("side"))), id_col, text_col, n, percent))
    if not large.isEmpty():
        # one document per leaf and component first, then all pairs of leaves that still hold different components
        for whole in (False, True):
            found = components(links)
            now = large.join(found, large.rep == found.node, "left").select("grp", "size_class", "part", "parts", "rep", F.coalesce("component", "rep").alias("label"))
            if not whole:
                now = now.groupBy("grp", "size_class", "part", "parts", "label").agg(F.min("rep").alias("rep"))
            now = cut(now)
            leaf = now.groupBy("grp", "size_class", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
            x, y = leaf.alias("x"), leaf.alias("y")
            near = (F.col("y.size_class") - F.col("x.size_class")).between(0, 3)
            later = (F.col("y.size_class") > F.col("x.size_class")) | (F.col("y.part") > F.col("x.part"))
            differ = (F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi"))
            pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & near & later & differ)
            pairs = pairs.select(F.col("x.grp").alias("grp"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("size_class", "part")])
            name = F.concat_ws(":", "grp", *[f"{s}_{c}" for s in "xy" for c in ("size_class", "part")])
            sides = [pairs.select(name.alias("leaf"), "grp", F.col(f"{s}_size_class").alias("size_class"), F.col(f"{s}_part").alias("part"), F.lit(k).alias("side")) for k, s in enumerate("xy")]
            rows = sides[0].unionByName(sides[1]).join(now, ["grp", "size_class", "part"]).select("leaf", F.col("rep").alias("id"), "label", "side")
            links = cut(links.unionByName(links_within(docs, rows, id_col, text_col, n, percent)))
    found = components(links)
    return member.join(found, member.rep == found.node, "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when each component of linked texts keeps one: the smallest id, null last.

    Where ids are null or repeat, rows are told apart by numbers of their own, so texts of one id that are no near copies
    all stay; of rows with one id in one component the one with the smallest hash over all columns stays. Rows without words stay,
    but of rows equal in id and text one. Extra columns pass through."""
    kinds = docs.groupBy(id_col).agg(F.count("*").alias("rows")).where(F.col(id_col).isNull() | (F.col("rows") > 1))
    if kinds.isEmpty():
        found = jaccard_components(docs, id_col, text_col, n, percent)
        gone = cut(found.where(F.col(id_col) != F.col("component_id")).select(id_col))
        return not_in(docs, id_col, gone)
    plain = [c for c, t in docs.dtypes if not t.startswith("map")]
    rows = cut(docs.withColumn("skein_row", F.monotonically_increasing_id()).withColumn("skein_hash", F.xxhash64(*plain)).withColumn("skein_text", F.xxhash64(text_col)))
    found = jaccard_components(rows.select(F.col("skein_row").alias("id"), F.col(text_col).alias("text")), "id", "text", n, percent)
    found = found.select(F.col("id").alias("skein_row"), F.col("component_id").alias("skein_group"), F.col("n_shingles").alias("skein_n"))
    slim = rows.select("skein_row", id_col, "skein_hash", "skein_text").join(found, "skein_row")
    group = [F.when(F.col("skein_n") > 0, F.col("skein_group")), *[F.when(F.col("skein_n") == 0, F.col(c)) for c in (id_col, "skein_text")]]
    first = F.min(F.struct(F.col(id_col).isNull(), id_col, "skein_hash", "skein_row"))
    left = slim.groupBy(*[g.alias(f"skein_{i}") for i, g in enumerate(group)]).agg(first.alias("first")).select("first.skein_row")
    gone = cut(rows.select("skein_row").join(left, "skein_row", "left_anti"))
    return not_in(rows, "skein_row", gone).select(*docs.columns)
