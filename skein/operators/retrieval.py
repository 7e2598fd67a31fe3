"""Keyword and vector retrieval, and their fusion. Every function takes all queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BETWEEN_TOKENS, runs

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, *text: str, terms: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """key, keep, term, tf, size: the inverted index, or its part for `terms`; size is the number of tokens of the document.

    Rows are documents, one a key. The whole index needs no shuffle: a row's sorted tokens are counted by where each begins."""
    tokens = runs(F.lower(F.concat_ws(" ", *text)), BETWEEN_TOKENS)
    if terms is None:
        held = docs.select(key, *keep, F.sort_array(tokens).alias("tokens")).select(key, *keep, "tokens", F.size("tokens").alias("n")).where("n > 0")
        new = lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", F.greatest(i - 1, F.lit(0))))
        held = held.select(key, *keep, "tokens", "n", F.filter(F.sequence(F.lit(0), F.col("n") - 1), new).alias("starts"))
        counted = F.transform("starts", lambda i, j: F.struct(F.get("tokens", i).alias("term"), (F.coalesce(F.get("starts", j + 1), F.col("n")) - i).cast("long").alias("tf")))
        return held.select(key, *keep, F.col("n").cast("long").alias("size"), F.explode(counted).alias("p")).select(key, *keep, "p.term", "size", "p.tf")
    # size before the explode, so that exploded rows don't carry the array
    each = docs.select(key, *keep, tokens.alias("tokens")).select(key, *keep, "tokens", F.size("tokens").cast("long").alias("size")).select(key, *keep, "size", F.explode("tokens").alias("term"))
    each = each.join(terms, "term", "left_semi")  # before the shuffle
    return each.groupBy(key, *keep, "term", "size").agg(F.count("*").alias("tf"))


def document_sizes(docs: DataFrame, key: str, *text: str, keep: Sequence[str] = ()) -> DataFrame:
    return docs.select(key, *keep, F.size(runs(F.lower(F.concat_ws(" ", *text)), BETWEEN_TOKENS)).cast("long").alias("size"))


class Index:
    """An inverted index: postings and, for each value of `kind` (a constant if None), the statistics over all its documents."""

    def __init__(self, rows: DataFrame, stats: DataFrame, key: str, keep: Sequence[str], kind: str | None):
        self.rows, self.stats, self.key, self.keep, self.kind = rows, stats, key, list(keep), kind

    @classmethod
    def of(cls, docs: DataFrame, key: str, text: Sequence[str], keep: Sequence[str] = (), kind: str | None = None, terms: DataFrame | None = None) -> Index:
        """The index of docs; with `terms` (one column, term) only its part for them, as a query on demand reads it."""
        named = [*keep, *([kind] if kind and kind not in keep else [])]
        group = [F.col(kind).alias("skein_kind")] if kind else [F.lit(0).alias("skein_kind")]
        stats = document_sizes(docs, key, *text, keep=named).groupBy(*group).agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
        return cls(postings(docs, key, *text, terms=terms, keep=named), stats, key, named, kind)

    def stored(self, write: Callable[[DataFrame], DataFrame]) -> Index:
        """The same over written tables; write() returns what it wrote."""
        return Index(write(self.rows), write(self.stats), self.key, self.keep, self.kind)

    def search(self, queries: DataFrame, limit: Column | int, by: Sequence[str] = (), condition: Column | None = None, before: tuple[str, str] | None = None) -> DataFrame:
        """The best documents of each query (query_id, by, terms) and kind: query_id, key, keep, score (negative, best least) and rank.

        `by` columns of query and document must agree. Statistics cover all documents; `by` and `condition` filter afterwards.

        before: a document's and a query's column; documents must have less, unless the query has null. For many queries over a stored index:
        blocks of queries and of documents meet in one group each, and no pair of them travels. A limit may then depend on kind and keep."""
        kind = F.col(self.kind) if self.kind else F.lit(0)
        rows = self.rows.withColumn("skein_kind", kind)
        wanted = queries.select("query_id", *by, F.explode(F.array_distinct("terms")).alias("term")).withColumn("term", F.lower("term")).distinct()
        known = rows.join(wanted.select("term").distinct(), "term", "left_semi")
        df = known.groupBy("skein_kind", "term").agg(F.count("*").alias("df"))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = df.join(self.stats, "skein_kind").select("skein_kind", "term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "mean")
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        ranks = W.partitionBy("query_id", "skein_kind").orderBy(F.round("score", 9), self.key)  # the order of a sum's terms decides no tie
        if before is not None:
            weighted = known.join(weights, ["skein_kind", "term"]).select(self.key, *self.keep, "skein_kind", "term", part.alias("skein_part"), (F.lit(limit) if isinstance(limit, int) else limit).alias("skein_most"))
            bounded = wanted.join(queries.select("query_id", F.col(before[1]).cast("double").alias("skein_before")), "query_id")
            scored = scored_in_tiles(weighted, bounded, self.key, self.keep, list(by), before[0])
            return scored.select("query_id", self.key, *self.keep, "score", F.row_number().over(ranks).alias("rank")).where(F.col("rank") <= limit)
        scored = known.join(weights, ["skein_kind", "term"]).join(wanted, ["term", *by])
        scored = scored.groupBy("query_id", self.key, *self.keep, "skein_kind").agg((-F.sum(part)).alias("score"))
        if condition is not None:
            scored = scored.join(queries.drop(*by, "terms"), "query_id").where(condition)
        return scored.select("query_id", self.key, *self.keep, "score", F.row_number().over(ranks).alias("rank")).where(F.col("rank") <= limit)


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: Sequence[str], limit: int, keep: Sequence[str] = (), by: Sequence[str] = (), condition: Column | None = None) -> DataFrame:
    """Index.search() over the part of an index that the queries need, made on the way: only postings of queried terms are shuffled."""
    terms = queries.select(F.explode("terms").alias("term")).select(F.lower("term").alias("term")).distinct()
    return Index.of(docs, key, text, [*keep, *[b for b in by if b not in keep]], terms=terms).search(queries, limit, by, condition)


#: Postings and queried terms of a tile at most, about.
TILE_POSTINGS, TILE_TERMS = 500_000, 50_000


def scored_in_tiles(weighted: DataFrame, wanted: DataFrame, key: str, keep: list[str], by: list[str], at: str) -> DataFrame:
    """query_id, key, keep, skein_kind and score of a superset of each query's and kind's best documents.

    weighted: key, keep, skein_kind, term, skein_part, skein_most; wanted: query_id, by, term, skein_before. Each group of `by` is dealt into
    blocks of documents and of queries; in a tile a query's terms add up over the tile's documents."""
    n, m = weighted.groupBy(*by).agg(F.count("*").alias("n")), wanted.groupBy(*by).agg(F.count("*").alias("m"))
    sizes = (n.join(m, by) if by else n.crossJoin(m)).select(*by, F.ceil(F.col("n") / TILE_POSTINGS).cast("int").alias("doc_blocks"), F.ceil(F.col("m") / TILE_TERMS).cast("int").alias("query_blocks"))
    deal = lambda df: df.join(sizes, by) if by else df.crossJoin(sizes)
    block = lambda c, parts: F.pmod(F.xxhash64(c), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    groups, shown = [F.col(b).alias(f"skein_by_{i}") for i, b in enumerate(by)], list(dict.fromkeys([key, *keep, "skein_kind"]))
    tile = [*[f"skein_by_{i}" for i in range(len(by))], "doc_block", "query_block"]
    left = deal(wanted).where("doc_blocks > 0").select("query_id", "term", "skein_before", *groups, block("query_id", "query_blocks").alias("query_block"), every("doc_blocks").alias("doc_block"))
    right = deal(weighted).where("query_blocks > 0").select(*shown, "term", "skein_part", "skein_most", *groups, block(key, "doc_blocks").alias("doc_block"), every("query_blocks").alias("query_block"))
    schema = T.StructType([left.schema["query_id"], *[right.schema[c] for c in shown], T.StructField("score", T.DoubleType())])
    codes = lambda c: c.combine_chunks().dictionary_encode(null_encoding="encode")

    def search(q: pa.Table, p: pa.Table) -> pa.Table:
        found = []
        if len(q) and len(p):
            terms, kinds = codes(p.column("term")), codes(p.column("skein_kind")).indices.to_numpy()
            document, first, of = np.unique(codes(p.column(key)).indices.to_numpy().astype(np.int64) * (int(kinds.max()) + 1) + kinds, return_index=True, return_inverse=True)
            order = np.argsort(terms.indices.to_numpy(), kind="stable")
            ends = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
            of, part = of[order], p.column("skein_part").to_numpy()[order]
            place = p.column(at).cast(pa.float64()).to_numpy()[first]  # null: NaN, which is before nothing
            most, kind = p.column("skein_most").fill_null(0).to_numpy()[first], kinds[first]
            asked = np.asarray(pc.fill_null(pc.index_in(q.column("term"), value_set=terms.dictionary), -1))
            query = codes(q.column("query_id")).indices.to_numpy()
            bound = q.column("skein_before").to_numpy()
            by_query = np.argsort(query, kind="stable")
            for rows in np.split(by_query, np.flatnonzero(np.diff(query[by_query])) + 1):
                spans = [slice(ends[t], ends[t + 1]) for t in asked[rows] if t >= 0]
                if not spans:
                    continue
                docs = np.concatenate([of[x] for x in spans])
                total = np.bincount(docs, weights=np.concatenate([part[x] for x in spans]), minlength=len(document))
                hit = np.zeros(len(document), bool)
                hit[docs] = True
                if not np.isnan(bound[rows[0]]):
                    hit &= place < bound[rows[0]]
                for one in np.unique(kind[hit]):
                    j = np.flatnonzero(hit & (kind == one))
                    k = int(most[j].max())
                    if len(j) > k > 0:  # within what rounding makes equal all stay
                        j = j[total[j] >= np.partition(total[j], len(j) - k)[len(j) - k] - 1e-8]
                    if k > 0:
                        found.append((np.full(len(j), rows[0]), first[j], -total[j]))
        i, j, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, float))
        return pa.table([q.column("query_id").take(pa.array(i)), *p.select(shown).take(pa.array(j)).columns, pa.array(score)], names=["query_id", *shown, "score"])

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(search, schema)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def knn(corpus: DataFrame | None, queries: DataFrame, key: str, vector: str, limit: Column | int, keep: Sequence[str] = (), by: Sequence[str] = (), kind: str | None = None, cells: Cells | None = None, probes: int = 24) -> DataFrame:
    """The nearest rows of each query (query_id, query_vector, by) and kind by squared Euclidean distance; a corpus of None has none.

    `by` columns must agree. Every query meets all rows that agree with it, in tiles of a block of queries and a block of rows (tiled());
    the window ranks what is left. Rows and queries without a vector, or with vectors of different lengths, don't meet. A limit that is
    a column may depend on key, kind and keep.

    cells: rows are searched in the `probes` nearest cells of a query only (Cells); a corpus that has a column `cell` is taken as assigned."""
    if corpus is None:
        return queries.where("false").select("query_id", *[F.lit(None).cast("string" if c == kind else "long").alias(c) for c in (key, *keep)], F.lit(None).cast("double").alias("distance"), F.lit(0).alias("rank"))
    held = [F.col("cell").alias("skein_cell")] if cells is not None and "cell" in corpus.columns else []
    rows, asked = corpus.where(F.col(vector).isNotNull()).select(key, vector, *keep, *[b for b in by if b not in keep], *held), queries.select("query_id", "query_vector", *by)
    if cells is None:
        scored = tiled(rows.withColumn("skein_most", F.lit(limit) if isinstance(limit, int) else limit), asked, key, vector, list(keep), list(by), kind)
    else:
        rows = rows.withColumn("cell", F.col("skein_cell")).drop("skein_cell") if "skein_cell" in rows.columns else cells.assigned(rows, vector)
        asked = cells.assigned(asked, "query_vector", max(probes, 2), "near").withColumn("cell", F.explode("near")).drop("near")
        pairs = rows.join(asked, [*by, "cell"])
        scored = pairs.where(F.size(vector) == F.size("query_vector")).select("query_id", key, *keep, squared_distance(F.col(vector), F.col("query_vector")).alias("distance"))
    ranks = W.partitionBy("query_id", *([kind] if kind else [])).orderBy("distance", key)
    return scored.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= limit)


#: Rows and queries of a tile at most, about.
TILE_ROWS, TILE_QUERIES = 8192, 16_384


def tiled(rows: DataFrame, asked: DataFrame, key: str, vector: str, keep: list[str], by: list[str], kind: str | None) -> DataFrame:
    """query_id, key, keep and distance of a superset of each query's and kind's nearest; at most skein_most rows a tile.

    Each group of `by` is dealt into blocks of queries and of rows, and each pair of blocks meets in one group: what is shuffled grows with
    rows x queries / the size of a block. Inside, products of matrices bound all distances; only rows that the bounds allow are measured,
    component by component in double precision."""
    of_rows, of_asked = F.ceil(F.col("n") / TILE_ROWS).cast("int"), F.ceil(F.col("m") / TILE_QUERIES).cast("int")
    asked = asked.where("query_vector IS NOT NULL").select("query_id", doubles(asked, "query_vector"), *[F.col(b).cast(rows.schema[b].dataType).alias(b) for b in by])
    n, m = rows.groupBy(*by).agg(F.count("*").alias("n")), asked.groupBy(*by).agg(F.count("*").alias("m"))
    sizes = (n.join(m, by) if by else n.crossJoin(m)).select(*by, of_rows.alias("row_blocks"), of_asked.alias("query_blocks"))
    deal = lambda df: df.join(sizes, by) if by else df.crossJoin(sizes)
    block = lambda c, parts: F.pmod(F.xxhash64(c), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    shown = list(dict.fromkeys([key, *keep]))
    # groups' own columns have names of their own, so that keep may name them too
    groups = [F.col(b).alias(f"skein_by_{i}") for i, b in enumerate(by)]
    tile = [*[f"skein_by_{i}" for i in range(len(by))], "row_block", "query_block"]
    left = deal(asked).where("row_blocks > 0").select("query_id", "query_vector", *groups, block("query_id", "query_blocks").alias("query_block"), every("row_blocks").alias("row_block"))
    right = deal(rows.withColumn("skein_vector", doubles(rows, vector))).where("query_blocks > 0").select(*shown, "skein_vector", "skein_most", *groups, block(key, "row_blocks").alias("row_block"), every("query_blocks").alias("query_block"))
    schema = T.StructType([left.schema["query_id"], *[right.schema[c] for c in shown], T.StructField("distance", T.DoubleType())])

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        found = []
        if len(q) and len(v):
            asks, held = vector_lists(q.column("query_vector")), vector_lists(v.column("skein_vector"))
            order = np.asarray(pc.rank(v.column(key), sort_keys="ascending", null_placement="at_start", tiebreaker="first"))
            kinds = v.column(kind).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() if kind else np.zeros(len(v), np.int64)
            most = v.column("skein_most").fill_null(0).to_numpy()
            for length in np.unique(asks[0]):
                i = np.flatnonzero(asks[0] == length)
                for one in np.unique(kinds):
                    j = np.flatnonzero((held[0] == length) & (kinds == one))
                    if len(j) and (k := int(most[j].max())) > 0:
                        found += [(i[a], j[b], x, none) for a, b, x, none in nearest_pairs(*block_of(asks, i, int(length)), *block_of(held, j, int(length)), order[j], k)]
        i, j, far, none = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, float, bool))
        picked = v.select(shown).take(pa.array(j))
        return pa.table([q.column("query_id").take(pa.array(i)), *picked.columns, pa.array(far, mask=none)], names=["query_id", *shown, "distance"])

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(search, schema)


def doubles(df: DataFrame, vector: str) -> Column:
    """The vector in double precision, or in single if it comes so."""
    return F.col(vector) if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else F.col(vector).cast("array<double>").alias(vector)


def vector_lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, starts, components (null: NaN) and where they are null."""
    lists = column.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy()
    flat = lists.flatten()
    return lengths, np.cumsum(lengths) - lengths, flat.to_numpy(zero_copy_only=False).astype(float), flat.is_null().to_numpy(zero_copy_only=False)


def block_of(lists: tuple[np.ndarray, ...], some: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as a matrix, and which of them hold a null."""
    at = lists[1][some][:, None] + np.arange(length)
    return lists[2][at], lists[3][at].any(axis=1)


def nearest_pairs(q: np.ndarray, q_null: np.ndarray, v: np.ndarray, v_null: np.ndarray, order: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Index of query and row, distance, and whether it is null, of each query's k nearest, as Spark orders them: null first, NaN last; ties by `order`.

    |q|^2 + |v|^2 - 2qv lies within `room` of the distance summed component by component. Vectors with null, non-finite or huge components
    are measured with all."""
    q_odd, v_odd = (~(np.abs(x) < 1e140).all(axis=1) for x in (q, v))
    q_safe, v_safe = np.where(q_odd[:, None], 0.0, q), np.where(v_odd[:, None], 0.0, v)
    q_square, v_square = (q_safe * q_safe).sum(axis=1), (v_safe * v_safe).sum(axis=1)
    q_columns, v_columns = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
    room, step = 4 * (q.shape[1] + 4) * float(np.finfo(float).eps), max(1, 2_000_000 // len(v))
    for at in range(0, len(q), step):
        end = min(at + step, len(q))
        both = q_square[at:end, None] + v_square
        far = both - 2 * (q_safe[at:end] @ v_safe.T)
        both *= room
        if len(v) > k:
            upper = far + both
            upper[:, v_odd] = np.inf
            upper.partition(k - 1, axis=1)
            allowed = (far - both <= upper[:, k - 1 : k]) | v_odd | q_odd[at:end, None]
            i, j = np.nonzero(allowed)
        else:
            i, j = np.divmod(np.arange((end - at) * len(v)), len(v))
        i = i + at
        exact = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for x, y in zip(q_columns, v_columns):
                apart = x[i] - y[j]
                exact += apart * apart
        none = q_null[i] | v_null[j]
        sorted_ = np.lexsort((order[j], np.where(none, 0.0, exact), ~none, i))
        i, j, exact, none = i[sorted_], j[sorted_], exact[sorted_], none[sorted_]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[keep], j[keep], exact[keep], none[keep]


class Cells:
    """An inverted file over vectors: centroids fitted on a bounded sample, and every row in the cell of its nearest one. A query looks into the
    cells of its nearest centroids only, and distances there are exact; knn() without cells looks at all rows.

    Centroids are at most `MOST` and travel to all tasks; `sample` rows, by the least hash of their vectors, fit them."""

    MOST = 4096

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def fit(cls, rows: DataFrame, vector: str, cells: int | None = None, sample: int = 50_000, rounds: int = 10, seed: int = 7) -> Cells:
        """Lloyd's rounds on the driver over at most `sample` vectors; cells defaults to the root of the number of rows. Vectors that are
        null or of another length than most take no part."""
        sizes = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
        if sizes is None:
            return cls(np.zeros((0, 0)))
        good = rows.where(F.size(vector) == sizes["size"]).select(F.col(vector).cast("array<double>").alias("v"))
        held = good.withColumn("h", F.xxhash64("v")).orderBy("h").limit(sample).select("v").toPandas()["v"]
        data = np.array(held.tolist())
        count = max(1, min(cells or int(np.sqrt(sizes["n"])), cls.MOST, len(data)))
        centroids = data[np.random.default_rng(seed).permutation(len(data))[:count]].copy()
        for _ in range(rounds):
            near = nearest_of(data, centroids, 1)[:, 0]
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, data)
            n = np.bincount(near, minlength=count)[:, None]
            moved = np.where(n > 0, sums / np.maximum(n, 1), centroids)
            if np.allclose(moved, centroids):
                break
            centroids = moved
        return cls(centroids)

    def assigned(self, rows: DataFrame, vector: str, probes: int = 1, out: str = "cell") -> DataFrame:
        """rows with the cells of their nearest centroids in `out`: one (an int), or an array of up to `probes`. Without a usable vector null."""
        shared = rows.sparkSession.sparkContext.broadcast(self.centroids)
        kind = "int" if probes == 1 else "array<int>"

        @F.pandas_udf(kind)
        def cell(vectors: pd.Series) -> pd.Series:
            centroids = shared.value
            fits = vectors.map(lambda v: v is not None and len(v) == centroids.shape[1]).to_numpy(dtype=bool) if len(vectors) else np.zeros(0, bool)
            found: list[object] = [None] * len(vectors)
            if fits.any() and len(centroids):
                near = nearest_of(np.array(vectors[fits].tolist(), float), centroids, probes)
                for i, x in zip(np.flatnonzero(fits), near):
                    found[i] = int(x[0]) if probes == 1 else x.tolist()
            return pd.Series(found, dtype=object)

        return rows.withColumn(out, cell(vector))


def nearest_of(data: np.ndarray, centroids: np.ndarray, n: int, block: int = 2048) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    n, square = min(n, len(centroids)), (centroids * centroids).sum(axis=1)
    out = np.empty((len(data), n), np.int64)
    for at in range(0, len(data), block):
        far = square - 2 * data[at : at + block] @ centroids.T
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        out[at : at + block] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return out


def rank_score(rank: Column, size: Column) -> Column:
    """1 for the first, falling by 1 / size a rank; 0 without rows."""
    return F.when(size <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - (rank - 1) / F.greatest(size, F.lit(1))))


def proximity(current: Column, source: Column) -> Column:
    return F.when(source < current, 1.0 / (1.0 + (current - source))).otherwise(F.lit(0.0))


def fuse(hits: DataFrame, limit: int, alpha: float = 0.7, beta: float = 0.2) -> DataFrame:
    """Fuses ranked legs. hits: query_id, current_idx, leg (0 chunk vectors, 1 narration vectors, 2 keywords), rank,
    source_type, source_id, chapter_idx.

    Rank scores use each leg's size before the causal filter; then, per source, the best of each kind counts and the first
    hit in leg order says where it is."""
    leg = W.partitionBy("query_id", "leg")
    scored = hits.withColumn("s", rank_score(F.col("rank"), F.count("*").over(leg)))
    scored = scored.where(F.col("current_idx").isNull() | (F.col("chapter_idx") < F.col("current_idx")))
    per = scored.groupBy("query_id", "source_type", "source_id").agg(
        F.coalesce(F.max(F.when(F.col("leg") < 2, F.col("s"))), F.lit(0.0)).alias("vector_score"),
        F.coalesce(F.max(F.when(F.col("leg") == 2, F.col("s"))), F.lit(0.0)).alias("keyword_score"),
        F.min_by(F.struct("chapter_idx", "current_idx"), F.struct("leg", "rank")).alias("m"),
        F.min(F.struct("leg", "rank")).alias("seq"),
    )
    score = alpha * F.col("vector_score") + (1 - alpha) * F.col("keyword_score") + beta * F.coalesce(proximity(F.col("m.current_idx"), F.col("m.chapter_idx")), F.lit(0.0))
    per = per.select("query_id", "source_type", "source_id", F.col("m.chapter_idx").alias("chapter_idx"), score.alias("score"), "seq")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("seq")


def prefer_chapter(hits: DataFrame, limit: int) -> DataFrame:
    """Hits of the query's own chapter first, then the others, each in rank order."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.col("chapter_idx") == F.col("current_idx")), "rank")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
