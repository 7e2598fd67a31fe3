"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents, in a fixed order, form one stream of words that is cut into blocks. A source's target is met by
whole passes over its stream and a last pass over some of its blocks. The last pass's block quotas of all
sources are split among the output shards by a binary tree: each node draws, without replacement, how many blocks of
each source go to its left half. A keyed permutation orders a source's blocks; each shard has a run of that order to itself, as
long as its share of the quotas, and draws the first blocks of its run, as many as the tree gave it. Hence the tree decides which
blocks a source gives. Whole passes deal their blocks to the shards in the same runs. A hash orders the blocks
inside each shard. Nothing depends on partitions, settings, files or the order of rows: the fixed order is that of a hash of
the id, and buckets are ranges of that hash, so their number changes no place in it.

Block starts come from sums over (source, bucket of ids), so a hot source is spread over all buckets. A source has blocks of its own length, so
that some 64 of them at least are drawn from, down to single words. The driver holds
one row per source; the tree's quotas, shards x sources integers, are broadcast and have at most `MOST_CELLS` cells:
with more sources there are fewer, larger shards, and more sources than that are an error.

Edge cases. Null text has size 0 and takes nothing; a source without words has target 0. Null is a source of its own, last in order.
Rows that repeat an id are documents of their own; rows equal in id, text and source may trade places. An empty table
gives an empty result. Extra columns pass through; those named like made ones are replaced. A very long text is one row with many blocks, a
few dozen bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import runs
from .bytewords import mix
from .shared import parts_for

WORD = r"[^\x20\x09-\x0D]+"
BETWEEN = r"[\x20\x09-\x0D]+"  # what lies between words
MOST_CELLS = 1 << 22
BLOCK = T.StructType([T.StructField(n, T.LongType()) for n in ("pass", "first", "words", "shard", "place")])


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = 3, total: int | None = None) -> list[float]:
    """Shares of the total by weight; a target stops at most * size and its excess is shared again by weight."""
    left = sum(sizes) if total is None else total
    out, active = [0.0] * len(sizes), list(range(len(sizes)))
    while active:
        weight = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] > most * sizes[i] * weight]
        if not over:
            for i in active:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact blocks of each source in each shard (shards x sources); column sums are the quotas.

    Shards get equal block counts up to one; a node's seed is its place in the tree, so a rerun draws the same."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        draw = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, draw, method="marginals") if total else have
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def draws(j: np.ndarray, blocks: int, key: int, quotas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For blocks j of a source with `blocks` of them: the shard in whose run each lies, and its place in the order of what the
    shards draw (those before quotas[-1], the running sum's end), or -1 if its shard does not draw it.

    quotas: running sums over shards of the blocks that each draws, at most `blocks` in all. A shard's run is never shorter than its quota."""
    total = int(quotas[-1])
    rank = permuted(j, blocks, key)
    if not total:  # nothing is drawn; runs are even
        return rank * len(quotas) // max(blocks, 1), np.full(len(j), -1)
    ends = quotas * blocks // total
    shard = np.searchsorted(ends, rank, "right")
    order = rank - np.concatenate(([0], ends[:-1]))[shard] + np.concatenate(([0], quotas[:-1]))[shard]
    return shard, np.where(order < quotas[shard], order, -1)


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to x: four Feistel rounds, walked until inside the range."""
    if n < 2:
        return x.astype(np.int64)
    half = ((n - 1).bit_length() + 1) // 2
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(key * 4 + 1, key * 4 + 5, dtype=np.uint64))
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[todo] = v = (left << np.uint64(half)) | right
        todo = todo[v >= n]
    return out.astype(np.int64)


def word_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with size (words; null text has none) and a hash that orders rows of one id."""
    size = F.size(runs(F.coalesce(F.col(text_col), F.lit("")), BETWEEN)).cast("long")
    return docs.drop("size").withColumn("size", size).withColumn("skein_tie", F.xxhash64(text_col))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = 3, block_words: int = 128, shard_words: int = 4_000_000, seed: int = 20240601, blocks: bool = True) -> DataFrame:
    """docs with size, source_size, target, taken (words the mix takes, repeats counted) and, with `blocks`,
    the blocks it takes: pass, first word in the document, words, shard and place in the shard.

    A table from word_sizes() needs no text. Sources in code-point order, null last, have the weights in turn. Taken words of a source add up to its rounded
    target. Blocks grow with the corpus beyond 2e8 blocks, so that the tree's draws stay in range, and never exceed n // 64 + 1 words of a source of
    n."""
    ready = "skein_tie" in docs.columns
    made = ["source_size", "target", "taken", "blocks"] + ["size"] * (not ready)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    sized = docs if ready else word_sizes(docs, text_col)
    kept = [c for c in docs.columns if c not in ("size", "skein_tie")]
    totals = sized.groupBy(source_col).agg(F.sum("size")).limit(MOST_CELLS + 1)
    per = sorted(((r[0], r[1]) for r in totals.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes = [r[0] for r in per], [int(r[1] or 0) for r in per]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(per))], most)
    if len(per) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} sources")
    longest = max(block_words, sum(sizes) * most // 200_000_000 + 1)
    plan, last = {}, []
    for i, (name, n, t) in enumerate(zip(names, sizes, goal)):
        whole, rest = divmod(min(round(t), most * n), n) if n else (0, 0)
        block = min(longest, n // 64 + 1)
        count = n // block
        full, extra = divmod(rest, block)
        # the last of the drawn blocks gives `cut` words; words that exceed all full blocks come from the stream's short end
        drawn, cut, tail = (full + (extra > 0), extra or block, 0) if full + (extra > 0) <= count else (count, block, extra)
        plan[name] = (i, n, t, whole, count, cut, tail, block)
        last.append(drawn)
    shards = max(1, min(-(-sum(map(round, goal)) // shard_words), MOST_CELLS // max(len(per), 1)))
    quotas = np.cumsum(split_quotas(np.array(last, np.int64), shards, seed), axis=0).T if last else np.zeros((0, shards), np.int64)
    quotas = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(quotas))
    plans = docs.sparkSession.sparkContext.broadcast(plan)

    # where each document starts in its source's stream: sums of earlier buckets, then a running sum inside the bucket
    n_buckets = parts_for(docs, 16_000_000)
    place = F.xxhash64(id_col)
    bucket = F.least(F.floor((place.cast("double") / float(1 << 64) + 0.5) * n_buckets), F.lit(n_buckets - 1)).cast("int")  # grows with the hash
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))  # never null, so that window and join share one exchange
    keyed = sized.withColumn("skein_source", source).withColumn("skein_bucket", bucket).withColumn("skein_hash", place)
    sums = keyed.groupBy("skein_source", "skein_bucket").agg(F.sum("size").alias("skein_sum"))
    before = W.partitionBy("skein_source").orderBy("skein_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("skein_source", "skein_bucket", F.coalesce(F.sum("skein_sum").over(before), F.lit(0)).alias("skein_before"))
    inside = W.partitionBy("skein_source", "skein_bucket").orderBy("skein_hash", id_col, "size", "skein_tie").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("skein_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = keyed.join(sums, ["skein_source", "skein_bucket"])
    placed = placed.withColumn("skein_start", F.col("skein_start") + F.col("skein_before")).select(*kept, "size", "skein_start")
    fields = [*placed.schema.fields[:-1], T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("taken", T.LongType())] + [T.StructField("blocks", T.ArrayType(BLOCK))] * blocks

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plans.value
        for batch in batches:
            source = batch.column(source_col).to_pylist()
            own = np.array([plan[s][0] for s in source], np.int64)
            size, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "skein_start"))
            taken, rows = np.zeros(len(own), np.int64), []
            for i in np.unique(own).tolist():
                _, n, _, whole, count, cut, tail, block = plan[names[i]]
                at = np.flatnonzero((own == i) & (size > 0))
                if not len(at):
                    continue
                first, stop = start[at] // block, (start[at] + size[at] - 1) // block
                per_doc = stop - first + 1
                doc = np.repeat(at, per_doc)
                j = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + np.repeat(first, per_doc)
                low, high = np.maximum(j * block, start[doc]), np.minimum((j + 1) * block, start[doc] + size[doc])
                inner, drawn = j < count, int(quotas.value[i, -1])
                for p in range(whole + (drawn > 0 or tail > 0)):
                    shard, order = (np.full(len(j), x) for x in (shards - 1, -1))
                    shard[inner], order[inner] = draws(j[inner], count, (seed + i) * 8 + p, quotas.value[i])
                    if p < whole:
                        end = high
                    else:
                        words_left = np.where(inner, np.where(order < 0, 0, np.where(order == drawn - 1, cut, block)), tail)
                        end = np.minimum(high, j * block + words_left)
                    words = np.maximum(end - low, 0)
                    np.add.at(taken, doc, words)
                    if blocks:
                        some = words > 0
                        place = (mix((j[some] * most + p).astype(np.uint64) * np.uint64(len(names)) + np.uint64(i) + np.uint64(seed)) >> np.uint64(1)).astype(np.int64)
                        rows.append((doc[some], np.full(some.sum(), p), (low - start[doc])[some], words[some], shard[some], place))
            columns = [batch.column(c) for c in (*kept, "size")]
            columns += [pa.array(np.array([plan[s][k] for s in source], t)) for k, t in ((1, np.int64), (2, np.float64))] + [pa.array(taken)]
            if blocks:
                flat = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 6
                order = np.lexsort((flat[2], flat[1], flat[0]))
                ends = np.searchsorted(flat[0][order], np.arange(len(own) + 1))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x[order], pa.int64()) for x in flat[1:]], BLOCK.names)))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    out = placed.mapInArrow(draw, T.StructType(fields))
    out.skein_shards = shards
    return out


def mixed_documents(mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as documents: a row per document and pass with the text that the pass takes, in the shard of its first block.

    A pass that takes all words has the text unchanged; one that takes some has their blocks' words, joined by spaces.
    mixed is what mix_sources() returned. Each shard lies in one partition, of as many as there are shards, shuffled by its
    blocks' places, so that a document's passes part."""
    passes = mixed.withColumn("skein_pass", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["pass"]))))
    own = F.filter("blocks", lambda b: b["pass"] == F.col("skein_pass"))
    words = runs(F.col(text_col), BETWEEN)
    some = F.array_join(F.flatten(F.transform("skein_own", lambda b: F.slice("skein_words", b["first"].cast("int") + 1, b["words"].cast("int")))), " ")
    whole = F.aggregate("skein_own", F.lit(0).cast("long"), lambda n, b: n + b["words"]) == F.col("size")
    passes = passes.withColumn("skein_own", own).withColumn("skein_whole", whole).withColumn("skein_words", F.when(~F.col("skein_whole"), words))
    passes = passes.withColumn(text_col, F.when(F.col("skein_whole"), F.col(text_col)).otherwise(some))
    passes = passes.withColumn("skein_shard", F.col("skein_own")[0]["shard"]).withColumn("skein_place", F.col("skein_own")[0]["place"]).drop("blocks", "skein_own", "skein_whole", "skein_words")
    return passes.repartition(mixed.skein_shards, "skein_shard").sortWithinPartitions("skein_shard", "skein_place", id_col, "skein_pass").drop("skein_pass", "skein_shard", "skein_place")


def shuffled_blocks(mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix in blocks: one row per block with its words' text, shards as partitions, shuffled inside each shard."""
    words = runs(F.col(text_col), BETWEEN)
    out = mixed.select(id_col, F.explode("blocks").alias("b"), text_col).select(id_col, "b.*", F.array_join(F.slice(words, F.col("b.first").cast("int") + 1, F.col("b.words").cast("int")), " ").alias("text"))
    return out.repartition(mixed.skein_shards, "shard").sortWithinPartitions("shard", "place", id_col, "first")
