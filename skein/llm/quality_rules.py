"""Quality rules with cutoffs whose false rejections are bounded on labelled documents.

A rule compares one statistic of a text with a cutoff. Strata are languages. For each stratum and rule, cutoffs of a fixed
grid are tested from the mildest to the strictest: a cutoff is certified if an exact binomial test on the labelled good
documents of the stratum rejects "more than alpha / rules of good documents are lost" at level
delta / (strata x rules). Testing stops at the first failure, so levels within a rule need no further split, and with the split
over strata and rules all certified cutoffs hold together with probability 1 - delta. Of these the one is taken that
catches most bad documents less `penalty` times the good ones lost; none if no cutoff gains. The guarantee is about good documents that
pass the base rules, which are no part of the method. Strata with too few labels certify nothing and lose nothing; report() lists
what was certified, with its upper bound.

Statistics are computed in one pass over whole texts; only counts per stratum, rule and grid cell reach the driver.

Edge cases. Null text has no words and fails the base rules, as do short texts. Null lang is a stratum of its own. Labels that are
null are ignored; a document labelled more than once counts with its lowest label. Rows that repeat an id are judged each. Empty
tables give empty results; without labels only the base rules act. Extra columns pass through; those named like
made ones are replaced. Values equal to a cutoff are kept. A very long text is measured in one piece, some 60 bytes a word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import SPACE, column_bytes, mix, pieces, spans_hash, sums, words
from .shared import cut

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: Rules: numerator, denominator, +1 if large values are rejected or -1 if small ones, cutoffs from mild to strict.
RULES: dict[str, tuple[str, str, int, list[float]]] = {
    "long_words": ("word_chars", "n_words", 1, [40 - 0.5 * k for k in range(64)]),
    "short_words": ("word_chars", "n_words", -1, [1 + 0.1 * k for k in range(30)]),
    "symbols": ("n_symbols", "n_words", 1, [2 * 0.9**k for k in range(64)]),
    "dup_lines": ("n_dup_lines", "n_lines", 1, [1 - k / 64 for k in range(64)]),
    "repeats": ("n_repeat_words", "n_words", 1, [0.5 - k / 128 for k in range(64)]),
}


def statistics(batch: pa.RecordBatch, text_col: str) -> list[np.ndarray]:
    """The STATISTICS of each row's whole text."""
    data, offsets = column_bytes(batch.column(text_col))
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(n, np.int64)] * len(STATISTICS)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, first = words(data, offsets)
    prefix = sums(data)
    n_words = np.diff(first)
    chars = per_doc(~SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = per_doc(SYMBOL[data])
    # lines that hold a word; equal ones are found by hashes keyed by document
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((breaks + 1, offsets[:-1])))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.append(begin[1:], len(data)), len(data))
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10))
    doc = np.searchsorted(offsets, begin, "right") - 1
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, doc = begin[full], stop[full], doc[full]
    keys = mix(spans_hash(prefix, begin, stop) + mix(doc.astype(np.uint64)))
    lines = np.bincount(doc, minlength=n)
    _, one = np.unique(keys, return_index=True)
    dups = lines - np.bincount(doc[one], minlength=n)
    # words in three-word windows that recur in the text
    repeated = np.zeros(n, np.int64)
    if len(starts) >= 3:
        h = spans_hash(prefix, starts, ends)
        doc = np.repeat(np.arange(n), n_words)
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        w = mix(h[at] + mix(h[at + 1] + mix(h[at + 2] + mix(doc[at].astype(np.uint64)))))
        order = np.argsort(w)
        s = w[order]
        same = s[1:] == s[:-1]
        hit = at[order[np.append(same, False) | np.append(False, same)]]
        marked = np.zeros(len(starts), dtype=bool)
        for k in range(3):
            marked[hit + k] = True
        repeated = np.bincount(doc[marked], minlength=n)
    return [n_words, chars, symbols, dups, repeated, lines]


def with_statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the STATISTICS; without the text unless it is kept."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in STATISTICS])
    names = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in statistics(batch, text_col))], [*names, *STATISTICS])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in STATISTICS]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: str) -> Column:
    top, bottom, *_ = RULES[rule]
    return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def at_least(value: Column) -> Callable[[Column], Column]:
    return lambda x: x >= value


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1, dtype=np.float64)
    logs = n * math.log1p(-p) + np.concatenate(([0.0], np.cumsum(np.log(n - i + 1) - np.log(i) + math.log(p) - math.log1p(-p))))
    top = logs.max()
    return min(1.0, float(np.exp(logs - top).sum() * math.exp(top))) if top > -700 else 0.0


def certified_cutoffs(cells: list[tuple], alpha: float, delta: float, penalty: float) -> list[tuple]:
    """Chosen cutoffs as (stratum, rule, cutoff, good, lost, caught), from (stratum, rule, cell, good, bad).

    Cell c holds documents that cutoff c and all stricter ones reject; cells past the grid are never rejected."""
    strata = sorted({c[0] for c in cells}, key=lambda s: (s is None, s or ""))
    level = delta / max(1, len(strata) * len(RULES))
    out = []
    for stratum in strata:
        for rule, (_, _, _, grid) in RULES.items():
            good, bad = np.zeros(len(grid) + 1, np.int64), np.zeros(len(grid) + 1, np.int64)
            for _, _, cell, g, b in (c for c in cells if c[0] == stratum and c[1] == rule):
                good[cell] += g
                bad[cell] += b
            best, choice = 0.0, None
            for k, (lost, caught) in enumerate(zip(np.cumsum(good)[:-1].tolist(), np.cumsum(bad)[:-1].tolist())):
                if binomial_at_most(lost, int(good.sum()), alpha / len(RULES)) > level:
                    break
                if caught - penalty * lost > best:
                    best, choice = caught - penalty * lost, (grid[k], int(good.sum()), lost, caught)
            if choice is not None:
                out.append((stratum, rule, *choice))
    return out


def upper_bound(lost: int, good: int, level: float) -> float:
    """The largest share of lost good documents that an exact test at this level does not refute."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_at_most(lost, good, mid) > level else (low, mid)
    return high


def report(chosen: list[tuple], strata: int, delta: float = 0.05) -> list[dict]:
    """What was certified: each cutoff with the labelled good documents, those lost, the bad ones caught and the bound of the share lost."""
    level = delta / max(1, strata * len(RULES))
    return [{"stratum": s, "rule": r, "cutoff": c, "good": g, "lost": n, "caught": b, "at_most_lost": upper_bound(n, g, level)} for s, r, c, g, n, b in chosen]


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", alpha: float = 0.05, delta: float = 0.05, penalty: float = 10.0) -> list[tuple]:
    """Cutoffs from documents with statistics and labels(id, quality: 1 good, 0 bad)."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("skein_id")).agg(F.min("quality").alias("skein_good"))
    seen = measured.where(~base_failed()).join(known, F.col(id_col) == F.col("skein_id"))
    cell = []
    for rule, (_, _, sign, grid) in RULES.items():
        # the number of cutoffs too mild to reject the value
        mild = F.size(F.filter(F.array(*[F.lit(g * float(sign)) for g in grid]), at_least(ratio(rule) * sign)))
        cell.append(F.struct(F.lit(rule).alias("rule"), mild.alias("cell")))
    cells = seen.select(F.col(stratum_col).alias("stratum"), F.col("skein_good").alias("good"), F.explode(F.array(*cell)).alias("c"))
    cells = cells.groupBy("stratum", "c.rule", "c.cell").agg(F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).alias("g"), F.sum(F.when(F.col("good") > 0, 0).otherwise(1)).alias("b"))
    return certified_cutoffs([tuple(r) for r in cells.toLocalIterator()], alpha, delta, penalty)


def judged(measured: DataFrame, chosen: list[tuple], stratum_col: str = "lang") -> DataFrame:
    """measured with base_failed and kept."""
    rejected = F.lit(False)
    for stratum, rule, cutoff, *_ in chosen:  # one condition per stratum and rule
        sign = RULES[rule][2]
        rejected = rejected | (F.col(stratum_col).eqNullSafe(F.lit(stratum)) & (ratio(rule) * sign > cutoff * sign))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk: float) -> DataFrame:
    """Statistics and verdicts per row, without texts; see the module's text."""
    measured = cut(with_statistics(docs.select(id_col, stratum_col, text_col), text_col, keep_text=False))
    return judged(measured, cutoffs(measured, labels, id_col, stratum_col, **risk), stratum_col)


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk: float) -> DataFrame:
    """The rows of docs that the rules keep, unchanged. Texts are measured again rather than joined, so they are not shuffled."""
    measured = cut(with_statistics(docs.select(id_col, stratum_col, text_col), text_col, keep_text=False))
    chosen = cutoffs(measured, labels, id_col, stratum_col, **risk)
    return judged(with_statistics(docs, text_col), chosen, stratum_col).where("kept").select(*docs.columns)
